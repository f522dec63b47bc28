"""Registered queries: one per operator, over whole driver tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as T
from corpusmill.functions import values as V
from corpusmill.operators import assessment as A
from corpusmill.operators import audit, boolean_query, dedup, flow, gold, question, quotes, review, screening
from corpusmill.operators.adapters import RuleAdapter
from corpusmill.plans.tables import RECORDS, SCREENED, records, screened, table
from corpusmill.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: ASCII normal form in SQL; the engine's own is Unicode-aware.
NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- duplicates -----------------------------------------------------------------


@query(f"SELECT count(*) AS groups, sum(n)::BIGINT AS records_identified, sum(n - 1)::BIGINT AS duplicates_removed FROM (SELECT {NORM.format('text')} AS k, count(*) AS n FROM documents GROUP BY 1)")
def dedup_group_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return dedup.group_counts(d, dedup.match_key(F.lit(""), "text", F.col("doc_id")))


@query(f"SELECT doc_id, group_size FROM (SELECT doc_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY {NORM.format('text')} ORDER BY n_chars DESC, doc_id) AS rn FROM documents WINDOW w AS (PARTITION BY {NORM.format('text')})) WHERE rn = 1")
def dedup_survivor(spark, sf_dir):
    """Richest record of each group: an arg-max aggregate, so a large group is combined map-side."""
    d = table(spark, sf_dir, "documents").withColumn("k", V.sha256(T.norm_dedup("text")))
    best = F.min(F.struct((-F.col("n_chars")).alias("minus"), "doc_id")).alias("b")
    return d.groupBy("k").agg(best, F.count("*").alias("group_size")).select("b.doc_id", "group_size")


def _entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    longer = F.concat(F.col("text"), F.when(i % 3 == 0, "").when(i % 3 == 1, " One more sentence.").otherwise(" One more sentence. And another one."))
    return d.select(
        "doc_id", F.col("text").alias("Title"), F.lit("").alias("DOI"), F.when(i % 3 != 0, F.col("source")).otherwise("").alias("Authors"),
        F.when(i % 2 == 0, (2000 + i % 20).cast("string")).otherwise("").alias("Year"), F.when(i % 4 == 3, "").when(i % 4 == 2, F.concat(longer, F.lit("..."))).otherwise(longer).alias("Abstract"),
    )


CONSOLIDATE_SQL = rf"""
WITH RECURSIVE e AS (
  SELECT doc_id, text AS Title, CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS Authors,
    CASE WHEN doc_id % 2 = 0 THEN (2000 + doc_id % 20)::VARCHAR ELSE '' END AS Year,
    CASE WHEN doc_id % 4 = 3 THEN '' ELSE text || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' One more sentence.' ELSE ' One more sentence. And another one.' END || CASE WHEN doc_id % 4 = 2 THEN '...' ELSE '' END END AS Abstract, sha256({NORM.format('text')}) AS k
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (trim(Abstract) <> '')::INT + (trim(Authors) <> '')::INT + (Year <> '')::INT DESC, doc_id) AS rn,
        count(*) OVER (PARTITION BY k) AS n, min(doc_id) OVER (PARTITION BY k) AS first_id FROM e),
f AS (
  SELECT k, rn, n, first_id, Title, Authors, Year, Abstract FROM r WHERE rn = 1
  UNION ALL
  SELECT f.k, r.rn, f.n, f.first_id, CASE WHEN f.Title = '' THEN r.Title ELSE f.Title END,
    CASE WHEN r.Authors = '' THEN f.Authors WHEN f.Authors = '' THEN r.Authors
         WHEN contains(lower(r.Authors), lower(f.Authors)) AND length(r.Authors) > length(f.Authors) THEN r.Authors ELSE f.Authors END,
    CASE WHEN f.Year = '' THEN r.Year ELSE f.Year END,
    CASE WHEN r.Abstract = '' THEN f.Abstract WHEN f.Abstract = '' THEN r.Abstract
         WHEN trim(rtrim({NORM.format('f.Abstract')}, '.…')) <> '' AND contains({NORM.format('r.Abstract')}, trim(rtrim({NORM.format('f.Abstract')}, '.…')))
              AND length({NORM.format('r.Abstract')}) > length({NORM.format('f.Abstract')}) THEN r.Abstract ELSE f.Abstract END
  FROM f JOIN r ON r.k = f.k AND r.rn = f.rn + 1)
SELECT first_id AS doc_id, n AS group_size, sha256(Title) AS title_sha, Authors, Year, sha256(Abstract) AS abstract_sha, row_number() OVER (ORDER BY first_id) AS place FROM f WHERE rn = n"""


@query(CONSOLIDATE_SQL)
def consolidate_fields(spark, sf_dir):
    """Whole records folded; groups stand in the order of their first records."""
    out = dedup.consolidate(_entries(spark, sf_dir), ["doc_id"])
    out = out.select("doc_id", "group_size", V.sha256(F.col("Title")).alias("title_sha"), "Authors", "Year", V.sha256(F.col("Abstract")).alias("abstract_sha"))
    return review.ranked(out, [F.col("doc_id").asc()], "place")


@query(f"""WITH g AS (SELECT count(*) AS n FROM documents GROUP BY {NORM.format("coalesce(string_split(text, chr(10))[1], '')")})
SELECT sum(n)::BIGINT AS records_identified, sum(n - 1)::BIGINT AS duplicate_records_removed, count(*) AS records_available_for_screening, true AS equations_valid FROM g""")
def prisma_identification(spark, sf_dir):
    """The flagship: scan, harmonise, match, fold to counts, check the conservation equation."""
    r = records(spark, sf_dir)
    c = dedup.group_counts(r, dedup.match_key(F.lit(""), "Title", F.lit("blank")))
    return c.select("records_identified", F.col("duplicates_removed").alias("duplicate_records_removed"), F.col("groups").alias("records_available_for_screening"), (F.col("records_identified") == F.col("duplicates_removed") + F.col("groups")).alias("equations_valid"))


# --- ingestion ------------------------------------------------------------------


def _exports(spark, sf_dir):
    """documents dealt to three databases with their own headers."""
    d = table(spark, sf_dir, "documents").withColumn("Title", F.substring_index("text", "\n", 1))
    i = F.col("doc_id")
    doi = F.when(i % 4 == 0, F.concat(F.lit("10.1/"), i.cast("string"))).when(i % 4 == 1, F.concat(F.lit("https://doi.org/10.1/"), i.cast("string"))).otherwise("")
    ieee = d.where(i % 3 == 0).select("doc_id", F.col("Title").alias("Document Title"), F.col("source").alias("Publication Title"), doi.alias("DOI"), F.when(i % 2 == 0, "http://a/pdf").otherwise(" ").alias("PDF Link"), F.lit("").alias("Link"), F.col("lang").alias("Author Keywords"))
    pubmed = d.where(i % 3 == 1).select("doc_id", F.col("doc_id").alias("PMID"), "Title", F.col("source").alias("Journal"), doi.alias("DOI"), F.lit(None).cast("string").alias("URL"))
    scholar = d.where(i % 3 == 2).select("doc_id", F.col("Title").alias("title"), F.col("source").alias("Publication"), F.lit("5").alias("Citations"), doi.alias("DOI"), F.lit("http://b").alias("URL"))
    return [ieee, pubmed, scholar]


@query("""SELECT doc_id, string_split(text, chr(10))[1] AS title, source AS source_title,
  CASE WHEN doc_id % 4 = 0 THEN '10.1/' || doc_id WHEN doc_id % 4 = 1 THEN 'https://doi.org/10.1/' || doc_id ELSE '' END AS doi,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'http://a/pdf' WHEN doc_id % 3 = 2 THEN 'http://b'
       WHEN doc_id % 4 IN (0, 1) THEN 'https://doi.org/10.1/' || doc_id ELSE '' END AS link,
  CASE WHEN doc_id % 3 = 0 THEN lang END AS keywords FROM documents""")
def harmonise_union(spark, sf_dir):
    parts = [ingest.harmonise(e, carry=("doc_id",)) for e in _exports(spark, sf_dir)]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.select("doc_id", F.col("Title").alias("title"), F.col("Source title").alias("source_title"), F.col("DOI").alias("doi"), F.col("Link").alias("link"), F.col("Keywords").alias("keywords"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN '' ELSE '10.' || doc_id || '/Ab' END AS doi,
  CASE WHEN doc_id % 6 = 5 THEN '' ELSE 'https://doi.org/10.' || doc_id || '/Ab' END AS link FROM documents""")
def canonical_doi(spark, sf_dir):
    i = F.col("doc_id")
    bare = F.concat(F.lit("10."), i.cast("string"), F.lit("/Ab"))
    forms = F.when(i % 6 == 0, bare).when(i % 6 == 1, F.concat(F.lit("https://doi.org/"), bare)).when(i % 6 == 2, F.concat(F.lit(" HTTP://DX.DOI.ORG/"), bare)).when(i % 6 == 3, F.concat(F.lit("doi : "), bare)).when(i % 6 == 4, F.concat(F.lit("DOI:"), bare, F.lit(" "))).otherwise(F.lit(" N/A"))
    d = table(spark, sf_dir, "documents").select("doc_id", T.canonical_doi(forms).alias("doi"))
    return d.withColumn("link", T.canonical_url(F.when(i % 2 == 0, F.lit("https://doi.org/")).otherwise("none"), F.col("doi")))


@query(r"""SELECT page_id, url AS canonical_url, CASE WHEN regexp_matches(url, '[?&]page=\d+') THEN regexp_extract(url, '[?&]page=(\d+)', 1)::BIGINT ELSE -1 END AS page_number FROM pages""")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url("url").alias("canonical_url"), F.coalesce(ingest.query_parameter("url", "page").try_cast("bigint"), F.lit(-1)).alias("page_number"))


@query("""SELECT doc_id, (n * 1234)::BIGINT AS total, n AS first, n + 9 AS last, (n + 9)::BIGINT AS of_total, CASE WHEN n % 2 = 0 THEN n ELSE -1 END AS only_count, CASE WHEN n % 3 = 0 THEN n ELSE 0 END AS start,
  n % 4 <> 1 AS same_query FROM (SELECT doc_id, doc_id + 1 AS n FROM documents)""")
def result_counts(spark, sf_dir):
    i = F.col("doc_id") + 1
    n = F.format_number(i * 1234, 0)
    d = table(spark, sf_dir, "documents")
    shown = ingest.shown_range(F.concat(F.lit("Showing "), i.cast("string"), F.lit("-"), (i + 9).cast("string"), F.lit(" of "), (i + 9).cast("string"), F.lit(" results")))
    url = F.when(i % 3 == 0, F.concat(F.lit("https://x.org/s?q=a&start="), i.cast("string"))).when(i % 3 == 1, F.lit("https://x.org/s?start=-4")).otherwise("https://x.org/s?q=b")
    only = F.when(i % 2 == 0, F.concat(i.cast("string"), F.lit(" results"))).otherwise("no result at all")
    return d.select(
        "doc_id", ingest.reported_total(F.concat(F.lit("About "), n, F.lit(" results (0.1 s)"))).alias("total"), shown["first"].alias("first"), shown["last"].alias("last"), shown["total"].alias("of_total"), F.coalesce(ingest.result_count(only), F.lit(-1)).alias("only_count"), ingest.start_offset(url).alias("start"),
        ingest.same_query(F.when(i % 4 == 0, F.lit("https://x.org/s?q=a%20b")).when(i % 4 == 1, F.lit("https://x.org/s?q=a")).when(i % 4 == 2, F.lit("https://x.org/s?q=(a%20b)")).otherwise("https://x.org/s?p=1&q=a+b"), "q", F.lit("a b")).alias("same_query"))


# --- text and evidence ----------------------------------------------------------


@query(r"""SELECT doc_id, 'abstract_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY pos))::VARCHAR, 3, '0') AS evidence_id, unit FROM (
  SELECT doc_id, generate_subscripts(u, 1) AS pos, trim(unnest(u), ' ' || chr(9) || chr(13)) AS unit FROM (
    SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31) || '|\n+') AS u FROM documents)) WHERE unit <> ''""")
def evidence_units(spark, sf_dir):
    d = records(spark, sf_dir)
    return d.select("doc_id", F.explode(T.evidence_units(F.lit(""), "Abstract")).alias("u")).select("doc_id", "u.evidence_id", F.col("u.text").alias("unit"))


@query("SELECT doc_id, item_id, 'abstract' AS source FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def exact_evidence(spark, sf_dir):
    """Quotes that a text holds word for word, found by one automaton over all of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("abstract"))
    return quotes.find_quotes(d, table(spark, sf_dir, "benchmark"), "doc_id", ["abstract"], "item_id", "text")


TERM_LINE = r"(' ' || array_to_string(list_transform(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 4 AND t LIKE '%es' THEN t[:-3] WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END), ' ') || ' ')"


@query(f"SELECT doc_id, contains({TERM_LINE.format('text')}, ' license ') AS license, contains({TERM_LINE.format('text')}, ' of the ') AS of_the, contains({TERM_LINE.format('text')}, ' right reserved ') AS rights FROM documents")
def term_containment(spark, sf_dir):
    terms = {"license": "License", "of_the": "of the", "rights": "rights reserved"}
    line = T.token_line("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[T.contains_term("text", F.lit(t), line).alias(n) for n, t in terms.items()])


BALANCED = [["license", "rights reserved"], ["the", "die"]]
HIGH_RECALL = [["license", "rights reserved", "released"], ["the", "die", "que"]]


def _sql_matches(groups):
    return " AND ".join("(" + " OR ".join(f"contains(lower(text), '{t}')" for t in g) + ")" for g in groups)


@query(f"SELECT doc_id, lang FROM documents WHERE {_sql_matches(BALANCED)}")
def boolean_eval_balanced(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(boolean_query.matches("text", BALANCED)).select("doc_id", "lang")


@query(f"SELECT source, count(*) AS n FROM documents WHERE {_sql_matches(HIGH_RECALL)} GROUP BY source")
def boolean_eval_high_recall(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(boolean_query.matches("text", HIGH_RECALL)).groupBy("source").agg(F.count("*").alias("n"))


def _concepts(spark):
    rows = [([("deep learning", ["deep learning", "neural_network", "Neural Network"], ["deep learning", "neural network", "neural networks", "CNN"]), ("therapy", ["therapy"], ["therapy", "therapies", "“treatment”"])],)]
    return spark.createDataFrame(rows, "concepts array<struct<label:string,balanced_terms:array<string>,high_recall_terms:array<string>>>")


@query("""SELECT * FROM (VALUES
 ('balanced','google_scholar','("deep learning" OR "neural network") AND ("therapy")'), ('balanced','scopus','TITLE-ABS-KEY(("deep learning" OR "neural network") AND ("therapy"))'),
 ('balanced','web_of_science','TS=(("deep learning" OR "neural network") AND ("therapy"))'), ('balanced','ieee_xplore','("deep learning" OR "neural network") AND ("therapy")'),
 ('balanced','pubmed','("deep learning"[tiab] OR "neural network"[tiab]) AND ("therapy"[tiab])'),
 ('high_recall','google_scholar','("deep learning" OR "neural network" OR "neural networks" OR "CNN") AND ("therapy" OR "therapies" OR "“treatment”")'),
 ('high_recall','scopus','TITLE-ABS-KEY(("neural network*" OR "deep learning" OR "CNN") AND (therap* OR "“treatment”"))'),
 ('high_recall','web_of_science','TS=(("neural network*" OR "deep learning" OR "CNN") AND (therap* OR "“treatment”"))'),
 ('high_recall','ieee_xplore','("neural network*" OR "deep learning" OR "CNN") AND (therap* OR "“treatment”")'),
 ('high_recall','pubmed','("neural network*"[tiab] OR "deep learning"[tiab] OR "CNN"[tiab]) AND (therap*[tiab] OR "“treatment”"[tiab])')) t(version, platform, query)""")
def boolean_compile(spark, sf_dir):
    return boolean_query.compile_bundle(_concepts(spark))


@query("SELECT unnest(['clean, distinct terms', 'no term is the whole question']) AS error")
def proposal_rules(spark, sf_dir):
    return _concepts(spark).select(F.explode(boolean_query.proposal_errors(F.col("concepts"), F.lit("Therapy?"))).alias("error"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+'))) AS tok FROM documents),
 q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS tok FROM benchmark),
 s AS (SELECT doc_id, item_id, count(*) AS overlap FROM w JOIN q USING (tok) GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, item_id) AS rn FROM s)
SELECT d.doc_id AS draft_id, coalesce(b.item_id, -1) AS group_id, coalesce(b.overlap, 0)::BIGINT AS overlap FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND rn = 1""")
def best_overlap_match(spark, sf_dir):
    drafts = records(spark, sf_dir).select(F.col("doc_id").alias("draft_id"), F.array("Title").alias("terms"))
    groups = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("group_id"), F.array("text").alias("terms"))
    return boolean_query.best_overlap(drafts, groups).select("draft_id", F.coalesce("group_id", F.lit(-1)).alias("group_id"), F.col("overlap").cast("long").alias("overlap"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'quoted ' || doc_id WHEN doc_id % 4 = 1 THEN 'once' WHEN doc_id % 4 = 2 THEN 'a' || chr(10) || 'b' ELSE '''=1+' || doc_id END AS cleaned,
  doc_id::VARCHAR AS row_id, ['first', 'second one', 'third'] AS entries, 'deep_learning_' || doc_id AS slug, 'state of the art' AS plain, doc_id % 2 = 0 AS one_edit, doc_id % 3 <> 2 AS acronym,
  'strasse ' || doc_id || ' λόγοσ' AS folded, CASE doc_id % 3 WHEN 0 THEN 'a_b_' || doc_id || '.csv.' WHEN 1 THEN '' ELSE 'plain  ' || doc_id END AS file FROM documents""")
def scalar_text(spark, sf_dir):
    i = F.col("doc_id")
    s = i.cast("string")
    cleaned = F.when(i % 4 == 0, T.strip_quotes(F.concat(F.lit(" “'quoted "), s, F.lit("'” ")))).when(i % 4 == 1, T.strip_quotes_once(F.lit('"once"'))).when(i % 4 == 2, T.unify_newlines(F.lit("a\r\nb"))).otherwise(T.excel_safe(F.concat(F.lit("=1+"), s)))
    return table(spark, sf_dir, "documents").select(
        "doc_id", cleaned.alias("cleaned"), T.source_id(F.concat(s, F.lit(".0"))).alias("row_id"), T.criteria_entries(F.lit("- first; 2) second one\r\n• third\n\n")).alias("entries"),
        T.slug(F.concat(F.lit("Deep learning #"), s)).alias("slug"), T.dehyphenate(F.lit("state-of-the-art")).alias("plain"),
        T.one_edit(F.lit("effects"), F.when(i % 2 == 0, "efefcts").otherwise("efcefts")).alias("one_edit"),
        T.acronym_matches(F.when(i % 3 == 1, "quality of life among adults").otherwise("magnetic resonance imaging"), F.when(i % 3 == 0, "MRI").when(i % 3 == 1, "QLA").otherwise("MOI")).alias("acronym"),
        T.norm_casefold(F.concat(F.lit("  Straße\t"), s, F.lit(" ΛΌΓΟΣ "))).alias("folded"), T.file_name(F.when(i % 3 == 0, F.concat(F.lit(" a/b?:"), s, F.lit(".csv. "))).when(i % 3 == 1, F.lit(" ")).otherwise(F.concat(F.lit("plain  "), s))).alias("file"),
    )


@query(r"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id::INT ELSE 0 END AS whole, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS finite,
  CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE event_id::DOUBLE END AS number, CASE event_id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence,
  [60, 60, 120, 300, 600, 900, 1800, 1800][(event_id % 8)::INT + 1] AS wait, (event_id % 4 <> 1) AS temporal, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, least(100, round((event_id % 250) * 100 / 200.0))::INT AS percent, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 60.0 WHEN 2 THEN 15.0 ELSE 0.0 END::DOUBLE AS seconds_left, ('0x' || substr(sha256(event_id::VARCHAR), 1, 8))::BIGINT AS seed FROM events""")
def scalar_numbers(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    s = i.cast("string")
    whole = F.when(i % 4 == 0, s).when(i % 4 == 1, F.concat(F.lit("-"), s)).when(i % 4 == 2, "x").otherwise(F.lit(None))
    return e.select(
        "event_id", V.safe_int(whole).alias("whole"), V.finite_or(F.when(i % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")), None).alias("finite"),
        V.to_number(F.when(i % 5 == 0, "n/a").otherwise(s)).alias("number"), V.risk_confidence(F.get(F.array(F.lit("LOW"), F.lit("borderline"), F.lit("HIGH"), F.lit("?")), (i % 4).cast("int"))).alias("confidence"),
        V.throttle_seconds((i % 8).cast("int")).alias("wait"), V.is_temporal(F.when(i % 4 == 0, F.concat(F.lit(" "), (i % 100).cast("string"), F.lit(" weeks."))).when(i % 4 == 1, "studies since 2015").when(i % 4 == 2, "2010–15").otherwise("During 1999")).alias("temporal"), V.utc_iso(F.col("ts")).alias("iso"), V.progress_percent(i % 250, F.lit(200)).alias("percent"), V.remaining_seconds(F.lit(30.0), i % 4, F.lit(3)).alias("seconds_left"), V.seed_number(s).alias("seed"),
    )


@query("""SELECT event_id, event_type AS kind, round(value, 6) AS value, CASE WHEN event_id % 3 = 0 THEN 'fenced' WHEN event_id % 3 = 1 THEN '' ELSE 'plain' END AS field FROM events""")
def json_answers(spark, sf_dir):
    i = F.col("event_id")
    body = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("value"), F.when(i % 3 == 0, "fenced").otherwise("plain").alias("field")))
    raw = F.when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    parsed = V.json_object(raw, "kind string, value double")
    field = V.json_field(F.when(i % 3 == 1, "{broken").otherwise(V.unfence(raw)), "field")
    return table(spark, sf_dir, "events").select("event_id", parsed["kind"].alias("kind"), F.round(V.json_safe(parsed["value"]), 6).alias("value"), field.alias("field"))


# --- decisions ------------------------------------------------------------------


@query(f"SELECT source, count(*) FILTER (WHERE Decision = 'KEEP') AS keep, count(*) FILTER (WHERE Decision = 'MAYBE') AS maybe, count(*) FILTER (WHERE Decision = 'REJECT') AS reject, count(*) FILTER (WHERE Decision = 'REJECT' AND Decision_Source <> 'manual_review') AS automated_rejects, count(*) FILTER (WHERE Decision = 'REJECT' AND Decision_Source = 'manual_review') AS manual_rejects, count(*) AS screened FROM {SCREENED} GROUP BY source")
def decision_counts_by_source(spark, sf_dir):
    return flow.decision_counts(screened(spark, sf_dir), "source")


@query(f"SELECT CASE WHEN trim(Exclusion_Reason) = '' THEN 'reason not classified' ELSE trim(Exclusion_Reason) END AS reason, count(*) AS count FROM {SCREENED} WHERE Decision = 'REJECT' GROUP BY 1")
def exclusion_reasons(spark, sf_dir):
    return flow.exclusion_reasons(screened(spark, sf_dir))


@query(f"""SELECT 100000::BIGINT AS records_identified, 10::BIGINT AS duplicate_records_removed, 99990::BIGINT AS records_available_for_screening, screened AS records_screened, 99990 - screened AS records_awaiting_screening,
  reject AS records_excluded, maybe AS records_awaiting_manual_review, keep AS records_included_after_title_abstract, 'manual_review' AS status, true AS equations_valid FROM (
  SELECT count(*) AS screened, count(*) FILTER (WHERE Decision = 'REJECT') AS reject, count(*) FILTER (WHERE Decision = 'MAYBE') AS maybe, count(*) FILTER (WHERE Decision = 'KEEP') AS keep FROM {SCREENED})""")
def flow_snapshot(spark, sf_dir):
    plan = {"identified": 100_000, "duplicates": 10, "available": 99_990, "selected": 99_990}
    row = flow.snapshot(flow.decision_counts(screened(spark, sf_dir)), plan)
    return row.select("records_identified", "duplicate_records_removed", "records_available_for_screening", "records_screened", "records_awaiting_screening", "records_excluded", "records_awaiting_manual_review", "records_included_after_title_abstract", "status", "equations_valid")


PRIORITY_SQL = """CASE WHEN Failure_Class LIKE '%validation_contradiction%' OR Validation_Status LIKE '%contradiction%' THEN 1
  WHEN Failure_Class LIKE '%browser_or_transport_failure%' AND (trim(Primary_Decision) <> '' OR trim(Verifier_Decision) <> '') THEN 2
  WHEN Failure_Class <> '' OR Validation_Status = 'safe_fallback' OR Route_Used = 'safe_fallback' THEN 3 WHEN Agreement_Status LIKE '%disagree%' THEN 4
  WHEN Route_Used = 'missing_abstract' THEN 6 ELSE 5 END"""


@query(f"""SELECT Source_Row_Index, p AS Review_Priority, ['validation_contradiction','transport_failure_with_provisional_assessment','technical_safe_fallback','independent_review_disagreement','semantic_maybe','missing_or_insufficient_evidence'][p] AS Review_Priority_Group,
  row_number() OVER (ORDER BY p, (Agreement_Status LIKE '%disagree%')::INT DESC, coalesce(try_cast(Confidence AS DOUBLE), -1) DESC, try_cast(Source_Row_Index AS DOUBLE) ASC NULLS LAST, Source_Row_Index) AS place
FROM (SELECT *, {PRIORITY_SQL} AS p FROM {SCREENED} WHERE Decision = 'MAYBE')""")
def review_queue(spark, sf_dir):
    queue = review.review_queue(screened(spark, sf_dir))
    placed = review.ranked(queue, review.queue_order(queue), "place")
    return placed.select("Source_Row_Index", "Review_Priority", "Review_Priority_Group", "place")


@query(f"""SELECT Source_Row_Index, 'job' AS Job_ID, Decision, CASE WHEN Primary_Decision <> '' THEN Primary_Decision ELSE Decision END AS Original_Model_Decision,
  CASE WHEN Decision_Source = 'manual_review' THEN Decision ELSE '' END AS Manual_Decision,
  CASE WHEN Decision_Source = 'manual_review' THEN 'reviewed' WHEN Decision = 'MAYBE' THEN 'pending' ELSE 'not_required' END AS Manual_Review_Status, Exclusion_Reason AS Manual_Review_Notes,
  CASE WHEN Decision_Source = 'manual_review' THEN 'human_review' WHEN Decision = 'MAYBE' AND Validation_Status = 'safe_fallback' THEN 'model_safe_maybe' ELSE 'model_validated' END AS Final_Decision_Source FROM {SCREENED}""")
def export_prepare(spark, sf_dir):
    run = screened(spark, sf_dir)
    out = review.prepare(run, "job", review.guard(run, "job"))
    return out.select("Source_Row_Index", "Job_ID", "Decision", "Original_Model_Decision", "Manual_Decision", "Manual_Review_Status", "Manual_Review_Notes", "Final_Decision_Source")


@query(f"""SELECT count(*) AS total_count, count(*) FILTER (WHERE Decision = 'KEEP') AS keep_count, count(*) FILTER (WHERE Decision = 'MAYBE') AS maybe_count, count(*) FILTER (WHERE Decision = 'REJECT') AS reject_count,
  count(*) FILTER (WHERE Validation_Status = 'validated') AS validated_count, count(*) FILTER (WHERE Validation_Status = 'safe_fallback') AS safe_fallback_count,
  count(*) FILTER (WHERE Failure_Class LIKE '%browser_or_transport_failure%') AS transport_failure_count, count(*) FILTER (WHERE Failure_Class LIKE '%validation_contradiction%') AS validation_contradiction_count,
  count(*) FILTER (WHERE Decision IN ('KEEP','REJECT') AND Validation_Status = 'safe_fallback') AS unsafe_definitive_fallback_count, count(*) FILTER (WHERE Route_Used = 'missing_abstract') AS missing_abstract_count FROM {SCREENED}""")
def export_summary(spark, sf_dir):
    return review.summary(screened(spark, sf_dir))


@query(f"""SELECT Source_Row_Index, CASE WHEN doc_id % 14 = 0 AND Decision = 'MAYBE' THEN 'KEEP' ELSE Decision END AS Decision,
  CASE WHEN doc_id % 14 <> 0 THEN '' WHEN Decision = 'MAYBE' THEN 'applied' ELSE 'not_maybe' END AS override_status FROM {SCREENED}""")
def manual_overrides(spark, sf_dir):
    run = screened(spark, sf_dir)
    """Three decisions a row, of which the second one counts: the last that names KEEP or REJECT."""
    said = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(d).alias("decision")) for k, d in ((1, "reject"), (2, "keep"), (3, "perhaps"))])
    over = table(spark, sf_dir, "labels").where("doc_id % 14 = 0").select(F.col("doc_id").cast("string").alias("row_id"), F.explode(said).alias("s")).select("row_id", "s.*", F.lit("read it").alias("reason"))
    return review.apply_overrides(run, over).select("Source_Row_Index", "Decision", "override_status")


@query(f"SELECT doc_id, ((row_number() OVER (ORDER BY source, doc_id) - 1) // 15)::BIGINT AS batch FROM {SCREENED}")
def batch_numbers(spark, sf_dir):
    run = screened(spark, sf_dir).select("doc_id", "source")
    return review.with_batches(run, [F.col("source").asc(), F.col("doc_id").asc()], 15).select("doc_id", "batch")


def _two_readings(spark, sf_dir):
    """Assessments of each document from its id: every kind of validity and decision meets every other."""
    i = F.col("doc_id")
    names = F.array(F.lit("KEEP"), F.lit("MAYBE"), F.lit("REJECT"))

    def of(n):
        d = F.get(names, (n % 3).cast("int"))
        kind = (F.floor(n / 3) % 5).cast("int")
        sem, ev, tech = kind != 1, ~kind.isin(2), kind == 3
        none = F.array().cast("array<string>")
        return F.struct(d, d, F.when(kind == 4, 0.7).otherwise(0.9), F.lit("r"), F.lit("q"), sem & ev & ~tech, ~tech, sem, ev, tech, F.when(tech, "broken").otherwise(""), none, none, F.lit("title")).cast(A.ASSESSMENT)

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", of(i).alias("p"), F.when(i % 4 != 0, of(F.floor(i / 15))).alias("v"))


MERGE_SQL = """WITH x AS (
  SELECT doc_id, ['KEEP','MAYBE','REJECT'][(doc_id % 3)::INT + 1] AS pd, (doc_id // 3 % 5) AS pk, doc_id % 4 <> 0 AS hv,
    ['KEEP','MAYBE','REJECT'][(doc_id // 15 % 3)::INT + 1] AS vd, (doc_id // 15 // 3 % 5) AS vk FROM documents),
 y AS (SELECT *, CASE WHEN pk = 4 THEN 0.7 ELSE 0.9 END AS pc, CASE WHEN vk = 4 THEN 0.7 ELSE 0.9 END AS vc,
    pk NOT IN (1, 3) AND (pd = 'MAYBE' OR pk <> 2) AS pf, vk NOT IN (1, 3) AND (vd = 'MAYBE' OR vk <> 2) AS vf FROM x),
 z AS (SELECT *, CASE WHEN pk = 3 THEN 'primary_validation_failed' WHEN pk = 1 THEN 'primary_semantic_contradiction'
    WHEN NOT hv AND (pd IN ('KEEP','MAYBE') OR pc < 0.8 OR NOT pf) THEN 'verification_unfinished' WHEN NOT hv THEN 'not_required'
    WHEN vk IN (1, 3) THEN 'verification_failed' WHEN pd = 'MAYBE' AND vd <> 'MAYBE' THEN 'disagreement' WHEN pd = 'MAYBE' THEN 'both_maybe' WHEN pd <> vd THEN 'disagreement'
    WHEN pf AND vf THEN 'agreement' WHEN pk = 2 AND vf THEN 'agreement_recovered_by_verifier_evidence' ELSE 'verification_failed' END AS agreement FROM y),
 w AS (SELECT *, CASE WHEN agreement IN ('agreement','agreement_recovered_by_verifier_evidence','not_required') THEN pd ELSE 'MAYBE' END AS decision FROM z)
SELECT doc_id, decision, (CASE WHEN agreement = 'not_required' THEN pc WHEN agreement IN ('agreement','agreement_recovered_by_verifier_evidence','both_maybe') THEN least(pc, vc) ELSE 0 END)::DOUBLE AS confidence, agreement,
  CASE WHEN decision IN ('KEEP','REJECT') THEN CASE WHEN hv AND vd = decision AND vk <> 2 THEN 'verifier' WHEN pk <> 2 THEN 'primary' ELSE 'none' END
       WHEN hv THEN CASE WHEN vk <> 2 THEN 'verifier' ELSE 'none' END WHEN pk <> 2 THEN 'primary' ELSE 'none' END AS evidence_source,
  CASE WHEN decision = 'MAYBE' AND agreement <> 'both_maybe' THEN 'safe_fallback' ELSE 'validated' END AS validation_status FROM w"""


@query(MERGE_SQL)
def merge_truth_table(spark, sf_dir):
    both = _two_readings(spark, sf_dir).withColumnRenamed("doc_id", "paper_id")
    out = screening.merged(both)
    return out.select(F.col("paper_id").alias("doc_id"), F.col("Decision").alias("decision"), F.col("Confidence").alias("confidence"), F.col("Agreement_Status").alias("agreement"), F.col("Final_Evidence_Source").alias("evidence_source"), F.col("Validation_Status").alias("validation_status"))


@query("""SELECT doc_id, pk <> 3 AS structural, pk <> 1 AS semantic, pk <> 2 AS evidence, pk = 3 AS technical, pk NOT IN (1, 3) AND (pd = 'MAYBE' OR pk <> 2) AS full_valid,
  pk <> 3 AND (pd IN ('KEEP', 'MAYBE') OR pk IN (1, 2, 4)) AS verify FROM (SELECT doc_id, ['KEEP','MAYBE','REJECT'][(doc_id % 3)::INT + 1] AS pd, (doc_id // 3 % 5) AS pk FROM documents)""")
def validity_predicates(spark, sf_dir):
    p = F.col("p")
    return _two_readings(spark, sf_dir).select("doc_id", A.structural_valid(p).alias("structural"), A.semantic_valid(p).alias("semantic"), A.evidence_valid(p).alias("evidence"), A.technical_invalid(p).alias("technical"), A.fully_valid(p).alias("full_valid"), A.requires_verification(p).alias("verify"))


@query("""SELECT doc_id, d IN ('MAYBE','REJECT') OR r <> 'LOW' OR NOT v AS deep, d = 'MAYBE' OR r <> 'LOW' OR NOT v AS critic, (d = 'KEEP' AND b = 'S') OR (d = 'REJECT' AND b IN ('X','C')) OR (d = 'MAYBE' AND b = 'U') AS basis_ok,
  CASE d WHEN 'REJECT' THEN 0 WHEN 'MAYBE' THEN 1 ELSE 2 END AS stage_rank FROM (
  SELECT doc_id, ['KEEP','MAYBE','REJECT'][(doc_id % 3)::INT + 1] AS d, ['LOW','BORDERLINE','HIGH'][(doc_id // 3 % 3)::INT + 1] AS r, doc_id % 5 <> 0 AS v, ['S','X','C','U'][(doc_id // 9 % 4)::INT + 1] AS b FROM documents)""")
def cascade_routing(spark, sf_dir):
    i = F.col("doc_id")
    pick = lambda n, *names: F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    d, r, b, ok = pick(i % 3, "KEEP", "MAYBE", "REJECT"), pick(F.floor(i / 3) % 3, "LOW", "BORDERLINE", "HIGH"), pick(F.floor(i / 9) % 4, "S", "X", "C", "U"), i % 5 != 0
    return table(spark, sf_dir, "documents").select("doc_id", A.needs_deep(d, r, ok).alias("deep"), A.needs_critic(d, r, ok).alias("critic"), A.basis_consistent(d, b).alias("basis_ok"), screening.stage_order(d).alias("stage_rank"))


@query("""WITH x AS (SELECT doc_id, list_transform([0, 1, 2], lambda k: ['MET','NOT_MET','UNCLEAR'][(doc_id // (CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 9 END) % 3)::INT + 1]) AS s FROM documents),
 y AS (SELECT doc_id, len(list_filter(s, lambda z: z = 'MET')) AS met, len(list_filter(s, lambda z: z = 'UNCLEAR')) AS unclear FROM x)
SELECT doc_id, g.group_id, met::INT AS met, unclear::INT AS unclear, CASE WHEN met >= g.need THEN 'met' WHEN met + unclear < g.need THEN 'failed' ELSE 'unclear' END AS state FROM y, (VALUES ('all', 3), ('two', 2)) g(group_id, need)""")
def group_tally(spark, sf_dir):
    i = F.col("doc_id")
    s = lambda k: F.get(F.array(F.lit("MET"), F.lit("NOT_MET"), F.lit("UNCLEAR")), (F.floor(i / k) % 3).cast("int"))
    statuses = F.create_map(F.lit("a"), s(1), F.lit("b"), s(3), F.lit("c"), s(9))
    members = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    groups = F.array(*[F.struct(F.lit(g).alias("group_id"), F.lit(o).alias("operator"), members.alias("member_ids"), F.lit(n).alias("minimum_required")) for g, o, n in (("all", "ALL", 0), ("two", "AT_LEAST", 2))])
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(A.group_states(statuses, groups)).alias("g")).select("doc_id", "g.group_id", "g.met", "g.unclear", "g.state")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'title' WHEN doc_id % 4 = 1 THEN 'none' WHEN doc_id % 4 = 2 THEN 'none' ELSE CASE WHEN contains(Title, q) THEN 'title' ELSE 'abstract' END END AS source,
  CASE WHEN doc_id % 4 = 1 THEN 'ellipsis_not_allowed' WHEN doc_id % 4 = 2 THEN 'quote_not_found_in_source' ELSE '' END AS failure,
  CASE WHEN doc_id % 4 IN (1, 2) THEN Title WHEN doc_id % 4 = 0 THEN Title ELSE q END AS repaired FROM (
  SELECT doc_id, trim(Title) AS Title, Abstract, trim(substr(Abstract, length(Abstract) - 11, 12), chr(10) || ' ') AS q FROM """ + RECORDS + """ WHERE trim(Title) <> '')""")
def evidence_repair(spark, sf_dir):
    i = F.col("doc_id")
    r = records(spark, sf_dir).where(T.has_value("Title")).withColumn("Title", T.ustrip("Title"))
    end = T.ustrip(F.col("Abstract").substr(F.length("Abstract") - 11, F.lit(12)))
    quote = F.when(i % 4 == 0, F.concat(F.lit("“"), F.col("Title"), F.lit("”"))).when(i % 4 == 1, F.lit("a ... b")).when(i % 4 == 2, F.lit("@@ not there @@")).otherwise(end)
    c = A.check_quote(quote, "Title", "Abstract")
    return r.select("doc_id", c["source"].alias("source"), c["failure"].alias("failure"), A.repair_quote(F.lit("KEEP"), quote, F.col("Title"), F.col("Abstract"))["quote"].alias("repaired"))


# --- runs -----------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def resume_pending(spark, sf_dir):
    return screening.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("toxic = 0"), "doc_id")


@query("SELECT doc_id, quality FROM labels WHERE toxic = 0 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def resume_reused(spark, sf_dir):
    chosen = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return screening.resumed(chosen, table(spark, sf_dir, "labels").where("toxic = 0"), "doc_id").select("doc_id", "quality")


@query("SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set_audit(spark, sf_dir):
    return audit.set_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT a.event_id AS attempt_id, count(d.event_id) AS n_downloads, CASE WHEN count(d.event_id) = 1 THEN min(d.event_id) ELSE -1 END AS download_id, count(d.event_id) > 1 AS ambiguous
FROM (SELECT * FROM events WHERE event_id % 2 = 0) a LEFT JOIN (SELECT * FROM events WHERE event_id % 2 = 1) d ON a.user_id = d.user_id AND d.ts >= a.ts - INTERVAL 1 SECOND AND d.ts <= a.ts + INTERVAL 120 SECOND GROUP BY a.event_id""")
def interval_match(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("at"))
    out = audit.interval_match(e.where("event_id % 2 = 0").withColumnRenamed("event_id", "attempt_id"), e.where("event_id % 2 = 1").withColumnRenamed("event_id", "download_id"), "user_id")
    return out.withColumn("download_id", F.coalesce("download_id", F.lit(-1)))


@query("""SELECT event_id, least(sum(f) OVER (PARTITION BY user_id, s ORDER BY event_id), 6)::BIGINT AS level FROM (
  SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (SELECT event_id, user_id, (value < 50)::INT AS f FROM events))""")
def failure_levels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return audit.failure_levels(e, "user_id", "event_id", F.col("value") < 50).select("event_id", "level")


@query("""SELECT event_id, doc AS blocked, CASE WHEN event_id % 3 = 1 THEN 'temporary_operation_failure' END AS failure, fin AS finished FROM (SELECT event_id, event_id % 3 = 0 AS doc,
  (event_id % 5 < 2) AND (event_id >= 1000 OR event_id % 11 BETWEEN 1 AND 9 OR event_id + event_id % 11 >= 500) AS fin FROM events)""")
def collector_states(spark, sf_dir):
    i = F.col("event_id")
    body = F.when(i % 3 == 0, "Our systems have detected UNUSUAL traffic").when(i % 3 == 1, "Please try again later.").otherwise("fine")
    nxt = F.when(i % 5 == 0, F.lit(None).cast("long")).when(i % 5 == 1, i).otherwise(i + 10)
    return table(spark, sf_dir, "events").select("event_id", audit.is_blocked(F.lit("/scholar"), body).alias("blocked"), audit.operation_failure(body).alias("failure"), audit.end_of_results(i, i % 11, F.lit(500).cast("long"), i, nxt).alias("finished"))


@query("""SELECT source AS run_id, count(*) AS n_expected, count(*) % 2 = 0 AS labels_ok, count(*) % 2 = 0 AS export_ok FROM documents GROUP BY source""")
def collection_integrity(spark, sf_dir):
    """A run per source; library ids differ from search ids, and runs of odd size lack one verified id."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.col("doc_id").cast("string").alias("id"))
    library = F.concat(F.lit("L"), "id")
    runs = d.groupBy("run_id").agg(F.count("*").alias("target"), F.min("id").alias("least"))
    runs = runs.select("run_id", "target", "least", F.lit(0).alias("unresolved"), F.lit(True).alias("audit_complete"), F.lit(True).alias("export_verified"), F.col("target").alias("export_rows"), F.lit(3).alias("integrity_version"))
    verified = d.join(F.broadcast(runs.select("run_id", "least", "target")), "run_id").where((F.col("target") % 2 == 0) | (F.col("id") != F.col("least"))).select("run_id", library.alias("id"))  # a row per source
    return audit.integrity_of_ids(runs, d, d.select("run_id", "id", library.alias("library_id")), verified)


@query("SELECT conv_id, string_agg(turn || ':' || role || ':' || length(text), '|' ORDER BY turn, role, length(text)) AS trace FROM conversations GROUP BY conv_id")
def conversation_trace(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    out = screening.trace(c, "conv_id", "turn", ["role", "n"])
    return out.select("conv_id", F.array_join(F.transform("trace", lambda t: F.concat_ws(":", t["turn"].cast("string"), t["role"], t["n"].cast("string"))), "|").alias("trace"))


@query("""SELECT user_id AS paper_id, round(sum(value / greatest(1, event_id % 4)), 4) AS seconds FROM events GROUP BY user_id""")
def stage_latency(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), F.col("value").alias("wall_seconds"), (F.col("event_id") % 4).alias("batch_size"))
    return screening.stage_latency(calls).select("paper_id", F.round("seconds", 4).alias("seconds"))


@query("SELECT doc_id, sha256(sha256(doc_id::VARCHAR) || '|' || sha256(text) || '|' || sha256(coalesce(lang, ''))) AS fingerprint FROM documents")
def row_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.row_fingerprint(["doc_id", "text", "lang"]).alias("fingerprint"))


_POLYNOMIAL = "list_reduce(l, lambda a, x: (a * {} + x) % {})"


@query(f"""WITH h AS (SELECT doc_id, ('0x' || substr(sha256(sha256(doc_id::VARCHAR) || '|' || sha256(coalesce(lang, '')) || '|' || sha256(coalesce(text, ''))), 1, 15))::BIGINT::HUGEINT AS h FROM documents),
 s AS (SELECT count(*) AS n, list(h ORDER BY doc_id, h) AS l FROM h)
SELECT n || ':' || {" || ':' || ".join(_POLYNOMIAL.format(b, gold.MERSENNE) for b in gold.BASES)} AS fingerprint FROM s""")
def ordered_fingerprint(spark, sf_dir):
    """Whole documents as a sequence: any two of them swapped change it, no partitioning does."""
    said = gold.ordered_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return spark.createDataFrame([(said,)], "fingerprint string")


@query("""SELECT user_id AS job_id, CASE WHEN user_id % 2 = 0 THEN 'i' || user_id END AS import_id, (CASE WHEN user_id % 2 = 0 THEN 10 ELSE 0 END)::BIGINT AS records_identified, CASE WHEN user_id % 2 = 0 THEN 'performed' ELSE 'not_performed' END AS deduplication_status,
  CASE WHEN user_id % 2 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'lineage unavailable' ELSE 'fingerprint differs' END AS lineage_warning FROM (SELECT DISTINCT user_id FROM events)""")
def import_lineage(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    i = F.col("user_id")
    name = F.concat(F.lit("i"), i.cast("string"))
    jobs = u.select(i.alias("job_id"), name.alias("import_id"), F.when(i % 2 == 0, "same").otherwise("other").alias("input_fingerprint"))
    imports = u.where((i % 2 == 0) | (i % 3 != 0)).select(name.alias("import_id"), F.lit("same").alias("clean_fingerprint"), F.lit(10).cast("long").alias("identified"), F.lit(1).cast("long").alias("duplicates"))
    return flow.inherit_lineage(jobs, imports).drop("duplicate_records_removed")


@query("""SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id HAVING count(*) > 1""")
def repeated_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id"))
    return ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")


# --- validation samples ---------------------------------------------------------


def _quotas(run):
    people = gold.population(run)
    return people, gold.allocate(people, min(gold.SAMPLE_SIZE, sum(people.values())))


QUOTA_SQL = f"""
 s AS (SELECT *, row_number() OVER (PARTITION BY Decision ORDER BY sha256('seed:' || Source_Row_Index), Source_Row_Index) AS rn FROM {SCREENED}),
 n AS (SELECT count(*) AS all_, count(*) FILTER (WHERE Decision = 'KEEP') AS k, count(*) FILTER (WHERE Decision = 'REJECT') AS r, count(*) FILTER (WHERE Decision = 'MAYBE') AS m FROM {SCREENED}),
 q AS (SELECT *, least(24, k) AS qk, least(24, r) AS qr, least(12, m) AS qm FROM n)"""


@query(f"WITH {QUOTA_SQL} SELECT Source_Row_Index, Decision FROM s, q WHERE rn <= CASE Decision WHEN 'KEEP' THEN 24 + 60 - qk - qr - qm WHEN 'REJECT' THEN 24 ELSE 12 END")
def stratified_sample(spark, sf_dir):
    run = screened(spark, sf_dir)
    return gold.stratified_sample(run, _quotas(run)[1], "seed").select("Source_Row_Index", "Decision")


@query(f"WITH {QUOTA_SQL}, t AS (SELECT s.*, q.* FROM s, q WHERE rn <= CASE Decision WHEN 'KEEP' THEN 24 + 60 - qk - qr - qm WHEN 'REJECT' THEN 24 ELSE 12 END) SELECT Decision, round(any_value(CASE Decision WHEN 'KEEP' THEN k WHEN 'REJECT' THEN r ELSE m END)::DOUBLE / count(*), 6) AS weight, count(*) AS sampled FROM t GROUP BY Decision")
def sample_weights(spark, sf_dir):
    run = screened(spark, sf_dir)
    people, quotas = _quotas(run)
    sample = gold.stratified_sample(run, quotas, "seed")
    weight = F.coalesce(*[F.when(F.col("Decision") == k, F.lit(people[k] / q)) for k, q in quotas.items() if q])
    return sample.groupBy("Decision").agg(F.round(F.max(weight), 6).alias("weight"), F.count("*").alias("sampled"))


def _judged(spark, sf_dir):
    """Human label from quality, model decision from length, a weight by decision."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    model = F.when(F.col("n_chars") > 2500, "KEEP").when(F.col("n_chars") > 900, "MAYBE").otherwise("REJECT")
    return d.select(F.col("doc_id").alias("row_id"), model.alias("model_decision"), F.when(F.col("quality") == 1, "KEEP").otherwise("REJECT").alias("human_decision"), F.when(F.col("n_chars") > 2500, 2.0).otherwise(1.5).alias("w"))


JUDGED = "(SELECT doc_id AS row_id, CASE WHEN n_chars > 2500 THEN 'KEEP' WHEN n_chars > 900 THEN 'MAYBE' ELSE 'REJECT' END AS model_decision, CASE WHEN quality = 1 THEN 'KEEP' ELSE 'REJECT' END AS human_decision, (CASE WHEN n_chars > 2500 THEN 2.0 ELSE 1.5 END)::DOUBLE AS w FROM labels JOIN documents USING (doc_id))"
METRICS = """sum(w) FILTER (WHERE human_decision = 'KEEP' AND model_decision IN ('KEEP','MAYBE')) / sum(w) FILTER (WHERE human_decision = 'KEEP') AS recall,
  coalesce(sum(w) FILTER (WHERE human_decision = 'KEEP' AND model_decision = 'REJECT'), 0) / sum(w) FILTER (WHERE human_decision = 'KEEP') AS false_reject_rate,
  coalesce(sum(w) FILTER (WHERE human_decision = 'KEEP' AND model_decision = 'KEEP'), 0) / sum(w) FILTER (WHERE model_decision = 'KEEP') AS keep_precision"""


@query(f"SELECT round(recall, 6) AS recall, round(false_reject_rate, 6) AS false_reject_rate, round(keep_precision, 6) AS keep_precision FROM (SELECT {METRICS} FROM {JUDGED})")
def weighted_metrics(spark, sf_dir):
    m = gold.weighted_metrics(_judged(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(f"SELECT m.model_decision, count(j.row_id) FILTER (WHERE human_decision = 'KEEP') AS keep, count(j.row_id) FILTER (WHERE human_decision = 'REJECT') AS reject FROM (VALUES ('KEEP'), ('MAYBE'), ('REJECT')) m(model_decision) LEFT JOIN {JUDGED} j USING (model_decision) GROUP BY 1")
def confusion(spark, sf_dir):
    return gold.confusion(_judged(spark, sf_dir))


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY model_decision ORDER BY sha256('seed:' || row_id), row_id) AS drawn FROM {JUDGED}),
 c AS (SELECT model_decision, count(*) AS n, least(count(*), CASE model_decision WHEN 'MAYBE' THEN 12 ELSE 24 END) AS quota FROM {JUDGED} GROUP BY 1),
 b AS (SELECT *, row_number() OVER (ORDER BY n - quota DESC, model_decision = 'MAYBE', model_decision) AS spare, 60 - sum(quota) OVER () AS short FROM c),
 chosen AS (SELECT a.* EXCLUDE (drawn) FROM a JOIN b USING (model_decision) WHERE drawn <= quota + CASE spare WHEN 1 THEN short ELSE 0 END),
 j AS (SELECT *, row_number() OVER (PARTITION BY model_decision ORDER BY row_id) - 1 AS place, count(*) OVER (PARTITION BY model_decision) AS size FROM chosen),
 d AS (SELECT it, model_decision, size, ('0x' || substr(sha256('seed:' || it || ':' || model_decision || ':' || place), 1, 8))::BIGINT % size AS place FROM j, range(2000) t(it)),
 e AS (SELECT it, {METRICS} FROM d JOIN j USING (model_decision, place) GROUP BY it),
 l AS (SELECT 'recall' AS metric, recall AS v FROM e UNION ALL SELECT 'false_reject_rate', false_reject_rate FROM e UNION ALL SELECT 'keep_precision', keep_precision FROM e)
SELECT metric, round(quantile_cont(v, 0.025), 4) AS lower, round(quantile_cont(v, 0.975), 4) AS upper FROM l GROUP BY metric""")
def bootstrap_ci(spark, sf_dir):
    """The operator's 2,000 resamples of a validation set: a stratified sample of the judged rows."""
    judged = _judged(spark, sf_dir)
    quotas = gold.allocate(gold.population(judged, "model_decision"), gold.SAMPLE_SIZE)
    return gold.bootstrap(gold.stratified_sample(judged, quotas, "seed", "model_decision", "row_id").drop("draw"), "seed")


DRAWS = " + ".join(f"(u >= {t})::INT" for t in gold.POISSON)


@query(f"""WITH h AS (SELECT *, sha256('seed:' || row_id) AS t FROM {JUDGED}),
 x AS (SELECT it, model_decision, human_decision, w, (('0x' || t[1:8])::BIGINT % {gold.PRIME} + it * (('0x' || t[9:16])::BIGINT % {gold.PRIME - 1} + 1)) % {gold.PRIME} AS x FROM h, range(2000) r(it)),
 u AS (SELECT *, (x * x % {gold.PRIME}) * (x * x % {gold.PRIME}) % {gold.PRIME} * x % {gold.PRIME} AS u FROM x),
 s AS (SELECT it, model_decision, count(*) / nullif(sum({DRAWS}), 0) AS a, sum(w * ({DRAWS})) AS w, sum(w * ({DRAWS})) FILTER (WHERE human_decision = 'KEEP') AS k FROM u GROUP BY 1, 2),
 e AS (SELECT it, sum(a * k) FILTER (WHERE model_decision <> 'REJECT') / nullif(sum(a * k), 0) AS recall, sum(a * k) FILTER (WHERE model_decision = 'REJECT') / nullif(sum(a * k), 0) AS false_reject_rate,
   sum(k) FILTER (WHERE model_decision = 'KEEP') / nullif(sum(w) FILTER (WHERE model_decision = 'KEEP'), 0) AS keep_precision FROM s GROUP BY it),
 l AS (SELECT 'recall' AS metric, coalesce(recall, 0) AS v FROM e UNION ALL SELECT 'false_reject_rate', coalesce(false_reject_rate, 0) FROM e UNION ALL SELECT 'keep_precision', coalesce(keep_precision, 0) FROM e)
SELECT metric, round(quantile_cont(v, 0.025), 4) AS lower, round(quantile_cont(v, 0.975), 4) AS upper FROM l GROUP BY metric""")
def bootstrap_ci_whole(spark, sf_dir):
    """2,000 resamples of all judged rows, in one pass over them."""
    return gold.bootstrap_whole(_judged(spark, sf_dir), "seed")


@query(f"""SELECT count(*) AS total_rows, round((count(*) FILTER (WHERE Validation_Status = 'validated'))::DOUBLE / count(*), 4) AS structurally_validated_rate, round((count(*) FILTER (WHERE Escalated = 'true'))::DOUBLE / count(*), 4) AS repair_call_rate,
  round(((count(*) FILTER (WHERE doc_id % 4 = 0 AND trim(Title) <> '')) + (count(*) FILTER (WHERE doc_id % 4 = 0 AND length(trim(substr(Abstract, 1, 20))) > 0)))::DOUBLE / (count(*) FILTER (WHERE doc_id % 4 = 0) * 2 + count(*) FILTER (WHERE doc_id % 4 = 1)), 4) AS exact_evidence_rate,
  count(*) FILTER (WHERE doc_id % 4 = 2) AS invalid_evidence_payloads, 0::BIGINT AS invalid_definitive_count FROM {SCREENED}""")
def safety_rates(spark, sf_dir):
    i = F.col("doc_id")
    two = F.to_json(F.array(F.struct(F.lit("title").alias("source"), F.col("Title").alias("quote")), F.struct(F.lit("abstract").alias("source"), F.col("Abstract").substr(F.lit(1), F.lit(20)).alias("quote"))))
    payload = F.when(i % 4 == 0, two).when(i % 4 == 1, '[{"source":"title","quote":"@@ no @@"}]').when(i % 4 == 2, '{"broken":1}').otherwise("")
    return gold.safety_rates(screened(spark, sf_dir).withColumn("Evidence_JSON", payload))


# --- model answers --------------------------------------------------------------


@query("""SELECT doc_id AS question_id, g.place::BIGINT AS place, g.role, CASE g.place WHEN 0 THEN source || ' training' WHEN 1 THEN lang || ' scores' ELSE 'adult readers' END AS canonical, true AS compiled
FROM documents, (VALUES (0, 'intervention_or_method'), (1, 'outcome'), (2, 'population')) g(place, role)""")
def question_parse(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    asked = F.concat(F.lit("How does "), F.col("source"), F.lit(" training affect "), F.col("lang"), F.lit(" scores among adult readers?"))
    out = question.parse_questions(d.select(F.col("doc_id").alias("question_id"), asked.alias("question")))
    return out.select("question_id", "place", "role", "canonical", "compiled")


@query(f"""SELECT doc_id::VARCHAR AS paper_id, CASE WHEN bar THEN 'REJECT' WHEN hit THEN CASE WHEN bar2 THEN 'MAYBE' ELSE 'KEEP' END ELSE 'MAYBE' END AS decision,
  CASE WHEN bar THEN 'not_required' WHEN hit AND bar2 THEN 'disagreement' WHEN hit THEN 'agreement' WHEN bar2 THEN 'disagreement' ELSE 'both_maybe' END AS agreement FROM (
  SELECT *, contains(w, 'license') AS bar, contains(w, 'the ') AS hit, contains(w, 'reserved') AS bar2 FROM (SELECT doc_id, lower(trim(Title) || ' ' || Abstract) AS w FROM {RECORDS} WHERE trim(Title) <> ''))""")
def adapter_screen(spark, sf_dir):
    """Both stages with rule adapters: only what needs a second reading gets one."""
    papers = records(spark, sf_dir).where(T.has_value("Title")).select(F.col("doc_id").cast("string").alias("paper_id"), T.ustrip("Title").alias("title"), F.col("Abstract").alias("abstract"))
    out = screening.two_stage(papers, RuleAdapter(("the ",), ("license",)), RuleAdapter(("the ",), ("license", "reserved")))
    return out.select("paper_id", F.col("Decision").alias("decision"), F.col("Agreement_Status").alias("agreement"))


RUBRIC = {"inclusion": [{"id": "I1", "role": "MANDATORY"}, {"id": "I2", "role": "UNRESOLVED"}], "exclusion": ["E1"], "groups": []}


@query("""SELECT batch_id, paper_id, CASE WHEN k = 0 THEN 'schema_invalid' WHEN k = 1 THEN 'unknown_id_in_response' WHEN m = 0 THEN 'missing_or_unknown_id' WHEN m = 1 THEN 'invalid_exclusion_assessments' WHEN m = 2 THEN 'quote_not_found_in_source' ELSE '' END AS failure,
  CASE WHEN k < 2 OR m < 3 THEN '' WHEN m = 3 THEN 'semantic_contradiction' WHEN m = 4 THEN 'valid_with_verification_required' ELSE 'valid' END AS validation_status,
  CASE WHEN k < 2 OR m < 3 THEN '' WHEN m = 3 THEN 'MAYBE' ELSE 'KEEP' END AS decision FROM (
  SELECT (doc_id // 10)::BIGINT AS batch_id, doc_id::VARCHAR AS paper_id, doc_id // 10 % 7 AS k, doc_id % 10 AS m FROM documents WHERE trim(string_split(text, chr(10))[1]) <> '')""")
def batch_validation(spark, sf_dir):
    """Raw answers of every fault: broken JSON, strange ids, missing papers, wrong criteria, false quotes."""
    papers = records(spark, sf_dir).where(T.has_value("Title")).select(F.floor(F.col("doc_id") / 10).alias("batch_id"), F.col("doc_id").cast("string").alias("paper_id"), T.ustrip("Title").alias("title"), F.col("Abstract").alias("abstract"), (F.col("doc_id") % 10).alias("m"))
    criterion = lambda i, s: F.struct(F.lit(i).alias("criterion_id"), s.alias("status"))
    item = F.struct(
        "paper_id", F.lit("KEEP").alias("decision"), F.lit(0.9).alias("confidence"), F.lit("r").alias("reason"), F.when(F.col("m") == 2, "@@ none @@").otherwise(F.col("title")).alias("evidence_quote"),
        F.array(criterion("I1", F.when(F.col("m") == 3, "NOT_MET").otherwise("MET")), criterion("I2", F.when(F.col("m") == 4, "UNCLEAR").otherwise("MET"))).alias("inclusion_assessments"),
        F.array(criterion("E1", F.lit("NOT_MET"))).alias("exclusion_assessments"), F.array().cast("array<string>").alias("risk_flags"),
    )
    item = F.when(F.col("m") == 1, item.withField("exclusion_assessments", F.array(criterion("E9", F.lit("MET"))))).otherwise(item)
    answers = papers.where("m <> 0").groupBy("batch_id").agg(F.collect_list(item).alias("items"))  # ten papers a batch
    strange = F.transform("items", lambda i: i.withField("paper_id", F.concat(F.lit("x"), i["paper_id"])))
    k = F.col("batch_id") % 7
    raw = F.when(k == 0, "{ not JSON").when(k == 1, F.to_json(F.struct(strange.alias("items")))).otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct("items")), F.lit("\n```")))
    out = A.validate_batch(answers.select("batch_id", raw.alias("raw")), papers.drop("m"), RUBRIC)
    return out.select("batch_id", "paper_id", "failure", "validation_status", F.coalesce("assessment.decision", F.lit("")).alias("decision"))


@query("""SELECT doc_id, doc_id % 5 = 0 OR doc_id % 5 = 4 AS valid, CASE doc_id % 5 WHEN 1 THEN 'no such evidence, C1: title_999' WHEN 2 THEN 'not assessed: C2' WHEN 3 THEN 'kept although an exclusion is met: C2' ELSE '' END AS first_error,
  (CASE WHEN doc_id % 5 = 1 THEN 0 ELSE 1 END)::BIGINT AS exact, doc_id % 5 = 4 AS warned FROM documents WHERE trim(string_split(text, chr(10))[1]) <> ''""")
def criteria_validation(spark, sf_dir):
    m = F.col("doc_id") % 5
    span = F.array(F.struct(F.lit("title").alias("source"), F.when(m == 1, "title_999").otherwise("title_001").alias("evidence_id")))
    none = F.array().cast("array<struct<source:string,evidence_id:string>>")
    one = lambda i, v, e: F.struct(F.lit(i).alias("criterion_id"), v.alias("verdict"), e.alias("evidence"))
    both = F.array(one("C1", F.lit("MET"), span), one("C2", F.when(m == 3, "MET").otherwise("NOT_MET"), none))
    given = F.when(m == 2, F.slice(both, 1, 1)).otherwise(both)
    protocol = [{"id": "C1", "kind": "inclusion", "required": True}, {"id": "C2", "kind": "exclusion", "required": True}]
    v = A.validate_criteria(F.col("Title"), F.col("Abstract"), F.lit("KEEP"), F.when(m == 4, 0.5).otherwise(0.9), given, protocol, F.lit(False))
    out = records(spark, sf_dir).where(T.has_value("Title")).select("doc_id", v.alias("v"))
    return out.select("doc_id", "v.valid", F.coalesce(F.get("v.errors", F.lit(0)), F.lit("")).alias("first_error"), F.col("v.exact").cast("long").alias("exact"), (F.size("v.warnings") > 0).alias("warned"))


@query("""SELECT doc_id, CASE WHEN m = 0 THEN 'KEEP' WHEN m = 3 THEN 'KEEP' ELSE 'MAYBE' END AS decision, CASE m WHEN 0 THEN 'primary_definitive' WHEN 1 THEN 'review_technical_failure' WHEN 2 THEN 'both_maybe' WHEN 3 THEN 'reviewer_resolved' END AS agreement,
  CASE WHEN m = 1 THEN 'local_review_failure' ELSE '' END AS failure, m IN (0, 3) AS repaired FROM (SELECT doc_id, doc_id % 4 AS m FROM documents WHERE trim(string_split(text, chr(10))[1]) <> '')""")
def local_review(spark, sf_dir):
    """First answers with wrong quotes, then the second reading of the MAYBEs: one fails, one stays, one decides."""
    m = F.col("doc_id") % 4
    rows = records(spark, sf_dir).where(T.has_value("Title")).withColumn("row_id", F.col("doc_id"))
    first = screening.local_row(rows.select("row_id", "Title", "Abstract", F.when(m == 0, "KEEP").otherwise("MAYBE").alias("decision"), F.lit(0.8).alias("confidence"), F.when(m == 0, "@@ none @@").otherwise("").alias("evidence_quote")))
    second = screening.local_row(rows.where(m != 0).select("row_id", "Title", "Abstract", F.when(m == 1, "???").when(m == 2, "MAYBE").otherwise("KEEP").alias("decision"), F.lit(0.9).alias("confidence"), F.lit("@@ none @@").alias("evidence_quote")))
    out = screening.apply_review(first, second)
    fixed = F.col("Evidence_Repaired") | ((F.col("Agreement_Status") == "reviewer_resolved") & (F.col("Evidence_Quote") == F.col("Title")))
    return out.select(F.col("row_id").alias("doc_id"), F.col("Decision").alias("decision"), F.col("Agreement_Status").alias("agreement"), F.col("Failure_Class").alias("failure"), fixed.alias("repaired"))
