"""Registered queries of refusals, validation files, platform queries, proposals, sets and headers, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.operators import audit, boolean_query, gold, reconcile
from corpusmill.operators.frames import new_folder, persisted
from corpusmill.plans.queries import query
from corpusmill.plans.tables import SCREENED, screened, table
from corpusmill.sources import ingest, packs, sinks, workbooks
from corpusmill.streaming import incremental

CONCEPTS = "array<struct<label:string,balanced_terms:array<string>,high_recall_terms:array<string>>>"


def _concept(label, balanced, high):
    return F.struct(label.alias("label"), F.array(*balanced).alias("balanced_terms"), F.array(*high).alias("high_recall_terms"))


@query("""WITH d AS (SELECT doc_id, source || ' model' AS a, lang || ' style' AS b FROM documents WHERE source <> '' AND lang <> ''),
 p AS (SELECT unnest(['google_scholar', 'scopus', 'web_of_science', 'ieee_xplore', 'pubmed']) AS platform), v AS (SELECT unnest(['balanced', 'high_recall']) AS version),
 q AS (SELECT doc_id, version, platform, CASE WHEN platform = 'pubmed' THEN '[tiab]' ELSE '' END AS tag, a, b,
   CASE WHEN version = 'balanced' THEN '("' || a || '"' || tag || ')' WHEN platform = 'google_scholar' THEN '("' || a || '" OR "' || a || 's")' ELSE '("' || a || '*"' || tag || ')' END AS x,
   CASE WHEN version = 'balanced' THEN '("' || b || '"' || tag || ')' ELSE '("' || b || '"' || tag || ' OR "' || a || ' ' || b || '"' || tag || ')' END AS y FROM d, p, v)
SELECT doc_id, version, platform, CASE platform WHEN 'scopus' THEN 'TITLE-ABS-KEY(' || x || ' AND ' || y || ')' WHEN 'web_of_science' THEN 'TS=(' || x || ' AND ' || y || ')' ELSE x || ' AND ' || y END AS query FROM q""")
def platform_queries(spark, sf_dir):
    """Balanced and high-recall queries of the concepts of every document, for five platforms."""
    a, b = F.concat("source", F.lit(" model")), F.concat("lang", F.lit(" style"))
    concepts = F.array(_concept(F.col("source"), [a], [a, F.concat(a, F.lit("s"))]), _concept(F.col("lang"), [b], [b, F.concat(a, F.lit(" "), b)]))
    d = table(spark, sf_dir, "documents").where("source <> '' and lang <> ''")
    return boolean_query.compile_bundle(d.select("doc_id", concepts.alias("concepts")), ("doc_id",))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars % 5 = 0 THEN 'two to five concepts' END, CASE WHEN n_chars % 5 <> 0 AND n_chars % 3 = 0 THEN 'unique labels' END,
   CASE WHEN n_chars % 5 <> 0 AND n_chars % 7 = 0 THEN 'high recall holds every balanced term' END, CASE WHEN n_chars % 2 = 0 THEN 'no term is the whole question' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM documents WHERE source <> '' AND lang <> '' AND n_chars IS NOT NULL""")
def proposal_checks(spark, sf_dir):
    """Rules broken by a proposal for every document, the subset rule of balanced and high-recall terms among them."""
    n, a, b = F.col("n_chars"), F.concat(F.lit("topic "), "source"), F.concat(F.lit("style "), "lang")
    first = _concept(F.col("source"), [a], [a, F.concat(a, F.lit(" more"))])
    second = _concept(F.when(n % 3 == 0, F.col("source")).otherwise(F.col("lang")), [b], [F.when(n % 7 == 0, F.concat(b, F.lit(" wide"))).otherwise(b), F.concat(b, F.lit(" other"))])
    concepts = F.when(n % 5 == 0, F.array(first)).otherwise(F.array(first, second)).cast(CONCEPTS)
    question = F.when(n % 2 == 0, F.concat(F.upper(a), F.lit("?"))).otherwise("another question")
    d = table(spark, sf_dir, "documents").where("source <> '' and lang <> '' and n_chars is not null")
    return d.select("doc_id", F.array_join(boolean_query.proposal_errors(concepts, question), "; ").alias("errors"))


@query(r"""WITH l AS (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, min(pos) AS pos FROM l GROUP BY 1, 2),
 u AS (SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE line <> ''), '')) AS lines_sha FROM s GROUP BY 1)
SELECT doc_id, n_lines, lines_sha, n_lines = 0 OR n_chars % 2 = 0 AS same FROM u JOIN documents USING (doc_id)""")
def distinct_lines(spark, sf_dir):
    """The distinct lines of every text in the order of their first places, and whether they equal a changed list as a set."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.split("text", "\n")
    found = audit.unique_strings(lines)
    changed = F.when(F.col("n_chars") % 2 == 0, F.concat(F.reverse(lines), lines)).otherwise(F.slice(found, 2, 2**31 - 1))
    return d.select("doc_id", F.size(found).cast("long").alias("n_lines"), F.sha2(F.array_join(found, "\n").cast("binary"), 256).alias("lines_sha"), audit.same_set(lines, changed).alias("same"))


@query(f"""WITH c AS (SELECT Decision, count(*) AS n FROM {SCREENED} GROUP BY Decision), q AS (SELECT sum(least(n, CASE Decision WHEN 'MAYBE' THEN 4 ELSE 8 END))::BIGINT AS n FROM c)
SELECT said, n AS rows, refusal FROM q, (VALUES ('sound', ''), ('other job', 'the CSV belongs to screening job'), ('other set', 'every row must have the one'), ('twice', 'duplicate Source_Row_Index'), ('added', 'added source rows'), ('removed', 'removed source rows'),
  ('altered', 'immutable blinded content'), ('unknown label', 'invalid Gold_Decision'), ('changed run', 'the screening job has changed')) t(said, refusal)""")
def label_refusals(spark, sf_dir):
    """A validation set written as files and read back; its gate passes sound labels and names what is wrong with others."""
    run = screened(spark, sf_dir).withColumns({"Year": F.lit("2001"), "DOI": F.lit("")})
    header, manifest, labels = gold.create_sample(run, "job", "q", 20)
    root = new_folder(spark, "validation")
    sinks.write_validation_set(header, manifest, labels, root)
    header, manifest, labels = sinks.read_validation_set(spark, root)
    first = labels.orderBy("Source_Row_Index").limit(1)
    one = F.col("Source_Row_Index") == first.first()["Source_Row_Index"]
    only = lambda c, v: labels.withColumn(c, F.when(one, F.lit(v)).otherwise(F.col(c)))
    cases = {
        "sound": labels.withColumn("Gold_Decision", F.lit("keep")), "other job": labels.withColumn("Screening_Job_ID", F.lit("job-2")), "other set": only("Validation_Set_ID", "x"),
        "twice": labels.unionByName(first), "added": labels.unionByName(first.withColumn("Source_Row_Index", F.lit("999999999"))), "removed": labels.where(~one),
        "altered": only("Title", "Another title"), "unknown label": only("Gold_Decision", "PERHAPS"), "changed run": labels,
    }
    expected = ("the CSV belongs to screening job", "every row must have the one", "duplicate Source_Row_Index", "added source rows", "removed source rows", "immutable blinded content", "invalid Gold_Decision", "the screening job has changed")
    rows = []
    for said, given in cases.items():
        try:
            gold.check_labels(given, header, manifest, run.withColumn("Year", F.lit("2002")) if said == "changed run" else run)
            refusal = ""
        except gold.LabelError as e:
            refusal = next((x for x in expected if str(e).startswith(x)), str(e))
        rows.append((said, refusal))
    return spark.createDataFrame(rows, "said string, refusal string").withColumn("rows", F.lit(manifest.count()).cast("long"))


@query(f"""SELECT 'a second job' AS said, 'another screening job is running' AS refusal, count(*) AS rows FROM {SCREENED} UNION ALL SELECT 'a MAYBE left', 'MAYBE records remain', count(*) FROM {SCREENED}
UNION ALL SELECT 'none left', '', count(*) FILTER (WHERE Decision <> 'MAYBE' AND trim(Title) <> '') FROM {SCREENED}""")
def run_refusals(spark, sf_dir):
    """A job beside another and a final pack with a MAYBE left are refused; without one the pack is written."""
    run = screened(spark, sf_dir)

    def second():
        with incremental.single_job(), incremental.single_job():
            return 0

    def finalise(rows):
        return sum(sinks.finalise_pack(rows, new_folder(spark, "refused")).values())

    out = []
    for said, call in (("a second job", second), ("a MAYBE left", lambda: finalise(run)), ("none left", lambda: finalise(run.where("Decision <> 'MAYBE'")))):
        try:
            out.append((said, "", call()))
        except (RuntimeError, ValueError) as e:
            out.append((said, str(e), run.count()))
    return spark.createDataFrame(out, "said string, refusal string, rows long")


@query("SELECT 'customer' AS name, c_custkey AS key, c_name AS value, c_mktsegment AS aliased FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def header_fields(spark, sf_dir):
    """Values of columns that are found by candidates in any case, and by aliases in letters and digits."""
    asked = {"customer": ("c_custkey", ["none", "C_NAME"], ["C MktSegment"]), "supplier": ("s_suppkey", ["S_Name", "s_comment"], ["segment"])}
    out = None
    for name, (key, candidates, aliases) in asked.items():
        t = table(spark, sf_dir, name)
        found, other = ingest.find_column(t.columns, candidates), ingest.alias_columns(t.columns, aliases)
        part = t.select(F.lit(name).alias("name"), F.col(key).cast("long").alias("key"), F.col(found).alias("value"), (F.col(other[0]) if other else F.lit(None).cast("string")).alias("aliased"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""SELECT p.part, s.Source_Row_Index, s.Decision, sha256(coalesce(s.Abstract, '')) AS abstract_sha FROM {SCREENED} s, (SELECT unnest(['all', 'keep', 'maybe', 'reject']) AS part) p WHERE p.part = 'all' OR p.part = lower(s.Decision)""")
def published_pack(spark, sf_dir):
    """Parts of a run published as a pack; a later run that dies in one of its parts leaves them as they were."""
    run = screened(spark, sf_dir).select("Source_Row_Index", "Decision", "Abstract")
    root = new_folder(spark, "published")
    packs.publish({"all": run} | {d: run.where(F.lower("Decision") == d) for d in ("keep", "maybe", "reject")}, root)
    dying = run.withColumn("Abstract", F.when(F.col("Decision") == "KEEP", F.raise_error(F.lit("the run dies"))).otherwise(F.col("Abstract")))
    try:
        packs.publish({"all": run.where("Decision <> 'KEEP'"), "keep": dying}, root)
    except Exception as e:
        if "the run dies" not in str(e):
            raise
    out = None
    for part in ("all", "keep", "maybe", "reject"):
        rows = packs.read_part(spark, root, part).select(F.lit(part).alias("part"), "Source_Row_Index", "Decision", F.sha2(F.coalesce("Abstract", F.lit("")).cast("binary"), 256).alias("abstract_sha"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_sha, coalesce(lang, '') AS lang, '' AS missing FROM documents WHERE doc_id IS NOT NULL")
def workbook_rows(spark, sf_dir):
    """Whole texts put into workbooks of some 200 rows, whose headers differ in order and case, and read back."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.col("doc_id") / 200).alias("book"))

    def made(key, pdf):
        names = ["doc_id", "text", "lang"] if key[0] % 2 else ["LANG", "Text ", "doc_id"]
        rows = pdf[[n.lower().strip() for n in names]].to_numpy().tolist()
        return pd.DataFrame({"path": [f"book-{key[0]}.xlsx"], "content": [workbooks.workbook([names, *rows])]})

    files = d.groupBy("book").applyInPandas(made, "path string, content binary")
    back = workbooks.named_rows(persisted(workbooks.parse_workbooks(files)), ["doc_id", "text", "lang", "missing"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"), "lang", "missing")


@query("""SELECT doc_id, 'missing' AS side FROM documents WHERE n_chars % 97 = 0 UNION ALL SELECT doc_id + 1000000000, 'unexpected' FROM documents WHERE n_chars % 89 = 0""")
def set_reconcile(spark, sf_dir):
    """Ids that a copy of the documents lacks or has more, peeled off a table of cells instead of joining both sets."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    copy = d.where("n_chars % 97 <> 0").select("doc_id").unionByName(d.where("n_chars % 89 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id")))
    return reconcile.reconcile(d.select("doc_id"), copy, "doc_id")
