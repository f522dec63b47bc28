"""Registered queries of files, runs, protocols and streams, and the SQL that checks them.

They write into new folders of the shared folder and read back what they wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import values as V
from corpusmill.operators import assessment as A
from corpusmill.operators import boolean_query, dedup, flow, gold, protocol, question, review, screening
from corpusmill.operators.adapters import RuleAdapter
from corpusmill.operators.frames import new_folder
from corpusmill.plans.queries import RUBRIC, _exports, query
from corpusmill.plans.tables import RECORDS, SCREENED, records, screened, table
from corpusmill.sources import ingest, sinks
from corpusmill.streaming import incremental

# --- files ------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS text_sha, CASE WHEN doc_id % 3 = 0 THEN '0' ELSE '' END AS cited, coalesce(lang, '') AS lang FROM documents""")
def csv_round_trip(spark, sf_dir):
    """Whole texts with line feeds, quotes and commas, written as CSV and read back as text: 0 stays "0"."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "0").alias("cited"), "lang")
    path = new_folder(spark, "csv")
    sinks.write_csv(rows, path)
    back = ingest.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), V.sha256(F.col("text")).alias("text_sha"), "cited", "lang")


@query("""WITH e AS (SELECT CASE WHEN doc_id % 4 IN (0, 1) THEN 'd' || doc_id ELSE 't' || lower(trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g'))) END AS k,
  doc_id % 4 IN (0, 1) OR trim(string_split(text, chr(10))[1]) <> '' AS keyed, doc_id FROM documents),
 g AS (SELECT count(*) AS n FROM e GROUP BY CASE WHEN keyed THEN k ELSE 'u' || doc_id END)
SELECT sum(n)::BIGINT AS total, count(*) AS kept, sum(n - 1)::BIGINT AS removed FROM g""")
def merge_files(spark, sf_dir):
    """Three exports as CSV files with their own headers, merged: total, kept and removed records."""
    paths = []
    for k, export in enumerate(_exports(spark, sf_dir)):
        paths.append(f"{new_folder(spark, 'export')}-{k}.csv")
        sinks.write_csv(export.drop("doc_id"), paths[-1])
    merged = ingest.merge_exports(spark, paths)
    place = F.concat_ws("/", "file_idx", "row_idx")
    counts = dedup.group_counts(merged, dedup.match_key("DOI", "Title", place, unify_doi=True))
    return counts.select(F.col("records_identified").alias("total"), F.col("groups").alias("kept"), F.col("duplicates_removed").alias("removed"))


@query("""SELECT doc_id, job_id FROM (SELECT doc_id, 'job-' || doc_id % 5 AS job_id FROM documents) WHERE job_id = 'job-3'""")
def run_lookup(spark, sf_dir):
    """The rows of one persisted run; the partition column prunes the scan."""
    path = new_folder(spark, "runs")
    runs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("job-"), (F.col("doc_id") % 5).cast("string")).alias("job_id"))
    runs.write.partitionBy("job_id").parquet(path)
    return ingest.read_run(spark, path, "job-3").select("doc_id", "job_id")


@query("""SELECT event_type AS kind, count(*) AS n, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'present' ELSE '' END AS note FROM events GROUP BY event_type""")
def json_documents(spark, sf_dir):
    """A summary document per event type, written and read back with a schema; a missing file is an empty document."""
    path = new_folder(spark, "documents")
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    least = counts.agg(F.min("kind").alias("least"))
    noted = counts.join(F.broadcast(least)).withColumn("note", F.when(F.col("kind") == F.col("least"), "present"))
    noted.select("kind", F.to_json(F.struct("kind", "n", "note")).alias("value")).write.partitionBy("kind").text(path)
    found = ingest.read_json_document(spark, path, "kind string, n long, note string")
    none = ingest.read_json_document(spark, f"{path}-absent", "kind string, n long, note string").where("kind is not null")
    return found.unionByName(none).select("kind", "n", F.coalesce("note", F.lit("")).alias("note"))


@query(f"""WITH s AS (SELECT * FROM {SCREENED}), parts AS (
  SELECT 'screened_all.csv' AS part, * FROM s UNION ALL SELECT 'screened_' || lower(Decision) || '.csv', * FROM s UNION ALL SELECT 'screened_maybe_review_queue.csv', * FROM s WHERE Decision = 'MAYBE')
SELECT part, Decision, count(*) AS n, sum(Source_Row_Index::BIGINT)::BIGINT AS ids, count(*) FILTER (WHERE trim(Title) <> '') AS titled, sum(length(trim(Abstract, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))::BIGINT AS abstract_chars FROM parts GROUP BY part, Decision""")
def export_pack(spark, sf_dir):
    """The whole pack of a run, read back from its files: every part under its fixed name, Decision in upper case."""
    root = new_folder(spark, "exports")
    run = screened(spark, sf_dir).withColumns({"API Key": F.lit("secret"), "doc_id": F.col("doc_id").cast("string")})
    sinks.export_pack(run, root, "job-1", {"research_question": "q"})
    parts = None
    for name in sinks.EXPORT_FILES.values():
        if not name.endswith(".csv"):
            continue
        rows = ingest.read_csv(spark, f"{root}/job-1/{name}").withColumn("part", F.lit(name))
        if "API Key" in rows.columns:
            raise ValueError("a secret column was exported")
        rows = rows.select("part", "Decision", "Source_Row_Index", "Title", "Abstract")
        parts = rows if parts is None else parts.unionByName(rows)
    chars = F.length(F.btrim("Abstract", F.lit(" \t\n\x0b\x0c\r")))
    return parts.groupBy("part", "Decision").agg(F.count("*").alias("n"), F.sum(F.col("Source_Row_Index").cast("long")).alias("ids"), F.count_if(T.has_value("Title")).alias("titled"), F.sum(chars).cast("long").alias("abstract_chars"))


@query(f"""SELECT lower(Decision) AS final_decision, Decision, count(*) AS n FROM {SCREENED} WHERE Decision <> 'MAYBE' AND trim(Title) <> '' GROUP BY Decision""")
def finalised_pack(spark, sf_dir):
    """The final rows by decision, read back; a run with a MAYBE left is refused."""
    root = new_folder(spark, "final")
    run = screened(spark, sf_dir)
    if not screening.may_finalise(run):
        run = run.where("Decision <> 'MAYBE'")
    sinks.finalise_pack(run, root)
    return spark.read.parquet(root).groupBy("final_decision", "Decision").agg(F.count("*").alias("n"))


@query("""SELECT true AS ok, count(*) AS row_count, 'authors|title|year|source' AS header, false AS bibtex_like, 0 AS errors FROM documents""")
def csv_quality(spark, sf_dir):
    """Inspection of an exported CSV: header, row count, widths."""
    path = new_folder(spark, "quality")
    d = table(spark, sf_dir, "documents")
    sinks.write_csv(d.select(F.lit("a").alias("authors"), F.concat(F.lit("t, \"q\"\n"), F.col("doc_id").cast("string")).alias("title"), F.lit("2001").alias("year"), "source"), path)
    got = ingest.inspect_csv(spark, path, expected_rows=d.count())
    row = (got["ok"], got["row_count"], "|".join(got["header"]), got["bibtex_like"], len(got["errors"]))
    return spark.createDataFrame([row], "ok boolean, row_count long, header string, bibtex_like boolean, errors int")


@query("""SELECT * FROM (VALUES ('customer', 'c_name', 'c_name,c_mktsegment'), ('orders', 'o_orderdate', ''), ('supplier', 's_name', 's_name'), ('nation', 'n_name', 'n_name')) t(name, found, aliased)""")
def column_finders(spark, sf_dir):
    """Headers of the driver tables: first candidate in any case, and columns that equal an alias in letters and digits."""
    asked = {"customer": (["none", "C_NAME"], ["CName", "c mktsegment"]), "orders": (["O_ORDERDATE"], ["name"]), "supplier": (["s_NAME "[:-1]], ["S-Name"]), "nation": (["N_Name", "n_comment"], ["n name", "N.NAME"])}
    rows = []
    for name, (candidates, aliases) in asked.items():
        columns = table(spark, sf_dir, name).columns
        rows.append((name, ingest.find_column(columns, candidates), ",".join(ingest.alias_columns(columns, aliases))))
    return spark.createDataFrame(rows, "name string, found string, aliased string")


# --- runs ---------------------------------------------------------------------------


@query(f"""SELECT 'local' AS engine, doc_id FROM {RECORDS} UNION ALL SELECT 'web', doc_id FROM {RECORDS} WHERE trim(Title) <> ''
UNION ALL (SELECT 'limited', doc_id FROM {RECORDS} WHERE trim(Title) <> '' ORDER BY doc_id DESC LIMIT 25)""")
def run_population(spark, sf_dir):
    """Who is screened: all (local), those with a title (web), the first of an order if a limit is asked for."""
    r = records(spark, sf_dir)
    parts = {"local": screening.population(r), "web": screening.population(r, "web"), "limited": screening.population(r, "web", 25, [F.col("doc_id").desc()])}
    named = [df.select(F.lit(name).alias("engine"), "doc_id") for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(f"""SELECT doc_id, k = 0 AND NOT pending AS reusable, (k = 0 AND NOT pending) OR (k < 3 AND pending AND Decision = 'MAYBE' AND k <> 2) AS restorable FROM (
  SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 3 WHEN Failure_Class <> '' THEN 1 ELSE 0 END AS k, doc_id % 5 = 0 AS pending, Decision FROM {SCREENED})""")
def checkpoint_reuse(spark, sf_dir):
    """Which checkpoint rows settle a paper (same protocol, validated, no failure, not pending), and which may be taken up again."""
    i = F.col("doc_id")
    rows = screened(spark, sf_dir).withColumns({"Protocol_ID": F.when(i % 4 == 3, "other").otherwise("p1"), "Review_Pending": (i % 5 == 0).cast("string"), "Primary_Decision": F.lit("MAYBE"), "Validation_Status": F.when(F.col("Failure_Class") != "", "safe_fallback").otherwise("validated")})
    return rows.select("doc_id", F.coalesce(A.reusable_local("p1"), F.lit(False)).alias("reusable"), A.restorable_local("p1").alias("restorable"))


@query(f"""SELECT Source_Row_Index, CASE WHEN doc_id % 3 = 0 THEN 'because ' || doc_id ELSE '' END AS Primary_Reason, CASE WHEN doc_id % 3 = 0 THEN 'said' ELSE '' END AS Primary_Evidence_Quote, '' AS Verifier_Reason,
  false AS holds_secret, true AS source_first FROM {SCREENED}""")
def export_fields(spark, sf_dir):
    """Fields out of the stored answers, source columns first, no column that looks like a secret."""
    i = F.col("doc_id")
    answer = F.when(i % 3 == 0, F.to_json(F.struct(F.concat(F.lit("because "), i.cast("string")).alias("reason"), F.lit("said").alias("evidence_quote")))).when(i % 3 == 1, "{broken")
    run = screened(spark, sf_dir).withColumns({"Primary_Assessment_JSON": answer, "Session-Token": F.lit("x"), "apikey": F.lit("y")})
    out = review.prepare(run, "job", review.guard(run, "job"))
    secret = any(c.lower() in ("session-token", "apikey") for c in out.columns)
    first = out.columns.index("Title") < out.columns.index("Job_ID")
    return out.select("Source_Row_Index", "Primary_Reason", "Primary_Evidence_Quote", "Verifier_Reason", F.lit(secret).alias("holds_secret"), F.lit(first).alias("source_first"))


@query("""SELECT * FROM (VALUES ('sound', ''), ('empty', 'the run is empty'), ('invalid', 'invalid screening decisions'), ('repeated', 'Source_Row_Index values must be nonempty and unique'),
 ('other job', 'the run does not belong to the requested job'), ('unsafe', 'unsafe definitive fallback decisions prevent export'), ('two protocols', 'multiple Protocol_ID values'), ('no column', 'missing columns: Decision')) t(variant, refusal)""")
def guard_refusals(spark, sf_dir):
    """What the export guard says to a sound run and to seven broken ones."""
    run = screened(spark, sf_dir)
    broken = {
        "sound": run, "empty": run.limit(0), "invalid": run.withColumn("Decision", F.lit("YES")), "repeated": run.union(run), "other job": run.withColumn("Job_ID", F.lit("k")),
        "unsafe": run.withColumns({"Validation_Status": F.lit("safe_fallback"), "Decision_Source": F.lit("tool")}), "two protocols": run.withColumn("Protocol_ID", F.col("Source_Row_Index")), "no column": run.drop("Decision"),
    }
    rows = []
    for name, frame in broken.items():
        try:
            review.guard(frame, "j")
            rows.append((name, ""))
        except review.ExportError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "variant string, refusal string")


@query(f"""WITH n AS (SELECT count(*) FILTER (WHERE Decision = 'KEEP') AS keep, count(*) FILTER (WHERE Decision = 'MAYBE') AS maybe, count(*) FILTER (WHERE Decision = 'REJECT') AS reject, count(*) AS screened FROM {SCREENED})
SELECT unnest(['records_identified','duplicate_records_removed','records_selected_for_run','records_screened','records_awaiting_screening','records_excluded','records_awaiting_manual_review','records_included_after_title_abstract','status','equations_valid']) AS field,
  unnest(['1000010','10','1000000', screened::VARCHAR, (1000000 - screened)::VARCHAR, reject::VARCHAR, maybe::VARCHAR, keep::VARCHAR, 'manual_review', 'true']) AS value FROM n""")
def flow_manifest(spark, sf_dir):
    """The flow of records as field and value, for a flat file."""
    plan = {"identified": 1_000_010, "duplicates": 10, "available": 1_000_000, "selected": 1_000_000}
    rows = flow.manifest_rows(flow.snapshot(flow.decision_counts(screened(spark, sf_dir)), plan))
    wanted = ["records_identified", "duplicate_records_removed", "records_selected_for_run", "records_screened", "records_awaiting_screening", "records_excluded", "records_awaiting_manual_review", "records_included_after_title_abstract", "status", "equations_valid"]
    return rows.where(F.col("field").isin(*wanted)).select("field", "value")


@query(f"""WITH f AS (SELECT sha256(sha256(Decision) || '|' || sha256(Source_Row_Index) || '|' || sha256(Abstract)) AS h FROM {SCREENED})
SELECT count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT)::HUGEINT::VARCHAR AS s0, true AS free_of_order, true AS free_of_job, true AS sees_change FROM f""")
def run_fingerprint(spark, sf_dir):
    """The content fingerprint: its first sum from plain hashes, and that only content changes it."""
    run = screened(spark, sf_dir).select("Decision", "Source_Row_Index", "Abstract")
    whole = gold.content_fingerprint(run)
    shuffled, named = gold.content_fingerprint(run.repartition("Source_Row_Index")), gold.content_fingerprint(run.withColumn("Job_ID", F.lit("x")))
    changed = gold.content_fingerprint(run.withColumn("Decision", F.when(F.col("Source_Row_Index") == run.agg(F.min("Source_Row_Index")).first()[0], "other").otherwise(F.col("Decision"))))
    h = run.select(V.row_fingerprint(["Decision", "Source_Row_Index", "Abstract"]).alias("h"))
    sums = h.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("s0"))
    return sums.select("n", "s0", F.lit(whole == shuffled).alias("free_of_order"), F.lit(whole == named).alias("free_of_job"), F.lit(whole != changed).alias("sees_change"))


@query("""SELECT true AS same_inputs, true AS other_question, true AS short_id, sha256('{"a": 1, "b": "ü"}') AS id, true AS revision_stable, true AS revision_moves""")
def identities(spark, sf_dir):
    """Ids of protocols, configurations and manifests: the same inputs, the same id."""
    a, b = (screening.protocol_id(q, "c", "i", "e", prompt="v1") for q in ("q", "q2"))
    counts = flow.decision_counts(screened(spark, sf_dir))
    plans = [{"identified": n, "duplicates": 0, "available": n, "selected": n} for n in (10**6, 10**6, 10**6 + 1)]
    first, again, other = (flow.snapshot(counts, p).select(flow.revision(flow.snapshot(counts, p)).alias("r")).first()["r"] for p in plans)
    row = (a == screening.protocol_id("q", "c", "i", "e", prompt="v1"), a != b, len(V.identity({"a": 1}, 16)) == 16, V.identity({"b": "ü", "a": 1}), first == again, first != other)
    return spark.createDataFrame([row], "same_inputs boolean, other_question boolean, short_id boolean, id string, revision_stable boolean, revision_moves boolean")


@query(f"""WITH a AS (SELECT Decision, row_number() OVER (PARTITION BY Decision) AS k FROM {SCREENED}), c AS (SELECT Decision, count(*) AS n FROM a GROUP BY Decision)
SELECT c.Decision AS model_decision, least(n, CASE c.Decision WHEN 'MAYBE' THEN 4 ELSE 8 END)::BIGINT AS rows, true AS blind, '' AS refusal FROM c""")
def validation_labels(spark, sf_dir):
    """A blinded validation set, labelled, bound to its run: its rows by decision, and that the gate lets it pass."""
    run = screened(spark, sf_dir).withColumns({"Year": F.lit("2001"), "DOI": F.lit("")})
    header, manifest, labels = gold.create_sample(run, "job", "q", 20)
    blind = not {"model_decision", "sampling_weight", "Decision", "Confidence"} & set(labels.columns)
    done = labels.withColumn("Gold_Decision", F.lit("keep"))
    try:
        gold.check_labels(done, header, manifest, run)
        refusal = ""
    except gold.LabelError as e:
        refusal = str(e)
    return manifest.groupBy("model_decision").agg(F.count("*").alias("rows")).withColumns({"blind": F.lit(blind), "refusal": F.lit(refusal)})


@query("""SELECT draft_id, round(CASE WHEN want = 0 THEN 1.0 ELSE both_ / want END, 6)::DOUBLE AS covered FROM (
  SELECT doc_id AS draft_id, len(w)::DOUBLE AS want, len(list_intersect(w, ['the', 'of', 'and', 'le', 'la', 'der', 'die', 'que', 'el']))::DOUBLE AS both_ FROM (
    SELECT doc_id, list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+')) AS w FROM documents))""")
def token_coverage(spark, sf_dir):
    """Share of a title's tokens that a list offers."""
    words = F.filter(F.split(T.norm_query("Title"), " "), lambda w: w != "")
    offered = F.array(*[F.lit(w) for w in ("the", "of", "and", "le", "la", "der", "die", "que", "el")])
    return records(spark, sf_dir).select(F.col("doc_id").alias("draft_id"), F.round(boolean_query.coverage(words, offered), 6).alias("covered"))


@query("""WITH p AS (SELECT doc_id, doc_id // 10 % 3 AS k, doc_id % 10 AS m FROM documents)
SELECT CASE WHEN k = 0 THEN 'schema_invalid' WHEN m = 0 THEN 'missing_or_unknown_id' WHEN m = 1 THEN 'invalid_exclusion_assessments' ELSE '' END AS failure, count(*) AS n FROM p GROUP BY 1""")
def rejection_counts(spark, sf_dir):
    """How many papers each fault of a batch answer costs."""
    i = F.col("doc_id")
    papers = records(spark, sf_dir).select(F.floor(i / 10).alias("batch_id"), i.cast("string").alias("paper_id"), F.col("Title").alias("title"), F.col("Abstract").alias("abstract"), (i % 10).alias("m"))
    one = lambda c, s: F.array(F.struct(F.lit(c).alias("criterion_id"), F.lit(s).alias("status")))
    inclusion = F.concat(one("I1", "MET"), one("I2", "MET"))
    item = F.struct("paper_id", F.lit("MAYBE").alias("decision"), F.lit(0.9).alias("confidence"), F.lit("r").alias("reason"), F.lit("").alias("evidence_quote"), inclusion.alias("inclusion_assessments"), F.when(F.col("m") == 1, one("E9", "MET")).otherwise(one("E1", "NOT_MET")).alias("exclusion_assessments"), F.array().cast("array<string>").alias("risk_flags"))
    answers = papers.groupBy("batch_id").agg(F.collect_list(F.when(F.col("m") != 0, item)).alias("items"))  # ten papers a batch
    raw = F.when(F.col("batch_id") % 3 == 0, "[").otherwise(F.to_json(F.struct("items")))
    return A.validate_batch(answers.select("batch_id", raw.alias("raw")), papers.drop("m"), RUBRIC).groupBy("failure").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN ['KEEP','MAYBE','REJECT'][(doc_id % 3)::INT + 1] WHEN doc_id % 2 = 0 THEN 'deep' WHEN doc_id % 5 = 0 THEN 'deep' ELSE 'KEEP' END AS decision FROM documents""")
def critic_fallback(spark, sf_dir):
    """A critic decides if its answer is valid, else a valid deep reading, else the critic or what there is."""
    i = F.col("doc_id")
    critic = F.when((i % 3 == 0) & (i % 5 == 0), F.lit(None)).otherwise(F.get(F.array(F.lit("KEEP"), F.lit("MAYBE"), F.lit("REJECT")), (i % 3).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", A.after_critic(critic, i % 3 != 0, F.lit("deep"), i % 2 == 0).alias("decision"))


# --- questions and protocols -----------------------------------------------------------

#: Questions of many forms, and (role, concept, coordination) of each of their groups.
FORMS = (
    ("How does alpha compared with beta alter access and cost?", (("intervention_or_method", "alpha", "single"), ("comparison", "beta", "single"), ("outcome", "access OR cost", "alternatives"))),
    ("How does alpha versus beta yield precision and recall?", (("intervention_or_method", "alpha", "single"), ("comparison", "beta", "single"), ("outcome", "precision OR recall", "alternatives"))),
    ("How does alpha relative to beta lead to speed and accuracy?", (("intervention_or_method", "alpha", "single"), ("comparison", "beta", "single"), ("outcome", "speed OR accuracy", "alternatives"))),
    ("Among compact and high-capacity cells, how does alpha affect beta?", (("intervention_or_method", "alpha", "single"), ("outcome", "beta", "single"), ("population", "compact and high-capacity cells", "shared_head"))),
    ("What is the impact of yoga on stress and anxiety in nurses?", (("intervention_or_method", "yoga", "single"), ("outcome", "stress OR anxiety", "alternatives"), ("other", "nurses", "single"))),
    ("Does aspirin reduce pain compared with placebo in children during 2010-2020?", (("intervention_or_method", "aspirin", "single"), ("outcome", "pain", "single"), ("comparison", "placebo", "single"), ("other", "children", "single"), ("other", "2010-2020", "single"))),
    ("How effective are masks for infection?", (("intervention_or_method", "masks", "single"), ("outcome", "infection", "single"))),
)
FORMS_SQL = ", ".join(f"({k}, {p}, '{role}', '{concept}', '{how}')" for k, (_, groups) in enumerate(FORMS) for p, (role, concept, how) in enumerate(groups))


@query(f"""SELECT doc_id AS question_id, place::BIGINT AS place, role, concept AS canonical, coordination FROM documents JOIN (VALUES {FORMS_SQL}) f(k, place, role, concept, coordination) ON doc_id % {len(FORMS)} = k""")
def question_forms(spark, sf_dir):
    """Seven forms of questions, dealt to the documents."""
    asked = F.get(F.array(*[F.lit(q) for q, _ in FORMS]), (F.col("doc_id") % len(FORMS)).cast("int"))
    out = question.parse_questions(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), asked.alias("question")))
    return out.select("question_id", "place", "role", "canonical", "coordination")


@query("""SELECT doc_id AS question_id, CASE doc_id % 4 WHEN 0 THEN 'single_ambiguous' WHEN 1 THEN 'single_ambiguous' ELSE 'read' END AS outcome FROM documents""")
def question_shapes(spark, sf_dir):
    """Misspelled starters and several sentences stay one ambiguous group; well-formed ones are read."""
    asked = F.get(F.array(F.lit("Hwo does alpha affect beta?"), F.lit("Alpha matters. Does it affect beta?"), F.lit("How does alpha affect beta?"), F.lit("Does alpha affect beta vs. gamma?")), (F.col("doc_id") % 4).cast("int"))
    out = question.parse_questions(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), asked.alias("question")))
    state = F.when((F.count("*") == 1) & (F.max("coordination") == "ambiguous"), "single_ambiguous").otherwise("read")
    return out.groupBy("question_id").agg(state.alias("outcome"))


@query("""SELECT doc_id AS question_id, k::BIGINT AS term, t.source FROM documents, (VALUES (0, 'literal'), (1, 'morphology'), (2, 'literal'), (3, 'validated_model')) t(k, source)""")
def term_provenance(spark, sf_dir):
    """Where each drafted term comes from, and that only safe ones come into a group."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.lit("How does decision-support imaging affect outcomes of random forests (RF)?").alias("question"), F.array(F.lit("imaging"), F.lit("decision support imaging"), F.lit("RF"), F.lit("radar")).alias("terms"))
    return protocol.term_sources(asked)


@query("""SELECT doc_id AS run_id, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 0 END AS errors, doc_id % 4 IN (0, 3) AS preserves, CASE WHEN doc_id % 4 IN (0, 3) THEN 'draft' ELSE 'fallback' END AS used FROM documents""")
def rubric_rules(spark, sf_dir):
    """Drafted rubrics: a sound one, one with a repeated id, one that loses a line, one that keeps a choice as a group."""
    i = F.col("doc_id") % 4
    criterion = lambda k, t, role: F.struct(F.lit(k).alias("id"), F.lit(t).alias("text"), F.lit(role).alias("role"))
    two = F.array(criterion("I1", "adults", "MANDATORY"), criterion("I2", "yoga", "MANDATORY"))
    twice = F.array(criterion("I1", "adults", "MANDATORY"), criterion("I1", "yoga", "MANDATORY"))
    loose = F.array(criterion("I1", "at least one of adults", "MANDATORY"), criterion("I2", "yoga", "MANDATORY"))
    groups = F.when(i == 3, F.array(F.struct(F.lit("g").alias("id"), F.lit("ANY").alias("operator"), F.array(F.lit("I1"), F.lit("I2")).alias("members"), F.lit(1).alias("minimum"))))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run_id"), F.when(i == 2, "adults; sleep").when(i == 3, "at least one of adults\n- yoga").when(i == 1, "- children").otherwise("- adults\n2) yoga").alias("inclusion"), F.lit("").alias("exclusion"),
        F.when(i == 1, twice).when(i == 3, loose).otherwise(two).alias("criteria"), groups.alias("groups"),
    )
    return protocol.check_rubrics(rows)


@query("""SELECT doc_id AS run_id, CASE WHEN doc_id % 3 = 0 THEN 'validated' ELSE 'fallback' END AS status, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS n_groups FROM documents""")
def question_frames(spark, sf_dir):
    """Submitted structures: one of this question, one of another, one with a span that the question lacks."""
    i = F.col("doc_id") % 3
    span = F.when(i == 2, "radar").otherwise("yoga")
    own = F.when(i == 1, "Another question?").otherwise("How does yoga affect stress?")
    submitted = F.to_json(F.struct(own.alias("question"), F.array(F.struct(F.lit("Yoga").alias("label"), F.array(span).alias("source_spans"))).alias("groups")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.lit("How does yoga affect stress?").alias("question"), submitted.alias("submitted"))
    return protocol.frames(rows)


@query("""SELECT doc_id, string_agg(block, ' AND ' ORDER BY g) AS query FROM documents, range(8) t(g), LATERAL (
  SELECT '(' || string_agg('"w' || doc_id || ' g' || g || 'x' || k || '"', ' OR ' ORDER BY k) || ')' AS block FROM range(8) u(k)) GROUP BY doc_id""")
def term_caps(spark, sf_dir):
    """Ten groups of ten terms compile to the first eight of each."""
    i = F.col("doc_id").cast("string")
    groups = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda g: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("w"), i, F.lit(" g"), g.cast("string"), F.lit("x"), k.cast("string"))))
    return table(spark, sf_dir, "documents").select("doc_id", boolean_query.compile_query(groups, "google_scholar").alias("query"))


# --- models and streams -------------------------------------------------------------------


def _papers(spark, sf_dir):
    return records(spark, sf_dir).where(T.has_value("Title")).select(F.col("doc_id").cast("string").alias("paper_id"), T.ustrip("Title").alias("title"), F.col("Abstract").alias("abstract"))


WORDS = f"(SELECT doc_id, lower(trim(Title) || ' ' || Abstract) AS w, trim(Title) AS t FROM {RECORDS} WHERE trim(Title) <> '')"


@query(f"""SELECT doc_id::VARCHAR AS paper_id, CASE WHEN contains(t, ' ') THEN CASE WHEN contains(w, 'the ') THEN 'KEEP' ELSE 'MAYBE' END ELSE 'MAYBE' END AS decision, NOT contains(t, ' ') AS technical FROM {WORDS}""")
def bisect_retry(spark, sf_dir):
    """A model that fails on some papers: batches are halved until only those are left, as technical MAYBEs."""
    papers = _papers(spark, sf_dir).withColumn("title", F.when(F.col("title").contains(" "), F.col("title")).otherwise(F.concat(F.lit("@@ "), F.col("title"))))
    out = screening.assess(papers, RuleAdapter(("the ",), (), "@@ "))
    return out.select("paper_id", "assessment.decision", F.col("assessment.technical_failure").alias("technical"))


@query(f"SELECT doc_id::VARCHAR AS paper_id, 'MAYBE' AS decision, 'local_inference_failure' AS failure FROM {WORDS}")
def time_budget(spark, sf_dir):
    """Without time left no paper is asked about: all are technical MAYBEs."""
    out = screening.assess(_papers(spark, sf_dir), RuleAdapter(("the ",)), budget_seconds=-1.0)
    return out.select("paper_id", "assessment.decision", F.col("assessment.failure_class").alias("failure"))


@query(f"""SELECT doc_id::VARCHAR AS paper_id, CASE WHEN contains(w, 'license') THEN 'REJECT' WHEN contains(w, 'the ') THEN 'KEEP' ELSE 'MAYBE' END AS decision, 0::BIGINT AS screened_again, 100 AS percent FROM {WORDS}""")
def stream_screen(spark, sf_dir):
    """Papers that arrive as files, screened as a stream; a second run finds all of them settled and asks nothing."""
    papers, source, root = _papers(spark, sf_dir), new_folder(spark, "arrivals"), new_folder(spark, "stream")
    papers.write.parquet(source)
    model = RuleAdapter(("the ",), ("license",))
    with incremental.single_job():
        stream = spark.readStream.schema(papers.schema).option("maxFilesPerTrigger", 64).parquet(source)
        incremental.screen_stream(stream, root, "id1", model, model, new_folder(spark, "stream-checkpoint")).awaitTermination()
    again = incremental.screen_batch(papers, root, "id1", model, model)
    done = incremental.results(spark, root, "id1")
    percent = incremental.progress_row(done, papers.count(), 1.0).first()["percent"]
    return done.select("paper_id", F.col("Decision").alias("decision"), F.lit(again).cast("long").alias("screened_again"), F.lit(percent).alias("percent"))


@query(f"""SELECT doc_id::VARCHAR AS paper_id, CASE WHEN bar THEN 'REJECT' WHEN hit THEN 'KEEP' ELSE 'MAYBE' END AS decision,
  CASE WHEN bar THEN CASE WHEN true THEN 'valid' END WHEN hit THEN CASE WHEN of_ THEN 'valid' ELSE 'valid_with_verification_required' END ELSE 'valid_with_verification_required' END AS validation_status, '' AS failure
FROM (SELECT doc_id, contains(w, 'license') AS bar, contains(w, 'the ') AS hit, contains(w, 'of ') AS of_ FROM {WORDS})""")
def criteria_screen(spark, sf_dir):
    """Papers screened by criteria: every answer is checked against the rubric before it counts."""
    model = RuleAdapter(("the ",), ("license",), inclusion={"I1": "the ", "I2": "of "}, exclusion={"E1": "license"})
    out = screening.assess_by_criteria(_papers(spark, sf_dir), model, RUBRIC)
    return out.select("paper_id", F.col("Decision").alias("decision"), F.col("Validation_Status").alias("validation_status"), F.col("Failure_Class").alias("failure"))


@query(f"""SELECT doc_id::VARCHAR AS paper_id, CASE WHEN hit AND NOT bar THEN 'KEEP' WHEN bar2 THEN 'REJECT' WHEN hit THEN 'KEEP' WHEN of_ THEN 'KEEP' ELSE 'MAYBE' END AS decision,
  CASE WHEN hit AND NOT bar THEN 'triage' WHEN bar2 OR hit THEN 'deep' ELSE 'critic' END AS layer, CASE WHEN hit AND NOT bar THEN 1 WHEN bar2 OR hit THEN 2 ELSE 3 END AS steps
FROM (SELECT doc_id, contains(w, 'license') AS bar, contains(w, 'reserved') AS bar2, contains(w, 'the ') AS hit, contains(w, 'of ') AS of_ FROM {WORDS})""")
def cascade_screen(spark, sf_dir):
    """Three layers: triage of all, a deep reading of rejects and doubts, a critic for what is still in doubt."""
    out = screening.cascade(_papers(spark, sf_dir), RuleAdapter(("the ",), ("license",)), RuleAdapter(("the ",), ("reserved",)), RuleAdapter(("of ",)))
    return out.select("paper_id", F.col("Decision").alias("decision"), F.col("Decision_Layer").alias("layer"), F.size("Layer_Trace").alias("steps"))


@query("""SELECT doc_id AS question_id, 'balanced' AS version, '("' || source || ' training") AND ("' || lang || ' scores")' AS query FROM documents
UNION ALL SELECT doc_id, 'high_recall', '("' || source || ' training") AND ("' || lang || ' scores")' FROM documents""")
def query_generation(spark, sf_dir):
    """Question and drafted terms to compiled queries: parsed, laid on groups, sanitised, compiled."""
    topic, outcome = F.concat("source", F.lit(" training")), F.concat("lang", F.lit(" scores"))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.concat(F.lit("How does "), topic, F.lit(" affect "), outcome, F.lit("?")).alias("question"), F.array(F.array(topic, F.lit("unrelated training radar")), F.array(outcome)).alias("draft"))
    made = protocol.concepts(asked)
    out = boolean_query.compile_bundle(made, ("question_id",), ("google_scholar",))
    return out.select("question_id", "version", "query")


@query(r"""WITH d AS (SELECT doc_id, 'What of ' || coalesce(source, '') || '?' AS q, doc_id % 3 > 0 AS framed, doc_id % 2 = 0 AS said, coalesce(lang, 'x') AS lang, coalesce(source, '') AS source,
    list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[;\n\x0b\x0c\r]'), lambda x: trim(x, ' -*' || chr(9))), lambda x: x <> '') AS inc, CASE WHEN trim(coalesce(source, ''), ' -*') <> '' THEN [trim(source, ' -*')] ELSE [] END AS exc FROM documents),
 c AS (SELECT *, CASE WHEN framed THEN 'The relation that the question asks for: "' || q || '"; all of (topic: "' || lang || '" OR "' || source || '")' ELSE 'drafted ' || source END AS core,
    CASE WHEN framed THEN list_concat(inc, exc) WHEN said THEN ['own ' || lang] ELSE [] END AS own FROM d)
SELECT doc_id AS run_id, len(own) + 1 AS n_criteria, sha256(array_to_string(list_concat([core], own), chr(10))) AS said_sha, NOT (framed OR (len(inc) = said::INT AND len(exc) = 0)) AS failed FROM c""")
def protocol_anchoring(spark, sf_dir):
    """A protocol a document: its text is the user's block of inclusion criteria, two thirds have a frame of the question."""
    i, blank = F.col("doc_id"), F.coalesce("source", F.lit(""))
    drafted = lambda id_, kind, said, source: F.struct(F.lit(id_).alias("id"), F.lit(kind).alias("kind"), said.alias("description"), F.lit(True).alias("required"), F.lit("").alias("expected_evidence"), F.lit(source).alias("source"))
    draft = [drafted("m", "inclusion", F.concat(F.lit("drafted "), blank), "model"), drafted("x", "exclusion", F.lit("widened"), "model")]
    lang = F.coalesce("lang", F.lit("x"))
    group = F.array(F.struct(F.lit("topic").alias("role"), F.lit(True).alias("required"), F.lit("AND").alias("relationship"), F.array(lang, blank).alias("spans")))
    runs = table(spark, sf_dir, "documents").select(
        i.alias("run_id"), F.concat(F.lit("What of "), blank, F.lit("?")).alias("question"), F.col("text").alias("inclusion"), blank.alias("exclusion"),
        F.when(i % 2 == 0, F.array(*draft, drafted("u", "inclusion", F.concat(F.lit("own "), lang), "user"))).otherwise(F.array(*draft)).alias("criteria"), F.when(i % 3 > 0, group).alias("groups"),
    )
    done = protocol.anchored_protocols(runs)
    said = F.array_join(F.transform("criteria", lambda c: c["description"]), "\n")
    return done.select("run_id", F.size("criteria").cast("long").alias("n_criteria"), V.sha256(said).alias("said_sha"), F.col("failure").isNotNull().alias("failed"))
