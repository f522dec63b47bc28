"""Flow counts, exports, samples, question parser, collectors."""

import os

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import values as V
from corpusmill.operators import audit, boolean_query, flow, gold
from corpusmill.operators.question import Parser, parse, term_source
from corpusmill.sources import ingest, sinks


def decided(spark, keep, maybe, reject, manual=0):
    rows = [("KEEP", "", "")] * keep + [("MAYBE", "", "")] * maybe + [("REJECT", "", " off ")] * (reject - manual) + [("REJECT", "manual_review", "")] * manual
    return spark.createDataFrame(rows, "Decision string, Decision_Source string, Exclusion_Reason string")


def test_flow_scenario(spark):
    plan = {"identified": 12, "duplicates": 2, "available": 10, "selected": 10}
    row = flow.snapshot(flow.decision_counts(decided(spark, 3, 2, 5)), plan)
    first = row.first()
    assert first["records_screened"] == 10 and first["equations_valid"] and first["status"] == "manual_review"
    assert row.select(flow.revision(row)).first()[0] == row.select(flow.revision(row)).first()[0]
    after = flow.snapshot(flow.decision_counts(decided(spark, 4, 0, 6, 1)), plan | {"finalized": True, "csv_match": True}).first()
    assert after["status"] == "title_abstract_complete" and after["excluded_by_manual_review"] == 1 and after["records_included_after_title_abstract"] == 4
    limited = flow.snapshot(flow.decision_counts(decided(spark, 1, 0, 2)), {"identified": 12, "duplicates": None, "available": 10, "selected": 4}).first()
    assert (limited["records_awaiting_screening"], limited["records_awaiting_current_run"], limited["records_deferred_by_limit"], limited["status"]) == (7, 1, 6, "screening")
    assert {r["reason"]: r["count"] for r in flow.exclusion_reasons(decided(spark, 0, 0, 3, 1)).collect()} == {"off": 2, "reason not classified": 1}
    assert {r["field"] for r in flow.manifest_rows(row).collect()} == set(row.columns)


def gold_run(spark):
    rows = [(str(271 + i), "KEEP" if i < 77 else "REJECT" if i < 93 else "MAYBE", f"=title {i}", "abstract", "p", "v") for i in range(100)]
    return spark.createDataFrame(rows, "Source_Row_Index string, Decision string, Title string, Abstract string, Protocol_ID string, Prompt_Version string")


def test_gold_numbers(spark):
    assert gold.allocate({"KEEP": 77, "REJECT": 16, "MAYBE": 7}, 60) == {"KEEP": 37, "REJECT": 16, "MAYBE": 7}
    run = gold_run(spark)
    header, manifest, labels = gold.create_sample(run, "job", "question")
    assert header["sample_size"] == 60 and labels.count() == 60
    assert gold.create_sample(run, "job", "question")[0]["set_id"] == header["set_id"]
    assert labels.first()["Title"].startswith("'=") and "Decision" not in labels.columns
    order = F.row_number().over(__import__("pyspark").sql.Window.partitionBy("model_decision").orderBy("Source_Row_Index"))
    truth = manifest.withColumn("n", order)
    # four KEEPs and all MAYBEs wrong, two REJECTs should have been kept
    human = F.when(F.col("model_decision") == "KEEP", F.when(F.col("n") <= 4, "REJECT").otherwise("KEEP")).when(F.col("model_decision") == "REJECT", F.when(F.col("n") <= 2, "KEEP").otherwise("REJECT")).otherwise(F.when(F.col("n") <= 3, "KEEP").otherwise("REJECT"))
    done = labels.drop("Gold_Decision").join(truth.select("Source_Row_Index", human.alias("Gold_Decision")), "Source_Row_Index")
    report = gold.evaluate(done, header, manifest, run, iterations=20)
    assert report["metrics"]["keep_precision"] == round(33 / 37, 4)
    assert report["metrics"]["false_reject_rate"] == round(2 / (33 * 77 / 37 + 2 + 3), 4)
    assert report["false_keeps"].count() == 4 and report["false_rejects"].count() == 2 and report["resolved"] == 60
    for r in report["intervals"].collect():
        assert r["lower"] <= r["upper"]
    bad = {
        "bound": labels.drop("Screening_Job_ID"), "belongs": labels.withColumn("Screening_Job_ID", F.lit("k")), "duplicate": labels.union(labels.limit(1)), "removed": labels.limit(59),
        "added": labels.withColumn("Source_Row_Index", F.when(F.col("Source_Row_Index") == labels.first()["Source_Row_Index"], "9999").otherwise(F.col("Source_Row_Index"))),
        "altered": labels.withColumn("Title", F.lit("x")), "invalid": labels.withColumn("Gold_Decision", F.lit("YES")), "missing": labels.drop("Abstract"), "Validation_Set_ID": labels.withColumn("Validation_Set_ID", F.lit("0" * 16)),
    }
    for word, frame in bad.items():
        with pytest.raises(gold.LabelError, match=word):
            gold.check_labels(frame, header, manifest, run)
    with pytest.raises(gold.LabelError, match="changed"):
        gold.check_labels(labels, header, manifest, run.withColumn("Title", F.lit("other")))


def test_export_pack(spark, tmp_path):
    rows = [("1", "KEEP", 'a, "b"\nc', "https://doi.org/10.1/ABC", "k"), ("2", "MAYBE", "t", "none", "k"), ("3", "REJECT", "u", "10.2/x", "k")]
    run = spark.createDataFrame(rows, "Source_Row_Index string, Decision string, Title string, `Article DOI` string, `API Key` string")
    root = str(tmp_path / "out")
    got = sinks.export_pack(run, root, "job-1", {"research_question": "q"})
    assert {k: got[k] for k in ("all", "keep", "maybe", "reject", "review_queue")} == {"all": 3, "keep": 1, "maybe": 1, "reject": 1, "review_queue": 1}
    assert {p.name for p in (tmp_path / "out" / "job-1").iterdir()} == {"screened_all.csv", "screened_keep.csv", "screened_maybe.csv", "screened_reject.csv", "screened_maybe_review_queue.csv", "screening_summary.json"}
    for name in ("keep", "maybe", "reject"):
        assert [r["Decision"] for r in ingest.read_csv(spark, f"{root}/job-1/screened_{name}.csv").collect()] == [name.upper()]
    queue = ingest.read_csv(spark, f"{root}/job-1/screened_maybe_review_queue.csv").first()
    assert queue["Review_Priority"] == "5" and queue["Decision"] == "MAYBE" and queue["Review_Reason"]
    back = ingest.read_csv(spark, f"{root}/job-1/screened_all.csv")
    assert {r["Decision"] for r in back.collect()} == {"KEEP", "MAYBE", "REJECT"}
    assert "API Key" not in back.columns and [r["Canonical_DOI"] for r in back.orderBy("Source_Row_Index").collect()] == ["10.1/ABC", "", "10.2/x"]
    assert back.columns[:2] == ["Title", "Article DOI"]
    path = str(tmp_path / "one.csv")
    first = sinks.write_csv_file(run.drop("API Key"), path, ["Source_Row_Index"])
    assert first == sinks.write_csv_file(run.drop("API Key"), path, ["Source_Row_Index"]) and open(path, "rb").read(3) == b"\xef\xbb\xbf"
    assert ingest.read_csv(spark, path).orderBy("Source_Row_Index").first()["Title"] == 'a, "b"\nc'
    assert sinks.write_once({"a": 1}, str(tmp_path / "m.json")) and not sinks.write_once({"a": 1}, str(tmp_path / "m.json"))
    with pytest.raises(ValueError):
        sinks.write_once({"a": 2}, str(tmp_path / "m.json"))
    with pytest.raises(ValueError):
        sinks.finalise_pack(run, str(tmp_path / "final"))
    assert sinks.finalise_pack(run.where("Decision <> 'MAYBE'"), str(tmp_path / "final")) == {"keep": 1, "reject": 1}
    back.write.partitionBy("Job_ID").parquet(str(tmp_path / "runs"))
    with pytest.raises(ValueError):
        ingest.read_run(spark, root, "../x")
    assert sinks.file_name(" a/b?.csv. ") == "a_b_.csv" and sinks.file_name("") == "citations.csv"


def test_csv_quality(spark, tmp_path):
    def inspect(body, n=None):
        p = tmp_path / f"{abs(hash((body, n)))}.csv"
        p.write_text(body, encoding="utf-8")
        return ingest.inspect_csv(spark, str(p), n)

    good = '﻿Authors,Title,Year\nA,"x\ny",2020\nB,z,\n'
    assert inspect(good, 2)["ok"] and inspect(good)["row_count"] == 2
    assert "does not match expected 3" in inspect(good, 3)["errors"][0]
    assert inspect("@article{x,\n}\n")["bibtex_like"] and inspect("")["errors"] == ["CSV body is empty"]
    assert not inspect("Authors,Title\nA,b\n")["ok"]
    wide = inspect("Authors,Title,Year\nA,b,1,9\nB,c\nC,d,2\n")
    assert wide["errors"] == ["2 CSV row(s) do not match the header column count"] and wide["row_count"] == 3


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("How does guided walking affect mood or sleep among nurses?", [("intervention_or_method", "guided walking"), ("outcome", "mood OR sleep"), ("population", "nurses")]),
        ("How does trial and error affect output?", [("intervention_or_method", "trial and error"), ("outcome", "output")]),
        ("What is the joint effect of heat and noise on focus?", [("intervention_or_method", "the joint effect of heat and noise"), ("outcome", "focus")]),
        ("How does solar drying improve shelf life, and cold storage reduce waste?", [("intervention_or_method", "solar drying"), ("outcome", "shelf life"), ("intervention_or_method", "cold storage"), ("outcome", "waste")]),
        ("How does tillage improve yield during 2020?", [("intervention_or_method", "tillage"), ("outcome", "yield"), ("other", "2020")]),
        ("In a scoping review of farming, how does tillage affect yield?", [("intervention_or_method", "tillage"), ("outcome", "yield"), ("domain", "farming")]),
        ("Among older adults, how does yoga versus tai chi influence balance?", [("intervention_or_method", "yoga"), ("comparison", "tai chi"), ("outcome", "balance"), ("population", "older adults")]),
        ("Hwo does yoga affect balance?", [("other", "Hwo does yoga affect balance")]),
        ("Yoga helps. Does it affect balance?", [("other", "Yoga helps. Does it affect balance")]),
        ("What is the impact of global positioning systems (GPS) on routing?", [("intervention_or_method", "global positioning systems"), ("outcome", "routing")]),
    ],
)
def test_questions(question, want):
    groups = parse(question)
    assert [(g.role, g.canonical) for g in groups] == want
    for g in groups:
        assert question[g.start : g.end] == g.text
        assert all(term_source(t, g) != "validated_model" for t in g.terms)


def test_question_bounds():
    with pytest.raises(ValueError):
        Parser("x" * 4001)
    with pytest.raises(ValueError):
        Parser(" ?! ")
    assert len(parse("How does a1 affect " + " and ".join(f"b{i}" for i in range(40)) + "?")[1].terms) == 8


def test_text_edges(spark):
    df = spark.createDataFrame([("   A B\tc ",), (None,), ("",)], "x string")
    got = [tuple(r) for r in df.select(T.norm_dedup("x"), T.has_value("x"), T.ustrip("x")).collect()]
    assert got == [("a b c", True, "A B\tc"), ("", False, None), ("", False, "")]
    units = spark.range(1).select(T.evidence_units(F.lit("  A title with spacing  "), F.lit("First sentence.  Second sentence!\nThird sentence?")).alias("u")).first()["u"]
    assert [(u["evidence_id"], u["text"]) for u in units] == [("title_001", "A title with spacing"), ("abstract_001", "First sentence."), ("abstract_002", "Second sentence!"), ("abstract_003", "Third sentence?")]
    row = spark.range(1).select(V.fnv1a(F.lit("a|")), V.progress_percent(F.lit(1), F.lit(0)), V.throttle_seconds(F.lit(None).cast("int")), V.remaining_seconds(F.lit(6.0), F.lit(0), F.lit(3)), V.json_field(F.lit("[1]"), "a")).first()
    h = 2166136261
    for ch in b"a|":
        h = (h ^ ch) * 16777619 % 2**32
    assert tuple(row) == (f"{h:08x}", 100, 60, None, "")


def test_collectors(spark):
    row = spark.range(1).select(ingest.reported_total(F.lit("About 9,61,000 results")), ingest.reported_total(F.lit("Page 41 of 405 results")), ingest.reported_total(F.lit("none")), ingest.shown_range(F.lit("Showing 1 of 1 result")), ingest.same_query(F.lit("https://x/y?queryText=%28a%20b%29"), "queryText", F.lit("a b"))).first()
    assert row[0] == 961000 and row[1] == 405 and row[2] is None and tuple(row[3]) == (1, 1, 1) and row[4]
    runs = spark.createDataFrame([("r", 2, ["a", "b"], ["B", "A"], {"a": "A", "b": "B"}, [], True, True, 2, 3), ("s", 0, [], [], {}, [], True, None, None, 3)], "run_id string, target int, saved array<string>, verified array<string>, library_ids map<string,string>, unresolved array<string>, audit_complete boolean, export_verified boolean, export_rows int, integrity_version int")
    assert [(r["labels_ok"], r["export_ok"]) for r in audit.integrity(runs).orderBy("run_id").collect()] == [(True, True), (True, True)]
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    assert audit.set_equal(a, a.union(a), "k") and not audit.set_equal(a, a.limit(1), "k")


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["csv_round_trip", "merge_files", "json_documents", "export_pack", "validation_labels", "question_forms", "rubric_rules", "bisect_retry", "stream_screen", "criteria_screen", "cascade_screen", "query_generation", "collection_integrity", "best_overlap_match", "manual_overrides", "dedup_group_counts", "boolean_compile", "merge_truth_table", "interval_match", "bootstrap_ci", "batch_validation", "bootstrap_ci_whole", "failure_levels", "exact_evidence", "ordered_fingerprint", "protocol_anchoring", "platform_queries", "proposal_checks", "distinct_lines", "run_refusals", "header_fields"])
def test_sql_agrees(spark, name):
    import duckdb

    from corpusmill.plans import checks, runs  # noqa: F401  they register their queries
    from corpusmill.plans.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "events", "conversations", "customer", "supplier"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours = QUERIES[name](spark, sf)
    theirs = con.execute(SQL[name])
    columns = [c[0] for c in theirs.description]
    order = sorted(columns)
    rows = lambda it, cols: sorted(str([r[cols.index(c)] for c in order]) for r in it)
    assert sorted(ours.columns) == order
    assert rows([tuple(r) for r in ours.collect()], ours.columns) == rows(theirs.fetchall(), columns)


def test_bootstrap_runs_all_resamples(spark):
    import hashlib

    import numpy as np

    from corpusmill.plans.queries import _judged

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no driver tables")
    strata = {}
    for r in sorted(_judged(spark, sf).collect(), key=lambda r: r["row_id"]):
        strata.setdefault(r["model_decision"], []).append((r["human_decision"], r["model_decision"], r["w"]))
    values = []
    for it in range(2000):
        draw = [rows[int(hashlib.sha256(f"seed:{it}:{d}:{k}".encode()).hexdigest()[:8], 16) % len(rows)] for d, rows in strata.items() for k in range(len(rows))]
        weight = lambda f, draw=draw: sum(w for h, m, w in draw if f(h, m))
        keep, said = weight(lambda h, m: h == "KEEP"), weight(lambda h, m: m == "KEEP")
        values.append((weight(lambda h, m: h == "KEEP" and m != "REJECT") / keep, weight(lambda h, m: h == "KEEP" and m == "REJECT") / keep, weight(lambda h, m: h == m == "KEEP") / said))
    low, high = np.percentile(np.array(values), [2.5, 97.5], axis=0)
    got = {r["metric"]: (r["lower"], r["upper"]) for r in gold.bootstrap(_judged(spark, sf), "seed").collect()}
    for k, name in enumerate(("recall", "false_reject_rate", "keep_precision")):
        assert got[name] == pytest.approx((low[k], high[k]), abs=1e-4)


def test_bootstrap_of_all_rows(spark):
    """Whole intervals against a loop over rows, and close to those of resamples of a fixed size."""
    import bisect
    import hashlib

    import numpy as np

    rows = [(i, d, "KEEP" if (i * 7919) % 100 < share else "REJECT", w) for i, (d, share, w) in enumerate([("KEEP", 80, 2.0)] * 300 + [("MAYBE", 40, 1.0)] * 150 + [("REJECT", 5, 1.5)] * 250)]
    records = spark.createDataFrame(rows, "row_id long, model_decision string, human_decision string, w double")
    got = {r["metric"]: (r["lower"], r["upper"]) for r in gold.bootstrap_whole(records.repartition(3), "s", 300).collect()}
    values = []
    for it in range(300):
        sums = {d: [0, 0, 0.0, 0.0] for d in gold.STRATA}
        for i, d, human, w in rows:
            h = hashlib.sha256(f"s:{i}".encode()).hexdigest()
            x = (int(h[:8], 16) % gold.PRIME + it * (int(h[8:16], 16) % (gold.PRIME - 1) + 1)) % gold.PRIME
            n = bisect.bisect_right(gold.POISSON, pow(x, 5, gold.PRIME))
            for k, v in enumerate((1, n, n * w, n * w * (human == "KEEP"))):
                sums[d][k] += v
        kept = {d: v[0] / v[1] * v[3] for d, v in sums.items()}
        values.append(((kept["KEEP"] + kept["MAYBE"]) / sum(kept.values()), kept["REJECT"] / sum(kept.values()), sums["KEEP"][3] / sums["KEEP"][2]))
    low, high = np.percentile(np.array(values), [2.5, 97.5], axis=0)
    fixed = {r["metric"]: (r["lower"], r["upper"]) for r in gold.bootstrap(records, "s", 300).collect()}
    for k, name in enumerate(("recall", "false_reject_rate", "keep_precision")):
        assert got[name] == pytest.approx((low[k], high[k]), abs=1e-4)
        assert got[name] == pytest.approx(fixed[name], abs=0.025)
    assert gold.bootstrap_whole(records.limit(0), "s", 10).where("lower is not null").count() == 0


def test_short_quotes_are_evidence(spark, tmp_path):
    from corpusmill.plans.queries import QUERIES

    texts = [(0, "the unbroken line"), (1, "a broken line, then"), (2, "x"), (3, None)]
    quotes = [(1, "broken"), (2, "broken line"), (3, "line, then"), (4, "a broken line, then"), (5, "absent"), (6, '"broken"')]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = sorted((r["doc_id"], r["item_id"]) for r in QUERIES["exact_evidence"](spark, str(tmp_path)).collect())
    assert out == [(d, i) for d, t in texts for i, q in quotes if t and q.strip('"') in t]


def test_workbooks(spark, tmp_path):
    pd = pytest.importorskip("pandas")
    path = str(tmp_path / "x.xlsx")
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        open(path, "wb").write(b"PK")
        with pytest.raises(RuntimeError, match="optional"):
            ingest.read_excel(spark, path)
        return
    pd.DataFrame({"Title": ["a"], "Cited by": ["0"]}).to_excel(path, index=False)
    assert ingest.read_excel(spark, path).first()["Cited by"] == "0"


def test_json_documents(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"a": 1, "b": {"c": "x"}}')
    schema = "a int, b struct<c:string>"
    assert ingest.read_json_document(spark, str(path), schema).first()["b"]["c"] == "x"
    path.write_text("{broken")
    assert ingest.read_json_document(spark, str(path), schema).first()["a"] is None
    assert ingest.read_json_document(spark, str(tmp_path / "none.json"), schema).first()["a"] is None


def test_questions_of_any_words():
    import random

    from corpusmill.operators.question import RELATIONS, VERBS

    words = [*VERBS, *sorted(RELATIONS), *"how does what is the effect of alpha betas and or , ( ) ? . versus compared used GPS Global Positioning Systems combined 2020 review".split()]
    rng = random.Random(1)
    for k in range(3000):
        q = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 16)))
        q = f"How does {q}?" if k % 2 else q
        try:
            groups = parse(q)
        except ValueError:
            continue
        assert all(q[g.start : g.end] == g.text and g.components and g.terms for g in groups)


def test_best_overlap_in_blocks(spark, monkeypatch):
    from corpusmill.operators import boolean_query

    words = ["the", "of", *(f"w{i}" for i in range(30))]
    drafts = spark.createDataFrame([(i, [" ".join(words[(i * k) % 32] for k in range(1, 6))]) for i in range(50)] + [(90, ["zzz"]), (91, [])], "draft_id long, terms array<string>")
    groups = spark.createDataFrame([(i, ["the of", " ".join(words[(i * 7 + k) % 32] for k in range(4))]) for i in range(40)], "group_id long, terms array<string>")
    whole = sorted(map(tuple, boolean_query.best_overlap(drafts, groups).collect()))
    monkeypatch.setattr(boolean_query, "MAX_INDEX", 50)
    assert sorted(map(tuple, boolean_query.best_overlap(drafts, groups).collect())) == whole and whole[-2:] == [(90, None, 0), (91, None, 0)]


def test_ordered_fingerprints(spark):
    rows = [(i, f"text {i % 40}") for i in range(500)]
    whole = spark.createDataFrame(rows, "k long, t string")
    said = gold.ordered_fingerprint(whole, ["k"])
    assert said.startswith("500:")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert gold.ordered_fingerprint(whole.repartition(7, "t"), ["k"]) == said
        swapped = [(i, rows[{3: 4, 4: 3}.get(i, i)][1]) for i in range(500)]
        assert gold.ordered_fingerprint(spark.createDataFrame(swapped, "k long, t string"), ["k"]) != said
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert gold.ordered_fingerprint(whole.limit(0), ["k"]) == "0:0:0"


def test_terms_are_cleaned_once_for_all_platforms(spark):
    """A term's patterns stand once in the plan of a version, not once a platform and a use, nor once a pair of terms."""
    concepts = spark.range(1).selectExpr("array(named_struct('label', 'a', 'balanced_terms', array('b_c', 'b c', 'bc'), 'high_recall_terms', array('city', 'Cities', 'b', 'bs', 'b'))) as concepts")
    bundle = boolean_query.compile_bundle(concepts)
    assert bundle._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 6
    got = {(r["version"], r["platform"]): r["query"] for r in bundle.collect()}
    assert len(got) == 10 and got["balanced", "google_scholar"] == '("b c" OR "bc")' and got["high_recall", "pubmed"] == "(cit*[tiab] OR b*[tiab])"
    assert got["high_recall", "google_scholar"] == '("city" OR "Cities" OR "b" OR "bs")'


def test_run_fingerprint_deals_rows_by_their_own_keys(spark, monkeypatch):
    """The rows of a decision are not dealt to one task to show that order does not count."""
    import __spark_entry__

    plans, whole = [], gold.content_fingerprint
    monkeypatch.setattr(gold, "content_fingerprint", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df))
    row = __spark_entry__.queries()["run_fingerprint"](spark, "/root/testdata/sf0.001").first()
    assert row["free_of_order"] and row["free_of_job"] and row["sees_change"]
    dealt = [p.splitlines()[0] for p in plans if p.startswith("Repartition")]
    assert len(dealt) == 1 and "Source_Row_Index" in dealt[0] and "Decision" not in dealt[0]
