"""Validity, merging, quotes, routing, resume, overrides."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import assessment as A
from corpusmill.operators import review, screening
from corpusmill.operators.adapters import RuleAdapter, answer_with_retry, batches_of, settled

GOOD = {"decision": "KEEP", "model_decision": "KEEP", "confidence": 0.9, "reason": "r", "evidence_quote": "q", "valid": True, "structural_valid": True, "semantic_valid": True, "evidence_valid": True, "technical_failure": False, "failure_class": "", "risk_flags": [], "validation_warnings": [], "evidence_source": "title"}


def of(decision="KEEP", **change):
    return json.dumps(GOOD | {"decision": decision, "model_decision": decision} | change)


def merge(spark, p, v):
    df = spark.createDataFrame([(p, v)], "p string, v string").select(F.from_json("p", A.ASSESSMENT).alias("p"), F.from_json("v", A.ASSESSMENT).alias("v"))
    r = df.select(A.merge_decisions(F.col("p"), F.col("v")).alias("m")).first()["m"]
    return r["decision"], r["confidence"], r["agreement"]


@pytest.mark.parametrize(
    ("p", "v", "want"),
    [
        (of(failure_class="missing_abstract"), None, ("MAYBE", 0.0, "missing_abstract")),
        (of(structural_valid=False), of(), ("MAYBE", 0.0, "primary_validation_failed")),
        (of(semantic_valid=False), of(), ("MAYBE", 0.0, "primary_semantic_contradiction")),
        (of(), None, ("MAYBE", 0.0, "verification_unfinished")),
        (of("REJECT"), None, ("REJECT", 0.9, "not_required")),
        (of("REJECT", confidence=0.7), None, ("MAYBE", 0.0, "verification_unfinished")),
        (of(), of(technical_failure=True), ("MAYBE", 0.0, "verification_failed")),
        (of("MAYBE"), of("REJECT"), ("MAYBE", 0.0, "disagreement")),
        (of("MAYBE"), of("MAYBE", confidence=0.6), ("MAYBE", 0.6, "both_maybe")),
        (of(), of("REJECT"), ("MAYBE", 0.0, "disagreement")),
        (of(), of(confidence=0.8), ("KEEP", 0.8, "agreement")),
        (of(evidence_valid=False), of(), ("KEEP", 0.9, "agreement_recovered_by_verifier_evidence")),
        (of(), of(evidence_valid=False), ("MAYBE", 0.0, "verification_failed")),
        # old checkpoints have no flags: absent is not false
        (json.dumps({"decision": "REJECT", "confidence": 0.9, "valid": True}), None, ("REJECT", 0.9, "not_required")),
        (json.dumps({"decision": "KEEP", "valid": False, "failure_class": "x"}), None, ("MAYBE", 0.0, "primary_validation_failed")),
    ],
)
def test_merge_table(spark, p, v, want):
    assert merge(spark, p, v) == want


@pytest.mark.parametrize(
    ("quote", "want"),
    [
        ("", (False, "none", "empty_evidence_quote")), ("“”", (False, "none", "empty_evidence_quote")), ("a…", (False, "none", "ellipsis_not_allowed")), ("'A title'", (True, "title", "")),
        ("a title", (False, "none", "quote_not_found_in_source")), ("exact part", (True, "abstract", "")),
    ],
)
def test_quotes(spark, quote, want):
    df = spark.createDataFrame([(quote,)], "q string")
    assert tuple(df.select(A.check_quote("q", F.lit("A title"), F.lit("an exact part"))["valid"], A.check_quote("q", F.lit("A title"), F.lit("an exact part"))["source"], A.check_quote("q", F.lit("A title"), F.lit("an exact part"))["failure"]).first()) == want


def test_retry_halves_and_gives_up():
    adapter = RuleAdapter(("good",), break_on="bad")
    papers = [{"paper_id": str(i), "title": "bad" if i == 2 else "good", "abstract": "x"} for i in range(5)]
    out = answer_with_retry(adapter, papers, settled)
    assert sorted(i for ids, _ in out for i in ids) == ["0", "1", "2", "3", "4"]
    assert [ids for ids, raw in out if not raw] == [["2"]]
    assert [len(b) for b in batches_of(papers, 2, 1000)] == [2, 2, 1]
    assert [len(b) for b in batches_of(papers, 4, 1)] == [1] * 5


def test_resume_and_stream(spark, tmp_path):
    from corpusmill.streaming.incremental import Progress, results, screen_batch, screen_stream, single_job

    rows = [(str(i), f"good title {i}" if i % 2 else f"title {i}", "abstract" if i else "") for i in range(6)]
    papers = spark.createDataFrame(rows, "paper_id string, title string, abstract string")
    calls = []

    one, two = RuleAdapter(("good",)), RuleAdapter(("good",))
    root = str(tmp_path / "runs")
    assert screen_batch(papers.limit(3), root, "x", one, two) == 3
    assert screen_batch(papers, root, "x", one, two) == 3
    assert screen_batch(papers, root, "x", one, two) == 0
    batch = {r["paper_id"]: r["Decision"] for r in results(spark, root, "x").collect()}
    source = str(tmp_path / "in")
    papers.write.parquet(source)
    stream = spark.readStream.schema(papers.schema).parquet(source)
    listener = Progress()
    spark.streams.addListener(listener)
    with single_job(), pytest.raises(RuntimeError):
        with single_job():
            calls.append("never")
    q = screen_stream(stream, root, "y", one, two, str(tmp_path / "cp"))
    q.awaitTermination()
    spark.streams.removeListener(listener)
    streamed = {r["paper_id"]: r["Decision"] for r in results(spark, root, "y").collect()}
    assert streamed == batch and len(batch) == 6 and not calls
    assert batch["0"] == "MAYBE" and batch["1"] == "KEEP" and batch["2"] == "MAYBE"


def test_stream_state(spark, tmp_path, monkeypatch):
    """A run that dies after writing a batch loses and repeats nothing; batches read their own rows and the last results."""
    from corpusmill.streaming import incremental as inc

    source, root, model = str(tmp_path / "in"), str(tmp_path / "runs"), RuleAdapter(("good",))
    early = spark.createDataFrame([("0", "title 0", "abstract"), (None, "no id", "abstract")], inc.PAPER)
    assert inc.results(spark, root, "x") is None and inc.screen_batch(early, root, "x", model, model) == 1
    for k in range(4):  # each file holds ten new papers, one with two texts, and one of the file before
        rows = [(str(i), f"good title {i}", "abstract") for i in range(10 * k - (k > 0), 10 * k + 10)] + [(str(10 * k + 5), "a title", None), (None, "x", "y")]
        spark.createDataFrame(rows, inc.PAPER).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(inc.PAPER).option("maxFilesPerTrigger", 1).parquet(source)
    whole, runs = inc.two_stage, []

    class Dies:
        def __init__(self, out):
            self.write = self
            self.out = out

        def mode(self, how):
            return self

        def parquet(self, path):
            self.out.write.mode("overwrite").parquet(path)
            runs.append(path)
            if len(runs) == 2:
                raise RuntimeError("died after writing")

    monkeypatch.setattr(inc, "two_stage", lambda *a, **k: Dies(whole(*a, **k)))
    with pytest.raises(Exception, match="died after writing"):
        inc.screen_stream(stream(), root, "x", model, model, str(tmp_path / "cp")).awaitTermination()
    q = inc.screen_stream(stream(), root, "x", model, model, str(tmp_path / "cp"))
    q.awaitTermination()
    assert runs[1] == runs[2] and len(runs) == 5  # the batch that died was written anew, in its folder
    out = inc.results(spark, root, "x").collect()
    assert sorted(int(r["paper_id"]) for r in out) == list(range(40))
    got = {r["paper_id"]: r["Decision"] for r in out}
    assert got["0"] == got["5"] == got["35"] == "MAYBE" and got["9"] == got["39"] == "KEEP"  # 0 as settled before, 5 by its least text
    assert max(p["numInputRows"] for p in q.recentProgress) <= 13 + 11  # a file, and what the batch before has settled
    q = inc.screen_stream(stream(), root, "x", model, model, str(tmp_path / "other"))  # knows of the results only
    q.awaitTermination()
    assert len(runs) == 5 and inc.results(spark, root, "x").count() == 40


def test_stream_keeps_ids_natively(spark, tmp_path):
    """Spark keeps the state without a call to Python a paper; of the texts of a batch the least one counts, nulls first."""
    from corpusmill.streaming import incremental as inc

    source, root = str(tmp_path / "in"), str(tmp_path / "runs")
    settled = spark.createDataFrame([("s", "t", "a")], inc.PAPER)
    assert inc.screen_batch(settled, root, "x", RuleAdapter(("good",)), RuleAdapter(("good",))) == 1
    rows = [("a", "b", "x"), ("a", "B", "z"), ("a", "B", "y"), ("n", "", ""), ("n", None, "z"), ("m", "t", "a"), ("m", "t", None), ("s", None, None), (None, None, "x"), ("u", "\U0001f600", "x"), ("u", "\uffee", "x")]
    spark.createDataFrame(rows, inc.PAPER).coalesce(1).write.parquet(source)
    spark.createDataFrame([("a", "A", None), ("new", "t", "a")], inc.PAPER).coalesce(1).write.mode("append").parquet(source)
    for k, f in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)):
        os.utime(f, (10 * k + 10, 10 * k + 10))
    seen = []
    stream = spark.readStream.schema(inc.PAPER).option("maxFilesPerTrigger", 1).parquet(source)
    key, provider = inc.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        q = inc.unsettled(stream, f"{root}/identity=x").writeStream.foreachBatch(lambda batch, n: seen.append({tuple(r) for r in batch.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
    assert seen == [{("a", "B", "y"), ("n", None, "z"), ("m", "t", None), ("u", "\uffee", "x")}, {("new", "t", "a")}]
    assert {s["operatorName"] for p in q.recentProgress for s in p["stateOperators"]} == {"dedupe"}


def test_blanks_take_time_in_proportion(spark):
    """Stripping a long run of spaces inside a text took the square of its length."""
    import time

    from corpusmill.functions.text import has_value, ustrip

    ends = [" ", "\n", "\u2028", "\u3000", ""]
    rows = [(f"{a}x{b}y{c}", f"x{b}y") for a in ends for b in ends for c in ends]
    rows += [("a" + " " * 150_000 + "b\n", "a" + " " * 150_000 + "b"), (" " * 150_000, ""), ("\r\n", ""), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, bare string")
    began = time.monotonic()
    got = df.select(ustrip("t").alias("s"), "bare", has_value("t").alias("v")).collect()
    assert all(r["s"] == r["bare"] and r["v"] == bool(r["bare"]) for r in got)
    assert time.monotonic() - began < 10


def test_overrides_and_guard(spark):
    run = spark.createDataFrame([("1", "MAYBE", "j"), ("2", "KEEP", "j"), ("3", "MAYBE", "j")], "Source_Row_Index string, Decision string, Job_ID string")
    over = spark.createDataFrame([("1", "keep", "first", 1), ("1", "reject", "off", 2), ("1", "perhaps", "", 3), ("2", "reject", "", 1), ("3", "perhaps", "", 1)], "row_id string, decision string, reason string, place int")
    out = {r["Source_Row_Index"]: (r["Decision"], r["override_status"], r["Exclusion_Reason"]) for r in review.apply_overrides(run, over).collect()}
    assert out == {"1": ("REJECT", "applied", "off"), "2": ("KEEP", "not_maybe", ""), "3": ("MAYBE", "invalid_decision", "")}
    review.guard(run, "j")
    for bad in (run.limit(0), run.withColumn("Decision", F.lit("YES")), run.union(run), run.withColumn("Job_ID", F.lit("k")), run.withColumn("Validation_Status", F.lit("safe_fallback")), run.drop("Decision"), run.withColumn("Protocol_ID", F.col("Source_Row_Index"))):
        with pytest.raises(review.ExportError):
            review.guard(bad, "j")


def test_checkpoint_predicates(spark):
    cols = "Protocol_ID string, Validation_Status string, Decision string, Failure_Class string, Review_Pending string, Primary_Decision string"
    rows = [("p", "validated", "KEEP", "", "", ""), ("p", "validated", "MAYBE", None, "true", "MAYBE"), ("q", "validated", "KEEP", "", "", ""), ("p", "technical_failure", "MAYBE", "x", "", ""), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, cols)
    got = [tuple(r) for r in df.select(F.coalesce(A.reusable_local("p"), F.lit(False)), A.restorable_local("p")).collect()]
    assert got == [(True, True), (False, True), (False, False), (False, False), (False, False)]
    cols = "Route_Used string, Execution_Origin string, Validation_Status string, Failure_Class string, Decision string, Final_Evidence_Source string, Evidence_Quote string, p string, v string"
    rows = [("missing_abstract",) + (None,) * 8, ("m", "model", "validated", "", "KEEP", "primary", "q", of(), of()), ("m", "model", "validated", "", "KEEP", "primary", "q", of(), None), ("m", "model", "validated", "", "REJECT", "none", "", of("REJECT"), None)]
    df = spark.createDataFrame(rows, cols).withColumn("p", F.from_json("p", A.ASSESSMENT)).withColumn("v", F.from_json("v", A.ASSESSMENT))
    assert [r[0] for r in df.select(A.reusable_web(F.col("p"), F.col("v"))).collect()] == [True, True, False, False]


def test_latency_and_population(spark):
    calls = spark.createDataFrame([("a", 8.0, 4), ("a", 1.0, 0)], "paper_id string, wall_seconds double, batch_size int")
    assert screening.stage_latency(calls).first()["seconds"] == 3.0
    rows = spark.createDataFrame([(1, "t"), (2, " "), (3, "u")], "row_id long, Title string")
    assert screening.population(rows, "web").count() == 2 and screening.population(rows).count() == 3
    assert [r["row_id"] for r in screening.population(rows, limit=2).collect()] == [1, 2]
    assert screening.protocol_id("a", "", "", "") != screening.protocol_id("b", "", "", "")
    assert screening.may_finalise(spark.createDataFrame([("KEEP",)], "Decision string"))


def test_readings_stay_beside_their_papers(spark):
    """Each row is read by its own text, though an id comes twice, and no layer shuffles a text."""
    rows = [("a", "keep it", "the the "), ("a", "drop it", "license"), ("b", "none", ""), (None, "no id", "the "), ("c", "x", "the ")]
    papers = spark.createDataFrame(rows, "paper_id string, title string, abstract string").repartition(1)
    keep, bar = RuleAdapter(("the ",), ("license",)), RuleAdapter((), ("license",))
    got = screening.assess(papers, keep).select("paper_id", "assessment.decision", "assessment.failure_class").collect()
    assert sorted(map(tuple, got), key=str) == [("a", "KEEP", ""), ("a", "REJECT", ""), ("b", "MAYBE", "missing_abstract"), ("c", "KEEP", ""), (None, "MAYBE", "local_inference_failure")]
    both = [(r["paper_id"], r["Primary_Decision"], r["Verifier_Decision"]) for r in screening.two_stage(papers, keep, bar).collect()]
    assert sorted(both, key=str) == [("a", "KEEP", "MAYBE"), ("a", "REJECT", ""), ("b", "MAYBE", ""), ("c", "KEEP", "MAYBE"), (None, "MAYBE", "")]
    first = screening._read(screening._known(spark.range(9).selectExpr("id as paper_id", "'t' as title", "'the ' as abstract")), "p", keep)
    second = screening._read(first, "v", bar, A.requires_verification(F.col("p")))
    assert "Exchange" not in second._jdf.queryExecution().executedPlan().toString() and second.where("v is not null").count() == 9
