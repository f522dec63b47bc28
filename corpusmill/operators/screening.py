"""Screening runs: who is screened, what is resumed, both reading stages, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import has_value, strip_quotes_once, stripped, text
from corpusmill.functions.values import identity, unfence
from corpusmill.operators.adapters import READING, ModelAdapter, reading_udf, screening_udf
from corpusmill.operators.assessment import ASSESSMENT, ITEM, after_critic, check_bare_quote, final_evidence, final_status, merge_decisions, model_decision, needs_critic, needs_deep, repair_quote, requires_verification, validate_batch
from corpusmill.operators.frames import persisted

ITEMS = "items array<struct<paper_id:string,decision:string,confidence:double,reason:string,evidence_quote:string,risk_flags:array<string>>>"


def protocol_id(question: str, context: str, inclusion: str, exclusion: str, **versions: str) -> str:
    """Identity of a run's inputs: the same ones resume the same checkpoint."""
    return identity({"question": question, "context": context, "inclusion": inclusion, "exclusion": exclusion} | versions)


def population(df: DataFrame, engine: str = "local", limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows to screen: all (local) or those with a title (web); a limit takes the first in ``order``."""
    rows = df if engine == "local" else df.where(has_value("Title"))
    if limit is None:
        return rows
    return rows.orderBy(*(order or [F.col("row_id")])).limit(limit)


def pending(rows: DataFrame, checkpoint: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that no reusable checkpoint row settles."""
    return rows.join(checkpoint.select(key).distinct(), key, "left_anti")


def resumed(rows: DataFrame, checkpoint: DataFrame, key: str = "row_id") -> DataFrame:
    """Checkpoint rows that are still selected."""
    return checkpoint.join(rows.select(key).distinct(), key, "left_semi")


def stage_order(decision: Column) -> Column:
    """Second readings in order of risk: REJECT, MAYBE, KEEP."""
    return F.when(decision == "REJECT", 0).when(decision == "MAYBE", 1).otherwise(2)


def _known(papers: DataFrame) -> DataFrame:
    return papers.select(F.col("paper_id").cast("string").alias("paper_id"), text("title").alias("title"), text("abstract").alias("abstract"))


def _read(rows: DataFrame, name: str, adapter: ModelAdapter, need: Column | None = None, **options) -> DataFrame:
    """``rows`` (paper_id, title, abstract, earlier assessments) and the assessment ``name``, null where ``need`` does not hold.

    Texts go through the reading beside their answers, with what earlier readings said
    as one string, so nothing is shuffled.
    """
    earlier = [c for c in rows.columns if c not in ("paper_id", "title", "abstract")]
    held = rows.select(*earlier).schema
    wanted = F.lit(True) if need is None else F.coalesce(need, F.lit(False))
    sent = rows.withColumn("wanted", wanted).select("paper_id", "title", "abstract", (F.to_json(F.struct(*earlier)) if earlier else F.lit("")).alias("held"), "wanted", (F.col("wanted") & has_value("abstract") & F.col("paper_id").isNotNull()).alias("asked"))
    bare = F.when(F.col("raw").contains("```"), F.regexp_replace("raw", r"(?is)^\s*```(?:json)?\s*|\s*```\s*$", "")).otherwise(F.col("raw"))
    answered = sent.mapInPandas(reading_udf(adapter, **options), READING).withColumn("items", F.from_json(bare, ITEMS)["items"])  # an answer is parsed once
    papers = answered.select("items", F.explode(F.arrays_zip("paper_id", "title", "abstract", "held", "wanted")).alias("x")).select("items", "x.*")
    before = papers.select("*", F.from_json("held", held).alias("h")).drop("held") if earlier else papers.drop("held")
    one = before.withColumn("i", F.get(F.filter("items", lambda i: i["paper_id"] == F.col("paper_id")), F.lit(0)))
    # columns of their own, so that a quote is cleaned and searched once
    one = one.withColumn("said", strip_quotes_once(F.col("i.evidence_quote"))).withColumn("quote", check_bare_quote(F.col("said"), F.col("title"), F.col("abstract")))
    return one.select("paper_id", "title", "abstract", *[F.col("h")[c].alias(c) for c in earlier], F.when(F.col("wanted"), _assessment()).alias(name))


def _assessment() -> Column:
    """What an answer's item ``i``, whose ``quote`` was checked, says of a paper (title, abstract)."""
    sound = F.col("i.decision").isin("KEEP", "MAYBE", "REJECT") & F.col("i.confidence").between(0, 1)
    quote, definitive = F.col("quote"), F.col("i.decision").isin("KEEP", "REJECT")
    none = F.array().cast("array<string>")

    def technical(reason: str, failure: str) -> Column:
        return F.struct(F.lit("MAYBE"), F.lit(""), F.lit(0.0), F.lit(reason), F.lit(""), F.lit(False), F.lit(False), F.lit(False), F.lit(False), F.lit(True), F.lit(failure), none, none, F.lit("none")).cast(ASSESSMENT)

    proven = ~definitive | quote["valid"]
    flags = F.coalesce("i.risk_flags", none)
    ok = F.struct(F.col("i.decision"), F.col("i.decision"), F.col("i.confidence"), text("i.reason"), text("i.evidence_quote"), proven, F.lit(True), F.lit(True), proven, F.lit(False), F.lit(""), flags, none, quote["source"]).cast(ASSESSMENT)
    return F.when(~has_value("abstract"), technical("The abstract is missing.", "missing_abstract")).when(F.coalesce(sound, F.lit(False)), ok).otherwise(technical("No usable answer.", "local_inference_failure"))


def assess(papers: DataFrame, adapter: ModelAdapter, **options) -> DataFrame:
    """paper_id, assessment of every paper (paper_id, title, abstract); evidence is checked, not trusted.

    Assessments are written once, since a model need not answer the same twice.
    Unanswered papers and those without an id get a technical MAYBE, and papers without
    an abstract one that says so, without a call.
    """
    return persisted(_read(_known(papers), "assessment", adapter, **options).select("paper_id", "assessment"))


def assess_by_criteria(papers: DataFrame, adapter: ModelAdapter, rubric: dict, **options) -> DataFrame:
    """paper_id, assessment and validation_status of every paper, judged by the criteria of ``rubric``.

    Answers go through :func:`validate_batch`, each with the papers that it settled;
    what no valid answer settles is a technical MAYBE that names its failure.
    """
    known = papers.select(F.col("paper_id").cast("string"), text("title").alias("title"), text("abstract").alias("abstract"))
    raw = persisted(known.where(has_value("abstract")).mapInPandas(screening_udf(adapter, **options), "ids array<string>, raw string").withColumn("batch_id", F.monotonically_increasing_id()))
    asked = raw.select("batch_id", F.explode("ids").alias("paper_id")).join(known, "paper_id")
    # an answer may also speak of papers that it did not settle
    items = F.filter(F.from_json(unfence("raw"), f"items array<{ITEM}>")["items"], lambda i: F.array_contains("ids", i["paper_id"]))
    own = F.when(items.isNull(), F.col("raw")).otherwise(F.to_json(F.struct(items.alias("items"))))
    judged = validate_batch(raw.select("batch_id", own.alias("raw")), asked, rubric)
    joined = known.select("paper_id").join(judged.select("paper_id", "assessment", "validation_status", "failure"), "paper_id", "left")
    failure = F.coalesce(F.when(F.col("failure") != "", F.col("failure")), F.lit("no_answer"))
    settled = F.col("assessment").isNotNull()
    return joined.select("paper_id", F.when(settled, F.col("assessment.decision")).otherwise("MAYBE").alias("Decision"), F.coalesce("assessment.confidence", F.lit(0.0)).alias("Confidence"), F.when(settled, F.col("validation_status")).otherwise("technical_failure").alias("Validation_Status"), F.when(settled, "").otherwise(failure).alias("Failure_Class"), F.coalesce("assessment.risk_flags", F.array().cast("array<string>")).alias("Risk_Flags"))


def risk(assessment: Column) -> Column:
    """Risk of a reading by its confidence."""
    c = assessment["confidence"]
    return F.when(c >= 0.9, "LOW").when(c >= 0.7, "BORDERLINE").otherwise("HIGH")


def cascade(papers: DataFrame, triage: ModelAdapter, deep: ModelAdapter, critic: ModelAdapter, **options) -> DataFrame:
    """paper_id, Decision, Decision_Layer, Validation_Status and Layer_Trace of three layers.

    All papers are triaged. Uncertain, risky or rejecting ones are read in full, and
    what is still uncertain goes to a critic, who never replaces a valid deep reading
    by an invalid one. The layers follow each other where a paper lies, and what they
    said is written once.
    """
    validated = lambda c: F.coalesce(c["valid"] & ~c["technical_failure"], F.lit(False))
    t, d = F.col("t"), F.col("d")
    first = _read(_known(papers), "t", triage, **options)
    second = _read(first, "d", deep, needs_deep(t["decision"], risk(t), validated(t)), **options)
    third = _read(second, "c", critic, d.isNotNull() & needs_critic(d["decision"], risk(d), validated(d)), **options)
    both = persisted(third.select("paper_id", "t", "d", "c"))
    c = F.col("c")
    judged = F.when(d.isNull(), t["decision"]).when(c.isNull(), d["decision"]).otherwise(after_critic(c["decision"], validated(c), d["decision"], validated(d)))
    layer = F.when(d.isNull(), "triage").when(c.isNull() | (~validated(c) & validated(d)), "deep").otherwise("critic")
    sound = F.when(d.isNull(), validated(t)).when(layer == "deep", validated(d)).otherwise(validated(c))
    steps = F.filter(F.array(*[F.when(x.isNotNull(), F.struct(F.lit(n).alias("layer"), x["decision"].alias("decision"), x["confidence"].alias("confidence"))) for n, x in (("triage", t), ("deep", d), ("critic", c))]), lambda x: x.isNotNull())
    return both.select("paper_id", F.when(sound, judged).otherwise("MAYBE").alias("Decision"), layer.alias("Decision_Layer"), F.when(sound, "validated").otherwise("technical_failure").alias("Validation_Status"), steps.alias("Layer_Trace"))


def two_stage(papers: DataFrame, primary: ModelAdapter, verifier: ModelAdapter, **options) -> DataFrame:
    """Both readings merged: paper_id, decision, confidence, reason, agreement, evidence and status.

    Only papers that need it are read a second time, where they lie; what both readings
    said is written once.
    """
    first = _read(_known(papers), "p", primary, **options)
    second = _read(first, "v", verifier, requires_verification(F.col("p")), **options)
    return merged(persisted(second.select("paper_id", "p", "v")))


def merged(both: DataFrame) -> DataFrame:
    """Final rows of paper_id, p, v."""
    p, v = F.col("p"), F.col("v")
    rows = both.withColumn("m", merge_decisions(p, v))
    rows = rows.withColumn("e", final_evidence(F.col("m.decision"), p, v))
    rows = rows.withColumn("s", final_status(F.col("m.decision"), F.col("m.agreement"), F.col("e"), p, v))
    return rows.select(
        "paper_id", F.col("m.decision").alias("Decision"), F.col("m.confidence").alias("Confidence"), F.col("m.reason").alias("Reason"), F.col("m.agreement").alias("Agreement_Status"),
        F.col("e.quote").alias("Evidence_Quote"), F.col("e.source").alias("Final_Evidence_Source"), F.col("s.validation_status").alias("Validation_Status"), F.col("s.failure_class").alias("Failure_Class"),
        model_decision(p).alias("Primary_Decision"), F.when(v.isNotNull(), model_decision(v)).otherwise("").alias("Verifier_Decision"), F.to_json(p).alias("Primary_Assessment_JSON"), F.coalesce(F.to_json(v), F.lit("")).alias("Verifier_Assessment_JSON"),
    )


def local_row(rows: DataFrame) -> DataFrame:
    """Local engine's row from title, abstract and an answer (decision, confidence, reason, evidence_quote; null: failed).

    A wrong quote is repaired with the title (KEEP, REJECT) or dropped (MAYBE).
    """
    fixed = repair_quote(F.col("decision"), F.col("evidence_quote"), F.col("Title"), F.col("Abstract"))
    rows = rows.withColumn("fixed", fixed)
    ok = F.col("decision").isin("KEEP", "MAYBE", "REJECT") & F.coalesce(F.col("confidence").between(0, 1), F.lit(False)) & F.col("fixed.usable")
    ok = F.coalesce(ok, F.lit(False))
    quote = F.when(ok, F.col("fixed.quote")).otherwise("")
    evidence = F.when(quote == "", F.lit("[]")).otherwise(F.to_json(F.array(F.struct(F.when(text("Title").contains(quote), "title").otherwise("abstract").alias("source"), quote.alias("quote")))))
    decision = F.when(ok, F.col("decision")).otherwise("MAYBE")
    return rows.withColumns({
        "Decision": decision,
        "Confidence": F.when(ok, F.col("confidence")).otherwise(0.0),
        "Evidence_Quote": quote,
        "Evidence_JSON": evidence,
        "Evidence_Repaired": ok & F.col("fixed.repaired"),
        "Validation_Status": F.when(ok, "validated").otherwise("technical_failure"),
        "Failure_Class": F.when(ok, "").otherwise("local_inference_failure"),
        "Review_Pending": decision == "MAYBE",
        "Agreement_Status": F.when(decision == "MAYBE", "pending_review").otherwise("primary_definitive"),
    }).drop("fixed")


def apply_review(rows: DataFrame, reviews: DataFrame, key: str = "row_id") -> DataFrame:
    """Second readings of pending MAYBEs: a valid one decides, a failed one leaves a MAYBE that says so."""
    r = reviews.select(key, F.struct("Decision", "Confidence", "Evidence_Quote", "Evidence_JSON", "Validation_Status").alias("r"))
    joined = rows.join(r, key, "left")
    hit = F.col("Review_Pending") & F.col("r").isNotNull()
    good = hit & (F.col("r.Validation_Status") == "validated")
    bad = hit & ~good
    pick = lambda new, failed, old: F.when(good, new).when(bad, failed).otherwise(old)
    change = {c: pick(F.col(f"r.{c}"), F.lit(f).cast(t), F.col(c)) for c, f, t in (("Decision", "MAYBE", "string"), ("Confidence", 0.0, "double"), ("Evidence_Quote", "", "string"), ("Evidence_JSON", "[]", "string"))}
    change["Validation_Status"] = pick(F.lit("validated"), F.lit("technical_failure"), F.col("Validation_Status"))
    change["Failure_Class"] = pick(F.lit(""), F.lit("local_review_failure"), F.col("Failure_Class"))
    resolved = F.when(F.col("r.Decision") == "MAYBE", "both_maybe").otherwise("reviewer_resolved")
    change["Agreement_Status"] = pick(resolved, F.lit("review_technical_failure"), F.col("Agreement_Status"))
    change["Verifier_Decision"] = F.when(hit, F.col("r.Decision")).otherwise("")
    change["Review_Pending"] = F.col("Review_Pending") & ~hit
    return joined.withColumns(change).drop("r")


def trace(stages: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """key, trace: the stages of each row in order, as an array of structs."""
    return stages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("trace"))


def stage_latency(calls: DataFrame) -> DataFrame:
    """paper_id, seconds: wall time of each batch shared by its papers."""
    return calls.groupBy("paper_id").agg(F.sum(F.col("wall_seconds") / F.greatest(F.lit(1), F.col("batch_size"))).alias("seconds"))


def may_finalise(df: DataFrame) -> bool:
    """Finalising waits until no MAYBE is left."""
    return df.where(F.upper(stripped("Decision")) == "MAYBE").limit(1).isEmpty()
