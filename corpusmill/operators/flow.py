"""Flow of records through a review: counts, equations, status, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import stripped, text
from corpusmill.functions.values import sha256

NO_REASON = "reason not classified"


def _c(df: DataFrame, name: str) -> Column:
    return text(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def decision_counts(df: DataFrame, *by: str) -> DataFrame:
    """keep, maybe, reject and screened, in one aggregate (for each value of ``by``)."""
    d = F.upper(stripped(_c(df, "Decision")))
    counts = [F.count_if(d == x).alias(x.lower()) for x in ("KEEP", "MAYBE", "REJECT")]
    manual = F.lower(_c(df, "Decision_Source")) == "manual_review"
    rejects = [F.count_if((d == "REJECT") & ~manual).alias("automated_rejects"), F.count_if((d == "REJECT") & manual).alias("manual_rejects")]
    out = df.groupBy(*by).agg(*counts, *rejects)
    return out.withColumn("screened", F.col("keep") + F.col("maybe") + F.col("reject"))


def exclusion_reasons(df: DataFrame) -> DataFrame:
    """reason, count of the rejected rows, by reason; a blank reason has a default name."""
    reason = stripped(_c(df, "Exclusion_Reason"))
    rejected = df.where(F.upper(stripped(_c(df, "Decision"))) == "REJECT")
    return rejected.groupBy(F.when(reason == "", NO_REASON).otherwise(reason).alias("reason")).agg(F.count("*").alias("count")).orderBy("reason")


def snapshot(counts: DataFrame, plan: dict) -> DataFrame:
    """One row: identification, screening counts, equations and status.

    ``counts``: the row of :func:`decision_counts`. ``plan``: identified, duplicates
    (None: deduplication not performed), other, available, selected, kind,
    finalized, csv_match, progress_status.
    """
    n = {k: F.lit(int(plan.get(k) or 0)).cast("long") for k in ("identified", "duplicates", "other", "available", "selected")}
    screened = F.col("screened")
    awaiting = F.greatest(F.lit(0), n["available"] - screened)
    this_run = F.greatest(F.lit(0), n["selected"] - screened)
    first = F.lit(True) if plan.get("duplicates") is None else n["identified"] == n["duplicates"] + n["other"] + n["available"]
    second = (n["available"] == screened + awaiting) & (screened <= n["selected"]) & (n["selected"] == screened + this_run)
    if plan.get("finalized"):
        status = F.when(F.lit(bool(plan.get("csv_match"))) & (n["selected"] >= n["available"]), "title_abstract_complete").otherwise("incomplete")
    elif plan.get("kind", "screening") != "screening":
        status = F.lit(plan.get("status", "identification_complete"))
    else:
        running = plan.get("progress_status") or ""
        ladder = F.when((screened > 0) & (F.col("maybe") > 0), "manual_review").when(screened < n["selected"], "screening").when(awaiting > 0, "incomplete").otherwise("title_abstract_complete")
        status = F.lit("error") if running == "error" else F.when(F.lit(running == "starting"), "starting").otherwise(ladder)
    warnings = F.filter(
        F.array(
            F.lit("title and abstract screening only"),
            F.when(F.lit(plan.get("duplicates") is None), F.lit("deduplication was not performed")),
            F.when(n["available"] > n["selected"], F.lit("a row limit left records unscreened")),
            F.when(F.col("maybe") > 0, F.lit("MAYBE records await manual review")),
            F.when(awaiting > 0, F.lit("some available records have not been screened")),
            F.when(F.lit(plan.get("csv_match") is None), F.lit("CSV counts have not been verified")),
        ),
        lambda x: x.isNotNull(),
    )
    return counts.select(
        n["identified"].alias("records_identified"), F.lit(plan.get("duplicates")).cast("long").alias("duplicate_records_removed"), n["other"].alias("records_removed_other_reasons"),
        n["available"].alias("records_available_for_screening"), n["selected"].alias("records_selected_for_run"), screened.alias("records_screened"), awaiting.alias("records_awaiting_screening"),
        this_run.alias("records_awaiting_current_run"), F.greatest(F.lit(0), n["available"] - n["selected"]).alias("records_deferred_by_limit"), F.col("reject").alias("records_excluded"),
        F.col("automated_rejects").alias("excluded_by_tool_assisted_screening"), F.col("manual_rejects").alias("excluded_by_manual_review"), F.col("maybe").alias("records_awaiting_manual_review"),
        F.col("keep").alias("records_included_after_title_abstract"), status.alias("status"), (first & second).alias("equations_valid"), F.lit(plan.get("csv_match")).cast("boolean").alias("csv_counts_match"), warnings.alias("warnings"),
    )


def manifest_rows(snapshot_row: DataFrame) -> DataFrame:
    """field, value pairs of a snapshot, for a flat CSV."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), (F.to_json(c) if t.startswith("array") else F.col(c).cast("string")).alias("value")) for c, t in snapshot_row.dtypes])
    return snapshot_row.select(F.explode(pairs).alias("p")).select("p.*")


def revision(snapshot_row: DataFrame) -> Column:
    """16 characters that change only if a field changes (times are not among them)."""
    return F.substring(sha256(F.to_json(F.struct(*sorted(snapshot_row.columns)), {"ignoreNullFields": "false"})), 1, 16)


def inherit_lineage(jobs: DataFrame, imports: DataFrame) -> DataFrame:
    """Jobs with the identification of their import, only if the fingerprint of their input is its own.

    ``jobs``: job_id, import_id, input_fingerprint. ``imports``: import_id,
    clean_fingerprint, identified, duplicates.
    """
    known = imports.select("import_id", "clean_fingerprint", F.lit(True).alias("present"), "identified", "duplicates")
    joined = jobs.join(known, "import_id", "left")
    same = F.coalesce(F.col("clean_fingerprint") == F.col("input_fingerprint"), F.lit(False))
    warning = F.when(F.col("import_id").isNull() | same, F.lit(None).cast("string")).when(F.col("present").isNull(), "lineage unavailable").otherwise("fingerprint differs")
    own = lambda c: F.when(same, F.col(c))
    return joined.select("job_id", own("import_id").alias("import_id"), F.when(same, F.col("identified")).otherwise(0).alias("records_identified"), own("duplicates").alias("duplicate_records_removed"), F.when(same, "performed").otherwise("not_performed").alias("deduplication_status"), warning.alias("lineage_warning"))
