"""The driver tables as review data: the mapping that all registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as bibliographic records: the first line is the title, the whole text the abstract."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring_index("text", "\n", 1).alias("Title"), F.col("text").alias("Abstract"), "source", "lang", "n_chars")


#: The same in SQL.
RECORDS = "(SELECT doc_id, string_split(text, chr(10))[1] AS Title, text AS Abstract, source, lang, n_chars FROM documents)"


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a decision from their labels: toxic REJECT, good KEEP, else MAYBE; unlabelled ones are left out.

    A few rows stand for fallbacks, disagreements and manual work, by their id.
    """
    lab = table(spark, sf_dir, "labels")
    d = records(spark, sf_dir).join(lab, "doc_id")
    i = F.col("doc_id")
    decision = F.when(F.col("toxic") == 1, "REJECT").when(F.col("quality") == 1, "KEEP").otherwise("MAYBE")
    decision = F.when(i % 7 == 0, "MAYBE").otherwise(decision)
    fallback = (decision == "MAYBE") & (i % 3 == 0)
    return d.select(
        i.cast("string").alias("Source_Row_Index"), "doc_id", "Title", "Abstract", "source", decision.alias("Decision"),
        F.when(i % 5 == 0, "").otherwise(F.round(0.5 + (i % 50) / 100, 2).cast("string")).alias("Confidence"),
        F.when(fallback, "safe_fallback").otherwise("validated").alias("Validation_Status"),
        F.when(fallback & (i % 2 == 0), "browser_or_transport_failure").when(fallback, "validation_contradiction").otherwise("").alias("Failure_Class"),
        F.when(i % 4 == 0, "disagreement").otherwise("agreement").alias("Agreement_Status"),
        F.when(i % 21 == 0, "missing_abstract").otherwise("model").alias("Route_Used"),
        F.when(decision == "REJECT", F.when(i % 2 == 0, "off topic").otherwise("")).otherwise("").alias("Exclusion_Reason"),
        F.when((decision == "REJECT") & (i % 11 == 0), "manual_review").otherwise("tool_assisted_screening").alias("Decision_Source"),
        F.when(i % 2 == 0, "MAYBE").otherwise("").alias("Primary_Decision"), F.lit("").alias("Verifier_Decision"), F.lit("").alias("Reason"),
        (i % 6 == 0).cast("string").alias("Escalated"), F.lit("p1").alias("Protocol_ID"), F.lit("v1").alias("Prompt_Version"),
    )


SCREENED = f"""(
  SELECT doc_id::VARCHAR AS Source_Row_Index, doc_id, Title, Abstract, source, Decision,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE round(0.5 + (doc_id % 50)::DOUBLE / 100, 2)::VARCHAR END AS Confidence,
    CASE WHEN fb THEN 'safe_fallback' ELSE 'validated' END AS Validation_Status,
    CASE WHEN fb AND doc_id % 2 = 0 THEN 'browser_or_transport_failure' WHEN fb THEN 'validation_contradiction' ELSE '' END AS Failure_Class,
    CASE WHEN doc_id % 4 = 0 THEN 'disagreement' ELSE 'agreement' END AS Agreement_Status,
    CASE WHEN doc_id % 21 = 0 THEN 'missing_abstract' ELSE 'model' END AS Route_Used,
    CASE WHEN Decision = 'REJECT' AND doc_id % 2 = 0 THEN 'off topic' ELSE '' END AS Exclusion_Reason,
    CASE WHEN Decision = 'REJECT' AND doc_id % 11 = 0 THEN 'manual_review' ELSE 'tool_assisted_screening' END AS Decision_Source,
    CASE WHEN doc_id % 2 = 0 THEN 'MAYBE' ELSE '' END AS Primary_Decision, '' AS Verifier_Decision, '' AS Reason,
    CASE WHEN doc_id % 6 = 0 THEN 'true' ELSE 'false' END AS Escalated
  FROM (SELECT *, Decision = 'MAYBE' AND doc_id % 3 = 0 AS fb FROM (
    SELECT r.*, CASE WHEN doc_id % 7 = 0 THEN 'MAYBE' WHEN toxic = 1 THEN 'REJECT' WHEN quality = 1 THEN 'KEEP' ELSE 'MAYBE' END AS Decision
    FROM {RECORDS} r JOIN labels USING (doc_id))))"""
