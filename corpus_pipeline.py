"""Corpus cleaning: toxicity, line dedup, near-dedup, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` writes what a stage returns as Parquet into the shared
folder and reads it again as the docs of the next one, so a lost executor never
makes an earlier stage run again. All stages but the last return the columns of
documents, with their values: columns of the user that bear the name of a result
(score, n_lines, kept, ...) stay as they are. Packing returns a row per piece.

Defined cases: a null text is clean, has one empty line, no near-duplicate and one
closing token; a null doc_id keeps its row in every filter but the one of benchmark
items, which goes by the text; of rows with equal doc_id and text near-dedup keeps
one, of rows with equal doc_id and different texts each text once; ties (equal
texts) keep the smallest doc_id; very long texts are handled whole; empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import forget, materialise, read_table
from corpusmill.llm.decontamination import decontaminate
from corpusmill.llm.line_dedup import dedup_lines
from corpusmill.llm.near_dup import drop_near_duplicates as keep_one_of_each
from corpusmill.llm.packing import pack
from corpusmill.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, in one pass over the texts."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many others hold; n_chars follows the text."""
    changed = dedup_lines(docs, counts=False)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by the definition of op6: shingles of two words, similarity 0.8."""
    return keep_one_of_each(docs, width=2, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of related texts."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack_windows),
]

#: Classifier, MinHash and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "*")
    last = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            forget(last)
        last = docs
    return docs
