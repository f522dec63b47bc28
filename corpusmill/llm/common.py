"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's default for the bytes of an Arrow batch, and what it becomes.
BATCH_BYTES = ("67108864b", "16777216b")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver runs elsewhere.

    Whole texts are large, so unless the session names another size, batches of
    16 MB keep the workers small. What is bounded and comes to the driver comes in
    Arrow batches, not as Python rows.
    """
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == BATCH_BYTES[0]:
        spark.conf.set(key, BATCH_BYTES[1])
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in parts:
        env["PYTHONPATH"] = ":".join([root, *parts])


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of ``sf_dir`` with only the named columns."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    A session of one machine without that setting gets a new temporary folder; on a
    cluster there is no safe choice, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The committed files survive lost executors, and later branches reuse them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` left-joined to materialised ``facts``, one row a key, whose ``size`` says how many rows have the key.

    The keys with more than a thousandth of all rows counted (1,000 at least) are
    1,000 at most; they are broadcast, and their rows take part in the shuffle under
    a key of their own, so no task gets the rows of a hot key.
    """
    total = facts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(1_000, total // 1_000)
    values = [c for c in facts.columns if c not in keys]
    packed = facts.select(*keys, F.struct(*values).alias("_fact"), (F.col(size) > limit).alias("_hot"))
    hot = packed.where("_hot").select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.col("_fact").alias("_hot_fact"))
    cold = packed.where("not _hot").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_fact").alias("_cold_fact"))
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns])
    held = rows.columns
    if hot.limit(1).count():
        on = [F.col(k) == F.col(f"_b{i}") for i, k in enumerate(keys)]
        rows = rows.join(F.broadcast(hot), on, "left")
        is_hot = F.col("_hot_fact").isNotNull()
        # no fact has the number that a hot row brings along, so it only spreads the hot rows
        spread = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(100_003))).otherwise(F.lit(-1).cast("long"))
        rows = rows.withColumn("_spread", spread)
        cold = cold.withColumn("_c", F.lit(-1).cast("long"))
        joined = rows.join(cold, [F.col("_spread") == F.col("_c"), *[F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]], "left")
        fact = F.coalesce("_hot_fact", "_cold_fact")
    else:
        joined, fact = rows.join(cold, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], "left"), F.col("_cold_fact")
    return joined.select(*held, *[fact[c].alias(c) for c in values])


def id_remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; null ids give 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(0))


def label_sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids in hash order, so that every task agrees on them.

    Repeated ids keep their largest label; null ids and labels are left out.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents, one row an id.

    Of different texts under one id the one with the largest hash counts.
    """
    chosen = label_sample(labels, label, limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` ids
    one = F.max_by("text", F.struct(F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"))).alias("text")
    return rows.groupBy("doc_id").agg(one, F.max("label").alias("label"))
