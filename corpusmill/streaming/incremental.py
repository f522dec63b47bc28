"""Incremental screening on Structured Streaming.

Records arrive as files; each micro-batch screens what no earlier batch or run has
settled and writes it under the run's identity. A stream keeps the paper ids it has
seen in Spark's state store (``dropDuplicates``), and reads the results of other runs of the identity as
a second stream, so every row is read once and a batch costs what its own rows cost,
however many papers are settled. A restart goes on from the checkpoint; a batch that
died is written anew in its own folder, so nothing is lost or repeated. If nothing is
left, the model is not called. Of several texts under one id the one with the least
(title, abstract) counts, nulls first, among those that arrive together; later ones are
ignored. Rows without an id are not screened, since no result could be told to be theirs.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from corpusmill.functions.values import progress_percent, remaining_seconds
from corpusmill.operators.adapters import ModelAdapter
from corpusmill.operators.frames import persisted
from corpusmill.operators.screening import pending, two_stage

_active = threading.Lock()

PAPER = "paper_id string, title string, abstract string"
#: Parts of a batch in which the least text of each paper is found; a task holds one part at a time.
GROUPS = 1_024
#: Keeps state on disk, so that it may outgrow the memory of the executors.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class single_job:
    """One job at a time; a second one is refused instead of queued."""

    def __enter__(self):
        if not _active.acquire(blocking=False):
            raise RuntimeError("another screening job is running")

    def __exit__(self, *_):
        _active.release()


def results(spark: SparkSession, root: str, identity: str) -> DataFrame | None:
    """Rows that earlier batches of this identity have written; None before the first."""
    try:
        return spark.read.parquet(f"{root}/identity={identity}").drop("run", "batch")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or one that a stream has made
            return None
        raise


def _papers(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("paper_id").cast("string").alias("paper_id"), F.col("title").cast("string").alias("title"), F.col("abstract").cast("string").alias("abstract")).where("paper_id is not null")


def screen_batch(papers: DataFrame, root: str, identity: str, primary: ModelAdapter, verifier: ModelAdapter, **options) -> int:
    """Screen what is pending and append it; returns how many papers that were.

    Appending the same papers again is impossible, since they are joined away.
    """
    done = results(papers.sparkSession, root, identity)
    todo = _papers(papers).groupBy("paper_id").agg(F.min(F.struct("title", "abstract")).alias("p")).select("paper_id", "p.*")
    todo = persisted(todo if done is None else pending(todo, done, "paper_id"))
    n = todo.count()
    if n:
        two_stage(todo, primary, verifier, **options).write.parquet(f"{root}/identity={identity}/run=r{uuid.uuid4().hex}/batch=0")
    return n


def _least_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per paper: that of a settled one, else its least text."""
    least = None
    for pdf in frames:
        rows = pdf if least is None else pd.concat([least, pdf])
        least = rows.sort_values(["settled", "title", "abstract"], ascending=[False, True, True], na_position="first").drop_duplicates("paper_id")
    yield least


def unsettled(stream: DataFrame, folder: str) -> DataFrame:
    """Papers of ``stream`` that come for the first time and have no row in ``folder``, where results appear."""
    spark = stream.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    # without a limit on its files the first batch reads all that was settled before
    done = spark.readStream.schema("paper_id string").option("basePath", folder).parquet(folder)
    done = done.select("paper_id", *[F.lit(None).cast("string").alias(c) for c in ("title", "abstract")], F.lit(True).alias("settled"))
    rows = _papers(stream).withColumn("settled", F.lit(False)).unionByName(done)
    # the least text of a batch needs no state; that a paper was seen is Spark's own, without a call to Python
    one = rows.groupBy(F.pmod(F.xxhash64("paper_id"), F.lit(GROUPS))).applyInPandas(_least_texts, rows.schema)
    return one.dropDuplicates(["paper_id"]).where("not settled").drop("settled")


def screen_stream(stream: DataFrame, root: str, identity: str, primary: ModelAdapter, verifier: ModelAdapter, checkpoint: str, **options) -> StreamingQuery:
    """A query that screens each micro-batch of ``stream`` (paper_id, title, abstract) as it comes."""
    spark, folder = stream.sparkSession, f"{root}/identity={identity}"
    run = f"r{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex}"  # the same after a restart

    def each(batch: DataFrame, number: int) -> None:
        todo = persisted(batch)  # the state is read once, though two stages read the rows
        if todo.limit(1).count():
            two_stage(todo, primary, verifier, **options).write.mode("overwrite").parquet(f"{folder}/run={run}/batch={number}")

    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:  # the query keeps the settings that it starts with
        return unsettled(stream, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE[0], before)


class Progress(StreamingQueryListener):
    """Rows seen and seconds spent, from the events of a query."""

    def __init__(self):
        self.rows, self.seconds, self.batches = 0, 0.0, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.seconds += event.progress.batchDuration / 1000
        self.batches += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def progress_row(done: DataFrame, total: int, elapsed: float) -> DataFrame:
    """done, total, percent and seconds left of a results table."""
    counted = done.agg(F.count("*").alias("done"))
    return counted.select("done", F.lit(total).alias("total"), progress_percent(F.col("done"), F.lit(total)).alias("percent"), remaining_seconds(F.lit(float(elapsed)), F.col("done"), F.lit(total)).alias("seconds_left"))
