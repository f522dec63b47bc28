"""Writers. Parquet is the system of record; single files are for people.

Spark's commit protocol makes a directory appear as a whole or not at all.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import has_value, stripped
from corpusmill.operators import review
from corpusmill.operators.frames import persisted
from corpusmill.operators.gold import BLIND
from corpusmill.sources import ingest


#: Names of the parts of an export.
EXPORT_FILES = {"all": "screened_all.csv", "keep": "screened_keep.csv", "maybe": "screened_maybe.csv", "reject": "screened_reject.csv", "review_queue": "screened_maybe_review_queue.csv", "summary": "screening_summary.json"}


def file_name(value: str, default: str = "citations.csv") -> str:
    """Without characters that file systems reserve, and without a dot at the end."""
    clean = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", " ".join(value.split())).rstrip(".")
    return clean or default


def _replace(path: str, data: bytes) -> None:
    """A file that appears as a whole: written beside, then renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(beside, "wb") as f:
            f.write(data)
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.unlink(beside)


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """A directory of CSV parts with a header; sorted across parts if ``order`` is given."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=False, emptyValue="", lineSep="\n")


def write_csv_file(df: DataFrame, path: str, order: list | None = None, bom: bool = True) -> str:
    """One local CSV file for a person to open (rows stream through the driver); returns its SHA-256."""
    import csv

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    beside, digest = f"{path}.{uuid.uuid4().hex}.tmp", hashlib.sha256()
    rows = (df.orderBy(*order) if order else df).toLocalIterator()
    try:
        with open(beside, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(df.columns)
            for r in rows:
                out.writerow(["" if v is None else v for v in r])
        with open(beside, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.unlink(beside)
    return digest.hexdigest()


def write_json_file(value: dict, path: str) -> None:
    _replace(path, json.dumps(value, ensure_ascii=False, indent=2, default=str).encode())


def write_once(value: dict, path: str) -> bool:
    """A document with a content id: False if it is there already; other content under the id is an error."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if json.load(f) != json.loads(json.dumps(value, default=str)):
                raise ValueError("a document of the same id has different content")
        return False
    write_json_file(value, path)
    return True


def write_validation_set(header: dict, manifest: DataFrame, labels: DataFrame, root: str) -> None:
    """A validation set as files: labels for people (CSV), and apart from them the private manifest and its header (JSON).

    The header comes last, so a set without one is unfinished and cannot be read.
    """
    spark = manifest.sparkSession
    write_csv(labels, f"{root}/labels", [F.col("Source_Row_Index")])
    manifest.write.mode("overwrite").json(f"{root}/private/manifest")
    spark.createDataFrame([(json.dumps(header, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/private/header")


def read_validation_set(spark: SparkSession, root: str) -> tuple[dict, DataFrame, DataFrame]:
    """(header, manifest, labels) as :func:`write_validation_set` left them, labels with what people have filled in."""
    header = json.loads(spark.read.text(f"{root}/private/header").first()["value"])
    schema = "draw long, model_decision string, sampling_weight double, " + ", ".join(f"`{c}` string" for c in BLIND)
    return header, spark.read.schema(schema).json(f"{root}/private/manifest"), ingest.read_csv(spark, f"{root}/labels")


def export_pack(run: DataFrame, root: str, job_id: str, protocol_inputs: dict | None = None) -> dict:
    """All, keep, maybe, reject, review queue and summary of a run under ``root``/``job_id``; returns the counts.

    Guards run before and after the projection. Each part is a folder of CSV files
    with a header, under its fixed name, with all columns of the projection.
    """
    ids = review.guard(run, job_id)
    frame = persisted(review.prepare(run, job_id, ids, protocol_inputs))
    review.guard(frame, job_id)
    base = f"{root.rstrip('/')}/{job_id}"
    write_csv(frame, f"{base}/{EXPORT_FILES['all']}")
    for decision in review.DECISIONS:
        write_csv(frame.where(F.col("Decision") == decision), f"{base}/{EXPORT_FILES[decision.lower()]}")
    write_csv(review.review_queue(frame), f"{base}/{EXPORT_FILES['review_queue']}", review.queue_order(frame))
    counts = review.summary(frame)
    counts.coalesce(1).write.mode("overwrite").json(f"{base}/{EXPORT_FILES['summary']}")
    got = counts.first().asDict()
    return {"all": got["total_count"], "keep": got["keep_count"], "maybe": got["maybe_count"], "reject": got["reject_count"], "review_queue": got["maybe_count"], "summary": got}


def finalise_pack(run: DataFrame, root: str) -> dict:
    """Rows with a title, by decision; refuses while a MAYBE is left, and counts what it wrote."""
    if not run.where(F.upper(stripped("Decision")) == "MAYBE").limit(1).isEmpty():
        raise ValueError("MAYBE records remain")
    rows = run.where(has_value("Title")).withColumn("final_decision", F.lower(stripped("Decision")))  # Decision keeps its name and case
    rows.write.mode("overwrite").partitionBy("final_decision").parquet(root)
    written = run.sparkSession.read.parquet(root).groupBy("final_decision").count()
    return {r["final_decision"]: r["count"] for r in written.collect()}
