"""Packs of several parts that appear as a whole or not at all.

Parts are staged in a folder of their own run, counted and hashed as written. A pack exists
once its manifest does: a numbered file beside the others, made by one rename that
fails if the number is taken. Readers go by the newest manifest, so a run that dies
leaves the pack before it readable, two runs at once cannot mix their parts, and
nobody reads a part that is being written.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.gold import content_fingerprint

MANIFEST = re.compile(r"manifest-(\d{8})\.json$")


class PackError(ValueError):
    pass


def _store(spark: SparkSession, root: str):
    """The file system of ``root``, and the class of its paths."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the packs under ``root``, in order."""
    store, Path = _store(spark, root)
    if not store.exists(Path(root)):
        return []
    found = (MANIFEST.search(f.getPath().getName()) for f in store.listStatus(Path(root)))
    return sorted(int(m[1]) for m in found if m)


def publish(parts: dict[str, DataFrame], root: str) -> int:
    """Write ``parts`` and publish them as the next version of the pack; returns its number."""
    spark = next(iter(parts.values())).sparkSession
    store, Path = _store(spark, root)
    run, listed = uuid.uuid4().hex, {}
    number = max(versions(spark, root), default=0) + 1
    for name, df in parts.items():
        at = f"data-{run}/{name}"
        df.write.parquet(f"{root}/{at}")
        back = spark.read.schema(df.schema).parquet(f"{root}/{at}")
        rows = back.count()
        listed[name] = {"path": at, "rows": rows, "schema": df.schema.json(), "digest": content_fingerprint(back) if rows else ""}
    beside, final = Path(f"{root}/.manifest-{run}"), Path(f"{root}/manifest-{number:08d}.json")
    out = store.create(beside, False)
    try:
        out.write(json.dumps({"version": number, "parts": listed}).encode())
    finally:
        out.close()
    if store.exists(final) or not store.rename(beside, final):
        store.delete(beside, False)
        raise PackError(f"version {number} was published by another run")
    return number


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """What a pack holds; the newest one without ``version``."""
    known = versions(spark, root)
    if not known or (version or known[-1]) not in known:
        raise PackError("there is no such pack")
    return json.loads(spark.read.text(f"{root}/manifest-{version or known[-1]:08d}.json", wholetext=True).first()["value"])


def read_part(spark: SparkSession, root: str, name: str, version: int | None = None, verify: bool = False) -> DataFrame:
    """A part of a pack; ``verify`` reads it once more for its count and hash."""
    from pyspark.sql.types import StructType

    parts = manifest(spark, root, version)["parts"]
    if name not in parts:
        raise PackError(f"the pack has no part {name}")
    known = parts[name]
    out = spark.read.schema(StructType.fromJson(json.loads(known["schema"]))).parquet(f"{root}/{known['path']}")
    if verify and (out.count() != known["rows"] or known["rows"] and content_fingerprint(out) != known["digest"]):
        raise PackError(f"part {name} is not what was published")
    return out


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` packs, and what runs that died have staged; returns how many folders went.

    For a moment when no run is publishing: the parts of one at work look like those of one that died.
    """
    store, Path = _store(spark, root)
    kept = versions(spark, root)[-keep:]
    used = {p["path"].split("/")[0] for v in kept for p in manifest(spark, root, v)["parts"].values()}
    gone = 0
    for f in store.listStatus(Path(root)):
        name = f.getPath().getName()
        numbered = MANIFEST.search(name)
        if name.startswith("data-") and name not in used or name.startswith(".manifest-") or numbered and int(numbered[1]) not in kept:
            store.delete(f.getPath(), True)
            gone += name.startswith("data-")
    return gone
