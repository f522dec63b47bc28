"""WARC archives: a writer that dedups payloads, and a reader that salvages.

Writer: payload digests are grouped with map-side combining, and the record with
the largest id of each digest becomes the response; the others revisit it. Only
digests of several rows are looked up again, so payloads that are not repeated need
no shuffle, unless few tasks hold most rows of the input. Each task writes gzip members, one a record, to files of bounded size in the shared
folder; the committed manifest names the files that count, so files of lost or
repeated tasks are never read.

Reader: a file is read as a stream. A position counts as a record only if its
gzip member (or, uncompressed, its version line and headers) passes every check:
checksum, length, closing lines, payload digest. After a failed check the reader
searches for the next position that passes, goes on there, and logs the bytes
between as a quarantined gap.

Defined cases: a null html is an empty payload; rows with equal id and payload
are all responses if the id is the largest; a null id loses to any other id; very long
payloads are written and read whole, whatever their size (a record is held in memory; a member that
inflates beyond the length its own header declares is quarantined, so a bomb cannot take a worker); an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import forget, materialise, shared_dir, ship, with_facts

FILE_BYTES = 64 << 20
CHUNK = 1 << 18
#: Bytes of a member that are unpacked first; most members end there.
FIRST = 1 << 12
#: Rows that one task may hold in any case without their being dealt to others.
TASK_ROWS = 10_000
LEVEL = 4
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
VERSION_LINE, HEADER_LINE = re.compile(r"WARC/1\.\d+"), re.compile(r"[^\s:]+:")
RECORD_LENGTH, HTTP_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)\s*$"), re.compile(rb"(?im)^content-length:\s*(\d+)")
NOT_IN_URL = re.compile(r"[\x00-\x20\x7f]")
#: Bytes in which the header of a record must end; what has no such end is quarantined.
MAX_HEADER = 1 << 26
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which has HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = NOT_IN_URL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def crowded(rows: DataFrame) -> bool:
    """Whether one task of ``rows`` has more than twice its share of them; of a Parquet file this reads the footer only."""
    most, total = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return (most or 0) > max(TASK_ROWS, 2 * (total or 0) / rows.sparkSession.sparkContext.defaultParallelism)


def write_archives(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of page_id, url, html; returns the manifest (path, bytes, records)."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    repeated = materialise(rows.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-digests")
    facts = repeated.hint("merge") if crowded(pages) else repeated  # a shuffle by digest deals crowded rows out
    linked = with_facts(rows, facts, ["sha"], "n")  # the page that a third of all rows repeat is met everywhere
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        store, root = fs.FileSystem.from_uri(base if "://" in base or base.startswith("file:") else f"file://{base}")
        store.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0
        for pdf in batches:
            for page_id, url, payload, sha, first in zip(*(pdf[c] for c in ("page_id", "url", "payload", "sha", "first")), strict=True):
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                page_id = None if pd.isna(page_id) else int(page_id)
                other = None if pd.isna(first) or page_id == int(first) or len(payload) < min_bytes else int(first)
                data = member(record_bytes(page_id, url, bytes(payload), base64.b32encode(bytes(sha)).decode(), other))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})

    manifest = linked.select("page_id", "url", "payload", "sha", "first").mapInPandas(run, "path string, bytes long, records long")
    prefix = base.split("://")[0] + "://" if "://" in base else "file://"
    done = materialise(manifest.select(F.concat(F.lit(prefix), "path").alias("path"), "bytes", "records"), "warc-manifest")
    forget(repeated)
    return done


class _Window:
    """A forward window over a stream: bytes before ``at`` may be let go."""

    def __init__(self, stream):
        self.stream, self.buffer, self.start, self.done = stream, bytearray(), 0, False

    def fill(self, until: int) -> None:
        """Hold the bytes up to position ``until``, or to the end."""
        while not self.done and self.start + len(self.buffer) < until:
            more = self.stream.read(max(CHUNK, until - self.start - len(self.buffer)))
            self.done = not more
            self.buffer += more

    def get(self, at: int, n: int) -> bytes:
        self.fill(at + n)
        with memoryview(self.buffer) as held:
            return bytes(held[at - self.start : at - self.start + n])

    def let_go(self, at: int) -> None:
        if at - self.start > 4 * CHUNK:
            del self.buffer[: at - self.start]
            self.start = at

    def next_candidate(self, at: int) -> int | None:
        """First position from ``at`` on where a member or version line may begin."""
        while True:
            self.fill(at + CHUNK)
            if m := CANDIDATE.search(self.buffer, at - self.start):
                return self.start + m.start()
            if self.done:
                return None
            at = max(at, self.start + len(self.buffer) - len(VERSION) + 1)


class BadRecord(Exception):
    pass


def parse_record(data: bytes) -> dict:
    """Fields of one whole WARC record; raises BadRecord if any check fails."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not VERSION_LINE.fullmatch(lines[0]) or not all(HEADER_LINE.match(x) or x[:1] in " \t" for x in lines[1:]):
        raise BadRecord("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        raise BadRecord("no content length")
    n = int(fields["content-length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise BadRecord("wrong length")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    declared = HTTP_LENGTH.search(http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type", "")
    if kind == "response" and (declared is None or int(declared[1]) != len(payload) or base32_sha1(payload) != digest):
        raise BadRecord("payload does not match its length or digest")
    return {
        "record_id": fields.get("warc-record-id", ""),
        "record_type": kind,
        "refers_to": fields.get("warc-refers-to"),
        "target": fields.get("warc-target-uri"),
        "payload_digest": digest,
        "payload_bytes": int(declared[1]) if declared else len(payload),
        "payload": payload if kind == "response" else None,
        "size": len(head) + 4 + n + 4,
    }


def _declared(data: bytes) -> int | None:
    """Bytes of the record that begins with ``data``, by its own header; None while the header goes on."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0:
        return None
    length = RECORD_LENGTH.search(data[:cut].replace(b"\r", b""))
    if not length:
        raise BadRecord("no content length")
    return cut + 4 + int(length[1]) + 4


def _member_at(window: _Window, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``at``, and where it ends."""
    unpack, out, here, size, limit, step = zlib.decompressobj(31), [], at, 0, None, FIRST
    try:
        while not unpack.eof:
            part = window.get(here, step)
            if not part:
                raise BadRecord("truncated member")
            here, step = here + len(part), min(CHUNK, 4 * step)
            while True:
                out.append(unpack.decompress(part, CHUNK))
                size, part = size + len(out[-1]), unpack.unconsumed_tail
                if limit is None:
                    limit = _declared(b"".join(out))
                if size > (MAX_HEADER if limit is None else limit):
                    raise BadRecord("no end of header" if limit is None else "a member larger than its record")
                if unpack.eof or (not part and len(out[-1]) < CHUNK):  # after the end, the tail is what follows the member
                    break
            here -= len(unpack.unused_data)
    except zlib.error as e:
        raise BadRecord(f"broken member: {e}") from None
    return b"".join(out), here


def _plain_at(window: _Window, at: int) -> tuple[bytes, int]:
    """The uncompressed record at ``at``, and where it ends."""
    size = 1 << 12
    while (cut := window.get(at, size).find(b"\r\n\r\n")) < 0:
        if size >= MAX_HEADER or len(window.get(at, size)) < size:
            raise BadRecord("no end of header")
        size *= 2
    total = _declared(window.get(at, cut + 4))
    if len(window.get(at + total - 4, 4)) < 4:
        raise BadRecord("truncated record")
    return window.get(at, total), at + total


def salvage(stream) -> Iterator[dict]:
    """Records and gaps of one archive, in file order; gaps have a reason and no record."""
    window, at, gap, reason = _Window(stream), 0, None, ""
    while head := window.get(at, len(VERSION)):
        try:
            if head.startswith(MAGIC):
                data, end = _member_at(window, at)
                fields = parse_record(data)
                if fields["size"] != len(data):
                    raise BadRecord("bytes after the record in its member")
            elif head == VERSION:
                data, end = _plain_at(window, at)
                fields = parse_record(data)
            else:
                raise BadRecord("neither a member nor a version line")
        except BadRecord as e:
            if gap is None:
                gap, reason = at, str(e)
            window.let_go(at)
            following = window.next_candidate(at + 1)
            if following is None:
                break
            at = following
            continue
        if gap is not None:
            yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": reason}
            gap = None
        yield {"kind": "record", "offset": at, "length": end - at} | fields
        at = end
        window.let_go(at)
    if gap is not None:
        while window.get(window.start + len(window.buffer), CHUNK):
            window.let_go(window.start + len(window.buffer))
        yield {"kind": "gap", "offset": gap, "length": window.start + len(window.buffer) - gap, "reason": reason}


SCHEMA = "path string, kind string, offset long, length long, reason string, record_id string, record_type string, refers_to string, target string, payload_digest string, payload_bytes long"


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Records and gaps of all files named by ``manifest`` (column path); payloads only on demand."""
    ship(manifest.sparkSession)
    columns = [c.split()[0] for c in SCHEMA.split(", ")] + ["payload"] * payloads

    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                store, at = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_stream(at, compression=None, buffer_size=CHUNK) as stream:
                    for x in salvage(stream):
                        held.append({"path": path} | {c: x.get(c) for c in columns if c != "path"})
                        size += len(x.get("payload") or b"") * payloads
                        if len(held) >= 2_000 or size > 8 << 20:
                            yield _frame(held, columns)
                            held, size = [], 0
                if held:
                    yield _frame(held, columns)

    files = max(1, manifest.count())
    return manifest.select("path").coalesce(1).repartition(files).mapInPandas(run, SCHEMA + ", payload binary" * payloads)


def _frame(held: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(held, columns=columns)
    for c in ("offset", "length", "payload_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def page_number(name: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({name}, 'urn:page:(-?[0-9]+)', 1) as bigint)")
