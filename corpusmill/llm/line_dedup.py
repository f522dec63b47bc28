"""Line dedup, with DataFrame functions only.

Distinct keys of each document are hashed to 128 bits, counted by key with
map-side combining, and only the keys over the threshold come back. They are joined
to the lines (the hottest ones, 1,000 at most, by broadcast, so no task gets all lines
of a hot key), gathered per document as positions, and each text is cut around them.
No text is shuffled by line.

Defined cases: a null or empty text is one empty line; rows without a doc_id keep
all lines and count for no key; rows with the same doc_id count as one document
and are each rewritten; of rows that tie for the largest doc_id all keep the line; keys
shorter than ``min_chars`` are never dropped; a text or line of any length is taken
whole; an empty table gives no rows; other columns pass through, but own columns named
n_lines and n_dropped are replaced (with ``counts=False`` they stay, and no counts are
returned).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise, ship, with_facts

WHITE = "\t\n\x0b\x0c\r "


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(WHITE))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, counts: bool = True) -> DataFrame:
    """The columns of ``docs`` with ``text`` rewritten and, with ``counts``, n_lines and n_dropped."""
    ship(docs.sparkSession)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    numbered = F.transform(lines, lambda x, i: F.struct(line_key(x).alias("k"), i.alias("pos")))
    long_enough = F.filter(numbered, lambda x: F.length(x["k"]) >= min_chars)
    ids = [F.col("doc_id"), F.xxhash64("text").alias("th")]  # tells apart rows that share an id
    hashed = docs.where("doc_id is not null and text is not null").select(*ids, F.transform(long_enough, lambda x: F.struct(_hashes(x["k"]).alias("h"), x["pos"].alias("pos"))).alias("ls"))

    once = hashed.select("doc_id", F.explode(F.array_distinct(F.transform("ls", lambda x: x["h"]))).alias("h")).select("doc_id", "h.h1", "h.h2")
    over = once.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper", "n")
    over = materialise(over, "lines-over")
    each = hashed.select("doc_id", "th", F.explode("ls").alias("l")).select("doc_id", "th", "l.h.h1", "l.h.h2", "l.pos")
    gone = with_facts(each, over, ["h1", "h2"], "n").where("doc_id <> keeper").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *ids)
    own = rows.join(gone, ["doc_id", "th"], "left").select("d", F.split(F.coalesce("d.text", F.lit("")), "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    starts = F.concat(F.array(F.lit(-1)), F.col("gone"))
    kept = F.flatten(F.transform(starts, lambda s, i: F.slice(F.col("lines"), s + 2, F.coalesce(F.get(F.col("gone"), i), F.size("lines")) - s - 1)))
    new = {"text": F.array_join(kept, "\n")}
    if counts:
        new |= {"n_lines": F.size("lines").cast("long"), "n_dropped": F.size("gone").cast("long")}
    made = own.select("d", F.struct(*[v.alias(c) for c, v in new.items()]).alias("made"))  # apart, so that no column of docs hides one
    if not counts:
        return made.select(*[F.col(f"made.{c}") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
    return made.select(*[F.col(f"d.`{c}`") for c in docs.columns if c not in new], *[F.col(f"made.{c}") for c in new])
