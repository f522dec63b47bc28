"""Duplicate groups and field-level survivorship.

Plan shape: one key expression, one shuffle on it, one fold per group, and minima over
all tasks for groups that are too large for one. Rows with
a DOI match on it alone, rows without one on their title alone, and a row with
neither stays single: it gets its own place as key, so blanks never form a hot
group. The fold depends on the order of its rows, so they are sorted by richness
and place inside each group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import canonical_doi, has_value, norm_dedup, text, ustrip
from corpusmill.operators.frames import persisted

#: Fields that a longer version of the same text may replace.
EXTENSIBLE = ("Abstract", "Authors", "Keywords", "Source title")
#: Different records of a group that one task folds, and large groups whose hashes are broadcast.
IN_ONE, MAX_LARGE = 1_000, 100_000
#: Fields that make the key, and its hashes.
KEYED, KEY = ("DOI", "Title"), ("k1", "k2")
#: Fields whose presence makes a record rich.
CORE = ("Abstract", "Authors", "Keywords", "Source title", "DOI", "Year", "Link")


def match_key(doi: Column | str, title: Column | str, place: Column, unify_doi: bool = False) -> Column:
    """Key of the duplicate group; ``unify_doi`` takes resolvers off first."""
    d = norm_dedup(canonical_doi(doi) if unify_doi else doi)
    t = norm_dedup(title)
    return F.when(d != "", F.concat(F.lit("d:"), d)).when(t != "", F.concat(F.lit("t:"), t)).otherwise(F.concat(F.lit("u:"), place.cast("string")))


def _count(columns: list[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + has_value(f"`{c}`").cast("int")
    return out


def extends(current: Column, candidate: Column) -> Column:
    """Whether the candidate is the current text and more (a closing ellipsis aside)."""
    short, long = norm_dedup(current), norm_dedup(candidate)
    core = ustrip(F.regexp_replace(short, r"[.…]+$", ""))
    return (core != "") & long.contains(core) & (F.length(long) > F.length(short))


def _prepared(records: DataFrame, place: list[str], unify_doi: bool) -> tuple[DataFrame, list[str], Callable[[Column, Column], Column]]:
    """Hashes of the key (k1, k2), richness (r1, r2: the richest first), place and payload of every record; the payload's fields; and the key of a payload and a place.

    A key may be a whole text, so 128 bits of its hash are shuffled instead.
    """
    fields = [c for c in records.columns if c not in place]
    at = F.struct(*[F.col(c) for c in place])
    payload = F.struct(*[text(F.col(f"`{c}`")).alias(c) for c in fields])

    def key_of(v: Column, at: Column) -> Column:
        part = lambda c: v[c] if c in fields else F.lit("")
        return match_key(part("DOI"), part("Title"), F.concat_ws("/", *[at[c] for c in place]), unify_doi)

    rows = records.select(payload.alias("v"), (-_count([c for c in CORE if c in fields])).alias("r1"), (-_count(fields)).alias("r2"), at.alias("at"))
    return rows.select(*key_hashes(key_of(F.col("v"), F.col("at"))), "v", "r1", "r2", "at"), fields, key_of


def _keyed(v: Column, fields: list[str]) -> Column:
    """What of a payload makes its key."""
    return F.struct(*([v[c].alias(c) for c in fields if c in KEYED] or [F.lit("").alias("none")]))


def _folded(rows: DataFrame, fields: list[str]) -> DataFrame:
    """group_size, first_place, the record (m) and the base (v, at) of each group, folded in one go."""
    # equal records count once: folding one a second time changes nothing, and a group
    # of exact copies shrinks before it is shuffled
    once = rows.groupBy(*KEY, "r1", "r2", "v").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    row = F.struct("r1", "r2", "at", "v")
    groups = once.groupBy(*KEY).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min("at").alias("first_place"), F.sum("n").alias("group_size"))

    def fold(acc: Column, r: Column) -> Column:
        out = []
        for c in fields:
            mine, other = acc[c], r["v"][c]
            pick = F.when(~has_value(other), mine).when(~has_value(mine), other)
            if c in EXTENSIBLE:
                pick = pick.when(extends(mine, other), other)
            out.append(pick.otherwise(mine).alias(c))
        return F.struct(*out)

    base = F.get("rows", F.lit(0))
    merged = F.aggregate(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), base["v"], fold)
    return groups.select("group_size", "first_place", merged.alias("m"), _keyed(base["v"], fields).alias("v"), base["at"].alias("at"))


def _folded_apart(rows: DataFrame, fields: list[str], in_one: int) -> DataFrame:
    """The same for groups of any size, which no task holds as a whole.

    A plain field takes the first filled value in the order of the fold: a minimum,
    combined before the shuffle. An extensible field goes on from its first value to the
    first later one that extends it, and so on: each step is a minimum over all rows of
    the group, which are dealt to tasks of about ``in_one`` rows with a copy of the
    current value. So there are as many steps as extensions follow each other.
    """
    order = F.struct("r1", "r2", "at")
    value = lambda c: F.col("v")[c]
    first = {c: F.coalesce(F.min(F.when(has_value(value(c)), F.struct(order.alias("o"), value(c).alias("x")))), F.min(F.struct(order.alias("o"), value(c).alias("x")))) for c in fields}
    richest = F.min(F.struct(order.alias("o"), _keyed(F.col("v"), fields).alias("v"))).alias("b")
    base = persisted(rows.groupBy(*KEY).agg(F.count("*").alias("group_size"), F.min("at").alias("first_place"), richest, *[e.alias(f"f{k}") for k, e in enumerate(first.values())]))
    longer = [k for k, c in enumerate(fields) if c in EXTENSIBLE]
    steps = []
    if longer:
        salts = F.ceil(F.col("group_size") / in_one)
        each = F.array(*[F.struct(F.lit(k).alias("field"), value(fields[k]).alias("x")) for k in longer])
        chain = rows.select(*KEY, order.alias("o"), F.explode(each).alias("e")).select(*KEY, "o", "e.field", "e.x").where(has_value("x")).distinct()
        spread = base.select(*KEY, salts.alias("salts"))
        chain = persisted(chain.join(spread, list(KEY)).withColumn("salt", F.pmod(F.xxhash64("o", "x"), F.col("salts"))).drop("salts"))
        known = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"f{k}.o").alias("so"), F.col(f"f{k}.x").alias("sx")) for k in longer])
        state = base.select(*KEY, salts.alias("salts"), F.explode(known).alias("s")).select(*KEY, "salts", "s.field", "s.so", "s.sx").where(has_value("sx"))
        while True:
            sent = state.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
            hits = chain.join(sent, [*KEY, "field", "salt"]).where((F.col("o") > F.col("so")) & extends(F.col("sx"), F.col("x")))
            nearest = hits.groupBy(*KEY, "field", "salts").agg(F.min(F.struct("o", "x")).alias("n"))
            state = persisted(nearest.select(*KEY, "salts", "field", F.col("n.o").alias("so"), F.col("n.x").alias("sx")))
            if state.isEmpty():
                break
            steps.append(state)
    out = base
    if steps:
        last = reduce(DataFrame.unionByName, [s.withColumn("step", F.lit(i)) for i, s in enumerate(steps)])
        ends = last.groupBy(*KEY).agg(*[F.max_by(F.when(F.col("field") == k, F.col("sx")), F.when(F.col("field") == k, F.col("step"))).alias(f"e{k}") for k in longer])
        out = base.join(ends, list(KEY), "left")
    ended = [F.coalesce(*([F.col(f"e{k}")] if steps and k in longer else []), F.col(f"f{k}.x")).alias(c) for k, c in enumerate(fields)]
    return out.select("group_size", "first_place", F.struct(*ended).alias("m"), "b.v", F.col("b.o.at").alias("at"))


def consolidate(records: DataFrame, place: list[str], unify_doi: bool = False, in_one: int = IN_ONE) -> DataFrame:
    """One record per group, with group_size and the place of its first row, in that order of places.

    ``place`` names the columns that order the input, no two rows alike. The richest
    record is the base; blank fields are filled by the next ones, and extensible fields
    take a safe extension. Groups of more than ``in_one`` different records, which a
    pass over hashes finds, are folded by minima over all tasks, with the same result.
    """
    rows, fields, key_of = _prepared(records, place, unify_doi)
    hashed = rows.select(*KEY, F.xxhash64("v").alias("v1")).distinct()
    large = persisted(hashed.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > in_one).drop("n"))
    n = large.count()
    if not n:
        out = _folded(rows, fields)
    else:
        held = F.broadcast(large) if n <= MAX_LARGE else large
        apart = persisted(rows.join(held, list(KEY), "left_semi"))
        out = _folded(rows.join(held, list(KEY), "left_anti"), fields).unionByName(_folded_apart(apart, fields, in_one))
    return out.select(key_of(F.col("v"), F.col("at")).alias("match_key"), "group_size", *[F.col(f"first_place.{c}").alias(c) for c in place], "m.*")


def key_hashes(key: Column) -> list[Column]:
    """128 bits that stand for a key, which may be a whole text."""
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("second"), key).alias("k2")]


def group_counts(records: DataFrame, key: Column) -> DataFrame:
    """records_identified, groups and duplicates_removed; counted with map-side combining.

    A key may be a whole text, so 128 bits of its hash are shuffled instead.
    """
    k = records.select(key.alias("k")).select(*key_hashes(F.col("k")))
    sizes = k.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("records_identified"), F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates_removed"))
