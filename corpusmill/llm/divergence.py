"""Source divergence audit: how the terms of the sources of a language differ.

Late strings. Tasks count terms and write (lang, source, digest, n, df), with the
string only where a task meets a term for the first time. What is shuffled to add
up the counts are digests of a fixed width. The strings of those digests that
stay are then reduced to their minimum and maximum: if the two differ, two terms
share the digest, and only such digests are counted again by their strings (split).
Strings come back at last to the rows that are reported.

1. :func:`counted` tokenises each text once; a task keeps at most ``TASK_WORDS``
   words and ``TASK_COUNTS`` counts before it writes them.
2. A term is kept if at least ``min_docs`` documents of its language hold it. The
   sum over a language is a window over its digest, which spills; a hot source only
   adds one row a digest.
3. All arithmetic is exact: ``p`` divides decimals of 38 digits.
4. Pairs of sources are compared over blocks of terms: a dense table of a block's
   terms by all sources of the language, a term that a source lacks at its
   smoothed floor. A block has about ``BLOCK_ROWS`` counts, and of the sources at most
   ``BLOCK_PAIRS`` pairs are added up in a task.

Defined cases: null text, lang and source are ''; every row is a document, rows that
repeat a doc_id (or lack one) too; ties of value go by the UTF-8 bytes of the item; a
language without kept terms has pairs of value 0 and no terms; a language with one
source has no pairs; texts of any length are read whole; an empty table gives no
rows; other columns of ``docs`` are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import forget, materialise, ship, with_facts

#: Bytes of terms stay (A-Z in lower case), all others end a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIN_DOCS, TOP_TERMS, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Words and counts that a task holds before it writes them.
TASK_WORDS, TASK_COUNTS = 300_000, 2_000_000
#: Slots of digests by which strings of dropped terms are passed over: the bound of a broadcast.
SLOTS = 1 << 20
#: Counts in a block of terms, and pairs of sources that a task adds up.
BLOCK_ROWS, BLOCK_PAIRS = 200_000, 1_000_000
COUNTS = "lang string, source string, digest long, term string, n long, df long"


class Numbers(dict):
    """Consecutive numbers of what is asked for."""

    def __missing__(self, key) -> int:
        self[key] = value = len(self)
        return value


def digest(word: bytes, bits: int = 64) -> int:
    """The signed 64-bit digest of a term; fewer ``bits`` make collisions, for tests."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(word) >> (64 - bits)).view(np.int64))


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sum of each of ``values`` under them."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def counted(docs: DataFrame, bits: int = 64, all_strings: bool = False) -> DataFrame:
    """(lang, source, digest, term, n, df) by task; ``term`` only on a word's first row, or on all."""
    ship(docs.sparkSession)

    def run(batches):
        words, groups, held, size = Numbers(), Numbers(), [], 0

        def written():
            key, n, df = _summed(np.concatenate([k for k, *_ in held]), np.concatenate([n for _, n, _ in held]), np.concatenate([d for *_, d in held]))
            word, group = key >> 24, key & 0xFFFFFF
            names, places = list(words), list(groups)
            first = np.concatenate([[True], word[1:] != word[:-1]]) | all_strings
            terms = np.full(len(word), None, dtype=object)
            terms[first] = [names[w].decode("utf-8", "replace") for w in word[first]]
            digests = np.fromiter((digest(w, bits) for w in names), dtype=np.int64, count=len(names))
            lang, source = (np.array([p[k] for p in places], dtype=object) for k in (0, 1))
            for at in range(0, len(word), 100_000):
                own = slice(at, at + 100_000)
                yield pd.DataFrame({"lang": lang[group[own]], "source": source[group[own]], "digest": digests[word[own]], "term": terms[own], "n": n[own], "df": df[own]})

        for pdf in batches:
            for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"], strict=True):
                parts = text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()
                if not parts:
                    continue
                ids, n = np.unique(np.fromiter(map(words.__getitem__, parts), dtype=np.int64, count=len(parts)), return_counts=True)
                held.append((ids << 24 | groups[lang, source], n.astype(np.int64), np.ones(len(ids), dtype=np.int64)))
                size += len(ids)
                if size > TASK_COUNTS:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                if len(words) > TASK_WORDS or size > TASK_COUNTS // 2 or len(groups) >= 0xFFFFFF:
                    yield from written()
                    words, groups, held, size = Numbers(), Numbers(), [], 0
        if held:
            yield from written()

    return docs.mapInPandas(run, COUNTS)


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    below = (total.cast("decimal(19,0)") + F.lit(SMOOTH).cast("decimal(2,0)") * kept.cast("decimal(17,0)")).cast("decimal(22,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, below)


def _kept(counts: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """Counts by source, of the terms that enough documents of the language hold, with the language's count."""
    by_source = counts.groupBy("lang", "source", *keys).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_lang = Window.partitionBy("lang", *keys)
    return by_source.withColumn("n_lang", F.sum("n").over(of_lang)).withColumn("df", F.sum("df").over(of_lang)).where(F.col("df") >= min_docs).drop("df")


def _pair_sums(kept: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of every ordered pair of sources of a language."""
    sizes = kept.groupBy("lang").agg(F.count("*").alias("rows"))
    plan = facts.groupBy("lang").agg(F.count("*").alias("sources")).join(sizes, "lang", "left")
    step = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_PAIRS) / F.col("sources")))  # sources on the left of a block's pairs
    plan = materialise(plan.select("lang", (F.coalesce("rows", F.lit(0)) / BLOCK_ROWS).cast("long").alias("more"), step.cast("long").alias("step"), F.ceil(F.col("sources") / step).alias("blocks"), F.coalesce("rows", F.lit(0)).alias("rows")), "div-plan")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c))
    left = with_facts(kept.select("lang", "source", "digest", "split", "p"), plan, ["lang"], "rows")
    left = left.withColumn("chunk", F.pmod(F.xxhash64("digest", "split"), F.col("more") + 1)).withColumn("block", each(F.col("blocks") - 1))
    right = facts.select("lang", "source", "z").join(plan.select("lang", "more", "step", "blocks"), "lang").withColumn("chunk", each(F.col("more"))).withColumn("block", each(F.col("blocks") - 1))

    def added(key, rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", ignore_index=True)
        names, floor, step = sources["source"].to_numpy(), sources["z"].to_numpy(), int(sources["step"].iloc[0]) if len(sources) else 1
        own = slice(int(key[2]) * step, (int(key[2]) + 1) * step)
        total = np.zeros((len(names[own]), len(names)), dtype=np.int64)
        term = rows.groupby(["digest", "split"], sort=False).ngroup().to_numpy()
        source = pd.Index(names).get_indexer(rows["source"])
        order = np.argsort(term, kind="stable")
        term, source, p = term[order], source[order], rows["p"].to_numpy()[order]
        few = max(1, BLOCK_PAIRS // max(1, len(names)))
        for at in range(0, int(term[-1]) + 1 if len(term) else 0, few):
            low, high = np.searchsorted(term, (at, at + few))
            table = np.tile(floor, (int(term[high - 1]) + 1 - at, 1))
            table[term[low:high] - at, source[low:high]] = p[low:high]
            table = np.ascontiguousarray(table.T)
            for k, row in enumerate(table[own]):
                total[k] += np.abs(table - row).sum(axis=1)
        a, b = np.meshgrid(np.arange(len(names))[own], np.arange(len(names)), indexing="ij")
        other = (a != b).ravel()
        return pd.DataFrame({"lang": key[0], "source": names[a.ravel()[other]], "item": names[b.ravel()[other]], "value": total.ravel()[other]})

    keys = ["lang", "chunk", "block"]
    both = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(added, "lang string, source string, item string, value long")
    return both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, bits: int = 64) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank for every source of every language.

    ``pair``: the other sources by their difference over all kept terms. ``term``: the
    ``top_terms`` kept terms that the source uses more than its language does.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialise(counted(rows, bits), "div-counts")
    kept = materialise(_kept(counts, ["digest"], min_docs), "div-kept")

    # the strings of what is kept: two under one digest differ in minimum and maximum
    slots = kept.select(F.pmod("digest", F.lit(SLOTS)).alias("slot")).distinct()  # SLOTS rows at most
    texts = counts.where("term is not null").withColumn("slot", F.pmod("digest", F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left_semi")
    texts = materialise(texts.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "div-texts")
    shared = materialise(texts.where("low <> high").select("digest"), "div-shared")
    terms = kept.withColumn("split", F.lit(""))
    if shared.limit(1).count():
        again = counted(rows, bits, all_strings=True).join(shared, "digest", "left_semi").withColumnRenamed("term", "split")
        split = _kept(again, ["digest", "split"], min_docs)
        terms = materialise(terms.join(shared, "digest", "left_anti").unionByName(split), "div-split")

    # what each source and each language adds up to
    groups = rows.select("lang", "source").distinct()
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    of_lang = terms.groupBy("lang", "digest", "split").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total_lang"))
    zero = F.lit(0).cast("long")
    facts = groups.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "rows", "kept", "total_lang"])
    facts = materialise(facts.withColumn("z", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept"))).otherwise(zero)), "div-facts")
    known = with_facts(terms, facts, ["lang", "source"], "rows")
    known = materialise(known.select("lang", "source", "digest", "split", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q")), "div-shares")

    # ties of the last place stay until their strings decide
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    most = known.where("p > q").select("lang", "source", "digest", "split", (F.col("p") - F.col("q")).alias("value")).withColumn("place", F.rank().over(best)).where(F.col("place") <= top_terms)
    named = most.join(texts.select("digest", "low"), "digest").withColumn("item", F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = named.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)

    of_pairs = _pair_sums(known, facts).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    out = materialise(of_pairs.unionByName(of_terms), "div-result")
    for done in (counts, kept, texts, shared, facts, known, *([terms] if terms.inputFiles() != kept.inputFiles() else [])):
        forget(done)
    return out
