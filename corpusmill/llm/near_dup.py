"""MinHash near-duplicates through a signature-coordinate inverted join.

1. Each text becomes its set of word shingles (64-bit hashes) and a signature of
   ``COORDINATES`` minima. Equal sets form one class with a number of its own; only
   classes go on, so copies are never expanded into pairs.
2. Each (coordinate, value) pair is a key of an inverted index. Pairs of documents
   are candidates if they agree on ``MIN_MATCHES`` coordinates or more. Such a
   pair agrees on one of the ``COORDINATES - MIN_MATCHES + 1`` rarest keys of
   either document, so only this prefix is posted, and keys that no other document
   has are skipped. A pair of Jaccard similarity 0.8 misses the threshold with a
   probability of 1.2e-6.
3. Hub round: under each key every document is paired with one hub, the document
   whose keys are the most frequent (in a group of copies the one closest to all
   others). This is linear in the postings however large a group is. A document
   first meets the hub that it shares most keys with, then those of its other hubs
   that are in another component. Candidates are confirmed on full shingle sets, and
   the links form components.
4. Merging rounds: crowded keys (more than ``SMALL_KEY`` documents) that still hold
   several components mostly hold parts of one group. Under each such key one document of
   every component, another one each time, meets one of the component that has most
   documents there: linear in the components of a key. The links merge parts, and the
   round is repeated while a share of ``MERGE_SHARE`` of its pairs are links,
   ``MERGE_ROUNDS`` times at most.
5. Rest round: only pairs under a key that are still in different components can
   add anything. Under keys of at most ``SMALL_KEY`` documents they are compared
   as they are, which is linear in the postings. The documents under larger keys
   that hold several components (a group of copies and its outsiders) go through
   an exact join on the rarest shingles. A pair that may reach the similarity has
   an early rare shingle in common (positional bound), and its sets differ in few
   slots of a parity map (a bound of the difference from below). So no link is
   lost, and a group is never expanded into all its pairs.
6. Components come from label propagation with pointer jumping; each round is
   written to the shared folder. Rows that share a label are narrow, and Spark splits their join.

Joins to what is known of a key (its count, its hub, its label) broadcast the hottest
keys, 1,000 at most, so no task gets all rows of a key.

Defined cases: a null text or one without words has the empty set, links with
nothing and is its own component; with fewer words than a shingle has, the whole
sequence is the one shingle; rows with a null doc_id link with nothing; rows that
share a doc_id are one document, which any of their texts may link, each row with
its own set size; of equal documents the smallest doc_id is kept; a text of any length
is taken whole; an empty table gives no rows; extra columns are ignored or, by
:func:`drop_near_duplicates`, kept whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import forget, materialise, ship, with_facts

COORDINATES = 32
MIN_MATCHES = 14
#: Documents under a key of which all pairs are compared, if in different components.
SMALL_KEY = 40
#: Rounds in which components under crowded keys meet one by one.
MERGE_ROUNDS = 4
#: Share of links among the pairs of a round from which on another round follows.
MERGE_SHARE = 0.1
#: Pairs for which the text of a hub is sent once.
PAIRS_A_TEXT = 256
#: Documents whose texts are looked up by a broadcast (three longs each, some 30 MB).
BROADCAST_HEADS = 300_000
#: Preceding tokens that a posting carries to tell whether a pair has met already.
LOOK_BACK = 8
#: Longs of a set's parity map.
PARITY_LONGS = 8
PARITY_BITS = (64 * PARITY_LONGS).bit_length() - 1
#: Slots of the shingle frequency sketch, which bounds the broadcast to 4 MB.
SKETCH_BITS = 20
#: Words whose hashes a worker holds.
CACHE_WORDS = 300_000
_random = np.random.default_rng(20240607)
FACTORS = _random.integers(1, 2**63, size=COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _random.integers(0, 2**63, size=COORDINATES, dtype=np.uint64)
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ONE
    h = (h ^ (h >> np.uint64(29))) * TWO
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mix(out + h[k : k + len(out)])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each hash family; a coordinate's number takes the lowest bits."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * FACTORS + ADDENDS
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    return ((low >> np.uint64(6)) << np.uint64(6) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, set_id (128-bit hash of the set) and keys (the signature)."""
    ship(docs.sparkSession)

    def run(batches):
        cache = WordHashes()
        for pdf in batches:
            sets = [shingles(t, width, cache) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"),
                "th": pdf["th"],
                "n_shingles": [len(s) for s in sets],
                "set_id": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "keys": [signature(s) if len(s) else np.zeros(0, dtype=np.int64) for s in sets],
            })

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return rows.mapInPandas(run, "doc_id long, th long, n_shingles long, set_id binary, keys array<long>")


def postings(reps: DataFrame) -> DataFrame:
    """(key, rep, n_shingles, weight): the prefix of each signature under keys that others share."""
    each = reps.select("rep", "n_shingles", F.explode("keys").alias("key"))
    often = materialise(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-keys")
    # no n means a key of one document: the rarest of all, to be skipped
    counted = with_facts(each, often.withColumn("rows", F.col("n")), ["key"], "rows").where("n is not null")
    shared = counted.groupBy("rep", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("ks"), F.sum("n").alias("weight"))
    prefix = F.greatest(F.lit(0), F.size("ks") - F.lit(MIN_MATCHES - 1))
    out = shared.where(F.size("ks") >= MIN_MATCHES).select("rep", "n_shingles", "weight", F.explode(F.slice("ks", F.lit(1), prefix)).alias("k")).select("k.key", "rep", "n_shingles", "weight")
    out = materialise(out, "near-postings")
    forget(often)
    return out


def similar_enough(a: Column, b: Column, percent: int) -> Column:
    """Set sizes that allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text) of the distinct ``nodes`` (rep): the text of each one's first document.

    Up to ``BROADCAST_HEADS`` of them are broadcast, so that no other text is shuffled.
    """
    heads = materialise(classes.join(nodes, "rep", "left_semi").select("rep", "doc_id", "th"), "near-heads")
    few = heads.count() <= BROADCAST_HEADS
    rows = docs.select("doc_id", "text").join(F.broadcast(heads) if few else heads, "doc_id").where(F.xxhash64("text") == F.col("th"))
    found = materialise(rows.select("rep", "text").dropDuplicates(["rep"]), "near-texts")
    forget(heads)
    return found


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the distinct materialised (a, b) that agree on enough coordinates and on their full sets.

    The text of ``b``, of which a hub has many pairs, is sent once for about
    ``PAIRS_A_TEXT`` of them, in as many tasks as that makes.
    """
    keys = classes.select("rep", "keys")
    if pairs.isEmpty():
        return pairs
    degree = materialise(pairs.groupBy("b").agg(F.count("*").alias("n")).join(keys.withColumnsRenamed({"rep": "b", "keys": "kb"}), "b"), "near-degrees")
    near = with_facts(pairs.join(keys.withColumnsRenamed({"rep": "a", "keys": "ka"}), "a"), degree, ["b"], "n")
    agree = F.size(F.array_intersect("ka", "kb"))  # a key holds its coordinate, so equal keys agree
    split = F.ceil(F.col("n") / PAIRS_A_TEXT)
    likely = materialise(near.where(agree >= MIN_MATCHES).select("a", "b", F.pmod(F.xxhash64("a"), split).alias("part")), "near-likely")
    texts = texts_of(likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct(), classes, docs)
    right = likely.select("b", "part").distinct().join(texts.withColumnsRenamed({"rep": "b", "text": "tb"}), "b")
    both = likely.join(texts.withColumnsRenamed({"rep": "a", "text": "ta"}), "a").join(right, ["b", "part"])

    def run(batches):
        cache = WordHashes()
        last: tuple = (None, None)
        for pdf in batches:
            keep = []
            for b, ta, tb in zip(pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                if last[0] != b:
                    last = (b, shingles(tb, width, cache))
                x, y = shingles(ta, width, cache), last[1]
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same) > 0)
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    out = materialise(both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long"), "near-links")
    for done in (degree, likely, texts):
        forget(done)
    return out


def rare_shingles(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(token, rep, n_shingles, component, at, before, parity): the shingles in the prefix of each text.

    The prefix takes the rarest shingles first, by a frequency sketch over all
    ``rows`` of rep, component and text (any order that all texts share is exact).
    Shingles that only one text has are skipped; ``at`` is the place in the order,
    ``before`` the last few of the shingles before it, and ``parity`` tells of each
    slot of the hash whether an odd number of the set's shingles fall into it.
    """
    held, spark = rows.select("rep", "component", "text"), rows.sparkSession

    def count(batches):
        cache = WordHashes()
        for pdf in batches:
            slots = np.concatenate([shingles(t, width, cache) >> np.uint64(64 - SKETCH_BITS) for t in pdf["text"]] + [np.zeros(0, dtype=np.uint64)])
            slot, n = np.unique(slots, return_counts=True)
            yield pd.DataFrame({"slot": slot.astype(np.int64), "n": n.astype(np.int64)})

    counted = held.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # 2 ** SKETCH_BITS rows at most
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    sketch[counted["slot"]] = np.minimum(counted["n"], 2**31 - 1)
    shipped = spark.sparkContext.broadcast(sketch)

    def prefix(batches):
        cache = WordHashes()
        for pdf in batches:
            for rep, component, text in zip(pdf["rep"], pdf["component"], pdf["text"], strict=True):
                s = shingles(text, width, cache)
                often = shipped.value[s >> np.uint64(64 - SKETCH_BITS)]
                order = np.lexsort((s, often))[: len(s) - (percent * len(s) + 99) // 100 + 1]
                at = np.flatnonzero(often[order] > 1)
                tokens = s[order[at]].view(np.int64)
                odd = np.bincount((s >> np.uint64(64 - PARITY_BITS)).astype(np.int64), minlength=1 << PARITY_BITS) & 1
                parity = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
                before = [tokens[max(0, k - LOOK_BACK) : k].tolist() for k in range(len(tokens))]
                yield pd.DataFrame({"token": tokens, "rep": rep, "n_shingles": len(s), "component": component, "at": at, "before": pd.Series(before, dtype=object), "parity": pd.Series([parity] * len(tokens), dtype=object)})

    return held.mapInPandas(prefix, "token long, rep long, n_shingles long, component long, at long, before array<long>, parity array<long>")


def cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) in different components under one token that may still reach the similarity.

    Tokens that both sides have just before show that the pair met there already.
    A slot of odd parity on one side only holds a shingle that the other lacks, so
    the number of such slots bounds the difference of the sets from below.
    """
    x, y = rows.alias("x"), rows.alias("y")
    sizes = F.col("x.n_shingles"), F.col("y.n_shingles")
    left = F.least(sizes[0] - F.col("x.at"), sizes[1] - F.col("y.at"))  # they have no more in common
    wanted = (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component"))
    wanted = wanted & ~F.arrays_overlap("x.before", "y.before")
    if "parity" in rows.columns:
        apart = sum((F.bit_count(F.col("x.parity")[k].bitwiseXOR(F.col("y.parity")[k])) for k in range(PARITY_LONGS)), F.lit(0))
        wanted = wanted & ((100 + percent) * apart <= (100 - percent) * (sizes[0] + sizes[1]))
    joined = x.join(y, wanted & similar_enough(*sizes, percent) & ((100 + percent) * left >= percent * (sizes[0] + sizes[1])))
    return joined.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the undirected ``edges`` (a, b)."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), "near-edges")
    state = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component"), F.count("*").alias("n")), "near-labels")
    while True:
        # the smallest label around, then the label of that label
        around = with_facts(both, state.withColumnRenamed("node", "other"), ["other"], "n").groupBy("node").agg(F.min("component").alias("near"))
        stepped = state.join(around, "node").select("node", "n", "component", F.least("component", "near").alias("next"))
        jump = state.select(F.col("node").alias("next"), F.col("component").alias("jumped"))
        following = stepped.join(jump, "next", "left").select("node", "n", F.col("component").alias("was"), F.least("next", F.coalesce("jumped", "next")).alias("component"))
        following = materialise(following, "near-labels")
        forget(state)
        changed = following.where("component <> was").limit(1).count()
        state = following.select("node", "n", "component")
        if not changed:
            forget(both)
            return state.select("node", "component")


def _edges(found: DataFrame) -> DataFrame:
    """What components say of their nodes, as (a, b)."""
    return found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")


def _open_keys(posted: DataFrame, found: DataFrame) -> DataFrame:
    """Materialised (key, rep, n_shingles, component, n): the postings of keys with several components, ``n`` of each key."""
    placed = materialise(posted.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")), "near-placed")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    several = materialise(several, "near-several")
    out = materialise(with_facts(placed, several, ["key"], "n").where("n is not null"), "near-open")
    forget(placed)
    forget(several)
    return out


def _component_pairs(open_keys: DataFrame, percent: int, turn: int) -> DataFrame:
    """Distinct (a, b), a < b: under each crowded key a document of every component and one of the component with most documents.

    ``turn`` changes which documents of a component are taken.
    """
    drawn = F.struct(F.xxhash64(F.lit(turn), "key", "rep").alias("h"), "rep", "n_shingles")
    picks = open_keys.where(F.col("n") > SMALL_KEY).groupBy("key", "component").agg(F.max(drawn).alias("p"), F.count("*").alias("n"))
    largest = picks.groupBy("key").agg(F.max(F.struct("n", "component", "p")).alias("m"))
    both = picks.join(largest, "key").where((F.col("component") != F.col("m.component")) & similar_enough(F.col("p.n_shingles"), F.col("m.p.n_shingles"), percent))
    return both.select(F.least("p.rep", "m.p.rep").alias("a"), F.greatest("p.rep", "m.p.rep").alias("b")).distinct()


def _classified(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Materialised: the sketch of every row, and (set_id, n, component_id) of every class of equal sets."""
    own = materialise(sketches(docs, width), "near-sketches")
    sound = own.where("n_shingles > 0 and doc_id is not null")
    head = F.min(F.struct("doc_id", "th")).alias("head")
    grouped = sound.groupBy("set_id").agg(head, F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = materialise(grouped.select(F.monotonically_increasing_id().alias("rep"), "set_id", "n", "head.doc_id", "head.th", "n_shingles", "keys"), "near-classes")
    posted = postings(classes)

    # a hub is the most central document under a key
    hub = posted.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.struct("weight", F.negative("rep").alias("minus"), "n_shingles")).alias("h"))
    hub = materialise(hub.select("key", "rows", F.negative("h.minus").alias("hub"), F.col("h.n_shingles").alias("n_hub")), "near-hubs")
    star = with_facts(posted, hub, ["key"], "rows").where((F.col("rep") != F.col("hub")) & similar_enough(F.col("n_shingles"), F.col("n_hub"), percent))
    first = materialise(star.groupBy(F.col("rep").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("shared")), "near-first")
    # each document first meets the hub that it shares most keys with, then only hubs of other components
    best = materialise(first.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "near-best")
    nearest = confirmed(best, classes, docs, width, percent)
    placed_first = components(nearest)
    of = lambda side: placed_first.withColumnsRenamed({"node": side, "component": f"c{side}"})
    apart = first.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    once = apart.select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).groupBy("x", "y").agg(F.max(F.struct("a", "b")).alias("m")).select("m.a", "m.b")
    once = materialise(once, "near-once")
    links = confirmed(once, classes, docs, width, percent)
    found = placed_first if links.isEmpty() else components(links.union(nearest))
    met = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_keys = _open_keys(posted, found)
    tried = [best, once]
    for turn in range(MERGE_ROUNDS):
        tried.append(materialise(_component_pairs(open_keys, percent, turn).join(met, ["a", "b"], "left_anti"), "near-merging"))
        more = confirmed(tried[-1], classes, docs, width, percent)
        if more.isEmpty():
            break
        met, paid = met.union(tried[-1]), more.count() >= MERGE_SHARE * tried[-1].count()
        found = components(_edges(found).union(more))
        forget(open_keys)
        open_keys = _open_keys(posted, found)
        if not paid:
            break

    small = open_keys.where(F.col("n") <= SMALL_KEY).select(F.col("key").alias("token"), "rep", "n_shingles", "component", F.lit(0).alias("at"), F.array().cast("array<long>").alias("before"))
    crowded = materialise(open_keys.where(F.col("n") > SMALL_KEY).select("rep", "component").distinct(), "near-crowded")
    texts = texts_of(crowded.select("rep"), classes, docs)
    rare = rare_shingles(crowded.join(texts, "rep"), width, percent)
    pairs = cross_pairs(small, percent).union(cross_pairs(rare, percent)).distinct().join(met, ["a", "b"], "left_anti")
    tried.append(materialise(pairs, "near-rest"))
    more = confirmed(tried[-1], classes, docs, width, percent)

    # classes that share a doc_id, and the links of both rounds
    members = sound.select("doc_id", "set_id").distinct()
    shared = members.groupBy("doc_id").count().where("count > 1").select("doc_id")
    ids = classes.select("set_id", "rep")
    same = members.join(shared, "doc_id").join(ids, "set_id").select("doc_id", "rep")
    same = same.join(same.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    same = materialise(same, "near-same")
    labels = found if more.isEmpty() and same.isEmpty() else components(_edges(found).union(more).union(same))
    labelled = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", "n", "doc_id", F.coalesce("component", "rep").alias("component"))
    labelled = materialise(labelled, "near-labelled")
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    least = materialise(least, "near-least")
    out = materialise(with_facts(labelled.drop("doc_id"), least, ["component"], "rows").select("set_id", "n", "component_id"), "near-components")
    for done in (classes, posted, hub, first, nearest, placed_first, links, found, open_keys, crowded, texts, same, labels, labelled, least, *tried):
        forget(done)
    return own, out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    own, components_of = _classified(docs, width, percent)
    asked = own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    rows = with_facts(asked, components_of, ["set_id"], "n")
    mine = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", mine.alias("component_id"), F.coalesce(mine == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with the columns of ``docs``.

    Of rows with equal doc_id and text one stays; other rows of a doc_id that stays
    and rows without one are all kept.
    """
    own, components_of = _classified(docs, width, percent)
    asked = own.where("doc_id is not null and n_shingles > 0").select("doc_id", "set_id")
    gone = with_facts(asked, components_of, ["set_id"], "n").where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit("second"), "text").alias("_t2"))
    rows = rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    repeated = materialise(own.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_t1")).count().where("count > 1").drop("count"), "near-repeated")
    if repeated.limit(1).count():
        again = rows.join(repeated, ["_id", "_t1"], "left_semi").dropDuplicates(["_id", "_t1", "_t2"])
        rows = rows.join(repeated, ["_id", "_t1"], "left_anti").unionByName(again)
    return rows.select("d.*")
