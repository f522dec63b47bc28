"""Language identification with interpolated Kneser-Ney character models.

Training counts every character n-gram of every training document. Words (runs
of letters, lower-cased, with a boundary mark on both sides) are counted per
language and partition with a bounded table, cut into n-grams of the highest
order, and summed by Spark over the 64-bit hash of the n-gram. Lower orders hold
Kneser-Ney continuation counts, which Spark groups as well, and the totals of every
context. Joins of one order with the next give the interpolated log-probabilities, and
executors write them, every n-gram of every language, as sorted hash arrays: leaves of
about ``LEAF_ENTRIES`` entries by the last bits of the hash, in the folder of
``spark.checkpoint.dir``. The driver knows only their number. A worker holds the leaves
it used last, up to ``HELD_BYTES``; a larger model is read leaf by leaf for the new words
of a batch, so its size changes the time and never the result. The leaves stay until the
shared folder is cleared, since the returned plan reads them.

A document is scored word by word (a bounded cache holds the words met before),
each language gets a cross-entropy per character, and the lowest one wins. The
margin to the second best becomes a score through a curve fitted on training texts
that a first model, of the other nine tenths, has not seen; ``reject_below`` turns poor scores into ``und`` (0 by default: the query
must name a learned language wherever there are letters).

Defined cases: null, empty or letterless texts give ``und`` with score 0; ties go
to the first language in alphabetical order; repeated rows count and are scored one by
one; a text of any length counts and is scored whole; without training rows everything
is ``und``; an empty table gives no rows; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, OrderedDict, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import forget, id_remainder, materialise, shared_dir, ship

ORDER = 4
DISCOUNT = 0.75
#: Tables of a model: n-grams of each order, contexts of each order from 2 on.
TABLES = 2 * ORDER - 1
#: Entries of a leaf, about, and bytes of the leaves that a worker holds.
LEAF_ENTRIES = 1 << 20
HELD_BYTES = 256 << 20
#: Values (characters times languages) scored in one step.
BLOCK_CELLS = 1_000_000
#: One in so many training texts, by a hash of the id, calibrates the score of the others' model.
CALIBRATION = 10
#: Distinct words held before a partition's counts are passed on.
WORD_TABLE = 200_000
#: Words scored in one step, words of the scoring cache, and characters of the texts whose words are counted together.
STEP_WORDS = 50_000
CACHE_WORDS = 200_000
GROUP_CHARS = 2_000_000
#: Rows whose margins fit the score curve, at most.
CURVE_ROWS = 20_000
LETTERS = re.compile(r"[^\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Probability of a character that a language does not have.
FLOOR = 6e-6


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between boundary marks, and where each starts."""
    joined = "\x00" * (ORDER - 1) + ("\x01" + "\x00" * (ORDER - 1)).join(words) + "\x01"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + ORDER
    return codes, np.cumsum(lengths) - lengths


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position from ORDER - 1 on."""
    at = len(codes) - ORDER + 1
    h = np.full(at, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ codes[ORDER - n + k : ORDER - n + k + at]) * MIX
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _spots(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices (into the hashes) of the characters of each word and its end mark."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def ngram_counts(counts: Counter) -> pd.DataFrame:
    """Rows (h1 .. hORDER, c1 .. : hash of each suffix and of its context; n) of a word table."""
    words = list(counts)
    codes, starts = _codes(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    spots = _spots(starts, lengths)
    n = np.repeat(np.fromiter(counts.values(), dtype=np.int64, count=len(words)), lengths)
    grams = [_hash(codes, k)[spots] for k in range(1, ORDER + 1)]
    # the context of the gram that ends at p is the gram, one shorter, that ends at p - 1
    before = np.concatenate([np.zeros(1, dtype=np.uint64), codes])
    contexts = [_hash(before[: len(codes)], k)[spots] for k in range(1, ORDER)]
    # the longest n-gram tells all others
    _, first, which = np.unique(grams[-1], return_index=True, return_inverse=True)
    total = np.zeros(len(first), dtype=np.int64)
    np.add.at(total, which, n)
    return pd.DataFrame({f"h{k}": g[first] for k, g in enumerate(grams, 1)} | {f"c{k}": c[first] for k, c in enumerate(contexts, 1)} | {"n": total})


KEYS = [f"h{k}" for k in range(1, ORDER + 1)] + [f"c{k}" for k in range(1, ORDER)]


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(lang, keys, n0, n): n-gram counts of the ``rows`` (text, lang, part) of part 0, and of all of them."""

    def run(batches):
        tables: dict[tuple, Counter] = defaultdict(Counter)
        held = 0

        def flush():
            for (lang, part), table in tables.items():
                if table:
                    yield ngram_counts(table).assign(lang=lang, part=part)
            tables.clear()

        for pdf in batches:
            for lang, part, text in zip(pdf["lang"], pdf["part"], pdf["text"], strict=True):
                table = tables[lang, part]
                had = len(table)
                table.update(words_of(text))
                held += len(table) - had
                if held > WORD_TABLE:
                    yield from flush()
                    held = 0
        yield from flush()

    schema = ", ".join(f"{k} long" for k in KEYS) + ", n long, lang string, part int"
    first = F.sum(F.when(F.col("part") == 0, F.col("n")).otherwise(0))
    return rows.select("text", "lang", "part").mapInPandas(run, schema).groupBy("lang", *KEYS).agg(first.alias("n0"), F.sum("n").alias("n"))


def _log(p):
    return F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))).cast("float")


def model_entries(grams: DataFrame) -> DataFrame:
    """(model, lang, kind, h, value): what each model knows, from n-gram counts (lang, keys, n0, n).

    ``n0`` counts the n-grams of model 0, ``n`` those of model 1. Kind k < ORDER is the
    log-probability of an n-gram of k + 1 characters, kind ORDER + k the log back-off
    weight of a context of k + 1. Every n-gram of an order ends in one of the order below,
    so the interpolation is a join of one order with the next.
    """
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(n).alias("n")) for m, n in enumerate(("n0", "n"))])).alias("m")
    level = grams.select("lang", *KEYS, models).select("lang", *KEYS, "m.*").where("n > 0")
    levels = {ORDER: level}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many distinct longer n-grams end in this one
        keys = [f"h{k}" for k in range(1, order + 1)] + [f"c{k}" for k in range(1, order)]
        level = level.groupBy("model", "lang", *keys).agg(F.count("*").alias("n"))
        levels[order] = level = materialise(level, "language-grams") if order == ORDER - 1 else level
    kept, made = [], [levels[ORDER - 1]]
    totals = levels[1].groupBy("model", "lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    probable = F.col("n") / F.col("total") * 0.999 + 0.001 / (F.col("kinds") + 1000)
    known = levels[1].join(totals, ["model", "lang"]).select("model", "lang", "h1", probable.alias("p"))
    for order in range(1, ORDER + 1):
        if order > 1:
            context = f"c{order - 1}"
            totals = levels[order].groupBy("model", "lang", context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            weight = F.col("kinds") * DISCOUNT / F.col("total")
            kept.append(totals.select("model", "lang", F.lit(ORDER + order - 2).alias("kind"), F.col(context).alias("h"), _log(weight).alias("value")))
            p = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + weight * F.col("p")
            lower = levels[order].join(totals, ["model", "lang", context]).join(known, ["model", "lang", f"h{order - 1}"])
            known = lower.select("model", "lang", f"h{order}", p.alias("p"))
        if 1 < order < ORDER:  # the next order and the model read it
            made.append(known := materialise(known, "language-grams"))
        kept.append(known.select("model", "lang", F.lit(order - 1).alias("kind"), F.col(f"h{order}").alias("h"), _log(F.col("p")).alias("value")))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    out = materialise(out, "language-entries")
    for done in made:
        forget(done)
    return out


@dataclass
class Models:
    """Two models as leaves of sorted hash arrays in the shared folder; nothing of their size is held here.

    A leaf holds the entries whose hash has its number as the last bits: rows (table, h)
    in order, with the languages that know the hash and their values.
    """

    langs: list[str]
    path: str = ""
    leaves: int = 1
    first: bool = False  # whether model 0 knows anything


def build(grams: DataFrame) -> Models:
    """Both models of the n-gram counts, computed, sorted and written by the executors."""
    found = grams.groupBy("lang").agg(F.max("n0").alias("n0")).orderBy("lang").collect()  # one row a language
    if not found:
        return Models([])
    langs = [r["lang"] for r in found]
    entries = model_entries(grams)
    leaves = 1 << max(0, (entries.count() - 1) // LEAF_ENTRIES).bit_length()
    table = (F.col("model") * TABLES + F.col("kind")).cast("int").alias("table")
    number = (F.array_position(F.lit(langs), F.col("lang")) - 1).cast("int")
    own = F.struct(number.alias("lang"), "value")
    rows = entries.select(F.col("h").bitwiseAND(leaves - 1).cast("int").alias("leaf"), table, "h", own.alias("own"))
    # one row a language at most; grouped, sorted and written after one shuffle by leaf
    rows = rows.repartition(leaves, "leaf").groupBy("leaf", "table", "h").agg(F.sort_array(F.collect_list("own")).alias("own"))
    rows = rows.select("leaf", "table", "h", F.col("own.lang").alias("langs"), F.col("own.value").alias("values")).sortWithinPartitions("leaf", "table", "h")
    path = f"{shared_dir(grams.sparkSession)}/language-model-{uuid.uuid4().hex}"
    rows.write.partitionBy("leaf").parquet(path)
    forget(entries)
    return Models(langs, path, leaves, any(r["n0"] for r in found))


class Leaves:
    """Leaves read by a worker, the latest used ones up to ``HELD_BYTES``, whatever the size of the models."""

    def __init__(self):
        self.held: OrderedDict = OrderedDict()
        self.size = 0

    def __call__(self, path: str, leaf: int) -> dict:
        key = path, leaf
        if key not in self.held:
            self.held[key] = got = self.read(f"{path}/leaf={leaf}")
            self.size += got["bytes"]
            while self.size > HELD_BYTES and len(self.held) > 1:
                self.size -= self.held.popitem(last=False)[1]["bytes"]
        self.held.move_to_end(key)
        return self.held[key]

    @staticmethod
    def read(path: str) -> dict:
        """Arrays of each table of a leaf: hashes, where their entries end, languages and values."""
        store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        if store.get_file_info(at).type == fs.FileType.NotFound:  # no hash has these bits
            return {"bytes": 0}
        rows = pq.read_table(at, filesystem=store, columns=["table", "h", "langs", "values"], partitioning=None)
        tables = rows["table"].to_numpy()
        langs, values = rows["langs"].combine_chunks(), rows["values"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(langs.value_lengths().to_numpy())])
        hashes, flat, numbers = rows["h"].to_numpy(), langs.flatten().to_numpy(), values.flatten().to_numpy()
        out: dict = {"bytes": hashes.nbytes + ends.nbytes + flat.nbytes + numbers.nbytes}
        for table in np.unique(tables):
            lo, hi = np.searchsorted(tables, [table, table + 1])
            out[int(table)] = hashes[lo:hi], ends[lo : hi + 1], flat, numbers
        return out


#: Shared by the tasks that a worker process runs one after the other.
_leaves = Leaves()


class WordModel:
    """Scores words: the longest n-gram known, and the back-off weights above it."""

    def __init__(self, models: Models, which: int):
        self.models, self.which = models, which

    def entries(self, kind: int, hashes: np.ndarray):
        """(position, language, value) arrays of all that the model knows of ``hashes``, leaf by leaf."""
        leaf_of = hashes & (self.models.leaves - 1)
        for leaf in np.unique(leaf_of) if self.models.leaves > 1 else [0]:
            table = _leaves(self.models.path, int(leaf)).get(self.which * TABLES + kind)
            if table is None:
                continue
            keys, ends, langs, values = table
            at = np.flatnonzero(leaf_of == leaf)  # not empty
            row = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            found = keys[row] == hashes[at]
            at, row = at[found], row[found]
            sizes = ends[row + 1] - ends[row]
            flat = np.arange(sizes.sum()) + np.repeat(ends[row] - np.cumsum(sizes) + sizes, sizes)
            yield np.repeat(at, sizes), langs[flat], values[flat]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Summed log-probability of each word (rows) in each language (columns), in steps of ``BLOCK_CELLS`` values."""
        codes, starts = _codes(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        spots, owners = _spots(starts, lengths), np.repeat(np.arange(len(words)), lengths)
        before = np.concatenate([np.zeros(1, dtype=np.uint64), codes])[: len(codes)]
        grams = [_hash(codes, n)[spots] for n in range(1, ORDER + 1)]
        contexts = [_hash(before, n)[spots] for n in range(1, ORDER)]
        total = np.zeros((len(words), len(self.models.langs)))
        step = max(1, BLOCK_CELLS // len(self.models.langs))
        for lo in range(0, len(spots), step):
            part = slice(lo, lo + step)
            out = np.full((len(spots[part]), len(self.models.langs)), np.log(FLOOR), dtype=np.float32)
            for n in range(1, ORDER + 1):
                if n > 1:
                    for at, lang, value in self.entries(ORDER + n - 2, contexts[n - 2][part]):
                        out[at, lang] += value
                for at, lang, value in self.entries(n - 1, grams[n - 1][part]):
                    out[at, lang] = value
            first = np.flatnonzero(np.diff(owners[part], prepend=-1))
            total[owners[part][first]] += np.add.reduceat(out, first, axis=0, dtype=np.float64)
        return total


class Scorer:
    """Cross-entropies of texts, with a bounded cache of word scores."""

    def __init__(self, models: Models, which: int = 1):
        self.model, self.langs = WordModel(models, which), len(models.langs)
        self.step = max(1, min(STEP_WORDS, BLOCK_CELLS // max(1, self.langs)))
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, self.langs))

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of ``scores`` of each of at most ``step`` words."""
        missing = [w for w in dict.fromkeys(words) if w not in self.row]
        if missing and len(self.row) + len(missing) > min(CACHE_WORDS, 4 * self.step):
            self.clear()
            missing = list(dict.fromkeys(words))
        if missing:
            self.row.update(zip(missing, range(len(self.row), len(self.row) + len(missing)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.word_scores(missing)])
        return np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character (rows: texts, columns: languages), and whether there are letters."""
        ends = np.cumsum([len(t or "") for t in texts], dtype=np.int64) // GROUP_CHARS
        groups = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1)
        parts = [self._entropies([texts[i] for i in g]) for g in groups]
        return np.concatenate([e for e, _ in parts]), np.concatenate([f for _, f in parts])

    def _entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        tables = [Counter(words_of(t)) for t in texts]
        words = [w for t in tables for w in t]
        n = np.fromiter((c for t in tables for c in t.values()), dtype=np.float64, count=len(words))
        owners = np.repeat(np.arange(len(tables)), np.array([len(t) for t in tables], dtype=np.int64))
        total, sizes = np.zeros((len(texts), self.langs)), np.zeros(len(texts))
        for lo in range(0, len(words), self.step):
            part = slice(lo, lo + self.step)
            rows, first = self.rows(words[part]), np.flatnonzero(np.diff(owners[part], prepend=-1))
            who = owners[part][first]
            total[who] += np.add.reduceat(self.scores[rows] * n[part, None], first, axis=0)
            lengths = np.fromiter(map(len, words[part]), dtype=np.float64, count=len(rows)) + 1
            sizes[who] += np.add.reduceat(lengths * n[part], first)
        # numerals such as superscripts are no letters
        found = np.fromiter((any(c.isalpha() for w in t for c in w) for t in tables), dtype=bool, count=len(tables))
        return np.where(found[:, None], -total / np.maximum(sizes, 1)[:, None], 0.0), found


def _best(entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = entropy.argmin(axis=1)
    if entropy.shape[1] < 2:
        return best, np.full(len(entropy), 1.0)
    two = np.partition(entropy, 1, axis=1)[:, :2]
    return best, two[:, 1] - two[:, 0]


def _curve(margin: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of being right over the margin, by Newton steps."""
    if not len(margin):
        return 0.0, 4.0
    x = np.stack([np.ones(len(margin)), margin], axis=1)
    y = (right * len(right) + 0.5) / (len(right) + 1)  # smoothed, so that a perfect fit stays finite
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w += np.linalg.solve(hess, x.T @ (y - p) - 1e-3 * w)
    return float(w[0]), float(max(w[1], 1e-3))


def identify(docs: DataFrame, folds: int = 3, held_fold: int = 1, reject_below: float = 0.0) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; languages of the held-out fold are never read."""
    spark = docs.sparkSession
    ship(spark)
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0).cast("int").alias("part")
    train = docs.where((id_remainder("doc_id", folds) != held_fold) & F.col("lang").isNotNull()).select("doc_id", "text", "lang", part)
    grams = materialise(corpus_counts(train), "language-counts")
    models = build(grams)
    forget(grams)
    if not models.langs:
        return docs.select(F.col("doc_id").cast("long"), (id_remainder("doc_id", folds) == held_fold).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    curve = _calibrated(models, train.where("part = 1")) if models.first else (0.0, 4.0)

    def run(batches):
        scorer = Scorer(models)
        names = np.array(models.langs, dtype=object)
        a, b = curve
        for pdf in batches:
            entropy, found = scorer.entropies(list(pdf["text"]))
            best, margin = _best(entropy)
            score = np.where(found, 1 / (1 + np.exp(-np.clip(a + b * margin, -30, 30))), 0.0)
            named = np.where(found & (score >= reject_below), names[best], "und")
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": named, "score": score})

    rows = docs.select("doc_id", "text", (id_remainder("doc_id", folds) == held_fold).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _calibrated(models: Models, unseen: DataFrame) -> tuple[float, float]:
    """The score curve from texts that the models have not seen, ``CURVE_ROWS`` ids at most."""

    def margins(batches):
        scorer = Scorer(models, 0)
        index = {x: i for i, x in enumerate(models.langs)}
        for pdf in batches:
            entropy, found = scorer.entropies(list(pdf["text"]))
            best, margin = _best(entropy)
            right = best == pdf["lang"].map(index).to_numpy()
            yield pd.DataFrame({"margin": margin[found], "right": right[found]})

    chosen = unseen.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS)
    seen = unseen.join(F.broadcast(chosen), "doc_id", "left_semi")  # CURVE_ROWS ids at most
    got = seen.mapInPandas(margins, "margin double, right boolean").groupBy(F.round("margin", 2).alias("margin"), "right").count().toPandas()
    got = got.sort_values(["margin", "right"])
    return _curve(np.repeat(got["margin"].to_numpy(), got["count"]), np.repeat(got["right"].to_numpy(dtype=float), got["count"]))
