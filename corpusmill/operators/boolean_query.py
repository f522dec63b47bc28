"""Concept groups: rules, compiled search strings for five platforms, evaluation on a corpus."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_term, group_covered, norm_query, prefix_base, text
from corpusmill.operators.frames import persisted

PLATFORMS = ("google_scholar", "scopus", "web_of_science", "ieee_xplore", "pubmed")
#: Tokens of the groups that every task holds at once.
MAX_INDEX = 1_000_000
MAX_GROUPS, MAX_TERMS, OPEN_TERMS = 8, 8, 5


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _distinct_terms(terms: Column) -> Column:
    """Cleaned terms, first of each normalised key, none blank."""
    cleaned = F.transform(F.transform(terms, clean_term), lambda t: F.struct(t.alias("t"), norm_query(t).alias("k")))

    def firsts(pairs: Column) -> Column:
        return _once(F.transform(pairs, lambda p: p["k"]), lambda keys: F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))

    return F.transform(_once(F.filter(cleaned, lambda p: p["k"] != ""), firsts), lambda p: p["t"])


def _render(term: Column, prefix: bool, pubmed: bool) -> Column:
    plain = F.concat(F.replace(term, F.lit('"'), F.lit("")), F.lit("*" if prefix else ""))
    quoted = F.concat(F.lit('"'), plain, F.lit('"'))
    out = F.when(plain.contains(" "), quoted).otherwise(plain) if prefix else quoted
    return F.concat(out, F.lit("[tiab]")) if pubmed else out


def _wildcards(clean: Column) -> Column:
    """struct<stems, rest> of distinct terms: plural pairs become one stem each, what no pair uses is the rest."""
    # left to right: a term that is used up by an earlier pair neither leads nor follows
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("stems"))
    places = F.transform(clean, lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def parts(places: Column) -> Column:
        def step(acc: Column, left: Column) -> Column:
            # a later term pairs with this one even if an earlier pair took it
            hits = F.filter(F.transform(F.slice(places, left["i"] + 2, F.size(places)), lambda r: F.struct(r["i"].alias("i"), prefix_base(left["t"], r["t"]).alias("stem"))), lambda x: x["stem"].isNotNull())
            paired = _once(F.get(hits, F.lit(0)), lambda hit: F.when(hit.isNotNull(), F.struct(F.concat(acc["used"], F.array(left["i"], hit["i"])).alias("used"), F.concat(acc["stems"], F.array(hit["stem"])).alias("stems"))).otherwise(acc))
            return F.when(F.array_contains(acc["used"], left["i"]), acc).otherwise(paired)

        def split(done: Column) -> Column:
            rest = F.transform(F.filter(places, lambda p: ~F.array_contains(done["used"], p["i"])), lambda p: p["t"])
            return F.struct(done["stems"].alias("stems"), rest.alias("rest"))

        return _once(F.aggregate(places, start, step), split)

    return _once(places, parts)


def _joined(shown: Column) -> Column:
    """``(a OR b)``; blank without terms."""
    return F.when(F.size(shown) > 0, F.concat(F.lit("("), F.array_join(shown, " OR "), F.lit(")"))).otherwise("")


def _scholar_block(clean: Column) -> Column:
    return _joined(F.transform(F.slice(clean, 1, MAX_TERMS), lambda t: _render(t, False, False)))


def _open_block(parts: Column, pubmed: bool) -> Column:
    """Wildcards, before the rest."""
    return _joined(F.slice(F.concat(F.transform(parts["stems"], lambda t: _render(t, True, pubmed)), F.transform(parts["rest"], lambda t: _render(t, False, pubmed))), 1, OPEN_TERMS))


def _query(blocks: Column, platform: str) -> Column:
    query = F.array_join(F.filter(blocks, lambda b: b != ""), " AND ")
    return {"scopus": F.concat(F.lit("TITLE-ABS-KEY("), query, F.lit(")")), "web_of_science": F.concat(F.lit("TS=("), query, F.lit(")"))}.get(platform, query)


def _compiled(groups: Column, platforms: tuple[str, ...]) -> Column:
    """array<struct<platform, query>>: terms are cleaned once for all platforms, and paired once."""

    def of(clean: Column) -> Column:
        scholar = F.transform(clean, _scholar_block)

        def queries(parts: Column | None) -> Column:
            blocks = lambda p: scholar if p == "google_scholar" else F.transform(parts, lambda g: _open_block(g, p == "pubmed"))
            return F.array(*[F.struct(F.lit(p).alias("platform"), _query(blocks(p), p).alias("query")) for p in platforms])

        return queries(None) if set(platforms) == {"google_scholar"} else _once(F.transform(clean, _wildcards), queries)

    return _once(F.transform(F.slice(groups, 1, MAX_GROUPS), _distinct_terms), of)


def compile_query(groups: Column, platform: str) -> Column:
    """AND of the OR blocks of the first eight groups (array<array<string>>)."""
    return F.get(_compiled(groups, (platform,)), F.lit(0))["query"]


def compile_bundle(concepts: DataFrame, keys: tuple[str, ...] = (), platforms: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """version, platform, query (and ``keys``) of concepts (label, balanced_terms, high_recall_terms)."""
    versions = {"balanced": "balanced_terms", "high_recall": "high_recall_terms"}
    terms = lambda field: F.transform("concepts", lambda c: c[field])
    rows = F.concat(*[F.transform(_compiled(terms(f), platforms), lambda q: F.struct(F.lit(v).alias("version"), q["platform"].alias("platform"), q["query"].alias("query"))) for v, f in versions.items()])
    return concepts.select(*keys, F.explode(rows).alias("q")).select(*keys, "q.*")


def proposal_errors(concepts: Column, question: Column | str) -> Column:
    """Broken rules of a concept proposal, in order; empty if it is sound."""
    norms = lambda terms: F.transform(terms, norm_query)
    malformed = lambda t: (clean_term(t) == "") | (F.length(clean_term(t)) > 160) | (clean_term(t) != F.trim(t)) | (norm_query(t) == "")
    bad_list = lambda terms: F.exists(terms, malformed) | (F.size(F.array_distinct(norms(terms))) < F.size(terms)) | ~F.size(terms).between(1, MAX_TERMS)
    labels = F.transform(concepts, lambda c: norm_query(c["label"]))
    every = F.flatten(F.transform(concepts, lambda c: F.concat(c["balanced_terms"], c["high_recall_terms"])))
    rules = [
        (~F.size(concepts).between(2, 5), "two to five concepts"),
        (F.exists(concepts, lambda c: (clean_term(c["label"]) == "") | (clean_term(c["label"]) != F.trim(c["label"])) | (F.length(c["label"]) > 60)), "clean labels"),
        ((F.size(F.array_distinct(labels)) < F.size(labels)) | F.array_contains(labels, ""), "unique labels"),
        (F.exists(concepts, lambda c: bad_list(c["balanced_terms"]) | bad_list(c["high_recall_terms"])), "clean, distinct terms"),
        (F.exists(concepts, lambda c: F.size(F.array_except(norms(c["balanced_terms"]), norms(c["high_recall_terms"]))) > 0), "high recall holds every balanced term"),
        (~F.exists(concepts, lambda c: F.size(F.array_except(norms(c["high_recall_terms"]), norms(c["balanced_terms"]))) > 0), "high recall adds a term"),
        ((norm_query(question) != "") & F.exists(every, lambda t: norm_query(t) == norm_query(question)), "no term is the whole question"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in rules]), lambda x: x.isNotNull())


def matches(body: Column | str, groups: list[list[str]], tokens: bool = False) -> Column:
    """Boolean query as a predicate: every group has a term in the text (lower case, or by tokens)."""
    low = F.lower(text(body))
    if tokens:
        return reduce(lambda a, b: a & b, [group_covered(body, F.array(*[F.lit(t) for t in g])) for g in groups], F.lit(True))
    any_ = lambda g: reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in g], F.lit(False))
    return reduce(lambda a, b: a & b, [any_(g) for g in groups], F.lit(True))


def _tokens(df: DataFrame, key: str) -> DataFrame:
    words = F.array_distinct(F.flatten(F.transform("terms", lambda t: F.split(norm_query(t), " "))))
    return df.select(key, F.filter(words, lambda w: w != "").alias("toks"))


def best_overlap(drafts: DataFrame, groups: DataFrame) -> DataFrame:
    """For each draft (draft_id, terms) the group (group_id, terms) that shares the most tokens; ties to the smaller id.

    Groups of about ``MAX_INDEX`` tokens in all become an inverted index that every
    task holds, so a word that all drafts and groups have makes no rows. More groups
    make more such blocks, each of which is one more pass over the drafts; a draft keeps
    its best group of every block, and the best of those is its answer.
    """
    mine = _tokens(drafts, "draft_id")
    theirs = _tokens(groups, "group_id").groupBy("group_id").agg(F.array_distinct(F.flatten(F.collect_list("toks"))).alias("toks"))
    theirs = persisted(theirs)
    size = theirs.agg(F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // MAX_INDEX))
    parts = [_best_of(mine, theirs.where(F.pmod(F.xxhash64("group_id"), F.lit(blocks)) == k)) for k in range(blocks)]
    if blocks == 1:
        return parts[0]
    best = reduce(DataFrame.unionByName, parts).groupBy("draft_id").agg(F.min(F.struct((-F.col("overlap")).alias("minus"), F.col("group_id").isNull().alias("none"), "group_id")).alias("b"))
    return best.select("draft_id", "b.group_id", (-F.col("b.minus")).alias("overlap"))


def _best_of(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """The best group of a block for each draft, by an index of the block."""
    rows = sorted((r["group_id"], r["toks"]) for r in theirs.collect())  # MAX_INDEX tokens, about
    index: dict[str, list[int]] = {}
    for k, (_, toks) in enumerate(rows):
        for t in toks:
            index.setdefault(t, []).append(k)
    shipped = mine.sparkSession.sparkContext.broadcast(({t: np.array(v) for t, v in index.items()}, [g for g, _ in rows]))

    def run(batches):
        places, ids = shipped.value
        for pdf in batches:
            found = []
            for toks in pdf["toks"]:
                hits = [places[t] for t in toks if t in places]
                n = np.bincount(np.concatenate(hits), minlength=len(ids)) if hits else np.zeros(1, dtype=int)
                found.append((ids[int(n.argmax())] if hits else None, int(n.max())))
            yield pd.DataFrame({"draft_id": pdf["draft_id"], "group_id": pd.array([g for g, _ in found], dtype="Int64"), "overlap": [n for _, n in found]})

    return mine.mapInPandas(run, "draft_id long, group_id long, overlap int")


def coverage(required: Column, offered: Column) -> Column:
    """Share of the required tokens that the offered ones hold; 1 if none are required."""
    return F.when(F.size(F.array_distinct(required)) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(required, offered)) / F.size(F.array_distinct(required)))
