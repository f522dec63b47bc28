"""Many exact quotes in many texts.

An automaton over a block of quotes finds all of them in one scan of a text, so
words that many texts hold make no rows: only true matches leave a task. A block has
about ``BLOCK_CHARS`` characters of distinct quotes, which bounds what is broadcast and
the automaton (about 100 MB); more quotes take more scans. An equal quote under many ids is
searched once and joined to its ids afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import has_ellipsis, strip_quotes_once, text
from corpusmill.operators.frames import persisted

BLOCK_CHARS = 1_000_000


def searcher(strings: list[str]) -> Callable[[str], set[int]]:
    """The function from a text to the places of those ``strings`` that it holds."""
    try:
        import ahocorasick
    except ImportError:  # slower, and the same
        return lambda t: {k for k, s in enumerate(strings) if s in t}
    automaton = ahocorasick.Automaton()
    for k, s in enumerate(strings):
        automaton.add_word(s, k)
    automaton.make_automaton()
    return lambda t: {k for _, k in automaton.iter(t)} if strings else set()


def find_quotes(docs: DataFrame, quotes: DataFrame, doc_id: str, fields: list[str], quote_id: str, quote: str) -> DataFrame:
    """(doc_id, quote_id, source): quotes that a document holds word for word, by the rules of :func:`assessment.check_quote`.

    ``source`` is the first of ``fields`` that holds the quote. Blank quotes, quotes with
    an ellipsis and null texts match nothing; repeated rows of either side are repeated.
    """
    clean = strip_quotes_once(F.col(quote))
    asked = persisted(quotes.select(F.col(quote_id).alias("__quote"), clean.alias("__clean")).where((F.col("__clean") != "") & ~has_ellipsis(F.col("__clean"))))
    distinct = asked.select("__clean").distinct()
    chars = distinct.agg(F.coalesce(F.sum(F.length("__clean")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    own_type = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("__doc"), *[text(F.col(f"`{f}`")).alias(f"__f{k}") for k, f in enumerate(fields)])
    out = None
    for block in range(blocks):
        strings = [r["__clean"] for r in distinct.where(F.pmod(F.xxhash64("__clean"), F.lit(blocks)) == block).orderBy("__clean").collect()]  # about BLOCK_CHARS characters
        shipped = docs.sparkSession.sparkContext.broadcast(strings)

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            known = shipped.value
            find = searcher(known)
            for pdf in batches:
                found: list[tuple] = []
                for doc, *held in zip(pdf["__doc"], *[pdf[f"__f{k}"] for k in range(len(fields))], strict=True):
                    done: set[int] = set()
                    for name, value in zip(fields, held, strict=True):
                        new = find(value) - done
                        found += [(doc, known[k], name) for k in sorted(new)]
                        done |= new
                yield pd.DataFrame(found, columns=["__doc", "__clean", "source"])

        hits = texts.mapInPandas(run, f"__doc {own_type}, __clean string, source string")
        out = hits if out is None else out.unionByName(hits)
    joined = out.join(asked, "__clean")
    return joined.select(F.col("__doc").alias(doc_id), F.col("__quote").alias(quote_id), "source")
