"""Statistics of a whole text, for the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

WHITE = (9, 10, 11, 12, 13, 32)
SYMBOLS = tuple(b"#*$%&|<>")
ASCII_PUNCTUATION = tuple(b"!\"'(),-./:;?@[]^_`{}~")

#: Order of the columns of :func:`features`.
FEATURES = (
    "log_words",
    "mean_word_length",
    "symbol_ratio",
    "upper_ratio",
    "digit_ratio",
    "punctuation_ratio",
    "dup_line_ratio",
    "repeat_word_ratio",
    "top_word_ratio",
    "distinct_word_ratio",
    "stutter_ratio",
    "log_line_length",
)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if distinct < 2_000_000:
        keys = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:  # three ids no longer fit one word: number the pairs first
        pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * distinct + ids[2:]
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    hit = counts[back] > 1
    if not hit.any():
        return 0
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def describe(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space only, as bytes.split() does
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0), [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    points = len(raw) - int(seen[0x80:0xC0].sum())
    word_chars = points - int(seen[list(WHITE)].sum())
    symbols = int(seen[list(SYMBOLS)].sum())

    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))

    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    repeats = repeated_words(ids, len(number))
    per_word = max(1, word_chars)
    features = [
        float(np.log1p(n)),
        word_chars / n,
        symbols / per_word,
        int(seen[65:91].sum()) / per_word,
        int(seen[48:58].sum()) / per_word,
        int(seen[list(ASCII_PUNCTUATION)].sum()) / per_word,
        dup_lines / len(lines),
        repeats / n,
        int(np.bincount(ids).max()) / n,
        len(number) / n,
        float((ids[1:] == ids[:-1]).sum()) / n,
        float(np.log1p(word_chars / len(lines))),
    ]
    return (n, word_chars, symbols, dup_lines, repeats), features


def table(texts) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows of five) and features of many texts."""
    both = [describe(t) for t in texts]
    counts = np.array([b[0] for b in both], dtype=np.int64).reshape(-1, 5)
    features = np.array([b[1] for b in both], dtype=np.float64).reshape(-1, len(FEATURES))
    return counts, features
