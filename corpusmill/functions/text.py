"""Text expressions. Blank and null are the same thing everywhere.

White space and case are Unicode-aware: ``(?U)`` patterns, since Spark's trim and
``\\s`` know ASCII only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing DOI or URL.
PLACEHOLDERS = ("", "-", "n/a", "na", "none", "null", "unavailable")

#: Words that carry no content in a question or a full form.
STOPWORDS = frozenset("a an and are as at be been being by do does did for from how in is it of on or that the their these this those to was were what when where which who why with within under among between can could should would used using use".split())


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The value as a string, blank for null."""
    return F.coalesce(_column(c).cast("string"), F.lit(""))


def ustrip(c: Column | str) -> Column:
    """Without Unicode white space at both ends; null stays null.

    One match of the whole string, which looks back from its end: to try each place in
    turn for white space up to the end takes longer, and the square of a run of spaces.
    """
    return F.regexp_replace(_column(c), r"(?Us)\A\s*+(.*\S)?\s*+\z", "$1")


def stripped(c: Column | str) -> Column:
    """ustrip with null as blank."""
    return ustrip(text(c))


def has_value(c: Column | str) -> Column:
    """Neither null nor blank; the search ends at the first character that is no white space."""
    return F.coalesce(_column(c).cast("string").rlike(r"(?U)\S"), F.lit(False))


def norm_dedup(c: Column | str) -> Column:
    """Matching key text: stripped, lower case, white space runs as one space.

    Texts of ASCII only take the plain patterns, which are several times faster.
    """
    s = text(c)
    plain = F.regexp_replace(F.lower(F.btrim(s, F.lit(" \t\n\x0b\f\r"))), r"\s+", " ")
    wide = F.regexp_replace(F.lower(ustrip(s)), r"(?U)\s+", " ")
    return F.when(F.length(s) == F.octet_length(s), plain).otherwise(wide)


def norm_casefold(c: Column | str) -> Column:
    """Without regard to case (ß is ss, both small sigmas and both small s are one), white space runs as one space."""
    low = F.translate(F.replace(F.lower(ustrip(text(c))), F.lit("ß"), F.lit("ss")), "ςſ", "σs")
    return F.regexp_replace(low, r"(?U)\s+", " ")


def norm_query(c: Column | str) -> Column:
    """Lower case, every run of other characters than letters and digits as one space."""
    return ustrip(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]+", " "))


def clean_term(c: Column | str) -> Column:
    """A search term without quotes, then brackets and punctuation, around it; ``_`` as a space."""
    spaced = F.regexp_replace(F.replace(text(c), F.lit("_"), F.lit(" ")), r"(?U)\s+", " ")
    bare = F.btrim(F.btrim(spaced, F.lit(" \t\r\n'\"")), F.lit(" ()[]{}.,;:!?—–"))
    return bare


def unify_newlines(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"\r\n?", "\n")


def source_id(c: Column | str) -> Column:
    """Row ids as text: ``12.0`` is ``12``."""
    s = stripped(c)
    return F.when(s.rlike(r"^[+-]?\d+\.0+$"), F.regexp_replace(s, r"\.0+$", "")).otherwise(s)


def strip_quotes_once(c: Column | str) -> Column:
    """One pair of straight or curly quotes around the text removed."""
    s = stripped(c)
    wrapped = s.rlike("(?s)^(?:\".*\"|'.*'|“.*”|‘.*’)$") & (F.length(s) >= 2)
    return F.when(wrapped, ustrip(s.substr(F.lit(2), F.greatest(F.length(s) - 2, F.lit(0))))).otherwise(s)


def strip_quotes(c: Column | str, passes: int = 4) -> Column:
    """Nested quote pairs removed, ``passes`` deep; a loop over a lambda variable keeps the plan small."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), stripped(c), lambda s, _: strip_quotes_once(s))


def has_ellipsis(c: Column | str) -> Column:
    return text(c).contains("...") | text(c).contains("…")


def excel_safe(c: Column | str) -> Column:
    """A leading formula sign is disarmed by an apostrophe."""
    s = text(c)
    return F.when(s.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), s)).otherwise(s)


def file_name(c: Column | str) -> Column:
    """Characters that file systems reserve become underscores."""
    return F.regexp_replace(stripped(c), r'[<>:"/\\|?*\x00-\x1f]+', "_")


def slug(c: Column | str, length: int = 40) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.substring(s, 1, length)


def evidence_texts(c: Column | str) -> Column:
    """Sentences and lines of a text, in order, each stripped, none empty."""
    parts = F.split(text(c), r"(?U)(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, ustrip), lambda x: x != "")


def evidence_units(title: Column | str, abstract: Column | str) -> Column:
    """array<struct<evidence_id, source, text>>: ids number the units of each source."""

    def of(name: str, c: Column | str) -> Column:
        return F.transform(evidence_texts(c), lambda x, i: F.struct(F.format_string(f"{name}_%03d", i + 1).alias("evidence_id"), F.lit(name).alias("source"), x.alias("text")))

    return F.concat(of("title", title), of("abstract", abstract))


def criteria_entries(c: Column | str) -> Column:
    """Entries of a criteria block, without bullets and numbers, none empty."""
    parts = F.split(text(c), r"[;\r\n]+")
    bare = F.transform(parts, lambda x: ustrip(F.regexp_replace(ustrip(x), r"^(?:[-*•]+|\(?\d+[.)])\s*", "")))
    return F.filter(bare, lambda x: x != "")


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def singular(t: Column) -> Column:
    """Plural endings of a token taken off: ies, es, s (not ss)."""
    n = F.length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & t.endswith("es"), t.substr(F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )


def token_line(c: Column | str) -> Column:
    """Singular tokens between single spaces, with one at both ends."""
    return F.concat(F.lit(" "), F.array_join(F.transform(tokens(c), singular), " "), F.lit(" "))


def contains_term(haystack: Column | str, term: Column | str, line: Column | None = None) -> Column:
    """Whether the term's tokens occur in a row, plural or not."""
    needle = token_line(term)
    return (F.length(needle) > 2) & (line if line is not None else token_line(haystack)).contains(needle)


def group_covered(haystack: Column | str, terms: Column) -> Column:
    """Whether any of an array of terms occurs."""
    line = token_line(haystack)
    return F.exists(terms, lambda t: contains_term(haystack, t, line))


def prefix_base(a: Column, b: Column) -> Column:
    """Stem that a wildcard can follow if the terms differ by a plural of the last word, else null.

    Words before the last must be equal; a stem of several words keeps them.
    """

    def stem(one: Column, many: Column) -> Column:
        low, high = F.lower(one), F.lower(many)
        head = r"^(?:.* )?"
        same_head = F.regexp_extract(one, head, 0) == F.regexp_extract(many, head, 0)
        cut = one.substr(F.lit(1), F.length(one) - 1)
        # few pairs differ by a plural, so the heads are compared last
        return F.when((high == F.concat(low, F.lit("s"))) & same_head, one).when(low.endswith("y") & (high == F.concat(F.lower(cut), F.lit("ies"))) & same_head, cut)

    return F.coalesce(stem(a, b), stem(b, a))


def dehyphenate(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"(?<=\w)-(?=\w)", " ")


def initials(c: Column | str) -> Column:
    """First letters of the words that count for an acronym."""
    words = F.filter(F.regexp_extract_all(text(c), F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: ~F.lower(w).isin(*sorted(STOPWORDS)))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def acronym_matches(full: Column | str, acronym: Column | str) -> Column:
    """A short form whose letters are the initials of 2 to 8 content words."""
    letters = initials(full)
    short = F.regexp_replace(F.upper(text(acronym)), "-", "")
    return text(acronym).rlike("^[A-Z][A-Z0-9-]{1,9}$") & F.length(letters).between(2, 8) & (letters == short)


def one_edit(a: Column | str, b: Column | str) -> Column:
    """Equal but for one insertion, deletion, substitution or swap of neighbours."""
    x, y = text(a), text(b)
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.lit(1)), x.substr(i, F.lit(1)), x.substr(i + 2, F.length(x))) == y)
    return (F.levenshtein(x, y) == 1) | ((F.length(x) == F.length(y)) & (F.length(x) > 1) & (x != y) & swap)


def first_value(columns: list[str], placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """First of the columns that holds more than a placeholder, else blank."""
    tries = [F.when(~F.lower(stripped(F.col(f"`{c}`"))).isin(*placeholders), stripped(F.col(f"`{c}`"))) for c in columns]
    return F.coalesce(*tries, F.lit(""))


def canonical_doi(c: Column | str) -> Column:
    """Without a resolver or ``doi:`` in front; placeholders are blank; case stays."""
    s = stripped(c)
    bare = stripped(F.regexp_replace(s, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi\s*:\s*)", ""))
    return F.when(F.lower(s).isin(*PLACEHOLDERS) | F.lower(bare).isin(*PLACEHOLDERS), F.lit("")).otherwise(bare)


def canonical_url(url: Column | str, doi: Column | None = None) -> Column:
    """Placeholders and bare resolvers are blank; then the link of a canonical DOI."""
    s = stripped(url)
    own = F.when(F.lower(s).isin(*PLACEHOLDERS) | s.rlike(r"(?i)^https?://(?:dx\.)?doi\.org/?$"), F.lit("")).otherwise(s)
    if doi is None:
        return own
    return F.when(own != "", own).when(text(doi) != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column | str, words: list[str]) -> Column:
    """Lower-cased text holds any of the words."""
    low = F.lower(text(c))
    return any_of([low.contains(w) for w in words])
