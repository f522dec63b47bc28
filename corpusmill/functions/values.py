"""Numbers, dates, JSON and hashes.

ANSI mode is on, so every conversion is a ``try_`` one with a stated default.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_term, stripped, text

#: Confidence of a triage decision by its risk.
RISK_CONFIDENCE = {"LOW": 0.95, "BORDERLINE": 0.75, "HIGH": 0.5}
#: Seconds to wait at each throttle level.
THROTTLE_SECONDS = (60, 120, 300, 600, 900, 1800)
#: Shapes of a span of time, each of which must be the whole text.
YEAR = r"(?:19|20)\d{2}"
TEMPORAL_SHAPES = (
    rf"{YEAR}(?:\s*(?:-|–|—|/|to|and)\s*(?:19|20)?\d{{2}})?",
    r"\d{1,4}\s+(?:days?|weeks?|months?|years?|hours?|minutes?)",
    r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
    rf"(?:before|after|during)\s+{YEAR}",
)


def safe_int(c: Column | str) -> Column:
    """A whole number of 0 or more; 0 for anything else."""
    return F.greatest(F.lit(0), F.coalesce(text(c).try_cast("double").try_cast("int"), F.lit(0)))


def finite_or(c: Column, default: float | None) -> Column:
    """The number, or the default if it is null, NaN or infinite."""
    n = c.try_cast("double")
    bad = n.isNull() | F.isnan(n) | (F.abs(n) == F.lit(float("inf")))
    return F.when(bad, F.lit(default).cast("double")).otherwise(n)


def to_number(c: Column | str, default: float = -1.0) -> Column:
    return F.coalesce(stripped(c).try_cast("double"), F.lit(default))


def ratio(part: Column, whole: Column, empty: float | None = None, places: int = 4) -> Column:
    """part / whole, rounded; ``empty`` where whole is 0."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(F.round(part.cast("double") / whole.cast("double"), places))


def risk_confidence(c: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RISK_CONFIDENCE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(stripped(c))), F.lit(0.5))


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Estimated time left; null before anything is done."""
    return F.when(done > 0, elapsed / done * F.greatest(total - done, F.lit(0)))


def progress_percent(done: Column, total: Column) -> Column:
    """Whole percent, at most 100; 100 if there is nothing to do."""
    return F.when(total > 0, F.least(F.lit(100), F.round(done * 100 / total))).otherwise(100).cast("int")


def throttle_seconds(level: Column) -> Column:
    ladder = F.array(*[F.lit(s) for s in THROTTLE_SECONDS])
    return F.get(ladder, F.least(F.greatest(F.coalesce(level, F.lit(1)) - 1, F.lit(0)), F.lit(len(THROTTLE_SECONDS) - 1)).cast("int"))


def is_temporal(c: Column | str) -> Column:
    """Whether all of a term is a span of time: years, a duration, a date."""
    return clean_term(c).rlike("(?i)^(?:" + "|".join(TEMPORAL_SHAPES) + ")$")


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def unfence(c: Column | str) -> Column:
    """Without a Markdown code fence around it."""
    s = stripped(c)
    inner = F.regexp_extract(s, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(s.rlike(r"(?is)^```(?:json)?\s*.*?\s*```$"), inner).otherwise(s)


def json_object(c: Column | str, schema) -> Column:
    """A model's answer as a struct; null if it is no JSON object."""
    bare = unfence(c)
    return F.when(bare.startswith("{"), F.from_json(bare, schema))


def json_field(c: Column | str, name: str) -> Column:
    """One field of a JSON object as text; blank if there is none."""
    return F.coalesce(stripped(F.get_json_object(text(c), f"$.{name}")), F.lit(""))


def json_safe(c: Column) -> Column:
    return finite_or(c, None)


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def row_fingerprint(columns: list[str]) -> Column:
    """Hash of named values in column order, blank for null; separators cannot occur in hex."""
    return F.sha2(F.concat_ws("|", *[F.sha2(text(F.col(f"`{c}`")).cast("binary"), 256) for c in columns]).cast("binary"), 256)


def seed_number(c: Column) -> Column:
    """First 32 bits of a text's SHA-256 as a number."""
    return F.conv(F.substring(sha256(c), 1, 8), 16, 10).cast("bigint")


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a over code points."""
    points = F.transform(F.filter(F.split(text(c), ""), lambda x: x != ""), F.ascii)
    step = lambda h, p: F.pmod(h.bitwiseXOR(p.cast("bigint")) * F.lit(16777619), F.lit(2**32))
    return F.lpad(F.lower(F.hex(F.aggregate(points, F.lit(2166136261).cast("bigint"), step))), 8, "0")


def identity(payload: dict, length: int = 64) -> str:
    """Id of a configuration: hash of its JSON with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:length]
