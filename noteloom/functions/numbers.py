"""Scores, vectors, durations and identities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds per unit of a relative duration; m is a month of 30 days, y a year of 365.
UNITS = {"": 86_400, "d": 86_400, "s": 1, "min": 60, "h": 3_600, "w": 604_800, "m": 2_592_000, "y": 31_536_000}


def duration(text: str) -> int:
    """Seconds of "10h", "5d", "3m", "1y", "90s", "30min", "2w" or a bare number of days; ValueError otherwise."""
    m = re.fullmatch(r"([0-9]+)([A-Za-z]*)", text.strip())
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a duration: {text!r}")
    n = int(m[1]) * UNITS[m[2].lower()]
    if n >= 2**63:
        raise ValueError(f"duration too large: {text!r}")
    return n


def cutoff(now: int, text: str) -> int:
    """now minus a duration, never below the smallest 64-bit number."""
    return max(now - duration(text), -(2**63))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, in the vectors' order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v)


def usable(v: Column, width: int) -> Column:
    """Right width, all finite, not all zero."""
    return v.isNotNull() & (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def relevance(cosine: Column) -> Column:
    """A finite cosine held to [0, 1]; null when there is none."""
    bad = cosine.isNull() | F.isnan(cosine) | (F.abs(cosine) == float("inf"))
    return F.when(~bad, F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine.cast("double"))))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def percent(score: Column, top: Column) -> Column:
    """Score relative to the top one, as a whole percentage within 0 to 100."""
    p = F.round(100.0 * score.cast("double") / F.greatest(top.cast("double"), F.lit(1.1920929e-07)))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), p)).cast("int")


def chunk_id(path: Column, ord_: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("#"), ord_.cast("string")), 256)


def vector_key(id_: Column) -> Column:
    """The first 16 hex digits, which compare as the unsigned 64-bit number does."""
    return F.substring(id_, 1, 16)


def context_budget(radius: int) -> int:
    """Tokens that a reranker reads with radius chunks on either side."""
    if not 0 <= radius <= 2:
        raise ValueError("context radius must be 0, 1 or 2")
    return 512 if radius == 0 else min(1024 * (2 * radius + 1), 8192)
