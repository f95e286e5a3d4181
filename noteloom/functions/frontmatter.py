"""The frontmatter of notes: filters (created, source) and searchable fields of other producers.

A block counts only when the first line is three hyphens and a later line closes it. Per line the first colon
splits name and value; the first created and source win, without quotes around them. Any other field whose value is
JSON gives search text: its name, then names and scalars of the value, object fields in the order of their names.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

FIELD = StructType([StructField("key", StringType()), StructField("search_text", StringType())])
SHAPE = StructType([StructField("created", StringType()), StructField("source", StringType()), StructField("fields", ArrayType(FIELD))])
_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
_OWN = frozenset(("created", "status", "source", "para", "modified", "title"))


def block(text: str | None) -> list[str] | None:
    """The lines of a closed block, or None."""
    if not text:
        return None
    lines = text.split("\n")
    if lines[0].removesuffix("\r") != "---":
        return None
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip() == "---":
            return lines[1:i]
    return None


def _rendered(number: float | int) -> str:
    return json.dumps(number)


def terms(value: object) -> list[str]:
    """Names and scalars of a JSON value in a fixed order."""
    if value is None:
        return ["null"]
    if isinstance(value, bool):
        return ["true" if value else "false"]
    if isinstance(value, int | float):
        return [_rendered(value)]
    if isinstance(value, str):
        return value.split()
    if isinstance(value, list):
        return [t for v in value for t in terms(v)]
    return [t for k in sorted(value) for t in [*k.split(), *terms(value[k])]]


def search_text(key: str, raw: str) -> str | None:
    if not _KEY.fullmatch(key) or key in _OWN:
        return None
    try:
        value = json.loads(raw, parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
    except ValueError:
        return None
    return " ".join([key, *terms(value)])


def parse(text: str | None) -> dict:
    """created, source and fields of one note."""
    out: dict = {"created": None, "source": None, "fields": []}
    for line in block(text) or []:
        key, colon, raw = line.partition(":")
        key, raw = key.strip(), raw.strip()
        if not colon or not raw:
            continue
        if key in ("created", "source"):
            if out[key] is None:
                out[key] = raw.strip("\"'")
        elif (t := search_text(key, raw)) is not None:
            out["fields"].append({"key": key, "search_text": t})
    return out


@F.pandas_udf(SHAPE)
def parsed(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in texts], columns=["created", "source", "fields"])


def created_seconds(created: Column, mtime: Column, zone: str = "UTC") -> Column:
    """Epoch seconds of a local minute ("2024-05-01T10:30") that the zone has exactly once, else the mtime cut to seconds."""
    t = F.trim(created)
    ok = t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$")
    # read as UTC whatever the session's zone is, then shifted by the zone's offset a day before and a day after
    local = F.when(ok, F.unix_seconds(F.try_to_timestamp(F.concat(t, F.lit(":00+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))
    offset = lambda at: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), zone)) - F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), "UTC"))
    a, b = local - offset(local - 86400), local - offset(local + 86400)
    good_a, good_b = a + offset(a) == local, b + offset(b) == local
    once = F.when(good_a & good_b & (a != b), F.lit(None).cast("long")).when(good_a, a).when(good_b, b)
    return F.coalesce(once, mtime.cast("long"))


def with_frontmatter(notes: DataFrame, content: str = "content") -> DataFrame:
    """notes with created_raw, source and fields; one Python pass."""
    d = notes.withColumn("__f", parsed(F.col(content)))
    return d.select(*notes.columns, F.col("__f.created").alias("created_raw"), F.col("__f.source").alias("source"), F.col("__f.fields").alias("fields"))
