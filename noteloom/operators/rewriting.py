"""Query variants: reading an expander's lines, the guard against drift, the fallback, and their cache."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

KINDS = ("lex", "vec", "hyde")
VARIANTS = "query_id string, list_no int, kind string, text string"


def variants(raw: str, query: str) -> list[tuple[str, str]]:
    """(kind, text) of lines "kind: text". Lines with template marks are dropped, and so are lex and vec lines that share no word of more than two bytes with the query."""
    words = [w.lower() for w in re.findall(r"[^\W_]+", query) if len(w.encode()) > 2]
    out = []
    for line in raw.splitlines():
        kind, colon, text = line.strip().partition(":")
        kind, text = kind.strip().lower(), text.strip()
        if not colon or kind not in KINDS or not text or "<|" in line:
            continue
        if kind != "hyde" and words and not any(w in text.lower() for w in words):
            continue
        out.append((kind, text))
    return out


def fallback(query: str) -> list[tuple[str, str]]:
    return [("hyde", f"Information about {query}"), ("lex", query), ("vec", query)]


def parsed(raw: Column, query: Column) -> Column:
    """The same over columns: array of (kind, text)."""
    words = F.transform(F.filter(F.split(query, r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 2), lambda w: ascii_lower(w))
    lines = F.transform(F.split(raw, r"\r?\n"), lambda x: F.trim(x))
    pair = lambda x: F.struct(ascii_lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))).alias("kind"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("text"))
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":")) & ~F.contains(x, F.lit("<|"))), pair)
    near = lambda p: (p["kind"] == "hyde") | (F.size(words) == 0) | F.exists(words, lambda w: F.contains(ascii_lower(p["text"]), w))
    return F.filter(pairs, lambda p: p["kind"].isin(*KINDS) & (p["text"] != "") & near(p))


def cache_key(query: str, identity: str) -> str:
    """Of a query and everything that shapes its expansion."""
    return hashlib.sha256(f"v1|{identity}|q={query}".encode()).hexdigest()


def expanded(spark: SparkSession, queries: dict[str, str], expander, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The variants of a batch, and the new rows (key, variants) for the cache. The batch is the caller's, so it is small."""
    keys = {q: cache_key(t, expander.identity) for q, t in queries.items()}
    known = {}
    if cache is not None:
        known = {r["key"]: [(v["kind"], v["text"]) for v in r["variants"]] for r in cache.where(F.col("key").isin(list(keys.values()))).collect()}
    rows, fresh = [], {}
    for q, text in queries.items():
        got = known.get(keys[q])
        if got is None:
            got = variants(expander.expand(text), text) or fallback(text)
            fresh[keys[q]] = got
        rows += [(str(q), n, kind, t) for n, (kind, t) in enumerate(got, 2)]
    new = spark.createDataFrame(list(fresh.items()), "key string, variants array<struct<kind string, text string>>")
    return spark.createDataFrame(rows, VARIANTS), new


def plan_lists(queries: DataFrame, more: DataFrame) -> DataFrame:
    """(query_id, list_no, kind, text, embedding): the original as words (0) and as a vector (1), then the variants."""
    q = F.col("query_id").cast("string").alias("query_id")
    none = F.lit(None).cast("array<float>")
    own = [queries.select(q, F.lit(n).alias("list_no"), F.lit(kind).alias("kind"), F.col("query").alias("text"), e.alias("embedding")) for n, kind, e in ((0, "lex", none), (1, "vec", F.col("embedding")))]
    return own[0].unionByName(own[1]).unionByName(more.select(q, "list_no", "kind", "text", "embedding"))
