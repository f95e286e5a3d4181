"""Models as interfaces, and deterministic stand-ins whose names say what they are.

No weights come with the package. A caller gives an object with these methods; it is called inside Arrow batches, and
loads what it needs on its first batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .functions.numbers import context_budget

#: What stands before a text, by its role.
DOCUMENT_PREFIX, QUERY_PREFIX = "title: none | text: ", "task: search result | query: "


class Embedder(Protocol):
    width: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row per text."""


class Reranker(Protocol):
    def score(self, queries: list[str], documents: list[str]) -> np.ndarray:
        """One logit per pair."""


class Expander(Protocol):
    identity: str

    def expand(self, query: str) -> str:
        """Lines of "lex: ...", "vec: ..." and "hyde: ..."."""


class HashedBagEmbedder:
    """A stand-in, no model: counts of hashed words, for tests and plans without weights."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.width] += 1.0 if h >> 63 else -1.0
        return out


class SharedWordsReranker:
    """A stand-in, no model: the log odds of the share of the query's words that the document holds."""

    def score(self, queries: list[str], documents: list[str]) -> np.ndarray:
        out = []
        for q, d in zip(queries, documents, strict=True):
            words, have = set(q.lower().split()), set(d.lower().split())
            share = (len(words & have) + 0.5) / (len(words) + 1)
            out.append(math.log(share / (1 - share)))
        return np.array(out)


class NoExpander:
    """A stand-in that gives no variant, so that the fallback is used."""

    identity = "none"

    def expand(self, query: str) -> str:
        return ""


def embed_column(model: Embedder, prefix: str = DOCUMENT_PREFIX):
    """A column function text -> unit vector; null for null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            ok = s.notna()
            m = model.embed([prefix + t for t in s[ok]]).astype(np.float32) if ok.any() else np.zeros((0, model.width), np.float32)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, n, out=m.copy(), where=n > 0)
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[ok] = pd.Series(list(m), index=s.index[ok])
            yield out

    return run


def rerank_column(model: Reranker):
    """A column function (query, document) -> logit."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in batches:
            yield pd.Series(model.score(q.fillna("").tolist(), d.fillna("").tolist()), index=q.index, dtype=float)

    return run


def fit_context(centre: str, before: list[str], after: list[str], budget: int, size=lambda t: math.ceil(len(t) / 3.5)) -> str:
    """The centre with as many neighbours as fit into the budget as one text, nearest first and the earlier of two equally near ones first.

    A neighbour that doesn't fit closes its side, so that none is skipped. A centre over the budget stays whole and alone.
    """
    kept = [centre]
    sides = {"before": iter(reversed(before)), "after": iter(after)} if size(centre) <= budget else {}
    while sides:
        for name in list(sides):
            more = next(sides[name], None)
            tried = [] if more is None else [more, *kept] if name == "before" else [*kept, more]
            if tried and size("\n\n".join(tried)) <= budget:
                kept = tried
            else:
                del sides[name]
    return "\n\n".join(kept)


def context_column(radius: int):
    """A column function over the window of a hit: array of (ord, body, centre) -> text within the budget."""
    from pyspark.sql.types import StringType

    budget = context_budget(radius)

    @F.pandas_udf(StringType())
    def run(windows: pd.Series) -> pd.Series:
        def one(w: list) -> str:
            rows = sorted(w, key=lambda r: r["ord"])
            at = next((i for i, r in enumerate(rows) if r["centre"]), 0)
            return fit_context(rows[at]["body"] or "", [r["body"] or "" for r in rows[:at]], [r["body"] or "" for r in rows[at + 1 :]], budget)

        return windows.map(one)

    return run
