"""Evaluation texts inside training texts (problem 8): a BM25 inverted index of the test items, searched by block-max WAND.

The items are indexed once: the postings of a term are the items that hold it, in order, each with the term's BM25
impact; blocks of items hold the largest impact of a term in the block. What is kept grows with the postings. Every
passage of every training text is a query, and all items that score the threshold or more come out:

* A passage is a window of ``run`` words; neighbouring windows that may reach the threshold are searched together, as
  one query of up to PASSAGE words. A window may reach it if its words' largest impacts anywhere add up to it.
* Each term of a query has a cursor in its postings. The lists, ordered by the items that their cursors are at, are added
  up by their largest impacts; the item at which the sum reaches the threshold is the pivot, no earlier item can reach it.
  If the block maxima at the pivot don't reach it either, the cursors jump behind the block, else they move up to
  the pivot, and an item that all lists before it have reached is scored in full. The cursors of many queries move
  together, as arrays; a query leaves when it has no pivot.
* Items above the threshold go to the exact check of consecutive words.

The threshold loses nothing: an item's impacts are divided by the smallest score that any run of ``run`` words of it
gives, so a passage that holds such a run scores 1 at least. Passages overlap by run - 1 words, so that every run lies
in one passage whole.

The test items are a stated set, far smaller than the corpus. They are broadcast in shards of at most
``shard_words`` words, one pass over the corpus per shard: 16 bytes per posting, some 32 MB for a full shard of
2,000,000 words. The corpus isn't shuffled.

Defined results: null or empty texts match nothing; an item of fewer words than ``run`` can't be held to leak;
repeated items are matched each by its own id; a text matches an item once, however often it holds it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 12
#: Words of a query at most, items of a block, and queries whose cursors move together.
PASSAGE, BLOCK, TOGETHER = 24, 16, 8_192
WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Sums of single-precision impacts may fall short of 1 by so much.
NEAR = 1 - 1e-4


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


class ItemIndex:
    """Postings of the items' terms; impacts are scaled so that 1 is each item's threshold."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, block: int = BLOCK):
        self.run, self.block = run, block
        kept = [(i, w) for i, t in sorted(items, key=lambda x: str(x[0])) if len(w := words(t or "")) >= run]
        self.ids = [i for i, _ in kept]
        self.terms: dict[str, int] = {}
        self.seqs = [np.array([self.terms.setdefault(x, len(self.terms)) for x in w], np.int32) for _, w in kept]
        self.n, self.blocks = len(kept), -(-len(kept) // block)
        df = Counter(t for s in self.seqs for t in set(s.tolist()))
        mean = sum(map(len, self.seqs)) / self.n if self.n else 1.0
        term, item, impact = [], [], []
        for k, s in enumerate(self.seqs):
            w = s.tolist()
            score = {t: math.log(1 + (self.n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            least = min(sum(score[t] for t in set(w[j : j + run])) for j in range(len(w) - run + 1))
            term += score
            item += [k] * len(score)
            impact += [x / least for x in score.values()]
        key = np.array(term, np.int64) * self.n + np.array(item, np.int64)
        order = np.argsort(key, kind="stable")
        #: Postings by term and item in one array of keys; a term's are those from first[term] on.
        self.key, self.impact = key[order], np.array(impact, np.float32)[order]
        self.first = np.searchsorted(self.key, np.arange(len(self.terms) + 1, dtype=np.int64) * max(self.n, 1))
        # one entry per term and block with a posting
        at = self.key // max(self.n, 1) * self.blocks + self.key % max(self.n, 1) // block if self.n else self.key
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if self.n else np.zeros(0, np.int64)
        self.block_key = at[start]
        self.block_max = np.maximum.reduceat(self.impact, start) if self.n else self.impact
        self.term_max = np.maximum.reduceat(self.impact, self.first[:-1]) if self.n else self.impact

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(text number, item id) of all pairs with a common run."""
        if not self.n:
            return []
        get, flat, owner, count = self.terms.get, [], [], []
        for k, t in enumerate(texts):
            w = words(t) if t else []
            if len(w) >= self.run:
                owner.append(k)
                count.append(len(w) + 1)
                flat += [get(x, -1) for x in w]
                flat.append(-1)  # nothing runs on over the end of a text
        if not owner:
            return []
        flat, count = np.array(flat, np.int32), np.array(count)
        # windows whose words are all of some item, and whose largest impacts reach the threshold
        impact = np.concatenate([self.term_max, np.zeros(1, np.float32)])[flat].astype(np.float64)
        total = np.concatenate([[0.0], np.cumsum(impact)])
        foreign = np.concatenate([[0], np.cumsum(flat < 0)])
        may = (total[self.run :] - total[: -self.run] >= NEAR) & (foreign[self.run :] == foreign[: -self.run])
        begin = np.flatnonzero(may)
        if not len(begin):
            return []
        # neighbouring windows as passages of up to PASSAGE words
        size = max(PASSAGE, self.run)
        fresh = np.concatenate([[True], np.diff(begin) != 1])
        stretch = np.maximum.accumulate(np.where(fresh, begin, 0))
        lead = fresh | ((begin - stretch) % (size - self.run + 1) == 0)
        lo = begin[lead]
        last = np.concatenate([np.flatnonzero(lead)[1:] - 1, [len(begin) - 1]])
        hi = begin[last] + self.run
        text = np.array(owner)[np.searchsorted(np.cumsum(count), lo, side="right")]
        found = set()
        for p in range(0, len(lo), TOGETHER):
            a, b = lo[p : p + TOGETHER], hi[p : p + TOGETHER]
            query = self._queries(flat, a, b, size)
            for q, k in self._wand(query):
                pair = (int(text[p + q]), self.ids[k])
                if pair not in found and self._holds(flat[a[q] : b[q]], k):
                    found.add(pair)
        return sorted(found, key=lambda x: (x[0], str(x[1])))

    def _queries(self, flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
        """The different terms of each passage in a row, -1 where there are fewer."""
        at = lo[:, None] + np.arange(size)
        q = np.where(at < hi[:, None], flat[np.minimum(at, len(flat) - 1)], -1)
        q.sort(axis=1)
        q[:, 1:][q[:, 1:] == q[:, :-1]] = -1
        return q

    def _wand(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(query, item) with a score of 1 or more."""
        n = np.int64(self.n)
        own = np.arange(len(query))
        live = query >= 0
        term = np.where(live, query, 0).astype(np.int64)
        most = np.where(live, self.term_max[term], 0).astype(np.float32)
        end = self.first[term + 1]
        cur = np.where(live, self.first[term], end)
        item = np.where(cur < end, self.key[np.minimum(cur, len(self.key) - 1)] - term * n, n)
        while len(own):
            # the lists in the order of the items they are at
            order = np.argsort(item, axis=1, kind="stable")
            reach = np.cumsum(np.take_along_axis(most, order, axis=1), axis=1) >= NEAR
            col = reach.argmax(axis=1)
            here = np.take_along_axis(item, order, axis=1)
            pivot = here[np.arange(len(own)), col]
            on = reach[:, -1] & (pivot < n)
            if not on.all():
                own, term, most, end, cur, item, pivot, here = (x[on] for x in (own, term, most, end, cur, item, pivot, here))
                if not len(own):
                    return
            upto = item <= pivot[:, None]
            # what the lists up to the pivot can give in its block
            r, c = np.nonzero(upto)
            k = term[r, c] * self.blocks + pivot[r] // self.block
            at = np.minimum(np.searchsorted(self.block_key, k), len(self.block_key) - 1)
            bound = np.bincount(r, weights=np.where(self.block_key[at] == k, self.block_max[at], 0), minlength=len(own))
            good = bound >= NEAR
            whole = good & (here[:, 0] == pivot)
            if whole.any():
                mine = whole[r] & (item[r, c] == pivot[r])
                score = np.bincount(r[mine], weights=self.impact[cur[r[mine], c[mine]]], minlength=len(own))
                for q in np.flatnonzero(whole & (score >= NEAR)):
                    yield int(own[q]), int(pivot[q])
            behind = np.minimum(np.where(upto, n, item).min(axis=1), (pivot // self.block + 1) * self.block)
            target = np.where(whole, pivot + 1, np.where(good, pivot, behind))
            move = item[r, c] < target[r]
            r, c = r[move], c[move]
            cur[r, c] = np.minimum(np.searchsorted(self.key, term[r, c] * n + np.minimum(target[r], n)), end[r, c])
            item[r, c] = np.where(cur[r, c] < end[r, c], self.key[np.minimum(cur[r, c], len(self.key) - 1)] - term[r, c] * n, n)

    def _holds(self, passage: np.ndarray, k: int) -> bool:
        windows = lambda s: {s[j : j + self.run].tobytes() for j in range(len(s) - self.run + 1)}
        return not windows(passage).isdisjoint(windows(self.seqs[k]))


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN, shard_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id): every document with every item of which it holds at least run consecutive words."""
    spark = docs.sparkSession
    clean = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(item_id, item_text).distinct()
    # words are at most half of the characters plus one, so this bounds them
    n = clean.agg(F.sum(F.length(item_text) / 2 + 1)).first()[0] or 0
    shards = max(1, math.ceil(n / shard_words))
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}[doc_id]
    ikind = {f.name: f.dataType.simpleString() for f in items.schema}[item_id]
    d = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("__d"), F.col(text).alias("__t"))
    schema = f"`{doc_id}` {kind}, `{item_id}` {ikind}"
    out = None
    for s in range(shards):
        # a shard's items, of at most about shard_words words; the index is made once and sent as it is
        part = clean.where(F.pmod(F.xxhash64(item_id), F.lit(shards)) == s).collect()
        held = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in part], run))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                ids, texts = b.column(0), b.column(1).to_pylist()
                for lo in range(0, len(texts), 512):
                    hits = index.search(texts[lo : lo + 512])
                    if hits:
                        first = ids.take(pa.array([lo + k for k, _ in hits]))
                        yield pa.RecordBatch.from_arrays([first, pa.array([i for _, i in hits], first.type if ikind == kind else None)], names=[doc_id, item_id])

        found = d.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct() if shards > 1 else out
