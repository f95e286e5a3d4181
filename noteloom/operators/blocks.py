"""BM25 of plain queries, block by block, for batches of queries that grow with the chunks.

The scores of all pairs of a query and a chunk that share a word grow as the product of both, so they are never rows.
The batch's words are looked up in each text (its words don't move), which leaves a short row per chunk; a block of
chunks scores every query in memory and gives its k best per query as numbers. Ids come in again for what is best over
all blocks. Scores are those of ``lexical.weighted``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..session import written

K1, B = 1.2, 0.75
#: Chunks that are scored at once.
BLOCK = 1 << 17


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def _stems(words: pa.Array, known) -> pa.Array:
    d = words.dictionary_encode()
    return pa.array([known(w) for w in d.dictionary.to_pylist()], pa.string()).take(d.indices)


def found(texts: DataFrame, words: pa.Array, stems: bool) -> DataFrame:
    """(id, lens, slots, tfs): the lengths of a chunk's fields, and which of the words are in it how often. texts has id and a list of words per field; a slot is a word and a field."""
    fields = len(texts.columns) - 1
    held = texts.sparkSession.sparkContext.broadcast(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 18)(stem)
        for b in batches:
            n, lens, rows, slots = b.num_rows, np.zeros((b.num_rows, fields), np.int64), [], []
            for f in range(fields):
                lens[:, f] = np.asarray(b.column(f + 1).value_lengths().fill_null(0))
                flat = b.column(f + 1).flatten()
                at = pc.index_in(_stems(flat, known) if stems else flat, value_set=held.value)
                hit = np.flatnonzero(np.asarray(at.is_valid()))
                rows.append(np.repeat(np.arange(n), lens[:, f])[hit])
                slots.append(np.asarray(at.fill_null(0))[hit].astype(np.int64) * fields + f)
            width = max(1, len(held.value) * fields)
            both, tf = np.unique(np.concatenate(rows) * width + np.concatenate(slots), return_counts=True)
            row, slot = np.divmod(both, width)
            ends = np.searchsorted(row, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), lists(np.arange(n + 1) * fields, lens.ravel()), lists(ends, slot), lists(ends, tf)], names=["id", "lens", "slots", "tfs"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(scan, f"id {kind}, lens array<int>, slots array<int>, tfs array<int>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def best(docs: DataFrame, fields: int, terms: pa.Table, words: pa.Array, k: int) -> DataFrame:
    """(query_id, id, score) of the k best per query, and of those that are equal to the last. docs is what ``found`` gives, once per id, with a number (no)."""
    spark = docs.sparkSession
    # one row, and one per slot
    sums = docs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("lens")[f]).alias(f"s{f}") for f in range(fields)]).first()
    df = np.zeros(len(words) * fields)
    for r in docs.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect():
        df[r.slot] = r["count"]
    idf, avg = np.log(1 + (sums.n - df + 0.5) / (df + 0.5)), np.array([(sums[f"s{f}"] or 0) / max(sums.n, 1) for f in range(fields)])
    q, t = terms["query_id"].combine_chunks().dictionary_encode(), np.asarray(pc.index_in(terms["term"].combine_chunks(), value_set=words))
    code = np.asarray(q.indices)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(q.dictionary) + 1))
    held = spark.sparkContext.broadcast((q.dictionary, starts, t[order].astype(np.int64), idf, avg))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, asked, idf, avg = held.value
        #: The k best scores of each query so far, and the least of them: what lies below is never among the best.
        so_far, least = [np.zeros(0, np.int64)] * len(names), np.full(len(names), -1, np.int64)
        for block in _blocks(batches):
            block = block.take(pc.sort_indices(block["id"]))
            n, no = block.num_rows, np.asarray(block["no"])
            lens = np.asarray(block["lens"].combine_chunks().flatten(), np.float64)
            each = block["slots"].combine_chunks()
            slot, tf = np.asarray(each.flatten(), np.int64), np.asarray(block["tfs"].combine_chunks().flatten(), np.float64)
            doc = np.repeat(np.arange(n), np.asarray(each.value_lengths()))
            f = slot % fields
            w = idf[slot] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[doc * fields + f] / avg[f]))
            order = np.argsort(slot, kind="stable")
            doc, v = doc[order], np.floor(w * 1e9 + 0.5).astype(np.int64)[order]
            begin = np.searchsorted(slot[order], np.arange(len(idf) + 1))
            total, seen = np.zeros(n, np.int64), np.zeros(n, bool)
            who, what, much = [], [], []
            for i in range(len(names)):
                parts = []
                for s in (asked[starts[i] : starts[i + 1], None] * fields + np.arange(fields)).ravel():
                    if (a := begin[s]) < (b := begin[s + 1]):
                        d = doc[a:b]
                        total[d] += v[a:b]
                        parts.append(d[~seen[d]])
                        seen[d] = True
                if parts:
                    at = np.concatenate(parts)
                    s = total[at]
                    total[at], seen[at] = 0, False
                    keep = s >= least[i]
                    at, s = at[keep], s[keep]
                    if len(at) > k:  # rows are in the order of their ids, which decides among equals
                        last = np.partition(s, -k)[-k]
                        over, same = np.flatnonzero(s > last), np.flatnonzero(s == last)
                        take = np.concatenate([over, same[np.argsort(at[same])[: k - len(over)]]])
                        at, s = at[take], s[take]
                    so_far[i] = np.concatenate([so_far[i], s])
                    if len(so_far[i]) >= k:
                        so_far[i] = np.partition(so_far[i], -k)[-k:]
                        least[i] = so_far[i].min()
                    who.append(np.full(len(at), i))
                    what.append(no[at])
                    much.append(s)
                if who and (len(who) >= 1024 or i == len(names) - 1):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(who))), pa.array(np.concatenate(what)), pa.array(np.concatenate(much))], names=["query_id", "no", "s"])
                    who, what, much = [], [], []

    kind = pa_type(terms.schema.field("query_id").type)
    few = 2 * spark.sparkContext.defaultParallelism
    d = docs.select("id", "no", "lens", "slots", "tfs")
    d = d.coalesce(few) if d.rdd.getNumPartitions() > few else d
    rows = d.mapInArrow(scan, f"query_id {kind}, no long, s long")
    w = Window.partitionBy("query_id").orderBy(F.desc("s"))
    rows = rows.withColumn("r", F.rank().over(w)).where(F.col("r") <= k)
    return rows.join(docs.select("no", "id"), "no").select("query_id", "id", (F.col("s") / 1e9).alias("score"))


def pa_type(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def search(texts: DataFrame, terms: DataFrame, k: int, stems: bool = False, unique: bool = False) -> DataFrame:
    """(query_id, id, score): at least the k best per query. terms (query_id, term) are the batch's different words, which every task holds; texts see ``found``."""

    def once(words: pa.Array) -> DataFrame:
        docs = found(texts, words, stems)
        return docs if unique else docs.dropDuplicates(["id"])

    return scored(once, len(texts.columns) - 1, terms, k)


def scored(docs: Callable[[pa.Array], DataFrame], fields: int, terms: DataFrame, k: int) -> DataFrame:
    """The same of what docs finds of the batch's words: rows as ``found`` gives them, once per id."""
    t = terms.select("query_id", "term").distinct().toArrow()
    words = pc.unique(t["term"])
    return best(written(docs(words).withColumn("no", F.monotonically_increasing_id()), "found-words"), fields, t, words, max(k, 1))
