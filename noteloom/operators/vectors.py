"""Cosine top-k of query vectors against a table of vectors: exact in blocks, or by cells of nearest centres.

Stored vectors are scanned once for a whole batch of queries: the batch (at most MAX_QUERIES at a time) is broadcast
as a matrix, and every Arrow batch of vectors is a matrix product. A task keeps the k best per query over all its
batches, and there are as many tasks as cores, so what is shuffled is k ids per query and core. ``expression`` computes the same in column algebra, for small inputs and for SQL parity.

Defined results: vectors of the wrong width, null, non-finite or zero are skipped; a query vector of the wrong width
has no result; ties go by the key's first 16 hex digits (the unsigned 64-bit key), then by the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers

#: Query vectors per pass over the stored ones: 1 MB at 64 wide, 12 MB at 768.
MAX_QUERIES = 4_096
#: Under so many stored vectors the exact scan is used even when it isn't asked for.
EXACT_UNDER = 10_000


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are usable, and their unit vectors in double."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
    rows = np.flatnonzero(lengths == width)
    m = flat[(np.cumsum(lengths) - lengths)[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    n = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(n) & (n > 0)
    return rows[ok], m[ok] / n[ok][:, None]


def _rank(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.substring("id", 1, 16), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 1))


class _Best:
    """The k best rows per query over all batches of a task, once per id.

    Products are made in single precision; what may be among the best by more than its error is computed in double. An
    id that comes again takes no place of another.
    """

    def __init__(self, queries: np.ndarray, k: int, kind: pa.DataType):
        self.exact, self.rough, self.k = queries, queries.astype(np.float32), max(k, 1)
        #: A bound of the error of a product of unit vectors in single precision, with that of the rounding of scores.
        self.error = (queries.shape[1] + 8) * 2.0**-24 + 1e-9
        self.least = np.full(len(queries), -np.inf)
        self.names, self.q, self.row, self.score = pa.array([], kind), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, names: pa.Array, m: np.ndarray, queries: np.ndarray | None = None) -> None:
        """names must differ among each other. queries: those that the rows are for."""
        queries, k, n, got = np.arange(len(self.exact)) if queries is None else queries, self.k, len(m), []
        rough = m.astype(np.float32).T
        for part in (queries[i : i + 256] for i in range(0, len(queries), 256)):
            cos = self.rough[part] @ rough
            bar = self.least[part] - self.error
            if n > k and (new := np.flatnonzero(np.isinf(bar))).size:
                bar[new] = np.partition(cos[new], n - k, axis=1)[:, n - k] - 2 * self.error
            q, r = np.divmod(np.flatnonzero(cos >= bar.astype(np.float32)[:, None]), n)
            for i in range(0, len(q), 1 << 16):
                a, b = part[q[i : i + (1 << 16)]], r[i : i + (1 << 16)]
                score = np.round(np.einsum("ij,ij->i", self.exact[a], m[b]), 9)
                keep = score >= self.least[a]
                got.append((a[keep], b[keep], score[keep]))
        if sum(len(x[0]) for x in got):
            q, r, score = (np.concatenate(x) for x in zip(*got, strict=True))
            used, r = np.unique(r, return_inverse=True)
            self._merge(names.take(pa.array(used)), q, r, score)

    def _merge(self, names: pa.Array, q: np.ndarray, r: np.ndarray, score: np.ndarray) -> None:
        called = pa.concat_arrays([self.names, names])
        q, r, score = np.concatenate([self.q, q]), np.concatenate([self.row, r + len(self.names)]), np.concatenate([self.score, score])
        place = np.asarray(pc.rank(called.cast(pa.string()), tiebreaker="dense")).astype(np.int64)[r]
        order = np.lexsort((place, -score, q))
        q, r, score, place = q[order], r[order], score[order], place[order]
        once = np.sort(np.unique(q * (len(called) + 1) + place, return_index=True)[1])
        q, r, score = q[once], r[once], score[once]
        start = np.searchsorted(q, np.arange(len(self.exact) + 1))
        keep = np.arange(len(q)) - start[q] < self.k
        full = np.flatnonzero(np.diff(start) >= self.k)
        self.least[full] = score[start[full] + self.k - 1]
        used, self.row = np.unique(r[keep], return_inverse=True)
        self.names, self.q, self.score = called.take(pa.array(used)), q[keep], score[keep]

    def batches(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """A row per query: its id, and the ids and scores of its best."""
        start = np.searchsorted(self.q, np.arange(len(self.exact) + 1))
        for a in range(0, len(self.exact), 4096):
            b = min(a + 4096, len(self.exact))
            some = np.flatnonzero(np.diff(start[a : b + 1])) + a
            rows = slice(start[a], start[b])
            hits = pa.StructArray.from_arrays([self.names.take(pa.array(self.row[rows])), pa.array(self.score[rows])], names=["id", "score"])
            at = np.append(start[some], start[b]) - start[a]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), hits)], names=["query_id", "hits"])


def _few(d: DataFrame) -> DataFrame:
    """As many tasks as cores at most: each streams its rows, and gives the k best of each query once."""
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d.coalesce(cores) if d.rdd.getNumPartitions() > cores else d


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The rows of the tasks' lists: they move by query once, and what follows happens where they are."""
    return _rank(lists.repartition("query_id").select("query_id", F.inline("hits")).dropDuplicates(["query_id", "id"]), k)


def _once(names: pa.Array, at: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose id comes again in a batch are left out, as they would take the places of others."""
    first = {x: i for i, x in reversed(list(enumerate(names.take(pa.array(at)).to_pylist())))}
    if len(first) == len(at):
        return at, m
    keep = np.array(sorted(first.values()))
    return at[keep], m[keep]


def _passes(queries: DataFrame, width: int, query_id: str, query_vector: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The usable query vectors, about MAX_QUERIES at a time, with their ids."""
    q = queries.where(F.col(query_id).isNotNull() & (F.size(query_vector) == width)).select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")).dropDuplicates(["q"])
    passes = max(1, -(-q.count() // MAX_QUERIES))
    for p in range(passes):
        t = (q if passes == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p)).toArrow()
        ids = t["q"].combine_chunks()
        rows, m = _matrix(t["v"].combine_chunks(), width) if t.num_rows else (np.zeros(0, np.int64), np.zeros((0, width)))
        yield ids.take(pa.array(rows, pa.int64())), m


def _type(d: DataFrame, name: str) -> str:
    return {f.name: f.dataType.simpleString() for f in d.schema}[name]


def use_exact(forced: bool, stored: int) -> bool:
    return forced or stored < EXACT_UNDER


def exact(stored: DataFrame, queries: DataFrame, k: int, width: int, key: str = "id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): cosines in double, rounded to 9 places so that ties are ties."""
    spark = stored.sparkSession
    s = stored.where(F.col(key).isNotNull() & (F.size(vector) == width)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    out = None
    for held in (spark.sparkContext.broadcast(p) for p in _passes(queries, width, query_id, query_vector)):

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, qm = held.value
            best = None
            for b in batches:
                at, m = _matrix(b.column(1), width)
                if not len(at) or not len(qm):
                    continue
                at, m = _once(b.column(0), at, m)
                best = best or _Best(qm, k, b.column(0).type)
                best.add(b.column(0).take(pa.array(at)), m)
            if best:
                yield from best.batches(ids)

        part_out = _few(s).mapInArrow(scan, f"query_id {_type(queries, query_id)}, hits array<struct<id:{_type(stored, key)},score:double>>")
        out = part_out if out is None else out.unionByName(part_out)
    return _merged(out, k)


def expression(stored: DataFrame, vector_of_query: list[float], k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, score, rank) for one query, all in column algebra."""
    width = len(vector_of_query)
    q = F.array(*[F.lit(float(x)) for x in vector_of_query])
    d = stored.where(F.col(key).isNotNull() & numbers.usable(F.col(vector), width)).select(F.col(key).alias("id"), F.col(vector).alias("v")).dropDuplicates(["id"])
    score = numbers.dot(F.col("v"), q) / (numbers.norm(F.col("v")) * numbers.norm(q))
    return _rank(d.select(F.lit(0).alias("query_id"), "id", F.round(score, 9).alias("score")), k).select("id", "score", "rank")


def cells(stored: DataFrame, width: int, n_cells: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 7, key: str = "id", vector: str = "embedding") -> tuple[np.ndarray, DataFrame]:
    """Centres fitted on at most ``sample`` vectors, and all vectors with the cell they belong to.

    The sample bounds what the driver holds; every stored vector is put into a cell.
    """
    spark = stored.sparkSession
    s = stored.where(F.col(key).isNotNull() & (F.size(vector) == width)).select(F.col(key).alias("id"), F.col(vector).alias("embedding"))
    t = _few(s).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    _, m = _matrix(t["embedding"].combine_chunks(), width)
    rng = np.random.default_rng(seed)
    c = m[rng.permutation(len(m))[: max(1, min(n_cells, len(m)))]] if len(m) else np.zeros((1, width))
    for _ in range(rounds if len(m) else 0):
        near = np.argmax(m @ c.T, axis=1)
        for j in range(len(c)):
            own = m[near == j]
            if len(own) and (n := np.linalg.norm(own.sum(axis=0))) > 0:
                c[j] = own.sum(axis=0) / n
    return c, placed(stored, c, width, key, vector)[1]


def placed(stored: DataFrame, centres: np.ndarray, width: int, key: str = "id", vector: str = "embedding") -> tuple[np.ndarray, DataFrame]:
    """The centres, and (id, embedding, cell) of all usable vectors."""
    s = stored.where(F.col(key).isNotNull() & (F.size(vector) == width)).select(F.col(key).alias("id"), F.col(vector).alias("embedding"))
    held = stored.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = _matrix(b.column(1), width)
            if len(at):
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.argmax(v @ held.value.T, axis=1).astype(np.int32))], names=["id", "embedding", "cell"])

    return centres, s.mapInArrow(assign, f"id {_type(stored, key)}, embedding array<float>, cell int")


def approximate(centres: np.ndarray, cells_of: DataFrame, queries: DataFrame, k: int, width: int, probes: int = 12, query_id: str = "query_id", query_vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) for a batch of queries, each from the ``probes`` cells nearest to it; other cells aren't read."""
    spark = cells_of.sparkSession
    out = None
    for ids, qm in _passes(queries, width, query_id, query_vector):
        near = np.argsort(-(qm @ centres.T), axis=1, kind="stable")[:, :probes]
        by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        held = spark.sparkContext.broadcast((ids, qm, by_cell))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, qm, by_cell = held.value
            best = None
            for b in batches:
                at, m = _once(b.column(0), *_matrix(b.column(1), width))
                cell = np.asarray(b.column(2))[at]
                for c in np.unique(cell):
                    rows, qs = np.flatnonzero(cell == c), by_cell.get(int(c), np.zeros(0, np.int64))
                    if not len(qs):
                        continue
                    best = best or _Best(qm, k, b.column(0).type)
                    best.add(b.column(0).take(pa.array(at[rows])), m[rows], qs)
            if best:
                yield from best.batches(ids)

        d = cells_of.where(F.col("cell").isin(list(by_cell))).select("id", "embedding", "cell")
        part = _few(d).mapInArrow(scan, f"query_id {_type(queries, query_id)}, hits array<struct<id:{_type(cells_of, 'id')},score:double>>")
        out = part if out is None else out.unionByName(part)
    return _merged(out, k)
