"""The most similar vectors of every vector (problem 1): a block matrix join.

Vectors are brought to unit length, and equal ones are one class. Blocks of vectors are multiplied as matrices of
int8; the rounding errors of both sides bound the true cosine. Rows move as int8 (a quarter of the bytes of floats);
only those with a pair whose upper bound reaches the floor are sent again as floats, and of these only pairs whose
upper bound reaches the floor and the k-th best lower bound of their row are recomputed from the floats. Each block pair
keeps k per row (a heap by (cosine, key)), and the heaps of all block pairs of a row are merged in the end: no pairs
but these leave a task, however dense a cloud of vectors is.

Which block pairs are multiplied:

* ``join``: every vector is a query. A block is a cell of nearest pivots: a vector is at home with its nearest
  pivot and a guest with the next ``probes - 1``; home rows are multiplied with home rows and guests. With a floor
  on the cosine near vectors share a cell but for a small part, measured in the tests (recall 0.9 is the least). The
  number of pivots grows with the square root of the rows, and in proportion to them where cells would outgrow
  ``block``, up to MAX_PIVOTS (32 MB at 64 wide as they are sent); over FLAT of them a vector looks for its pivots below the
  BEAM nearest of the square root of their number. A cell over ``block`` rows is cut into blocks, and every pair of
  its blocks is a task of its own, so a hot cell is many tasks. With ``exact`` all vectors are one cell, cut so: nothing
  is lost, and the work is that of all pairs, never emitted.
* ``search``: a stated set of queries against all rows, exactly: query blocks times row blocks.

Defined results: null, wrong-width, non-finite and all-zero vectors, and null ids, are not usable: they are no
query and no result. An id that is delivered again counts once. Ties go by id among equal vectors and by a hash of
the id among others. A vector is never its own neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

MAX_PIVOTS = 1 << 18
#: So many pivots are compared with every vector; of more, those below the BEAM nearest leading ones.
FLAT, BEAM = 4_096, 12
BLOCK = 16_384
#: Rows of a float tile of products, so that a task holds some tens of MB.
TILE = 1_024


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors (float32) of the usable rows of a list column."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(col)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, width), np.float32)
    # flatten() leaves nulls out, so it agrees with lengths that are 0 for nulls
    lengths = np.asarray(col.value_lengths().fill_null(0))
    flat = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    rows = np.flatnonzero(lengths == width)
    if not len(rows):
        return rows, np.zeros((0, width), np.float32)
    m = flat[start[rows][:, None] + np.arange(width)]
    ok = np.isfinite(m).all(axis=1)
    big = np.abs(m).max(axis=1, initial=0.0, where=np.isfinite(m))
    ok &= big > 0
    rows, m, big = rows[ok], m[ok], big[ok]
    m /= big[:, None]
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    return rows, m.astype(np.float32) + np.float32(0)  # + 0 makes -0 and 0 the same bytes


def usable(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(__id, __v): usable rows, the vector as the bytes of its unit float32 form."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, m = unit_rows(b.column(1), width)
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([r.tobytes() for r in m], pa.binary())], names=["__id", "__v"])

    d = df.where(F.col(key).isNotNull() & (F.size(vector) == width)).select(F.col(key).alias("__id"), F.col(vector).alias("__e"))
    return d.mapInArrow(scan, f"__id {kind}, __v binary")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(__r, __v, ids): one row per different vector, with its k + 1 smallest ids and their hash key __r.

    The rank filter runs before the shuffle as well, so a vector that a third of all rows share sends k + 1 ids per task.
    """
    w = Window.partitionBy("__v").orderBy("__id")
    few = rows.withColumn("__n", F.dense_rank().over(w)).where(F.col("__n") <= k + 1)
    c = few.groupBy("__v").agg(F.array_sort(F.collect_set("__id")).alias("ids"))
    return c.select(F.unhex(F.md5(F.element_at("ids", 1).cast("string"))).alias("__r"), "__v", "ids")


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding takes away (rounded up)."""
    scale = np.abs(m).max(axis=1) / 127
    q = np.rint(m / scale[:, None]).astype(np.int8)
    err = np.sqrt(((m - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-6
    return q, scale.astype(np.float32), err.astype(np.float32)


class Best:
    """Per row the k best (cosine, key) so far."""

    def __init__(self, n: int, k: int):
        self.k, self.cos = k, [np.zeros(0, np.float64) for _ in range(n)]
        self.who = [np.zeros(0, np.int64) for _ in range(n)]

    def add(self, rows: np.ndarray, others: np.ndarray, cos: np.ndarray, order: np.ndarray) -> None:
        at = np.lexsort((order[others], -cos, rows))
        rows, others, cos = rows[at], others[at], cos[at]
        cut = np.flatnonzero(np.diff(rows)) + 1
        for r, o, c in zip(np.split(rows, cut), np.split(others, cut), np.split(cos, cut), strict=True):
            if len(r):
                i = r[0]
                allc, allo = np.concatenate([self.cos[i], c[: self.k]]), np.concatenate([self.who[i], o[: self.k]])
                top = np.lexsort((order[allo], -allc))[: self.k]
                self.cos[i], self.who[i] = allc[top], allo[top]


def _candidates(bound_lo: np.ndarray, bound_hi: np.ndarray, floor: float, k: int) -> np.ndarray:
    """Mask of pairs that may be among the k best of their row: the upper bound reaches the k-th best lower bound."""
    least = np.full(len(bound_lo), floor, np.float32)
    busy = np.flatnonzero((bound_hi >= floor).sum(axis=1) > k)
    if len(busy):
        kth = -np.partition(-bound_lo[busy], k - 1, axis=1)[:, k - 1]
        least[busy] = np.maximum(floor, kth)
    return bound_hi >= least[:, None]


def products(a: np.ndarray, b: np.ndarray, k: int, floor: float, both: bool, same: bool, order_a: np.ndarray, order_b: np.ndarray) -> tuple[Best, Best | None]:
    """The k best of b for each row of a and, with both, the k best of a for each row of b. same: a is b."""
    best_a, best_b = Best(len(a), k), Best(len(b), k) if both else None
    qa, sa, ea = quantised(a)
    qb, sb, eb = quantised(b)
    # products of int8 are whole numbers under 2^24, so float32 holds them exactly and BLAS can make them
    fb = qb.astype(np.float32).T.copy()
    na = 1 + ea
    for lo in range(0, len(a), TILE):
        hi = min(lo + TILE, len(a))
        cos = (qa[lo:hi].astype(np.float32) @ fb) * sa[lo:hi, None] * sb[None, :]
        slack = na[lo:hi, None] * eb[None, :] + ea[lo:hi, None] + np.float32(1e-5)
        if same:
            cos[np.arange(hi - lo), np.arange(lo, hi)] = -4
        up, down = cos + slack, cos - slack
        i, j = np.nonzero(_candidates(down, up, floor, k))
        pick = [(i, j)]
        if both:
            jt, it = np.nonzero(_candidates(down.T, up.T, floor, k))
            pick.append((it, jt))
        for side, (i, j) in enumerate(pick):
            for s in range(0, len(i), 1 << 16):
                ii, jj = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                exact = np.einsum("ij,ij->i", a[lo + ii].astype(np.float64), b[jj].astype(np.float64))
                ok = exact >= floor
                ii, jj, exact = ii[ok] + lo, jj[ok], exact[ok]
                if side == 0:
                    best_a.add(ii, jj, exact, order_b)
                elif best_b is not None:
                    best_b.add(jj, ii, exact, order_a)
    return best_a, best_b


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _order(keys: list[bytes]) -> np.ndarray:
    """Places of the keys in their order, for ties."""
    out = np.empty(len(keys), np.int64)
    out[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] = np.arange(len(keys))
    return out


def _emit(best: Best, src: list[bytes], dst: list[bytes]) -> pa.Table:
    n = [len(c) for c in best.cos]
    rows = np.repeat(np.arange(len(n)), n)
    who = np.concatenate(best.who) if rows.size else np.zeros(0, np.int64)
    cos = np.concatenate(best.cos) if rows.size else np.zeros(0)
    return pa.table({"src": pa.array([src[i] for i in rows], pa.binary()), "dst": pa.array([dst[i] for i in who], pa.binary()), "cos": pa.array(cos, pa.float64())})


class Pivots:
    """The nearest pivots of vectors. Many pivots hang below leading ones, each below its nearest."""

    def __init__(self, p: np.ndarray):
        self.p = p.astype(np.float16)
        lead = int(math.sqrt(len(p))) if len(p) > FLAT else 0
        self.lead = p[:lead].astype(np.float32)
        if lead:
            of = np.concatenate([np.argmax(p[lo : lo + 8_192] @ self.lead.T, axis=1) for lo in range(0, len(p), 8_192)])
            order = np.argsort(of, kind="stable")
            self.below = np.split(order, np.searchsorted(of[order], np.arange(1, lead)))

    def nearest(self, m: np.ndarray, take: int) -> np.ndarray:
        """Per vector the numbers of its ``take`` nearest pivots, the nearest first."""
        take = min(take, len(self.p))
        if not len(self.lead):
            s = m @ self.p.astype(np.float32).T
            top = np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(self.p) else np.tile(np.arange(len(self.p)), (len(m), 1))
            return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
        s = m @ self.lead.T
        beam = np.argpartition(-s, min(BEAM, s.shape[1] - 1), axis=1)[:, :BEAM]
        best, who = np.full((len(m), take), -9, np.float32), np.zeros((len(m), take), np.int64)
        for k in np.unique(beam):
            rows = np.flatnonzero((beam == k).any(axis=1))
            s = m[rows] @ self.p[self.below[k]].astype(np.float32).T
            both = np.concatenate([best[rows], s], axis=1)
            names = np.concatenate([who[rows], np.broadcast_to(self.below[k], s.shape)], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :take]
            best[rows], who[rows] = np.take_along_axis(both, top, axis=1), np.take_along_axis(names, top, axis=1)
        return who


def pivots(c: DataFrame, n: int, width: int, probes: int, block: int) -> np.ndarray:
    """Pivots are different vectors of the collection, taken by the smallest hash; their number is bounded."""
    k = int(min(MAX_PIVOTS, max(1, math.sqrt(probes * n), 2 * probes * n / block)))
    got = c.select("__v").orderBy(F.xxhash64("__v"), "__v").limit(k).toArrow()
    return np.frombuffer(b"".join(got["__v"].to_pylist()), np.float32).reshape(-1, width)


def packed(m: np.ndarray) -> pa.Array:
    """Rows as int8 with their scale and rounding error."""
    q, scale, err = quantised(m)
    d = np.concatenate([q.view(np.uint8), np.stack([scale, err], axis=1).view(np.uint8)], axis=1)
    return pa.array([r.tobytes() for r in d], pa.binary())


def unpacked(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width + 8)
    tail = d[:, width:].copy().view(np.float32)
    return d[:, :width].view(np.int8), tail[:, 0], tail[:, 1]


def reaching(a: tuple, b: tuple, floor: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a and of b have a partner in the other with an upper bound of floor or more. same: a is b."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    fb = qb.astype(np.float32).T.copy()
    on_a, on_b = np.zeros(len(qa), bool), np.zeros(len(qb), bool)
    for lo in range(0, len(qa), TILE):
        hi = min(lo + TILE, len(qa))
        up = (qa[lo:hi].astype(np.float32) @ fb) * sa[lo:hi, None] * sb[None, :]
        up += (1 + ea[lo:hi, None]) * eb[None, :] + ea[lo:hi, None] + np.float32(1e-5)
        if same:
            up[np.arange(hi - lo), np.arange(lo, hi)] = -4
        ok = up >= floor
        on_a[lo:hi] = ok.any(axis=1)
        on_b |= ok.any(axis=0)
    return on_a, on_b


def join(df: DataFrame, key: str, vector: str, width: int, k: int = 10, floor: float = 0.92, probes: int = 5, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """(id, neighbour, cos): per usable vector its k most similar others among those of at least floor.

    Every equal vector is a neighbour with cosine 1 (within rounding); ids of one class come in their order.
    """
    pairs, cls, rows = _class_pairs(df, key, vector, width, k, floor, 1 if exact else probes, block, exact)
    ids = cls.select("__r", "ids")
    near = pairs.join(ids.select(F.col("__r").alias("dst"), F.col("ids").alias("others")), "dst")
    # at most k classes of at most k + 1 ids each
    near = near.groupBy("src").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("c"), F.col("dst").alias("r"), F.col("others").alias("o")))), lambda x: F.transform(x["o"], lambda y: F.struct(y.alias("id"), (-x["c"]).alias("cos"))))).alias("near"))
    own = F.transform("ids", lambda y: F.struct(y.alias("id"), F.lit(1.0).alias("cos")))
    d = ids.join(near.withColumnRenamed("src", "__r"), "__r", "left").withColumn("near", F.slice(F.concat(own, F.coalesce("near", F.expr("array()").cast(near.schema["near"].dataType))), 1, 2 * k + 1))
    d = d.where(F.size("near") > 1)
    # ids beyond the first k + 1 of a class are joined to it in salted parts; the class is small, its rows may be a third of all
    small = d.select(F.explode("ids").alias(key), "near")
    big = cls.where(F.size("ids") > k)
    if not big.isEmpty():
        salt = 16
        wide = big.select("__r", "__v").join(d.select("__r", "near", "ids"), "__r").withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        more = rows.withColumn("__s", F.pmod(F.xxhash64("__id"), F.lit(salt)).cast("int")).distinct().join(wide, ["__v", "__s"]).where(~F.array_contains("ids", F.col("__id")))
        small = small.unionByName(more.select(F.col("__id").alias(key), "near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col(key)), 1, k)
    return small.select(key, F.explode(others).alias("n")).select(key, F.col("n.id").alias("neighbour"), F.col("n.cos").alias("cos"))


def _sides(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Which rows of a block pair are multiplied with which: home rows with home rows and with guests; True for a block with itself."""
    home, left = np.asarray(t["home"]), np.asarray(t["left"])
    h, g = np.flatnonzero(home), np.flatnonzero(~home)
    if t["bi"][0].as_py() == t["bj"][0].as_py():
        some = [(h, h, True), (h, g, False)]
    else:
        some = [(h[left[h]], h[~left[h]], False), (h[left[h]], g[~left[g]], False), (h[~left[h]], g[left[g]], False)]
    return [(x, y, same) for x, y, same in some if len(x) and len(y) and not (same and len(x) < 2)]


def _class_pairs(df: DataFrame, key: str, vector: str, width: int, k: int, floor: float, probes: int, block: int, exact: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(src, dst, cos) between classes, the classes, and the usable rows."""
    spark = df.sparkSession
    rows = usable(df, key, vector, width)
    cls = written(classes(rows, k), "vector-classes")
    n = cls.count()
    blocks = max(1, int(block))
    first = np.ones((1, width), np.float32) if exact else pivots(cls, n, width, probes, blocks)
    held = spark.sparkContext.broadcast(Pivots(first))

    def place(d: DataFrame, coarse: bool) -> DataFrame:
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = held.value
            for b in batches:
                for lo in range(0, b.num_rows, 8_192):
                    part = b.slice(lo, 8_192)
                    m = _matrix(part.column(1), width)
                    top = p.nearest(m, probes)
                    take = top.shape[1]
                    at = pa.array(np.repeat(np.arange(len(m)), take))
                    home = np.tile(np.arange(take) == 0, len(m))
                    data = packed(m) if coarse else part.column(1)
                    yield pa.RecordBatch.from_arrays([pa.array(top.ravel().astype(np.int32)), pa.array(home), part.column(0).take(at), data.take(at)], names=["cell", "home", "r", "v"])

        return d.select("__r", "__v").mapInArrow(assign, "cell int, home boolean, r binary, v binary")

    # blocks per cell: one short row per pivot, at most MAX_PIVOTS of them
    coarse = place(cls, True)
    sizes = coarse.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > blocks).collect() if n > blocks else []
    cuts = {r.cell: -(-r.n // blocks) for r in sizes}
    keys = ["cell", "bi", "bj"] if cuts else ["cell"]
    cut = lambda d: _spread(d, cuts) if cuts else d.withColumns({"bi": F.lit(0), "bj": F.lit(0), "left": F.lit(True)})

    def sift(_: tuple, t: pa.Table) -> pa.Table:
        on = np.zeros(t.num_rows, bool)
        if t.num_rows:
            q, scale, err = unpacked(t["v"], width)
            for x, y, same in _sides(t):
                a, b = reaching((q[x], scale[x], err[x]), (q[y], scale[y], err[y]), floor, same)
                on[x[a]] = True
                on[y[b]] = True
        return pa.table({"r": t["r"].filter(pa.array(on))})

    near = written(cut(coarse).groupBy(*keys).applyInArrow(sift, "r binary").distinct(), "near-vectors")
    placed = cut(place(cls.join(near.withColumnRenamed("r", "__r"), "__r", "left_semi"), False))

    def tile(_: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        if not t.num_rows:
            return _emit(Best(0, k), [], [])
        keys_, m = t["r"].to_pylist(), _matrix(t["v"], width)
        order = _order(keys_)
        outs = []
        for x, y, same in _sides(t):
            kx, ky = [keys_[i] for i in x], [keys_[i] for i in y]
            a, b = products(m[x], m[y], k, floor, not same, same, order[x], order[y])
            outs.append(_emit(a, kx, ky))
            if b is not None:
                outs.append(_emit(b, ky, kx))
        return pa.concat_tables(outs) if outs else _emit(Best(0, k), [], [])

    pairs = placed.groupBy(*keys).applyInArrow(tile, "src binary, dst binary, cos double")
    # a pair can come from two cells; the heaps of a row are merged: at most k from each of its block pairs
    once = pairs.groupBy("src", "dst").agg(F.max("cos").alias("cos"))
    w = Window.partitionBy("src").orderBy(F.desc("cos"), "dst")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n"), cls, rows


def _spread(placed: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """Rows of cells over the block size, in every pair of blocks that their block belongs to."""
    spark = placed.sparkSession
    parts = spark.createDataFrame([(int(c), int(n)) for c, n in cuts.items()], "cell int, parts int")
    d = placed.join(F.broadcast(parts), "cell", "left").fillna(1, ["parts"])
    d = d.withColumn("b", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int"))
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return d.select("cell", "home", "r", "v", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), (F.col("b") <= F.col("o")).alias("left"))


def found(df: DataFrame, key: str, vector: str, width: int, k: int = 10, floor: float = 0.92) -> DataFrame:
    """(id_a, id_b): pairs of at least floor of which one is among the k most similar of the other."""
    j = join(df, key, vector, width, k, floor)
    return j.select(F.least(key, "neighbour").alias("id_a"), F.greatest(key, "neighbour").alias("id_b")).distinct()


def search(df: DataFrame, key: str, vector: str, width: int, queries: DataFrame, k: int = 10, row_block: int = 8_192, query_block: int = 2_048) -> DataFrame:
    """(id, neighbour, cos): the k most similar rows of df for each query row, exactly (recall 1).

    queries has the same columns as df. Every block of queries meets every block of rows; both are cut by hash, so no
    block is hot, and each block pair sends k per query.
    """
    def cut(d: DataFrame, size: int) -> tuple[DataFrame, int]:
        u = usable(d, key, vector, width).dropDuplicates(["__id"])
        n = max(1, -(-d.count() // size))
        return u.withColumn("b", F.pmod(F.xxhash64("__id"), F.lit(n)).cast("int")), n

    rows, nr = cut(df, row_block)
    qs, nq = cut(queries, query_block)
    r = rows.select(F.col("b").alias("bj"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("bi"), "__id", "__v", F.lit(False).alias("q"))
    q = qs.select(F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("bj"), F.col("b").alias("bi"), "__id", "__v", F.lit(True).alias("q"))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"`{key}` {kind}, neighbour {kind}, cos double"

    def tile(_: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        isq = np.asarray(t["q"])
        x, y = np.flatnonzero(isq), np.flatnonzero(~isq)
        ids, m = t["__id"].to_pylist(), _matrix(t["__v"], width)
        src, dst, cs = [], [], []
        if len(x) and len(y):
            place = {ids[j]: n for n, j in enumerate(y)}
            order = _order([ids[j] for j in y])
            # one more than k, as a query may meet itself
            a, _b = products(m[x], m[y], k + 1, -2.0, False, False, np.arange(len(x)), order)
            for i in range(len(x)):
                own = place.get(ids[x[i]], -1)
                keep = [(c, o) for c, o in zip(a.cos[i], a.who[i], strict=True) if o != own][:k]
                src += [ids[x[i]]] * len(keep)
                dst += [ids[y[o]] for _, o in keep]
                cs += [c for c, _ in keep]
        types = t.schema.field("__id").type
        return pa.table({key: pa.array(src, types), "neighbour": pa.array(dst, types), "cos": pa.array(cs, pa.float64())})

    got = r.unionByName(q).groupBy("bi", "bj").applyInArrow(tile, schema)
    w = Window.partitionBy(key).orderBy(F.desc("cos"), "neighbour")
    return got.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
