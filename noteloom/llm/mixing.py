"""Sources mixed to target shares (problem 9): balanced sampling by the cube method.

A source whose target amount is r times its size gives every document floor(r) times, and once more with the
probability r - floor(r). Which documents get the extra copy is drawn by the cube method: probabilities move along
directions that change neither the expected number of documents nor the expected tokens, until they are 0 or 1. So
the drawn tokens and documents hit their targets but for a few documents per source, where independent draws would
scatter.

The flight phase runs in blocks of a source (cut by hash, so that a source with a third of all documents is many
tasks), a task per block; inside a block, lanes of a few documents take their steps together, as arrays. A block leaves at most as many undecided documents as there are constraints; these go on to the next level, in
blocks of blocks, until one block per source is left. What that leaves is the landing: the token constraint is let
go, then the count, and the last document is drawn by its own probability.

Sizes are tokens of a public tokenizer whose vocabulary file is a parameter. Defined results: names of sources
compare without case, outer blanks and the difference of _ and -; documents without a source, with a source that is
no target, or with null text take no part; a repeated document counts once; a target without documents reaches share 0
and its share is spread over the others in proportion; the total is the largest for which every source that
has documents meets its share within its repeats, or the one that is asked for, each source then at most at its cap.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK = 10_000
#: Units of a lane; all lanes of a block fly at once.
LANE = 32
EPS = 1e-9
#: The word pattern of the byte-level vocabulary, as its publisher gives it; taken from the tokenizer's own package where there is one.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """The path of the vocabulary on this machine; every worker needs the file under the same path."""
    import os

    return os.environ.get("NOTELOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[_\\s]+", "-")


def sized(docs: DataFrame, key: str, text: str, source: str, vocabulary: str | None = None) -> DataFrame:
    """(doc, src, tokens): one row per document with a text and a source."""
    path = vocabulary or default_vocabulary()
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc", "src", "tokens"])

    d = docs.select(F.col(key).alias("doc"), source_name(F.col(source)).alias("src"), F.col(text).alias("t"))
    d = d.where("doc is not null and src is not null and src != '' and t is not null")
    return d.mapInArrow(scan, f"doc {kind}, src string, tokens long").dropDuplicates(["doc"])


def null_vector(rows: list[np.ndarray]) -> np.ndarray:
    """A vector that the rows (one constraint each) send to 0."""
    return np.linalg.svd(np.array(rows))[2][-1]


def flight(pi: np.ndarray, constraints: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities along the null space of the constraints until at most len(constraints) are undecided.

    constraints has a row per constraint and a column per unit, already divided by the first probabilities.
    """
    pi = pi.astype(np.float64).copy()
    p = len(constraints)
    waiting = list(np.flatnonzero((pi > EPS) & (pi < 1 - EPS))[::-1])
    hand: list[int] = []
    while True:
        while len(hand) < p + 1 and waiting:
            hand.append(waiting.pop())
        if len(hand) < p + 1:
            return pi
        a = constraints[:, hand]
        if p == 2:
            u = np.array([a[0, 1] * a[1, 2] - a[0, 2] * a[1, 1], a[0, 2] * a[1, 0] - a[0, 0] * a[1, 2], a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]])
            if np.abs(u).max() < 1e-12:
                u = null_vector(list(a))
        elif p == 1:
            u = np.array([a[0, 1], -a[0, 0]])
        else:
            u = null_vector(list(a))
        u = u / np.abs(u).max()
        x = pi[hand]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > EPS, (1 - x) / u, np.where(u < -EPS, -x / u, np.inf)).min()
            down = np.where(u > EPS, x / u, np.where(u < -EPS, (x - 1) / u, np.inf)).min()
        step = up if rng.random() * (up + down) < down else -down
        x = np.clip(x + step * u, 0, 1)
        x[x < EPS], x[x > 1 - EPS] = 0, 1
        pi[hand] = x
        hand = [i for i, v in zip(hand, x, strict=True) if 0 < v < 1]


def flight_in_lanes(pi: np.ndarray, constraints: np.ndarray, rng: np.random.Generator, lane: int = LANE) -> np.ndarray:
    """The flight under two constraints, in lanes of ``lane`` units that take each step together.

    Every lane keeps three units in hand and moves them along their one null direction; a unit that is decided is
    replaced by the lane's next. A lane leaves two undecided at most, which go into the lanes of the next round.
    """
    pi = pi.astype(np.float64).copy()
    while True:
        left = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
        n = len(left) // lane
        if n < 4:
            return flight(pi, constraints, rng)
        units = rng.permutation(left)[: n * lane].reshape(n, lane)
        hand, nxt, on = units[:, :3].copy(), np.full(n, 3), np.arange(n)
        while len(on):
            h = hand[on]
            a, b = constraints[0][h], constraints[1][h]
            u = np.cross(a, b)
            flat = np.abs(u).max(axis=1) < 1e-12  # the constraints say the same of these three, so one of them does
            u[flat] = np.stack([a[flat, 1], -a[flat, 0], np.zeros(flat.sum())], axis=1)
            u /= np.abs(u).max(axis=1, keepdims=True)
            x = pi[h]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > EPS, (1 - x) / u, np.where(u < -EPS, -x / u, np.inf)).min(axis=1)
                down = np.where(u > EPS, x / u, np.where(u < -EPS, (x - 1) / u, np.inf)).min(axis=1)
            x = np.clip(x + np.where(rng.random(len(on)) * (up + down) < down, up, -down)[:, None] * u, 0, 1)
            x[x < EPS], x[x > 1 - EPS] = 0, 1
            pi[h] = x
            for k in range(3):
                lane_no = on[(x[:, k] == 0) | (x[:, k] == 1)]
                more = lane_no[nxt[lane_no] < lane]
                hand[more, k] = units[more, nxt[more]]
                nxt[lane_no] += 1
            on = on[nxt[on] <= lane]


def land(pi: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the last ones: with the count alone, then each by itself."""
    pi = flight(pi, np.ones((1, len(pi))), rng)
    open_ = (pi > EPS) & (pi < 1 - EPS)
    pi[open_] = rng.random(open_.sum()) < pi[open_]
    return pi


def drawn(units: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """units (doc, src, tokens, pi) with take 0 or 1."""
    kind = units.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, src string, tokens long, pi double, p0 double, blk long"

    def fly(final: bool):
        def one(key: tuple, t: pa.Table) -> pa.Table:
            o = np.argsort(np.array([str(x) for x in t["doc"].to_pylist()]), kind="stable")
            t = t.take(pa.array(o))
            pi, p0, tok = (np.asarray(t[c], dtype=np.float64) for c in ("pi", "p0", "tokens"))
            rng = np.random.default_rng([seed, abs(hash_of(key[0].as_py())), int(key[1].as_py()), int(final)])
            # the order is random, so that what is left at the end isn't the largest key
            mix = rng.permutation(len(pi))
            c = np.vstack([np.ones(len(pi)), tok / max(1.0, tok.mean() if len(tok) else 1.0)])[:, mix]
            out = np.empty(len(pi))
            out[mix] = flight_in_lanes(pi[mix], c, rng)
            if final:
                out = land(out, tok, rng)
            return t.set_column(t.schema.get_field_index("pi"), "pi", pa.array(out))

        return one

    sizes = {r.src: r["count"] for r in units.groupBy("src").count().collect()}
    most = max(sizes.values(), default=0)
    blocks = max(1, -(-most // block))
    d = units.select("doc", "src", "tokens", "pi", F.col("pi").alias("p0"), F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("long").alias("blk"))
    done = None
    while True:
        final = blocks == 1
        # so many partitions as blocks: left to itself, the engine puts the short rows of all blocks into one task
        flown = d.repartition(max(1, blocks * len(sizes)), "src", "blk").groupBy("src", "blk").applyInArrow(fly(final), schema)
        if final:
            return (flown if done is None else done.unionByName(flown)).select("doc", "src", "tokens", F.round("pi").cast("int").alias("take"))
        flown = written(flown, "flight")
        ready = flown.where(f"pi < {EPS} or pi > 1 - {EPS}")
        done = ready if done is None else done.unionByName(ready)
        # a block leaves two documents at most, so thousands of blocks fit into one
        blocks = -(-blocks // (block // 4))
        d = flown.where(f"pi >= {EPS} and pi <= 1 - {EPS}").withColumn("blk", F.pmod(F.col("blk"), F.lit(blocks)))


def hash_of(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode())


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[float, float]]:
    """Per source its times (how often each document is given on average) and its wanted share among those with documents."""
    live = {n: (s, r) for n, s, r in targets if totals.get(n, 0) > 0 and s > 0 and r > 0}
    whole = sum(s for s, _ in live.values())
    if not live:
        return {}
    most = min(r * totals[n] * whole / s for n, (s, r) in live.items())
    n_tokens = most if total is None else total
    return {n: (min(float(r), n_tokens * s / whole / totals[n]), s / whole) for n, (s, r) in live.items()}


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, seed: int = 1, vocabulary: str | None = None) -> DataFrame:
    """(doc, src, tokens, copies): the selection; copies is at least 1."""
    goal = {}
    # one short row per target source
    for r in targets.select(source_name(F.col("src_name")).alias("n"), "target_share", "max_repeats").where("n is not null and target_share is not null and max_repeats is not null").collect():
        s, c = goal.get(r.n, (0.0, 0))
        goal[r.n] = (s + r.target_share, max(c, r.max_repeats))
    units = written(sized(docs, key, text, source, vocabulary).where(F.col("src").isin(list(goal))), "sized")
    totals = {r.src: r.t for r in units.groupBy("src").agg(F.sum("tokens").alias("t")).collect()}
    times = plan(totals, [(n, s, c) for n, (s, c) in goal.items()], total)
    if not times:
        return units.select("doc", "src", "tokens", F.lit(0).alias("copies")).where("false")
    rate = F.element_at(F.create_map(*[F.lit(x) for n, (t, _) in times.items() for x in (n, t)]), F.col("src"))
    u = units.where(F.col("src").isin(list(times))).withColumn("rate", rate)
    # a rate that is whole but for rounding has no fraction
    u = u.withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("pi", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    some = drawn(u.where(f"pi > {EPS}").select("doc", "src", "tokens", "pi"), seed).withColumn("whole", F.floor(F.element_at(F.create_map(*[F.lit(x) for n, (t, _) in times.items() for x in (n, t)]), F.col("src")) + 1e-9).cast("int"))
    every = some.select("doc", "src", "tokens", (F.col("whole") + F.col("take")).alias("copies")).unionByName(u.where(f"pi <= {EPS}").select("doc", "src", "tokens", F.col("whole").alias("copies")))
    return every.where("copies > 0")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(src_name, target_share, reached_share, docs, copies, tokens): what a selection reaches; every target has a row."""
    got = selection.groupBy("src").agg(F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    t = targets.select(source_name(F.col("src_name")).alias("src"), "src_name", "target_share")
    zero = {"docs": 0, "copies": 0, "tokens": 0}
    d = t.join(got, "src", "left").fillna(zero)
    # one row per target source, so a window over all of them is a handful of rows
    whole = F.sum("tokens").over(Window.partitionBy())
    return d.select("src_name", "target_share", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)).alias("reached_share"), "docs", "copies", "tokens")


def kept(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(src_name, given, share_met, cap_kept): whether a target source is in the selection, meets its share, and keeps its cap.

    The share is that among the sources with documents; it is met if it is off by at most three of the source's longest documents.
    """
    t = targets.select(source_name(F.col("src_name")).alias("src"), "src_name", "target_share", "max_repeats")
    got = selection.groupBy("src").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("most"), F.max("tokens").alias("long"))
    d = t.join(got, "src", "left")
    w = Window.partitionBy()  # one row per target source
    d = d.withColumns({"whole": F.sum("t").over(w), "live": F.sum(F.when(F.col("t") > 0, F.col("target_share"))).over(w)})
    off = F.abs(F.col("t") - F.col("whole") * F.col("target_share") / F.col("live"))
    return d.select("src_name", F.col("t").isNotNull().alias("given"), F.coalesce(off <= 3 * F.col("long"), F.lit(True)).alias("share_met"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("cap_kept"))
