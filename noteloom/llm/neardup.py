"""Near-duplicate texts (problem 7): a grouped prefix join.

A text is the set of its runs of ``width`` consecutive words. Two sets with a Jaccard similarity of at least t share
one of the first |x| - ceil(t |x|) + 1 members in any fixed order of all members, so only these prefixes are
joined. The order puts rare members first, by counts over all texts in a count-min sketch: LINES lines of SKETCH
counters, of which a member takes its least. Counters fill up as the corpus grows, all of them by about the same, so
members above the common level still come last; the order only steers the work, never the result.

* Texts with the same words are one class; classes are what is compared. A group of exact copies, however large, is
  one row from here on; it is counted and reduced before the shuffle.
* Classes with the same prefix and the same number of members are one group. Groups are joined by the members of
  their prefixes; sizes and the positions of the common member bound the overlap inside the join, and a pair needs as
  many common members as its sizes ask for. Bitmaps of the sets bound it there for groups of one class only.
* The pairs of groups that are left are expanded to pairs of classes, which the classes' own bitmaps bound, and their
  sets are compared exactly.

A member that stands in more than HOT prefixes, which are counted exactly, is cut into salted blocks, so that no task
holds all of its groups; so is a group of very many classes.

Defined results: null texts, null keys and texts with fewer than least words (or than width) have no partner; case and
punctuation make no difference; a repeated row counts once; ids with the same words are similar with 1. ``similar``
gives all pairs of ids, also n (n - 1) / 2 for n copies of one text; ``grouped`` counts them by class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: The sketch: 16 MB on the driver and on each executor, whatever the data.
LINES, SKETCH, CHUNK = 2, 1 << 20, 1 << 11
#: Ids of a class that are paired at once; a class of more is cut into such parts.
PART = 256
#: Bits of the sets' bitmaps, and buckets of the filter in front of the last join.
BITS, FILTER = 192, 1 << 20
MAPS = ["b0", "b1", "b2"]
#: So many members of a set make one more common member in the prefixes a condition.
PER_MATCH = 32
#: Groups per block of a frequent member, classes per block of a group, and rows of prefix members per task of their join.
HOT, GROUP, TASK = 20_000, 2_000, 250_000
_WORD = re.compile(r"[^\W_]+")


class Shingler:
    """64-bit hashes of runs of words, vectorised over a batch of texts."""

    def __init__(self, width: int):
        self.width, self.known = width, {}
        self.mix = [np.uint64(xxhash.xxh3_64_intdigest(f"place {i}") | 1) for i in range(width)]

    def _hash(self, w: str) -> int:
        h = self.known.get(w)
        if h is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            h = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash), each once, ordered by text and hash; the texts are words with single blanks."""
        words, n = [], np.zeros(len(texts), np.int64)
        get = self._hash
        for i, t in enumerate(texts):
            w = t.split(" ") if t else []
            n[i] = len(w)
            words += [get(x) for x in w]
        flat = np.array(words, np.uint64)
        k = np.maximum(0, n - self.width + 1)
        doc = np.repeat(np.arange(len(texts)), k)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        at = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + first[doc]
        with np.errstate(over="ignore"):
            h = np.zeros(len(doc), np.uint64)
            for i, m in enumerate(self.mix):
                h = (h ^ (flat[at + i] * m)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        if len(doc):
            keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
            doc, h = doc[keep], h[keep]
        return doc, h


def worded_rows(df: DataFrame, key: str, text: str, origin: str | None, least: int) -> DataFrame:
    """(id, o, c, w): every text's words with single blanks, and the hash c of these, its class. One pass, no shuffle."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    o = origin or key

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, words = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                w = _WORD.findall(t.lower())
                if len(w) >= max(least, 1):
                    at.append(i)
                    words.append(" ".join(w))
            take = pa.array(at, pa.int64())
            c = pa.array([xxhash.xxh3_128_digest(w) for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), c, pa.array(words, pa.string())], names=["id", "o", "c", "w"])

    d = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(o).alias("o"), F.col(text).alias("t"))
    return d.mapInArrow(scan, f"id {types[key]}, o {types[o]}, c binary, w string")


def lines(h: np.ndarray) -> list[np.ndarray]:
    """Every line's counter for each member."""
    with np.errstate(over="ignore"):
        return [((h * np.uint64(m)) >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[:LINES]]


def sketch(classes: DataFrame, width: int) -> np.ndarray:
    """How often members fall on each counter of each line, over all classes. Tasks send their counters packed, in chunks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, total = Shingler(width), np.zeros((LINES, SKETCH), np.int64)
        for b in batches:
            col = b.column(0)
            for lo in range(0, len(col), 4_096):
                _, h = s.sets(col.slice(lo, 4_096).to_pylist())
                for i, at in enumerate(lines(h)):
                    total[i] += np.bincount(at, minlength=SKETCH)
        if total.any():
            parts = total.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], names=["k", "d"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in t["d"]:
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return pa.table({"k": t["k"][:1], "d": pa.array([total.tobytes()], pa.binary())})

    # so many rows as chunks, whatever the data
    got = classes.select("w").mapInArrow(count, "k int, d binary").groupBy("k").applyInArrow(add, "k int, d binary").toArrow()
    out = np.zeros((LINES * SKETCH // CHUNK, CHUNK), np.int64)
    for k, d in zip(got["k"].to_pylist(), got["d"].to_pylist(), strict=True):
        out[k] = np.frombuffer(d, np.int64)
    return out.reshape(LINES, SKETCH)


def parities(doc: np.ndarray, bit: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Per row the parity of its members on each bit, as 64-bit words."""
    odd = (np.bincount(doc * bits + bit.astype(np.int64), minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)


def wanted(n: np.ndarray) -> np.ndarray:
    """How many common members the prefixes of two sets must have, by the smaller set's size.

    If sets overlap in o members, the m-th common one in the order has at least o - m + 1 members from it on in either
    set. So the first k common ones stand where at least o - k + 1 members are left, within prefixes that are longer
    by k - 1: fewer than k such matches mean less overlap than o. One match would do for exactness; more of them keep
    chance matches, of which large sets have many, out of the candidates.
    """
    return 1 + n // PER_MATCH


def ceil_share(t: float, n: np.ndarray) -> np.ndarray:
    """ceil(t n), safe against binary fractions."""
    return np.ceil(t * n - 1e-9).astype(np.int64)


def prefixes(classes: DataFrame, width: int, t: float, counts: np.ndarray) -> DataFrame:
    """(c, g, n, p, b0, b1, b2): a class's group, its number of members, its prefix in the common order, and a bitmap.

    A bit of the bitmap is the parity of the members that fall on it, so two bitmaps differ in no more bits than the
    sets differ in members: a bound on the overlap in three machine words. Members are 32 bits here: a collision can
    only add a candidate. The prefix is longer by ``wanted`` - 1 than one common member needs.
    """
    held = classes.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c = Shingler(width), held.value
        for b in batches:
            for lo in range(0, b.num_rows, 4_096):
                part = b.slice(lo, 4_096)
                doc, h = s.sets(part.column(1).to_pylist())
                n = np.bincount(doc, minlength=part.num_rows)
                seen = np.min([c[i][at] for i, at in enumerate(lines(h))], axis=0)
                order = np.lexsort((h, seen, doc))
                h, doc = h[order], doc[order]
                keep = np.where(n > 0, np.minimum(n, n - ceil_share(t, n) + wanted(n)), 0)
                start = np.cumsum(n) - n
                at = np.repeat(start, keep) + np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
                tok = (h[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                offsets = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
                g = [xxhash.xxh3_64_intdigest(tok[offsets[i] : offsets[i + 1]].tobytes() + int(n[i]).to_bytes(8, "little")) for i in range(len(n))]
                words = parities(doc, (h >> np.uint64(32)) % np.uint64(BITS), part.num_rows, BITS)
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.array(g, np.uint64).view(np.int64)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tok)), *[pa.array(words[:, k].copy()) for k in range(BITS // 64)]],
                    names=["c", "g", "n", "p", "b0", "b1", "b2"],
                )
                yield out.filter(pa.array(n > 0))

    return classes.select("c", "w").mapInArrow(cut, "c binary, g long, n int, p array<int>, b0 long, b1 long, b2 long")


def apart() -> F.Column:
    """In how many bits the bitmaps of sides a and b differ."""
    x, *rest = [F.bit_count(F.col(f"{b}a").bitwiseXOR(F.col(f"{b}b"))) for b in MAPS]
    return sum(rest, x)


def common(t: float) -> F.Column:
    """How many members sets of na and nb members must share for a similarity of t."""
    return F.ceil((F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-9)


def blocked(d: DataFrame, key: str, member: str, sizes: DataFrame, most: int) -> DataFrame:
    """d with the pair of blocks (bi, bj) and the own block b of every row; keys that sizes (key, n) names are cut into blocks of ``most``."""
    cut = sizes.select(key, F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    d = d.join(cut, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    d = d.withColumn("b", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o")}).drop("blocks", "o")


def group_pairs(leaders: DataFrame, t: float, cut: DataFrame) -> DataFrame:
    """(ga, gb): pairs of groups (ga < gb) whose members may reach t; leaders has one class per group, lone where it is the only one."""
    bits = [*MAPS, "lone"]
    e = leaders.select("g", "n", *bits, F.posexplode("p").alias("pos", "tok"))
    per = cut.select(F.explode("p").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    hot = written(per.where(F.col("n") > HOT), "hot-members")
    keys, own = ["tok"], []
    if not hot.isEmpty():
        e, keys, own = blocked(e, "tok", "g", hot, HOT), ["tok", "bi", "bj"], ["b"]
    rows = cut.agg(F.sum(F.size("p"))).first()[0] or 0
    e = e.repartition(max(int(leaders.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK), *keys)
    named = lambda s: e.select(*keys, F.col("g").alias(f"g{s}"), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"i{s}"), *[F.col(x).alias(f"{x}{s}") for x in bits + own])
    need = common(t)
    k = F.lit(1) + F.floor(F.least("na", "nb") / PER_MATCH)
    room = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    # members of a group share size and prefix, not the bitmap: a leader's says nothing about the others
    mapped = ~(F.col("lonea") & F.col("loneb")) | (apart() <= F.col("na") + F.col("nb") - 2 * need)
    near = (F.col("ga") < F.col("gb")) & (F.least("na", "nb") >= F.ceil(F.greatest("na", "nb") * t - 1e-9)) & (room >= need - k + 1) & mapped & (_once() if own else F.lit(True))
    met = named("a").join(named("b"), keys).where(near).select("ga", "gb", k.cast("int").alias("k"))
    return met.groupBy("ga", "gb", "k").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= F.col("k")).select("ga", "gb").distinct()


def _once() -> F.Column:
    """Rows of one block meet where it meets itself alone."""
    return (F.col("ba") != F.col("bb")) | (F.col("bi") == F.col("bj"))


def class_pairs(classes: DataFrame, width: int, t: float) -> DataFrame:
    """(ca, cb, sim): pairs of classes (ca < cb) with a similarity of at least t, by the exact sets."""
    counts = sketch(classes, width)
    cut = written(prefixes(classes, width, t, counts), "prefixes")
    member = cut.select("c", "g")
    # of a group of several classes one leads; the others, which are few as a rule, leave the join of the prefixes
    several = member.groupBy("g").agg(F.min("c").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    others = member.join(several, "g").where("c != first").select("c", "g")
    leaders = cut.join(others.select("c"), "c", "left_anti").join(several.select("g", F.lit(True).alias("led")), "g", "left")
    across = group_pairs(leaders.withColumn("lone", F.col("led").isNull()), t, cut)
    side = lambda s, x: cut.select(F.col("g").alias(f"g{s}"), F.col("c").alias(x), F.col("n").alias(f"n{s}"), *[F.col(b).alias(f"{b}{s}") for b in MAPS])
    across = across.join(side("a", "x"), "ga").join(side("b", "y"), "gb").where(apart() <= F.col("na") + F.col("nb") - 2 * common(t)).select("x", "y")
    # classes of a group share its prefix; the rest is bounded by their bitmaps, and large groups meet in blocks
    inner = blocked(cut.join(several.select("g"), "g", "left_semi"), "g", "c", several.where(F.col("m") > GROUP).select("g", F.col("m").alias("n")), GROUP)
    part = lambda s, x: inner.select("g", "bi", "bj", F.col("b").alias(f"b{s}"), F.col("c").alias(x), F.col("n").alias(f"n{s}"), *[F.col(b).alias(f"{b}{s}") for b in MAPS])
    inside = part("a", "x").join(part("b", "y"), ["g", "bi", "bj"]).where((F.col("x") < F.col("y")) & _once() & (apart() <= F.col("na") + F.col("nb") - 2 * common(t))).select("x", "y")
    pairs = across.unionByName(inside).select(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).distinct()
    pairs = written(pairs, "class-pairs")
    texts = only(classes, pairs)
    full = pairs.join(texts.select(F.col("c").alias("ca"), F.col("w").alias("wa")), "ca").join(texts.select(F.col("c").alias("cb"), F.col("w").alias("wb")), "cb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(width)
        for b in batches:
            for lo in range(0, b.num_rows, 2_048):
                part = b.slice(lo, 2_048)
                m = part.num_rows
                da, ha = s.sets(part.column(2).to_pylist())
                db, hb = s.sets(part.column(3).to_pylist())
                na, nb = np.bincount(da, minlength=m), np.bincount(db, minlength=m)
                # a member of both sides stands twice in a row
                doc, h = np.concatenate([da, db]), np.concatenate([ha, hb])
                o = np.lexsort((h, doc))
                doc, h = doc[o], h[o]
                both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=m)
                union = na + nb - both
                sim = np.where(union > 0, both / np.maximum(union, 1), 0.0)
                ok = pa.array(both * 1.0 >= t * union - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], names=["ca", "cb", "sim"]).filter(ok)

    return full.select("ca", "cb", "wa", "wb").mapInArrow(verify, "ca binary, cb binary, sim double")


def only(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes that may be in a pair: others stay out of the shuffle. The filter has FILTER buckets, whatever the data."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER)).cast("int")
    ends = pairs.select(bucket("ca").alias("k")).unionByName(pairs.select(bucket("cb").alias("k"))).distinct().toArrow()
    on = np.zeros(FILTER, bool)
    on[np.asarray(ends["k"])] = True
    held = classes.sparkSession.sparkContext.broadcast(np.packbits(on))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(held.value).astype(bool)
        for b in batches:
            yield b.filter(pa.array(on[np.asarray(b.column(2))]))

    return classes.select("c", "w", bucket("c").alias("k")).mapInArrow(keep, "c binary, w string, k int").drop("k")


def classes_of(texts: DataFrame) -> DataFrame:
    """(c, w): one row per class of (uid, c, w). The numbers of the rows that repeat a class are taken out, so that texts needn't move to be compared."""
    slim = texts.select("uid", "c")
    copied = slim.groupBy("c").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    extra = written(slim.join(copied, "c").where("uid != first").select("uid"), "copies")
    return texts.join(extra, "uid", "left_anti").select("c", "w")


def parts_of(rows: DataFrame) -> DataFrame:
    """(c, part, only, m): the ids of a class with their origins, in parts of about PART; all in part 0 as a rule.

    An origin with more than PART ids in a class has parts of its own, named in ``only``: their ids aren't compared with
    one another. What a row must know of large classes is joined by class and salt, as such a class may hold a third of all rows.
    """
    salts = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    sizes = rows.groupBy("c", "o").agg(F.count(F.lit(1)).alias("n"))
    cut = lambda n: F.ceil(F.col(n) / PART).cast("int")
    hot = sizes.where(F.col("n") > PART).select("c", F.struct("o").alias("only"), cut("n").alias("own"))
    large = sizes.where(F.col("n") <= PART).groupBy("c").agg(F.sum("n").alias("n")).where(F.col("n") > PART).select("c", cut("n").alias("blocks"))
    d = rows.select("c", "id", "o", F.struct("o").alias("only"), F.pmod(F.xxhash64("id"), F.lit(16)).cast("int").alias("salt"))
    d = d.join(salts(hot), ["c", "only", "salt"], "left").join(salts(large), ["c", "salt"], "left")
    # another seed than the salt's, which would leave blocks empty
    block = F.pmod(F.xxhash64("id", F.lit("part")), F.coalesce("own", "blocks", F.lit(1))).cast("int")
    part = F.when(F.col("own").isNotNull(), F.xxhash64("only", block)).otherwise(block.cast("long"))
    only = F.when(F.col("own").isNotNull(), F.col("only"))
    return d.select("c", part.alias("part"), only.alias("only"), F.struct("id", "o").alias("x")).groupBy("c", "part", "only").agg(F.collect_set("x").alias("m"))


def id_pairs(rows: DataFrame, sims: DataFrame) -> DataFrame:
    """(id_a, id_b, sim), id_a < id_b: all pairs of ids of different origins, in a class or in similar classes."""
    parts = written(parts_of(rows), "parts")
    named = lambda s: parts.select(F.col("c").alias(f"c{s}"), F.col("part").alias(f"p{s}"), F.col("only").alias(f"o{s}"), F.size("m").alias(f"n{s}"))
    apart = F.col("oa").isNull() | F.col("ob").isNull() | (F.col("oa") != F.col("ob"))
    # which parts meet is settled on short rows; the lists follow by class and part, so a large class is spread
    cross = sims.join(named("a"), "ca").join(named("b"), "cb").where(F.coalesce(apart, F.lit(True)))
    few = parts.groupBy("c").agg(F.sum(F.size("m")).alias("n")).where("n > 1").select("c")
    inner = named("a").join(few.select(F.col("c").alias("ca")), "ca").join(named("b").withColumnRenamed("cb", "ca"), "ca")
    inner = inner.where(F.coalesce(apart, F.lit(True)) & ((F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("na") > 1))))
    meet = cross.select("ca", "pa", "cb", "pb", "sim").unionByName(inner.select("ca", "pa", F.col("ca").alias("cb"), "pb", F.lit(1.0).alias("sim")))
    lists = lambda s: parts.select(F.col("c").alias(f"c{s}"), F.col("part").alias(f"p{s}"), F.col("m").alias(f"m{s}"))
    ab = meet.join(lists("a"), ["ca", "pa"]).join(lists("b"), ["cb", "pb"])
    met = ab.withColumn("same", (F.col("ca") == F.col("cb")) & (F.col("pa") == F.col("pb"))).select("sim", "same", F.explode("ma").alias("x"), "mb").select("sim", "same", "x", F.explode("mb").alias("y"))
    met = met.where((F.col("x.id") != F.col("y.id")) & ~F.col("x.o").eqNullSafe(F.col("y.o")) & (~F.col("same") | (F.col("x.id") < F.col("y.id"))))
    return met.select(F.least("x.id", "y.id").alias("id_a"), F.greatest("x.id", "y.id").alias("id_b"), "sim").groupBy("id_a", "id_b").agg(F.max("sim").alias("sim"))


def texts_and_pairs(df: DataFrame, key: str, text: str, origin: str | None, width: int, t: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, o, c) of all texts, and the similar classes."""
    texts = written(worded_rows(df, key, text, origin, max(least, width)).withColumn("uid", F.monotonically_increasing_id()), "texts")
    return texts.select("id", "o", "c"), class_pairs(classes_of(texts), width, t)


def similar(df: DataFrame, key: str, text: str, origin: str | None = None, width: int = 5, t: float = 0.8, least: int = 0) -> DataFrame:
    """(id_a, id_b, sim), id_a < id_b: similar texts; with origin, only of different origins."""
    return id_pairs(*texts_and_pairs(df, key, text, origin, width, t, least))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group): the smallest node that links lead to, by alternating large and small stars.

    Links to larger neighbours are drawn to the smallest neighbour, then links to smaller ones, until nothing moves;
    the number of rounds grows as the square of the logarithm of the longest chain. Each round is written to the shared folder.
    Minimum per node is combined before the shuffle, so a node with very many links is no hot task.
    """
    e = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    last = None
    while True:
        for large in (True, False):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
            low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            d = both.join(low, "u")
            moved = d.where("v > u") if large else d
            nxt = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            if not large:
                nxt = nxt.unionByName(low.select("u", F.col("m").alias("v")))
            e = nxt.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = written(e, "links")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("group"))).distinct()


def grouped(df: DataFrame, key: str, text: str, width: int = 5, t: float = 0.8) -> DataFrame:
    """(key, group_id, links): every text that has a similar one, with the smallest key of its group and its number of partners."""
    rows, sims = texts_and_pairs(df, key, text, None, width, t, 0)
    # by class, as the pairs of ids grow with the square of the copies; class and id stand for one another in the links
    rows, sims = written(rows.select("id", "c").distinct(), "ids"), written(sims.select("ca", "cb"), "class-links")
    sizes = rows.groupBy("c").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    either = sims.unionByName(sims.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
    near = either.join(sizes.select(F.col("c").alias("cb"), "n"), "cb").groupBy(F.col("ca").alias("c")).agg(F.sum("n").alias("near"))
    links = sizes.join(near, "c", "left").select("c", "first", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links")).where("links > 0")
    grouped_by = components(sims, "ca", "cb").select(F.col("node").alias("c"), F.col("group").alias("root"))
    c = links.join(grouped_by, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least_id = c.groupBy("root").agg(F.min("first").alias("group_id"))
    per = c.join(least_id, "root").select("c", "group_id", "links")
    return rows.join(per, "c").select(F.col("id").alias(key), "group_id", "links")


def found(df: DataFrame) -> DataFrame:
    """(id_a, id_b) of TESTDATA.md: kind 0, different paths, 45 words each, three-word runs, 0.6."""
    d = df.where("kind = 0").select("id", "path", "body")
    return similar(d, "id", "body", "path", 3, 0.6, 45).select("id_a", "id_b")
