"""What happens to a ranked list after fusion. Every stage takes and gives rows with query_id and pos (from 1).

A stage drops rows or numbers them again; none relies on the order of rows, and filters stand after an explicit rank,
so they can't be moved below it. Lists are as long as the pool that was asked for, so windows per query are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import ascii_lower

def per_query():
    return Window.partitionBy("query_id")


#: Positions that no cut may hide: the best of either source.
CHAMPION = 3
#: The knee: least rows on either side, least drop (ten percent), and three robust deviations.
SIDE, MAD_SCALE, SIGMA = 3, 1.4826, 3.0


def renumbered(d: DataFrame) -> DataFrame:
    return d.withColumn("pos", F.row_number().over(per_query().orderBy("pos")))


def since(d: DataFrame, cutoff: int | None) -> DataFrame:
    """Keeps created >= cutoff; a null is dropped. Nothing moves up from outside the list."""
    return d if cutoff is None else d.where(F.col("created") >= cutoff)


def from_source(d: DataFrame, want: str | None) -> DataFrame:
    """Keeps one source, A to Z without case; a null never matches."""
    return d if want is None else d.where(ascii_lower(F.col("source")) == ascii_lower(F.lit(want)))


def excluded(path: Column, words: list[str]) -> Column:
    """Whether a path holds one of the words, A to Z without case."""
    clean = list(dict.fromkeys(w.strip().lower() if w.isascii() else w.strip() for w in words if w.strip()))
    if not clean:
        return F.lit(False)
    return F.exists(F.array(*[F.lit(w) for w in clean]), lambda w: F.contains(ascii_lower(path), ascii_lower(w)))


def scoped(d: DataFrame, words: list[str]) -> DataFrame:
    return d.where(~excluded(F.col("path"), words))


def elided(d: DataFrame, words: list[str]) -> DataFrame:
    """(query_id, elided): how many rows the scope takes away."""
    return d.groupBy("query_id").agg(F.count_if(excluded(F.col("path"), words)).alias("elided"))


def one_per_note(d: DataFrame) -> DataFrame:
    """The first chunk of every note stands for it, with the number of further ones in siblings (null for none).

    Its source and fusion ranks become the best of all its note's chunks; score, body and rerank rank stay its own.
    """
    w = Window.partitionBy("query_id", "path")
    best = {c: F.min(c).over(w) for c in ("bm25_rank", "cosine_rank", "fusion_rank") if c in d.columns}
    n = F.count(F.lit(1)).over(w) - 1
    first = F.row_number().over(w.orderBy("pos"))
    kept = d.withColumns({**best, "siblings": F.when(n > 0, n.cast("int")), "__n": first}).where("__n = 1").drop("__n")
    return renumbered(kept)


def truncated(d: DataFrame, limit: int) -> DataFrame:
    return d.where(F.col("pos") <= limit)


def score_floor(d: DataFrame, floor: float | None) -> DataFrame:
    """Keeps rows of at least floor percent of the first row that is left."""
    if floor is None:
        return d
    top = F.first("score").over(per_query().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.withColumn("__p", numbers.percent(F.col("score"), top)).where(F.col("__p") >= floor).drop("__p")


def relevance_floor(d: DataFrame, floor: float | None) -> DataFrame:
    """Keeps relevance >= floor; an unknown relevance passes a floor of 0 only."""
    return d if floor is None else d.where(F.coalesce(F.col("relevance") >= floor, F.lit(False)) | F.lit(floor == 0))


def champion_through(d: DataFrame) -> DataFrame:
    """(query_id, champion): the last position that is among the best of either source, else 0."""
    best = (F.col("bm25_rank") <= CHAMPION) | (F.col("cosine_rank") <= CHAMPION)
    return d.groupBy("query_id").agg(F.coalesce(F.max(F.when(best, F.col("pos"))), F.lit(0)).alias("champion"))


def tidy_lengths(d: DataFrame, champions: bool = True) -> DataFrame:
    """(query_id, keep, n): how long the head of the list is, in front of the largest unusual drop of rrf.

    All n rows are kept where the list is short, a score is missing, not finite, not positive or larger than the one
    before it, where no drop stands out, or where a source's champion stands behind the drop.
    """
    order = per_query().orderBy("pos")
    s = F.col("rrf").cast("double")
    nxt = F.lead(s).over(order)
    last = F.row_number().over(per_query().orderBy(F.desc("pos"))) == 1
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    bad = ~F.coalesce(fine(s), F.lit(False)) | (~last & ~F.coalesce(fine(nxt) & (nxt <= s), F.lit(False)))
    g = d.select("query_id", "pos", *(["bm25_rank", "cosine_rank"] if champions else []), s.alias("rrf"), F.when(~last & ~bad, F.log(F.try_divide(s, nxt))).alias("gap"), bad.alias("bad"))
    center = g.groupBy("query_id").agg(F.median("gap").alias("center"), F.count(F.lit(1)).cast("int").alias("n"), F.max(F.col("bad")).alias("bad"))
    if champions:
        center = center.join(champion_through(g), "query_id")
    else:
        center = center.withColumn("champion", F.lit(0))
    e = g.drop("bad").join(center, "query_id")
    keep = F.col("pos").cast("int")
    eligible = (keep >= SIDE) & (F.col("n") - keep >= SIDE)
    best = e.groupBy("query_id", "n", "center", "bad", "champion").agg(
        F.median(F.abs(F.col("gap") - F.col("center"))).alias("mad"),
        # the largest drop, the latest of equal ones
        F.max(F.when(eligible, F.struct("gap", keep.alias("keep")))).alias("knee"),
    )
    limit = F.greatest(F.log(F.lit(10.0 / 9.0)), F.col("center") + SIGMA * MAD_SCALE * F.col("mad"))
    cut = ~F.col("bad") & (F.col("n") >= 2 * SIDE) & (F.col("knee.gap") > limit) & (F.col("champion") <= F.col("knee.keep"))
    return best.select("query_id", F.when(F.coalesce(cut, F.lit(False)), F.col("knee.keep")).otherwise(F.col("n")).alias("keep"), "n")


def tidied(d: DataFrame, limit: int) -> DataFrame:
    """Cuts lists of exactly limit rows at their knee; other lists stay."""
    t = tidy_lengths(d)
    return d.join(t, "query_id").where((F.col("n") != limit) | (F.col("pos") <= F.col("keep"))).drop("keep", "n")


def rerank_cap(limit: int, pool: int, floor_active: bool) -> int:
    """How many candidates a reranker scores: twice the limit, 16 at least; all of them when a score floor is active."""
    return pool if floor_active else min(max(2 * limit, 16), pool)


def reranked(d: DataFrame, cap: int, logit: str = "logit") -> DataFrame:
    """The first cap rows are put into the order of their logits; score becomes its sigmoid; the rest stays behind them.

    Rows of the prefix without a logit come after those with one.
    """
    head = F.col("pos") <= cap
    order = per_query().orderBy(F.when(head, 0).otherwise(1), F.when(head, F.col(logit)).desc_nulls_last(), "pos")
    d = d.withColumn("__p", F.row_number().over(order))
    scored = head & F.col(logit).isNotNull()
    return d.withColumns(
        {
            "rerank": F.when(scored, F.col(logit)),
            "rerank_rank": F.when(scored, F.col("__p").cast("int")),
            "score": F.when(scored, numbers.sigmoid(F.col(logit))).otherwise(F.col("score").cast("double")),
            "pos": F.col("__p"),
        }
    ).drop("__p")


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """(query_id, pos, ord, id, body, centre): the chunks around each hit, of its note and kind.

    hits has query_id, pos and id. A hit that isn't there has no window. The join is on path and kind, with the range
    of numbers as its condition; hits are the short side.
    """
    c = chunks.select("path", "kind", "ord", "id", "body").dropDuplicates(["id"])
    at = hits.select("query_id", "pos", "id").join(c.select("id", F.col("path").alias("p"), F.col("kind").alias("k"), F.col("ord").alias("o")), "id").select("query_id", "pos", "p", "k", "o")
    near = (F.col("path") == F.col("p")) & (F.col("kind") == F.col("k")) & F.col("ord").between(F.col("o") - radius, F.col("o") + radius)
    return at.join(c, near).select("query_id", "pos", "ord", "id", "body", (F.col("ord") == F.col("o")).alias("centre"))


def per_note_display(d: DataFrame, most: int = 3) -> DataFrame:
    """Notes in the order of their first hit, with up to most hits each, and how many more there are."""
    w = Window.partitionBy("query_id", "path")
    d = d.withColumns({"note_pos": F.min("pos").over(w), "n_in_note": F.row_number().over(w.orderBy("pos")), "more": F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0))})
    return d.where(F.col("n_in_note") <= most)
