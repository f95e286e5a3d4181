"""One ranking from several differently-scaled scores (problem 2): reciprocal rank fusion.

Every score ranks the items of a run on its own; an item's fused score is the sum over the scores of
1 / (c + position), so the range of a score has no say.

Runs of up to ``one_task`` rows are ranked by windows: one shuffle by run serves the removal of repeated rows, all
positions and the final order. A run of more rows is never brought into one task: its positions come from counted
values in monotone buckets and its final order from a total sort by ranges (``operators.ranking``), so one run may hold
a third of all rows, and all of its items may have the same score. Both ways give the same rows.

Defined results: a score that is null, NaN or infinite gives its item no position in that ranking and moves nobody
else; an item without any usable score has the fused score 0 and comes last; equal scores share a position (one plus
the number of larger ones); a repeated row counts once, and where an item has several values of a score in a run the
largest finite one counts. Rows whose run or item is null are no candidates. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import finite, numbered, positions
from ..session import written

RRF_C = 60
#: Rows of a run that one task may sort.
ONE_TASK = 200_000


def fuse(df: DataFrame, run: str, item: str, scores: Sequence[str], c: int = RRF_C, one_task: int = ONE_TASK) -> DataFrame:
    """(run, item, n, <score>_pos for each score, fused, place): place 1 is the best of its run; ties go by item.

    n is the number of the run's candidates. ``place`` is dense over them: one plus the number of candidates with a
    larger fused score, or the same score and a smaller item.
    """
    d = df.where(F.col(run).isNotNull() & F.col(item).isNotNull()).select(run, item, *[finite(F.col(s)).alias(s) for s in scores])
    # one row per run of more than one_task rows
    large = written(d.groupBy(run).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > one_task).select(run), "large-runs")
    if large.isEmpty():
        return _in_windows(d, run, item, scores, c)
    small = _in_windows(d.join(large, run, "left_anti"), run, item, scores, c)
    return small.unionByName(_in_parts(d.join(large, run, "left_semi"), run, item, scores, c))


def _once(d: DataFrame, run: str, item: str, scores: Sequence[str]) -> DataFrame:
    """One row per run and item, with each score's largest value."""
    return d.groupBy(run, item).agg(*[F.max(s).alias(s) for s in scores])


def _total(scores: Sequence[str], c: int) -> Column:
    """The terms are added in the order of the scores' names, so the sum doesn't depend on the order of columns."""
    return sum((F.coalesce(1.0 / (F.lit(float(c)) + F.col(f"{s}_pos")), F.lit(0.0)) for s in sorted(scores)), F.lit(0.0))


def _named(d: DataFrame, run: str, item: str, scores: Sequence[str]) -> DataFrame:
    return d.select(run, item, F.col("n").cast("long").alias("n"), *[F.col(f"{s}_pos").cast("long").alias(f"{s}_pos") for s in scores], "fused", F.col("place").cast("long").alias("place"))


def _in_windows(d: DataFrame, run: str, item: str, scores: Sequence[str], c: int) -> DataFrame:
    """Runs that fit into a task; the partitioning by run is kept through all steps."""
    w = Window.partitionBy(run)
    got = _once(d.repartition(run), run, item, scores).withColumn("n", F.count(F.lit(1)).over(w))
    for s in scores:
        got = got.withColumn(f"{s}_pos", F.when(F.col(s).isNotNull(), F.rank().over(w.orderBy(F.col(s).desc_nulls_last()))))
    got = got.withColumn("fused", _total(scores, c))
    return _named(got.withColumn("place", F.row_number().over(w.orderBy(F.col("fused").desc(), F.col(item)))), run, item, scores)


def _in_parts(d: DataFrame, run: str, item: str, scores: Sequence[str], c: int) -> DataFrame:
    """Runs of any size. Items move twice, by their names; positions are found for numbers that stand for them."""
    every = written(_once(d, run, item, scores).withColumn("__i", F.monotonically_increasing_id()), "candidates")
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("__s"), F.col(s).alias("__v")) for s in scores])).alias("__p")
    long = every.select(run, "__i", pairs).select(run, "__i", "__p.*").where("__v is not null")
    met = long.join(positions(long, [run, "__s"], "__v", out="__pos"), [run, "__s", "__v"])
    per = met.groupBy("__i").agg(*[F.max(F.when(F.col("__s") == s, F.col("__pos"))).alias(f"{s}_pos") for s in scores])
    sizes = every.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    got = every.join(per, "__i", "left").join(sizes, run).withColumn("fused", _total(scores, c))
    got = got.select(run, item, "n", *[f"{s}_pos" for s in scores], "fused")
    return _named(numbered(got, run, [F.col("fused").desc(), F.col(item).asc()]), run, item, scores)


def best_by_all(df: DataFrame, run: str, item: str, scores: Sequence[str], part: float = 0.1, one_task: int = ONE_TASK) -> DataFrame:
    """(run, item): candidates of the fused ranking whose position is in the best part of their run by every one of the scores.

    The best part of a run of n candidates are the positions up to ceil(n * part).
    """
    most = F.ceil(F.col("n") * F.lit(part) - F.lit(1e-9))
    got = fuse(df, run, item, scores, one_task=one_task)
    for s in scores:
        got = got.where(F.col(f"{s}_pos") <= most)
    return got.select(run, item)
