"""Positions within groups, without one task per group.

A window over a group sorts the whole group in one task, which fails when one group holds a third of all rows. Here
values are counted first (so ties are one row, combined before the shuffle), and a group's values are cut into
buckets by a monotone function of the value. Windows then run over the buckets of a group and over the values of a
bucket: a bucket spans a factor of 2^(1/128), which holds under 100,000 different single-precision numbers, and a
group has at most a few thousand buckets with values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def finite(v: Column) -> Column:
    """v as a double where it is a finite number, else null."""
    d = v.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), F.when(d == 0, F.lit(0.0)).otherwise(d))


def bucket(v: Column) -> Column:
    """A whole number that never falls as v rises."""
    size = F.floor(F.log2(F.abs(v)) * 128) + 200_000
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def positions(df: DataFrame, keys: list[str], value: str, weight: str | None = None, out: str = "pos") -> DataFrame:
    """(keys, value, out): per distinct finite value of a group, one plus the number of rows with a larger value.

    weight: a column that says how many rows a row stands for. Null and non-finite values have no position.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    counted = df.withColumn(value, finite(F.col(value))).where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(n).cast("long").alias("__n"))
    counted = counted.withColumn("__b", bucket(F.col(value)))
    inside = Window.partitionBy(*keys, "__b").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    higher = counted.groupBy(*keys, "__b").agg(F.sum("__n").alias("__t")).withColumn("__above", F.coalesce(F.sum("__t").over(above), F.lit(0))).drop("__t")
    ranked = counted.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(higher, [*keys, "__b"])
    return ranked.select(*keys, value, (F.col("__in") + F.col("__above") + 1).alias(out))


def numbered(df: DataFrame, group: str, order: Sequence[Column], out: str = "place") -> DataFrame:
    """df with the place of each row in its group, from 1, by order (which should tell all rows of a group apart).

    A total sort: the rows are cut into ranges of (group, order), however many equal values one of its columns has, and
    sorted inside. A row's place is its number in its range less where the group begins there, plus what earlier
    ranges hold of the group: one short row per range and group. No task holds a group.
    """
    keys = [F.col(group).asc(), *order]
    # the ranges are drawn from a sample of the rows, so these are written first
    rows = written(df, "to-number")
    cut = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    cut = cut.withColumn("__p", F.shiftright("__m", 33))
    held = cut.groupBy(group, "__p").agg(F.min("__m").alias("__lo"), F.count(F.lit(1)).alias("__k"))
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__b", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    return cut.join(held, [group, "__p"]).withColumn(out, F.col("__m") - F.col("__lo") + F.col("__b") + 1).drop("__m", "__p", "__lo", "__b")
