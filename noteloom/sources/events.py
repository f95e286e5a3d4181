"""Events that external programs write, one JSON object per line, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of event and their fields; which fields a line has depends on its type.
SHAPE = "type string, level string, message string, current long, total long, path string, action string, ok boolean, error string, no_index boolean"
TYPES = ("log", "progress", "note", "result")


def parsed(line: Column) -> Column:
    """The event of a line; null for a line that is none."""
    e = F.from_json(line, SHAPE, {"mode": "PERMISSIVE"})
    return F.when(e["type"].isin(*TYPES), e)


def of_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Columns of SHAPE and raw; lines that are no event keep their text in raw, all others have null there. A note's action is create unless it says otherwise."""
    d = lines.withColumn("e", parsed(F.col(column)))
    d = d.select("e.*", F.when(F.col("e").isNull(), F.col(column)).alias("raw"))
    return d.withColumn("action", F.when(F.col("type") == "note", F.coalesce("action", F.lit("create"))).otherwise(F.col("action")))


def to_line(d: DataFrame) -> DataFrame:
    """(value): events as lines; null fields are left out."""
    cols = [c.split()[0] for c in SHAPE.split(", ")]
    return d.where("type is not null").select(F.to_json(F.struct(*[c for c in cols if c in d.columns])).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return of_lines(spark.read.text(path))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return of_lines(spark.readStream.text(path))
