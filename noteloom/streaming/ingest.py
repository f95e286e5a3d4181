"""Streams: new notes as they come, events of external programs, and use of notes in windows.

A file stream sees new files only, never what was removed, so the comparison of whole listings (plans.index) stays
the authority; the stream keeps a corpus fresh between two of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking

NOTES = "path string, content string, mtime double"


def note_stream(spark: SparkSession, folder: str, most_files: int = 1_000) -> DataFrame:
    """Notes that arrive as Parquet files of NOTES rows."""
    return spark.readStream.schema(NOTES).option("maxFilesPerTrigger", most_files).parquet(folder)


def chunk_stream(notes: DataFrame) -> DataFrame:
    """The chunks of a stream of notes; no state."""
    return chunking.chunked(notes)


def into_table(chunks: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream of chunks to Parquet files, each exactly once; with once it ends when all that is there is done."""
    w = chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """act(batch, number) for every batch; a number may come again after a failure, so act must be the same done twice."""
    w = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def use_in_windows(events: DataFrame, at: str = "ts", key: str = "path", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, uses) per window; events later than late are left out, so state is bounded."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count(F.lit(1)).alias("uses")).select(F.col("window.start").alias("start"), key, "uses")
