"""Use of notes: counters, runs and events of presented hits, and reports on them.

Counters are an aggregate of an append-only log of (path, count, first_used, last_used) rows, which any number of
writers may add to; a batch of one presentation is checked as a whole and written as one folder that appears by a
rename, so a batch is there whole or not at all. User data is kept apart from what can be derived again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import place
from . import provenance

TICKS = "path string, count long, first_used long, last_used long"
EVENTS = "run_id long, path string, fusion_rank int, bm25_rank int, cosine_rank int, rerank_rank int, final_rank int, rerank_scored tinyint"


MOST_PAYLOAD, MOST_QUERY = 1_000_000, 16_384


def payload(content: str, store_query: bool = False, query: str | None = None) -> tuple[dict, list[str], str | None]:
    """A presentation as an agent reports it: its batch, its paths, and the query only when it is to be kept.

    ValueError for more than a megabyte, a query of more than 16 KB, unknown fields, or a batch that fails its checks.
    """
    if len(content.encode()) > MOST_PAYLOAD:
        raise ValueError("payload too large")
    batch = json.loads(content)
    if not isinstance(batch, dict) or set(batch) != {"run", "events"} or any(set(e) != {"path", "provenance"} for e in batch["events"]):
        raise ValueError("a payload has run and events, an event path and provenance")
    if store_query and (query is None or not query.strip() or len(query.encode()) > MOST_QUERY):
        raise ValueError("a query to be kept must be there and not too long")
    provenance.check_batch(batch)
    return batch, [note_path(e["path"]) for e in batch["events"]], query if store_query else None


def note_path(path: str) -> str:
    """A note's relative path in normal form; ValueError when it isn't one."""
    p = path.strip().replace("\\", "/")
    while p.startswith("./"):
        p = p[2:]
    if not p.endswith(".md") or p.startswith("/") or any(x in ("", ".", "..") for x in p.split("/")):
        raise ValueError(f"not a note's path: {path!r}")
    return p


def counters(log: DataFrame) -> DataFrame:
    """One row per path: counts added up, the first and the last use. Combined before the shuffle."""
    return log.where("path is not null").groupBy("path").agg(F.sum("count").alias("count"), F.min("first_used").alias("first_used"), F.max("last_used").alias("last_used"))


def from_events(events: DataFrame, runs: DataFrame) -> DataFrame:
    """The counters that a log of events gives: one use per event, at its run's time."""
    e = events.distinct().join(runs.select(F.col("id").alias("run_id"), "ts").distinct(), "run_id")
    return counters(e.select("path", F.lit(1).cast("long").alias("count"), F.col("ts").alias("first_used"), F.col("ts").alias("last_used")))


def rekeyed(log: DataFrame, moves: DataFrame) -> DataFrame:
    """Counters after notes were moved (old_path, new_path); a move to itself changes nothing."""
    m = moves.where("old_path is not null and new_path is not null and old_path != new_path").groupBy("old_path").agg(F.max("new_path").alias("new_path"))
    d = log.join(m, log["path"] == m["old_path"], "left").withColumn("path", F.coalesce("new_path", "path")).drop("old_path", "new_path")
    return counters(d)


def fame(ticks: DataFrame, files: DataFrame, limit: int = 20, include_missing: bool = False) -> DataFrame:
    """The most used notes; missing ones (no file) only when asked for. Ties: the later use, then the path."""
    d = ticks.join(files.select("path").distinct().withColumn("__f", F.lit(True)), "path", "left").withColumn("missing", F.col("__f").isNull()).drop("__f")
    if not include_missing:
        d = d.where(~F.col("missing"))
    return d.orderBy(F.desc("count"), F.desc("last_used"), "path").limit(limit)


def rank_report(ticks: DataFrame, files: DataFrame, events: DataFrame, runs: DataFrame, limit: int = 20, include_missing: bool = False) -> DataFrame:
    """Medians of the ranks per note, pipeline and corpus, for the most used notes; notes without events have one row.

    The limit is of notes, not of rows. Exact medians per group; the groups are of at most ``limit`` notes.
    """
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be within 1 and 10000")
    base = fame(ticks, files, limit, include_missing)
    # at most 10,000 short rows, so they go to the events and not the events to them
    some = F.broadcast(base.select("path"))
    r = runs.select(F.col("id").alias("run_id"), "pipeline_id", "corpus_sha256", "ts").distinct()
    e = events.distinct().join(some, "path", "left_semi").join(r, "run_id")
    med = lambda c: F.median(c).alias(f"median_{c}")
    g = e.groupBy("path", "pipeline_id", "corpus_sha256").agg(
        F.count(F.lit(1)).alias("events"), *[med(c) for c in ("fusion_rank", "bm25_rank", "cosine_rank", "rerank_rank", "final_rank")],
        F.count_if(F.col("rerank_scored") == 1).alias("rerank_scored"), F.count_if(F.coalesce(F.col("rerank_scored"), F.lit(0)) != 1).alias("unscored_tail"), F.max("ts").alias("last_event"),
    )
    d = base.select("path", F.col("count").alias("ticks"), "missing").join(g, "path", "left")
    return d.fillna(0, ["events", "rerank_scored", "unscored_tail"])


def ordered_report(report: DataFrame, ticks: DataFrame) -> DataFrame:
    """With place: notes by use, their groups newest first."""
    d = report.join(ticks.select("path", "last_used"), "path", "left")
    w = Window.orderBy(F.desc("ticks"), F.desc("last_used"), "path", F.desc("last_event"), "pipeline_id", "corpus_sha256")
    return d.withColumn("place", F.row_number().over(w)).drop("last_used")


def orphans(ticks: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """One row: counters and events whose path has no file."""
    f = files.select("path").distinct()
    t = ticks.select("path", F.lit(1).alias("t"), F.lit(0).alias("e"))
    both = t.unionByName(events.distinct().select("path", F.lit(0).alias("t"), F.lit(1).alias("e")))
    lost = both.join(f, "path", "left_anti")
    return lost.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("ticks"), F.coalesce(F.sum("e"), F.lit(0)).alias("events"))


def record(batch: dict | None, paths: list[str], now: int, store: str, spark, query: str | None = None) -> str:
    """Checks a presentation and writes it as one new folder under store; gives the folder.

    batch is {"run": ..., "events": [...]} or None for plain counters. A failed check or write leaves nothing.
    """
    if not paths:
        raise ValueError("nothing to record")
    if len(set(paths)) != len(paths) or any(not p for p in paths):
        raise ValueError("paths must be different and not empty")
    if query is not None and batch is None:
        raise ValueError("a stored query needs a run")
    if batch is not None:
        provenance.check_batch(batch)
    tag = place(spark, "x").rsplit("-", 1)[1]
    run_id = int(tag[:15], 16)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    staged, final = f"{store.rstrip('/')}/.staged-{tag}", f"{store.rstrip('/')}/batch-{tag}"
    fs = hadoop(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        spark.createDataFrame([(p, 1, now, now) for p in paths], TICKS).coalesce(1).write.parquet(f"{staged}/ticks")
        if batch is not None:
            run = batch["run"]
            spark.createDataFrame([(run_id, run["pipeline_id"], run["corpus_sha256"], json.dumps(run, sort_keys=True), query, now)], "id long, pipeline_id string, corpus_sha256 string, provenance_json string, query_text string, ts long").coalesce(1).write.parquet(f"{staged}/runs")
            rows = [(run_id, e["path"], *[e["provenance"].get(k) for k in ("fusion_rank", "bm25_rank", "cosine_rank", "rerank_rank", "final_rank")], int(e["provenance"]["rerank_scored"])) for e in batch["events"]]
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{staged}/events")
        if not fs.rename(hadoop(staged), hadoop(final)):
            raise OSError(f"can't publish {final}")
    except BaseException:
        fs.delete(hadoop(staged), True)
        raise
    return final


def recorded(spark, store: str, what: str) -> DataFrame:
    """All published rows: ticks, runs or events."""
    return spark.read.parquet(f"{store.rstrip('/')}/batch-*/{what}")


def with_days(d: DataFrame, *columns: str) -> DataFrame:
    """Epoch seconds beside their day (UTC) as <column>_day, for display."""
    return d.withColumns({f"{c}_day": F.date_format(F.timestamp_seconds(F.col(c)), "yyyy-MM-dd") for c in columns})
