"""Only new or changed records since the last successful run (problem 6).

``replay`` takes the index runs in order. A run's listing is a full one, so it is compared with the last version of
the state once, and what differs becomes the next version: new rows, and positions of old ones (see
``sources.versioned``). A failed run commits nothing. Whoever processes the records reads them off two manifests, as
the files that only the newer one names, in any later session. That a run was processed is part of its version, so a
replay that died goes on after the last run that it committed.

Defined results: a path or hash that is null is no record (a null hash means that the path was seen but not read,
and it keeps its state); hashes compare without case; repeated deliveries count once; of several rows of a path
the latest counts, and among rows of one moment the one with the larger hash (a null is the smallest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import place, written
from ..sources.versioned import VersionedTable


DAY = 86_400
#: A replay compacts its table after so many versions, so that no version has more files and vectors than these left.
COMPACT = 32


def latest(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """One row per key: the value of its latest row. Combined before the shuffle, so a hot key is no hot task."""
    best = F.max(F.struct(F.col(at).alias("a"), F.col(value).alias("v")))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("__best")).select(key, F.col("__best.v").alias(value))


def base_state(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, sha256): per path the files row with the latest indexed_at inside a successful run."""
    ok = runs.where("status = 'ok' and started_at is not null and finished_at is not null").select("started_at", "finished_at").distinct()
    # rows meet runs by the day, so that the join has an equal key; a run is listed under every day that it touches
    day = lambda c: F.floor(F.col(c) / DAY)
    ok = ok.where("started_at <= finished_at").withColumn("day", F.explode(F.sequence(day("started_at"), day("finished_at"))))
    rows = files.select("path", F.lower("sha256").alias("sha256"), "indexed_at").withColumn("day", day("indexed_at"))
    inside = rows.join(ok, (rows.day == ok.day) & rows.indexed_at.between(ok.started_at, ok.finished_at), "left_semi")
    return latest(inside, "path", "indexed_at", "sha256").where("sha256 is not null")


def delta(state: DataFrame, seen: DataFrame) -> DataFrame:
    """state (path, sha256, __file, __pos) against what a run saw (path, sha256): one row per path that differs.

    new_sha is null where the path is gone; __file and __pos say which row it replaces, null for a new path.
    """
    now = seen.select("path", F.col("sha256").alias("new_sha"), F.lit(True).alias("__seen"))
    both = state.select("path", F.col("sha256").alias("old_sha"), *VersionedTable.AT).join(now, "path", "full_outer")
    new = F.col("old_sha").isNull() & F.col("new_sha").isNotNull()
    changed = F.col("old_sha").isNotNull() & F.col("new_sha").isNotNull() & (F.col("old_sha") != F.col("new_sha"))
    removed = F.col("old_sha").isNotNull() & F.col("__seen").isNull()
    return both.where(new | changed | removed).select("path", "new_sha", *VersionedTable.AT)


def replay(files: DataFrame, walk: DataFrame, runs: DataFrame, first_run: int, path: str | None = None, compact: int = COMPACT) -> tuple[VersionedTable, list[tuple[int, int, int]]]:
    """Commit the state before first_run and one version per later successful run.

    Gives the table and, per run, (run_id, version before, version after). A table that already holds some runs
    (``processed`` in its last manifest) goes on after them: that is how a run that died is taken up again.
    """
    spark = files.sparkSession
    held = VersionedTable(spark, path or place(spark, "state"), "path")
    if not held.versions():
        held.commit(base_state(files, runs), processed=first_run - 1)
    # the list of runs is metadata: one short row per run
    done = held.manifest(held.versions()[-1])["processed"]
    versions = held.versions()
    todo = [r.run_id for r in runs.where((F.col("run_id") >= first_run) & (F.col("run_id") > done) & (F.col("status") == "ok")).select("run_id").distinct().orderBy("run_id").collect()]
    steps = []
    for run in todo:
        if len(versions) > 1 and versions[-1] - (held.manifest(versions[-1])["compacted"] or 0) >= compact:
            versions.append(held.compact())
        before = versions[-1]
        # the listing of one run only: run_id is a plain comparison that reaches the scan
        seen = latest(walk.where(F.col("run_id") == run).select("path", F.lower("sha256").alias("sha256"), "seen_at"), "path", "seen_at", "sha256")
        # written once, as it becomes both the new rows and the positions of the old ones
        d = written(delta(held.live(before), seen), "delta")
        after = held.commit(d.where("new_sha is not null").select("path", F.col("new_sha").alias("sha256")), d.where("__pos is not null"), processed=run)
        versions.append(after)
        steps.append((run, before, after))
    return held, steps


def found(files: DataFrame, walk: DataFrame, runs: DataFrame, first_run: int = 9) -> DataFrame:
    """(run_id, path, verdict) of TESTDATA.md."""
    held, steps = replay(files, walk, runs, first_run)
    out = None
    for run, before, after in steps:
        part = held.changes(before, after).select(F.lit(run).cast("int").alias("run_id"), "path", "verdict")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else files.sparkSession.createDataFrame([], "run_id int, path string, verdict string")
