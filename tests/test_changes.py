"""Change reading: a replay with failures, ties and repeats, and what a run that dies leaves behind."""

import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators import changes
from noteloom.sources.versioned import VersionedTable

RUNS = "run_id int, started_at long, finished_at long, status string"
FILES = "path string, mtime double, sha256 string, indexed_at long"
WALK = "run_id int, path string, mtime double, sha256 string, seen_at long"


def brute(files, walk, runs, first):
    state = {}
    for p, _, s, at in sorted((f for f in files if f[0] is not None), key=lambda f: (f[3], (f[2] or "").lower())):
        if any(r[3] == "ok" and r[2] is not None and r[1] <= at <= r[2] for r in runs):
            state[p] = s.lower() if s else None
    state = {p: s for p, s in state.items() if s}
    out = set()
    for run, *_, status in sorted(runs):
        if run < first or status != "ok":
            continue
        seen = {}
        for r, p, _, s, at in sorted((w for w in walk if w[1] is not None), key=lambda w: (w[4], (w[3] or "").lower())):
            if r == run:
                seen[p] = s.lower() if s else None
        for p, s in seen.items():
            if s and p not in state:
                out.add((run, p, "new"))
            elif s and s != state[p]:
                out.add((run, p, "changed"))
        for p in set(state) - set(seen):
            out.add((run, p, "removed"))
            del state[p]
        state |= {p: s for p, s in seen.items() if s}
    return out


def test_random_histories(spark):
    rng = random.Random(3)
    for _ in range(2):
        runs = [(r, r * 100, r * 100 + 50, rng.choice(["ok", "ok", "failed"])) for r in range(1, 8)] + [(8, 800, None, "failed")]
        paths = [f"p{i}" for i in range(30)]
        sha = lambda: rng.choice(["aa", "AA", "bb", "cc", "dd"])
        files = [(rng.choice(paths + [None]), 1.0, sha(), rng.randrange(100, 500)) for _ in range(80)]
        walk = [(r, rng.choice(paths + [None]), 1.0, rng.choice([sha(), sha(), None]), rng.randrange(9)) for r in range(5, 9) for _ in range(40)]
        f, w = spark.createDataFrame(files + files[:9], FILES), spark.createDataFrame(walk + walk[:9], WALK)
        got = changes.found(f, w, spark.createDataFrame(runs, RUNS), 5)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == brute(files, walk, runs, 5)


def test_empty_tables(spark):
    f, w, r = spark.createDataFrame([], FILES), spark.createDataFrame([], WALK), spark.createDataFrame([], RUNS)
    assert changes.found(f, w, r, 9).collect() == []


def test_a_run_that_dies_is_repeated_whole(spark, tmp_path):
    runs = spark.createDataFrame([(1, 0, 10, "ok"), (2, 20, 30, "ok"), (3, 40, 50, "ok")], RUNS)
    files = spark.createDataFrame([("a", 1.0, "x", 5), ("b", 1.0, "x", 5)], FILES)
    walk = spark.createDataFrame([(2, "a", 1.0, "y", 21), (2, "c", 1.0, "z", 21), (3, "a", 1.0, "y", 41), (3, "c", 1.0, None, 41)], WALK)
    path = f"file://{tmp_path}/state"
    held, steps = changes.replay(files, walk, runs.where("run_id < 3"), 2, path)
    # data without a manifest, as a dead writer leaves it
    spark.createDataFrame([("ghost", "x")], "path string, sha256 string").write.parquet(f"{path}/data/2-dead")
    again, more = changes.replay(files, walk, runs, 2, path)
    assert [s[0] for s in steps] == [2] and [s[0] for s in more] == [3]
    assert {(r.path, r.sha256) for r in again.live().collect()} == {("a", "y"), ("c", "z")}
    assert {(r.path, r.verdict) for r in again.changes(0, 1).collect()} == {("a", "changed"), ("b", "removed"), ("c", "new")}
    assert again.changes(1, 2).collect() == []
    assert {(r.path, r.verdict) for r in again.changes(0, 2).collect()} == {("a", "changed"), ("b", "removed"), ("c", "new")}


def test_one_writer_per_version(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "k")
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    assert t.commit(rows) == 0
    with pytest.raises(RuntimeError):
        t._publish(0, {})
    assert t.live().drop(*t.AT).collect() == rows.collect()
    assert t.live().where(F.col("__pos") != 0).count() == 0


def test_compaction_changes_no_record(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "k")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    t.commit(rows(("a", 1), ("b", 1), ("c", 1)))
    t.commit(rows(("a", 2), ("d", 1)), t.live().where("k in ('a', 'b')"))
    assert t.compact() == 2 and t.changes(1, 2).count() == 0
    t.commit(rows(("a", 3)), t.live().where("k = 'a'"))
    assert {tuple(r) for r in t.live().select("k", "v").collect()} == {("a", 3), ("c", 1), ("d", 1)}
    assert {tuple(r) for r in t.live(1).select("k", "v").collect()} == {("a", 2), ("c", 1), ("d", 1)}
    want = {("a", "changed"), ("b", "removed"), ("d", "new")}
    assert {(r.k, r.verdict) for r in t.changes(0, 1).collect()} == want == {(r.k, r.verdict) for r in t.changes(0, 3).collect()}
    assert {(r.k, r.v, r.verdict) for r in t.changes(2, 3).collect()} == {("a", 3, "changed")}


def test_a_replay_that_dies_goes_on_and_its_plan_stays_small(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    runs = spark.createDataFrame([(r, r * 100, r * 100 + 50, "ok") for r in range(1, 9)], RUNS)
    files = spark.createDataFrame([(f"p{i}", 1.0, rng.choice("abc"), 110) for i in range(20)], FILES)
    walk = spark.createDataFrame([(r, f"p{i}", 1.0, rng.choice("abc"), r * 100) for r in range(2, 9) for i in rng.sample(range(25), 18)], WALK)
    straight, steps = changes.replay(files, walk, runs, 2, f"file://{tmp_path}/a", compact=3)
    # the second dies in run 5, after its data are written
    publish = VersionedTable._publish
    monkeypatch.setattr(VersionedTable, "_publish", lambda self, v, c: publish(self, v, c) if c["processed"] != 5 else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        changes.replay(files, walk, runs, 2, f"file://{tmp_path}/b", compact=3)
    monkeypatch.setattr(VersionedTable, "_publish", publish)
    again, more = changes.replay(files, walk, runs, 2, f"file://{tmp_path}/b", compact=3)
    assert [s[0] for s in steps] == list(range(2, 9)) and [s[0] for s in more] == list(range(5, 9))
    rows = lambda t: {tuple(r) for r in t.live().select("path", "sha256").collect()}
    assert rows(again) == rows(straight)
    deltas = lambda t, s: [{(r.path, r.verdict) for r in t.changes(b, a).collect()} for _, b, a in s]
    assert deltas(again, more) == deltas(straight, steps)[3:]
    size = lambda v: len(straight.live(v)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(steps[0][2]) == size(steps[1][2]) == size(straight.versions()[-1])
