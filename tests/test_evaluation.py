"""Metrics, labels, the gate, and records of use."""

import json

import pytest

from noteloom.operators import provenance, usage
from noteloom.plans import evaluate, gate
from noteloom.sources import labels


def run(spark, ranked, rel, k):
    q = spark.createDataFrame([(1, "c")], "query_id int, cohort string")
    r = spark.createDataFrame([(1, p, i) for i, p in enumerate(ranked, 1)], "query_id int, path string, rank int")
    j = spark.createDataFrame([(1, p, g) for p, g in rel.items()], "query_id int, path string, grade int")
    return evaluate.per_query(q, r, j, k).first()


@pytest.mark.parametrize(("ranked", "k", "p"), [("axby", 4, 0.5), ("axby", 2, 0.5), ("ab", 5, 0.4), ("", 10, 0.0)])
def test_precision(spark, ranked, k, p):
    assert run(spark, list(ranked), dict.fromkeys("abc", 1), k).precision_at_k == pytest.approx(p)


def test_other_metrics(spark):
    r = run(spark, list("axb"), dict.fromkeys("abc", 1), 3)
    assert r.recall_at_k == pytest.approx(2 / 3) and r.found == ["a", "b"] and r.missing == ["c"]
    assert run(spark, list("xa"), {"a": 1}, 1).reciprocal_rank_at_k == 0 and run(spark, list("xa"), {"a": 1}, 2).reciprocal_rank_at_k == 0.5
    grades = {"a": 3, "b": 2, "c": 1}
    assert run(spark, list("abc"), grades, 3).ndcg_at_k == pytest.approx(1)
    assert run(spark, list("axb"), grades, 3).ndcg_at_k == pytest.approx(0.904949, abs=1e-6)
    neg = run(spark, list("ab"), {"a": 0}, 3)
    assert neg.is_negative and neg.precision_at_k is None and neg.ndcg_at_k is None
    with pytest.raises(ValueError):
        run(spark, [], {}, 0)


def test_aggregate_of_negatives_is_null(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    r = spark.createDataFrame([(1, "a", 1, 0.5), (2, "b", 1, None)], "query_id int, path string, rank int, score double")
    none = spark.createDataFrame([], "query_id int, path string, grade int")
    a = evaluate.aggregate(evaluate.per_query(q, r, none)).first()
    assert a.mean_precision_at_k is None and a.n_negative == 2 and a.mean_top_score_negative is None and a.n_negative_with_top_score == 1


def test_labels():
    good = '{"query":" q ","relevant":["a.md",{"path":"b/c.md","grade":3}]}\n\n{"query":"n","cohort":"x-1","relevant":[]}'
    got = labels.parse(good)
    assert got[0] == {"query": "q", "cohort": None, "judged": {"a.md": 1, "b/c.md": 3}, "graded": True} and not got[1]["graded"]
    for bad in (
        "", '{"query":"","relevant":[]}', '{"query":"q","relevant":["/a.md"]}', '{"query":"q","relevant":["a/../b.md"]}', '{"query":"q","relevant":["a.txt"]}', '{"query":"q","relevant":["a.md","a.md"]}',
        '{"query":"q","relevant":[{"path":"a.md","grade":4}]}', '{"query":"q","cohort":"a b","relevant":[]}', '{"query":"q","relevant":[],"x":1}', '{"query":"q","relevant":[]}\n{"query":"q","relevant":[]}', "no json",
    ):
        with pytest.raises(ValueError):
            labels.parse(bad)
    with pytest.raises(ValueError, match="line 2"):
        labels.parse('{"query":"q","relevant":[]}\n{')


def report(gain=0.0, recall=1.0, policy="rrf_k60", n=20):
    qs = [
        {"query": f"q{i}", "cohort": f"c{i % 4}", "is_negative": False, "precision_at_k": 0.1, "recall_at_k": recall, "reciprocal_rank_at_k": 0.5, "ndcg_at_k": 0.5 + (i % 3) / 100 + gain, "top_score": None}
        for i in range(n)
    ]
    config = {"k": 10, "mode": "hybrid", "rerank": False, "exact_requested": True, "vector_backend": "exact", "fusion_candidate_pool": "bm25_cosine_union", "adaptive_cutoff": False, "fusion_policy": policy, "score_kind": "x"}
    return {"schema_version": 1, "config": config, "provenance": {"labels_sha256": "0123456789abcdef" * 4, "index": "i"}, "queries": qs}


def test_gate():
    ok = gate.compare(report(), report(0.02, policy="new"))
    assert ok["accepted"] and len(ok["checks"]) == 12 and ok["bootstrap_lower"] == pytest.approx(0.02)
    assert not gate.compare(report(), report(0.02, 0.9, "new"))["accepted"]
    assert not gate.compare(report(n=8), report(0.02, policy="new", n=8))["checks"]["held_out_sample_size"]
    assert not gate.compare(report(), report(0.02))["accepted"]
    other = report(0.02, policy="new")
    other["provenance"]["index"] = "j"
    with pytest.raises(ValueError):
        gate.compare(report(), other)
    assert gate.lower_bound([], "0" * 64) is None and gate.lower_bound([float("nan")], "0" * 64) is None


def provenance_run():
    r = {
        "schema_version": 1, "binary_version": "1", "binary_sha256": "a" * 64, "corpus_sha256": "b" * 64, "indexed_files": 100, "indexed_chunks": 200, "embedded_chunks": 200, "embed_model": "m", "embed_dims": 64, "chunk_version": "1",
        "tantivy_version": "1", "fusion_policy": "rrf_k60", "fusion_candidate_pool": "u", "vector_backend": "exact", "exact_requested": True, "automatic_exact_cutoff": 10, "rerank_model": "r", "rerank_policy": "p", "relevance_policy": "q",
        "source_limit": 120, "fusion_limit": 40, "candidate_pool": 30, "rerank_cap": 20, "limit": 10, "returned": 10, "full_body": True, "note_level": True, "metadata_filters": False, "cwd_scope": False, "scope_policy": "c" * 64,
        "scope_elided": 0, "index_refresh_requested": True, "index_refresh_succeeded": True, "result_policy": "n",
    }
    return r | {"pipeline_id": provenance.pipeline_id(r)}


def batch(**change):
    r = provenance_run() | change
    e = {"fusion_rank": 2, "bm25_rank": 1, "cosine_rank": None, "rerank_rank": 1, "final_rank": 1, "rerank_scored": True}
    e["event_id"] = provenance.event_id(r["pipeline_id"], r["corpus_sha256"], "a.md", r["returned"], r["scope_elided"], e)
    return {"run": r, "events": [{"path": "a.md", "provenance": e}]}


def test_provenance(spark):
    provenance.check_batch(batch())
    for change in ({"rerank_cap": 19}, {"source_limit": 119}, {"limit": 0}, {"embedded_chunks": 500}, {"embed_model": ""}):
        with pytest.raises(ValueError):
            provenance.check_batch(batch(**change))
    b = batch()
    b["events"].append(b["events"][0])
    with pytest.raises(ValueError, match="different path"):
        provenance.check_batch(b)
    r = provenance_run()
    d = spark.createDataFrame([tuple(str(r[k]).lower() if isinstance(r[k], bool) else str(r[k]) for k in provenance.IDENTITY)], ", ".join(f"{k} string" for k in provenance.IDENTITY))
    assert d.select(provenance.pipeline_id_column({k: d[k] for k in provenance.IDENTITY})).first()[0] == r["pipeline_id"]


def test_usage(spark):
    log = spark.createDataFrame([("a", 3, 100, 200), ("b", 1, 150, 150)], usage.TICKS)
    moved = usage.rekeyed(log, spark.createDataFrame([("a", "b")], "old_path string, new_path string")).collect()
    assert [tuple(r) for r in moved] == [("b", 4, 100, 200)]
    same = usage.rekeyed(log, spark.createDataFrame([("a", "a")], "old_path string, new_path string"))
    assert {tuple(r) for r in same.collect()} == {("a", 3, 100, 200), ("b", 1, 150, 150)}
    t = spark.createDataFrame([("a", 3, 1, 10), ("b", 3, 1, 30), ("gone", 3, 1, 20)], usage.TICKS)
    f = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.path for r in usage.fame(t, f, 20, True).collect()] == ["b", "gone", "a"]
    assert [r.path for r in usage.fame(t, f).collect()] == ["b", "a"]
    e = spark.createDataFrame([(1, "a", 1, 1, None, None, 1, 0), (2, "a", 3, 2, None, None, 2, 0), (2, "a", 3, 2, None, None, 2, 0)], usage.EVENTS)
    runs = spark.createDataFrame([(1, "p", "x", 5), (2, "p", "y", 6)], "id long, pipeline_id string, corpus_sha256 string, ts long")
    rep = usage.ordered_report(usage.rank_report(t, f, e, runs), t).orderBy("place").collect()
    assert [(r.path, r.corpus_sha256, r.events) for r in rep] == [("b", None, 0), ("a", "y", 1), ("a", "x", 1)]
    o = usage.orphans(t, e, f).first()
    assert (o.ticks, o.events) == (1, 0)
    assert usage.orphans(t.limit(0), e.limit(0), f).first().ticks == 0
    with pytest.raises(ValueError):
        usage.rank_report(t, f, e, runs, 0)


def test_a_batch_is_there_whole_or_not(spark, tmp_path):
    store = f"file://{tmp_path}/use"
    (tmp_path / "use").mkdir()
    usage.record(batch(), ["a.md"], 7, store, spark, "words")
    assert usage.recorded(spark, store, "events").count() == 1 and usage.recorded(spark, store, "runs").first().query_text == "words"
    bad = batch()
    bad["events"][0]["provenance"]["final_rank"] = "no number"
    bad["events"][0]["provenance"]["event_id"] = "x"
    for wrong in (bad, batch(limit=0)):
        with pytest.raises((ValueError, TypeError)):
            usage.record(wrong, ["a.md"], 8, store, spark)
    assert usage.recorded(spark, store, "ticks").count() == 1 and len(list((tmp_path / "use").glob("batch-*"))) == 1
    assert json.loads(usage.recorded(spark, store, "runs").first().provenance_json)["limit"] == 10


def test_payload():
    b, paths, q = usage.payload(json.dumps(batch()), True, "words")
    assert paths == ["a.md"] and q == "words" and usage.payload(json.dumps(batch()))[2] is None
    for bad in (" " * 1_000_001, "{}", json.dumps(batch() | {"x": 1}), json.dumps(batch(limit=0))):
        with pytest.raises(ValueError):
            usage.payload(bad)
    with pytest.raises(ValueError):
        usage.payload(json.dumps(batch()), True, "x" * 16_385)
    assert usage.note_path(" ./a/b.md ") == "a/b.md"
    for bad in ("/a.md", "a/../b.md", "a.txt", ""):
        with pytest.raises(ValueError):
            usage.note_path(bad)


def test_event_ids_of_a_table(spark):
    from noteloom.plans import search

    r = provenance_run()
    d = spark.createDataFrame([("q", 1, "a.md", 2, 1, None, 1), ("q", 2, "b.md", 25, None, 3, None)], "query_id string, pos int, path string, fusion_rank int, bm25_rank int, cosine_rank int, rerank_rank int")
    got = {x.path: x for x in search.with_event_ids(d, r).collect()}
    for x in got.values():
        ranks = {k: x[k] for k in ("fusion_rank", "bm25_rank", "cosine_rank", "rerank_rank", "final_rank", "rerank_scored")}
        assert x.event_id == provenance.event_id(r["pipeline_id"], r["corpus_sha256"], x.path, r["returned"], r["scope_elided"], ranks)
    assert json.loads(search.as_json(d).first().hits) == [{"path": "a.md"}, {"path": "b.md"}]
    assert usage.with_days(spark.createDataFrame([(86_400,)], "ts long"), "ts").first().ts_day == "1970-01-02"


def test_event_problems(spark):
    rows = [(1, "a", 1, 1, 1, 1, 1, 1), (1, "b", 2, 0, 1, None, 2, 0), (2, "a", None, 1, 1, None, 1, 1), (2, "a", 1, 1, 1, 1, 2, 0)]
    got = {(r.run_id, r.path, r.final_rank): set(r.problems) for r in provenance.event_problems(spark.createDataFrame(rows + rows[:1], usage.EVENTS)).collect()}
    assert got == {(1, "b", 2): {"rank below 1"}, (2, "a", 1): {"fusion_rank", "scored without rank", "path repeated"}, (2, "a", 2): {"rank without score", "path repeated"}}
