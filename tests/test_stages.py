"""Stages after fusion on hand-made lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.operators import fusing, lexical, rewriting, stages, vectors

HIT = "query_id int, pos int, id string, path string, score float, rrf float, cosine float, bm25_rank int, cosine_rank int, fusion_rank int, created long, source string, relevance float"


def hits(spark, rows, q=1):
    """rows of dicts; pos counts from 1."""
    names = [c.split()[0] for c in HIT.split(", ")]
    full = [{"query_id": q, "pos": i, "id": f"c{i}", "path": f"p{i}.md", "score": 1.0 / i, "rrf": 1.0 / i, "fusion_rank": i, **r} for i, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], HIT)


def ids(d, c="id"):
    return [r[c] for r in d.orderBy("pos").collect()]


def test_rrf_ties_go_by_id(spark):
    lists = spark.createDataFrame([(1, 0, "b", 1), (1, 0, "a", 2), (1, 1, "a", 1), (1, 1, "b", 2)], "query_id int, list_no int, id string, rank int")
    got = fusing.fused(lists, 10).orderBy("fusion_rank").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].rrf == got[1].rrf
    assert got[0].rrf == pytest.approx(1 / 61 + 1 / 62)
    a = spark.createDataFrame([(1, "b", 9.0, 1), (1, "a", 8.0, 2)], "query_id int, id string, score double, rank int")
    b = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "z", 0.1, 3)], "query_id int, id string, score double, rank int")
    assert [r.id for r in fusing.hybrid(a, b, 2).orderBy("fusion_rank").collect()] == ["a", "b"]


def test_filters(spark):
    d = hits(spark, [{"created": 1001}, {"created": 1000}, {"created": 999}, {}])
    assert ids(stages.since(d, 1000)) == ["c1", "c2"] and stages.since(d, None).count() == 4
    d = hits(spark, [{"source": "Corti"}, {"source": "slack"}, {}])
    assert ids(stages.from_source(d, "corti")) == ["c1"]
    d = hits(spark, [{"path": "a/Scientist/x.md"}, {"path": "b.md"}, {"path": "scientist.md"}, {"path": "c.md"}])
    assert ids(stages.scoped(d, ["scientist"])) == ["c2", "c4"]
    assert stages.elided(d, [" SCIENTIST ", ""]).first().elided == 2
    assert stages.scoped(d, []).count() == 4


def test_dedup(spark):
    rows = [{"path": p, "bm25_rank": b} for p, b in (("a", 5), ("b", 4), ("a", 3), ("c", None), ("b", 1))]
    got = stages.one_per_note(hits(spark, rows)).orderBy("pos").collect()
    assert [(r.path, r.siblings, r.bm25_rank) for r in got] == [("a", 1, 3), ("b", 1, 1), ("c", None, None)]
    assert [r.pos for r in got] == [1, 2, 3] and [r.id for r in got] == ["c1", "c2", "c4"]
    many = [{"path": p} for p in "aabacdbe"]
    cut = stages.truncated(stages.one_per_note(hits(spark, many)), 3).orderBy("pos").collect()
    assert [(r.path, r.siblings) for r in cut] == [("a", 2), ("b", 1), ("c", None)]
    filtered = stages.since(hits(spark, [{"path": "a", "created": 500}, {"path": "a", "created": 2000}, {"path": "b", "created": 2000}]), 1000)
    assert [(r.path, r.siblings) for r in stages.one_per_note(stages.renumbered(filtered)).orderBy("pos").collect()] == [("a", None), ("b", None)]


def test_floors(spark):
    d = hits(spark, [{"score": 1.0, "relevance": 0.9}, {"score": 0.5, "relevance": 0.2}, {"score": 0.4}])
    assert ids(stages.score_floor(d, 50)) == ["c1", "c2"]
    assert ids(stages.relevance_floor(d, 0.5)) == ["c1"] and ids(stages.relevance_floor(d, 0.0)) == ["c1", "c2", "c3"]


GOLD = [0.032786883, 0.03175403, 0.030309988, 0.027912386, 0.025816994, 0.02444842, 0.022785103, 0.019655071, 0.018332252, 0.017220989]


@pytest.mark.parametrize(
    ("scores", "keep"),
    [
        (GOLD, 7), (GOLD[:7], 7), ([1, 0.99, 0.98, 0.5, 0.49, 0.48, 0.47, 0.46], 3), ([0.9**i for i in range(8)], 8), ([1, 0.5, 0.49, 0.48, 0.47, 0.46, 0.45, 0.44, 0.43, 0.01], 10),
        ([1, 0.5, 0.4], 3), ([1, float("nan"), 0.98, 0.5, 0.49, 0.48, 0.47], 7), ([1, 0.9, 0.8, 0.0, 0.0, 0.0], 6), ([0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 6), ([s * 1e3 for s in GOLD], 7),
    ],
)
def test_tidy(spark, scores, keep):
    d = hits(spark, [{"rrf": float(s)} for s in scores])
    assert stages.tidy_lengths(d).first().keep == keep


def test_tidy_never_hides_a_champion(spark):
    rows = [{"rrf": float(s)} for s in [1, 0.99, 0.98, 0.5, 0.49, 0.48, 0.47, 0.46]]
    rows[6]["cosine_rank"] = 3
    assert stages.tidy_lengths(hits(spark, rows)).first().keep == 8
    d = hits(spark, [{}, {"bm25_rank": 3}, {}, {"cosine_rank": 4}, {}])
    assert stages.champion_through(d).first().champion == 2
    tidy = hits(spark, [{"rrf": float(s)} for s in GOLD])
    assert stages.tidied(tidy, 10).count() == 7 and stages.tidied(tidy, 11).count() == 10


def test_rerank(spark):
    assert [stages.rerank_cap(*a) for a in ((15, 60, False), (8, 60, False), (4, 60, False), (15, 10, False), (15, 60, True), (15, 10, True))] == [30, 16, 16, 10, 60, 10]
    d = hits(spark, [{"id": x, "score": s} for x, s in zip("abcde", (0.05, 0.04, 0.03, 0.02, 0.01), strict=True)]).withColumn("logit", F.when(F.col("id") == "b", 3.0).when(F.col("id") == "a", -1.0))
    got = stages.reranked(d, 2).orderBy("pos").collect()
    assert [r.id for r in got] == list("bacde") and got[0].score == pytest.approx(1 / (1 + math.exp(-3))) and got[2].score == pytest.approx(0.03)
    assert [r.rerank_rank for r in got] == [1, 2, None, None, None]


def test_neighbours(spark):
    c = spark.createDataFrame([("n", o, 0 if o < 6 else 1, f"i{o}", f"b{o}") for o in range(8)], "path string, ord int, kind int, id string, body string")
    at = lambda i: [r.ord for r in stages.neighbours(spark.createDataFrame([(1, 1, i)], "query_id int, pos int, id string"), c, 2).orderBy("ord").collect()]
    assert (at("i3"), at("i0"), at("i5"), at("i6"), at("none")) == ([1, 2, 3, 4, 5], [0, 1, 2], [3, 4, 5], [6, 7], [])


def test_bm25_and_query_syntax(spark):
    c = spark.createDataFrame([("1", "Cats", "the cat sat"), ("2", "", "a dog and a cat"), ("3", "", "the dog sat down"), ("4", None, None), ("1", "Cats", "the cat sat")], "id string, heading_path string, body string")
    ix = lexical.build(c)
    run = lambda q: [r.id for r in lexical.search(ix, lexical.query_terms(spark, {"q": q}), 10).orderBy("rank").collect()]
    assert set(run("cat")) == {"1", "2"} and set(run("cat down")) == {"1", "2", "3"}
    assert run("+sat -cat") == ["3"] and run('"dog sat"') == ["3"] and run("heading:cats") == ["1"]
    assert set(run("cat AND sat")) == {"1"} and set(run('what\'s "cat')) == {"1", "2"} and run("!!!") == []
    n, df, tf, ln, avg = 4, 2, 1, 3, (3 + 5 + 4 + 0) / 4
    want = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ln / avg))
    got = lexical.search(ix, lexical.query_terms(spark, {"q": "cat"}), 10).where("id = '1'").first()
    assert got.score == pytest.approx(want, abs=1e-8)
    stemmed = lexical.build(c, stem=True)
    assert "1" in [r.id for r in lexical.search(stemmed, lexical.query_terms(spark, {"q": "cats"}, stem=True), 10).collect()]


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).astype("f4")
    rows = [(f"{i:032x}", m[i].tolist()) for i in range(300)] + [("zz", [1.0] * 7), ("zy", None), ("zx", [float("nan")] + [1.0] * 7), ("zw", [0.0] * 8), (None, [1.0] * 8)]
    s = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(0, m[7].tolist()), (1, [1.0])], "query_id int, embedding array<float>")
    got = [r.id for r in vectors.exact(s, q, 5, 8).orderBy("query_id", "rank").collect()]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert got == [f"{i:032x}" for i in np.argsort(-(u @ u[7]))[:5]]
    assert got == [r.id for r in vectors.expression(s, m[7].tolist(), 5).orderBy("rank").collect()]
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in ("9", "3", "7")], "id string, embedding array<float>")
    q2 = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [r.id for r in vectors.exact(same, q2, 3, 2).orderBy("rank").collect()] == ["3", "7", "9"]
    assert vectors.use_exact(False, 9_999) and not vectors.use_exact(False, 10_000) and vectors.use_exact(True, 10**9)


def test_cells_reach_recall(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(30, 16))
    m = (centre[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype("f4")
    s = spark.createDataFrame([(f"{i:032x}", v.tolist()) for i, v in enumerate(m)], "id string, embedding array<float>")
    c, placed = vectors.cells(s, 16, 24, sample=800)
    placed = placed.cache()
    assert placed.count() == 1500
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(40)] + [(99, [0.0] * 16), (98, None)], "query_id int, embedding array<float>")
    got = {}
    for r in vectors.approximate(c, placed, q, 10, 16, 8).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert set(got) == set(range(40)) and all(len(x) == 10 for x in got.values())
    assert sum(len({f"{j:032x}" for j in np.argsort(-(u @ u[i]))[:10]} & got[i]) for i in range(40)) / 400 >= 0.98


def test_variants(spark):
    raw = "lex: solar panels\nvec: unrelated\nhyde: Anything goes\n<|im_end|>\nlex:\nnonsense: solar\nVEC: about Solar power"
    want = [("lex", "solar panels"), ("hyde", "Anything goes"), ("vec", "about Solar power")]
    assert rewriting.variants(raw, "solar energy") == want
    d = spark.createDataFrame([(raw, "solar energy")], "r string, q string").select(rewriting.parsed(F.col("r"), F.col("q")).alias("v")).first()
    assert [(v.kind, v.text) for v in d.v] == want
    assert [k for k, _ in rewriting.fallback("x")] == ["hyde", "lex", "vec"]

    class Fixed:
        identity = "fixed"
        calls = 0

        def expand(self, q):
            self.calls += 1
            return f"lex: {q} more"

    e = Fixed()
    v, new = rewriting.expanded(spark, {"1": "solar energy"}, e)
    again, none = rewriting.expanded(spark, {"1": "solar energy"}, e, new)
    assert e.calls == 1 and none.count() == 0 and v.collect() == again.collect()
