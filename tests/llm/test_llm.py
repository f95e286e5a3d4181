"""Operators for training data against brute force, round trips, and awkward inputs."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("noteloom.llm")
from noteloom.llm import fusion, leakage, markup, mixing, mojibake, neardup, neighbours, splitting  # noqa: E402

# ---- 1 neighbours


def planted(rng, n, width, groups):
    m = rng.normal(size=(n, width))
    for g in range(groups):
        base = rng.normal(size=width)
        for _ in range(6):
            m[rng.integers(n)] = base + 0.2 * rng.normal(size=width)
    return m.astype("f4")


def brute(m, ids, k, floor):
    u = m.astype("f8") / np.linalg.norm(m.astype("f8"), axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(m)):
        near = [(-round(s[i, j], 12), ids[j]) for j in range(len(m)) if j != i and s[i, j] >= floor]
        out |= {tuple(sorted((ids[i], j))) for _, j in sorted(near)[:k]}
    return out


@pytest.mark.parametrize(("width", "flat"), [(16, 4_096), (64, 4_096), (100, 4_096), (64, 20)])
def test_join_recall(spark, monkeypatch, width, flat):
    monkeypatch.setattr(neighbours, "FLAT", flat)  # pivots over it hang below leading ones
    m = planted(np.random.default_rng(width), 1500, width, 60)
    ids = [f"v{i:05d}" for i in range(len(m))]
    d = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, m, strict=True)], "id string, embedding array<float>, cell string").repartition(5)
    got = {tuple(r) for r in neighbours.found(d, "id", "embedding", width).collect()}
    want = brute(m, ids, 10, 0.92)
    assert len(want) > 100 and len(got & want) / len(want) >= 0.9 and len(got - want) <= 0.01 * len(want)


def test_an_exact_join_finds_all(spark):
    m = planted(np.random.default_rng(60), 700, 16, 40)
    ids = [f"v{i:05d}" for i in range(len(m))]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m, strict=True)], "id string, embedding array<float>")
    got = {tuple(sorted((r.id, r.neighbour))) for r in neighbours.join(d, "id", "embedding", 16, block=100, exact=True).collect()}
    assert got == brute(m, ids, 10, 0.92) and len(got) > 50


def test_sifting_keeps_all_that_reach_the_floor():
    rng = np.random.default_rng(61)
    m = rng.normal(size=(1_500, 12)).astype("f4")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    q = neighbours.unpacked(neighbours.packed(m), 12)
    on, _ = neighbours.reaching(q, q, 0.8, True)
    s = m.astype("f8") @ m.T.astype("f8")
    np.fill_diagonal(s, -2)
    assert on[s.max(axis=1) >= 0.8].all() and 0 < on.mean() < 1


def test_copies_skew_and_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8).astype("f4")
    rows = [(f"c{i:03d}", (base * (2.0 ** (i % 3))).tolist()) for i in range(60)]  # a third and more are one vector
    rows += [(f"z{i}", rng.normal(size=8).astype("f4").tolist()) for i in range(20)]
    rows += [("n1", None), ("n2", [0.0] * 8), ("n3", [1.0] * 7), ("n4", [float("inf")] + [1.0] * 7), ("n5", [float("nan")] * 8), (None, [1.0] * 8), ("c000", base.tolist())]
    d = spark.createDataFrame(rows, "id string, embedding array<float>")
    j = neighbours.join(d, "id", "embedding", 8, k=5, floor=0.99).collect()
    assert {r.id for r in j} == {f"c{i:03d}" for i in range(60)}
    for i in range(60):
        mine = sorted(r.neighbour for r in j if r.id == f"c{i:03d}")
        assert mine == [f"c{n:03d}" for n in range(7) if n != i][:5]
    assert neighbours.found(d.limit(0), "id", "embedding", 8).collect() == []


def test_a_cell_over_the_block_size(spark):
    rng = np.random.default_rng(6)
    m = (rng.normal(size=8) + 0.02 * rng.normal(size=(300, 8))).astype("f4")
    ids = [f"v{i:03d}" for i in range(300)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m, strict=True)], "id string, embedding array<float>")
    j = neighbours.join(d, "id", "embedding", 8, k=4, floor=0.9, block=40)
    got = {tuple(sorted((r.id, r.neighbour))) for r in j.collect()}
    want = brute(m, ids, 4, 0.9)
    assert len(got & want) / len(want) >= 0.9


def test_quantised_bounds_hold():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(200, 33)).astype("f4")
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    q, s, e = neighbours.quantised(a)
    est = (q.astype("f4") @ q.T.astype("f4")) * s[:, None] * s[None]
    slack = (1 + e)[:, None] * e[None] + e[:, None] + 1e-5
    assert (np.abs(a @ a.T - est) <= slack).all()


def test_search_is_exact(spark):
    m = np.random.default_rng(8).normal(size=(400, 24)).astype("f4")
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>")
    got = neighbours.search(d, "id", "embedding", 24, d.where("id % 20 = 0"), 10, row_block=90, query_block=7).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 400, 20):
        s = u @ u[q]
        s[q] = -2
        assert {r.neighbour for r in got if r.id == q} == set(np.argsort(-s)[:10].tolist())


# ---- 2 fusion


@pytest.mark.parametrize("one_task", [200_000, 90, 1])
def test_fusion_against_brute_force(spark, one_task):
    rng = random.Random(2)
    val = lambda: rng.choice([None, float("nan"), float("inf"), 1.0, 2.0, rng.random() * 1e4, -rng.random()])
    rows = [(rng.choice([1, 1, 1, 2, None]), f"i{rng.randrange(60)}", val(), val(), val(), "x") for _ in range(300)]
    d = spark.createDataFrame(rows + rows[:20], "run int, id string, a double, b double, c double, pos string")
    best = {}
    for run, i, *v, _ in rows:
        if run is not None:
            o = best.setdefault((run, i), [None] * 3)
            for k, x in enumerate(v):
                if x is not None and math.isfinite(x):
                    o[k] = x if o[k] is None else max(o[k], x)
    every = fusion.fuse(d, "run", "id", ["a", "b", "c"], one_task=one_task).collect()
    got = {(r.run, r.id): r for r in every}
    assert set(got) == set(best) and len(every) == len(got)
    for run in (1, 2):
        mine = {i: v for (r, i), v in best.items() if r == run}
        pos = {i: [None if v[k] is None else 1 + sum(w[k] is not None and w[k] > v[k] for w in mine.values()) for k in range(3)] for i, v in mine.items()}
        fused = {i: sum(1 / (60 + p) for p in ps if p) for i, ps in pos.items()}
        order = sorted(mine, key=lambda i: (-round(fused[i], 12), i))
        for i in mine:
            r = got[run, i]
            assert [r.a_pos, r.b_pos, r.c_pos] == pos[i] and r.n == len(mine) and r.fused == pytest.approx(fused[i], abs=1e-12)
        assert sorted(mine, key=lambda i: got[run, i].place) == order
        n = math.ceil(len(mine) / 10)
        want = {i for i, p in pos.items() if all(x is not None and x <= n for x in p)}
        assert {r.id for r in fusion.best_by_all(d, "run", "id", ["a", "b", "c"], one_task=one_task).where(f"run = {run}").collect()} == want
    assert fusion.fuse(d.limit(0), "run", "id", ["a", "b", "c"], one_task=one_task).collect() == []


@pytest.mark.parametrize("one_task", [200_000, 10])
def test_a_run_of_equal_scores_is_ordered_by_item(spark, one_task):
    d = spark.createDataFrame([(1, f"i{k:04d}", 1.0, None) for k in range(500)] + [(2, "x", 1.0, None)], "run int, id string, a double, b double").repartition(4)
    got = fusion.fuse(d, "run", "id", ["a", "b"], one_task=one_task)
    assert [r.id for r in got.where("run = 1").orderBy("place").collect()] == [f"i{k:04d}" for k in range(500)]
    assert {(r.place, r.a_pos) for r in got.where("run = 2").collect()} == {(1, 1)} and got.agg(F.max("place")).first()[0] == 500


# ---- 3 markup


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a <b>bold</b> word", {"html"}), ("x<br/>y", {"html"}), ("one <!-- no --> two", {"html"}), ("R&amp;D", {"html"}), ("&#8217;", {"html"}), ("a **b c** d", {"markdown"}), ("a _b_ c", {"markdown"}), ("~~x~~", {"markdown"}),
        ("`x`", {"markdown"}), ("[a](b.md)", {"markdown"}), ("![a](b.png)", {"markdown"}), ("x[^1]", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("see [text][ref]", {"markdown"}),
        ("[[Note|x]]", {"wiki"}), ("{{main|x}}", {"wiki"}), ("{| class=\"a\"\n|-\n| x\n|}", {"wiki"}), ("a ''b'' c", {"wiki"}), ("== Head ==\nx", {"wiki"}), ("\\textbf{x} y", {"latex"}), ("\\begin{equation}\na\n\\end{equation}", {"latex"}),
        ("~\\cite{a}", {"latex"}), ("a < b and c > d", set()), ("Vec<u8> and Map<K, V>", set()), ("Costs $5 now and $12 later", set()), ("With $\\alpha_1 = x_2$ fine", set()), ("$$\\frac{a}{b}$$", set()), ("C:\\notes\\temp\\new", set()),
        ("__init__.py and chunk_id_next", set()), ("4 * 3 * 2", set()), ("array[i][0], row [1] [sic]", set()), ("- [ ] todo\n- [x] done\n1. one", set()), ("```\n<b>x</b> **y** [[z]] \\textbf{q}\n```", set()), ("ratio == 1.5 holds", set()),
        ("~3 days at 50%", set()), ("The R&D shelf; x", set()), ("it's the 'soft' one", set()), ("Braces {a, b}", set()), ("", set()), (None, set()),
    ],
)
def test_languages(spark, text, want):
    d = spark.createDataFrame([("k", text, "h", "x"), ("k", text, "h", "x")], "id string, body string, heading_path string, markup_text string")
    rows = markup.residue(d, "id", ["body", "heading_path"]).collect()
    assert {r.markup for r in rows} == want and len(rows) == len(want)


def test_cleaning_keeps_structure(spark):
    t = "<h2>Head</h2>\n<p>Some <b>bold</b> &amp; [[Page|shown]] text{{x}} **strong** \\emph{x}.</p>\n<ul><li>one</li><li>two</li></ul>\n<pre><code>a < b</code></pre>\n$\\alpha_1$\n\n```\n<b>kept</b>\n```\n\\section{S}\n== W =="
    d = spark.createDataFrame([(t,), (None,), ("",), ("plain " * 50_000,)], "t string").select(markup.cleaned(F.col("t"))).collect()
    out = d[0][0]
    for part in ("## Head", "Some bold & shown text strong x.", "- one", "- two", "```\na < b\n```", "$\\alpha_1$", "<b>kept</b>", "# S", "## W"):
        assert part in out, (part, out)
    assert d[1][0] is None and d[2][0] == "" and d[3][0] == "plain " * 50_000


def test_cleaning_reaches_any_depth(spark):
    deep = 9
    wiki = "a " + "{{box|x=" * deep + "z" + "}}" * deep + " b"
    latex = "a " + "\\emph{" * deep + "z" + "}" * deep + " b"
    got = [r[0] for r in spark.createDataFrame([(0, wiki), (1, latex)], "i int, t string").orderBy("i").select(markup.cleaned(F.col("t"))).collect()]
    assert got == ["a  b", "a z b"]


# ---- 5 splitting


def test_splitting(spark):
    rng = random.Random(4)
    fence = "```\n" + "code\n\n" * 40 + "```\n"
    texts = ["", "  ", None, "short", "x" * 9_000, ("word " * 30 + "\n\n") * 60, "🙂é\n" * 3_000, fence * 30, "```\n" + "y\n" * 4_000 + "```\n", "a. " * 3_000, "\r\n".join(["line " * 20] * 90), "z" * 3_150, "z" * 3_151]
    block = lambda n: "```\n" + "k\n" * n + "```"
    texts += ["a. " * 900 + "\n" + block(1_500) + "\n" + "b. " * 900, block(1_440) + "\n" + "e " * 2_000]
    texts += ["".join(rng.choice([" ", "\n\n", "ab", "。", "```\n", "# H\n", "x" * 300]) for _ in range(900)) for _ in range(6)]
    d = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "id int, body string, piece_text string")
    got = {}
    for r in splitting.split(d, "body").orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append(r)
    for i, t in enumerate(texts):
        ps = got.get(i, [])
        if t is None or not t.strip(" "):
            assert not ps
            continue
        assert "".join(p.piece_own for p in ps) == t and all(len(p.piece) <= 3_150 for p in ps)
        assert [p.piece_no for p in ps] == list(range(len(ps)))
        for a, b in zip(ps, ps[1:], strict=False):
            assert b.piece == b.piece[: b.overlap_chars] + b.piece_own and (a.piece + "").endswith(b.piece[: b.overlap_chars][-50:])
    assert len(got[3]) == 1 and len(got[11]) == 1 and len(got[12]) == 2 and len(got[4]) >= 3
    own = [p.piece_own for p in got[7]]
    assert all(o.count("```") % 2 == 0 for o in own)
    for i, n in ((13, 1_500), (14, 1_440)):  # blocks that fit aren't cut, even where they leave less room than an overlap
        assert any(block(n) in p.piece_own for p in got[i]) and len(got[i]) > 1
    k = splitting.kept(d, "id", "body").collect()
    assert all(r.within and r.in_order and r.overlaps_fit and r.n_chars == len(texts[r.id]) for r in k) and len(k) == len(got)
    assert {r.id: r.n_fences for r in k}[13] == 1 and {r.id: r.n_fences for r in k}[7] == 30
    assert all(o.endswith("\n\n") for o in [p.piece_own for p in got[5]])


def test_oversized(spark):
    rows = [("p", "a " * 2_000), ("r", "a" * 3_151), ("f", "```\n" + "x " * 1_700 + "\n```"), ("s", "a" * 3_150), ("m", "```\n" + "b" * 3_140 + "\n```\n" + "c " * 30), ("g", "a" * 2_000 + "\n```\nx\n```\n" + "b" * 2_000), ("n", None), (None, "a" * 4_000), ("u", "```\n" + "x " * 2_000)]
    got = {tuple(r) for r in splitting.oversized(spark.createDataFrame(rows + rows[:3], "id string, body string"), "id", "body").collect()}
    assert got == {("p", "plain"), ("r", "run"), ("f", "fence"), ("m", "plain"), ("g", "plain"), ("u", "plain")}


# ---- 7 near-duplicates


def shingles(t, n):
    w = re.findall(r"[^\W_]+", t.lower())
    return frozenset(zip(*[w[i:] for i in range(n)], strict=False))


@pytest.mark.parametrize(("width", "t"), [(3, 0.6), (5, 0.8)])
def test_similar_against_brute_force(spark, width, t):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 90))]
        for c in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((f"d{g:02d}{c}", f"p{rng.randrange(40)}", " ".join(w)))
    rows += [("e1", "p1", ""), ("e2", "p2", None), ("e3", "p3", "two words"), (None, "p", "a b c d e f"), ("x1", "q1", "Same, text. here again now then!"), ("x2", "q2", "same text here again now THEN")]
    d = spark.createDataFrame([(*r, "k") for r in rows + rows[:10]], "id string, path string, body string, sim string")
    got = {(r.id_a, r.id_b): r.sim for r in neardup.similar(d, "id", "body", "path", width, t).collect()}
    sets = {r[0]: (shingles(r[2] or "", width), r[1]) for r in rows if r[0]}
    want = {}
    for a in sets:
        for b in sets:
            (x, p), (y, q) = sets[a], sets[b]
            if a < b and p != q and x and y and len(x & y) >= t * len(x | y) - 1e-9:
                want[a, b] = len(x & y) / len(x | y)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 5


@pytest.mark.parametrize("group", [2_000, 1])
def test_groups_of_several_classes_lose_no_pair(spark, monkeypatch, group):
    monkeypatch.setattr(neardup, "GROUP", group)
    # x0 and x1 have the same rare words in front, so one prefix, but other common words behind; y is near x1 alone
    rows = []
    say = lambda x, n: " ".join(f"{x}n{i}" for i in range(n))
    for g in range(8):
        head = [f"h{g}n{i}" for i in range(18)]
        tails = [f"in between {say(f'b{g}t{k}', 22)}" for k in range(2)]
        rows += [(f"x{g}{k}", f"{' '.join(head)} {tails[k]}") for k in range(2)]
        rows.append((f"y{g}", f"{say(f'o{g}', 8)} {' '.join(head[8:])} {tails[1]}"))
        rows += [(f"z{g}{k}{i}", f"{say(f'z{g}t{k}i{i}', 60)} {tails[k]}") for k in range(2) for i in range(4)]
    got = {(r.id_a, r.id_b) for r in neardup.similar(spark.createDataFrame(rows, "id string, body string"), "id", "body", None, 3, 0.6).collect()}
    assert got == {(f"x{g}1", f"y{g}") for g in range(8)}


def test_a_large_group_of_near_classes_meets_in_blocks(spark, monkeypatch):
    # all begin with the same rare words and end in one of a few common ones: classes of one prefix and size
    monkeypatch.setattr(neardup, "GROUP", 4)
    head = " ".join(f"r{i}" for i in range(40))
    rows = [(f"d{k:02d}", f"{head} c{k}") for k in range(20)] + [(f"o{k:02d}{j}", f"c{k} o{k}x{j} " * 25) for k in range(20) for j in range(3)]
    got = neardup.similar(spark.createDataFrame(rows, "id string, body string"), "id", "body", None, 3, 0.8)
    assert {(r.id_a, r.id_b) for r in got.collect() if r.id_a[0] == "d"} == {(f"d{a:02d}", f"d{b:02d}") for a in range(20) for b in range(a + 1, 20)}


def test_a_large_class_keeps_its_links(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w20 ", "zz ")
    rows = [(f"c{i:03d}", f"p{i}", text) for i in range(100)] + [("d", "pd", near)]
    got = [tuple(r) for r in neardup.similar(spark.createDataFrame(rows, "id string, path string, body string"), "id", "body", "path", 3, 0.6).select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and ("c000", "d") in got
    assert {x for p in got for x in p} == {r[0] for r in rows}
    links = spark.createDataFrame(got, "id_a string, id_b string")
    assert {r.group for r in neardup.components(links, "id_a", "id_b").collect()} == {"c000"}


@pytest.mark.parametrize("part", [256, 7])
def test_copies_give_all_pairs(spark, monkeypatch, part):
    # most copies lie under one path; the few others have the largest ids
    monkeypatch.setattr(neardup, "PART", part)
    a = " ".join(f"w{i}" for i in range(40))
    b = a.replace("w20 ", "zz ")
    rows = [(f"{'y' if i > 37 else 'a'}{i:03d}", f"p{i}" if i > 37 else "hot", a) for i in range(40)]
    rows += [(f"{'z' if i > 37 else 'b'}{i:03d}", f"q{i % 2}" if i > 37 else "hot", b) for i in range(40)]
    rows += [(f"c{i:02d}", f"r{i}", "other " + a[4:]) for i in range(33)]
    d = spark.createDataFrame(rows + rows[:5], "id string, path string, body string")
    got = [(r.id_a, r.id_b) for r in neardup.similar(d, "id", "body", "path", 3, 0.6).collect()]
    sets = {i: (p, shingles(t, 3)) for i, p, t in rows}
    want = {(x, y) for x, (p, u) in sets.items() for y, (q, v) in sets.items() if x < y and p != q and len(u & v) >= 0.6 * len(u | v) - 1e-9}
    assert len(got) == len(set(got)) and set(got) == want
    g = neardup.grouped(d, "id", "body", 3, 0.6).collect()
    assert sorted(r.id for r in g) == sorted(sets) and {(r.group_id, r.links) for r in g} == {("a000", len(sets) - 1)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")], "a string, b string")
    got = {r.node: r.group for r in neardup.components(links, "a", "b").collect()}
    assert len(got) == 63 and {v for k, v in got.items() if k[0] == "n"} == {"n000"} and got["y"] == "x"


def test_hot_members_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 5)
    rows = [(f"d{i:02d}", " ".join([f"common{j}" for j in range(20)] + [f"own{i}x{k}" for k in range(2)])) for i in range(25)]
    d = spark.createDataFrame(rows, "id string, body string")
    got = {(r.id_a, r.id_b) for r in neardup.similar(d, "id", "body", None, 3, 0.6).collect()}
    assert len(got) == 25 * 24 // 2
    g = neardup.grouped(d, "id", "body", 3, 0.6).collect()
    assert {r.group_id for r in g} == {"d00"} and {r.links for r in g} == {24}


# ---- 8 leakage


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, say(rng.randrange(5, 60))) for i in range(50)]
    docs = []
    for i in range(120):
        w = say(rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            _, src = rng.choice(items)
            n = rng.choice([8, 11, 12, 13, 40])
            k = rng.randrange(max(1, len(src) - n + 1))
            at = rng.randrange(len(w) + 1)
            w = w[:at] + src[k : k + n] + w[at:]
        docs.append((i, ", ".join(w).upper()))
    docs += [(900, None), (901, ""), (None, "x")]
    want = set()
    grams = {i: {tuple(w[k : k + 12]) for k in range(len(w) - 11)} for i, w in items}
    for i, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        mine = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(i, j) for j, g in grams.items() if i is not None and g & mine}
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (None, "x")], "item_id long, text string")
    for shard in (2_000_000, 300):
        rows = [tuple(r) for r in leakage.leaks(d, "doc_id", "text", e, "item_id", "text", shard_words=shard).collect()]
        assert set(rows) == want and len(rows) == len(want) > 20
    assert leakage.leaks(d, "doc_id", "text", e.limit(0), "item_id", "text").collect() == []


def test_wand_finds_what_all_scores_give():
    rng = random.Random(81)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12, 40)))) for i in range(70)]
    index = leakage.ItemIndex(items, block=4)
    queries = np.full((60, 24), -1, np.int32)
    for q in queries:
        terms = sorted(rng.sample(range(40), rng.randrange(4, 20)))
        q[: len(terms)] = terms
    full = np.zeros((40, index.n))
    full[index.key // index.n, index.key % index.n] = index.impact
    want = {(q, k) for q in range(60) for k in np.flatnonzero(full[queries[q][queries[q] >= 0]].sum(axis=0) >= leakage.NEAR)}
    assert set(index._wand(queries)) == want and len(want) > 60


def test_an_index_of_many_items_is_small():
    rng = np.random.default_rng(82)
    items = [(k, " ".join(f"t{x}" for x in w)) for k, w in enumerate(rng.zipf(1.2, size=(40_000, 50)) % 100_000)]
    index = leakage.ItemIndex(items)
    held = sum(x.nbytes for x in (index.key, index.impact, index.first, index.block_key, index.block_max, index.term_max, *index.seqs))
    assert held < 100_000_000
    assert [b for _, b in index.search([f"so {items[123][1]} it is"])] == [123]


# ---- 9 mixing


@pytest.mark.parametrize("fly", [mixing.flight, mixing.flight_in_lanes])
def test_cube_keeps_the_totals(fly):
    rng = np.random.default_rng(9)
    pi = np.full(400, 0.3)
    tok = rng.integers(1, 500, 400).astype(float)
    tokens, counts = [], []
    for s in range(60):
        out = mixing.land(fly(pi, np.vstack([np.ones(400), tok]), np.random.default_rng(s)), tok, np.random.default_rng(s + 1000))
        assert set(np.unique(out)) <= {0.0, 1.0}
        tokens.append((out * tok).sum())
        counts.append(out.sum())
    assert max(counts) - min(counts) <= 2
    assert np.std(tokens) < 0.15 * np.sqrt((tok**2 * 0.3 * 0.7).sum())
    assert abs(np.mean(tokens) - 0.3 * tok.sum()) < 0.02 * tok.sum()


def test_lanes_of_equal_units_draw_fairly():
    tok = np.full(1_000, 7.0)
    taken = sum(mixing.land(mixing.flight_in_lanes(np.full(1_000, 0.25), np.vstack([np.ones(1_000), tok / 7]), np.random.default_rng(s)), tok, np.random.default_rng(s)) for s in range(200))
    assert taken.sum() == 200 * 250 and abs(taken[:500].sum() - taken[500:].sum()) < 1_500 and taken.max() < 90 and taken.min() > 20


def test_mix(spark):
    rows = [(i, "word " * (1 + i % 7), ("A", "a ", "b_c", "B-c", None, "zz")[i % 6]) for i in range(600)] + [(1, "word " * 2, "a "), (700, None, "a"), (None, "x", "a")]
    d = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, tokens int")
    t = spark.createDataFrame([("a", 0.5, 1), ("b-c", 0.4, 3), ("none", 0.1, 2)], "src_name string, target_share double, max_repeats int")
    m = mixing.mix(d, t).cache()
    assert m.count() == m.select("doc").distinct().count() and m.agg(F.max("copies")).first()[0] <= 3
    assert m.where("src = 'a'").agg(F.max("copies")).first()[0] == 1
    s = {r.src_name: r for r in mixing.shares(m, t).collect()}
    assert s["none"].tokens == 0 and s["a"].reached_share == pytest.approx(5 / 9, abs=0.01) and s["b-c"].reached_share == pytest.approx(4 / 9, abs=0.01)
    again = mixing.mix(d.repartition(7), t)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in m.collect()}
    assert mixing.mix(d.limit(0), t).collect() == []
    units = spark.createDataFrame([(i, "a", 1 + i % 9, 0.4) for i in range(500)], "doc long, src string, tokens long, pi double")
    drawn = mixing.drawn(units, 1, block=40).collect()
    assert len(drawn) == 500 and abs(sum(r["take"] for r in drawn) - 200) <= 2 and abs(sum(r["take"] * r.tokens for r in drawn) - 0.4 * sum(r.tokens for r in drawn)) < 40


# ---- 10 encodings

CLEAN = {
    "de": "Wir müssen die Mülltonnen prüfen bevor der Hausmeister zurückkommt Größe und Gewicht über die Tür",
    "fr": "Le frère aîné a déplacé la boîte à épices près de l’école après la tempête où ça a marché",
    "pl": "Jutro trzeba sprawdzić łóżko polowe bo padał śnieg i mąż sąsiadki zdąży przed świętem",
    "ru": "Проект ждёт поисковый указатель уже много дней и запасной ключ лучше хранить в новый шкаф",
    "ja": "倉庫の温度計の記録は古いので検索に時間がかかる。隣の人が駅前で会議の議事録を確認した。",
}
DAMAGE = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("cp1252", "cp437"), ("cp1251", "latin-1"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("cp1250", "cp1252")]


def test_restoring(spark):
    rows, want = [], {}
    for n in range(40):
        for lang, t in CLEAN.items():
            w = t.split()
            rows.append((len(rows), f"Note {n}\n\n" + (" ".join(w[n % 5 :] + w[: n % 5]) if lang != "ja" else t)))
    for lang, t in CLEAN.items():
        for true, read in DAMAGE:
            try:
                bad = t.encode(true).decode(read)
            except UnicodeError:
                continue
            if bad != t:
                want[len(rows)] = (t, 0)
                rows.append((len(rows), f"Plain words first.\n\n{bad}"))
    t = CLEAN["de"]
    want[len(rows)] = (t, 1)
    rows.append((len(rows), "Plain words first.\n\n" + t.encode("cp1252").decode("utf-8", "replace")))
    double = t.encode().decode("cp1252").encode().decode("cp1252", "replace")
    want[len(rows)] = (t, int("�" in double))
    rows.append((len(rows), "Plain words first.\n\n" + double))
    first = min(want)
    rows += [(9_000, None), (9_001, ""), (9_002, "ascii"), (None, "für"), (9_003, "Âme, Îlot, Être, Ô joie. SÃO JOÃO, NÃO É OPÇÃO. Ångström § 5")]
    got = {r.id: r for r in mojibake.restored(spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, lossy int"), "id", "text").collect()}
    assert not [k for k in got if k is None or k < first or k >= 9_000], [got[k].text for k in got if k < first or k >= 9_000]
    missed = [rows[k][1] for k in want if k not in got]
    assert len(missed) <= 0.05 * len(want), missed
    whole = sum(got[k].restored.endswith(t) for k, (t, _) in want.items() if k in got)
    assert whole >= 0.85 * len(want), [(got[k].restored, t) for k, (t, _) in want.items() if k in got and not got[k].restored.endswith(t)][:5]
    assert all(got[k].lossy == lossy for k, (_, lossy) in want.items() if k in got)
    assert mojibake.restored(spark.createDataFrame([], "id long, text string"), "id", "text").collect() == []


def test_each_code_page_loses_its_own_bytes():
    assert mojibake.UNSHOWN["cp1252"] == (0x81, 0x8D, 0x8F, 0x90, 0x9D) and mojibake.UNSHOWN["cp1250"] == (0x81, 0x83, 0x88, 0x90, 0x98) and not mojibake.UNSHOWN["latin-1"]
    words = {"Łukasz": 9, "ŁĄŁŁŁŁŁĄ": 5, "zażółć": 9, "Ł": 4, "ł": 9, "Ń": 2, "Schlüssel": 8, "für": 30, "год": 20, "Март": 9}
    m = mojibake.Model(list(words.items()))
    for true, read, word in (("utf-8", "cp1250", "Łukasz"), ("utf-8", "cp1250", "ŁĄŁŁŁŁŁĄ"), ("cp437", "cp1252", "Schlüssel"), ("utf-8", "cp1251", "Март")):
        bad = "".join(bytes([b]).decode(read, "replace") for b in word.encode(true))
        assert m._through(bad, read, true) == word, (bad, word)
    # nothing known fits: each place by its commonest character, through many lost bytes as well
    assert m._through("".join(bytes([b]).decode("cp1250", "replace") for b in "xŁŁŁŁŁŁŁx".encode()), "cp1250", "utf-8") == "xŁŁŁŁŁŁŁx"
    assert m._through("w�re", "cp1252", "cp437") is None and m._through("�", "cp1252", "cp437") is None


def test_words_beyond_the_broadcast_count(spark):
    rows = []
    for n in range(12):
        for lang, t in CLEAN.items():
            w = t.split()
            rows.append(f"Note {n}\n\n" + (" ".join(w[n % 5 :] + w[: n % 5]) if lang != "ja" else t))
    for t in CLEAN.values():
        for true, read in DAMAGE:
            try:
                rows.append(f"Plain words first.\n\n{t.encode(true).decode(read)}")
            except UnicodeError:
                pass
    t = CLEAN["de"]
    rows += ["First. " + t.encode("cp1252").decode("utf-8", "replace"), "First. " + t.encode().decode("cp1252").encode().decode("cp1252", "replace"), "First. " + CLEAN["ru"].encode().decode("cp1252", "replace"), "First. " + CLEAN["pl"].encode().decode("cp1250", "replace"), "First. " + CLEAN["de"].encode("cp437").decode("cp1252", "replace")]
    d = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    whole, few = ({tuple(r) for r in mojibake.restored(d, "id", "text", size).collect()} for size in (200_000, 10))
    assert len(whole) > 15 and {r[:3] + r[4:] for r in few} == {r[:3] + r[4:] for r in whole}
    gain = {r[0]: r[3] for r in few}
    assert all(gain[r[0]] == pytest.approx(r[3]) for r in whole)
