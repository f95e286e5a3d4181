"""What searches of many queries move and keep: rows that grow with the chunks and the queries, never with their product."""

import math
import random
import re
from collections import Counter

import numpy as np

from noteloom import reference_queries
from noteloom.models import SharedWordsReranker
from noteloom.operators import lexical, vectors
from noteloom.plans import search, stores


def stages(spark):
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    got = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return [got.apply(i) for i in range(got.size())]


def moved(spark, run, what="shuffleWriteRecords"):
    """The rows (or bytes) written to shuffles in run, and what it gives."""
    total = lambda: sum(getattr(s, what)() for s in stages(spark))
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = total()
    got = run()
    bus.waitUntilEmpty()
    return total() - before, got


def brute(chunks, queries, k):
    docs = {i: [re.findall(r"\w+", t.lower()) for t in fields] for i, *fields in chunks}
    n, avg = len(docs), [sum(len(d[f]) for d in docs.values()) / len(docs) for f in (0, 1)]
    counts = {i: [Counter(x) for x in d] for i, d in docs.items()}
    df = [Counter(w for d in counts.values() for w in d[f]) for f in (0, 1)]
    out = []
    for q, text in queries:
        scores = Counter()
        for i, d in counts.items():
            for f in (0, 1):
                for w in {*text.split()} & {*d[f]}:
                    idf, tf = math.log(1 + (n - df[f][w] + 0.5) / (df[f][w] + 0.5)), d[f][w]
                    scores[i] += round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[i][f]) / avg[f])) * 1e9)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, i, s / 1e9, r) for r, (i, s) in enumerate(best, 1)]
    return out


def test_plain_queries_move_no_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    chunks = [(f"{rng.randrange(16**8):08x}", text(2), text(rng.choice((0, 3, 3, 8)))) for _ in range(1500)]
    queries = [(i, " ".join(rng.sample(words + ["nowhere"], 3))) for i in range(150)]
    c = spark.createDataFrame(chunks + chunks[:50], "id string, heading_path string, body string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    run = lambda: [tuple(r) for r in lexical.search(lexical.build(c), lexical.plain_terms(q, "query_id", "query"), 7).orderBy("query_id", "rank").collect()]
    rows, got = moved(spark, run)
    assert got == brute(chunks, queries, 7)
    # 150 queries meet most of 1,500 chunks each; a task of at most eight gives its best
    assert rows < 40_000


def test_vector_scans_give_their_best_once(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{i * 7919 % 100_003:016x}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2_000, 8)).round(1))]
    rows += [(f"{i + 200_000:016x}", rows[0][1]) for i in range(30)]  # equally near
    queries = [(i, rows[i * 3][1]) for i in range(100)]
    # repeated ids lie in other batches and tasks
    c = spark.createDataFrame(rows + rows[::3], "id string, embedding array<float>").repartition(24)
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    cos = np.round(unit(np.float32([v for _, v in queries]).astype(float)) @ unit(np.float32([v for _, v in rows]).astype(float)).T, 9)
    ids = [i for i, _ in rows]
    want = [(k, *x) for k in range(100) for x in [(ids[j], r) for r, j in enumerate(sorted(range(len(ids)), key=lambda j: (-cos[k, j], ids[j]))[:12], 1)]]
    asked = vectors.exact(c, q, 12, 8).select("query_id", "id", "rank").orderBy("query_id", "rank")
    assert [tuple(r) for r in asked.collect()] == want
    n, _ = moved(spark, lambda: vectors.exact(c.localCheckpoint(), q, 12, 8).write.format("noop").mode("overwrite").save())
    assert n < 10_000  # 2,700 rows and 100 queries by task; a list per batch was 100 * 12 rows for each of 24, twice


def test_a_whole_search_moves_no_pairs(spark):
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(9)
    rows = [(f"{i:016x}", f"n{i % 300}.md", i // 300, 0, "h", " ".join(rng.choices(words, k=12)), [rng.gauss(0, 1) for _ in range(4)], 0, "s") for i in range(1_500)]
    c = spark.createDataFrame(rows, "id string, path string, ord int, kind int, heading_path string, body string, embedding array<float>, created_at long, source string").repartition(16)
    q = spark.createDataFrame([(i, " ".join(rng.sample(words, 4)), rows[i][6]) for i in range(200)], "query_id long, query string, embedding array<float>")
    n, hits = moved(spark, lambda: search.search(search.Corpus.of(c, 4), q, search.Options(limit=5, exhaustive=True)).collect())
    assert len(hits) == 1_000
    assert n < 250_000  # over 200 * 1,500 pairs share a word or a direction, of which 200 * 60 per task and list may move


def test_cells_give_their_best_once(spark):
    rng = np.random.default_rng(6)
    rows = [(f"{i:016x}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2_000, 8)))]
    c = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(24).localCheckpoint()
    centres, placed = vectors.cells(c, 8, 8)
    q = c.limit(100)
    near = lambda: vectors.approximate(centres, placed, q, 12, 8, 8, query_id="id")
    # all cells are probed, so it finds what the exact scan finds
    assert {tuple(r) for r in near().select("query_id", "id", "rank").collect()} == {tuple(r) for r in vectors.exact(c, q, 12, 8, query_id="id").select("query_id", "id", "rank").collect()}
    n, _ = moved(spark, lambda: near().write.format("noop").mode("overwrite").save())
    assert n < 10_000


def test_a_stored_index_moves_no_postings(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    chunks = [(f"{rng.randrange(16**8):08x}", text(2), text(rng.choice((0, 30, 60)))) for _ in range(1500)]
    queries = [(i, " ".join(rng.sample(words + ["nowhere"], 3))) for i in range(150)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, heading_path string, body string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    c = frame(chunks + chunks[:50] + [(None, "w1", "w1")])
    store = stores.WordStore(spark, f"file://{tmp_path}/words", stem=False)
    run = lambda: [tuple(r) for r in lexical.search(store.index(), lexical.plain_terms(q, "query_id", "query"), 7).orderBy("query_id", "rank").collect()]
    made, _ = moved(spark, lambda: store.replace(c))
    assert made < 5_000  # 1,550 chunks; they have over 40,000 postings
    read, got = moved(spark, run)
    assert got == brute(chunks, queries, 7)
    assert read < 40_000
    # changed and deleted chunks: their old words are no more, in the index as it grows and when it is put together
    now = [(i, h, "w5 " * 1200 if n < 40 else b) for n, (i, h, b) in enumerate(chunks)] + [("new", "w7", "w7 w8")]
    store.replace(frame(now[:40] + now[-1:]))
    store.delete(frame(now[40:90]).select("id"))
    left = now[:40] + now[90:]
    spots = lambda: sorted((r.term, r.field, r.id, r.tf, *r.places) for r in store.index().postings.collect())
    want = sorted((w, f, i, len(at), *at) for i, *fields in left for f, t in zip(("heading_path", "body"), fields, strict=True) for w in {*t.split()} for at in [[n for n, x in enumerate(t.split()) if x == w]])
    assert run() == brute(left, queries, 7) and spots() == want
    store.compact()
    assert run() == brute(left, queries, 7) and spots() == want


def test_bodies_of_other_chunks_do_not_move(spark):
    rng = random.Random(11)
    rows = [(f"{i:016x}", f"n{i % 100}.md", i // 100, 0, "h", f"w{i % 50} " + rng.randbytes(1500).hex(), [rng.gauss(0, 1) for _ in range(4)], 0, "s") for i in range(2_000)]
    c = spark.createDataFrame(rows + rows[::5], "id string, path string, ord int, kind int, heading_path string, body string, embedding array<float>, created_at long, source string").localCheckpoint()
    q = spark.createDataFrame([(i, f"w{i}", rows[i][6]) for i in range(10)], "query_id long, query string, embedding array<float>")
    body = {r[0]: r[5] for r in rows}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the hits were many
    try:
        for o, reranker in ((search.Options(limit=5, full=True, exhaustive=True), None), (search.Options(limit=5, full=True, rerank=True), SharedWordsReranker())):
            n, hits = moved(spark, lambda o=o, r=reranker: search.search(search.Corpus.of(c, 4), q, o, r).collect(), "shuffleWriteBytes")
            assert len(hits) == 50 and all(h.body == body[h.chunk_id] for h in hits)
            assert n < 2_500_000  # of 6 MB of bodies, 50 are shown and at most 160 are reranked
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_smart_search_moves_no_chunk_whole(spark, tmp_path):
    rng = random.Random(12)
    vector = lambda: [rng.gauss(0, 1) for _ in range(64)]
    rows = [(f"{i:016x}", f"n{i}.md", 0, 0, "h", f"w{i % 50} " + rng.randbytes(1500).hex(), vector(), 0, "s") for i in range(2_000)]
    c = spark.createDataFrame(rows + rows[::5], "id string, path string, ord int, kind int, heading_path string, body string, embedding array<float>, created_at long, source string")
    c.write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(1, 6)], "id long, query_text string").write.parquet(f"{tmp_path}/tick_runs.parquet")
    spark.createDataFrame([(i, vector()) for i in range(7)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n, hits = moved(spark, lambda: reference_queries.smart_search(spark, str(tmp_path)).collect(), "shuffleWriteBytes")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(hits) == 50 and len({(h.query_id, h.path) for h in hits}) == 50
    assert n < 2_500_000  # of 6 MB of bodies, those of at most 150 rows are read


def test_a_tidy_search_looks_chunks_up_as_often_as_any(spark):
    rng = random.Random(13)
    rows = [(f"{i:016x}", f"n{i}.md", 0, 0, "h", f"w{i % 50} w{i % 7}", [rng.gauss(0, 1) for _ in range(4)], 0, "s") for i in range(4_000)]
    c = spark.createDataFrame(rows, "id string, path string, ord int, kind int, heading_path string, body string, embedding array<float>, created_at long, source string").localCheckpoint()
    q = spark.createDataFrame([(i, f"w{i}", rows[i][6]) for i in range(5)], "query_id long, query string, embedding array<float>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = lambda whole: moved(spark, lambda: search.search(search.Corpus.of(c, 4), q, search.Options(limit=5, exhaustive=whole)).collect())
        (n, hits), (m, kept) = run(True), run(False)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(hits) == 25 and {(h.query_id, h.chunk_id) for h in kept} <= {(h.query_id, h.chunk_id) for h in hits}
    assert m < n + 2_000  # a further lookup moves 4,000 chunks
