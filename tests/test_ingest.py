"""Notes, chunks, the store, export, events and streams."""

import hashlib
import json
import os

import numpy as np
import pytest

from noteloom.models import HashedBagEmbedder, SharedWordsReranker, fit_context
from noteloom.operators import chunking, provenance
from noteloom.plans import index, search
from noteloom.sources import events, export, notes
from noteloom.streaming import ingest


def parts(text):
    return [(o, k, h, b) for _, o, k, h, b in chunking.chunks_of("n.md", text)]


def test_headings():
    assert parts("just a bare idea") == [(0, 0, "", "just a bare idea")]
    got = parts("# T\n\n## A\n\nalpha\n\n## Empty\n\n## B\n\nbeta\n")
    assert got == [(0, 0, "T > A", "alpha"), (1, 0, "T > Empty", "Empty"), (2, 0, "T > B", "beta")]
    assert [h for _, _, h, _ in parts("# Meeting\n## A\n## B\n## C")] == ["Meeting > A", "Meeting > B", "Meeting > C"]
    assert parts("# Only") == [(0, 0, "Only", "Only")]
    assert parts("") == parts("  \n") == parts(None) == []
    assert parts("Title\n===\n\ntext\n\nSub\n---\n\nmore") == [(0, 0, "Title", "text"), (1, 0, "Title > Sub", "more")]
    assert parts("#### low\n\nx")[0][3].startswith("low")
    assert chunking.chunks_of("a.md", "x")[0][0] == hashlib.sha256(b"a.md#0").hexdigest()


def test_frontmatter_and_fields():
    got = parts('---\ncreated: 2024-01-01T10:00\nsource: s\nstatus: open\ncorti: {"mode":"live"}\n---\n# T\n\nbody')
    assert got == [(0, 0, "T", "body"), (1, 1, "Frontmatter > corti", "corti mode live")]
    assert parts("---\ncreated: x\n\nbody")[0][1] == 0
    long = parts('---\nblob: "' + "x" * 10_000 + '"\n---\nhi')
    assert sum(k == 1 for _, k, _, _ in long) > 1 and all(chunking.estimated(b) <= 1033 for _, _, _, b in long)


def test_sizes():
    code = "\n".join(f"line {i}" for i in range(400))
    got = parts(f"# T\n\nintro\n\n```py\n{code}\n```\n\nend")
    assert sum(code in b for *_, b in got) == 1
    prose = "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(40))
    got = parts(prose)
    assert len(got) > 1 and all(chunking.estimated(b) <= 900 + 128 + 5 for *_, b in got)
    for i in range(40):
        assert any(f"Paragraph {i} " in b for *_, b in got)
    assert all(len(b) <= 3150 + 448 + 2 for *_, b in parts("y" * 10_000))


def test_store(spark, tmp_path):
    root = tmp_path / "notes"
    (root / "00-Inbox").mkdir(parents=True)
    (root / ".hidden").mkdir()
    for name, body in {"00-Inbox/a.md": "# A\n\nred apples", "_b.MD": "blue sky", "empty.md": "", ".x.md": "no", ".hidden/y.md": "no", "c.txt": "no"}.items():
        (root / name).write_text(body)
    assert [p for p, *_ in notes.walk(str(root))] == ["00-Inbox/a.md", "_b.MD", "empty.md"]
    store, model = index.Store(spark, f"file://{tmp_path}/store"), HashedBagEmbedder(16)
    assert index.index(store, str(root), model, 1) == {"new": 3}
    assert index.index(store, str(root), model, 2) == {"same": 3}
    (root / "_b.MD").write_text("green sky")
    os.utime(root / "_b.MD", (1, 1))
    os.utime(root / "empty.md", (5, 5))
    (root / "00-Inbox/a.md").unlink()
    assert index.index(store, str(root), model, 3) == {"changed": 1, "refreshed": 1, "removed": 1}
    assert [(r.path, r.body) for r in store.table("chunks").collect()] == [("_b.MD", "green sky")]
    assert index.index(store, str(root), model, 4, "since", 4.0) == {"same": 1, "changed": 1}
    with pytest.raises(ValueError):
        index.index(store, str(root), HashedBagEmbedder(8), 5)
    version = index.compact(store, 1)["version"]
    assert version == 5 and store.table("files").count() == 2
    bad = {r["check"]: r["count"] for r in index.examined(store).collect()}
    assert set(bad.values()) == {0} and "rows of the vector index without chunk" in bad
    store.vacuum()
    assert store.table("chunks").count() == 1
    lost = {r["check"]: r["count"] for r in index.doctor(store.table("files"), store.table("chunks"), 16, words=store.table("chunks").limit(0), vectors=spark.createDataFrame([("ghost",)], "id string")).collect()}
    assert (lost["chunks missing in the word index"], lost["rows of the vector index without chunk"], lost["chunks missing in the vector index"]) == (1, 1, 1)
    o = index.overview(store.table("files"), store.table("chunks")).first()
    assert (o.files, o.chunks, o.embedded) == (2, 1, 1)
    inbox = spark.createDataFrame([("00-Inbox/x.md", "# Tt", 5), ("00-Inbox/y/z.md", "", 5), ("00-Inbox/w.md", "", 1)], "path string, content string, created long")
    assert [tuple(r) for r in notes.inbox(inbox, 2).collect()] == [("00-Inbox/x.md", "Tt")]


def test_search_in_a_store_is_that_in_its_chunks(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    for i in range(12):
        (root / f"n{i}.md").write_text(f"# Note {i}\n\n{'solar panels ' if i % 2 else 'wind turbines '}{'roofs ' * (i % 3)}number {i}")
    store, model = index.Store(spark, f"file://{tmp_path}/store"), HashedBagEmbedder(32)
    index.index(store, str(root), model, 1)
    q = spark.createDataFrame([("q", "solar roof"), ("r", "turbine"), ("none", "zzz")], "query_id string, query string")
    q = search.embedded_queries(q, model)
    rows = lambda c, **o: sorted(tuple(r) for r in search.search(c, q, search.Options(exhaustive=True, **o)).select("query_id", "pos", "chunk_id", "bm25_rank", "cosine_rank").collect())
    for step in range(3):
        if step == 1:
            (root / "n3.md").write_text("# Note 3\n\nturbines only")
            os.utime(root / "n3.md", (7, 7))
            (root / "n5.md").unlink()
            (root / "new.md").write_text("solar roofing")
            assert index.index(store, str(root), model, 2) == {"same": 10, "changed": 1, "removed": 1, "new": 1}
        if step == 2:
            index.compact(store, 1)
        corpus = search.Corpus.kept(store)
        fresh = search.Corpus.of(store.table("chunks"), 32, stem=True)
        assert rows(corpus) == rows(fresh) and {r[0] for r in rows(corpus, mode="bm25")} == {"q", "r"}
    # the approximate search is taken where there is much and nobody asks for the exact one
    corpus.stored = 10**6
    assert rows(corpus) == rows(fresh)
    seen = []
    corpus.cells = lambda d, k: seen.append(k) or store.vectors(32).search(d, k)
    rows(corpus, exact=True)
    assert not seen
    rows(corpus)
    assert seen == [120]
    assert index.index(store, str(root), model, 3, "full") == {"changed": 12} and set(r["count"] for r in index.examined(store).collect()) == {0}
    # a pass that dies before its manifest changes nothing, and its repeat is whole
    (root / "n7.md").write_text("# Note 7\n\nbatteries")
    os.utime(root / "n7.md", (9, 9))
    publish, store.publish = store.publish, lambda c: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError, match="lost"):
        index.index(store, str(root), model, 4)
    store.publish = publish
    assert store.table("chunks").where("body like '%batteries%'").count() == 0
    assert index.index(store, str(root), model, 4) == {"same": 11, "changed": 1}
    assert store.table("chunks").where("path = 'n7.md'").count() == 1 and set(r["count"] for r in index.examined(store).collect()) == {0}


def test_evaluation_smart_search_and_provenance(spark, tmp_path):
    from noteloom.operators.provenance import IDENTITY
    from noteloom.plans import evaluate, gate
    from noteloom.sources import labels

    root = tmp_path / "notes"
    root.mkdir()
    words = ["solar panels", "wind turbines", "tide mills", "heat pumps", "roof tiles"]
    for i, w in enumerate(words):
        (root / f"n{i}.md").write_text(f"# {w}\n\n{w} and more about {w}")
    store, model = index.Store(spark, f"file://{tmp_path}/store"), HashedBagEmbedder(32)
    index.index(store, str(root), model, 1)
    corpus = search.Corpus.kept(store)
    content = "\n".join(json.dumps({"query": w, "cohort": f"c{i % 2}", "relevant": [{"path": f"n{i}.md", "grade": 2}]}) for i, w in enumerate(words))
    got = evaluate.report(corpus, store.table("files"), content, search.Options(limit=10, exact=True), model)
    assert labels.report(json.dumps(got)) == got and got["aggregate"]["mean_ndcg_at_k"] == 1.0 and got["queries"][2]["ranked"][0] == "n2.md"
    again = json.loads(json.dumps(got))
    again["config"]["fusion_policy"] = "other"
    assert not gate.compare(got, again)["accepted"] and gate.compare(got, again)["checks"]["candidate_is_distinct_fusion_policy"]
    with pytest.raises(ValueError, match="unknown or missing"):
        labels.report(json.dumps({**got, "config": {**got["config"], "odd": 1}}))
    for bad in (search.Options(mode="bm25", exact=True), search.Options(since=1), search.Options(limit=2000)):
        with pytest.raises(ValueError):
            evaluate.report(corpus, store.table("files"), content, bad, model)
    with pytest.raises(ValueError, match="aren't indexed"):
        evaluate.report(corpus, store.table("files"), '{"query":"x","relevant":["gone.md"]}', search.Options(), model)

    q = search.embedded_queries(spark.createDataFrame([("q", "wind turbines")], "query_id string, query string"), model)
    none = spark.createDataFrame([("q", 2, "lex", "turbines", None)], "query_id string, list_no int, kind string, text string, embedding array<float>")
    hits, trouble = search.smart_or_plain(corpus, q, lambda: none, search.Options(), SharedWordsReranker())
    assert trouble is None and hits.first().path == "n1.md"

    class Flaky(SharedWordsReranker):
        def score(self, queries, documents):
            if not os.path.exists(flag):
                open(flag, "w").close()
                raise RuntimeError("no weights")
            return super().score(queries, documents)

    flag = str(tmp_path / "tried")
    hits, trouble = search.smart_or_plain(corpus, q, lambda: none, search.Options(), Flaky())
    assert "no weights" in trouble or "PythonException" in trouble
    assert hits.orderBy("pos").first().path == "n1.md" and hits.orderBy("pos").first().cosine is not None

    out, told = search.run(store, q.drop("embedding"), search.Options(limit=3), model, refresh=lambda: index.index(store, str(root), model, 2))
    assert told["refreshed"] is True and [h["path"] for h in json.loads(out.first().hits)][0] == "n1.md"
    out, told = search.run(store, q.drop("embedding"), search.Options(limit=3, smart=True), model, SharedWordsReranker(), lambda d: none, lambda: 1 / 0, "text")
    assert told["refreshed"].startswith("ZeroDivisionError") and told["smart"] is None
    assert out.first().text.split("\n")[:2] == ["n1.md (100%)", "  wind turbines: wind turbines and more about wind turbines"]

    known = {"schema_version": 1, "binary_version": "1", "binary_sha256": "a" * 64, "corpus_sha256": "b" * 64, "indexed_files": 5, "indexed_chunks": 5, "embedded_chunks": 5, "embed_model": "m", "embed_dims": 32, "chunk_version": "1", "tantivy_version": "1", "fusion_policy": "rrf_k60", "fusion_candidate_pool": "u", "vector_backend": "exact", "automatic_exact_cutoff": 10, "rerank_model": "r", "rerank_policy": "p", "relevance_policy": "q", "index_refresh_requested": False, "index_refresh_succeeded": False, "result_policy": "n"}
    o = search.Options(full=True, rerank=True, exact=True, limit=5)
    hits, run = search.with_provenance(corpus, q, o, SharedWordsReranker(), known)
    assert hits.count() == run["returned"] and set(IDENTITY) <= set(run) and len(hits.first().event_id) == 64
    moved = iter(range(9))
    corpus.state = lambda: next(moved)
    with pytest.raises(ValueError, match="changed"):
        search.with_provenance(corpus, q, o, SharedWordsReranker(), known)


def test_capture_and_filing(tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 5, 1, 10, 30, 5)
    root = str(tmp_path)
    p = notes.captured(root, "Über: Plan 9!", at, body="  text ", source="web", fields='{"b": [1, "x"], "a_1": {"k": null}}')
    assert p == "00-Inbox/20240501-103005-ber-plan-9.md"
    assert (tmp_path / p).read_text() == '---\ncreated: 2024-05-01T10:30\nstatus: inbox\nsource: web\na_1: {"k": null}\nb: [1, "x"]\n---\n\n# Über: Plan 9!\n\ntext\n'
    for bad in ('{"status": 1}', "[1]", '{"a b": 1}', json.dumps({"a": "x" * 70_000})):
        with pytest.raises(ValueError):
            notes.captured(root, "t", at, fields=bad)
    with pytest.raises(FileExistsError):
        notes.captured(root, "Über: Plan 9!", at)
    old, new = notes.filed(root, p, "10-Projects/garden", dt.datetime(2024, 6, 2, 8, 5))
    assert (old, new) == (p, "10-Projects/garden/20240501-103005-ber-plan-9.md") and not (tmp_path / p).exists()
    text = (tmp_path / new).read_text()
    assert text.startswith("---\ncreated: 2024-05-01T10:30\nstatus: active\nsource: web\n") and "\npara: project\nmodified: 2024-06-02T08:05\n---\n\n# Über" in text
    assert notes.enriched("plain\n", {"status": "active"}) == "---\nstatus: active\n---\n\nplain\n"
    os.symlink(tmp_path / "10-Projects", tmp_path / "alias")
    assert notes.relative(root, str(tmp_path / "10-Projects/x.md")) == "10-Projects/x.md" and notes.relative(str(tmp_path / "alias"), str(tmp_path / "10-Projects/x.md")) == "x.md"


def test_fingerprints(spark):
    f = spark.createDataFrame([("b", "2"), ("a", "1"), ("a", "1"), (None, "3")], "path string, sha256 string")
    want = hashlib.sha256(b"a\x001\nb\x002\n").hexdigest()
    assert provenance.corpus_fingerprint(f).first()[0] == want
    assert provenance.fingerprint_tree(f).first()[0] == provenance.fingerprint_tree(f.repartition(3)).first()[0]


def test_search_end_to_end(spark):
    texts = ["solar panels on the roof", "wind turbines", "solar storm", "a recipe for soup", "roof repair"]
    m = HashedBagEmbedder(64)
    rows = [(f"{i:064x}", f"n{i % 4}.md", i, 0, "", t, m.embed([t])[0].tolist(), 100 + i, "web") for i, t in enumerate(texts)]
    c = spark.createDataFrame(rows, "id string, path string, ord int, kind int, heading_path string, body string, embedding array<float>, created_at long, source string")
    corpus = search.Corpus.of(c, 64)
    q = spark.createDataFrame([("q", "solar roof", m.embed(["solar roof"])[0].tolist())], "query_id string, query string, embedding array<float>")
    run = lambda r=None, **o: search.search(corpus, q, search.Options(**o), r).orderBy("pos").collect()
    got = run()
    assert got[0].path == "n0.md" and len({r.path for r in got}) == len(got) and got[0].relevance is None and got[0].body is None
    assert {r.path for r in run(mode="bm25")} == {"n0.md", "n2.md"} and run(mode="vec", relevance=True)[0].relevance > 0
    assert run(r=SharedWordsReranker(), rerank=True, rerank_context=1, full=True)[0].rerank_rank == 1
    assert [r.created for r in run(since=102, chunks=True)] and all(r.created >= 102 for r in run(since=102, chunks=True))
    v = spark.createDataFrame([("q", 2, "lex", "panels", None), ("q", 3, "hyde", "storm", m.embed(["storm"])[0].tolist())], "query_id string, list_no int, kind string, text string, embedding array<float>")
    smart = search.smart_search(corpus, q, v, search.Options(), SharedWordsReranker()).collect()
    assert smart and all(r.cosine is None for r in smart)
    folders = search.suggested_folders(corpus, "n0.md", q)
    assert folders.count() == 0
    for bad in ({"mode": "x"}, {"limit": 0}, {"rerank_context": 1}, {"rerank_context": 3, "rerank": True}, {"mode": "bm25", "relevance": True}, {"smart": True, "min_relevance": 0.5}, {"min_relevance": 2.0}, {"tick_provenance": True}):
        with pytest.raises(ValueError):
            search.Options(**bad).check()
    assert (search.Options().pool, search.Options().depth, search.Options(limit=12, chunks=True).pool, search.Options(limit=12, chunks=True).depth) == (40, 120, 12, 36)


def test_context_never_skips_a_neighbour():
    size = len
    assert fit_context("c", ["a1", "a2"], ["b1"], 100, size) == "a1\n\na2\n\nc\n\nb1"
    assert fit_context("c", ["tiny", "x" * 50], ["b"], 10, size) == "c\n\nb"
    assert fit_context("c" * 50, ["a"], [], 10, size) == "c" * 50
    assert fit_context("c", ["a"], ["b"], 6, size) == "a\n\nc" and fit_context("c", [], ["b", "d"], 7, size) == "c\n\nb\n\nd"


def test_export(spark, tmp_path):
    rows = [("i1", "b.md", 0, "", [1.0, 2.0]), ("i2", "a.md", 1, "", [3.0, 4.0]), ("i3", "a.md", 0, "", None)]
    c = spark.createDataFrame([(*r[:4], r[4], 5, None) for r in rows], "id string, path string, ord int, heading_path string, embedding array<float>, created_at long, source string")
    out = str(tmp_path / "out")
    m = export.export(c, out, 2)
    assert np.load(f"{out}/vectors.npy").tolist() == [[3, 4], [1, 2]] and m["rows"] == 2
    assert [json.loads(x)["path"] for x in open(f"{out}/meta.jsonl")] == ["a.md", "b.md"]
    assert len(export.npy_header(10**6, 768)) % 64 == 0
    with pytest.raises(ValueError):
        export.export(c, out, 2)
    with pytest.raises(Exception, match="wrong width"):
        export.export(c, out, 3, force=True)
    assert np.load(f"{out}/vectors.npy").shape == (2, 2)
    with pytest.raises(ValueError):
        export.export(c, str(tmp_path / "out" / "in"), 2, notes_root=out)


def test_event_lines(spark, tmp_path):
    lines = ['{"type":"note","path":"a.md"}', '{"type":"log","level":"info","message":"m"}', '{"type":"odd"}', "plain", '{"type":"result","ok":true}']
    (tmp_path / "e.txt").write_text("\n".join(lines))
    got = events.read(spark, str(tmp_path / "e.txt")).collect()
    assert [(r.type, r.action, r.raw) for r in got] == [("note", "create", None), ("log", None, None), (None, None, '{"type":"odd"}'), (None, None, "plain"), ("result", None, None)]
    assert json.loads(events.to_line(events.read(spark, str(tmp_path / "e.txt"))).collect()[1].value) == {"type": "log", "level": "info", "message": "m"}


def test_scope_files(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    name = ".noteloom.json"
    (deep / name).write_text('{"exclude":[" Two ","one"]}')
    (tmp_path / "a" / name).write_text('{"exclude":["three"],"root":true}')
    (tmp_path / name).write_text('{"exclude":["never"]}')
    assert notes.scope_words(str(deep)) == ["two", "one", "three"]
    (deep / name).write_text("{broken")
    assert notes.scope_words(str(deep)) == ["three"]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a.md", "# A\n\nx\n\n## B\n\ny", 1.0), ("b.md", "", 1.0)]
    spark.createDataFrame(rows, ingest.NOTES).write.parquet(src)
    for _ in range(2):  # the second time there is nothing new
        ingest.into_table(ingest.chunk_stream(ingest.note_stream(spark, src)), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    seen = []
    ingest.each_batch(ingest.note_stream(spark, src), lambda d, n: seen.append(d.count()), str(tmp_path / "cp2")).awaitTermination()
    assert seen == [2]
