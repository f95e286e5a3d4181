"""Queries of the search engine's own operators over the supplied tables, and their SQL.

Roles: chunks is the chunk store; scored holds the candidates of search runs (a run is a query); tick_runs has query
texts; the vector of a query is the row of embeddings with the query's number; tick_events and tick_runs are the log
of use; files and vault_walk are two states of the note folder; documents are whole notes. A judgment's grade is the
length of the judged path modulo 4: an arbitrary rule that both sides can compute.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import frontmatter, numbers, text
from .models import HashedBagEmbedder, SharedWordsReranker, context_column
from .operators import changes, chunking, fusing, lexical, provenance, rewriting, stages, usage, vectors
from .plans import evaluate, gate, index, search, stores
from .session import place, table, written
from .sources import events, export, labels, notes

WIDTH, LIMIT, POOL = 64, 10, 40
#: Cells of approximate search, and how many of them a query reads.
CELLS, PROBES = 64, 12
CUTOFF, WORDS = 1_650_000_000, ["archive", "kiln"]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("id is not null").dropDuplicates(["id"])


def _queries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "tick_runs").where("query_text is not null").select(F.col("id").alias("query_id"), F.col("query_text").alias("query")).distinct()
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return q.join(e, "query_id", "left")


def _corpus(spark: SparkSession, d: str) -> search.Corpus:
    return search.Corpus.of(table(spark, d, "chunks"), WIDTH)


def _hits(spark: SparkSession, d: str, pool: int = POOL) -> DataFrame:
    """The best candidates of every run by rrf, with their chunks' columns; the rank filter runs before the shuffle too."""
    s = table(spark, d, "scored").where("run_id is not null and id is not null and rrf is not null and not isnan(rrf) and abs(rrf) < float('inf')").select("run_id", "id", "score", "rrf", "cosine", "bm25", "bm25_rank", "cosine_rank").distinct()
    once = Window.partitionBy("run_id", "id").orderBy(F.desc("rrf"), F.desc_nulls_last("bm25"), F.desc_nulls_last("cosine"), F.desc_nulls_last("bm25_rank"), F.desc_nulls_last("cosine_rank"))
    s = s.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    w = Window.partitionBy("run_id").orderBy(F.desc("rrf"), "id")
    top = s.withColumn("fusion_rank", F.row_number().over(w)).where(F.col("fusion_rank") <= pool)
    c = _chunks(spark, d).select("id", "path", "kind", "ord", F.col("heading_path").alias("heading"), F.col("created_at").alias("created"), "source")
    h = top.join(c, "id").withColumnRenamed("run_id", "query_id").withColumn("pos", F.col("fusion_rank")).withColumn("score", F.col("rrf"))
    return stages.renumbered(h).withColumn("relevance", numbers.relevance(F.col("cosine")))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    got = lexical.search(lexical.build(table(spark, d, "chunks", True)), lexical.plain_terms(_queries(spark, d), "query_id", "query"), LIMIT)
    return got.select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.exact(_chunks(spark, d), _queries(spark, d), LIMIT, WIDTH).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    got = search.retrieved(_corpus(spark, d), _queries(spark, d), search.Options())
    return got.select("query_id", "id", "bm25_rank", "cosine_rank", F.round(F.col("rrf").cast("double"), 8).alias("rrf"), "fusion_rank")


def search_notes(spark: SparkSession, d: str) -> DataFrame:
    """The whole plain search, one hit per note, without the adaptive cut."""
    got = search.search(_corpus(spark, d), _queries(spark, d), search.Options(exhaustive=True))
    return got.select("query_id", "pos", "chunk_id", "path", F.round(F.col("rrf").cast("double"), 8).alias("rrf"), "snippet", "siblings")


def search_tidy(spark: SparkSession, d: str) -> DataFrame:
    """The plain search as it is by default, with the adaptive cut."""
    got = search.search(_corpus(spark, d), _queries(spark, d), search.Options())
    return got.select("query_id", "pos", "chunk_id", "path", "siblings", "relevance", "body", "rerank")


_STORES: dict = {}


def _kept(spark: SparkSession, d: str) -> tuple[DataFrame, stores.WordStore]:
    """The chunk table and its stored word index, made once per session and folder: later searches only read it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        # repeated ids are one in the index; vectors and bodies don't move for it
        c = table(spark, d, "chunks").where("id is not null")
        words = stores.WordStore(spark, place(spark, "words"), stem=False)
        words.replace(c)
        _STORES[key] = (c, words)
    return _STORES[key]


def search_stored(spark: SparkSession, d: str) -> DataFrame:
    """search_notes with the word index stored before the search."""
    c, words = _kept(spark, d)
    got = search.search(search.Corpus(c, words.index(), WIDTH), _queries(spark, d), search.Options(exhaustive=True))
    return got.select("query_id", "pos", "chunk_id", "path", F.round(F.col("rrf").cast("double"), 8).alias("rrf"), "snippet", "siblings")


def word_store(spark: SparkSession, d: str) -> DataFrame:
    """The live rows of a stored word index after one folder was deleted and another one's bodies were replaced by their headings."""
    c = _chunks(spark, d)
    words = stores.WordStore(spark, place(spark, "words"), stem=False)
    words.replace(c)
    words.delete(c.where("startswith(path, '30-Resources/')").select("id"))
    words.replace(c.where("startswith(path, '40-Archive/')").withColumn("body", F.col("heading_path")))
    words.compact()
    p = words.index()
    tf = p.postings.groupBy("id").agg(F.sum("tf").alias("postings"))
    return p.lengths.groupBy("id").agg(F.sum("len").cast("long").alias("words")).join(tf, "id", "left").select("id", "words", F.coalesce("postings", F.lit(0)).cast("long").alias("postings"))


#: Queries in the query syntax: a required word, a phrase, an excluded word, a word of one field.
SYNTAX = {"must": "+firewall rule", "phrase": '"thesis chapter"', "not": "kiln -archive", "field": "heading:risks ledger", "and": "roof AND tile"}


def query_syntax(spark: SparkSession, d: str) -> DataFrame:
    got = lexical.search(lexical.build(_chunks(spark, d)), lexical.query_terms(spark, SYNTAX), LIMIT)
    return got.select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def smart_search(spark: SparkSession, d: str) -> DataFrame:
    """Every stored query with two variants made by a rule, reranked against the original by the words they share."""
    q = _queries(spark, d)
    e = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("other"))
    none = F.lit(None).cast("array<float>")
    v = q.join(e, "query_id", "left")
    two = v.select("query_id", F.lit(2).alias("list_no"), F.lit("lex").alias("kind"), F.concat("query", F.lit(" archive")).alias("text"), none.alias("embedding"))
    three = v.select("query_id", F.lit(3).alias("list_no"), F.lit("hyde").alias("kind"), F.lit("a passage").alias("text"), F.col("other").alias("embedding"))
    got = search.smart_search(_corpus(spark, d), q, two.unionByName(three), search.Options(), SharedWordsReranker())
    return got.select(F.col("query_id").cast("long").alias("query_id"), "pos", "chunk_id", "path", "rerank_rank", F.round(F.col("rrf").cast("double"), 8).alias("rrf"))


def suggested_folders(spark: SparkSession, d: str) -> DataFrame:
    """Where a note that says what the first stored query says may belong."""
    q = _queries(spark, d).where("embedding is not null").orderBy("query_id").limit(1)
    return search.suggested_folders(search.Corpus.of(_chunks(spark, d), WIDTH), "30-Resources/none.md", q, notes.folders(table(spark, d, "files"))).select("folder", F.round(F.col("score").cast("double"), 8).alias("score"), "pos")


def since_filter(spark: SparkSession, d: str) -> DataFrame:
    return stages.since(_hits(spark, d), CUTOFF).select("query_id", "pos", "id")


def source_filter(spark: SparkSession, d: str) -> DataFrame:
    return stages.from_source(_hits(spark, d), "Slack").select("query_id", "pos", "id")


def scope_exclude(spark: SparkSession, d: str) -> DataFrame:
    return stages.scoped(stages.truncated(_hits(spark, d), LIMIT), WORDS).select("query_id", "pos", "id", "path")


def scope_elided(spark: SparkSession, d: str) -> DataFrame:
    return stages.elided(stages.truncated(_hits(spark, d), LIMIT), WORDS)


def note_dedup(spark: SparkSession, d: str) -> DataFrame:
    return stages.one_per_note(_hits(spark, d)).select("query_id", "pos", "id", "path", "bm25_rank", "cosine_rank", "fusion_rank", "siblings")


def score_floor(spark: SparkSession, d: str) -> DataFrame:
    return stages.score_floor(_hits(spark, d), 60.0).select("query_id", "pos", "id")


def relevance_floor(spark: SparkSession, d: str) -> DataFrame:
    return stages.relevance_floor(_hits(spark, d), 0.5).select("query_id", "pos", "id", F.round("relevance", 6).alias("relevance"))


def tidy_prefix(spark: SparkSession, d: str) -> DataFrame:
    return stages.tidy_lengths(stages.truncated(_hits(spark, d), LIMIT))


def rerank_prefix(spark: SparkSession, d: str) -> DataFrame:
    """With the cosine as the logit of the first candidates."""
    logit = F.when(~F.isnan("cosine") & (F.abs("cosine") < float("inf")), F.col("cosine").cast("double"))
    got = stages.reranked(_hits(spark, d).withColumn("logit", logit), stages.rerank_cap(LIMIT, POOL, False))
    return got.select("query_id", "pos", "id", "rerank_rank", F.round("score", 6).alias("score"))


def display_groups(spark: SparkSession, d: str) -> DataFrame:
    return stages.per_note_display(_hits(spark, d)).select("query_id", "pos", "id", "note_pos", "n_in_note", "more")


def neighbor_window(spark: SparkSession, d: str) -> DataFrame:
    got = stages.neighbours(stages.truncated(_hits(spark, d), 3), table(spark, d, "chunks").where("id is not null"), 2)
    return got.select("query_id", "pos", "ord", "id", "centre")


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """What a reranker reads of the first hits: the chunk with its neighbours as far as they fit."""
    h = stages.truncated(_hits(spark, d), 3)
    w = stages.neighbours(h, table(spark, d, "chunks").where("id is not null"), 1).groupBy("query_id", "pos").agg(F.collect_list(F.struct("ord", F.coalesce("body", F.lit("")).alias("body"), "centre")).alias("w"))
    doc = w.select("query_id", "pos", context_column(1)(F.col("w")).alias("doc"))
    return doc.select("query_id", "pos", F.md5("doc").alias("doc"), F.length("doc").cast("long").alias("chars"))


def variant_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Three lists of every run: the ranks by words, by vectors, and both of them again by the sum."""
    h = _hits(spark, d)
    lists = [h.where("bm25_rank >= 1").select("query_id", F.lit(0).alias("list_no"), "id", F.col("bm25_rank").alias("rank")), h.where("cosine_rank >= 1").select("query_id", F.lit(1).alias("list_no"), "id", F.col("cosine_rank").alias("rank")), h.select("query_id", F.lit(2).alias("list_no"), "id", F.col("pos").alias("rank"))]
    got = fusing.fused(lists[0].unionByName(lists[1]).unionByName(lists[2]), POOL)
    return got.select("query_id", "id", F.round(F.col("rrf").cast("double"), 8).alias("rrf"), "fusion_rank")


def _ranking(spark: SparkSession, d: str, score: str = "rrf") -> DataFrame:
    h = stages.one_per_note(_hits(spark, d))
    if score != "rrf":
        h = h.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.col(score)), "path")))
    return h.select("query_id", "path", F.col("pos").alias("rank"), F.col("relevance").alias("score"))


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", "path").distinct().withColumn("grade", (F.length("path") % 4).cast("int"))


def _eval(spark: SparkSession, d: str, score: str = "rrf") -> DataFrame:
    q = _hits(spark, d).select("query_id", F.concat(F.lit("c"), (F.col("query_id") % 4).cast("string")).alias("cohort")).distinct()
    return evaluate.per_query(q, _ranking(spark, d, score), _qrels(spark, d), 10)


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _eval(spark, d).select("query_id", "cohort", "is_negative", r("precision_at_k"), r("recall_at_k"), r("reciprocal_rank_at_k"), r("ndcg_at_k"), "returned", F.size("found").alias("n_found"), F.size("missing").alias("n_missing"))


def eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    a = evaluate.aggregate(_eval(spark, d))
    return a.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes])


def cohort_delta(spark: SparkSession, d: str) -> DataFrame:
    """The order by fused score against the order by relevance."""
    return evaluate.by_cohort(_eval(spark, d), _eval(spark, d, "relevance")).select("cohort", "queries", F.round("ndcg_delta", 6).alias("ndcg_delta"))


def bootstrap_gate(spark: SparkSession, d: str) -> DataFrame:
    """The checks on two rankings of the same runs: the one by fused scores and the one by relevance. A report has a row per run."""
    config = {"k": 10, "mode": "hybrid", "rerank": False, "exact_requested": True, "vector_backend": "exact", "fusion_candidate_pool": "bm25_cosine_union", "adaptive_cutoff": False}
    names = ("cohort", "is_negative", "precision_at_k", "recall_at_k", "reciprocal_rank_at_k", "ndcg_at_k")

    def report(score: str, policy: str) -> dict:
        rows = _eval(spark, d, score).orderBy("query_id").collect()
        return {"schema_version": 1, "config": {**config, "fusion_policy": policy}, "provenance": {"labels_sha256": "0123456789abcdef" * 4, "index": d}, "queries": [{"query": str(r.query_id), **{n: r[n] for n in names}} for r in rows]}

    got = gate.compare(report("rrf", "rrf_k60"), report("relevance", "relevance"))
    return spark.createDataFrame(list(got["checks"].items()), "check string, passed boolean")


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).where(numbers.usable(F.col("embedding"), WIDTH))
    return export.numbered_rows(c, WIDTH).select("i", "id", "path", "ord")


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """What a note's chunks hold: their number by kind, their tokens by estimate, and how many have no heading."""
    c = _chunks(spark, d).where("path is not null")
    return c.groupBy("path").agg(F.count_if(F.col("kind") == 0).alias("content"), F.count_if(F.col("kind") == 1).alias("fields"), F.sum(text.estimated_tokens(F.col("body"))).cast("long").alias("tokens"), F.count_if(F.col("heading_path") == "").alias("bare"), F.max(F.length("body")).cast("long").alias("longest"))


def stemmed_search(spark: SparkSession, d: str) -> DataFrame:
    """Which chunks a stemmed index finds for a word in another form than theirs."""
    c = _chunks(spark, d)
    ids = lexical.search(lexical.build(c, stem=True), lexical.query_terms(spark, {"note": "notes", "measure": "measuring", "check": "checks"}, stem=True), 1_000_000_000)
    return ids.select("query_id", "id")


def _as_files(notes_: DataFrame, root: str) -> None:
    """Writes notes (path, content) as files under a folder that all tasks see."""

    def write(batches):
        import pyarrow as pa

        for b in batches:
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                full = os.path.join(root, p)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(t.encode())
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["path"])

    notes_.select("path", "content").mapInArrow(write, "path string").count()


def store_pass(spark: SparkSession, d: str) -> DataFrame:
    """The documents as note files, indexed; then one folder changed and another one deleted, and indexed again."""
    root, base = place(spark, "notes").removeprefix("file://"), place(spark, "store")
    n = table(spark, d, "documents").where("note_path like '%.md' and text is not null").groupBy(F.col("note_path").alias("path")).agg(F.max_by("text", "doc_id").alias("content"))
    n = written(n, "notes-to-write")
    _as_files(n, root)
    store, model = index.Store(spark, base), HashedBagEmbedder(16)
    index.index(store, root, model, 1)
    _as_files(n.where("startswith(path, '40-Archive/')").withColumn("content", F.concat("content", F.lit("\n\nOne line more."))), root)
    shutil.rmtree(os.path.join(root, "30-Resources"), ignore_errors=True)
    index.index(store, root, model, 2)
    c = store.table("chunks").groupBy("path").agg(F.bool_and(F.size("embedding") == 16).alias("embedded"))
    found = index.examined(store).agg(F.sum("count").alias("problems"))
    return store.table("files").join(c, "path", "left").crossJoin(F.broadcast(found)).select("path", "sha256", F.coalesce("embedded", F.lit(False)).alias("embedded"), "problems")


def tick_record(spark: SparkSession, d: str) -> DataFrame:
    """The notes of the first two runs, each recorded as a batch of plain uses, and the counters that both give."""
    e = table(spark, d, "tick_events").where("path is not null").select("run_id", "path").distinct()
    runs = [r.run_id for r in e.select("run_id").distinct().orderBy("run_id").limit(2).collect()]
    at = place(spark, "ticks")
    for k, run in enumerate(runs):
        # a run has at most a hundred notes
        usage.record(None, [r.path for r in e.where(F.col("run_id") == run).orderBy("path").collect()], 1_700_000_000 + k, at, spark)
    return usage.counters(usage.recorded(spark, at, "ticks"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    told = ("10h", "5d", "3m", "1y", "90s", "30min", "2w", "7")
    return spark.createDataFrame([(t, numbers.duration(t), numbers.cutoff(1_700_000_000, t)) for t in told], "told string, seconds long, cutoff long")


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Judgments as people write them, one JSON object per line."""
    lines = ['{"query": " roof tile ", "cohort": "a", "relevant": ["x/a.md", {"path": "b.md", "grade": 3}]}', "", '{"query": "none", "relevant": []}', '{"query": "zero", "relevant": [{"path": "c.md", "grade": 0}]}']
    q, r, _ = labels.tables(spark, "\n".join(lines))
    return q.join(r, "query_id", "left").select("query", "cohort", "graded", "path", "grade")


def unknown_paths(spark: SparkSession, d: str) -> DataFrame:
    """Judgments of the runs' notes and of the exported notes, some of which aren't indexed or have no chunk."""
    more = table(spark, d, "documents").where("note_path is not null").select(F.lit(0).cast("long").alias("query_id"), F.col("note_path").alias("path"), F.lit(1).alias("grade"))
    return evaluate.unknown_paths(_qrels(spark, d).unionByName(more), table(spark, d, "files"), table(spark, d, "chunks"))


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return usage.from_events(table(spark, d, "tick_events"), table(spark, d, "tick_runs"))


def tick_counters(spark: SparkSession, d: str) -> DataFrame:
    return _ticks(spark, d)


def fame(spark: SparkSession, d: str) -> DataFrame:
    return usage.fame(_ticks(spark, d), table(spark, d, "files"), 20, True)


def rank_report(spark: SparkSession, d: str) -> DataFrame:
    r = usage.rank_report(_ticks(spark, d), table(spark, d, "files"), table(spark, d, "tick_events"), table(spark, d, "tick_runs"), 20, True)
    return r.select("path", "ticks", "missing", "pipeline_id", "corpus_sha256", "events", "median_fusion_rank", "median_bm25_rank", "median_cosine_rank", "median_rerank_rank", "median_final_rank", "rerank_scored", "unscored_tail", "last_event")


def usage_merge(spark: SparkSession, d: str) -> DataFrame:
    """Counters after every note of the archive was moved to one folder by its file name."""
    t = _ticks(spark, d)
    moves = t.where("startswith(path, '40-Archive/')").select(F.col("path").alias("old_path"), F.concat(F.lit("40-Archive/"), text.file_name(F.col("path"))).alias("new_path"))
    return usage.rekeyed(t, moves)


def orphans(spark: SparkSession, d: str) -> DataFrame:
    return usage.orphans(_ticks(spark, d), table(spark, d, "tick_events"), table(spark, d, "files"))


def event_problems(spark: SparkSession, d: str) -> DataFrame:
    """Two runs at a time logged under one number, so that paths and ranks come twice."""
    e = table(spark, d, "tick_events").withColumn("run_id", F.expr("run_id div 2"))
    return provenance.event_problems(e).select("run_id", "path", "final_rank", F.array_join("problems", ", ").alias("problems"))


def _base(spark: SparkSession, d: str) -> DataFrame:
    return changes.base_state(table(spark, d, "files"), table(spark, d, "index_runs"))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """The files table against the listing of run 12: what must be read, what is new, removed, or the same."""
    m = F.coalesce((F.col("mtime")), F.lit(0.0))
    old = table(spark, d, "files").where("path is not null").groupBy("path").agg(F.max(F.struct(F.col("indexed_at"), m.alias("mtime"), F.col("sha256"))).alias("b")).select("path", "b.mtime", "b.sha256")
    new = table(spark, d, "vault_walk").where("run_id = 12 and path is not null").groupBy("path").agg(F.max(F.struct(F.col("seen_at"), m.alias("mtime"))).alias("b")).select("path", "b.mtime")
    return index.status(old, new).select("path", "status")


def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return provenance.corpus_fingerprint(_base(spark, d))


def fingerprint_tree(spark: SparkSession, d: str) -> DataFrame:
    return provenance.fingerprint_tree(_base(spark, d))


def doctor(spark: SparkSession, d: str) -> DataFrame:
    return index.doctor(_base(spark, d), table(spark, d, "chunks").distinct(), WIDTH, _ticks(spark, d), table(spark, d, "tick_events"))


def overview(spark: SparkSession, d: str) -> DataFrame:
    return index.overview(_base(spark, d), table(spark, d, "chunks"))


def settled_status(spark: SparkSession, d: str) -> DataFrame:
    """snapshot_diff once the hashes of the paths that had to be read are known."""
    old = table(spark, d, "files").where("path is not null").groupBy("path").agg(F.max(F.struct(F.col("indexed_at"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"), F.lower("sha256").alias("sha256"))).alias("b")).select("path", "b.mtime", "b.sha256")
    new = table(spark, d, "vault_walk").where("run_id = 12 and path is not null").groupBy("path").agg(F.max(F.struct(F.col("seen_at"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"), F.lower("sha256").alias("sha256"))).alias("b")).select("path", "b.mtime", "b.sha256")
    got = index.status(old, new.select("path", "mtime")).join(new.select("path", "sha256"), "path", "left")
    return index.settled(got).select("path", F.coalesce("status", F.lit("unknown")).alias("status"))


def usage_days(spark: SparkSession, d: str) -> DataFrame:
    return usage.with_days(_ticks(spark, d), "first_used", "last_used").select("path", "first_used_day", "last_used_day")


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of four kinds, made of the log by a rule, read as events."""
    p, k = F.col("path"), F.col("run_id") % 4
    line = F.when(k == 0, F.concat(F.lit('{"type":"note","path":"'), p, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"type":"log","level":"info","message":"'), p, F.lit('"}'))).when(k == 2, p).otherwise(F.concat(F.lit('{"type":"odd","path":"'), p, F.lit('"}')))
    e = table(spark, d, "tick_events").where("path is not null").select(line.alias("value"))
    return events.of_lines(e).select("type", "level", "message", "path", "action", "raw")


def inbox_notes(spark: SparkSession, d: str) -> DataFrame:
    return notes.inbox(table(spark, d, "documents").select(F.col("note_path").alias("path"), F.col("text").alias("content")))


def extension_sizes(spark: SparkSession, d: str) -> DataFrame:
    return notes.sizes(table(spark, d, "documents").select(F.col("note_path").alias("path"), F.col("n_chars").alias("length")))


def created_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Local minutes of one zone; what isn't one takes the time of change, here 0."""
    f = table(spark, d, "frontmatter").where("created is not null").distinct()
    return f.select("path", "created", frontmatter.created_seconds(F.col("created"), F.lit(0.0), "Europe/Berlin").alias("created_at"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.truncated(t, 80).alias("short"), text.human_size(F.col("n_chars") * 1000).alias("size"), F.md5(text.note_text(t)).alias("head"), text.producer_key(F.col("source")).alias("producer"), text.folder_of(text.kind_of(text.bucket(F.col("note_path")))).alias("folder"))


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    c = _chunks(spark, d)
    return c.select("id", text.bucket(p).alias("bucket"), text.kind_of(text.bucket(p)).alias("kind_name"), text.parent_folder(p).alias("folder"), text.short_title(p).alias("title"), text.leaf_heading(F.col("heading_path")).alias("leaf"), text.slug(F.col("heading_path")).alias("slug"), text.estimated_tokens(F.col("body")).cast("long").alias("tokens"), numbers.vector_key(F.col("id")).alias("vector_key"), text.owned_path(p).alias("owned"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Whether ids are the hash of path and number."""
    return _chunks(spark, d).select("id", (numbers.chunk_id(F.col("path"), F.col("ord")) == F.col("id")).alias("fits"))


def folder_list(spark: SparkSession, d: str) -> DataFrame:
    return notes.folders(table(spark, d, "files"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = _chunks(spark, d).where(numbers.usable(F.col("embedding"), WIDTH))
    return v.select("id", F.round(numbers.norm(F.col("embedding")), 4).alias("norm"), F.round(numbers.norm(numbers.normalised(F.col("embedding"))), 4).alias("unit_norm"))


def unembedded_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("embedding is null").select("path").distinct()


def frontmatter_fields(spark: SparkSession, d: str) -> DataFrame:
    got = frontmatter.with_frontmatter(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")))
    return got.select("doc_id", "created_raw", "source", F.size("fields").alias("n_fields"))


def note_titles(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents")
    return n.select("doc_id", text.note_title(F.col("note_path"), F.col("text")).alias("title"), F.length(text.without_frontmatter(F.col("text"))).cast("long").alias("body_chars"))


def chunk_notes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document, as a note of its own."""
    n = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return chunking.chunked(n)


def chunk_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a note's chunks: numbers from 0 on, ids that are their hashes, and no word of the note lost; list numbers and the names on code fences aren't kept."""
    n = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    c = chunking.chunked(n).where("kind = 0")
    told = F.array_distinct(F.flatten(F.collect_list(F.concat(text.tokens(F.col("body")), text.tokens(F.col("heading_path"))))))
    g = c.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last"), F.min("ord").alias("first"), F.bool_and(numbers.chunk_id(F.col("path"), F.col("ord")) == F.col("id")).alias("ids_fit"), told.alias("told"))
    plain = F.regexp_replace(text.without_frontmatter(F.col("content")), "(?m)^ *```.*$", "")
    words = F.filter(F.array_distinct(text.tokens(plain)), lambda w: w.rlike(r"^\p{L}+$"))
    return g.join(n, "path").select("path", ((F.col("first") == 0) & (F.col("last") == F.col("n") - 1)).alias("in_order"), "ids_fit", (F.size(F.array_except(words, "told")) == 0).alias("words_kept"))


def query_variants(spark: SparkSession, d: str) -> DataFrame:
    """An expander's lines, made from the query by a rule: one that shares words, one that drifts, one passage."""
    q = table(spark, d, "tick_runs").where("query_text is not null").select(F.col("id").alias("query_id"), F.col("query_text").alias("query")).distinct()
    raw = F.concat(F.lit("lex: about "), F.col("query"), F.lit("\nvec: zzz\nhyde: A passage.\n<|end|> lex: x\nnote"))
    return q.select("query_id", F.explode(rewriting.parsed(raw, F.col("query"))).alias("v")).select("query_id", "v.kind", "v.text")


def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search for every chunk whose id, read as a number, is divisible by 20, and whether it finds what the exact scan finds: recall of 0.98."""
    # many passes of queries read the vectors and their cells
    c = written(_chunks(spark, d).where(numbers.usable(F.col("embedding"), WIDTH)).select("id", "embedding"), "vectors")
    q = c.where(F.conv(F.substring("id", 1, 8), 16, 10).cast("long") % 20 == 0)
    centres, placed = vectors.cells(c, WIDTH, CELLS)
    near = vectors.approximate(centres, written(placed, "cells"), q, LIMIT, WIDTH, PROBES, query_id="id")
    true = vectors.exact(c, q, LIMIT, WIDTH, query_id="id")
    both = true.select("query_id", "id").join(near.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.98 * F.count(F.lit(1))).alias("recall_98"))


def hourly_use(spark: SparkSession, d: str) -> DataFrame:
    """Events per type in windows of an hour: the batch form of the streaming aggregate."""
    from .streaming.ingest import use_in_windows

    return use_in_windows(table(spark, d, "events").select(F.col("ts"), "event_type"), "ts", "event_type")


_ALL = (
    bm25_topk, cosine_topk, hybrid_rrf, search_notes, search_stored, search_tidy, word_store, query_syntax, smart_search, suggested_folders, settled_status, usage_days, event_lines, inbox_notes, extension_sizes,
    created_minutes, text_functions, chunk_rules, bootstrap_gate, export_rows, chunk_stats, stemmed_search, store_pass, tick_record, durations, label_lines, since_filter, source_filter, scope_exclude, scope_elided, note_dedup, score_floor, relevance_floor, tidy_prefix, rerank_prefix, display_groups, neighbor_window,
    context_windows, variant_fusion, eval_metrics, eval_aggregate, cohort_delta, unknown_paths, tick_counters, fame, rank_report, usage_merge, orphans, event_problems, snapshot_diff, corpus_fingerprint, fingerprint_tree, doctor, overview,
    path_functions, chunk_ids, folder_list, unit_vectors, unembedded_paths, frontmatter_fields, note_titles, chunk_notes, query_variants, ivf_topk, hourly_use,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_W = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_CH = "ch AS (SELECT id, any_value(path) AS path, any_value(ord) AS ord, any_value(kind) AS kind, any_value(heading_path) AS heading_path, any_value(body) AS body, any_value(embedding) AS embedding, any_value(created_at) AS created_at, any_value(source) AS source FROM chunks WHERE id IS NOT NULL GROUP BY id)"
_Q = "q AS (SELECT DISTINCT id AS query_id, query_text AS query FROM tick_runs WHERE query_text IS NOT NULL)"
_BM25 = f"""
tok AS (SELECT id, 'body' AS field, {_W.format("body")} AS t FROM ch UNION ALL SELECT id, 'heading_path', {_W.format("heading_path")} FROM ch),
len AS (SELECT id, field, coalesce(len(t), 0) AS len FROM tok), st AS (SELECT field, count(*) AS n, avg(len) AS avg_len FROM len GROUP BY field),
tf AS (SELECT id, field, term, count(*) AS tf FROM (SELECT id, field, unnest(t) AS term FROM tok) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, unnest({_W.format("query")}) AS term FROM q),
w AS (SELECT query_id, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS w FROM qt JOIN tf USING (term) JOIN df USING (field, term) JOIN st USING (field) JOIN len USING (id, field)),
lexs AS (SELECT query_id, id, sum(round(w * 1e9)::BIGINT) / 1e9 AS score FROM w GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lexs)
"""
_OK = "len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true) AND list_contains(list_transform(embedding, lambda x: x <> 0), true)"
_VEC = f"""
sv AS (SELECT id, embedding::DOUBLE[] AS e FROM ch WHERE {_OK}), qv AS (SELECT q.query_id, v.embedding::DOUBLE[] AS e FROM q JOIN embeddings v ON v.vec_id = q.query_id),
vs AS (SELECT query_id, id, round(list_cosine_similarity(qv.e, sv.e), 9) AS score FROM qv, sv),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, substr(id, 1, 16), id) AS rank FROM vs)
"""
_RRF = """
hy AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.id, v.id) AS id, l.rank AS bm25_rank, v.rank AS cosine_rank,
              coalesce((1.0::DOUBLE / (60 + l.rank))::FLOAT, 0::FLOAT) + coalesce((1.0::DOUBLE / (60 + v.rank))::FLOAT, 0::FLOAT) AS rrf
       FROM (SELECT * FROM lex WHERE rank <= 120) l FULL JOIN (SELECT * FROM vec WHERE rank <= 120) v ON l.query_id = v.query_id AND l.id = v.id),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS fusion_rank FROM hy QUALIFY fusion_rank <= 40)
"""
_HITS = f"""{_CH},
s1 AS (SELECT DISTINCT run_id, id, rrf, cosine, bm25, bm25_rank, cosine_rank FROM scored WHERE run_id IS NOT NULL AND id IS NOT NULL AND isfinite(rrf)),
s2 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY rrf DESC, bm25 DESC NULLS LAST, cosine DESC NULLS LAST, bm25_rank DESC NULLS LAST, cosine_rank DESC NULLS LAST) = 1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rrf DESC, id) AS fusion_rank FROM s2 QUALIFY fusion_rank <= 40),
h AS (SELECT run_id AS query_id, s3.id, row_number() OVER (PARTITION BY run_id ORDER BY fusion_rank) AS pos, rrf, rrf AS score, cosine, bm25, bm25_rank, cosine_rank, fusion_rank, path, kind, ord, created_at AS created, source,
             CASE WHEN isfinite(cosine) THEN greatest(0, least(1, cosine::DOUBLE)) END AS relevance FROM s3 JOIN ch ON ch.id = s3.id)
"""
_NOTE = """n0 AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY query_id, path) - 1 AS more, min(bm25_rank) OVER (PARTITION BY query_id, path) AS b, min(cosine_rank) OVER (PARTITION BY query_id, path) AS c, min(fusion_rank) OVER (PARTITION BY query_id, path) AS f FROM h WINDOW w AS (PARTITION BY query_id, path ORDER BY pos)),
n1 AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos, id, path, b AS bm25_rank, c AS cosine_rank, f AS fusion_rank, CASE WHEN more > 0 THEN more::INT END AS siblings, relevance FROM n0 WHERE k = 1)"""


def _eval_sql(name: str, order: str) -> str:
    return f"""
r{name} AS (SELECT query_id, path, {order} AS rank, relevance AS score FROM n1),
d{name} AS (SELECT r.query_id, count(*) AS hits, min(rank) AS best, sum(round((2 ** grade - 1) / log2(rank + 1), 12)) AS dcg FROM r{name} r JOIN rel USING (query_id, path) WHERE rank <= 10 GROUP BY 1),
l{name} AS (SELECT query_id, count(*) AS returned, arg_min(coalesce([score], [NULL]), rank)[1] AS top_score FROM r{name} GROUP BY 1),
e{name} AS (SELECT qq.query_id, 'c' || (qq.query_id % 4) AS cohort, n_rel IS NULL AS is_negative, CASE WHEN n_rel IS NOT NULL THEN coalesce(hits, 0) / 10.0 END AS precision_at_k, CASE WHEN n_rel IS NOT NULL THEN coalesce(hits, 0) / n_rel END AS recall_at_k,
      CASE WHEN n_rel IS NOT NULL THEN coalesce(1.0 / best, 0) END AS reciprocal_rank_at_k, CASE WHEN n_rel IS NOT NULL THEN coalesce(dcg / idcg, 0) END AS ndcg_at_k, top_score, returned, coalesce(hits, 0) AS hits, coalesce(n_rel, 0) AS n_rel
      FROM qq LEFT JOIN ideal USING (query_id) LEFT JOIN d{name} USING (query_id) LEFT JOIN l{name} USING (query_id))"""


_EVAL = f"""{_HITS}, {_NOTE},
qrel AS (SELECT DISTINCT query_id, path, length(path) % 4 AS grade FROM h), rel AS (SELECT * FROM qrel WHERE grade > 0), qq AS (SELECT DISTINCT query_id FROM h),
ideal AS (SELECT query_id, count(*) AS n_rel, sum(CASE WHEN k <= 10 THEN round((2 ** grade - 1) / log2(k + 1), 12) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, path) AS k FROM rel) GROUP BY 1),
{_eval_sql("a", "pos")}"""
_TIDY = """bad AS (SELECT query_id, n, bool_or(s <= 0 OR (nx IS NOT NULL AND (nx <= 0 OR nx > s))) AS bad, coalesce(max(CASE WHEN bm25_rank <= 3 OR cosine_rank <= 3 THEN pos END), 0) AS champion FROM t GROUP BY ALL),
            g AS (SELECT query_id, pos, n, CASE WHEN nx > 0 AND s > 0 THEN ln(s / nx) END AS gap FROM t), c AS (SELECT query_id, median(gap) AS center FROM g GROUP BY 1),
            m AS (SELECT query_id, center, median(abs(gap - center)) AS mad, max((gap, pos)) FILTER (pos >= 3 AND n - pos >= 3 AND gap IS NOT NULL) AS knee FROM g JOIN c USING (query_id) GROUP BY ALL),
            td AS (SELECT query_id, CASE WHEN NOT bad AND n >= 6 AND knee[1] > greatest(ln(10.0::DOUBLE / 9), center + 3 * 1.4826 * mad) AND champion <= knee[2] THEN knee[2] ELSE n END::INT AS keep, n::INT AS n FROM bad JOIN m USING (query_id))"""
_T = "SELECT *, rrf::DOUBLE AS s, lead(rrf::DOUBLE) OVER (PARTITION BY query_id ORDER BY pos) AS nx, count(*) OVER (PARTITION BY query_id) AS n FROM h WHERE pos <= 10"
#: The lines of a text, the number of the line that closes its frontmatter (0 for none), and the text without it.
_FRONT = """ln AS (SELECT *, string_split(text, chr(10)) AS l FROM documents),
            fm AS (SELECT *, CASE WHEN l[1] IN ('---', '---' || chr(13)) THEN coalesce(list_position(list_transform(l[2:], lambda x: regexp_replace(x, '\\s+$', '')), '---'), 0) ELSE 0 END AS z FROM ln),
            bo AS (SELECT *, CASE WHEN z > 0 THEN array_to_string(l[z + 2:], chr(10)) ELSE text END AS body, CASE WHEN z > 0 THEN l[2:z] ELSE [] END AS front FROM fm)"""
_TITLE = "coalesce(nullif(trim(regexp_extract({1}, '(?m)^# ([^\\r\\n]*)', 1)), ''), regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '\\.[^.]*$', ''))"
_OFF = "(epoch(timezone('Europe/Berlin', to_timestamp({0})))::BIGINT - ({0}))"
_TICKS = "ev AS (SELECT DISTINCT * FROM tick_events), ru AS (SELECT DISTINCT id, pipeline_id, corpus_sha256, ts FROM tick_runs), tk AS (SELECT path, count(*) AS count, min(ts) AS first_used, max(ts) AS last_used FROM ev JOIN ru ON ru.id = ev.run_id WHERE path IS NOT NULL GROUP BY path)"
_FAME = "fm AS (SELECT *, path NOT IN (SELECT path FROM files WHERE path IS NOT NULL) AS missing FROM tk ORDER BY count DESC, last_used DESC, path LIMIT 20)"
_BASE = "ok AS (SELECT started_at, finished_at FROM index_runs WHERE status = 'ok'), base AS (SELECT path, arg_max(lower(sha256), (indexed_at, lower(sha256))) AS sha256 FROM files f WHERE path IS NOT NULL AND EXISTS (SELECT 1 FROM ok WHERE f.indexed_at BETWEEN started_at AND finished_at) GROUP BY path)"
_TREE = """lf AS (SELECT ('0x' || substr(sha256(path), 1, 8))::BIGINT % 256 AS part, path, sha256 FROM base WHERE sha256 IS NOT NULL), lv AS (SELECT part, sha256(string_agg(path || chr(0) || sha256 || chr(10), '' ORDER BY path, sha256)) AS s FROM lf GROUP BY part),
            tree AS (SELECT sha256(string_agg(part || ':' || s || chr(10), '' ORDER BY part)) AS corpus_tree_sha256 FROM lv)"""
_NAME = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.md$', '')"


def oracle_sql() -> dict[str, str]:
    word = " OR ".join(f"contains(lower(path), '{w}')" for w in WORDS)
    return {
        "bm25_topk": f"WITH {_CH}, {_Q}, {_BM25} SELECT query_id, id, round(score, 5) AS score, rank FROM lex WHERE rank <= 10",
        "cosine_topk": f"WITH {_CH}, {_Q}, {_VEC} SELECT query_id, id, round(score, 5) AS score, rank FROM vec WHERE rank <= 10",
        "hybrid_rrf": f"WITH {_CH}, {_Q}, {_BM25}, {_VEC}, {_RRF} SELECT query_id, id, bm25_rank, cosine_rank, round(rrf::DOUBLE, 8) AS rrf, fusion_rank FROM fu",
        "search_notes": (notes_sql := f"""WITH {_CH}, {_Q}, {_BM25}, {_VEC}, {_RRF}, h AS (SELECT fu.*, path, body FROM fu JOIN ch USING (id)),
            n AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY fusion_rank) AS k, count(*) OVER (PARTITION BY query_id, path) - 1 AS more, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS flat FROM h),
            p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_rank) AS pos FROM n WHERE k = 1)
            SELECT query_id, pos, id AS chunk_id, path, round(rrf::DOUBLE, 8) AS rrf, CASE WHEN length(flat) > 200 THEN left(flat, 200) || '…' ELSE flat END AS snippet, CASE WHEN more > 0 THEN more::INT END AS siblings FROM p WHERE pos <= 10"""),
        "search_stored": notes_sql,
        "search_tidy": f"""WITH {_CH}, {_Q}, {_BM25}, {_VEC}, {_RRF}, nn AS (SELECT fu.*, path, row_number() OVER (PARTITION BY query_id, path ORDER BY fusion_rank) AS k, count(*) OVER (PARTITION BY query_id, path) - 1 AS more, min(bm25_rank) OVER (PARTITION BY query_id, path) AS b, min(cosine_rank) OVER (PARTITION BY query_id, path) AS c FROM fu JOIN ch USING (id)),
            h AS (SELECT query_id, id, path, rrf, b AS bm25_rank, c AS cosine_rank, CASE WHEN more > 0 THEN more::INT END AS siblings, row_number() OVER (PARTITION BY query_id ORDER BY fusion_rank) AS pos FROM nn WHERE k = 1 QUALIFY pos <= 10), t AS ({_T}),
            {_TIDY} SELECT query_id, pos, id AS chunk_id, path, siblings, NULL::DOUBLE AS relevance, NULL::VARCHAR AS body, NULL::DOUBLE AS rerank FROM h JOIN td USING (query_id) WHERE n <> 10 OR pos <= keep""",
        "word_store": f"""WITH {_CH}, c AS (SELECT id, heading_path AS h, CASE WHEN starts_with(path, '40-Archive/') THEN heading_path ELSE body END AS b FROM ch WHERE NOT starts_with(coalesce(path, ''), '30-Resources/')),
            w AS (SELECT id, coalesce(len({_W.format("h")}), 0) + coalesce(len({_W.format("b")}), 0) AS words FROM c) SELECT id, words, words AS postings FROM w""",
        "query_syntax": f"""WITH {_CH}, qt AS (SELECT * FROM (VALUES ('must', 'firewall', NULL), ('must', 'rule', NULL), ('phrase', 'thesis', NULL), ('phrase', 'chapter', NULL), ('not', 'kiln', NULL), ('field', 'risks', 'heading_path'), ('field', 'ledger', NULL), ('and', 'roof', NULL), ('and', 'tile', NULL)) AS v(query_id, term, fld)),
            {_BM25.replace("qt AS (SELECT DISTINCT query_id, unnest(" + _W.format("query") + ") AS term FROM q),", "").replace("SELECT query_id, id, ln(1", "SELECT query_id, id, fld, field, ln(1").replace("FROM w GROUP BY ALL", "FROM w WHERE fld IS NULL OR fld = field GROUP BY query_id, id").replace("lex AS (SELECT *, row_number()", "lx AS (SELECT *, row_number()")},
            al AS (SELECT id, list_distinct(flatten(list(coalesce(t, [])))) AS t, bool_or(contains(' ' || array_to_string(t, ' ') || ' ', ' thesis chapter ')) AS ph FROM tok GROUP BY id),
            ok AS (SELECT l.* FROM lexs l JOIN al USING (id) WHERE CASE query_id WHEN 'must' THEN list_contains(t, 'firewall') WHEN 'phrase' THEN ph WHEN 'not' THEN NOT list_contains(t, 'archive') WHEN 'and' THEN list_contains(t, 'roof') AND list_contains(t, 'tile') ELSE true END)
            SELECT query_id, id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ok QUALIFY rank <= 10""",
        "smart_search": f"""WITH {_CH}, q0 AS (SELECT DISTINCT id AS query_id, query_text AS query FROM tick_runs WHERE query_text IS NOT NULL),
            q AS (SELECT query_id * 2 AS query_id, query FROM q0 UNION ALL SELECT query_id * 2 + 1, query || ' archive' FROM q0), {_BM25},
            sv AS (SELECT id, embedding::DOUBLE[] AS e FROM ch WHERE {_OK}), qv AS (SELECT q0.query_id * 2 AS query_id, v.embedding::DOUBLE[] AS e FROM q0 JOIN embeddings v ON v.vec_id = q0.query_id UNION ALL SELECT q0.query_id * 2 + 1, v.embedding::DOUBLE[] FROM q0 JOIN embeddings v ON v.vec_id = q0.query_id + 1),
            vs AS (SELECT query_id, id, round(list_cosine_similarity(qv.e, sv.e), 9) AS score FROM qv, sv), vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, substr(id, 1, 16), id) AS rank FROM vs),
            al AS (SELECT query_id // 2 AS query_id, (query_id % 2) * 2 AS no, id, rank FROM lex WHERE rank <= 40 UNION ALL SELECT query_id // 2, (query_id % 2) * 2 + 1, id, rank FROM vec WHERE rank <= 40),
            s4 AS (SELECT query_id, id, max(CASE WHEN no = 0 THEN rank END) AS r0, max(CASE WHEN no = 1 THEN rank END) AS r1, max(CASE WHEN no = 2 THEN rank END) AS r2, max(CASE WHEN no = 3 THEN rank END) AS r3 FROM al GROUP BY 1, 2),
            fs AS (SELECT query_id, id, (((0::FLOAT + coalesce((1.0::DOUBLE / (60 + r0))::FLOAT, 0::FLOAT)) + coalesce((1.0::DOUBLE / (60 + r1))::FLOAT, 0::FLOAT)) + coalesce((1.0::DOUBLE / (60 + r2))::FLOAT, 0::FLOAT)) + coalesce((1.0::DOUBLE / (60 + r3))::FLOAT, 0::FLOAT) AS rrf FROM s4),
            fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS pos FROM fs QUALIFY pos <= 40),
            wd AS (SELECT fu.*, path, list_filter(list_distinct(regexp_split_to_array(lower(query), '\\s+')), lambda x: x <> '') AS a, list_filter(list_distinct(regexp_split_to_array(lower(body), '\\s+')), lambda x: x <> '') AS b FROM fu JOIN ch USING (id) JOIN q0 USING (query_id)),
            lg AS (SELECT *, (len(list_intersect(a, b)) + 0.5::DOUBLE) / (len(a) + 1) AS share FROM wd), l2 AS (SELECT *, CASE WHEN pos <= 20 THEN ln(share / (1 - share)) END AS logit FROM lg),
            rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos <= 20 THEN 0 ELSE 1 END, logit DESC NULLS LAST, pos) AS np FROM l2), pn AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY np) AS k FROM rr),
            o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY np) AS p FROM pn WHERE k = 1) SELECT query_id, p AS pos, id AS chunk_id, path, CASE WHEN pos <= 20 THEN np::INT END AS rerank_rank, round(rrf::DOUBLE, 8) AS rrf FROM o WHERE p <= 10""",
        "suggested_folders": f"""WITH {_CH}, q AS (SELECT DISTINCT id AS query_id, query_text AS query FROM tick_runs JOIN embeddings ON vec_id = id WHERE query_text IS NOT NULL ORDER BY id LIMIT 1), {_BM25}, {_VEC}, {_RRF.replace("rank <= 120", "rank <= 36").replace("fusion_rank <= 40", "fusion_rank <= 12")},
            hf AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, rrf, fusion_rank FROM fu JOIN ch USING (id)), nf AS (SELECT folder, arg_min(rrf, fusion_rank) AS score, min(fusion_rank)::INT AS pos FROM hf WHERE folder <> '' AND NOT starts_with(folder, '00-Inbox') GROUP BY 1),
            fo AS (WITH  p AS (SELECT DISTINCT split_part(path, '/', 1) AS a, CASE WHEN length(path) - length(replace(path, '/', '')) > 1 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END AS b FROM files WHERE contains(path, '/')),
            s AS (SELECT a, bool_or(b IS NOT NULL) AS several FROM p WHERE a IN ('10-Projects', '20-Areas', '30-Resources', '40-Archive') GROUP BY 1) SELECT DISTINCT coalesce(b, a) AS folder FROM p JOIN s USING (a) WHERE b IS NOT NULL OR NOT several)
            SELECT folder, round(score::DOUBLE, 8) AS score, pos FROM nf UNION ALL SELECT folder, 0.0, NULL FROM fo WHERE folder NOT IN (SELECT folder FROM nf)""",
        "settled_status": """WITH o AS (SELECT path, max((indexed_at, coalesce(mtime, 0), lower(sha256))) AS b FROM files WHERE path IS NOT NULL GROUP BY 1), n AS (SELECT path, max((seen_at, coalesce(mtime, 0), lower(sha256))) AS b FROM vault_walk WHERE run_id = 12 AND path IS NOT NULL GROUP BY 1)
            SELECT path, coalesce(CASE WHEN n.b IS NULL THEN 'removed' WHEN o.b IS NULL THEN 'new' WHEN abs(n.b[2] - o.b[2]) < 2.220446049250313e-16 THEN 'same' WHEN n.b[3] <> o.b[3] THEN 'changed' ELSE 'refreshed' END, 'unknown') AS status FROM o FULL JOIN n USING (path)""",
        "usage_days": f"WITH {_TICKS} SELECT path, strftime(make_timestamp(first_used * 1000000), '%Y-%m-%d') AS first_used_day, strftime(make_timestamp(last_used * 1000000), '%Y-%m-%d') AS last_used_day FROM tk",
        "event_lines": """SELECT CASE run_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'log' END AS type, CASE WHEN run_id % 4 = 1 THEN 'info' END AS level, CASE WHEN run_id % 4 = 1 THEN path END AS message, CASE WHEN run_id % 4 = 0 THEN path END AS path, CASE WHEN run_id % 4 = 0 THEN 'create' END AS action,
            CASE run_id % 4 WHEN 2 THEN path WHEN 3 THEN '{"type":"odd","path":"' || path || '"}' END AS raw FROM tick_events WHERE path IS NOT NULL""",
        "inbox_notes": f"SELECT note_path AS path, {_TITLE.format('note_path', 'text')} AS title FROM documents WHERE regexp_matches(note_path, '^00-Inbox/[^/]+\\.md$')",
        "extension_sizes": "SELECT lower(regexp_extract(note_path, '\\.([^./]+)$', 1)) AS extension, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1",
        "created_minutes": f"""WITH f AS (SELECT DISTINCT path, created, source, tz, loc_tag FROM frontmatter WHERE created IS NOT NULL), l AS (SELECT *, CASE WHEN regexp_full_match(trim(created), '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}') THEN epoch(try_strptime(trim(created), '%Y-%m-%dT%H:%M'))::BIGINT END AS l FROM f),
            ab AS (SELECT *, l - {_OFF.format("l - 86400")} AS a, l - {_OFF.format("l + 86400")} AS b FROM l), g AS (SELECT *, a + {_OFF.format("a")} = l AS ga, b + {_OFF.format("b")} = l AS gb FROM ab)
            SELECT path, created, coalesce(CASE WHEN ga AND gb AND a <> b THEN NULL WHEN ga THEN a WHEN gb THEN b END, 0)::BIGINT AS created_at FROM g""",
        "text_functions": f"""WITH {_FRONT}, x AS (SELECT *, n_chars * 1000 AS nb FROM bo) SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 79) || '…' ELSE text END AS short,
            CASE WHEN nb >= 1048576 THEN printf('%.1f MB', floor(nb / 1048576.0::DOUBLE * 10 + 0.5) / 10) WHEN nb >= 1024 THEN printf('%.1f KB', floor(nb / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE nb || ' B' END AS size, md5(left(body, 800)) AS head,
            regexp_full_match(source, '[A-Za-z_][A-Za-z0-9_-]*') AND source NOT IN ('created', 'status', 'source', 'para', 'modified', 'title') AS producer, CASE WHEN contains(note_path, '/') AND split_part(note_path, '/', 1) IN ('00-Inbox', '10-Projects', '20-Areas', '30-Resources', '40-Archive') THEN split_part(note_path, '/', 1) END AS folder FROM x""",
        "frontmatter_fields": f"""WITH {_FRONT}, k AS (SELECT doc_id, list_filter(list_transform(front, lambda x: struct_pack(k := regexp_replace(regexp_extract(x, '^([^:]*):', 1), '^\\s+|\\s+$', '', 'g'), v := regexp_replace(regexp_extract(x, '^[^:]*:(.*)$', 1), '^\\s+|\\s+$', '', 'g'))), lambda p: p.v <> '') AS p FROM bo)
            SELECT doc_id, trim(list_filter(p, lambda y: y.k = 'created')[1].v, chr(34) || chr(39)) AS created_raw, trim(list_filter(p, lambda y: y.k = 'source')[1].v, chr(34) || chr(39)) AS source,
            len(list_filter(p, lambda y: regexp_full_match(y.k, '[A-Za-z_][A-Za-z0-9_-]*') AND NOT list_contains(['created', 'status', 'source', 'para', 'modified', 'title'], y.k) AND json_valid(y.v)))::INT AS n_fields FROM k""",
        "note_titles": f"WITH {_FRONT} SELECT doc_id, {_TITLE.format('note_path', 'text')} AS title, length(body) AS body_chars FROM bo",
        "chunk_rules": f"WITH {_FRONT} SELECT doc_id || '.md' AS path, true AS in_order, true AS ids_fit, true AS words_kept FROM bo WHERE regexp_matches(body, '[\\p{{L}}\\p{{N}}]')",
        "event_problems": """WITH e AS (SELECT DISTINCT run_id // 2 AS run_id, path, fusion_rank, bm25_rank, cosine_rank, rerank_rank, final_rank, rerank_scored FROM tick_events), w AS (SELECT *, count(*) OVER (PARTITION BY run_id, path) AS np, count(final_rank) OVER (PARTITION BY run_id, final_rank) AS nf FROM e),
            p AS (SELECT *, list_filter([CASE WHEN fusion_rank IS NULL OR fusion_rank < 1 THEN 'fusion_rank' END, CASE WHEN final_rank IS NULL OR final_rank < 1 THEN 'final_rank' END, CASE WHEN least(bm25_rank, cosine_rank, rerank_rank) < 1 THEN 'rank below 1' END, CASE WHEN rerank_scored = 1 AND rerank_rank IS NULL THEN 'scored without rank' END,
              CASE WHEN rerank_scored = 0 AND rerank_rank IS NOT NULL THEN 'rank without score' END, CASE WHEN np > 1 THEN 'path repeated' END, CASE WHEN nf > 1 THEN 'final_rank repeated' END], lambda x: x IS NOT NULL) AS l FROM w)
            SELECT run_id, path, final_rank, array_to_string(l, ', ') AS problems FROM p WHERE len(l) > 0""",
        "fingerprint_tree": f"WITH {_BASE}, {_TREE} SELECT * FROM tree",
        "overview": f"WITH {_BASE}, {_TREE} SELECT (SELECT count(DISTINCT path) FROM base WHERE sha256 IS NOT NULL) AS files, (SELECT count(DISTINCT id) FROM chunks) AS chunks, (SELECT count(DISTINCT id) FROM chunks WHERE embedding IS NOT NULL) AS embedded, corpus_tree_sha256 FROM tree",
        "doctor": f"""WITH {_BASE}, {_TICKS}, f AS (SELECT DISTINCT path FROM base WHERE sha256 IS NOT NULL), c AS (SELECT DISTINCT * FROM chunks)
            SELECT 'chunks without vector' AS "check", count(*) AS count FROM c WHERE embedding IS NULL UNION ALL SELECT 'vectors of another width', count(*) FROM c WHERE len(embedding) <> 64 UNION ALL SELECT 'chunks without file', count(*) FROM c WHERE path IS NULL OR path NOT IN (SELECT path FROM f)
            UNION ALL SELECT 'chunk ids more than once', count(*) FROM (SELECT id FROM c GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'paths more than once', 0 UNION ALL SELECT 'ids that don''t fit path and number', count(*) FROM c WHERE sha256(path || '#' || ord) <> id
            UNION ALL SELECT 'counters without file', count(*) FROM tk WHERE path NOT IN (SELECT path FROM f) UNION ALL SELECT 'events without file', count(*) FROM ev WHERE path IS NULL OR path NOT IN (SELECT path FROM f)""",
        "export_rows": f"WITH {_CH} SELECT row_number() OVER (ORDER BY path NULLS FIRST, ord NULLS FIRST, id) - 1 AS i, id, path, ord FROM ch WHERE {_OK}",
        "chunk_stats": f"WITH {_CH} SELECT path, count(*) FILTER (kind = 0) AS content, count(*) FILTER (kind = 1) AS fields, sum(ceil(length(body) / 3.5))::BIGINT AS tokens, count(*) FILTER (heading_path = '') AS bare, max(length(body)) AS longest FROM ch WHERE path IS NOT NULL GROUP BY path",
        "stemmed_search": f"""WITH {_CH}, t AS (SELECT id, list_concat({_W.format("coalesce(body, '')")}, {_W.format("coalesce(heading_path, '')")}) AS t FROM ch),
            w AS (SELECT * FROM (VALUES ('note', ['note', 'notes', 'noted', 'noting']), ('measure', ['measure', 'measures', 'measured', 'measuring', 'measurement', 'measurements']), ('check', ['check', 'checks', 'checked', 'checking'])) AS v(query_id, ws)) SELECT query_id, id FROM w, t WHERE list_has_any(t, ws)""",
        "store_pass": """WITH n AS (SELECT note_path AS path, arg_max(text, doc_id) AS t FROM documents WHERE note_path LIKE '%.md' AND text IS NOT NULL GROUP BY 1)
            SELECT path, sha256(CASE WHEN starts_with(path, '40-Archive/') THEN t || chr(10) || chr(10) || 'One line more.' ELSE t END) AS sha256, true AS embedded, 0::BIGINT AS problems FROM n WHERE NOT starts_with(path, '30-Resources/')""",
        "tick_record": """WITH e AS (SELECT DISTINCT run_id, path FROM tick_events WHERE path IS NOT NULL), r AS (SELECT run_id, row_number() OVER (ORDER BY run_id) - 1 AS k FROM (SELECT DISTINCT run_id FROM e) QUALIFY k < 2)
            SELECT path, count(*) AS count, min(1700000000 + k)::BIGINT AS first_used, max(1700000000 + k)::BIGINT AS last_used FROM e JOIN r USING (run_id) GROUP BY 1""",
        "durations": "SELECT told, seconds::BIGINT AS seconds, (1700000000 - seconds)::BIGINT AS cutoff FROM (VALUES ('10h', 36000), ('5d', 432000), ('3m', 7776000), ('1y', 31536000), ('90s', 90), ('30min', 1800), ('2w', 1209600), ('7', 604800)) AS v(told, seconds)",
        "label_lines": "SELECT * FROM (VALUES ('roof tile', 'a', true, 'x/a.md', 1), ('roof tile', 'a', true, 'b.md', 3), ('none', NULL, false, NULL, NULL), ('zero', NULL, false, 'c.md', 0)) AS v(query, cohort, graded, path, grade)",
        "since_filter": f"WITH {_HITS} SELECT query_id, pos, id FROM h WHERE created >= {CUTOFF}",
        "source_filter": f"WITH {_HITS} SELECT query_id, pos, id FROM h WHERE lower(source) = 'slack'",
        "scope_exclude": f"WITH {_HITS} SELECT query_id, pos, id, path FROM h WHERE pos <= 10 AND NOT ({word})",
        "scope_elided": f"WITH {_HITS} SELECT query_id, count(*) FILTER ({word}) AS elided FROM h WHERE pos <= 10 GROUP BY 1",
        "note_dedup": f"WITH {_HITS}, {_NOTE} SELECT * EXCLUDE (relevance) FROM n1",
        "score_floor": f"WITH {_HITS}, t AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY pos) AS top FROM h) SELECT query_id, pos, id FROM t WHERE greatest(0, least(100, round(100.0::DOUBLE * score::DOUBLE / greatest(top::DOUBLE, 1.1920929e-07)))) >= 60",
        "relevance_floor": f"WITH {_HITS} SELECT query_id, pos, id, round(relevance, 6) AS relevance FROM h WHERE relevance >= 0.5",
        "tidy_prefix": f"""WITH {_HITS}, t AS (SELECT *, rrf::DOUBLE AS s, lead(rrf::DOUBLE) OVER (PARTITION BY query_id ORDER BY pos) AS nx, count(*) OVER (PARTITION BY query_id) AS n FROM h WHERE pos <= 10),
            {_TIDY}
            SELECT * FROM td""",
        "rerank_prefix": f"""WITH {_HITS}, l AS (SELECT *, CASE WHEN isfinite(cosine) THEN cosine::DOUBLE END AS logit FROM h),
            p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos <= 20 THEN 0 ELSE 1 END, CASE WHEN pos <= 20 THEN logit END DESC NULLS LAST, pos) AS np FROM l)
            SELECT query_id, np AS pos, id, CASE WHEN pos <= 20 AND logit IS NOT NULL THEN np::INT END AS rerank_rank, round(CASE WHEN pos <= 20 AND logit IS NOT NULL THEN 1 / (1 + exp(-logit)) ELSE score::DOUBLE END, 6) AS score FROM p""",
        "display_groups": f"WITH {_HITS}, t AS (SELECT query_id, pos, id, min(pos) OVER (PARTITION BY query_id, path) AS note_pos, row_number() OVER (PARTITION BY query_id, path ORDER BY pos) AS n_in_note, greatest(count(*) OVER (PARTITION BY query_id, path) - 3, 0) AS more FROM h) SELECT * FROM t WHERE n_in_note <= 3",
        "neighbor_window": f"WITH {_HITS} SELECT h.query_id, h.pos, ch.ord, ch.id, ch.ord = h.ord AS centre FROM h JOIN ch ON ch.path = h.path AND ch.kind = h.kind AND ch.ord BETWEEN h.ord - 2 AND h.ord + 2 WHERE h.pos <= 3",
        "context_windows": f"""WITH {_HITS}, t AS (SELECT h.query_id, h.pos, max(CASE WHEN ch.ord = h.ord THEN coalesce(body, '') END) AS c, max(CASE WHEN ch.ord = h.ord - 1 THEN coalesce(body, '') END) AS b, max(CASE WHEN ch.ord = h.ord + 1 THEN coalesce(body, '') END) AS n
              FROM h JOIN ch ON ch.path = h.path AND ch.kind = h.kind AND ch.ord BETWEEN h.ord - 1 AND h.ord + 1 WHERE h.pos <= 3 GROUP BY 1, 2),
            u AS (SELECT *, CASE WHEN b IS NOT NULL AND ceil(length(b || chr(10) || chr(10) || c) / 3.5) <= {numbers.context_budget(1)} THEN b || chr(10) || chr(10) || c ELSE c END AS s FROM t),
            v AS (SELECT *, CASE WHEN ceil(length(c) / 3.5) > {numbers.context_budget(1)} THEN c WHEN n IS NOT NULL AND ceil(length(s || chr(10) || chr(10) || n) / 3.5) <= {numbers.context_budget(1)} THEN s || chr(10) || chr(10) || n ELSE s END AS d FROM u)
            SELECT query_id, pos, md5(d) AS doc, length(d) AS chars FROM v""",
        "variant_fusion": f"""WITH {_HITS}, t AS (SELECT query_id, id, (0::FLOAT + coalesce((1.0::DOUBLE / (60 + CASE WHEN bm25_rank >= 1 THEN bm25_rank END))::FLOAT, 0::FLOAT)) + coalesce((1.0::DOUBLE / (60 + CASE WHEN cosine_rank >= 1 THEN cosine_rank END))::FLOAT, 0::FLOAT) + (1.0::DOUBLE / (60 + pos))::FLOAT AS rrf FROM h)
            SELECT query_id, id, round(rrf::DOUBLE, 8) AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS fusion_rank FROM t QUALIFY fusion_rank <= 40""",
        "eval_metrics": f"WITH {_EVAL} SELECT query_id, cohort, is_negative, round(precision_at_k, 6) AS precision_at_k, round(recall_at_k, 6) AS recall_at_k, round(reciprocal_rank_at_k, 6) AS reciprocal_rank_at_k, round(ndcg_at_k, 6) AS ndcg_at_k, returned, hits::INT AS n_found, (n_rel - hits)::INT AS n_missing FROM ea",
        "eval_aggregate": f"""WITH {_EVAL}, g AS (SELECT avg(precision_at_k) AS a, avg(recall_at_k) AS b, avg(reciprocal_rank_at_k) AS c, avg(ndcg_at_k) AS d, count(*) FILTER (NOT is_negative) AS np, count(*) FILTER (is_negative) AS nn, count(ndcg_at_k) AS ng,
              count(top_score) FILTER (NOT is_negative) AS tp, count(top_score) FILTER (is_negative) AS tn, avg(top_score) FILTER (NOT is_negative) AS mp, avg(top_score) FILTER (is_negative) AS mn FROM ea),
            k AS (SELECT *, CASE WHEN np = tp THEN mp END AS p, CASE WHEN nn = tn THEN mn END AS n FROM g)
            SELECT round(a, 6) AS mean_precision_at_k, round(b, 6) AS mean_recall_at_k, round(c, 6) AS mrr_at_k, round(d, 6) AS mean_ndcg_at_k, np AS n_positive, nn AS n_negative, ng AS n_graded, tp AS n_positive_with_top_score, tn AS n_negative_with_top_score,
              round(p, 6) AS mean_top_score_positive, round(n, 6) AS mean_top_score_negative, round(p - n, 6) AS top_score_delta FROM k""",
        "cohort_delta": f"""WITH {_EVAL}, {_eval_sql("b", "row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC NULLS LAST, path)")}
            SELECT ea.cohort, count(*) AS queries, round(avg(eb.ndcg_at_k - ea.ndcg_at_k), 6) AS ndcg_delta FROM ea JOIN eb USING (query_id) WHERE NOT ea.is_negative GROUP BY 1""",
        "unknown_paths": f"WITH {_HITS}, p AS (SELECT path FROM h UNION SELECT note_path FROM documents WHERE note_path IS NOT NULL) SELECT path FROM p WHERE path NOT IN (SELECT path FROM files WHERE path IS NOT NULL) OR path NOT IN (SELECT path FROM chunks WHERE path IS NOT NULL)",
        "tick_counters": f"WITH {_TICKS} SELECT * FROM tk",
        "fame": f"WITH {_TICKS}, {_FAME} SELECT path, count, first_used, last_used, missing FROM fm",
        "rank_report": f"""WITH {_TICKS}, {_FAME}, g AS (SELECT path, pipeline_id, corpus_sha256, count(*) AS events, median(fusion_rank) AS median_fusion_rank, median(bm25_rank) AS median_bm25_rank, median(cosine_rank) AS median_cosine_rank, median(rerank_rank) AS median_rerank_rank,
              median(final_rank) AS median_final_rank, count(*) FILTER (rerank_scored = 1) AS rerank_scored, count(*) FILTER (coalesce(rerank_scored, 0) <> 1) AS unscored_tail, max(ts) AS last_event FROM ev JOIN ru ON ru.id = ev.run_id GROUP BY ALL)
            SELECT path, count AS ticks, missing, pipeline_id, corpus_sha256, coalesce(events, 0) AS events, median_fusion_rank, median_bm25_rank, median_cosine_rank, median_rerank_rank, median_final_rank, coalesce(rerank_scored, 0) AS rerank_scored, coalesce(unscored_tail, 0) AS unscored_tail, last_event FROM fm LEFT JOIN g USING (path)""",
        "usage_merge": f"WITH {_TICKS} SELECT CASE WHEN starts_with(path, '40-Archive/') THEN '40-Archive/' || regexp_extract(path, '([^/]*)$', 1) ELSE path END AS path, sum(count)::BIGINT AS count, min(first_used) AS first_used, max(last_used) AS last_used FROM tk GROUP BY 1",
        "orphans": f"WITH {_TICKS}, f AS (SELECT path FROM files WHERE path IS NOT NULL) SELECT (SELECT count(*) FROM tk WHERE path NOT IN (SELECT path FROM f)) AS ticks, (SELECT count(*) FROM ev WHERE path IS NULL OR path NOT IN (SELECT path FROM f)) AS events",
        "snapshot_diff": """WITH o AS (SELECT path, max((indexed_at, coalesce(mtime, 0), sha256))[2] AS m FROM files WHERE path IS NOT NULL GROUP BY 1), n AS (SELECT path, max((seen_at, coalesce(mtime, 0)))[2] AS m FROM vault_walk WHERE run_id = 12 AND path IS NOT NULL GROUP BY 1)
            SELECT path, CASE WHEN n.m IS NULL THEN 'removed' WHEN o.m IS NULL THEN 'new' WHEN abs(n.m - o.m) >= 2.220446049250313e-16 THEN 'unread' ELSE 'same' END AS status FROM o FULL JOIN n USING (path)""",
        "corpus_fingerprint": f"WITH {_BASE} SELECT sha256(string_agg(path || chr(0) || sha256 || chr(10), '' ORDER BY path)) AS corpus_sha256 FROM base WHERE sha256 IS NOT NULL",
        "path_functions": f"""WITH {_CH}, p AS (SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS bucket, {_NAME} AS name, left(regexp_replace(regexp_replace(lower(heading_path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS sl FROM ch)
            SELECT id, bucket, CASE bucket WHEN '00-Inbox' THEN 'inbox' WHEN '10-Projects' THEN 'project' WHEN '20-Areas' THEN 'area' WHEN '30-Resources' THEN 'resource' WHEN '40-Archive' THEN 'archive' END AS kind_name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder,
              CASE WHEN strlen(name) > 16 THEN regexp_replace(name, '^\\d{{8}}-\\d{{6}}-', '') ELSE name END AS title, string_split(heading_path, ' > ')[-1] AS leaf, CASE WHEN sl = '' THEN 'note' ELSE sl END AS slug, ceil(length(body) / 3.5)::BIGINT AS tokens, substr(id, 1, 16) AS vector_key,
              path LIKE '%_.md' AND NOT starts_with(path, '/') AS owned FROM p""",
        "chunk_ids": f"WITH {_CH} SELECT id, sha256(path || '#' || ord) = id AS fits FROM ch",
        "folder_list": """WITH p AS (SELECT DISTINCT split_part(path, '/', 1) AS a, CASE WHEN length(path) - length(replace(path, '/', '')) > 1 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END AS b FROM files WHERE contains(path, '/')),
            s AS (SELECT a, bool_or(b IS NOT NULL) AS several FROM p WHERE a IN ('10-Projects', '20-Areas', '30-Resources', '40-Archive') GROUP BY 1) SELECT DISTINCT coalesce(b, a) AS folder FROM p JOIN s USING (a) WHERE b IS NOT NULL OR NOT several""",
        "unit_vectors": f"WITH {_CH}, v AS (SELECT id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM ch WHERE {_OK}) SELECT id, round(n, 4) AS norm, 1.0::DOUBLE AS unit_norm FROM v",
        "unembedded_paths": "SELECT DISTINCT path FROM chunks WHERE embedding IS NULL",
        "query_variants": f"WITH {_Q} SELECT query_id, 'lex' AS kind, 'about ' || query AS text FROM q UNION ALL SELECT query_id, 'hyde', 'A passage.' FROM q",
        "ivf_topk": f"WITH {_CH} SELECT count(*) * 10 AS wanted, true AS recall_98 FROM ch WHERE {_OK} AND ('0x' || substr(id, 1, 8))::BIGINT % 20 = 0",
        "hourly_use": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS uses FROM events GROUP BY ALL",
    }
