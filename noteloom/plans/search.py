"""Search in two plans: retrieve and fuse; then look up, rerank, filter, one hit per note, cut, scope, floors, tidy.

What the first gives, a pool of candidates per query, is written, since the second uses it several times. A batch of queries is a table; every stage works per query_id, so one query is a table of one row. Options are checked
on the driver before anything is planned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import snippet
from ..models import QUERY_PREFIX, Embedder, Reranker, context_column, embed_column, rerank_column
from ..operators import fusing, lexical, rewriting, stages, vectors
from ..session import written
from .index import Store

LEAST_POOL = 30
MODES = ("hybrid", "bm25", "vec")


@dataclass(frozen=True)
class Options:
    mode: str = "hybrid"
    limit: int = 10
    chunks: bool = False
    full: bool = False
    rerank: bool = False
    rerank_context: int = 0
    smart: bool = False
    min_score: float | None = None
    relevance: bool = False
    min_relevance: float | None = None
    since: int | None = None
    source: str | None = None
    exclude: tuple[str, ...] = field(default=())
    exact: bool = False
    exhaustive: bool = False
    tick_provenance: bool = False

    def check(self) -> Options:
        """Raises ValueError where options contradict each other or are out of bounds."""
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.limit < 1:
            raise ValueError("limit must be at least 1")
        numbers.context_budget(self.rerank_context)
        if self.rerank_context and not (self.rerank or self.smart):
            raise ValueError("rerank_context needs rerank or smart")
        if self.min_relevance is not None and not 0 <= self.min_relevance <= 1:
            raise ValueError("min_relevance must be within 0 and 1")
        wants = self.relevance or self.min_relevance is not None
        if wants and self.mode == "bm25":
            raise ValueError("relevance needs mode hybrid or vec")
        if wants and self.smart:
            raise ValueError("relevance isn't there with smart, which keeps no cosine of the original query")
        if self.tick_provenance:
            plain = self.full and self.rerank and self.exact and self.mode == "hybrid" and self.limit <= 1000
            if not plain or self.smart or self.chunks or wants or self.min_score is not None or self.since is not None or self.source is not None:
                raise ValueError("tick_provenance needs a full, reranked, exact, hybrid search per note without filters and floors, limit 1 to 1000")
        return self

    @property
    def pool(self) -> int:
        """How many fused candidates the later stages get, since they may drop many."""
        deep = self.rerank or self.smart or self.since is not None or self.source is not None or not self.chunks
        return max(4 * self.limit, LEAST_POOL) if deep else self.limit

    @property
    def depth(self) -> int:
        """How many candidates each source gives."""
        return max(3 * self.pool, LEAST_POOL) if self.mode == "hybrid" else self.pool

    @property
    def tidy(self) -> bool:
        return self.mode == "hybrid" and not (self.exhaustive or self.rerank or self.smart or self.chunks or self.min_score is not None or self.min_relevance is not None)


@dataclass
class Corpus:
    """The chunk table (id, path, ord, kind, heading_path, body, embedding, created_at, source) and its word index."""

    #: One row per id; what is looked up and scanned for vectors may also be the rows as they came (see ``of``).
    chunks: DataFrame
    index: lexical.Index
    width: int
    #: Stored cells of the vectors and how many there are, where they may be searched approximately.
    cells: Callable[[DataFrame, int], DataFrame] | None = None
    stored: int = 0
    #: What the state is known by: equal before and after a search, if nobody wrote in between.
    state: Callable[[], object] = lambda: None

    @classmethod
    def of(cls, chunks: DataFrame, width: int, stem: bool = False) -> Corpus:
        """A table of chunks, tokenised for this search. Repeated ids are left out where texts are counted; vectors and bodies don't move for it."""
        return cls(chunks.where("id is not null"), lexical.build(chunks, stem=stem), width)

    @classmethod
    def kept(cls, store: Store) -> Corpus:
        """A store's current state, with its indexes as they are stored; nothing is tokenised or fitted."""
        m = store.manifest()
        if m is None:
            raise ValueError("nothing is indexed")
        cells = store.vectors(m["width"])
        rows = cells.rows.live(m["vectors"])
        near = lambda q, k: cells.search(q, k, version=m["vectors"])
        return cls(store.table("chunks", m), store.words.index(m["words"]), m["width"], near, rows.count(), lambda: (store.manifest() or {}).get("version"))


def retrieved(corpus: Corpus, queries: DataFrame, o: Options, terms: DataFrame | None = None) -> DataFrame:
    """Fused candidates with their ranks; queries has query_id, query and, unless mode is bm25, embedding."""
    none = F.lit(None)
    if o.mode != "vec":
        lex = lexical.search(corpus.index, terms if terms is not None else lexical.plain_terms(queries, "query_id", "query", corpus.index.stem), o.depth)
    if o.mode != "bm25":
        whole = corpus.cells is None or vectors.use_exact(o.exact, corpus.stored)
        vec = vectors.exact(corpus.chunks, queries, o.depth, corpus.width) if whole else corpus.cells(queries, o.depth)
    if o.mode == "hybrid":
        got = fusing.hybrid(lex, vec, o.pool)
        return got.withColumn("score", F.col("rrf"))
    one = lex if o.mode == "bm25" else vec
    name, other = ("bm25", "cosine") if o.mode == "bm25" else ("cosine", "bm25")
    return one.select("query_id", "id", F.col("score").alias(name), F.col("rank").alias(f"{name}_rank"), none.cast("double").alias(other), none.cast("int").alias(f"{other}_rank"), none.cast("float").alias("rrf"), F.col("rank").alias("fusion_rank"), F.col("score").cast("float").alias("score"))


def looked_up(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """What the stages need of each hit's chunk; a hit whose chunk is gone is dropped, and of a chunk that is there twice one row is taken."""
    c = chunks.select("id", "path", F.col("created_at").alias("created"), "source")
    d = hits.join(c, "id").dropDuplicates(["query_id", "id"]).withColumn("relevance", numbers.relevance(F.col("cosine")))
    return stages.renumbered(d.withColumn("pos", F.col("fusion_rank")))


def likely(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks whose ids' hashes are among those of ids, so that a join by id moves little else. Every task holds the hashes, 8 bytes each."""
    h = np.sort(np.asarray(ids.select(F.xxhash64("id").alias("h")).distinct().toArrow()["h"]))

    @F.pandas_udf("boolean")
    def among(x: pd.Series) -> pd.Series:
        v = x.to_numpy()
        return pd.Series(h[np.minimum(np.searchsorted(h, v), len(h) - 1)] == v)

    return chunks.where(among(F.xxhash64("id"))) if len(h) else chunks.where("false")


def with_bodies(d: DataFrame, chunks: DataFrame) -> DataFrame:
    """d, which is written, with the heading and the body of each hit's chunk: for the rows that are left, or that a reranker reads. Other bodies don't move."""
    ids = d.select("id").distinct()
    c = likely(chunks.select("id", F.col("heading_path").alias("heading"), "body"), ids).join(ids, "id", "left_semi")
    return d.join(c.dropDuplicates(["id"]), "id")


def presented(hits: DataFrame, chunks: DataFrame, queries: DataFrame, o: Options, reranker: Reranker | None = None) -> DataFrame:
    """All stages after fusion."""
    d = looked_up(hits, chunks)
    none = F.lit(None)
    d = d.withColumns({"rerank": none.cast("double"), "rerank_rank": none.cast("int"), "siblings": none.cast("int")})
    if o.rerank or o.smart:
        if reranker is None:
            raise ValueError("rerank needs a reranker")
        cap = stages.rerank_cap(o.limit, o.pool, (o.min_score or 0) > 0)
        d = written(d, "looked-up")
        head = with_bodies(d.where(F.col("pos") <= cap), chunks).join(queries.select("query_id", "query"), "query_id")
        if o.rerank_context:
            w = stages.neighbours(head, chunks, o.rerank_context).groupBy("query_id", "pos").agg(F.collect_list(F.struct("ord", "body", "centre")).alias("w"))
            head = head.join(w, ["query_id", "pos"], "left").withColumn("doc", F.coalesce(context_column(o.rerank_context)(F.coalesce("w", F.array(F.struct(F.lit(0).alias("ord"), F.col("body"), F.lit(True).alias("centre"))))), "body"))
        else:
            head = head.withColumn("doc", F.col("body"))
        head = head.withColumn("logit", rerank_column(reranker)(F.col("query"), F.col("doc")))
        d = d.join(head.select("query_id", "pos", "logit"), ["query_id", "pos"], "left")
        d = stages.reranked(d, cap).drop("logit")
    d = stages.renumbered(stages.from_source(stages.since(d, o.since), o.source))
    if not o.chunks:
        d = stages.one_per_note(d)
    d = stages.scoped(stages.truncated(d, o.limit), list(o.exclude))
    d = stages.renumbered(d)
    d = stages.relevance_floor(stages.score_floor(d, o.min_score), o.min_relevance)
    if o.tidy:
        # at most limit rows per query, which it reads several times
        d = stages.tidied(written(d, "untidied"), o.limit)
    if not (o.relevance or o.min_relevance is not None):
        d = d.withColumn("relevance", none.cast("double"))
    # at most limit rows per query, so bodies are read for these alone
    d = with_bodies(written(d, "hits"), chunks).withColumn("snippet", snippet(F.col("body")))
    if not o.full:
        d = d.withColumn("body", none.cast("string"))
    return stages.renumbered(d).select("query_id", "pos", F.col("id").alias("chunk_id"), "path", "heading", "score", "relevance", "rrf", "cosine", "bm25", "bm25_rank", "cosine_rank", "fusion_rank", "rerank", "rerank_rank", "snippet", "body", "created", "source", "siblings")


def search(corpus: Corpus, queries: DataFrame, o: Options = Options(), reranker: Reranker | None = None, terms: DataFrame | None = None) -> DataFrame:
    """The hits of every query in the batch."""
    o.check()
    # at most a pool per query; the stages use them several times, and their chunks are looked up by them
    pool = written(retrieved(corpus, queries, o, terms), "pool")
    return presented(pool, corpus.chunks, queries, o, reranker)


def smart_search(corpus: Corpus, queries: DataFrame, variants: DataFrame, o: Options, reranker: Reranker) -> DataFrame:
    """Every query with its variants: one ranked list per variant and two for the original, fused and reranked against the original.

    variants has query_id, list_no (from 2), kind (lex, vec, hyde), text and embedding (null for lex).
    """
    o = replace(o, smart=True).check()
    lists = rewriting.plan_lists(queries, variants)
    lex = lists.where("kind = 'lex'").withColumn("key", F.concat_ws("\x01", "query_id", "list_no"))
    vec = lists.where("kind != 'lex'").withColumn("key", F.concat_ws("\x01", "query_id", "list_no"))
    a = lexical.search(corpus.index, lexical.plain_terms(lex, "key", "text", corpus.index.stem), o.pool)
    b = vectors.exact(corpus.chunks, vec, o.pool, corpus.width, query_id="key")
    named = lambda d: d.select(F.split_part("query_id", F.lit("\x01"), F.lit(1)).alias("query_id"), F.split_part("query_id", F.lit("\x01"), F.lit(2)).cast("int").alias("list_no"), "id", "rank")
    got = fusing.fused(named(a).unionByName(named(b)), o.pool)
    none = F.lit(None)
    got = got.withColumns({"score": F.col("rrf"), **{c: none.cast(t) for c, t in (("bm25", "double"), ("bm25_rank", "int"), ("cosine", "double"), ("cosine_rank", "int"))}})
    q = queries.withColumn("query_id", F.col("query_id").cast("string"))
    return presented(written(got, "pool"), corpus.chunks, q, o, reranker)


def suggested_folders(corpus: Corpus, note_path: str, query: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(folder, score, pos): where a note may belong: folders of similar notes by their first hit, then the other known ones with 0.

    The search is by chunks, with limit 12; the note itself, the top level and the inbox are left out.
    """
    from ..functions.text import parent_folder

    o = Options(limit=12, chunks=True)
    hits = search(corpus, query, o)
    f = parent_folder(F.col("path"))
    near = hits.where(F.col("path") != note_path).withColumn("folder", f).where("folder != '' and not startswith(folder, '00-Inbox')")
    near = near.groupBy("folder").agg(F.min_by("score", "pos").alias("score"), F.min("pos").cast("int").alias("pos"))
    if folders is None:
        return near
    rest = folders.select("folder").distinct().join(near, "folder", "left_anti").select("folder", F.lit(0.0).cast("float").alias("score"), F.lit(None).cast("int").alias("pos"))
    return near.unionByName(rest)


def chunk_lists(hits: DataFrame, most: int = 3) -> DataFrame:
    """For display: hits under their notes."""
    return stages.per_note_display(hits, most)


#: Fields of a hit that a result has; fields without a value are left out of its JSON.
HIT = ("chunk_id", "path", "heading", "score", "relevance", "rrf", "cosine", "bm25", "rerank", "snippet", "body", "created", "source", "siblings")


def as_json(hits: DataFrame) -> DataFrame:
    """(query_id, hits): one JSON array per query, in order; ranks stay internal. A list is at most the limit long."""
    one = F.struct("pos", F.struct(*[c for c in HIT if c in hits.columns]).alias("hit"))
    return hits.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["hit"])).alias("hits"))


def as_text(hits: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, text): for people: notes in the order of their first hit, each with up to ``most`` hits under it and how many more there are."""
    d = chunk_lists(hits, most)
    percent = numbers.percent(F.col("score"), F.max("score").over(stages.per_query())).cast("int").cast("string")
    head = F.when(F.col("n_in_note") == 1, F.concat(F.col("path"), F.lit(" ("), percent, F.lit("%)\n")))
    line = F.concat(F.lit("  "), F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.col("heading"), F.lit(": "))).otherwise(""), F.coalesce("snippet", F.lit("")))
    rest = F.when((F.col("n_in_note") == most) & (F.col("more") > 0), F.concat(F.lit("\n  and "), F.col("more").cast("string"), F.lit(" more")))
    one = F.struct("note_pos", "n_in_note", F.concat(F.coalesce(head, F.lit("")), line, F.coalesce(rest, F.lit(""))).alias("line"))
    return d.withColumn("one", one).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["line"]), "\n").alias("text"))


def run(store: Store, queries: DataFrame, o: Options, embedder: Embedder, reranker: Reranker | None = None, variants: Callable[[DataFrame], DataFrame] | None = None, refresh: Callable[[], object] | None = None, form: str = "json") -> tuple[DataFrame, dict]:
    """The whole way of a search: bring the store up to date if asked to, search, give the hits as JSON or text per query.

    A refresh that fails doesn't stop the search, which then reads the last state; what happened is told beside the hits.
    """
    o.check()
    if form not in ("json", "text"):
        raise ValueError("form is json or text")
    told: dict = {"refreshed": None, "smart": None}
    if refresh is not None:
        try:
            refresh()
            told["refreshed"] = True
        except Exception as e:  # noqa: BLE001 - an older state is better than no answer
            told["refreshed"] = f"{type(e).__name__}: {str(e)[:200]}"
    corpus = Corpus.kept(store)
    q = queries if o.mode == "bm25" else embedded_queries(queries, embedder)
    if o.smart:
        hits, told["smart"] = smart_or_plain(corpus, q, lambda: variants(q), replace(o, smart=False), reranker)
    else:
        hits = search(corpus, q, o, reranker)
    return (as_json if form == "json" else as_text)(hits), told


def with_event_ids(hits: DataFrame, run: dict) -> DataFrame:
    """Hits with final_rank, rerank_scored and the id that binds their ranks to the run."""
    from ..operators.provenance import event_ids

    d = hits.withColumns({"final_rank": F.col("pos"), "rerank_scored": F.col("rerank_rank").isNotNull()})
    ranks = F.struct("fusion_rank", "bm25_rank", "cosine_rank", "rerank_rank", "final_rank", F.col("rerank_scored").cast("int").alias("rerank_scored"))
    return d.withColumn("event_id", event_ids(F.lit(run["pipeline_id"]), F.lit(run["corpus_sha256"]), "path", F.lit(run["returned"]), F.lit(run["scope_elided"]), ranks))


def embedded_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """queries (query_id, query) with embedding: the query as the model wants queries, not documents."""
    return queries.withColumn("embedding", embed_column(embedder, QUERY_PREFIX)(F.col("query")))


def smart_or_plain(corpus: Corpus, queries: DataFrame, variants: Callable[[], DataFrame], o: Options, reranker: Reranker) -> tuple[DataFrame, str | None]:
    """The smart search's hits, or, where its models fail, the plain reranked search's and what went wrong.

    Models run inside the plan, so the smart search is carried out here and its hits, at most limit per query, are
    written; only then is it known to have worked.
    """
    try:
        return written(smart_search(corpus, queries, variants(), o, reranker), "smart-hits"), None
    except ValueError:
        raise  # options that contradict each other are the caller's
    except Exception as e:  # noqa: BLE001 - whatever an optional model does, the plain search answers
        return search(corpus, queries, replace(o, smart=False, rerank=True), reranker), f"{type(e).__name__}: {str(e)[:200]}"


def with_provenance(corpus: Corpus, queries: DataFrame, o: Options, reranker: Reranker, run: dict) -> tuple[DataFrame, dict]:
    """The hits of one query with the ids that bind their ranks, and the run's identity; ValueError where the index changed meanwhile.

    run has what the caller knows of the identity (models, versions, fingerprints); counts and limits are filled in.
    """
    from ..operators.provenance import pipeline_id, run_checks, scope_policy

    replace(o, tick_provenance=True).check()
    before = corpus.state()
    hits = written(search(corpus, queries, o, reranker), "hits")
    n = hits.count()
    pool = written(retrieved(corpus, queries, o), "pool").count()
    cut = search(corpus, queries, replace(o, exclude=()), reranker).count() - n if o.exclude else 0
    if corpus.state() != before:
        raise ValueError("the index changed during the search")
    full = {**run, "limit": o.limit, "source_limit": o.depth, "fusion_limit": o.pool, "candidate_pool": pool, "rerank_cap": min(stages.rerank_cap(o.limit, o.pool, False), pool), "returned": n, "scope_elided": cut, "scope_policy": scope_policy(list(o.exclude)), "full_body": True, "note_level": True, "metadata_filters": False, "exact_requested": True, "cwd_scope": bool(o.exclude)}
    full["pipeline_id"] = pipeline_id(full)
    for name, ok in run_checks(full):
        if not ok:
            raise ValueError(f"check failed: {name}")
    return with_event_ids(hits, full), full
