"""Retrieval quality against judgments, for all queries at once.

ranking has (query_id, path, rank); qrels has (query_id, path, grade), where a grade of 0 is judged and not relevant.
A query with no relevant path is a negative: its metrics are null and its share in no mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade.cast("double")) - 1) / F.log2(rank.cast("double") + 1)


def per_query(queries: DataFrame, ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row per query: precision (over k), recall, reciprocal rank and nDCG at k, found and missing paths, top score.

    queries has query_id and cohort, and says with graded whether nDCG is wanted (true when it has no such column);
    ranking may have a score. A path that is ranked twice counts at its first rank.
    """
    if not 1 <= k <= 1000:
        raise ValueError("k must be within 1 and 1000")
    q = queries.select("query_id", *[c for c in ("cohort", "graded") if c in queries.columns]).dropDuplicates(["query_id"])
    rel = qrels.where("grade > 0 and path is not null").groupBy("query_id", "path").agg(F.max("grade").alias("grade"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "path")
    ideal = rel.withColumn("r", F.row_number().over(w)).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_relevant"), F.sum(F.when(F.col("r") <= k, F.round(_gain(F.col("grade"), F.col("r")), 12))).alias("idcg"), F.array_sort(F.collect_set("path")).alias("relevant")
    )
    first = ranking.where("rank is not null").groupBy("query_id", "path").agg(F.min("rank").alias("rank"))
    hit = first.where(F.col("rank") <= k).join(rel, ["query_id", "path"])
    got = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("best"), F.sum(F.round(_gain(F.col("grade"), F.col("rank")), 12)).alias("dcg"), F.array_sort(F.collect_set("path")).alias("found"))
    lists = ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"), *([F.min_by("score", "rank").alias("top_score")] if "score" in ranking.columns else [F.lit(None).cast("double").alias("top_score")]))
    d = q.join(ideal, "query_id", "left").join(got, "query_id", "left").join(lists, "query_id", "left")
    neg = F.col("n_relevant").isNull()
    graded = F.coalesce(F.col("graded"), F.lit(False)) if "graded" in q.columns else F.lit(True)
    none = F.expr("cast(array() as array<string>)")
    return d.select(
        "query_id", *(["cohort"] if "cohort" in q.columns else []), neg.alias("is_negative"),
        F.when(~neg, F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision_at_k"),
        F.when(~neg, F.coalesce("hits", F.lit(0)) / F.col("n_relevant").cast("double")).alias("recall_at_k"),
        F.when(~neg, F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("reciprocal_rank_at_k"),
        F.when(~neg & graded, F.when(F.col("idcg") > 0, F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0))).otherwise(0.0)).alias("ndcg_at_k"),
        "top_score", F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("found", none).alias("found"), F.array_except(F.coalesce("relevant", none), F.coalesce("found", none)).alias("missing"),
    )


def aggregate(reports: DataFrame) -> DataFrame:
    """One row of means. Means of top scores only when every member has one; nDCG over graded queries only."""
    pos, neg = ~F.col("is_negative"), F.col("is_negative")
    full = lambda side: F.when(F.count_if(side) == F.count(F.when(side, F.col("top_score"))), F.avg(F.when(side, F.col("top_score").cast("double"))))
    p, n = full(pos), full(neg)
    return reports.agg(
        F.avg("precision_at_k").alias("mean_precision_at_k"), F.avg("recall_at_k").alias("mean_recall_at_k"), F.avg("reciprocal_rank_at_k").alias("mrr_at_k"), F.avg("ndcg_at_k").alias("mean_ndcg_at_k"),
        F.count_if(pos).alias("n_positive"), F.count_if(neg).alias("n_negative"), F.count("ndcg_at_k").alias("n_graded"),
        F.count(F.when(pos, F.col("top_score"))).alias("n_positive_with_top_score"), F.count(F.when(neg, F.col("top_score"))).alias("n_negative_with_top_score"),
        p.alias("mean_top_score_positive"), n.alias("mean_top_score_negative"), (p - n).alias("top_score_delta"),
    )


def by_cohort(before: DataFrame, after: DataFrame) -> DataFrame:
    """(cohort, queries, ndcg_delta): means of the paired differences of positive queries."""
    b = before.where("not is_negative").select("query_id", "cohort", F.col("ndcg_at_k").alias("b"))
    a = after.where("not is_negative").select("query_id", F.col("ndcg_at_k").alias("a"))
    return b.join(a, "query_id").where("cohort is not null and a is not null and b is not null").groupBy("cohort").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("a") - F.col("b")).alias("ndcg_delta"))


def unknown_paths(qrels: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Judged paths that aren't indexed, or have no chunk; must be empty before an evaluation."""
    have = files.select("path").distinct().join(chunks.select("path").distinct(), "path", "left_semi")
    return qrels.select("path").distinct().join(have, "path", "left_anti")


def report(corpus, files: DataFrame, content: str, o, embedder=None, reranker=None, versions: dict | None = None) -> dict:
    """The report that the gate compares: searches all labels of a file's content as one batch and scores what comes.

    o are the options of the searches; o.limit is k. ValueError where options contradict each other, where a judged
    path isn't indexed or has no chunk, or where the index changed meanwhile. Reports are one entry per label, so they
    are small. versions has version and binary_sha256.
    """
    from dataclasses import replace

    from ..operators import vectors
    from ..operators.provenance import fingerprint_tree
    from ..session import written
    from ..sources import labels
    from . import search

    k = o.limit
    if not 1 <= k <= 1000:
        raise ValueError("k must be within 1 and 1000")
    if o.exact and o.mode == "bm25":
        raise ValueError("exact needs mode hybrid or vec")
    if o.smart or o.since is not None or o.source is not None or o.exclude or o.min_score is not None or o.chunks:
        raise ValueError("an evaluation is per note, without filters and floors")
    o = replace(o, full=False, exhaustive=True).check()
    spark = files.sparkSession
    asked, qrels, sha = labels.tables(spark, content)
    lost = [r.path for r in unknown_paths(qrels, files, corpus.chunks).orderBy("path").limit(5).collect()]
    if lost:
        raise ValueError(f"judged paths that aren't indexed: {lost}")
    state = corpus.state()
    print_ = lambda: {"corpus": fingerprint_tree(files).first()[0], "chunks": corpus.chunks.count()}
    before = print_()
    queries = asked if o.mode == "bm25" else search.embedded_queries(asked, embedder)
    hits = written(search.search(corpus, queries, o, reranker), "evaluated")
    score = "relevance" if o.relevance else "score"
    ranking = hits.select("query_id", "path", F.col("pos").alias("rank"), F.col(score).cast("double").alias("score"))
    per = per_query(asked, ranking, qrels, k)
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("l")).select("query_id", F.col("l.path").alias("ranked"))
    rows = per.drop("cohort").join(asked.select("query_id", "query", "cohort"), "query_id").join(lists, "query_id", "left").orderBy(F.col("query_id").cast("int")).collect()
    total = aggregate(per).first().asDict()
    if corpus.state() != state or print_() != before:
        raise ValueError("the index changed during the evaluation")
    exact = o.mode != "bm25" and (corpus.cells is None or vectors.use_exact(o.exact, corpus.stored))
    names = ("query", "cohort", "is_negative", "precision_at_k", "recall_at_k", "reciprocal_rank_at_k", "ndcg_at_k", "top_score", "returned", "found", "missing")
    return {
        "schema_version": 1,
        "config": {
            "k": k, "mode": o.mode, "fusion_policy": "rrf_k60" if o.mode == "hybrid" else "none", "fusion_candidate_pool": "bm25_cosine_union" if o.mode == "hybrid" else "single_retriever", "rerank": o.rerank,
            "rerank_policy": f"context_{o.rerank_context}" if o.rerank else "none", "score_floor": False, "exact_requested": o.exact, "vector_backend": "none" if o.mode == "bm25" else "exact" if exact else "cells",
            "automatic_exact_cutoff": vectors.EXACT_UNDER, "score_kind": score, "result_policy": "one_per_note", "note_level": True, "adaptive_cutoff": False, "index_refresh": False, "cwd_scope": False,
        },
        "provenance": {"version": "1", "binary_sha256": "", **(versions or {}), "labels_sha256": sha, "index": before},
        "aggregate": total,
        "queries": [{**{n: r[n] for n in names}, "ranked": list(r["ranked"] or [])} for r in rows],
    }
