"""Reciprocal rank fusion of ranked lists, per query.

Terms are single-precision 1 / (60 + rank), as scores are defined. Two lists are added as exactly two numbers after a
full outer join; of more lists the terms are added in the order of the lists, since the sum of floats depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = 60


def term(rank: Column) -> Column:
    return (F.lit(1.0) / (F.lit(float(C)) + rank)).cast("float")


def numbered(scored: DataFrame, score: str, out: str, query: str = "query_id", key: str = "id") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn(out, F.row_number().over(w))


def hybrid(lexical: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, bm25, bm25_rank, cosine, cosine_rank, rrf, fusion_rank) of the union of both lists."""
    a = lexical.select("query_id", "id", F.col("score").alias("bm25"), F.col("rank").alias("bm25_rank"))
    b = semantic.select("query_id", "id", F.col("score").alias("cosine"), F.col("rank").alias("cosine_rank"))
    zero = F.lit(0.0).cast("float")
    rrf = F.coalesce(term(F.col("bm25_rank")), zero) + F.coalesce(term(F.col("cosine_rank")), zero)
    both = a.join(b, ["query_id", "id"], "full_outer").withColumn("rrf", rrf)
    return numbered(both, "rrf", "fusion_rank").where(F.col("fusion_rank") <= limit)


def fused(lists: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, rrf, fusion_rank) of any number of lists: rows (query_id, list_no, id, rank)."""
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("list_no", term(F.col("rank")).alias("t")))), F.lit(0.0).cast("float"), lambda s, x: (s + x["t"]).cast("float"))
    return numbered(lists.groupBy("query_id", "id").agg(total.alias("rrf")), "rrf", "fusion_rank").where(F.col("fusion_rank") <= limit)
