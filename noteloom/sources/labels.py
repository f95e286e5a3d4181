"""Judgments (one JSON object per line) and evaluation reports, read strictly. Both are small files of people and tools."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

QRELS = "query_id string, path string, grade int"
QUERIES = "query_id string, query string, cohort string, graded boolean"


def _path(p: object) -> str:
    if not isinstance(p, str) or not p.endswith(".md") or p.startswith("/") or any(x in ("", ".", "..") for x in p.split("/")) or p.split("/")[-1] == ".md":
        raise ValueError(f"not a relative .md path: {p!r}")
    return p


def parse_line(line: str) -> dict:
    """query, cohort, judged (path -> grade) and graded of one line."""
    raw = json.loads(line)
    if not isinstance(raw, dict) or set(raw) - {"query", "cohort", "relevant"} or not isinstance(raw.get("query"), str) or not isinstance(raw.get("relevant"), list):
        raise ValueError("a label has query, relevant and maybe cohort")
    query, cohort = raw["query"].strip(), raw.get("cohort")
    if not query:
        raise ValueError("query must not be empty")
    if cohort is not None:
        if not isinstance(cohort, str):
            raise ValueError("cohort must be text")
        cohort = cohort.strip() or None
        if cohort and not re.fullmatch("[A-Za-z0-9_-]{1,64}", cohort):
            raise ValueError("cohort must be 1 to 64 letters, digits, - or _")
    judged: dict[str, int] = {}
    explicit = False
    for e in raw["relevant"]:
        grade = 1
        if isinstance(e, dict):
            if set(e) != {"path", "grade"} or type(e["grade"]) is not int:
                raise ValueError("a graded path has path and grade")
            e, grade, explicit = e["path"], e["grade"], True
        if _path(e) in judged:
            raise ValueError(f"path twice: {e!r}")
        if not 0 <= grade <= 3:
            raise ValueError(f"grade out of 0 to 3: {grade}")
        judged[e] = grade
    return {"query": query, "cohort": cohort, "judged": judged, "graded": explicit and any(judged.values())}


def parse(content: str) -> list[dict]:
    """All lines; blank ones are left out, errors name the line, no query may come twice and there must be one."""
    out: list[dict] = []
    for n, line in enumerate(content.splitlines(), 1):
        if not line.strip():
            continue
        try:
            label = parse_line(line)
        except ValueError as e:
            raise ValueError(f"labels line {n}: {e}") from e
        if any(label["query"] == o["query"] for o in out):
            raise ValueError(f"labels line {n}: query twice")
        out.append(label)
    if not out:
        raise ValueError("no labels")
    return out


def tables(spark: SparkSession, content: str) -> tuple[DataFrame, DataFrame, str]:
    """Queries, judgments and the labels' hash."""
    labels = parse(content)
    q = spark.createDataFrame([(str(i), x["query"], x["cohort"], x["graded"]) for i, x in enumerate(labels)], QUERIES)
    r = spark.createDataFrame([(str(i), p, g) for i, x in enumerate(labels) for p, g in x["judged"].items()], QRELS)
    return q, r, hashlib.sha256(content.encode()).hexdigest()


#: What a report has, and nothing else.
REPORT = {"schema_version", "config", "provenance", "aggregate", "queries"}
QUERY = {"query", "cohort", "is_negative", "precision_at_k", "recall_at_k", "reciprocal_rank_at_k", "ndcg_at_k", "top_score", "returned", "ranked", "found", "missing"}


#: The fields of a report's parts.
CONFIG = {
    "k", "mode", "fusion_policy", "fusion_candidate_pool", "rerank", "rerank_policy", "score_floor", "exact_requested", "vector_backend", "automatic_exact_cutoff", "score_kind", "result_policy", "note_level", "adaptive_cutoff",
    "index_refresh", "cwd_scope",
}
PROVENANCE = {"version", "binary_sha256", "labels_sha256", "index"}
AGGREGATE = {
    "mean_precision_at_k", "mean_recall_at_k", "mrr_at_k", "mean_ndcg_at_k", "n_positive", "n_negative", "n_graded", "n_positive_with_top_score", "n_negative_with_top_score", "mean_top_score_positive", "mean_top_score_negative", "top_score_delta",
}


def report(content: str) -> dict:
    """A report; ValueError for unknown or missing fields, in its parts as well."""
    r = json.loads(content)
    if not isinstance(r, dict) or set(r) != REPORT:
        raise ValueError(f"a report has the fields {sorted(REPORT)}")
    for part, fields in (("config", CONFIG), ("provenance", PROVENANCE), ("aggregate", AGGREGATE)):
        if not isinstance(r[part], dict) or set(r[part]) != fields:
            raise ValueError(f"{part} has unknown or missing fields: {sorted(set(r[part]) ^ fields) if isinstance(r[part], dict) else part}")
    for q in r["queries"]:
        if set(q) - QUERY or not {"query", "is_negative"} <= set(q):
            raise ValueError("a query's report has unknown or missing fields")
        for k in QUERY - set(q):
            q[k] = None
    return r
