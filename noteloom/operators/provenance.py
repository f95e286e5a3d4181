"""Identities and checks of search runs and of the hits that were presented.

The checks are a list of named conditions, so that they can run on one payload on the driver and, as boolean columns,
on a table of events.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST_EVENTS, MOST_LIMIT, SCHEMA_VERSION = 100, 1_000, 1
#: The fields of a run's identity, in the order in which they are hashed.
IDENTITY = (
    "schema_version", "binary_version", "binary_sha256", "indexed_files", "indexed_chunks", "embedded_chunks", "embed_model", "embed_dims", "chunk_version", "tantivy_version", "fusion_policy",
    "fusion_candidate_pool", "vector_backend", "exact_requested", "automatic_exact_cutoff", "rerank_model", "rerank_policy", "relevance_policy", "source_limit", "fusion_limit", "candidate_pool", "rerank_cap",
    "limit", "full_body", "note_level", "metadata_filters", "cwd_scope", "scope_policy", "index_refresh_requested", "index_refresh_succeeded", "result_policy",
)
_NAMES = ("binary_version", "embed_model", "chunk_version", "tantivy_version", "fusion_policy", "fusion_candidate_pool", "vector_backend", "rerank_model", "rerank_policy", "relevance_policy", "result_policy")
_SHA = re.compile("[0-9a-f]{64}")


def _text(v: object) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def pipeline_id(run: dict) -> str:
    """The hash of the identity fields, each with its length in bytes before it."""
    return hashlib.sha256("".join(f"{len(_text(run[k]).encode())}:{_text(run[k])}|" for k in IDENTITY).encode()).hexdigest()


def pipeline_id_column(columns: dict[str, Column]) -> Column:
    """The same over columns."""
    parts = [F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"), F.lit("|")) for c in (columns[k] for k in IDENTITY)]
    return F.sha2(F.concat(*parts), 256)


def event_id(pipeline: str, corpus: str, path: str, returned: int, elided: int, ranks: dict) -> str:
    """The hash that binds a hit's ranks to its run, corpus and path: lengths and numbers as little-endian 64-bit words."""
    out = b"".join(struct.pack("<Q", len(s.encode())) + s.encode() for s in (pipeline, corpus, path))
    out += struct.pack("<4Q", returned, elided, ranks["fusion_rank"], ranks["final_rank"])
    for k in ("bm25_rank", "cosine_rank", "rerank_rank"):
        v = ranks.get(k)
        out += b"\0" if v is None else b"\1" + struct.pack("<Q", v)
    return hashlib.sha256(out + (b"\1" if ranks["rerank_scored"] else b"\0")).hexdigest()


@F.pandas_udf(StringType())
def event_ids(pipeline: pd.Series, corpus: pd.Series, path: pd.Series, returned: pd.Series, elided: pd.Series, ranks: pd.DataFrame) -> pd.Series:
    rows = ranks.astype(object).where(ranks.notna(), None).to_dict("records")
    for r in rows:
        for k, v in r.items():
            r[k] = None if v is None else int(v)
    return pd.Series([event_id(*x) for x in zip(pipeline, corpus, path, map(int, returned), map(int, elided), rows, strict=True)], index=path.index)


def run_checks(r: dict) -> list[tuple[str, bool]]:
    sha = lambda k: bool(_SHA.fullmatch(str(r.get(k))))
    fusion, limit = r["fusion_limit"], r["limit"]
    return [
        ("schema_version", r["schema_version"] == SCHEMA_VERSION),
        ("pipeline_id", sha("pipeline_id") and r["pipeline_id"] == pipeline_id(r)),
        *[(k, sha(k)) for k in ("binary_sha256", "corpus_sha256", "scope_policy")],
        *[(k, 1 <= len(str(r[k]).encode()) <= 256) for k in _NAMES],
        ("embedded_chunks", r["embedded_chunks"] <= r["indexed_chunks"]),
        ("limit", 1 <= limit <= MOST_LIMIT),
        ("fusion_limit", fusion == max(4 * limit, 30)),
        ("source_limit", r["source_limit"] == max(3 * fusion, 30)),
        ("candidate_pool", r["candidate_pool"] <= min(fusion, r["indexed_chunks"])),
        ("rerank_cap", r["rerank_cap"] == min(max(2 * limit, 16), r["candidate_pool"])),
        ("returned", r["returned"] <= min(limit, r["candidate_pool"])),
        ("full_note_level", bool(r["full_body"]) and bool(r["note_level"]) and not r["metadata_filters"] and bool(r["exact_requested"])),
    ]


def rank_checks(run: dict, e: dict) -> list[tuple[str, bool]]:
    cap, inside = run["rerank_cap"], lambda v, n: v is None or 1 <= v <= n
    scored, rank = bool(e["rerank_scored"]), e.get("rerank_rank")
    return [
        ("fusion_rank", e["fusion_rank"] is not None and inside(e["fusion_rank"], run["candidate_pool"])),
        ("bm25_rank", inside(e.get("bm25_rank"), run["source_limit"])),
        ("cosine_rank", inside(e.get("cosine_rank"), run["source_limit"])),
        ("final_rank", e["final_rank"] is not None and inside(e["final_rank"], run["returned"])),
        ("rerank_rank", (e["fusion_rank"] <= cap and rank is not None and 1 <= rank <= cap) if scored else (e["fusion_rank"] > cap and rank is None)),
    ]


def check_batch(batch: dict) -> None:
    """ValueError with the name of the first condition that fails."""
    run, events = batch["run"], batch["events"]
    checks = run_checks(run) + [("event_count", 1 <= len(events) <= min(MOST_EVENTS, run["returned"]))]
    for e in events:
        p = e["provenance"]
        checks += rank_checks(run, p)
        checks.append(("event_id", p["event_id"] == event_id(run["pipeline_id"], run["corpus_sha256"], e["path"], run["returned"], run["scope_elided"], p)))
    for k in ("path", "fusion_rank", "bm25_rank", "cosine_rank", "rerank_rank", "final_rank"):
        v = [x for e in events if (x := e["path"] if k == "path" else e["provenance"].get(k)) is not None]
        checks.append((f"different {k}", len(set(v)) == len(v)))
    for name, ok in checks:
        if not ok:
            raise ValueError(f"check failed: {name}")


def event_problems(events: DataFrame) -> DataFrame:
    """Events with a problem array: what a table can check by itself (nulls, signs, scored against unscored, repeats in a run)."""
    from pyspark.sql import Window

    e = events.distinct()
    bad = [
        (F.col("fusion_rank").isNull() | (F.col("fusion_rank") < 1), "fusion_rank"),
        (F.col("final_rank").isNull() | (F.col("final_rank") < 1), "final_rank"),
        (F.least("bm25_rank", "cosine_rank", "rerank_rank") < 1, "rank below 1"),
        ((F.col("rerank_scored") == 1) & F.col("rerank_rank").isNull(), "scored without rank"),
        ((F.col("rerank_scored") == 0) & F.col("rerank_rank").isNotNull(), "rank without score"),
        (F.count(F.lit(1)).over(Window.partitionBy("run_id", "path")) > 1, "path repeated"),
        (F.count("final_rank").over(Window.partitionBy("run_id", "final_rank")) > 1, "final_rank repeated"),
    ]
    p = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in bad]), lambda x: x.isNotNull())
    return e.withColumn("problems", p).where(F.size("problems") > 0)


def scope_policy(words: list[str]) -> str:
    """The hash of the sorted words, each with a zero byte after it."""
    return hashlib.sha256(b"".join(w.encode() + b"\0" for w in sorted(words))).hexdigest()


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """(corpus_sha256): the hash over paths and content hashes in the order of the paths; mtimes have no part.

    One number for a whole corpus needs the whole list in order: about a hundred bytes per note in one task. For
    very large corpora use fingerprint_tree, which hashes parts in parallel and then the parts' hashes.
    """
    parts = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    text = F.array_join(F.transform(parts, lambda x: F.concat(x["path"], F.lit("\0"), x["sha256"], F.lit("\n"))), "")
    return files.select("path", "sha256").where("path is not null and sha256 is not null").distinct().agg(F.sha2(text, 256).alias("corpus_sha256"))


def fingerprint_tree(files: DataFrame, parts: int = 256) -> DataFrame:
    """(corpus_tree_sha256): as corpus_fingerprint, of 256 parts by the path's hash, so no task holds the whole list."""
    d = files.select("path", "sha256").where("path is not null and sha256 is not null").distinct()
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit("\0"), x["sha256"], F.lit("\n"))), "")
    leaf = d.groupBy(F.conv(F.substring(F.sha2("path", 256), 1, 8), 16, 10).cast("long").alias("h"), "path", "sha256").agg(F.lit(1)).groupBy(F.pmod("h", F.lit(parts)).alias("part")).agg(F.sha2(one, 256).alias("s"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "s"))), lambda x: F.concat(x["part"].cast("string"), F.lit(":"), x["s"], F.lit("\n"))), "")
    return leaf.agg(F.sha2(top, 256).alias("corpus_tree_sha256"))
