"""Whether a candidate ranking may replace a baseline: twelve named checks on two evaluation reports.

Reports are small (one entry per judged query) and come as dictionaries, as their readers give them. The bootstrap
draws with a fixed generator, so the same reports give the same answer everywhere.
"""

from __future__ import annotations

import math
from collections import defaultdict

#: What is required, and how much may be lost.
K, LEAST_QUERIES, LEAST_COHORTS, LEAST_PER_COHORT = 10, 20, 4, 3
GAIN, MRR_LOSS, PRECISION_LOSS, COHORT_LOSS = 0.01, 0.005, 0.005, 0.01
SAMPLES, QUANTILE, EPS, SCHEMA = 10_000, 0.025, 1e-12, 1
_MASK = (1 << 64) - 1


def _xorshift(seed: int):
    """The 64-bit generator with shifts 13, 7 and 17."""
    x = max(seed, 1)
    while True:
        x ^= (x << 13) & _MASK
        x ^= x >> 7
        x ^= (x << 17) & _MASK
        yield x


def lower_bound(differences: list[float], labels_sha256: str) -> float | None:
    """The 2.5 percent quantile of the means of 10,000 resamples, seeded by the labels' hash."""
    n = len(differences)
    if not n or not all(map(math.isfinite, differences)) or len(labels_sha256) < 16:
        return None
    draw = _xorshift(int(labels_sha256[:16], 16))
    means = []
    for _ in range(SAMPLES):
        total = 0.0
        for _ in range(n):
            total += differences[next(draw) % n]
        means.append(total / n)
    return sorted(means)[int(SAMPLES * QUANTILE)]


def _mean(v: list) -> float | None:
    return sum(v) / len(v) if v and None not in v else None


def comparable(a: dict, b: dict) -> None:
    """ValueError unless both reports are of the same labels, index, queries and, but for the fusion, configuration."""
    if a["schema_version"] != SCHEMA or b["schema_version"] != SCHEMA:
        raise ValueError("reports have another schema")
    for k in ("labels_sha256", "index"):
        if a["provenance"][k] != b["provenance"][k]:
            raise ValueError(f"reports differ in {k}")
    rest = lambda r: {k: v for k, v in r["config"].items() if k not in ("fusion_policy", "score_kind")}
    if rest(a) != rest(b):
        raise ValueError("reports differ in more than the fusion")
    who = lambda r: [(q["query"], q["cohort"], q["is_negative"]) for q in r["queries"]]
    if who(a) != who(b):
        raise ValueError("reports have different queries")


def compare(a: dict, b: dict) -> dict:
    """The checks with their outcome, the metrics, and accepted."""
    comparable(a, b)
    pairs = [(x, y) for x, y in zip(a["queries"], b["queries"], strict=True) if not x["is_negative"]]
    delta, means = {}, {}
    for name in ("ndcg_at_k", "reciprocal_rank_at_k", "precision_at_k", "recall_at_k"):
        means[name] = (_mean([x[name] for x, _ in pairs]), _mean([y[name] for _, y in pairs]))
        delta[name] = None if None in means[name] else means[name][1] - means[name][0]
    graded = all(x["ndcg_at_k"] is not None and y["ndcg_at_k"] is not None for x, y in pairs)
    boot = lower_bound([y["ndcg_at_k"] - x["ndcg_at_k"] for x, y in pairs], a["provenance"]["labels_sha256"]) if graded else None
    cohorts: dict[str, list[float]] = defaultdict(list)
    for x, y in pairs:
        if x["cohort"] is not None and x["ndcg_at_k"] is not None and y["ndcg_at_k"] is not None:
            cohorts[x["cohort"]].append(y["ndcg_at_k"] - x["ndcg_at_k"])
    worst = min((sum(v) / len(v) for v in cohorts.values()), default=None)
    c, policy = a["config"], lambda r: r["config"]["fusion_policy"]
    least = lambda v, bound: v is not None and v + EPS >= bound
    fixed = c["k"] == K and c["mode"] == "hybrid" and not c["rerank"] and c["exact_requested"] and c["vector_backend"] == "exact" and c["fusion_candidate_pool"] == "bm25_cosine_union" and not c["adaptive_cutoff"]
    checks = {
        "fixed_exact_hybrid_config": bool(fixed),
        "baseline_is_rrf_k60": policy(a) == "rrf_k60",
        "candidate_is_distinct_fusion_policy": policy(a) != policy(b),
        "held_out_sample_size": len(pairs) >= LEAST_QUERIES,
        "graded_diverse_cohorts": sum(map(len, cohorts.values())) == len(pairs) and len(cohorts) >= LEAST_COHORTS and all(len(v) >= LEAST_PER_COHORT for v in cohorts.values()),
        "mean_ndcg_gain": least(delta["ndcg_at_k"], GAIN),
        "paired_ndcg_bootstrap": boot is not None and boot > 0,
        "no_mean_recall_loss": least(delta["recall_at_k"], 0),
        "no_per_query_recall_loss": all(None not in (x["recall_at_k"], y["recall_at_k"]) and y["recall_at_k"] - x["recall_at_k"] >= -EPS for x, y in pairs),
        "bounded_mrr_loss": least(delta["reciprocal_rank_at_k"], -MRR_LOSS),
        "bounded_precision_loss": least(delta["precision_at_k"], -PRECISION_LOSS),
        "bounded_cohort_ndcg_loss": least(worst, -COHORT_LOSS),
    }
    return {"accepted": all(checks.values()), "checks": checks, "means": means, "bootstrap_lower": boot, "worst_cohort": worst, "cohorts": {k: len(v) for k, v in sorted(cohorts.items())}}
