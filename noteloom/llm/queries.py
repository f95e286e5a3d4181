"""The queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import fusion, leakage, markup, mixing, mojibake, neardup, neighbours, splitting

WIDTH = 64
SCORES = ("bm25", "cosine", "rrf")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.found(table(spark, d, "chunks", True), "id", "embedding", WIDTH)


def p1_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar vectors of every vector whose id is divisible by 20, against all vectors."""
    e = table(spark, d, "embeddings")
    got = neighbours.search(e, "vec_id", "embedding", WIDTH, e.where("vec_id % 20 = 0"), 10)
    return got.select("vec_id", "neighbour", F.round("cos", 5).alias("cos"))


def p1_exact(spark: SparkSession, d: str) -> DataFrame:
    """All vectors against all by the same block products in one cell that is cut into block pairs: no loss, for tables that can bear it."""
    return neighbours.join(table(spark, d, "embeddings"), "vec_id", "embedding", WIDTH, 10, 0.2, exact=True).select("vec_id", "neighbour", F.round("cos", 5).alias("cos"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.best_by_all(table(spark, d, "scored"), "run_id", "id", SCORES)


def p2_fused(spark: SparkSession, d: str) -> DataFrame:
    got = fusion.fuse(table(spark, d, "scored"), "run_id", "id", SCORES)
    return got.select("run_id", "id", *[f"{s}_pos" for s in SCORES], F.round("fused", 9).alias("fused"), "place")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.residue(table(spark, d, "chunks", True), "id", ["body", "heading_path"])


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", True).select("id", "body", "heading_path").dropDuplicates(["id"])
    return markup.clean(c, ["body", "heading_path"]).select("id", "body_clean", "heading_path_clean")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the cleaned texts: no construct is left outside fenced blocks, and these and the formulas are as they were."""
    c = table(spark, d, "chunks", True).where("id is not null and body is not null").select("id", "body", "heading_path").dropDuplicates(["id"])
    return markup.kept(c, "id", ["body", "heading_path"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "chunks", True), "id", "body")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks", True).select("id", "path", "ord", "heading_path", "body").dropDuplicates(["id"])
    return splitting.split(c, "body").select("id", "path", "ord", "heading_path", "piece_no", "piece", "overlap_chars")


def p5_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: the pieces' own parts, put together again."""
    c = table(spark, d, "chunks", True).select("id", "body").dropDuplicates(["id"])
    own = F.array_sort(F.collect_list(F.struct("piece_no", "piece_own")))
    whole = F.array_join(F.transform(own, lambda x: x["piece_own"]), "")
    got = splitting.split(c, "body").groupBy("id").agg(whole.alias("t"))
    return got.select("id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of all pieces: the limit, the order, the overlaps, the whole text, and whole fenced blocks."""
    c = table(spark, d, "chunks", True).where("id is not null").select("id", "body").dropDuplicates(["id"])
    return splitting.kept(c, "id", "body")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "chunks", True))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Five words and a similarity of 0.8: every chunk with a copy, its group and its number of partners."""
    return neardup.grouped(table(spark, d, "chunks", True).where("kind = 0"), "id", "body")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents", True), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents", True), table(spark, d, "mix_targets")).select(F.col("doc").alias("doc_id"), "src", "tokens", "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents", True), t), t)


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mix: shares, caps, and which sources have documents."""
    t = table(spark, d, "mix_targets")
    return mixing.kept(mixing.mix(table(spark, d, "documents", True), t), t)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents", True), "doc_id", "text").select("doc_id", "lossy")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents", True), "doc_id", "text").select("doc_id", "restored", "lossy")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_knn, p1_exact, p2_found, p2_fused, p3_found, p3_cleaned, p3_kept, p5_found, p5_pieces, p5_rejoined, p5_kept, p7_found, p7_groups, p8_found, p9_mix, p9_shares, p9_kept, p10_found, p10_restored)}


_SCORED = """
s0 AS (SELECT run_id, id, max(CASE WHEN isfinite(bm25) THEN bm25 END)::DOUBLE AS bm25, max(CASE WHEN isfinite(cosine) THEN cosine END)::DOUBLE AS cosine,
              max(CASE WHEN isfinite(rrf) THEN rrf END)::DOUBLE AS rrf FROM scored WHERE run_id IS NOT NULL AND id IS NOT NULL GROUP BY run_id, id),
s1 AS (SELECT run_id, id, count(*) OVER (PARTITION BY run_id) AS n,
              CASE WHEN bm25 IS NOT NULL THEN rank() OVER (PARTITION BY run_id ORDER BY bm25 DESC NULLS LAST) END AS bm25_pos,
              CASE WHEN cosine IS NOT NULL THEN rank() OVER (PARTITION BY run_id ORDER BY cosine DESC NULLS LAST) END AS cosine_pos,
              CASE WHEN rrf IS NOT NULL THEN rank() OVER (PARTITION BY run_id ORDER BY rrf DESC NULLS LAST) END AS rrf_pos FROM s0)
"""

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_FENCE = r"(?ms)^```[^\n]*\n(?:.*?\n)??```[ \t\r]*$"


#: Its own short grammar, without looking around: what stands before and after a mark is matched with it.
_P3 = r"""
WITH c AS (SELECT DISTINCT id, unnest([body, heading_path]) AS t FROM chunks WHERE id IS NOT NULL),
f AS (SELECT id, regexp_replace(t, '(?ms)^```[^\n]*\n(?:.*?\n)??```[ \t\r]*$', chr(10), 'g') AS r FROM c WHERE t IS NOT NULL),
g AS (SELECT *, regexp_replace(r, '(?s)\$\$.*?\$\$|\$[^\s$](?:[^$\n]*?[^\s\\$])?\$', ' ', 'g') AS m FROM f),
p AS (SELECT *, unnest(regexp_split_to_array(r, '\n[ \t\r]*\n')) AS w FROM g), pm AS (SELECT *, unnest(regexp_split_to_array(regexp_replace(m, '([\p{L}\p{N}])_([\p{L}\p{N}])', '\1\2', 'g'), '\n[ \t\r]*\n')) AS w FROM g),
x AS (SELECT id, 'html' AS markup FROM f WHERE regexp_matches(r, '(?s)<!--.*?-->|&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});') OR regexp_matches(r, '(?i)</?(?:a|abbr|b|blockquote|br|center|cite|code|dd|del|div|dl|dt|em|font|h[1-6]|hr|i|img|ins|kbd|li|mark|ol|p|pre|s|small|span|strong|sub|sup|table|tbody|td|th|thead|tr|tt|u|ul)(?:\s+[A-Za-z-]+\s*=\s*(?:"[^"<>]*"|''[^''<>]*''|[^\s"''<>=`]+))*\s*/?>')
  UNION SELECT id, 'markdown' FROM f WHERE regexp_matches(r, '(?:^|[^\w\])])!?\[[^\[\]\n]*\]\([^()\s]*(?:\s+"[^"\n]*")?\)|(?:^|[^\w\])\[])!?\[[^\[\]\n^][^\[\]\n]*\]\[[^\[\]\n]*\]|(?m:^ {0,3}\[[^\[\]\n^][^\[\]\n]*\]:[ \t]+\S+)|<(?:https?|ftp|mailto):[^\s<>]+>|\[\^[\p{L}\p{N}_-]+\]|(?m:^[ \t]*\|?[^|\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-+:?[ \t]*\|[ \t|:\-\r]*$)')
  UNION SELECT id, 'markdown' FROM p WHERE regexp_matches(w, '(?:^|[^\p{L}\p{N}_*\\])\*{1,3}[^\s*](?:[^*]*[^\s*])?\*{1,3}(?:$|[^\p{L}\p{N}_*])|(?:^|[^A-Za-z0-9_*\\])\*{2,3}[^\s*](?:[^*\n]*[^\s*])?\*{2,3}(?:$|[^A-Za-z0-9_*])|~~[^\s~](?:[^~]*[^\s~])?~~|`[^`]+`')
  UNION SELECT id, 'markdown' FROM pm WHERE regexp_matches(w, '(?:^|[^\p{L}\p{N}_\\/.])_{1,3}[^\s_](?:[^_]*[^\s_])?_{1,3}(?:$|[^\p{L}\p{N}_.]|\.(?:$|[^A-Za-z]))')
  UNION SELECT id, 'wiki' FROM f WHERE regexp_matches(r, '\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|(?m:^[ \t]*\{\|)|(?m:^[ \t]*={2,6}[ \t]*[^=\n][^\n]*?={2,6}[ \t\r]*$)')
  UNION SELECT id, 'wiki' FROM p WHERE regexp_matches(w, '(?s)(?:^|[^\w''])''{2,5}[^\s''](?:.*?[^\s''])?''{2,5}')
  UNION SELECT id, 'latex' FROM g WHERE regexp_matches(regexp_replace(m, '(?:^|[^A-Za-z0-9])[A-Za-z]:\\[^\s]*|\\\\[A-Za-z0-9_.-]+\\[^\s]*', ' ', 'g'), '\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|\\[A-Za-z]{2,}'))
SELECT DISTINCT id, markup FROM x"""


def oracle_sql() -> dict[str, str]:
    w = _WORDS.format("body")
    return {
        "p1_found": """
            WITH c AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM chunks WHERE id IS NOT NULL AND len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true) AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
            s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.e, b.e) AS cos FROM c a, c b WHERE a.id <> b.id), n AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY cos DESC, y) AS n FROM s WHERE cos >= 0.92)
            SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM n WHERE n <= 10""",
        "p1_knn": """
            WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
            c AS (SELECT q.vec_id, a.vec_id AS neighbour, list_cosine_similarity(q.e, a.e) AS cos FROM q, a WHERE q.vec_id <> a.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, neighbour) AS n FROM c)
            SELECT vec_id, neighbour, round(cos, 5) AS cos FROM r WHERE n <= 10""",
        "p1_exact": """
            WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT q.vec_id, a.vec_id AS neighbour, list_cosine_similarity(q.e, a.e) AS cos FROM a q, a WHERE q.vec_id <> a.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, neighbour) AS n FROM c WHERE cos >= 0.2)
            SELECT vec_id, neighbour, round(cos, 5) AS cos FROM r WHERE n <= 10""",
        "p2_found": f"WITH {_SCORED} SELECT run_id, id FROM s1 WHERE bm25_pos <= ceil(n / 10.0) AND cosine_pos <= ceil(n / 10.0) AND rrf_pos <= ceil(n / 10.0)",
        "p2_fused": f"""WITH {_SCORED}, s2 AS (SELECT *, 0.0::DOUBLE + coalesce(1.0::DOUBLE / (60 + bm25_pos), 0) + coalesce(1.0::DOUBLE / (60 + cosine_pos), 0) + coalesce(1.0::DOUBLE / (60 + rrf_pos), 0) AS f FROM s1)
            SELECT run_id, id, bm25_pos, cosine_pos, rrf_pos, round(f, 9) AS fused, row_number() OVER (PARTITION BY run_id ORDER BY f DESC, id) AS place FROM s2""",
        "p3_found": _P3,
        "p3_kept": "SELECT DISTINCT id, true AS clean, true AS blocks_kept, true AS formulas_kept FROM chunks WHERE id IS NOT NULL AND body IS NOT NULL",
        "p5_found": f"""
            WITH c AS (SELECT DISTINCT id, body FROM chunks WHERE id IS NOT NULL AND length(body) > 3150),
            f AS (SELECT id, list_max(list_transform(regexp_extract_all(body, '{_FENCE}'), lambda x: length(x))) AS longest,
                         list_max(list_transform(regexp_split_to_array(regexp_replace(body, '{_FENCE}', chr(10), 'g'), '\\s+'), lambda x: length(x))) AS run FROM c)
            SELECT id, CASE WHEN longest > 3150 THEN 'fence' WHEN run > 3150 THEN 'run' ELSE 'plain' END AS cut FROM f""",
        "p5_rejoined": "SELECT id, length(body) AS n_chars, md5(body) AS digest FROM (SELECT DISTINCT id, body FROM chunks) WHERE trim(body) <> ''",
        "p5_kept": f"""
            SELECT id, length(body) AS n_chars, len(list_filter(regexp_extract_all(body, '{_FENCE}'), lambda x: length(x) <= 3150)) AS n_fences, true AS within, true AS in_order, true AS overlaps_fit
            FROM (SELECT DISTINCT id, body FROM chunks WHERE id IS NOT NULL) WHERE trim(body) <> ''""",
        "p7_found": f"""
            WITH c AS (SELECT id, any_value(path) AS path, any_value({w}) AS w FROM chunks WHERE kind = 0 AND id IS NOT NULL GROUP BY id),
            s AS (SELECT DISTINCT id, path, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM c, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 45),
            n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
            b AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS k FROM s x JOIN s y ON x.t = y.t AND x.id < y.id AND x.path <> y.path GROUP BY 1, 2)
            SELECT id_a, id_b FROM b JOIN n p ON p.id = id_a JOIN n q ON q.id = id_b WHERE k >= 0.6 * (p.n + q.n - k) - 1e-9""",
        "p7_groups": f"""
            WITH RECURSIVE c AS (SELECT id, any_value({w}) AS w FROM chunks WHERE kind = 0 AND id IS NOT NULL GROUP BY id),
            s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS t FROM c, unnest(range(1, len(w) - 3)) AS u(i)), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
            b AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.t = y.t AND x.id <> y.id GROUP BY 1, 2), e AS (SELECT a, b FROM b JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE k >= 0.8 * (p.n + q.n - k) - 1e-9),
            r AS (SELECT a AS id, a AS z FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.z = e.a), g AS (SELECT id, min(z) AS group_id FROM r GROUP BY id)
            SELECT id, group_id, (SELECT count(*) FROM e WHERE e.a = g.id) AS links FROM g""",
        "p8_found": f"""
            WITH d AS (SELECT doc_id AS i, {_WORDS.format("text")} AS w FROM documents), e AS (SELECT item_id AS i, {_WORDS.format("text")} AS w FROM eval_items),
            dg AS (SELECT DISTINCT i, array_to_string(w[k:k + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS u(k)),
            eg AS (SELECT DISTINCT i, array_to_string(w[k:k + 11], ' ') AS g FROM e, unnest(range(1, len(w) - 10)) AS u(k))
            SELECT DISTINCT dg.i AS doc_id, eg.i AS item_id FROM dg JOIN eg USING (g)""",
        "p9_kept": """
            WITH d AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[_\\s]+', '-', 'g') AS src FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND text <> '')
            SELECT src_name, regexp_replace(lower(trim(src_name)), '[_\\s]+', '-', 'g') IN (SELECT src FROM d) AS given, true AS share_met, true AS cap_kept FROM mix_targets""",
    }
