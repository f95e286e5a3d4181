"""The queries of the core, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import timestamps
from .operators import changes
from .session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(table(spark, d, "frontmatter"), table(spark, d, "chunks"), table(spark, d, "files"))


def p4_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Epoch values of all units, as seconds: chunks.created_at and files.mtime."""
    c = table(spark, d, "chunks").select(F.lit("created_at").alias("fld"), F.col("id").alias("rec"), F.coalesce(timestamps.rescaled("created_at", True), "created_at").alias("utc_s"))
    m = table(spark, d, "files").select(F.lit("mtime").alias("fld"), F.col("path").alias("rec"), F.coalesce(timestamps.rescaled("mtime", False), F.floor("mtime").cast("long")).alias("utc_s"))
    return c.unionByName(m).where("utc_s is not null").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.found(table(spark, d, "files"), table(spark, d, "vault_walk"), table(spark, d, "index_runs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_epochs, p6_found)}


#: Every notation is read by its own expression, and local times by the zones' offsets a day before and a day after.
_P4 = r"""
WITH t0 AS (SELECT DISTINCT path, tz, loc_tag, regexp_replace(created, '^[\s\x{00a0}\x{feff}''"`\x{2018}\x{2019}\x{201c}\x{201d}]+|[\s\x{00a0}\x{feff}''"`\x{2018}\x{2019}\x{201c}\x{201d}]+$', '', 'g') AS t FROM frontmatter WHERE created IS NOT NULL),
t1 AS (SELECT *, nullif(coalesce(nullif(regexp_extract(t, '\[([A-Za-z_]+(?:/[A-Za-z_+-]+){0,2})\]$', 1), ''), regexp_extract(t, '\s([A-Z][A-Za-z_]+/[A-Za-z_/+-]+)$', 1)), '') AS zn, regexp_replace(t, '\s*\[[A-Za-z_]+(?:/[A-Za-z_+-]+){0,2}\]$|\s+[A-Z][A-Za-z_]+/[A-Za-z_/+-]+$', '') AS a FROM t0),
t2 AS (SELECT *, regexp_extract(a, '[0-9Mm.]\s*([+-]\d{2}:?\d{2}|[Zz])$', 1) AS o, regexp_extract(a, '[0-9Mm.]\s+([A-Za-z]{1,5})$', 1) AS w FROM t1),
t3 AS (SELECT *, CASE WHEN upper(w) IN ('AM', 'PM', 'Z') THEN '' ELSE upper(w) END AS ab FROM t2),
t4 AS (SELECT *, trim(CASE WHEN o <> '' AND (contains(a, ':') OR regexp_matches(a, '\dT\d{4}')) THEN left(a, length(a) - length(o)) WHEN ab <> '' THEN left(a, length(a) - length(ab)) ELSE a END) AS b FROM t3),
t5 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(b, '(:\d{2}:\d{2})[.,]\d{1,9}', '\1'), '([Tt]\d{6})[.,]\d{1,9}', '\1'), '(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+', '') AS c FROM t4),
p AS (SELECT *, CASE
    WHEN regexp_matches(c, '^\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[Tt]|,?\s+)(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)$') THEN regexp_extract(c, '^(?P<y>\d{4})[-/](?P<m>\d{1,2})[-/](?P<d>\d{1,2})(?:[Tt]|,?\s+)(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)$', ['y', 'm', 'd', 'h'])
    WHEN regexp_matches(c, '^\d{8}[Tt]\d{4}(?:\d{2})?$') THEN struct_pack(y := left(c, 4), m := c[5:6], d := c[7:8], h := c[10:11] || ':' || c[12:13] || CASE WHEN length(c) > 13 THEN ':' || c[14:15] ELSE '' END)
    WHEN regexp_matches(c, '^\d{1,2}\.\d{1,2}\.\d{4}(?:[Tt]|,?\s+)(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)$') THEN regexp_extract(regexp_replace(c, '^(\d+)\.(\d+)\.(\d+)', '\3 \2 \1'), '^(?P<y>\d{4}) (?P<m>\d{1,2}) (?P<d>\d{1,2})(?:[Tt]|,?\s+)(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)$', ['y', 'm', 'd', 'h'])
    WHEN regexp_matches(c, '^\d{1,2}[-/]\d{1,2}[-/]\d{4}(?:[Tt]|,?\s+)(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)$') THEN regexp_extract(regexp_replace(c, '^(\d+)[-/](\d+)[-/](\d+)', CASE WHEN loc_tag IN ('en-US', 'en-us', 'en_US', 'en-PH', 'en-CA') THEN '\3 \1 \2' ELSE '\3 \2 \1' END), '^(?P<y>\d{4}) (?P<m>\d{1,2}) (?P<d>\d{1,2})(?:[Tt]|,?\s+)(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)$', ['y', 'm', 'd', 'h'])
    WHEN regexp_matches(c, '^\d{1,2}\.?\s+[A-Za-z]{3,9}\.?,?\s+\d{4}(?:[Tt]|,?\s+)(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)$') THEN regexp_extract(regexp_replace(c, '^(\d+)\.?\s+([A-Za-z]+)\.?,?\s+(\d{4})', '\3 \2 \1'), '^(?P<y>\d{4}) (?P<m>[A-Za-z]+) (?P<d>\d{1,2})(?:[Tt]|,?\s+)(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)$', ['y', 'm', 'd', 'h'])
    WHEN regexp_matches(c, '^[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4}(?:[Tt]|,?\s+)(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)$') THEN regexp_extract(regexp_replace(c, '^([A-Za-z]+)\.?\s+(\d+),?\s+(\d{4})', '\3 \1 \2'), '^(?P<y>\d{4}) (?P<m>[A-Za-z]+) (?P<d>\d{1,2})(?:[Tt]|,?\s+)(\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AaPp]\.?[Mm]\.?)?)$', ['y', 'm', 'd', 'h']) END AS s FROM t5),
n AS (SELECT *, coalesce(try_cast(s.m AS INT), list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(left(s.m, 3)))) AS m, regexp_extract(s.h, '^(\d+)', 1)::INT AS h0, lower(regexp_extract(s.h, '([AaPp])', 1)) AS ap, regexp_extract(s.h, '^\d+(:\d{2}(?::\d{2})?)', 1) AS r FROM p),
l AS (SELECT *, epoch(try_cast(printf('%04d-%02d-%02d %02d', s.y::INT, m, s.d::INT, CASE WHEN ap = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE ap WHEN 'p' THEN 12 ELSE 0 END ELSE 99 END) || CASE WHEN length(r) = 3 THEN r || ':00' ELSE r END AS TIMESTAMP))::BIGINT AS l FROM n WHERE s IS NOT NULL AND m IS NOT NULL),
zs AS (SELECT name FROM pg_timezone_names()),
ax AS (SELECT * FROM (VALUES ('Europe/Berlin', 'CET', 3600), ('Europe/Berlin', 'CEST', 7200), ('Europe/Paris', 'CET', 3600), ('Europe/Paris', 'CEST', 7200), ('Europe/Madrid', 'CET', 3600), ('Europe/Madrid', 'CEST', 7200), ('Europe/Warsaw', 'CET', 3600), ('Europe/Warsaw', 'CEST', 7200), ('Europe/London', 'BST', 3600),
    ('America/New_York', 'EST', -18000), ('America/New_York', 'EDT', -14400), ('America/Chicago', 'CST', -21600), ('America/Chicago', 'CDT', -18000), ('America/Los_Angeles', 'PST', -28800), ('America/Los_Angeles', 'PDT', -25200), ('Asia/Tokyo', 'JST', 32400), ('Asia/Kolkata', 'IST', 19800),
    ('Australia/Sydney', 'AEST', 36000), ('Australia/Sydney', 'AEDT', 39600), ('Europe/Moscow', 'MSK', 10800)) AS v(zone, abbr, off)),
z AS (SELECT *, coalesce(zn, tz) AS zone FROM l),
f AS (SELECT z.*, CASE WHEN o IN ('Z', 'z') OR ab IN ('UTC', 'GMT') THEN 0 WHEN o <> '' AND replace(o, ':', '')[2:3]::INT <= 18 AND replace(o, ':', '')[4:5]::INT <= 59 THEN (replace(o, ':', '')[2:3]::INT * 3600 + replace(o, ':', '')[4:5]::INT * 60) * CASE o[1] WHEN '-' THEN -1 ELSE 1 END WHEN ab <> '' THEN ax.off END AS off, coalesce(z.zone IN (SELECT name FROM zs), false) AS known
      FROM z LEFT JOIN ax ON ax.zone = z.zone AND ax.abbr = z.ab WHERE l IS NOT NULL),
g AS (SELECT *, l - (epoch(timezone(zone, to_timestamp(l - 86400)))::BIGINT - (l - 86400)) AS ua, l - (epoch(timezone(zone, to_timestamp(l + 86400)))::BIGINT - (l + 86400)) AS ub FROM f WHERE known AND o = '' AND ab = ''),
g2 AS (SELECT *, epoch(timezone(zone, to_timestamp(ua)))::BIGINT = l AS ga, epoch(timezone(zone, to_timestamp(ub)))::BIGINT = l AS gb FROM g),
cr AS (SELECT path, l - off AS u FROM f WHERE o <> '' OR ab <> '' UNION ALL SELECT path, CASE WHEN ga AND gb AND ua <> ub THEN NULL WHEN ga THEN ua WHEN gb THEN ub END FROM g2
    UNION ALL SELECT path, (v // x.k)::BIGINT FROM (SELECT path, regexp_extract(t, '^(\d{9,19})(?:[.,]\d+)?$', 1)::HUGEINT AS v FROM t0 WHERE regexp_full_match(t, '\d{9,19}([.,]\d+)?')) e, (VALUES (1::HUGEINT), (1000), (1000000), (1000000000)) AS x(k) WHERE v >= 1420070400::HUGEINT * x.k AND v < 1893456000::HUGEINT * x.k)
SELECT fld, rec, utc_s::BIGINT AS utc_s FROM (
SELECT DISTINCT 'created' AS fld, path AS rec, u AS utc_s FROM cr WHERE u IS NOT NULL AND path IS NOT NULL
UNION SELECT 'created_at', id, created_at // x.k FROM chunks, (VALUES (1000::BIGINT), (1000000), (1000000000)) AS x(k) WHERE id IS NOT NULL AND created_at >= 1420070400::HUGEINT * x.k AND created_at < 1893456000::HUGEINT * x.k
UNION SELECT 'mtime', path, floor(mtime / x.k::DOUBLE)::BIGINT FROM files, (VALUES (1000::BIGINT), (1000000), (1000000000)) AS x(k) WHERE path IS NOT NULL AND mtime >= 1420070400.0::DOUBLE * x.k AND mtime < 1893456000.0::DOUBLE * x.k)"""


def _unit(c: str) -> str:
    cases = " ".join(f"WHEN {c} >= 1420070400::HUGEINT * {u} AND {c} < 1893456000::HUGEINT * {u} THEN floor({c} / {u})" for u in (1000, 1000000, 1000000000))
    return f"CASE {cases} ELSE floor({c}) END::BIGINT"


def oracle_sql() -> dict[str, str]:
    whole = " ".join(f"WHEN created_at >= 1420070400::HUGEINT * {u} AND created_at < 1893456000::HUGEINT * {u} THEN created_at // {u}" for u in (1000, 1000000, 1000000000))
    return {
        "p4_found": _P4,
        "p4_epochs": f"""SELECT DISTINCT * FROM (SELECT 'created_at' AS fld, id AS rec, CASE {whole} ELSE created_at END AS utc_s FROM chunks
            UNION ALL SELECT 'mtime', path, {_unit("mtime")} FROM files) WHERE utc_s IS NOT NULL""",
        "p6_found": """
            WITH ok AS (SELECT run_id, started_at, finished_at FROM index_runs WHERE status = 'ok'),
            base AS (SELECT path, arg_max(lower(sha256), (indexed_at, lower(sha256))) AS sha FROM files f WHERE EXISTS (SELECT 1 FROM ok WHERE f.indexed_at BETWEEN started_at AND finished_at) AND path IS NOT NULL GROUP BY path),
            todo AS (SELECT run_id FROM ok WHERE run_id >= 9),
            walk AS (SELECT run_id, path, seen_at, lower(sha256) AS sha FROM vault_walk WHERE path IS NOT NULL),
            seen AS (SELECT run_id, path, sha FROM (SELECT *, row_number() OVER (PARTITION BY run_id, path ORDER BY seen_at DESC, sha DESC NULLS LAST) AS n FROM walk) WHERE n = 1),
            grid AS (SELECT path, run_id FROM (SELECT path FROM base UNION SELECT path FROM seen) CROSS JOIN todo),
            v AS (SELECT g.path, g.run_id, s.path IS NOT NULL AS here, s.sha, CASE WHEN s.path IS NULL THEN '-' ELSE s.sha END AS state FROM grid g LEFT JOIN seen s USING (path, run_id)
                  UNION ALL SELECT path, 0, true, sha, coalesce(sha, '-') FROM base),
            w AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY path ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-') AS was FROM v)
            SELECT run_id, path, CASE WHEN NOT here THEN 'removed' WHEN was = '-' THEN 'new' ELSE 'changed' END AS verdict FROM w
            WHERE run_id > 0 AND ((NOT here AND was <> '-') OR (sha IS NOT NULL AND was <> sha))""",
    }
