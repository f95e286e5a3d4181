"""Timestamps of many notations, brought to one UTC instant (problem 4).

Every notation is one branch of a single regular expression with named groups. One pass of the regular
expression takes all components out of a text; the calendar is checked on the numbers, and the instant is put
together by integer arithmetic on days, so nothing depends on the session's time zone or on a parser's leniency.
All of it is JVM-side column algebra: no Python, no shuffle.

Defined results: null for null or blank text, free text, dates without a time of day, impossible dates or clock
times, a numeric date whose order the locale doesn't settle to a possible date, a local time without a zone, and
a local time that its zone skips or has twice. Blanks and quotes around the text are ignored.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: English month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Instants outside these years are taken for another unit (epoch numbers).
FIRST, LAST = 1_420_070_400, 1_893_456_000
#: Locales that write the month first in numeric dates; all others write the day first.
MONTH_FIRST = ("en-US", "en-us", "en_US", "en-PH", "en-CA")

_CLOCK = r"(?<h{i}>\d{{1,2}}):(?<mi{i}>\d{{2}})(?::(?<s{i}>\d{{2}})(?:[.,](?<f{i}>\d{{1,9}}))?)?(?:\s*(?<ap{i}>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?<z{i}>Z|z)|\s*(?<o{i}>[+-]\d{{2}}:?\d{{2}})|\s+(?<ab{i}>[A-Za-z]{{1,5}}))?(?:\s*\[(?<zn{i}>[A-Za-z_]+(?:/[A-Za-z_+-]+){{0,2}})\]|\s+(?<zm{i}>[A-Z][A-Za-z_]+/[A-Za-z_/+-]+))?"
_NAME = "|".join(m[:3] + f"(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + "|sept"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
#: One branch per notation; {i} makes the group names differ, as Java demands.
BRANCHES = (
    r"(?<e{i}>\d{{9,19}})(?:[.,]\d+)?",
    r"(?<y{i}>\d{{4}})-(?<m{i}>\d{{1,2}})-(?<d{i}>\d{{1,2}})(?:[Tt]|\s+)" + _CLOCK + _ZONE,
    r"(?<y{i}>\d{{4}})(?<m{i}>\d{{2}})(?<d{i}>\d{{2}})[Tt](?<h{i}>\d{{2}})(?<mi{i}>\d{{2}})(?<s{i}>\d{{2}})?(?:[.,](?<f{i}>\d{{1,9}}))?" + _ZONE,
    r"(?<y{i}>\d{{4}})/(?<m{i}>\d{{1,2}})/(?<d{i}>\d{{1,2}})(?:[Tt]|,?\s+)" + _CLOCK + _ZONE,
    r"(?<d{i}>\d{{1,2}})\.(?<m{i}>\d{{1,2}})\.(?<y{i}>\d{{4}})(?:[Tt]|,?\s+)" + _CLOCK + _ZONE,
    r"(?<na{i}>\d{{1,2}})[/-](?<nb{i}>\d{{1,2}})[/-](?<y{i}>\d{{4}})(?:[Tt]|,?\s+)" + _CLOCK + _ZONE,
    r"(?i:" + _DAY + r")(?<d{i}>\d{{1,2}})\.?\s+(?<mn{i}>(?i:" + _NAME + r"))\.?,?\s+(?<y{i}>\d{{4}})(?:[Tt]|,?\s+)" + _CLOCK + _ZONE,
    r"(?i:" + _DAY + r")(?<mn{i}>(?i:" + _NAME + r"))\.?\s+(?<d{i}>\d{{1,2}}),?\s+(?<y{i}>\d{{4}})(?:[Tt]|,?\s+)" + _CLOCK + _ZONE,
)
PARTS = ("e", "y", "m", "d", "na", "nb", "mn", "h", "mi", "s", "ap", "z", "o", "ab", "zn", "zm")
_MARK = "\x01"


def _compiled() -> tuple[str, str]:
    """The alternation and the replacement that lists its groups; a group that took no part gives nothing."""
    branches = [b.format(i=i) for i, b in enumerate(BRANCHES)]
    every = "|".join(branches)
    listed = "|".join("".join(f"${{{p}{i}}}" for i in range(len(BRANCHES)) if f"(?<{p}{i}>" in every) for p in PARTS)
    return f"^(?:{every})$", _MARK + listed


PATTERN, LISTED = _compiled()
_EDGE = "[\\s\\u00a0\\ufeff'\"`\\u2018\\u2019\\u201c\\u201d]+"


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integers only (years after 0)."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def epoch_seconds(v: Column) -> Column:
    """Whole seconds of an epoch number (a decimal) in s, ms, us or ns: the unit that puts it in 2015 to 2029, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("long"))
    for u in (1, 1_000, 1_000_000, 1_000_000_000):
        out = out.when((v >= FIRST * u) & (v < LAST * u), F.floor(v / F.lit(u).cast("decimal(20,0)")).cast("long"))
    return out


def rescaled(name: str, integral: bool) -> Column:
    """Whole seconds of a column whose value is in ms, us or ns; null when it is in seconds or fits no unit, is null or NaN."""
    out = F.when(F.lit(False), F.lit(None).cast("long"))
    for u in (1_000, 1_000_000, 1_000_000_000):
        inside = (F.col(name) >= FIRST * u) & (F.col(name) < LAST * u)
        out = out.when(inside, F.expr(f"`{name}` div {u}") if integral else F.floor(F.col(name) / float(u)).cast("long"))
    return out


def abbreviations(spark: SparkSession) -> DataFrame:
    """(zone, abbr, abbr_s): the abbreviations each IANA zone has used since 2010; under 2,000 rows whatever the data."""
    rows = set()
    for name in sorted(available_timezones()):
        zone = ZoneInfo(name)
        for year in range(2010, 2031):
            for month in (1, 4, 7, 10):
                t = dt.datetime(year, month, 15, tzinfo=zone)
                if (a := t.tzname()) and a.isalpha():
                    rows.add((name, a, int(t.utcoffset().total_seconds())))
    once: dict = {}
    for name, a, s in sorted(rows):
        once.setdefault((name, a), set()).add(s)
    return spark.createDataFrame([(n, a, s.pop()) for (n, a), s in once.items() if len(s) == 1], "zone string, abbr string, abbr_s long")


def _offset(zone: Column, at: Column) -> Column:
    """Seconds east of UTC that the zone has at an instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), zone)) - at


def normalised(df: DataFrame, text: str, tz: str, locale: str, out: str = "utc_s") -> DataFrame:
    """df and out: the UTC second that df[text] names (see the module), or null.

    tz and locale are columns: the zone and the locale of the row's author. An offset, a zone or an epoch number in
    the text comes before tz; an abbreviation is one of tz, or UTC and GMT anywhere. Other columns pass untouched;
    helper columns have names that begin with __ts.
    """
    spark = df.sparkSession
    trimmed = F.regexp_replace(F.regexp_replace(F.col(text), "^" + _EDGE, ""), _EDGE + "$", "")
    d = df.withColumn("__ts", F.split(F.regexp_replace(trimmed, PATTERN, LISTED), r"\|", -1))
    hit = F.startswith(F.col("__ts")[0], F.lit(_MARK))
    raw = {p: F.when(F.col("__ts")[i] != "", F.col("__ts")[i]) for i, p in enumerate(PARTS)}
    raw["e"] = F.when(F.length(F.col("__ts")[0]) > 1, F.substring(F.col("__ts")[0], 2, 30))
    num = lambda p: F.expr(f"try_cast(__tsp.{p} as int)")
    d = d.withColumn("__tsp", F.when(hit, F.struct(*[raw[p].alias(p) for p in PARTS])))
    p = F.col("__tsp")
    first = F.col(locale).isin(*MONTH_FIRST)
    name = F.lower(F.substring(p["mn"], 1, 3))
    month = F.coalesce(num("m"), F.when(first, num("na")).otherwise(num("nb")), reduce(lambda c, i: c.when(name == MONTHS[i][:3], i + 1), range(12), F.when(F.lit(False), 0)))
    day = F.coalesce(num("d"), F.when(first, num("nb")).otherwise(num("na")))
    hour, ap = num("h"), F.lower(p["ap"])
    full = F.when(ap.isNull(), hour).when((hour < 1) | (hour > 12), F.lit(None)).otherwise(hour % 12 + F.when(ap == "p", 12).otherwise(0))
    d = d.withColumn("__tsn", F.struct(num("y").alias("y"), month.alias("m"), day.alias("d"), full.alias("h"), num("mi").alias("mi"), F.coalesce(num("s"), F.lit(0)).alias("s")))
    n = F.col("__tsn")
    possible = (n["y"] >= 1) & n["m"].between(1, 12) & (n["d"] >= 1) & (n["d"] <= days_in_month(n["y"], n["m"])) & n["h"].between(0, 23) & n["mi"].between(0, 59) & n["s"].between(0, 59)
    local = F.when(possible, days_from_civil(n["y"], n["m"], n["d"]).cast("long") * 86400 + n["h"] * 3600 + n["mi"] * 60 + n["s"])
    digits = F.regexp_replace(p["o"], ":", "")
    oh, om = F.substring(digits, 2, 2).cast("int"), F.substring(digits, 4, 2).cast("int")
    off = F.when((oh <= 18) & (om <= 59), (oh * 3600 + om * 60) * F.when(F.startswith(digits, F.lit("-")), -1).otherwise(1))
    abbr = F.upper(p["ab"])
    d = d.withColumn("__tsl", local).withColumn("__tso", F.when(p["z"].isNotNull() | abbr.isin("Z", "UTC", "GMT"), F.lit(0)).otherwise(off))
    d = d.withColumn("__tsa", abbr).withColumn("__tsz", F.coalesce(p["zn"], p["zm"], F.col(tz)))
    known = abbreviations(spark).select(F.col("zone").alias("__tsz"), F.col("abbr").alias("__tsa"), F.col("abbr_s").alias("__tss"))
    d = d.join(F.broadcast(known), ["__tsz", "__tsa"], "left")
    zones = spark.createDataFrame([(z,) for z in sorted(available_timezones())], "__tsz string").withColumn("__tsk", F.lit(True))
    d = d.join(F.broadcast(zones), "__tsz", "left")
    at, zone = F.col("__tsl"), F.when(F.col("__tsk"), F.col("__tsz"))
    before, after = _offset(zone, at - 86400), _offset(zone, at + 86400)
    d = d.withColumn("__tsc", F.struct((at - before).alias("a"), (at - after).alias("b"), before.alias("oa"), after.alias("ob")))
    c = F.col("__tsc")
    good_a, good_b = _offset(zone, c["a"]) == c["oa"], _offset(zone, c["b"]) == c["ob"]
    once = F.when(good_a & good_b & (c["a"] != c["b"]), F.lit(None).cast("long")).when(good_a, c["a"]).when(good_b, c["b"])
    bad_offset = p["o"].isNotNull() & off.isNull()
    instant = (
        F.when(p["e"].isNotNull(), epoch_seconds(F.expr("try_cast(__tsp.e as decimal(20,0))")))
        .when(bad_offset, F.lit(None).cast("long"))
        .when(F.col("__tso").isNotNull(), at - F.col("__tso"))
        .when(abbr.isNotNull(), at - F.col("__tss"))
        .otherwise(once)
    )
    return d.withColumn(out, instant.cast("long")).drop("__ts", "__tsp", "__tsn", "__tsl", "__tso", "__tsa", "__tsz", "__tsk", "__tss", "__tsc")


def found(frontmatter: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(fld, rec, utc_s) of TESTDATA.md; each distinct row once, so repeated deliveries count once."""
    # the texts repeat and are few beside the rows of chunks; no join is needed before the union
    typed = normalised(frontmatter.select("path", "created", "tz", "loc_tag"), "created", "tz", "loc_tag")
    one = typed.select(F.lit("created").alias("fld"), F.col("path").alias("rec"), "utc_s")
    two = chunks.select(F.lit("created_at").alias("fld"), F.col("id").alias("rec"), rescaled("created_at", True).alias("utc_s"))
    three = files.select(F.lit("mtime").alias("fld"), F.col("path").alias("rec"), rescaled("mtime", False).alias("utc_s"))
    return one.unionByName(two).unionByName(three).where("utc_s is not null and rec is not null").distinct()
