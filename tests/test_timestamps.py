"""Timestamps against hand-made cases and against a slow reading of the whole small table."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

from noteloom.functions import timestamps
from noteloom.session import table

B, NY, IN = "Europe/Berlin", "America/New_York", "Asia/Kolkata"


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


CASES = [
    ("2024-01-02T03:04", B, "de-DE", utc(2024, 1, 2, 2, 4)),
    (" '2024-07-02T03:04:05.999' ", B, "de-DE", utc(2024, 7, 2, 1, 4, 5)),
    ("2024-03-31T02:30", B, "de-DE", None),
    ("2024-10-27T02:30", B, "de-DE", None),
    ("2024-10-27T02:30+01:00[Europe/Berlin]", B, "de-DE", utc(2024, 10, 27, 1, 30)),
    ("2024-10-27 02:30 CEST", B, "de-DE", utc(2024, 10, 27, 0, 30)),
    ("2024-10-27 02:30 EST", B, "de-DE", None),
    ("2024-02-30T10:00", B, "de-DE", None),
    ("2023-02-29T10:00Z", B, "de-DE", None),
    ("2024-02-29T10:00Z", None, "de-DE", utc(2024, 2, 29, 10)),
    ("2024-02-29T24:00Z", None, "de-DE", None),
    ("2024-02-29T10:60Z", None, "de-DE", None),
    ("2024-02-29", B, "de-DE", None),
    ("2024-05-05T10:00", None, "de-DE", None),
    ("2024-05-05T10:00", "No/Where", "de-DE", None),
    ("20240229T101112Z", None, "en-US", utc(2024, 2, 29, 10, 11, 12)),
    ("03/04/2024 05:06", "UTC", "en-US", utc(2024, 3, 4, 5, 6)),
    ("03/04/2024 05:06", "UTC", "en-GB", utc(2024, 4, 3, 5, 6)),
    ("13/04/2024 05:06", "UTC", "en-US", None),
    ("3/4/2024 12:06 AM", "UTC", "en-US", utc(2024, 3, 4, 0, 6)),
    ("3/4/2024 12:06 PM", "UTC", "en-US", utc(2024, 3, 4, 12, 6)),
    ("3/4/2024 13:06 PM", "UTC", "en-US", None),
    ("August 5, 2024 1:02 PM", NY, "en-US", utc(2024, 8, 5, 17, 2)),
    ("5 Aug 2024, 13:02", IN, "en-GB", utc(2024, 8, 5, 7, 32)),
    ("Mon, 05 Aug 2024 13:02:03 -0930", None, "en-GB", utc(2024, 8, 5, 22, 32, 3)),
    ("2024-08-05 13:02 IST", IN, "en-GB", utc(2024, 8, 5, 7, 32)),
    ("2024-08-05T13:02:03 UTC", NY, "en-US", utc(2024, 8, 5, 13, 2, 3)),
    ("05.08.2024 13:02", B, "de-DE", utc(2024, 8, 5, 11, 2)),
    ("2024/08/05 13:02", "Asia/Tokyo", "ja-JP", utc(2024, 8, 5, 4, 2)),
    ("1700000000", None, None, 1700000000),
    ("1700000000123", None, None, 1700000000),
    ("1700000000123456", None, None, 1700000000),
    ("1700000000999999999", None, None, 1700000000),
    ("17000000000", None, None, None),
    ("2024-08-05T13:02:03+25:00", B, "de-DE", None),
    ("yesterday", B, "de-DE", None),
    ("", B, "de-DE", None),
    (None, B, "de-DE", None),
    ("x" * 100_000, B, "de-DE", None),
]


def test_cases(spark):
    rows = [(i, *c[:3], "extra") for i, c in enumerate(CASES)]
    d = spark.createDataFrame(rows, "n int, created string, tz string, loc string, utc_text string")
    got = {r.n: r.utc_s for r in timestamps.normalised(d, "created", "tz", "loc").collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[3]]
    assert not wrong
    assert set(timestamps.normalised(d, "created", "tz", "loc").columns) == set(d.columns) | {"utc_s"}


def test_session_zone_has_no_say(spark):
    d = spark.createDataFrame([("2024-07-02T03:04", B, "de-DE")], "created string, tz string, loc string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert timestamps.normalised(d, "created", "tz", "loc").first().utc_s == utc(2024, 7, 2, 1, 4)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def slow(text, tz):
    """ISO local minutes and seconds only."""
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d)(?::(\d\d))?", text.strip(" \t'"))
    if not m or tz is None:
        return None
    try:
        local = dt.datetime(*[int(x or 0) for x in m.groups()])
    except ValueError:
        return None
    zone = ZoneInfo(tz)
    found = set()
    for fold in (0, 1):
        t = local.replace(tzinfo=zone, fold=fold).astimezone(dt.timezone.utc)
        if t.astimezone(zone).replace(tzinfo=None) == local:
            found.add(int(t.timestamp()))
    return found.pop() if len(found) == 1 else None


def test_local_times_of_the_table(spark, data):
    f = table(spark, data, "frontmatter")
    rows = timestamps.normalised(f, "created", "tz", "loc_tag").where(r"trim(translate(created, '\'\t', '')) rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:]{5,8}$'").collect()
    assert len(rows) > 5
    for r in rows:
        assert r.utc_s == slow(r.created, r.tz), r


def test_units_nulls_and_empty(spark):
    c = spark.createDataFrame([("a", 1700000000), ("a", 1700000000123), ("b", None), ("c", -5), ("d", 1700000000123456789)], "id string, created_at long")
    m = spark.createDataFrame([("p", 1700000000.5), ("q", 1.7e12), ("r", float("nan")), ("s", None)], "path string, mtime double")
    f = spark.createDataFrame([], "path string, created string, tz string, loc_tag string")
    got = {tuple(r) for r in timestamps.found(f, c.union(c), m).collect()}
    assert got == {("created_at", "a", 1700000000), ("created_at", "d", 1700000000), ("mtime", "q", 1700000000)}
