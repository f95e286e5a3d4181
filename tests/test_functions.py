"""Scalar functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from noteloom.functions import frontmatter, numbers, stem, text


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (text.slug, "Héllo, World!  (2)", "h-llo-world-2"),
        (text.slug, "!!!", "note"),
        (text.slug, "a" * 60, "a" * 40),
        (text.bucket, "00-Inbox/a.md", "00-Inbox"),
        (text.bucket, "a.md", ""),
        (text.parent_folder, "a/b/c.md", "a/b"),
        (text.parent_folder, "c.md", ""),
        (text.short_title, "x/20240102-030405-some-title.md", "some-title"),
        (text.short_title, "x/20240102-030405-.md", "20240102-030405-"),
        (text.leaf_heading, "A > B > C", "C"),
        (text.snippet, " a \n\n b ", "a b"),
        (text.ascii_lower, "ÄAZ", "Äaz"),
        (text.estimated_tokens, "x" * 8, 3),
        (text.human_size, "1536", None),
        (text.owned_path, "a/b.md", True),
        (text.owned_path, "/a/b.md", False),
        (text.owned_path, "a/../b.md", False),
        (text.owned_path, "a//b.md", False),
        (text.owned_path, "a/b.txt", False),
        (text.producer_key, "asr_model", True),
        (text.producer_key, "status", False),
        (text.producer_key, "1a", False),
        (text.without_frontmatter, "---\na: b\n---\nx", "x"),
        (text.without_frontmatter, "---\na: b\nx", "---\na: b\nx"),
        (text.note_title, None, None),
    ],
)
def test_text(spark, fn, value, want):
    if fn is text.note_title:
        d = spark.createDataFrame([("a/b.md", "x\n# T \n"), ("a/b.md", "x")], "p string, b string")
        assert [r[0] for r in d.select(text.note_title(F.col("p"), F.col("b"))).collect()] == ["T", "b"]
    elif fn is text.human_size:
        assert one(spark, 1536, fn, "long") == "1.5 KB" and one(spark, 12, fn, "long") == "12 B"
    else:
        assert one(spark, value, fn) == want
        assert one(spark, None, fn) in (None, "", False, "note")


def test_snippet_cuts_by_code_points(spark):
    assert one(spark, "🙂" * 300, text.snippet) == "🙂" * 200 + "…"


def test_durations():
    day = 86_400
    good = {"10h": 36_000, "5d": 5 * day, "3m": 90 * day, "1y": 365 * day, "90s": 90, "30min": 1_800, "2w": 14 * day, "7": 7 * day, "3D": 3 * day, "  5H ": 18_000}
    assert {k: numbers.duration(k) for k in good} == good
    for bad in ("", "abc", "10x", "1.5d", "10 d", "-3d", "m", "10é", "9" * 30):
        with pytest.raises(ValueError):
            numbers.duration(bad)
    assert numbers.cutoff(-(2**63) + 5, "1d") == -(2**63)


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<float>")
    got = [tuple(r) for r in d.select(numbers.usable(F.col("v"), 2), numbers.normalised(F.col("v"))).collect()]
    assert [g[0] for g in got] == [True, False, False, False, False]
    assert got[0][1] == pytest.approx([0.6, 0.8]) and got[1][1] == [0.0, 0.0]
    assert [one(spark, x, numbers.relevance, "double") for x in (0.5, -1.0, 2.0, float("nan"), None)] == [0.5, 0.0, 1.0, None, None]
    pct = spark.createDataFrame([(1.0, 1.0), (0.5, 1.0), (2.0, 1.0), (1.0, 0.0)], "a double, b double").select(numbers.percent(F.col("a"), F.col("b")))
    assert [r[0] for r in pct.collect()] == [100, 50, 100, 100]
    assert [numbers.context_budget(r) for r in (0, 1, 2)] == [512, 3072, 5120]


def test_frontmatter():
    t = "---\ncreated: '2024-01-02T03:04'\nsource: \"corti\"\nsource: other\ncorti: {\"models\":{\"asr\":{\"id\":\"nvidia/x\"}},\"mode\":\"live\",\"n\":[1,true,null]}\nstatus: {}\nbad: [\nplain: text\n---\nbody"
    got = frontmatter.parse(t)
    assert (got["created"], got["source"]) == ("2024-01-02T03:04", "corti")
    assert got["fields"] == [{"key": "corti", "search_text": "corti mode live models asr id nvidia/x n 1 true null"}]
    for none in (None, "", "x", "---\ncreated: a", " ---\na: b\n---"):
        assert frontmatter.parse(none) == {"created": None, "source": None, "fields": []}


def test_created_falls_back(spark):
    d = spark.createDataFrame([("2024-07-01T10:00", 5.9), ("2024-03-31T02:30", 5.9), ("2024-10-27T02:30", 5.9), ("soon", 5.9), (None, 5.9)], "c string, m double")
    got = [r[0] for r in d.select(frontmatter.created_seconds(F.col("c"), F.col("m"), "Europe/Berlin")).collect()]
    assert got == [1719820800, 5, 5, 5, 5]


@pytest.mark.parametrize(("word", "want"), [("running", "run"), ("flies", "fli"), ("ties", "tie"), ("hopping", "hop"), ("hoped", "hope"), ("nationally", "nation"), ("generous", "generous"), ("caresses", "caress"), ("skies", "sky"), ("happily", "happili"), ("relational", "relat"), ("controlling", "control"), ("by", "by"), ("über", "über"), ("sky", "sky"), ("agreed", "agre")])
def test_stems(word, want):
    assert stem.stem(word) == want
