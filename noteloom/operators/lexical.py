"""An inverted index and BM25 for many queries at once.

The index is three tables: postings (term, field, id, tf, and the places for phrases), the length of every field, and
one row of statistics per field. A query batch is (query_id, term, role) rows; scoring is one join of postings with
the batch's terms, so only their postings are read, then a sum per query and chunk and a rank filter that runs before
the shuffle as well. Tables of plain queries are scored in blocks of chunks instead (``blocks``), also over stored
postings (``postings``). Scores are the published form with k1 = 1.2 and b = 0.75, summed over the fields; equal scores
go by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import stemmed
from ..functions.text import tokens
from ..session import written
from . import blocks, postings
from .blocks import K1, B

FIELDS = ("heading_path", "body")


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    stem: bool = False


class Fresh(Index):
    """The index of texts that are at hand. What a search needs of it is made when it is asked for."""

    def __init__(self, per: DataFrame, texts: DataFrame, stem: bool, unique: bool):
        self.per, self.texts, self.stem, self.unique = per, texts, stem, unique

    @cached_property
    def lengths(self) -> DataFrame:
        # two short rows per chunk; statistics and scores read them, and not the texts again
        return written(self.per.select("id", "field", F.size("t").alias("len")), "lengths")

    @cached_property
    def stats(self) -> DataFrame:
        return self.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))

    @cached_property
    def postings(self) -> DataFrame:
        places = self.per.select("id", "field", F.posexplode("t").alias("pos", "term"))
        if self.stem:  # stems of the different terms only
            terms = places.select("term").distinct().withColumn("s", stemmed("term"))
            places = places.join(terms, "term").select("id", "field", "pos", F.col("s").alias("term"))
        return places.groupBy("term", "field", "id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("places"))


class Stored(Index):
    """An index as it is stored: rows with lists (see ``postings``) in folders of their terms (tb) and segments, and its live chunks, with their segment, block, number and lengths."""

    def __init__(self, lists: DataFrame, docs: DataFrame, fields: tuple[str, ...], stem: bool, buckets: int):
        self.lists, self.docs, self.fields, self.stem, self.buckets = lists, docs, fields, stem, buckets

    @cached_property
    def lengths(self) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"len_{i}").alias("len")) for i, f in enumerate(self.fields)])).alias("f")
        return self.docs.select("id", each).select("id", "f.field", "f.len")

    @cached_property
    def stats(self) -> DataFrame:
        return self.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))

    @cached_property
    def postings(self) -> DataFrame:
        return postings.single(self.lists, self.docs, self.fields)

    def of(self, words: pa.Array) -> DataFrame:
        """The rows of some different terms, which are a batch's and so on every task; only their folders are read."""
        t = self.docs.sparkSession.createDataFrame(pa.table({"term": words.cast(pa.string())}))
        # at most so many numbers as there are folders
        some = [r.b for r in t.select(bucket_of("term", self.buckets).alias("b")).distinct().collect()]
        return self.lists.where(F.col("tb").isin(some)).join(F.broadcast(t), "term", "left_semi")


def bucket_of(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def of_terms(index: Index, terms: DataFrame) -> DataFrame:
    """The live postings of some terms (term); of a stored index only the folders of these terms are read."""
    if isinstance(index, Stored):
        return postings.single(index.of(terms.select("term").distinct().toArrow()["term"].combine_chunks()), index.docs, index.fields)
    return index.postings.join(terms.select("term").distinct(), "term", "left_semi")


def build(chunks: DataFrame, key: str = "id", fields: tuple[str, ...] = FIELDS, stem: bool = False, unique: bool = False) -> Index:
    """The index of a table of chunks. Null texts are empty; chunks without a key are left out; repeated keys count once (unique: there are none)."""
    d = chunks.where(F.col(key).isNotNull())
    once = d if unique else d.dropDuplicates([key])
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(tokens(F.col(f)), F.expr("array()").cast("array<string>")).alias("t")) for f in fields])).alias("p")
    texts = d.select(F.col(key).alias("id"), *[tokens(F.col(f)).alias(f"t_{i}") for i, f in enumerate(fields)])
    return Fresh(once.select(F.col(key).alias("id"), parts).select("id", "p.field", "p.t"), texts, stem, unique)


_PART = re.compile(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|(\S+))')


def parse_query(text: str) -> list[tuple[str, str, str | None, int]]:
    """(role, term, field or None, phrase number) of a query; role is should, must or not, and phrase 0 means a single word.

    Words are alternatives; +word must be there, -word must not, "two words" is a phrase, field:word looks at one
    field, AND and OR stand between words. A query with an open quote, or with a field that isn't known, is read as
    its letters and digits only.
    """
    known = {"heading": "heading_path", "body": "body", "heading_path": "heading_path"}
    found = list(_PART.finditer(text))
    if text.count('"') % 2 or any(m[2] and m[2] not in known for m in found):
        return [("should", w, None, 0) for w in re.findall(r"[^\W_]+", text.lower())]
    out: list[list] = []
    phrase, both = 0, False
    for m in found:
        if m[4] in ("AND", "OR") and not m[1] and not m[2]:
            both = m[4] == "AND"
            if both and out and out[-1][0] == "should":
                last = out[-1][3]
                for x in out:
                    if x is out[-1] or (last and x[3] == last):
                        x[0] = "must"
            continue
        words = re.findall(r"[^\W_]+", (m[3] if m[3] is not None else m[4]).lower())
        role = {"+": "must", "-": "not"}.get(m[1], "must" if both else "should")
        both = False
        number = 0
        if m[3] is not None and len(words) > 1:
            phrase += 1
            number = phrase
        out += [[role, w, known.get(m[2]) if m[2] else None, number] for w in words]
    return [tuple(x) for x in out]


TERMS = "query_id string, role string, term string, field string, phrase int, place int"


def query_terms(spark: SparkSession, queries: dict[str, str], stem: bool = False) -> DataFrame:
    """The parsed terms of a batch. The batch comes from the caller's memory, so it is small by nature."""
    from ..functions.stem import stem as stem_word

    rows = []
    for q, text in queries.items():
        seen: dict[int, int] = {}
        for role, term, fld, phrase in parse_query(text):
            place = seen[phrase] = seen.get(phrase, -1) + 1
            rows.append((str(q), role, stem_word(term) if stem else term, fld, phrase, place))
    return spark.createDataFrame(rows, TERMS)


def plain_terms(queries: DataFrame, query_id: str, text: str, stem: bool = False) -> DataFrame:
    """The terms of a table of queries, all alternatives; for batches that are tables themselves. stem: as the index was built."""
    q = queries.where(F.col(query_id).isNotNull())
    if stem:
        d = q.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).distinct()
        return d.select("query_id", stemmed("term").alias("term")).distinct()
    return q.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).distinct()


def weighted(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, id, score): the sum over the query's terms and the fields.

    Terms that occur in the batch select the postings; document frequencies are counted over those. The batch's terms,
    their postings and their weights are written on the way: the texts of an index that isn't stored are read once for
    both, and the engine sees how short the terms and weights are, so that the postings needn't move to meet them.
    """
    terms = written(terms, "terms")
    hit = written(of_terms(index, terms).select("term", "field", "id", "tf"), "hit-postings")
    df = hit.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    # two rows of statistics, whatever the data
    idf = df.join(F.broadcast(index.stats), "field").withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("term", "field", "idf", "avg_len")
    idf = written(idf, "term-weights")
    scored = hit.join(idf, ["term", "field"]).join(index.lengths, ["id", "field"])
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = scored.select("term", "field", "id", weight.alias("w"))
    keys = ["term"]
    if "field" in terms.columns:
        t = terms.select("query_id", "term", F.col("field").alias("only")).distinct()
        joined = scored.join(t, keys).where(F.col("only").isNull() | (F.col("only") == F.col("field")))
    else:
        joined = scored.join(terms.select("query_id", "term").distinct(), keys)
    # rounded before the sum, so that its order has no say in ties
    return joined.groupBy("query_id", "id").agg((F.sum(F.round(F.col("w") * 1e9).cast("long")) / 1e9).alias("score"))


def top(scored: DataFrame, k: int, score: str = "score", query: str = "query_id", key: str = "id") -> DataFrame:
    """The k best per query with their rank; the filter is applied before the shuffle too."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 1))


def search(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) for a batch of parsed queries (see query_terms) or plain terms."""
    if "role" not in terms.columns and isinstance(index, Fresh):
        return top(blocks.search(index.texts, terms, k, index.stem, index.unique), k)
    if "role" not in terms.columns and isinstance(index, Stored):
        found = lambda words: postings.found(index.of(words), index.docs, words, index.fields)
        return top(blocks.scored(found, len(index.fields), terms, k), k)
    if "role" not in terms.columns:
        return top(weighted(index, terms), k)
    positive = terms.where("role != 'not'")
    got = weighted(index, positive)
    met = lambda t: of_terms(index, t).join(t, "term").where(F.col("only").isNull() | (F.col("only") == F.col("field")))
    t = terms.withColumn("only", F.col("field")).drop("field")
    # single required and excluded words
    need = t.where("role = 'must' and phrase = 0").groupBy("query_id").agg(F.countDistinct("term", F.coalesce("only", F.lit(""))).alias("need"))
    have = met(t.where("role = 'must' and phrase = 0")).groupBy("query_id", "id").agg(F.countDistinct("term", F.coalesce("only", F.lit(""))).alias("have"))
    got = got.join(F.broadcast(need), "query_id", "left").join(have, ["query_id", "id"], "left").where("need is null or have = need").drop("need", "have")
    got = got.join(met(t.where("role = 'not' and phrase = 0")).select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    # phrases: the words stand one after the other in one field
    size = t.where("phrase > 0").groupBy("query_id", "phrase", "role").agg(F.count(F.lit(1)).alias("size"))
    spots = met(t.where("phrase > 0")).select("query_id", "phrase", "role", "id", "field", (F.explode("places").alias("at")), "place").withColumn("start", F.col("at") - F.col("place"))
    full = spots.groupBy("query_id", "phrase", "role", "id", "field", "start").agg(F.countDistinct("place").alias("n")).join(F.broadcast(size), ["query_id", "phrase", "role"]).where("n = size")
    full = full.select("query_id", "phrase", "role", "id").distinct()
    asked = t.where("phrase > 0 and role = 'must'").groupBy("query_id").agg(F.countDistinct("phrase").alias("need"))
    held = full.where("role = 'must'").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("have"))
    got = got.join(F.broadcast(asked), "query_id", "left").join(held, ["query_id", "id"], "left").where("need is null or have = need").drop("need", "have")
    got = got.join(full.where("role = 'not'").select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    # a chunk of a phrase query that is only alternatives needs one alternative that holds: a single word or a whole phrase
    only = t.where("role = 'should'").groupBy("query_id").agg(F.min("phrase").alias("least")).join(t.where("role = 'must'").select("query_id").distinct(), "query_id", "left_anti").where("least > 0").select("query_id")
    some = full.where("role = 'should'").select("query_id", "id").distinct().withColumn("ok", F.lit(True))
    got = got.join(F.broadcast(only.withColumn("strict", F.lit(True))), "query_id", "left").join(some, ["query_id", "id"], "left").where("strict is null or ok").drop("strict", "ok")
    return top(got, k)
