"""Stored indexes: words and vectors of a chunk table, kept beside it and brought up to date by what changed.

Both are written once and read by every later search. A replacement writes the rows of the changed chunks only; what
becomes of the old ones is told by a table of the live chunks, whose commit makes the change visible (see
``sources.versioned``). ``compact`` writes the live rows again, in few files.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import tokens
from ..operators import lexical, postings, vectors
from ..sources.versioned import NOTHING, VersionedTable

#: Folders that the postings of a segment are spread over by their terms.
BUCKETS = 64


class WordStore:
    """An inverted index as segments of postings (see ``operators.postings``), by buckets of terms, and a table of the live chunks with their segment, place in it and lengths."""

    def __init__(self, spark: SparkSession, path: str, stem: bool = True, fields: tuple[str, ...] = lexical.FIELDS, buckets: int = BUCKETS):
        self.spark, self.path, self.stem, self.fields, self.buckets = spark, path.rstrip("/"), stem, fields, buckets
        self.docs = VersionedTable(spark, f"{self.path}/docs", "id")

    def _segment(self, made: DataFrame) -> DataFrame:
        """Writes the rows of postings and gives the chunks that are in them, with their segment. A search reads the folders of its terms only."""
        name = uuid.uuid4().hex
        # every task writes the lists that it made: they don't move, and a task has a file per folder at most
        p = made.withColumn("tb", F.when(F.col("term").isNull(), -1).otherwise(lexical.bucket_of("term", self.buckets)))
        p.sortWithinPartitions("tb", "term").write.partitionBy("tb").option("compression", "zstd").parquet(f"{self.path}/postings/{name}")
        return postings.chunks(self._lists(name, made.schema).where("tb = -1")).withColumn("segment", F.lit(name))

    def _lists(self, segment: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(StructType([*schema, StructField("tb", IntegerType())])).parquet(f"{self.path}/postings/{segment}")

    def replace(self, chunks: DataFrame, gone: DataFrame | None = None, base: int | None = None) -> int:
        """Puts chunks (id and the fields) in, in place of those with the same id, and takes out those that gone (id) names."""
        # null texts are empty; chunks without an id are left out; repeated ids count once, and texts are shorter than their words
        once = chunks.where("id is not null").select("id", *self.fields).dropDuplicates(["id"])
        added = self._segment(postings.made(once.select("id", *[tokens(F.col(f)).alias(f) for f in self.fields]), self.fields, self.stem))
        if base == NOTHING or not self.docs.versions():
            return self.docs.commit(added, base=NOTHING)
        out = added.select("id") if gone is None else added.select("id").unionByName(gone.select("id"))
        return self.docs.commit(added, self.docs.live(base).join(out.distinct(), "id", "left_semi"), base=base)

    def delete(self, gone: DataFrame, base: int | None = None) -> int:
        live = self.docs.live(base)
        return self.docs.commit(live.drop(*VersionedTable.AT).where("false"), live.join(gone.select("id").distinct(), "id", "left_semi"), base=base)

    def compact(self, base: int | None = None) -> int:
        """The live postings as one segment."""
        whole = self.index(base)
        self.docs.commit(self._segment(postings.again(whole.lists, whole.docs, self.fields)), self.docs.live(base), base=base)
        return self.docs.compact()

    def index(self, version: int | None = None) -> lexical.Stored:
        """The index as of a version, for ``lexical.search``."""
        live = self.docs.live(version).drop(*VersionedTable.AT)
        schema = self.spark.createDataFrame([], postings.schema(live.schema["id"].dataType.simpleString(), len(self.fields))).schema
        # one short name per segment, of which compaction leaves one
        segments = [r.segment for r in live.select("segment").distinct().collect()]
        parts = [self._lists(s, schema).withColumn("segment", F.lit(s)) for s in segments]
        lists = parts[0] if parts else self.spark.createDataFrame([], schema).withColumns({"tb": F.lit(0), "segment": F.lit("")})
        for p in parts[1:]:
            lists = lists.unionByName(p)
        return lexical.Stored(lists, live, self.fields, self.stem, self.buckets)


class VectorStore:
    """Vectors by cells of nearest centres. Centres are fitted on a bounded sample at the first build and kept; every vector is in a cell."""

    def __init__(self, spark: SparkSession, path: str, width: int, cells: int = 64, sample: int = 20_000):
        self.spark, self.path, self.width, self.cells, self.sample = spark, path.rstrip("/"), width, cells, sample
        self.rows = VersionedTable(spark, f"{self.path}/rows", "id")

    def centres(self) -> np.ndarray | None:
        """The centres of the last build: so many short rows as cells."""
        if not self.rows.versions():
            return None
        name = self.rows.manifest(self.rows.versions()[-1])["note"]
        return np.array([r.centre for r in self.spark.read.parquet(f"{self.path}/centres/{name}").orderBy("cell").collect()], np.float64)

    def _commit(self, placed: DataFrame, gone: DataFrame | None, note: str, base: int | None) -> int:
        return self.rows.commit(placed.repartitionByRange("cell").sortWithinPartitions("cell"), gone, base=base, note=note)

    def rebuild(self, stored: DataFrame, base: int | None = None) -> int:
        """Fits centres anew and places all vectors of stored (id, embedding)."""
        c, placed = vectors.cells(stored, self.width, self.cells, self.sample)
        name = uuid.uuid4().hex
        self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres/{name}")
        old = self.rows.live(base) if self.rows.versions() and base != NOTHING else None
        return self._commit(placed, old, name, base)

    def replace(self, stored: DataFrame, gone: DataFrame | None = None, base: int | None = None) -> int:
        """Puts vectors in, in place of those with the same id, and takes out those that gone (id) names."""
        c = None if base == NOTHING else self.centres()
        if c is None:
            return self.rebuild(stored, base)
        _, placed = vectors.placed(stored, c, self.width)
        out = stored.select("id") if gone is None else stored.select("id").unionByName(gone.select("id"))
        note = self.rows.manifest(self.rows.versions()[-1])["note"]
        return self._commit(placed, self.rows.live(base).join(out.distinct(), "id", "left_semi"), note, base)

    def search(self, queries: DataFrame, k: int, probes: int = 12, version: int | None = None, **names: str) -> DataFrame:
        """(query_id, id, score, rank) of a batch of queries, from the cells nearest to each."""
        return vectors.approximate(self.centres(), self.rows.live(version), queries, k, self.width, probes, **names)
