"""Immutable table versions: data files, deletion vectors and one manifest per version (problem 6).

A version never rewrites a file. It adds files of new rows and files of deletion vectors (which rows, by file and
position, of earlier files are gone), and last of all its manifest, by one rename: without the manifest the version
doesn't exist, so a run that dies leaves nothing that a reader sees, and its repeat writes new files. Every manifest
also names the input version up to which its rows were made, so what was processed and that it was processed become
true in the same commit: nothing is skipped or done twice.

Manifests name files, never rows. A version is read in one scan of the files it names, however many versions they
come from, less the positions that its vectors name; ``compact`` puts the rows of a version into fresh files. ``changes``
compares two manifests and reads only the files in which they differ.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


#: The base of a commit that goes on from no version.
NOTHING = -1


class VersionedTable:
    """A table under ``path`` with one row per ``key`` (a column that isn't null) in every version.

    Its columns are fixed by the first commit. Repeated keys in a commit are an error of the caller.
    """

    #: Where a row stands: its file and its place in it, as ``live`` gives them and ``commit`` takes them.
    AT = ("__file", "__pos")

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._at = lambda name: hadoop(f"{self.path}/{name}")
        self._fs = hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, content: dict) -> None:
        """Manifest last, by a rename that fails when another writer took the version."""
        self._fs.mkdirs(self._at("manifests"))
        temporary = self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        target = self._at(f"manifests/{version:012d}.json")
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            raise RuntimeError(f"version {version} was committed by another writer")

    def _write(self, df: DataFrame, folder: str, version: int) -> list[dict]:
        """The files that df became."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        found = [s for s in self._fs.listStatus(self._at(folder)) if s.getPath().getName().endswith(".parquet")]
        return [{"name": f"{folder}/{s.getPath().getName()}", "version": version, "bytes": s.getLen()} for s in found]

    def _read(self, files: Iterable[dict], schema: StructType, places: bool = False) -> DataFrame:
        """Rows of some files of a manifest in one scan; with places, with AT."""
        names = [f"{self.path}/{f['name']}" for f in files]
        if not names:
            none = StructType([*schema, StructField("__file", StringType()), StructField("__pos", LongType())]) if places else schema
            return self.spark.createDataFrame([], none)
        rows = self.spark.read.schema(schema).parquet(*names)
        # a file's name is unique in the table, as it holds the writing task's own number
        return rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__pos")) if places else rows

    @staticmethod
    def _schema(m: dict) -> StructType:
        return StructType.fromJson(m["schema"])

    def _vectors(self, m: dict, files: Iterable[dict] | None = None) -> DataFrame:
        """(key, __file, __pos) of some vectors of a manifest, by default of all."""
        key = next(f for f in self._schema(m) if f.name == self.key)
        return self._read(m["vectors"] if files is None else files, StructType([StructField(self.key, key.dataType), StructField("__file", StringType()), StructField("__pos", LongType())]))

    def commit(self, added: DataFrame, gone: DataFrame | None = None, processed: int | None = None, base: int | None = None, note: str | None = None) -> int:
        """A new version: the rows of added are new, those that gone names (key and AT, as read by ``live``) are no more.

        It goes on from version base, by default the last one: who keeps several tables in step names the version that
        they had together (NOTHING for none), and what a writer left behind that died in between is passed over.
        """
        last = self.versions()
        version = last[-1] + 1 if last else 0
        old = self.manifest(last[-1] if base is None else base) if last and base != NOTHING else {"data": [], "vectors": [], "schema": None, "compacted": None}
        tag = uuid.uuid4().hex
        content = {"schema": old["schema"] or json.loads(added.schema.json()), "vectors": old["vectors"], "processed": processed, "compacted": old["compacted"], "note": note}
        content["data"] = [*old["data"], *self._write(added, f"data/{version}-{tag}", version)]
        if gone is not None:
            content["vectors"] = [*old["vectors"], *self._write(gone.select(self.key, *self.AT), f"vectors/{version}-{tag}", version)]
        self._publish(version, content)
        return version

    def compact(self, base: int | None = None, partitions: int | None = None) -> int:
        """A version's rows again (by default the last one's), in fresh files and without vectors: a version that changes no record."""
        last = self.versions()[-1] if base is None else base
        old, version = self.manifest(last), self.versions()[-1] + 1
        rows = self.live(last)
        files = self._write((rows.coalesce(partitions) if partitions else rows).drop(*self.AT), f"data/{version}-{uuid.uuid4().hex}", version)
        self._publish(version, {**old, "data": files, "vectors": [], "compacted": version})
        return version

    def vacuum(self, keep: Iterable[int]) -> None:
        """Deletes all versions but those of keep, and all files that none of these names. Nobody may read or write the table meanwhile."""
        keep = set(keep)
        kept = [self.manifest(v) for v in keep]
        named = {f["name"].rsplit("/", 1)[0] for m in kept for f in [*m["data"], *m["vectors"]]}
        for v in set(self.versions()) - keep:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        for kind in ("data", "vectors"):
            if self._fs.exists(self._at(kind)):
                for s in self._fs.listStatus(self._at(kind)):
                    if f"{kind}/{s.getPath().getName()}" not in named:
                        self._fs.delete(s.getPath(), True)

    def live(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last by default), each with its AT. Deleted positions are few beside the rows, so taking them out is a filter as a rule."""
        m = self.manifest(self.versions()[-1] if version is None else version)
        rows = self._read(m["data"], self._schema(m), True)
        return rows.join(self._vectors(m).select(*self.AT), list(self.AT), "left_anti") if m["vectors"] else rows

    def changes(self, older: int, newer: int) -> DataFrame:
        """Record deltas between two versions: the key, the columns as they became, and verdict new, changed or removed.

        Read are the data files and the deletion vectors that only the newer manifest has. A key with a row in a new
        data file and an entry in a new vector was changed, with the row alone new, with the entry alone removed.
        Columns of a removed key are null. Where a compaction lies between the two, no file is in both, and whole
        versions are compared.
        """
        a, b = self.manifest(older), self.manifest(newer)
        if a["compacted"] != b["compacted"]:
            return self._compared(older, newer)
        had = {f["name"] for f in [*a["data"], *a["vectors"]]}
        more = [f for f in b["data"] if f["name"] not in had]
        less = [f for f in b["vectors"] if f["name"] not in had]
        dead, rows = self._vectors(b, less), self._read(more, self._schema(b), True)
        if less and len({f["version"] for f in more}) > 1:  # a row that came and went between the two
            rows = rows.join(dead.select(*self.AT), list(self.AT), "left_anti")
        fresh = [f["name"].rsplit("/", 1)[1] for f in more] if len({f["version"] for f in [*more, *less]}) > 1 else []
        if fresh:
            dead = dead.join(self.spark.createDataFrame([(n,) for n in fresh], "__file string"), "__file", "left_anti")
        was = dead.select(self.key).distinct().withColumn("__was", F.lit(True))
        now = rows.drop(*self.AT).withColumn("__now", F.lit(True))
        verdict = F.when(F.col("__now") & F.col("__was"), "changed").when(F.col("__now"), "new").otherwise("removed")
        return now.join(was, self.key, "full_outer").withColumn("verdict", verdict).drop("__now", "__was")

    def _compared(self, older: int, newer: int) -> DataFrame:
        was = self.live(older).drop(*self.AT)
        now = self.live(newer).drop(*self.AT)
        others = [c for c in now.columns if c != self.key]
        was = was.select(self.key, F.struct(*others).alias("__was"))
        now = now.select(self.key, *others, F.struct(*others).alias("__now"))
        verdict = F.when(F.col("__was").isNull(), "new").when(F.col("__now").isNull(), "removed").when(~F.col("__was").eqNullSafe(F.col("__now")), "changed")
        return now.join(was, self.key, "full_outer").withColumn("verdict", verdict).where("verdict is not null").drop("__now", "__was")
