"""Ingestion: what changed, chunks and vectors of that, and the next version of every derived table in one step.

A store holds four versioned tables: files, chunks, the word index and the vector index. A version of the store is a
manifest that names a version of each, renamed into place last; so all of them are always of one state, and readers
resolve it once. A pass writes the rows of what changed and where the old ones stood, never a whole table; changed
files are read once, into a table of their own. Use of notes is kept elsewhere and outlives any rebuild.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter
from ..models import Embedder, embed_column
from ..operators import chunking
from ..operators.provenance import fingerprint_tree
from ..session import written
from ..sources import notes as notes_source
from ..sources.versioned import NOTHING, VersionedTable
from .stores import VectorStore, WordStore

CHUNK_VERSION = "1"
FILES = "path string, mtime double, sha256 string, indexed_at long"
CHUNKS = chunking.SCHEMA + ", embedding array<float>, created_at long, source string"
MODES = ("incremental", "full", "since")


def status(old: DataFrame, new: DataFrame, mode: str = "incremental", cutoff: float | None = None, broken: DataFrame | None = None) -> DataFrame:
    """(path, mtime, status, forced) of a listing against the files table.

    unread: an old path whose mtime moved or which is forced (its hash decides); same: nothing to read; new; removed.
    broken has paths that an interrupted run left without vectors; they are forced.
    """
    if mode not in MODES or (mode == "since") != (cutoff is not None):
        raise ValueError("mode is incremental, full, or since with a cutoff")
    a = old.select("path", F.col("mtime").alias("m0"), F.col("sha256").alias("s0")).dropDuplicates(["path"])
    b = new.select("path", "mtime").dropDuplicates(["path"])
    d = a.join(b, "path", "full_outer")
    forced = F.lit(mode == "full") if mode != "since" else F.coalesce(F.col("mtime") >= F.lit(cutoff), F.lit(False))
    if broken is not None:
        d = d.join(broken.select("path").distinct().withColumn("__b", F.lit(True)), "path", "left")
        forced = forced | F.coalesce("__b", F.lit(False))
    s = F.when(F.col("mtime").isNull(), "removed").when(F.col("m0").isNull(), "new").when(forced | (F.abs(F.col("mtime") - F.col("m0")) >= 2.220446049250313e-16), "unread").otherwise("same")
    return d.select("path", F.coalesce("mtime", "m0").alias("mtime"), "s0", s.alias("status"), forced.alias("forced"))


def settled(read: DataFrame) -> DataFrame:
    """The status of paths whose content was read (with sha256): changed, or refreshed where only the mtime moved."""
    s = F.when(F.col("status") != "unread", F.col("status")).when(F.col("forced") | (F.col("sha256") != F.col("s0")), "changed").otherwise("refreshed")
    return read.withColumn("status", s)


@dataclass
class Store:
    """files (by path) and chunks (by id) with their indexes, under one folder."""

    spark: SparkSession
    path: str
    stem: bool = True

    def __post_init__(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        base = self.path.rstrip("/")
        self._p = lambda x: p(f"{base}/{x}")
        self._fs = p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self.files, self.chunks = VersionedTable(self.spark, f"{base}/files", "path"), VersionedTable(self.spark, f"{base}/chunks", "id")
        self.words = WordStore(self.spark, f"{base}/words", self.stem)

    def vectors(self, width: int) -> VectorStore:
        return VectorStore(self.spark, f"{self.path.rstrip('/')}/vectors-{width}", width)

    def manifest(self) -> dict | None:
        """The newest manifest; manifests are numbered and never changed."""
        if not self._fs.exists(self._p("manifests")):
            return None
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._p("manifests")) if s.getPath().getName().endswith(".json"))
        if not names:
            return None
        stream = self._fs.open(self._p(f"manifests/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def rows(self, name: str, manifest: dict | None = None) -> DataFrame | None:
        """A table's rows with their places, or None before the first pass."""
        m = manifest or self.manifest()
        return None if m is None else (self.files if name == "files" else self.chunks).live(m[name])

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        got = self.rows(name, manifest)
        return self.spark.createDataFrame([], {"files": FILES, "chunks": CHUNKS}[name]) if got is None else got.drop(*VersionedTable.AT)

    def publish(self, content: dict) -> dict:
        """The next manifest of the store."""
        was = self.manifest()
        version = (was["version"] + 1) if was else 1
        m = {**content, "version": version}
        self._fs.mkdirs(self._p("manifests"))
        tmp = self._p(f".{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(m, sort_keys=True).encode()))
        out.close()
        target = self._p(f"manifests/{version:09d}.json")
        if self._fs.exists(target) or not self._fs.rename(tmp, target):
            raise RuntimeError("another writer published this version")
        return m

    def vacuum(self) -> None:
        """Deletes what the newest manifest doesn't name. Nobody may read an older state meanwhile."""
        m = self.manifest()
        if m:
            self.files.vacuum([m["files"]])
            self.chunks.vacuum([m["chunks"]])


def index(store: Store, root: str, embedder: Embedder, now: int, mode: str = "incremental", cutoff: float | None = None, zone: str = "UTC") -> dict:
    """One pass over a folder of notes; gives counts per status. Nothing is visible until all of it is written."""
    spark = store.spark
    listing = notes_source.listing(spark, root)
    m = store.manifest()
    identity = {"chunk_version": CHUNK_VERSION, "width": embedder.width, "model": type(embedder).__name__}
    if m and m["chunk_version"] != CHUNK_VERSION:
        mode, cutoff = "full", None
    elif m and (m["width"], m["model"]) != (identity["width"], identity["model"]) and mode != "full":
        raise ValueError("the vectors are of another model; index with mode full")
    old_files, old_chunks = store.rows("files", m), store.rows("chunks", m)
    known = store.table("files", m)
    broken = None if old_chunks is None else old_chunks.where("embedding is null").select("path")
    todo = written(status(known, listing, mode, cutoff, broken), "todo")
    # every changed file is read once: its hash, its chunks and its counts are of the same bytes
    done = written(settled(notes_source.contents(todo.where("status in ('new', 'unread')"), root)), "read")
    fresh = done.where("status in ('new', 'changed')")
    d = frontmatter.with_frontmatter(fresh.select("path", "mtime", "content")).drop("fields")
    d = d.withColumn("created_at", frontmatter.created_seconds(F.col("created_raw"), F.col("mtime"), zone))
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    made = chunking.chunked(d, carry=["created_at", "source"]).withColumn("embedding", embed_column(embedder)(F.col("body")))
    made = written(made.select(*names), "chunks-made")
    touched = done.select("path", "mtime", "sha256", F.lit(now).cast("long").alias("indexed_at"))
    gone = todo.where("status = 'removed'").select("path").unionByName(fresh.select("path")).distinct()
    # a full pass begins its indexes anew, where no old row can be left over
    whole = m is None or mode == "full"
    out = None if old_chunks is None else written(old_chunks.join(gone, "path", "left_semi").select("id", *VersionedTable.AT), "chunks-gone")
    before = lambda name: NOTHING if m is None else m[name]
    at = {
        "chunks": store.chunks.commit(made, out, base=before("chunks")),
        "files": store.files.commit(touched, None if old_files is None else old_files.join(todo.where("status != 'same'").select("path"), "path", "left_semi"), base=before("files")),
        "words": store.words.replace(made, None if out is None else out.select("id"), base=before("words")),
    }
    cells = store.vectors(embedder.width)
    at["vectors"] = cells.rebuild(made, NOTHING) if whole else cells.replace(made, None if out is None else out.select("id"), base=before("vectors"))
    store.publish({**at, **identity})
    counts = todo.where("status in ('same', 'removed')").select("status").unionByName(done.select("status")).groupBy("status").count().collect()
    return {r["status"]: r["count"] for r in counts}


def compact(store: Store, partitions: int) -> dict:
    """The current state again, in fewer and larger files and without deletion vectors."""
    m = store.manifest()
    if m is None:
        raise ValueError("nothing to compact")
    at = {"files": store.files.compact(m["files"], partitions), "chunks": store.chunks.compact(m["chunks"], partitions), "words": store.words.compact(m["words"])}
    return store.publish({**m, **at})


def doctor(files: DataFrame, chunks: DataFrame, width: int, ticks: DataFrame | None = None, events: DataFrame | None = None, words: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(check, count): what isn't as it should be; all counts are 0 in a sound store (orphans aside, which are only told)."""
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("check"), "count")
    f = files.select("path").distinct()
    out = [
        one(chunks.where(F.col("embedding").isNull()), "chunks without vector"),
        one(chunks.where(F.size("embedding") != width), "vectors of another width"),
        one(chunks.join(f, "path", "left_anti"), "chunks without file"),
        one(chunks.groupBy("id").count().where("count > 1"), "chunk ids more than once"),
        one(files.groupBy("path").count().where("count > 1"), "paths more than once"),
        one(chunks.where(F.sha2(F.concat("path", F.lit("#"), F.col("ord").cast("string")), 256) != F.col("id")), "ids that don't fit path and number"),
    ]
    # the indexes' live rows (id) against the chunks, both ways
    ids = chunks.select("id").distinct()
    with_vector = chunks.where(F.col("embedding").isNotNull()).select("id").distinct()
    for name, held, want in (("word index", words, ids), ("vector index", vectors, with_vector)):
        if held is not None:
            out += [one(want.join(held.select("id"), "id", "left_anti"), f"chunks missing in the {name}"), one(held.select("id").join(want, "id", "left_anti"), f"rows of the {name} without chunk")]
    if ticks is not None:
        out.append(one(ticks.join(f, "path", "left_anti"), "counters without file"))
    if events is not None:
        out.append(one(events.distinct().join(f, "path", "left_anti"), "events without file"))
    d = out[0]
    for x in out[1:]:
        d = d.unionByName(x)
    return d


def examined(store: Store, ticks: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """``doctor`` of a store's current state, indexes included."""
    m = store.manifest()
    if m is None:
        raise ValueError("nothing is indexed")
    return doctor(store.table("files", m), store.table("chunks", m), m["width"], ticks, events, store.words.docs.live(m["words"]), store.vectors(m["width"]).rows.live(m["vectors"]))


def overview(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, chunks with a vector, and the corpus' fingerprint."""
    blank = {"files": F.lit(None).cast("long"), "chunks": F.lit(None).cast("long"), "embedded": F.lit(None).cast("long"), "corpus_tree_sha256": F.lit(None).cast("string")}
    names = list(blank)
    a = files.agg(F.countDistinct("path").alias("files"))
    b = chunks.agg(F.countDistinct("id").alias("chunks"), F.countDistinct(F.when(F.col("embedding").isNotNull(), F.col("id"))).alias("embedded"))
    rows = [d.select(*[F.col(n) if n in d.columns else blank[n].alias(n) for n in names]) for d in (a, b, fingerprint_tree(files))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*[F.max(n).alias(n) for n in names])
