"""Export of a coherent set of vectors: a matrix file, a line of metadata per row, and a manifest that comes last.

Rows stream through the driver partition by partition, since both files are one each by their nature; the driver
holds one partition at a time. ``export_parts`` writes the same as a table, for sets that no single file should hold.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import struct
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .notes import outside

META = ("id", "path", "ord", "heading_path", "created_at", "source")


def npy_header(rows: int, width: int) -> bytes:
    """Version 1 header of a C-ordered float32 matrix, padded with blanks so that the data begins at a multiple of 64."""
    d = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({rows}, {width}), }}"
    pad = -(10 + len(d) + 1) % 64
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(d) + pad + 1) + d.encode() + b" " * pad + b"\n"


def ordered(chunks: DataFrame, width: int, sort: bool = True) -> DataFrame:
    """The rows of an export in the order of path and ord; a vector of another width is an error."""
    d = chunks.where("embedding is not null and id is not null").dropDuplicates(["id"])
    bad = F.when(F.size("embedding") != width, F.raise_error(F.concat(F.lit("vector of the wrong width: "), F.col("id"))).cast("array<float>"))
    d = d.withColumn("embedding", F.coalesce(bad, F.col("embedding"))).select(*META, "embedding")
    return d.orderBy("path", "ord", "id") if sort else d


def numbered_rows(chunks: DataFrame, width: int) -> DataFrame:
    """The rows of an export with their numbers i from 0, by a total sort in ranges: no task and no driver holds them all."""
    d = ordered(chunks, width, False).withColumn("__all", F.lit(0))
    got = numbered(d, "__all", [F.col("path").asc(), F.col("ord").asc(), F.col("id").asc()], "i")
    return got.select((F.col("i") - 1).alias("i"), *META, "embedding")


def export_parts(chunks: DataFrame, path: str, width: int) -> None:
    """The same rows as Parquet files, numbered."""
    numbered_rows(chunks, width).write.option("compression", "zstd").parquet(path)


def export(chunks: DataFrame, out: str, width: int, notes_root: str | None = None, form: str = "npy", force: bool = False) -> dict:
    """vectors.npy (or .f32), meta.jsonl and manifest.json under out; gives the manifest.

    A folder with other content needs force; out may not be inside the notes. A failure leaves the former export.
    """
    if form not in ("npy", "f32"):
        raise ValueError("form must be npy or f32")
    if notes_root is not None:
        outside(out, notes_root)
    if os.path.islink(out) or (os.path.isdir(out) and os.listdir(out) and not force):
        raise ValueError("the folder isn't empty")
    os.makedirs(out, exist_ok=True)
    tmp = tempfile.mkdtemp(prefix=".export-", dir=out)
    name = f"vectors.{form}"
    try:
        n, digest = 0, hashlib.sha256()
        with open(f"{tmp}/data", "wb") as data, open(f"{tmp}/meta.jsonl", "w", encoding="utf-8") as meta:
            for row in ordered(chunks, width).toLocalIterator(prefetchPartitions=True):
                b = np.asarray(row.embedding, "<f4").tobytes()
                data.write(b)
                digest.update(b)
                meta.write(json.dumps({"i": n, **{k: row[k] for k in META if row[k] is not None}}, ensure_ascii=False) + "\n")
                n += 1
        with open(f"{tmp}/{name}", "wb") as f, open(f"{tmp}/data", "rb") as data:
            f.write(npy_header(n, width) if form == "npy" else b"")
            shutil.copyfileobj(data, f)
        manifest = {"rows": n, "dims": width, "dtype": "float32", "format": form, "data_sha256": digest.hexdigest(), "files": [name, "meta.jsonl"]}
        with open(f"{tmp}/manifest.json", "w") as f:
            json.dump(manifest, f)
        if os.path.exists(f"{out}/manifest.json"):
            os.remove(f"{out}/manifest.json")  # no manifest while files of two exports stand side by side
        for x in (name, "meta.jsonl", "manifest.json"):
            os.replace(f"{tmp}/{x}", f"{out}/{x}")
        return manifest
    finally:
        shutil.rmtree(tmp, ignore_errors=True)
