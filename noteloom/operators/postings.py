"""Postings as they are stored: blocks of chunks, and in a block lists of chunk numbers by term and field.

A task numbers the chunks that it holds, so an id stands in an index once and not once per posting, and lists are made
where the texts are: they never move to be made. What is asked of a block's chunks comes together by block. Long lists
are several rows, so that no row and no Arrow batch grows with the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from .blocks import _stems, lists

#: Most chunks of a block, words of a block, and postings (or chunks) in a row.
CHUNKS, WORDS, ROW = 1 << 16, 1 << 22, 1 << 10


def schema(key: str, fields: int) -> str:
    """Of rows with a list, and of rows (term is null) with some of a block's chunks."""
    lens = "".join(f",len_{f}:int" for f in range(fields))
    return f"term string, field string, block long, nos array<int>, tfs array<int>, places array<int>, docs array<struct<id:{key},no:int{lens}>>"


def _kinds(key: pa.DataType, fields: int) -> list[pa.DataType]:
    ints = pa.list_(pa.int32())
    docs = pa.struct([("id", key), ("no", pa.int32()), *[(f"len_{f}", pa.int32()) for f in range(fields)]])
    return [pa.string(), pa.string(), pa.int64(), ints, ints, ints, pa.list_(docs)]


def _rows(key: pa.DataType, fields: int, n: int, block: int, **columns: pa.Array) -> pa.RecordBatch:
    names = ["term", "field", "block", "nos", "tfs", "places", "docs"]
    columns["block"] = pa.array(np.full(n, block, np.int64))
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(names, _kinds(key, fields), strict=True)], names=names)


def _block(block: int, ids: pa.Array, lens: np.ndarray, words: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]], fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A block's rows. words: for each field the different terms, and of each word its term's number, its chunk and its place."""
    n = len(ids)
    at = np.append(np.arange(0, n, ROW), n)
    docs = pa.StructArray.from_arrays([ids, pa.array(np.arange(n, dtype=np.int32)), *[pa.array(lens[:, f].astype(np.int32)) for f in range(len(fields))]], names=["id", "no", *[f"len_{f}" for f in range(len(fields))]])
    yield _rows(ids.type, len(fields), len(at) - 1, block, docs=pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), docs))
    for name, (terms, code, doc, place) in zip(fields, words, strict=True):
        if not len(code):
            continue
        both = code.astype(np.int64) * n + doc
        order = np.argsort(both, kind="stable")
        both, place = both[order], place[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        ends = np.append(first, len(both))
        t, no = np.divmod(both[first], n)
        new = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        # a row begins with a term, and after so many of its postings
        begin = np.flatnonzero((np.arange(len(t)) - np.repeat(new, np.diff(np.append(new, len(t))))) % ROW == 0)
        cut = np.append(begin, len(t))
        yield _rows(ids.type, len(fields), len(begin), block, term=terms.take(pa.array(t[begin])), field=pa.array([name] * len(begin)), nos=lists(cut, no), tfs=lists(cut, np.diff(ends)), places=lists(ends[cut], place))


def _sized(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[pa.Table]:
    held, rows, words = [], 0, 0
    for b in batches:
        for i in range(0, b.num_rows, ROW):
            held.append(b.slice(i, ROW))
            rows += held[-1].num_rows
            words += sum(len(held[-1].column(f + 1).flatten()) for f in range(fields))
            if rows + ROW > CHUNKS or words >= WORDS:
                yield pa.Table.from_batches(held)
                held, rows, words = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def made(texts: DataFrame, fields: tuple[str, ...], stems: bool) -> DataFrame:
    """The rows (see ``schema``) of texts: id, once each, and a list of words per field."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = lru_cache(1 << 18)(stem), TaskContext.get().partitionId() << 32
        for number, block in enumerate(_sized(batches, len(fields))):
            n, lens, words = block.num_rows, np.zeros((block.num_rows, len(fields)), np.int64), []
            for f in range(len(fields)):
                c = block.column(f + 1).combine_chunks()
                lens[:, f] = np.asarray(c.value_lengths().fill_null(0))
                flat = c.flatten()
                d = (_stems(flat, known) if stems else flat).dictionary_encode()
                place = np.arange(len(flat)) - np.repeat(np.cumsum(lens[:, f]) - lens[:, f], lens[:, f])
                words.append((d.dictionary, np.asarray(d.indices), np.repeat(np.arange(n), lens[:, f]), place))
            yield from _block(task + number, block.column(0).combine_chunks(), lens, words, fields)

    few = 4 * texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(few).mapInArrow(scan, schema(texts.schema["id"].dataType.simpleString(), len(fields)))


def chunks(rows: DataFrame) -> DataFrame:
    """(block, id, no, len_0, ...) of the chunks in rows."""
    return rows.where("term is null").select("block", F.inline("docs"))


def _together(rows: DataFrame, docs: DataFrame, fields: int, places: bool) -> DataFrame:
    """Lists and live chunks by block, the chunks first."""
    none = F.lit(None)
    ints = none.cast("array<int>")
    a = docs.select("segment", "block", F.lit(0).alias("kind"), "id", "no", F.array(*[F.coalesce(f"len_{f}", F.lit(0)) for f in range(fields)]).alias("lens"), none.cast("string").alias("term"), none.cast("string").alias("field"), ints.alias("nos"), ints.alias("tfs"), ints.alias("places"))
    b = rows.where("term is not null").select("segment", "block", F.lit(1).alias("kind"), none.cast(docs.schema["id"].dataType).alias("id"), none.cast("int").alias("no"), ints.alias("lens"), "term", "field", "nos", "tfs", F.col("places") if places else ints.alias("places"))
    return a.unionByName(b).repartition("segment", "block").sortWithinPartitions("segment", "block", "kind")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Table]]:
    """Of each block that has a live chunk: the ids of its live chunks, their lengths, what row a number has (-1: none), and the rows with lists."""

    def whole(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        n = int(np.count_nonzero(np.asarray(t["kind"]) == 0))
        if not n:
            return None
        d, rest = t.slice(0, n), t.slice(n)
        no = np.asarray(d["no"])
        most = max([no.max(), *([pc.max(rest["nos"].combine_chunks().flatten()).as_py() or 0] if rest.num_rows else [])])
        row = np.full(most + 1, -1, np.int64)
        row[no] = np.arange(n)
        return d["id"].combine_chunks(), np.asarray(d["lens"].combine_chunks().flatten()).reshape(n, -1), row, rest

    held, last = [], None
    for b in batches:
        s, k = b.column(0).dictionary_encode().indices, np.asarray(b.column(1))
        s = np.asarray(s)
        cuts = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            name = (b.column(0)[i].as_py(), int(k[i]))
            if held and name != last and (got := whole(held)):
                yield got
            if name != last:
                held, last = [], name
            held.append(b.slice(i, j - i))
    if held and (got := whole(held)):
        yield got


def found(rows: DataFrame, docs: DataFrame, words: pa.Array, fields: tuple[str, ...]) -> DataFrame:
    """What ``blocks.found`` gives of texts, of stored lists and the live chunks (docs)."""
    held, names, n_fields = docs.sparkSession.sparkContext.broadcast(words), pa.array(fields), len(fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lens, row, t in _by_block(batches):
            n, nos = len(ids), t["nos"].combine_chunks()
            slot = np.asarray(pc.index_in(t["term"].combine_chunks(), value_set=held.value).fill_null(-1)).astype(np.int64) * n_fields + np.asarray(pc.index_in(t["field"].combine_chunks(), value_set=names))
            slot = np.repeat(slot, np.asarray(nos.value_lengths()))
            at, tf = row[np.asarray(nos.flatten())], np.asarray(t["tfs"].combine_chunks().flatten())
            keep = (at >= 0) & (slot >= 0)
            at, slot, tf = at[keep], slot[keep], tf[keep]
            order = np.lexsort((slot, at))
            ends = np.searchsorted(at[order], np.arange(n + 1))
            for i in range(0, n, 1 << 14):
                j = min(n, i + (1 << 14))
                some = order[ends[i] : ends[j]]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), lists(np.arange(j - i + 1) * n_fields, lens[i:j].ravel()), lists(ends[i : j + 1] - ends[i], slot[some]), lists(ends[i : j + 1] - ends[i], tf[some])], names=["id", "lens", "slots", "tfs"])

    return _together(rows, docs, n_fields, False).mapInArrow(scan, f"id {docs.schema['id'].dataType.simpleString()}, lens array<int>, slots array<int>, tfs array<int>")


def single(rows: DataFrame, docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(term, field, id, tf, places) of the live chunks: a row per posting."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, row, t in _by_block(batches):
            for i in range(0, t.num_rows, 64):
                part = t.slice(i, 64)
                nos, tf = part["nos"].combine_chunks(), np.asarray(part["tfs"].combine_chunks().flatten())
                of = np.repeat(np.arange(part.num_rows), np.asarray(nos.value_lengths()))
                at = row[np.asarray(nos.flatten())]
                places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)), part["places"].combine_chunks().flatten())
                keep = np.flatnonzero(at >= 0)
                of, take = pa.array(of[keep]), pa.array(keep)
                yield pa.RecordBatch.from_arrays([part["term"].combine_chunks().take(of), part["field"].combine_chunks().take(of), ids.take(pa.array(at[keep])), pa.array(tf[keep].astype(np.int64)), places.take(take)], names=["term", "field", "id", "tf", "places"])

    return _together(rows, docs, len(fields), True).mapInArrow(scan, f"term string, field string, id {docs.schema['id'].dataType.simpleString()}, tf long, places array<int>")


def again(rows: DataFrame, docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The rows of the live chunks alone; small blocks become larger ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId() << 32, 0, []

        def put() -> Iterator[pa.RecordBatch]:
            begin = np.cumsum([0, *[len(ids) for ids, *_ in held]])
            words = []
            for f in range(len(fields)):
                parts = [w[f] for *_, w in held]
                d = pa.concat_arrays([terms for terms, *_ in parts]).dictionary_encode()
                base = np.cumsum([0, *[len(terms) for terms, *_ in parts]])
                code = np.concatenate([np.asarray(d.indices)[c + b] for (_, c, *_), b in zip(parts, base)])
                doc = np.concatenate([x + b for (_, _, x, _), b in zip(parts, begin)])
                words.append((d.dictionary, code, doc, np.concatenate([p for *_, p in parts])))
            return _block(task + number, pa.concat_arrays([ids for ids, *_ in held]), np.concatenate([lens for _, lens, _ in held]), words, fields)

        for ids, lens, row, t in _by_block(batches):
            words = []
            for name in fields:
                part = t.filter(pc.equal(t["field"], name))
                nos, tf = part["nos"].combine_chunks(), np.asarray(part["tfs"].combine_chunks().flatten())
                code = np.repeat(np.repeat(np.arange(part.num_rows), np.asarray(nos.value_lengths())), tf)
                doc = np.repeat(row[np.asarray(nos.flatten())], tf)
                keep = doc >= 0
                words.append((part["term"].combine_chunks(), code[keep], doc[keep], np.asarray(part["places"].combine_chunks().flatten())[keep]))
            if held and (sum(len(x) for x, *_ in held) + len(ids) > CHUNKS or sum(len(c) for *_, w in held for _, c, *_ in w) + sum(len(c) for _, c, *_ in words) > WORDS):
                yield from put()
                held, number = [], number + 1
            held.append((ids, lens, words))
        if held:
            yield from put()

    return _together(rows, docs, len(fields), True).mapInArrow(scan, schema(docs.schema["id"].dataType.simpleString(), len(fields)))
