"""Folders of Markdown notes: an explicit listing, contents read in parallel, and rule files.

Spark's own file sources leave out empty files and names with an underscore in front, which are notes like others, so
the listing is made here. It is one short row per file; contents are read by the tasks, only for the paths asked for.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter, text

#: Fields that belong to a note's own lifecycle.
OWN_FIELDS = ("created", "status", "source", "para", "modified", "title")
LISTING = "path string, mtime double, length long"


def walk(root: str) -> Iterator[tuple[str, float, int]]:
    """(path, mtime, length) of all .md files (in any case) in the order of their paths; dot names are left out. A failure is an error."""
    def fail(e: OSError) -> None:
        raise e

    found = []
    for folder, dirs, names in os.walk(root, onerror=fail):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        for n in names:
            if not n.startswith(".") and n.lower().endswith(".md"):
                full = os.path.join(folder, n)
                s = os.stat(full)
                found.append((os.path.relpath(full, root).replace(os.sep, "/"), s.st_mtime, s.st_size))
    yield from sorted(found)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """The notes under root, before anything is written."""
    return spark.createDataFrame(list(walk(root)), LISTING)


def contents(notes: DataFrame, root: str) -> DataFrame:
    """notes with content (text, bad bytes replaced) and sha256 (of the bytes); every task opens its own files."""
    names = notes.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in notes.dtypes) + ", content string, sha256 string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            raw = [Path(root, p).read_bytes() for p in b.column(names.index("path")).to_pylist()]
            more = [pa.array([r.decode("utf-8", "replace") for r in raw], pa.string()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, "content", "sha256"])

    return notes.mapInArrow(read, schema)


def inbox(notes: DataFrame, cutoff: int | None = None) -> DataFrame:
    """(path, title) of the notes directly in the inbox, created (or changed) at cutoff or later."""
    d = notes.where(F.col("path").rlike(r"^00-Inbox/[^/]+\.md$"))
    if cutoff is not None:
        d = d.where(F.col("created") >= cutoff)
    return d.select("path", text.note_title(F.col("path"), F.col("content")).alias("title")).orderBy("path", "title")


def folders(files: DataFrame) -> DataFrame:
    """(folder): the folders directly under each kind of folder that has any, else that folder itself; the inbox is none."""
    kinds = [f for k, f in text.FOLDERS.items() if k != "inbox"]
    parts = F.split(F.col("path"), "/")
    d = files.where(F.size(parts) > 1).select(parts[0].alias("a"), F.when(F.size(parts) > 2, F.concat(parts[0], F.lit("/"), parts[1])).alias("b")).where(F.col("a").isin(kinds)).distinct()
    some = d.groupBy("a").agg(F.max(F.col("b").isNotNull()).alias("some"))
    return d.join(some, "a").where("b is not null or not some").select(F.coalesce("b", "a").alias("folder")).distinct()


def sizes(notes: DataFrame) -> DataFrame:
    """(extension, files, bytes) of a listing."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return notes.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def scope_words(start: str, stop: str | None = None, name: str = ".noteloom.json") -> list[str]:
    """Exclusion words of the rule files from a folder up to stop, in order; a file with "root": true is the last one read. A broken file is left out."""
    words: list[str] = []
    for d in [Path(start), *Path(start).parents]:
        try:
            rule = json.loads((d / name).read_text())
            exclude, last = rule.get("exclude", []), bool(rule.get("root", False))
            if not isinstance(exclude, list) or not all(isinstance(w, str) for w in exclude):
                raise ValueError("exclude must be a list of words")
        except (OSError, ValueError, AttributeError):
            exclude, last = [], False
        words += exclude
        if last or (stop is not None and d == Path(stop)):
            break
    return list(dict.fromkeys(w for x in words if (w := x.strip().translate(str.maketrans(text.UPPER, text.LOWER)))))


MOST_FIELDS = 64 * 1024


def extra_fields(content: str | None) -> str:
    """Frontmatter lines of a producer's JSON object; ValueError for anything else, for names that aren't its own to give, or too much."""
    if not content or not content.strip():
        return ""
    if len(content.encode()) > MOST_FIELDS:
        raise ValueError("too many fields")
    fields = json.loads(content)
    if not isinstance(fields, dict):
        raise ValueError("fields must be an object")
    for name in fields:
        if not re.fullmatch("[A-Za-z_][A-Za-z0-9_-]*", name) or name in OWN_FIELDS:
            raise ValueError(f"not a producer's field: {name!r}")
    lines = "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in sorted(fields.items()))
    if len(lines.encode()) > MOST_FIELDS:
        raise ValueError("too many fields")
    return lines


def _slug(title: str) -> str:
    words = re.sub("[^a-z0-9]+", "-", title.translate(str.maketrans(text.UPPER, text.LOWER))).strip("-")
    return words[:40] or "note"


def captured(root: str, title: str, at: dt.datetime, kind: str = "inbox", body: str = "", source: str | None = None, fields: str | None = None) -> str:
    """Writes a new note and gives its path. Everything is checked before anything is made; a note that is there is an error."""
    lines = extra_fields(fields)
    if kind.lower() not in text.FOLDERS:
        raise ValueError(f"kind must be one of {list(text.FOLDERS)}")
    path = f"{text.FOLDERS[kind.lower()]}/{at:%Y%m%d-%H%M%S}-{_slug(title)}.md"
    own = f"created: {at:%Y-%m-%dT%H:%M}\nstatus: inbox\n" + (f"source: {source}\n" if source else "")
    full = Path(root, path)
    full.parent.mkdir(parents=True, exist_ok=True)
    with open(full, "x", encoding="utf-8", newline="\n") as f:
        f.write(f"---\n{own}{lines}---\n\n# {title}\n\n{body.strip()}\n")
    return path


def enriched(content: str, values: dict[str, str]) -> str:
    """A note's text with fields set in its frontmatter: in their place where they are there, else behind the others."""
    held = frontmatter.block(content)
    rest = content if held is None else content.split("\n", len(held) + 2)[-1]
    lines = [x.removesuffix("\r") for x in held or []]
    for name, value in values.items():
        at = next((i for i, x in enumerate(lines) if x.lstrip().startswith(f"{name}:")), len(lines))
        lines[at : at + 1] = [f"{name}: {value}"]
    return "---\n" + "\n".join(lines) + f"\n---\n\n{rest.strip(chr(10)).lstrip()}\n"


def filed(root: str, path: str, folder: str, at: dt.datetime) -> tuple[str, str]:
    """Moves a note to a folder with its status, kind and time of change set; gives (old, new) path for ``usage.rekeyed`` and the next pass."""
    source = Path(root, path)
    kind = next((k for k, f in text.FOLDERS.items() if folder.split("/")[0] == f), "")
    target = Path(root, folder, source.name)
    if not source.is_file():
        raise ValueError(f"no such note: {path}")
    if target.exists() and target.resolve() != source.resolve():
        raise ValueError(f"a note of that name is there: {target}")
    target.parent.mkdir(parents=True, exist_ok=True)
    new = enriched(source.read_text(encoding="utf-8"), {"status": "active", "para": kind, "modified": f"{at:%Y-%m-%dT%H:%M}"})
    staged = source.with_name(f".{source.name}.filed")
    staged.write_text(new, encoding="utf-8", newline="\n")
    os.replace(staged, source)
    os.replace(source, target)
    return path, relative(root, str(target))


def relative(root: str, path: str) -> str:
    """A note's path under the root, also of a name that leads there by links; the file itself may be gone."""
    p = Path(path)
    if not p.is_absolute():
        return path
    if p.is_relative_to(root):
        return p.relative_to(root).as_posix()
    real = Path(os.path.realpath(p.parent), p.name)
    return real.relative_to(os.path.realpath(root)).as_posix() if real.is_relative_to(os.path.realpath(root)) else path


def outside(target: str, root: str) -> str:
    """A place for derived output; ValueError when it is inside the notes, or is a link."""
    t, r = os.path.realpath(target), os.path.realpath(root)
    if t == r or t.startswith(r + os.sep) or os.path.islink(target):
        raise ValueError("derived output must be outside the notes")
    return t
