"""Notes to chunks: heading-aware, bounded in size, code kept whole.

A note is read as blocks (headings, fenced or indented code, paragraphs) by one scan over its lines. Headings of
level 1 to 3 open a section and make its breadcrumb; lower ones are text. A section's paragraphs are packed up to
the budget, with the end of the last piece repeated at the front of the next one; a code block is never cut. A
section without text is kept under its own heading only where no section below it carries the same breadcrumb. Fields
of other producers come last, as chunks of kind 1. A chunk's id is the hash of its path and its number in the note.

Defined results: null, empty and blank notes have no chunk; a title alone is one chunk with the title as its body;
a frontmatter block that never closes is plain text; raw HTML blocks and link definitions are not text; adjoining
list items are lines of one paragraph.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter

BUDGET, OVERLAP, PER_TOKEN = 900, 128, 3.5
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:\s*\S+")
_BULLET = re.compile(r"^\s{0,3}(?:[-*+]|\d{1,9}[.)])[ \t]+")
_HTML = re.compile(r" {0,3}<(?:!--|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_INLINE = re.compile(r"!?\[([^\[\]]*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+\"[^\"]*\")?\)|(`+)(.+?)\2|(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=\S)\4|<[A-Za-z/][^<>]*>", re.S)


def estimated(text: str) -> int:
    return math.ceil(len(text) / PER_TOKEN)


def plain(text: str) -> str:
    """Inline marks taken off; what they mark stays."""
    while True:
        out = _INLINE.sub(lambda m: m[1] if m[1] is not None else m[3] if m[3] is not None else m[5] if m[5] is not None else "", text)
        if out == text:
            return out
        text = out


@dataclass
class Section:
    """A breadcrumb and its blocks: (is code, text)."""

    crumb: tuple[str, ...]
    blocks: list[tuple[bool, str]] = field(default_factory=list)

    @property
    def heading_path(self) -> str:
        return " > ".join(t for t in self.crumb if t)


def body_of(text: str) -> str:
    inner = frontmatter.block(text)
    return text if inner is None else "\n".join(text.split("\n")[len(inner) + 2 :])


def sections(text: str) -> list[Section]:
    """The blocks of a note by section."""
    out, levels = [Section(())], []
    para: list[str] = []

    def close() -> None:
        joined = plain("\n".join(para)).strip()
        if joined:
            out[-1].blocks.append((False, joined))
        para.clear()

    def heading(level: int, title: str) -> None:
        close()
        if level > 3:
            if title:
                out[-1].blocks.append((False, title))
            return
        while levels and levels[-1][0] >= level:
            levels.pop()
        levels.append((level, title))
        out.append(Section(tuple(t for _, t in levels)))

    lines = body_of(text).replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if m := _FENCE.match(line):
            close()
            mark, code = m[1], []
            while i < len(lines) and not re.fullmatch(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*", lines[i]):
                code.append(lines[i])
                i += 1
            i += 1
            if any(c.strip() for c in code):
                out[-1].blocks.append((True, "\n".join(code).rstrip()))
        elif not line.strip():
            close()
        elif m := _ATX.match(line):
            heading(len(m[1]), plain(m[2] or "").strip())
        elif para and (m := re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line)) and not _BULLET.match(para[-1]):
            title = plain(" ".join(x.strip() for x in para)).strip()
            para.clear()
            heading(1 if m[1][0] == "=" else 2, title)
        elif _RULE.match(line):
            close()
        elif not para and line.startswith(("    ", "\t")):
            code = [line]
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                code.append(lines[i])
                i += 1
            out[-1].blocks.append((True, "\n".join(c[4:] if c.startswith("    ") else c.lstrip("\t") for c in code).rstrip()))
        elif not para and (_DEFINITION.match(line) or _HTML.match(line)):
            if _HTML.match(line):  # an HTML block ends at a blank line
                while i < len(lines) and lines[i].strip():
                    i += 1
        else:
            para.append(_BULLET.sub("", re.sub(r"^ {0,3}>[ ]?", "", line)).strip())
    close()
    return out


def words_cut(text: str, budget: int) -> list[str]:
    """A long paragraph as runs of words within the budget; a single longer word by characters."""
    most = max(1, int(budget * PER_TOKEN))
    out, run = [], ""
    for w in text.split():
        if estimated(w) > budget:
            out += [run] if run else []
            run = ""
            out += [w[k : k + most] for k in range(0, len(w), most)]
        elif run and estimated(run) + estimated(w) + 1 > budget:
            out.append(run)
            run = w
        else:
            run = f"{run} {w}" if run else w
    return [*out, run] if run else out


def tail(text: str) -> str:
    """The end of a piece that the next one repeats, begun after white space."""
    n = int(OVERLAP * PER_TOKEN)
    if len(text) <= n:
        return text
    end = text[-n:]
    m = re.search(r"\s", end)
    return end[m.start() :].lstrip() if m else end


def packed(blocks: list[tuple[bool, str]], budget: int = BUDGET) -> list[str]:
    """Bodies of a section."""
    units: list[str] = []
    for code, text in blocks:
        units += [text] if code or estimated(text) <= budget else words_cut(text, budget)
    out: list[str] = []
    again, held = "", []

    def emit() -> None:
        nonlocal again, held
        if held:
            out.append("\n\n".join(x for x in (again.strip(), "\n\n".join(held).strip()) if x))
            again, held = tail(out[-1]), []

    for u in units:
        large = estimated(u) > budget
        if large or estimated(again) + estimated("\n\n".join(held)) + estimated(u) > budget:
            emit()
        held.append(u)
        if large:
            emit()
    emit()
    return out


def chunks_of(path: str, text: str | None) -> list[tuple[str, int, int, str, str]]:
    """(id, ord, kind, heading_path, body) of one note."""
    if not text or not text.strip():
        return []
    parts = sections(text)
    crumbs = [s.crumb for s in parts if s.crumb]
    out: list[tuple[int, str, str]] = []
    for s in parts:
        bodies = [b for b in (x.strip() for x in packed(s.blocks)) if b]
        if not bodies and s.crumb and s.crumb[-1] and not any(len(c) > len(s.crumb) and c[: len(s.crumb)] == s.crumb for c in crumbs):
            bodies = [s.crumb[-1]]
        out += [(0, s.heading_path, b) for b in bodies]
    for f in frontmatter.parse(text)["fields"]:
        out += [(1, f"Frontmatter > {f['key']}", b) for b in packed([(False, f["search_text"])])]
    return [(hashlib.sha256(f"{path}#{n}".encode()).hexdigest(), n, kind, heading, body) for n, (kind, heading, body) in enumerate(out)]


SCHEMA = "id string, path string, ord int, kind tinyint, heading_path string, body string"


def chunked(notes: DataFrame, path: str = "path", content: str = "content", carry: list[str] | None = None) -> DataFrame:
    """SCHEMA and the columns in carry: the chunks of every note, with no shuffle."""
    carry = carry or []
    types = {f.name: f.dataType.simpleString() for f in notes.schema}
    schema = ", ".join([SCHEMA, *[f"`{c}` {types[c]}" for c in carry]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for i, (p, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                for c in chunks_of(p, t) if p is not None else []:
                    rows.append((c[0], p, *c[1:]))
                    at.append(i)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int8(), pa.string(), pa.string())
            arrays = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*arrays, *[b.column(2 + j).take(take) for j in range(len(carry))]], names=["id", "path", "ord", "kind", "heading_path", "body", *carry])

    return notes.select(F.col(path).alias("path"), F.col(content).alias("content"), *carry).mapInArrow(scan, schema)
