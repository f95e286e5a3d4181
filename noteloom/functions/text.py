"""Scalar functions on texts and paths, as column expressions (no Python in the plan)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four kinds of note and the folders they live in.
FOLDERS = {"inbox": "00-Inbox", "project": "10-Projects", "area": "20-Areas", "resource": "30-Resources", "archive": "40-Archive"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[\p{L}\p{N}]+"


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only, unlike lower(), which is Unicode's."""
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null for null."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def estimated_tokens(c: Column) -> Column:
    """Code points over 3.5, rounded up."""
    return F.ceil(F.length(c) / F.lit(3.5))


def snippet(c: Column, size: int = 200) -> Column:
    """White space collapsed, at most size code points, with an ellipsis where something is cut."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.left(flat, F.lit(size)), F.lit("…"))).otherwise(flat)


def truncated(c: Column, width: int) -> Column:
    """At most width code points, the last an ellipsis where something is cut."""
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(max(width - 1, 0))), F.lit("…"))).otherwise(c)


def slug(c: Column) -> Column:
    """ASCII letters and digits in lower case, other runs as one hyphen, trimmed, then 40 long; note when empty."""
    s = F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-")
    s = F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(40))
    return F.when(s == "", "note").otherwise(s)


def bucket(path: Column) -> Column:
    """The first part of a path with more than one part, else nothing."""
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("")


def folder_of(kind: Column) -> Column:
    return reduce(lambda c, kv: c.when(ascii_lower(kind) == kv[0], kv[1]), FOLDERS.items(), F.when(F.lit(False), ""))


def kind_of(folder: Column) -> Column:
    return reduce(lambda c, kv: c.when(folder == kv[1], kv[0]), FOLDERS.items(), F.when(F.lit(False), ""))


def parent_folder(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def short_title(path: Column) -> Column:
    """The file's name without .md and without a leading YYYYMMDD-HHMMSS- stamp, if more than the stamp is there."""
    name = F.regexp_replace(file_name(path), r"\.md$", "")
    return F.when(F.octet_length(name) > 16, F.regexp_replace(name, r"^\d{8}-\d{6}-", "")).otherwise(name)


def leaf_heading(heading_path: Column) -> Column:
    return F.element_at(F.split(heading_path, " > "), -1)


def note_title(path: Column, body: Column) -> Column:
    """The first level-one heading's text, else the file's name without its extension."""
    found = F.trim(F.regexp_extract(body, r"(?m)^# (.*)$", 1))
    return F.when(found != "", found).otherwise(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))


def note_text(body: Column, size: int = 800) -> Column:
    """The first size code points of a note without its frontmatter."""
    return F.left(without_frontmatter(body), F.lit(size))


def without_frontmatter(text: Column) -> Column:
    """A leading block between lines of three hyphens is taken off; one that never closes stays."""
    return F.regexp_replace(text, r"\A---\r?\n(?:(?!---\s*(?:\n|\z))[^\n]*\n)*+---[^\S\n]*(?:\r?\n|\z)", "")


def human_size(n: Column) -> Column:
    """Bytes with a binary unit and one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, u in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {u}", n.cast("double") / float(1024**i))).otherwise(out)
    return out


def owned_path(path: Column) -> Column:
    """Whether a path is relative, normal and a Markdown note: no empty, dot or parent parts, no leading slash."""
    return path.rlike(r"^(?!/)(?:(?!\.{1,2}(?:/|$))[^/\x00]+/)*+(?!\.{1,2}$)[^/\x00]+\.md$")


def producer_key(key: Column) -> Column:
    """A field name that a producer may add: the grammar, and none of the lifecycle fields."""
    #: Fields of the note's own lifecycle.
    return key.rlike("^[A-Za-z_][A-Za-z0-9_-]*$") & ~key.isin("created", "status", "source", "para", "modified", "title")
