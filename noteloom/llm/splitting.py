"""Splitting oversized texts at natural boundaries (problem 5).

One regular expression with bounded quantifiers takes a text apart from left to right. Its alternatives are ordered
by the strength of the boundary that ends a piece: before a heading or a fenced block, after one, a blank line, a
line end, the end of a sentence, white space, and any character as the last resort. Each alternative consumes up to
the limit and gives back only as far as half of it, so a strong boundary isn't bought with a tiny piece. A whole
fenced block that fits into the limit is one unit, taken before anything else and never cut. Neighbouring units are
put together while they fit, and overlaps are taken by looking back from the cut. All of it is JVM-side:
regexp_extract_all and array functions. A text becomes one array of its pieces, and that is what is exploded: the text
itself isn't copied into the rows of its pieces.

Lengths are in code points; a token is 3.5 of them. Defined results: null text gives no piece, an empty or blank one
gives none either; a text within the limit is one piece, unchanged; the pieces' own parts, in order, are exactly
the text. Repeated rows give repeated pieces. Columns whose names clash with those of the pieces are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5
LIMIT_TOKENS = 900
OVERLAP_TOKENS = 128

#: A fenced block: from a line that starts with three backticks to the next line of three backticks alone.
#: The repetition is possessive, which Java runs as a loop: a plain one would take a stack frame per line.
FENCE = r"(?<![^\n])```[^\n]*\n(?:(?!```[ \t\r]*(?:\n|\z))[^\n]*\n)*+```[ \t\r]*(?=\n|\z)"
PIECE = ("piece_no", "piece", "piece_own", "overlap_chars")


def chars(tokens: int) -> int:
    return int(tokens * CHARS_PER_TOKEN)


def pattern(limit: int) -> str:
    """Pieces of 1 to limit characters; alternatives by the strength of the boundary."""
    low, any_ = limit // 2, r"[\s\S]"
    strong = [
        rf"{any_}{{{low},{limit}}}(?=\n#{{1,6}} |\n```|\z)",
        rf"{any_}{{{low},{limit}}}(?<=\n```)(?=\r?\n)",
        rf"{any_}{{{low},{limit}}}(?<=\n\r?\n)",
        rf"{any_}{{{low},{limit}}}(?<=\n)",
        rf"{any_}{{{low},{limit}}}(?<=[.!?…。！？][\"'”’)\]]?\s|[。！？])",
        rf"{any_}{{{low},{limit}}}(?<=\s)",
    ]
    return rf"{any_}{{1,{limit}}}\z|" + "|".join(strong) + rf"|{any_}{{1,{limit}}}"


def _unit(t: Column, fence: Column, cut: Column) -> Column:
    return F.struct(t.alias("t"), fence.alias("fence"), cut.alias("cut"))


def units(text: Column, limit: int, room: int) -> Column:
    """(t, fence, cut): fenced blocks of up to limit characters, and what else there is in units of at most room.

    fence: the unit is of a fenced block. cut: the unit follows one of the same stretch or block.
    """
    around, blocks = F.split(text, FENCE, -1), F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))

    def apart(t: Column, fence: bool, most: int) -> Column:
        small = F.array(_unit(t, F.lit(fence), F.lit(False)))
        parts = F.transform(F.regexp_extract_all(t, F.lit(pattern(room)), F.lit(0)), lambda p, i: _unit(p, F.lit(fence), i > 0))
        return F.when(F.length(t) <= most, small).otherwise(parts)

    mixed = F.transform(F.arrays_zip(around.alias("a"), blocks.alias("b")), lambda x: F.concat(apart(F.coalesce(x["a"], F.lit("")), False, room), apart(F.coalesce(x["b"], F.lit("")), True, limit)))
    return F.filter(F.flatten(mixed), lambda u: F.length(u["t"]) > 0)


def packed(parts: Column, room: int) -> Column:
    """The texts of the pieces, in order: neighbouring units joined while they fit together."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, u: Column) -> Column:
        fits = (F.length(acc["open"]) + F.length(u["t"]) <= room) | (acc["open"] == "")
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, F.concat(acc["open"], u["t"])).otherwise(u["t"]).alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def overlapped(pieces: Column, limit: int, over: int) -> Column:
    """(piece_no, piece, piece_own, overlap_chars) of each piece. Two neighbours hold more than an overlap, so looking back ends there."""

    def one(own: Column, i: Column) -> Column:
        before = F.concat(F.when(i > 1, F.element_at(pieces, i - 1)).otherwise(F.lit("")), F.when(i > 0, F.element_at(pieces, i)).otherwise(F.lit("")))
        take = F.least(F.lit(over), F.lit(limit) - F.length(own))
        back = F.when(i > 0, F.right(before, take)).otherwise(F.lit(""))
        # the look-back began inside a word unless the character before it is white space
        inside = (F.length(before) > take) & ~F.substring(before, F.length(before) - take, F.lit(1)).rlike(r"^\s")
        back = F.when(take <= 0, "").when(inside & back.rlike(r"\s"), F.regexp_replace(back, r"^\S*\s+", "")).otherwise(back)
        return F.struct(i.alias("piece_no"), F.concat(back, own).alias("piece"), own.alias("piece_own"), F.length(back).alias("overlap_chars"))

    return F.transform(pieces, one)


def _room(limit_tokens: int, overlap_tokens: int) -> tuple[int, int, int]:
    limit, over = chars(limit_tokens), chars(overlap_tokens)
    if not 0 <= over < limit // 2:
        raise ValueError("an overlap must be shorter than half of the limit")
    # all pieces but fenced blocks leave room for an overlap; only a text that fits as a whole takes the whole limit
    return limit, over, limit - over


def split(df: DataFrame, text: str, limit_tokens: int = LIMIT_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """df's rows without the text, one per piece: piece_no (from 0), piece (with its overlap), piece_own (without it), overlap_chars.

    A piece with its overlap has at most the limit. The overlap is the end of the text before the piece, at most
    overlap_tokens long, moved forward to begin after white space; a run without white space is cut as it is. A
    fenced block that all but fills the limit takes what overlap is left.
    """
    limit, over, room = _room(limit_tokens, overlap_tokens)
    t, none = F.col(text), F.expr("cast(array() as array<string>)")
    pieces = F.when(F.length(F.trim(t)) == 0, none).when(F.length(t) <= limit, F.array(t)).otherwise(packed(units(t, limit, room), room))
    keep = [c for c in df.columns if c != text and c not in PIECE]
    d = df.where(F.col(text).isNotNull()).select(*keep, pieces.alias("__p"))
    return d.select(*keep, F.explode(overlapped(F.col("__p"), limit, over)).alias("__x")).select(*keep, "__x.*")


def oversized(df: DataFrame, key: str, text: str, limit_tokens: int = LIMIT_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """(key, cut) of the texts that ``split`` cuts, by what it had to cut: fence, run or plain, as TESTDATA.md has them.

    No piece is over the limit, so every text over it comes in several. The units tell the rest: a fenced block over the limit comes in several, and a cut between two characters that aren't
    white space may lie in an unbroken run over the limit, whose length is then checked in the text.
    """
    limit, _, room = _room(limit_tokens, overlap_tokens)
    d = df.where(F.col(key).isNotNull() & (F.length(F.col(text)) > limit)).select(key, text)
    d = d.withColumn("__u", units(F.col(text), limit, room))
    u = F.col("__u")
    fence = F.exists(u, lambda x: x["fence"] & x["cut"])
    tight = lambda x, i: x["cut"] & ~x["fence"] & x["t"].rlike(r"^\S") & F.element_at(u, i)["t"].rlike(r"\S\z")
    inside = F.exists(F.transform(u, lambda x, i: F.when(i > 0, tight(x, i)).otherwise(F.lit(False))), lambda x: x)
    # what is left of a fenced block is a line end, so that runs don't grow together over it
    run = inside & F.regexp_replace(F.col(text), FENCE, "\n").rlike(rf"\S{{{limit + 1}}}")
    return d.select(key, F.when(fence, "fence").when(run, "run").otherwise("plain").alias("cut")).distinct()


def kept(df: DataFrame, key: str, text: str, limit_tokens: int = LIMIT_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """(key, n_chars, n_fences, within, in_order, overlaps_fit): what holds of the pieces of every text, rejoined.

    n_chars and n_fences are those of the pieces' own parts put together and of fenced blocks of up to the limit that
    lie in one piece; within: no piece is over the limit; overlaps_fit: each overlap is the end of the text before.
    """
    limit = chars(limit_tokens)
    d = split(df.select(key, text), text, limit_tokens, overlap_tokens)
    all_ = F.array_sort(F.collect_list(F.struct(*PIECE)))
    blocks = F.regexp_extract_all(F.col("piece_own"), F.lit(FENCE), F.lit(0))
    d = d.withColumn("__f", F.size(F.filter(blocks, lambda b: F.length(b) <= limit)))
    g = d.groupBy(key).agg(all_.alias("p"), F.sum("__f").alias("n_fences"), F.max(F.length("piece")).alias("most"))
    ok = F.forall(F.transform(F.col("p"), lambda x, i: (x["piece_no"] == i) & ((i == 0) | F.endswith(F.concat(F.when(i > 1, F.element_at("p", i - 1)["piece_own"]).otherwise(F.lit("")), F.when(i > 0, F.element_at("p", i)["piece_own"]).otherwise(F.lit(""))), F.left(x["piece"], x["overlap_chars"])))), lambda x: x)
    order = F.forall(F.transform(F.col("p"), lambda x, i: x["piece_no"] == i), lambda x: x)
    whole = F.array_join(F.transform("p", lambda x: x["piece_own"]), "")
    return g.select(key, F.length(whole).cast("long").alias("n_chars"), F.col("n_fences").cast("long").alias("n_fences"), (F.col("most") <= limit).alias("within"), order.alias("in_order"), ok.alias("overlaps_fit"))
