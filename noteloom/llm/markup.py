"""Markup residue in texts: which languages a text holds, and clean text with its structure kept (problem 3).

The method first named for this problem, template deduction from tokens with equal occurrence vectors over pages of
one host, finds what pages share. The residue here stands once, anywhere in a sentence, in notes that share no
template, so its occurrence vectors are all different and no class forms. It is found by the grammar of each
language instead: one regular expression per language over the text outside fenced blocks, JVM-side, with formulas
and file paths set aside where their characters would be mistaken.

Defined results: null or empty texts hold nothing and stay as they are; fenced blocks and formulas between dollar
signs are untouched; an unclosed tag, comment or emphasis mark is left as it stands, except that a known HTML tag
counts and goes on its own, also one that was escaped. Repeated rows give one row.
"""

from __future__ import annotations

import html

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .splitting import FENCE

#: Element names of HTML, and attributes that stand without a value.
ELEMENTS = (
    "a abbr acronym address article aside audio b big blockquote body br button canvas caption center cite code col colgroup dd del details dfn "
    "dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input "
    "ins kbd label legend li link main map mark menu meta nav noscript object ol optgroup option p param picture pre q s samp script section "
    "select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
BARE = "async|autofocus|checked|controls|defer|disabled|hidden|multiple|nowrap|readonly|required|reversed|selected"

_ATTR = rf"(?:\s+(?:[A-Za-z_:][-\w:.]*\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+)|(?:{BARE})(?=[\s/>])))*+"
TAG = rf"(?i:</?(?:{'|'.join(ELEMENTS)}){_ATTR}\s*/?>)"
COMMENT = r"<!--[\s\S]*?-->"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
HTML = rf"{COMMENT}|{TAG}|{REFERENCE}"

_W = r"\p{L}\p{N}"
#: Marks inside one paragraph; repetitions are of single characters, which Java runs as loops whatever the length.
STAR = rf"(?<![{_W}_*\\])\*{{1,3}}(?=[^\s*])[^*]*?(?<=[^\s*])\*{{1,3}}(?![{_W}_*])"
STAR_CJK = r"(?<![\w*\\])\*{2,3}(?=[^\s*])[^*\n]*?(?<=[^\s*])\*{2,3}(?![\w*])"
INNER = rf"(?<=[{_W}])_(?=[{_W}])"
UNDER = rf"(?<![{_W}_\\/.])_{{1,3}}(?=[^\s_])[^_]*?(?<=[^\s_])_{{1,3}}(?![{_W}_]|\.[A-Za-z])"
STRIKE = r"(?<!~)~~(?=[^\s~])[^~]*?(?<=[^\s~])~~(?!~)"
CODE = r"(?<!`)(?:`(?!`)[^`]+`(?!`)|``(?!`)[\s\S]+?(?<!`)``(?!`))"
LINK = r"(?<![\w\])])!?\[[^\[\]\n]*\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)"
LINK_REF = r"(?<![\w\])\[])!?\[[^\[\]\n^][^\[\]\n]*\]\[[^\[\]\n]*\]"
LINK_DEF = r"(?m:^ {0,3}\[[^\[\]\n^][^\[\]\n]*\]:[ \t]+\S+)"
AUTO = r"<(?:https?|ftp|mailto):[^\s<>]+>"
NOTE = r"\[\^[\p{L}\p{N}_-]+\]"
MD_TABLE = r"(?m:^[ \t]*\|?[^|\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-+:?[ \t]*\|[ \t|:\-\r]*$)"
MARKS = "|".join((STAR, STAR_CJK, STRIKE, CODE))
MARKDOWN = "|".join((LINK, LINK_REF, LINK_DEF, AUTO, NOTE, MD_TABLE))

WIKI_LINK = r"\[\[[^\[\]\n]+\]\]"
TEMPLATE = r"\{\{[^{}]+\}\}"
WIKI_TABLE = r"(?m:^[ \t]*\{\|)"
APOS = r"(?<![\w'])'{2,5}(?=[^\s'])[\s\S]*?(?<=[^\s'])'{2,5}(?!')"
WIKI_HEAD = r"(?m:^[ \t]*(={2,6})(?!=)[ \t]*[^=\n][^\n]*?[ \t]*\1(?!=)[ \t\r]*$)"
WIKI = "|".join((WIKI_LINK, TEMPLATE, WIKI_TABLE))

FORMULA = r"\$\$[\s\S]*?\$\$|(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\$])\$(?![\w$])"
PATHS = r"(?<![A-Za-z0-9])[A-Za-z]:\\[^\s]*|\\\\[A-Za-z0-9_.-]+\\[^\s]*"
LATEX = r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|\\[A-Za-z]{2,}\*?(?![A-Za-z\\])"

LANGUAGES = ("html", "markdown", "wiki", "latex")


def languages(text: Column) -> Column:
    """The languages of LANGUAGES that hold a construct in the text, fenced blocks aside."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), FENCE, "\n")
    plain = F.regexp_replace(rest, FORMULA, " ")
    # emphasis doesn't reach over a blank line; its marks are looked for only where there are any
    paragraphs = lambda t: F.split(t, r"\n[ \t\r]*\n")
    inside = lambda t, sign, p: F.contains(t, F.lit(sign)) & F.exists(paragraphs(t), lambda x: x.rlike(p))
    holds = (
        rest.rlike(HTML),
        rest.rlike(MARKDOWN) | (rest.rlike("[*`]|~~") & F.exists(paragraphs(rest), lambda x: x.rlike(MARKS))) | inside(F.regexp_replace(plain, INNER, ""), "_", UNDER),
        rest.rlike(WIKI) | rest.rlike(WIKI_HEAD) | inside(rest, "''", APOS),
        F.regexp_replace(plain, PATHS, " ").rlike(LATEX),
    )
    return F.filter(F.array(*[F.when(h, F.lit(n)) for n, h in zip(LANGUAGES, holds, strict=True)]), lambda x: x.isNotNull())


def residue(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(key, markup): one row per language that any of the texts of a row holds."""
    d = df.where(F.col(key).isNotNull())
    found = F.array_distinct(F.flatten(F.array(*[languages(F.col(t)) for t in texts])))
    return d.select(key, F.explode(found).alias("markup")).distinct()


_CLEANING = regex.compile(r"[<&*_~`\[{\\|]|''|^[ \t]*==", regex.M)
_SEGMENT = regex.compile(rf"({FENCE}|{FORMULA})")
_INLINE = {k: regex.compile(v) for k, v in {"star": STAR, "star2": STAR_CJK, "under": UNDER.replace("[^_]*?", rf"(?:[^_]|{INNER})*?"), "strike": STRIKE, "apos": APOS, "code": CODE}.items()}
_BLANK = regex.compile(r"(\n[ \t\r]*\n)")


def _marks(t: str, name: str, sign: str) -> str:
    """One kind of mark taken off, paragraph by paragraph."""
    if sign not in t:
        return t
    return "".join(_INLINE[name].sub(lambda m: m[0].strip(sign), p) for p in _BLANK.split(t))
_NAMES = {"textemdash": "—", "textendash": "–", "ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "quad": " ", "newline": "\n", "par": "\n\n"}


def _html(t: str) -> str:
    t = regex.sub(COMMENT, "", t)
    t = regex.sub(r"(?i)<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?([\s\S]*?)(?:</code>)?\s*</pre>", lambda m: "\n```\n" + m[1].strip("\n") + "\n```\n", t)
    t = regex.sub(rf"(?i)<h([1-6]){_ATTR}\s*>([\s\S]*?)</h\1\s*>", lambda m: "\n" + "#" * int(m[1]) + " " + m[2].strip() + "\n", t)
    t = regex.sub(rf"(?i)<li{_ATTR}\s*>", "\n- ", t)
    t = regex.sub(r"(?i)</t[dh]>\s*<t[dh]\b[^<>]*>", " | ", t)
    t = regex.sub(r"(?i)<br\s*/?>|</(?:tr|ul|ol|table)>", "\n", t)
    t = regex.sub(r"(?i)</?(?:p|div|blockquote|section|article)\b[^<>]*>", "\n", t)
    t = regex.sub(rf"(?i)<code{_ATTR}\s*>([^<]*)</code>", r"\1", t)
    t = regex.sub(rf"(?i)<img{_ATTR}\s*/?>", lambda m: (regex.search(r"(?i)\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m[0]) or [""] * 3)[1] or "", t)
    was = None
    while t != was:  # tags that were escaped come out of references; both shorten the text
        was = t
        t = regex.sub(REFERENCE, lambda m: html.unescape(m[0]), regex.sub(TAG, "", t))
    return t


def _wiki(t: str) -> str:
    t = regex.sub(WIKI_HEAD, lambda m: "#" * len(m[1]) + " " + m[0].strip().strip("=").strip(), t)
    t = regex.sub(r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\]", "", t)
    t = regex.sub(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]+)\]\]", r"\1", t)
    n = 1
    while n:  # templates inside templates; each round shortens the text
        t, n = regex.subn(TEMPLATE, "", t)
    rows = lambda m: "\n".join(" | ".join(c.strip() for c in r.strip().lstrip("|!").split("||")) for r in regex.split(r"\n\|-[^\n]*", m[1])[1:] if r.strip())
    t = regex.sub(r"(?m)^[ \t]*\{\|([\s\S]*?)\n[ \t]*\|\}", rows, t)
    return _marks(t, "apos", "'")


def _latex(t: str) -> str:
    heads = {"section": "#", "subsection": "##", "subsubsection": "###", "paragraph": "####", "chapter": "#"}
    t = regex.sub(r"\\begin\{equation\*?\}([\s\S]*?)\\end\{equation\*?\}", lambda m: "$$" + m[1].strip() + "$$", t)
    t = regex.sub(r"\\(" + "|".join(heads) + r")\*?\{([^{}]*)\}", lambda m: heads[m[1]] + " " + m[2], t)
    t = regex.sub(r"\\item\b[ \t]*", "- ", t)
    t = regex.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?[ \t]*\n?", "", t)
    t = regex.sub(r"~?\\(?:cite[pt]?|ref|eqref|label|pageref)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", t)
    t = regex.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", t)
    n = 1
    while n:  # commands inside commands
        t, n = regex.subn(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", lambda m: _NAMES.get(regex.match(r"\\([A-Za-z]+)", m[0])[1], m[1]), t)
    t = regex.sub(r"(?<![\w:\\])\\([A-Za-z]{2,})\*?(?![A-Za-z\\])[ \t]?", lambda m: _NAMES.get(m[1], ""), t)
    return regex.sub(r"\\([%&#_{}$])", r"\1", t)


def _markdown(t: str) -> str:
    t = regex.sub(LINK_DEF, "", t)
    t = regex.sub(LINK, lambda m: regex.search(r"\[([^\[\]\n]*)\]", m[0])[1], t)
    t = regex.sub(LINK_REF, lambda m: regex.search(r"\[([^\[\]\n]*)\]", m[0])[1], t)
    t = regex.sub(AUTO, lambda m: m[0][1:-1], t)
    t = regex.sub(r"(?m)^" + NOTE + r":[ \t]*", "", t)
    t = regex.sub(NOTE, "", t)
    t = regex.sub(r"(?m)^[ \t]*\|[ \t]*:?-+:?[ \t]*\|[ \t|:\-\r]*\n?", "", t)
    t = _marks(t, "code", "`")
    was = None
    while t != was:  # marks inside marks
        was = t
        for k, c in (("star", "*"), ("star2", "*"), ("under", "_"), ("strike", "~")):
            t = _marks(t, k, c)
    return t


def _clean(text: str | None) -> str | None:
    if not text or not _CLEANING.search(text):
        return text
    out = []
    for i, part in enumerate(_SEGMENT.split(text)):
        if i % 2:
            out.append(part)
            continue
        part = _latex(_wiki(_html(part)))
        out.append("".join(p if j % 2 else _markdown(p) for j, p in enumerate(_SEGMENT.split(part))))
    return regex.sub(r"\n{3,}", "\n\n", "".join(out))


@F.pandas_udf(StringType())
def cleaned(texts: pd.Series) -> pd.Series:
    """The text without its markup; headings, lists, tables' cells, code blocks and formulas stay, in Markdown form."""
    return texts.map(_clean, na_action="ignore")


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with <column>_clean for each of the columns."""
    return df.withColumns({f"{c}_clean": cleaned(F.col(c)) for c in columns})


def kept(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, clean, blocks_kept, formulas_kept): whether the cleaned columns hold no construct, and all fenced blocks and formulas of the first."""
    d = clean(df, columns)
    first, after = F.coalesce(F.col(columns[0]), F.lit("")), F.coalesce(F.col(f"{columns[0]}_clean"), F.lit(""))
    # what stands in a formula is the formula's
    left = F.flatten(F.array(*[languages(F.regexp_replace(F.col(f"{c}_clean"), FORMULA, " ")) for c in columns]))
    outside = F.regexp_replace(first, FENCE, "\n")
    held = lambda t, p: F.forall(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda b: F.contains(after, b))
    return d.select(key, (F.size(left) == 0).alias("clean"), held(first, FENCE).alias("blocks_kept"), held(outside, FORMULA).alias("formulas_kept"))
