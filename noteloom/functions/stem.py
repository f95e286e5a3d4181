"""English stemming after the published description of the Porter2 algorithm.

Applied to the table of different terms, never to every occurrence.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The endings, exceptions and invariants that the description lists.
_EXCEPT = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = frozenset(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
_KEPT = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_V = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    """Starts of the regions after the first, and after the second, vowel and consonant."""
    def after(start: int) -> int:
        m = re.compile(rf"[{_V}][^{_V}]").search(w, start)
        return m.end() if m else len(w)

    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(rf"[{_V}][^{_V}]", w))


def stem(word: str) -> str:
    """The stem of one lower-case word; words with characters other than a to z and ' stay as they are."""
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    w = word.removeprefix("'")
    if w in _EXCEPT:
        return _EXCEPT[w]
    if w in _SAME:
        return w
    w = re.sub(rf"(?<=[{_V}])y|^y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("'s'$|'s$|'$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # past and present participles
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if re.search(rf".[^{_V}][yY]$", w):
        w = w[:-1] + "i"
    # derivational endings, the longest that fits
    def ending(table: dict[str, str], start: int) -> None:
        nonlocal w
        for e in sorted(table, key=len, reverse=True):
            if w.endswith(e):
                if len(w) - len(e) >= start:
                    w = w[: len(w) - len(e)] + table[e]
                return

    if w.endswith("ogi"):
        if len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
    elif w.endswith("li") and not w.endswith(tuple(_STEP2)):
        if len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    else:
        ending(_STEP2, r1)
    if w.endswith("ative"):
        if len(w) - 5 >= r2:
            w = w[:-5]
    else:
        ending(_STEP3, r1)
    for e in _STEP4:
        if w.endswith(e):
            if len(w) - len(e) >= r2:
                w = w[: len(w) - len(e)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")
