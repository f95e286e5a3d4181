"""Text that was decoded with the wrong character encoding (problem 10), as a noisy channel.

A channel is the pair (encoding that was used, encoding that should have been used), once or, for UTF-8, several
times. The words with non-ASCII characters of a text are the observations of a hidden Markov model whose states are
"as it was written" and one per channel. Going back through a channel turns a word into bytes and the bytes into
the word that was meant; a lost byte (U+FFFD) is a wildcard in that lattice and stands for every byte that the
encoding that was used doesn't define, or for any character where the text was read as UTF-8. Through such a lattice
the most frequent known word that fits is taken, else the likeliest path by characters, found by Viterbi search
whatever the number of lost bytes. The words that come out are weighed by their frequency in the whole
corpus, and Viterbi search finds the likeliest states; changing the state costs, since damage covers a text or one
passage of it, not single words here and there.

The corpus statistics are counts of words over all texts, combined before the shuffle. Of them the most frequent
words (by default 200,000, some 10 MB) are broadcast, a bound that doesn't grow with the data. Where there are more,
the texts are judged in blocks: a block asks for the words that it lacks, gets their counts by a join, and is judged
again, until it asks nothing. So every count that a verdict rests on is exact, as are the totals.

Defined results: null and empty texts, and texts in ASCII, are whole. A text that holds U+FFFD is damaged and its
``lossy`` is 1. Where a lost character can't be told, U+FFFD stays. Repeated rows are judged alike.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Encodings that were used wrongly, and those that texts had.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp866", "iso8859-15")
MEANT = ("utf-8", "cp1252", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "shift_jis", "euc_jp", "iso8859-5")
DOUBLE_BYTE = ("shift_jis", "euc_jp")
LOST = "�"
#: Costs in nats: to begin damage, to end it, and what a valid UTF-8 sequence is worth, which chance hardly gives.
BEGIN, END, UTF8_WORTH = 8.0, 2.0, 5.0
LEAST_GAIN = 1.0
#: Words of so few sightings are judged by their characters.
RARE = 2
#: Texts of a block are 2 ** BLOCK; slots of the filter of all words, which only saves questions.
BLOCK, SLOTS = 11, 1 << 24

TOKEN = re.compile(r"[^\t\n\r\f\v ]*[^\x00-\x7f][^\t\n\r\f\v ]*")
#: Characters that are written without spaces between words; each counts on its own.
_SINGLE = "\u3000-\u30ff\u3400-\u9fff\uff00-\uffef"
_RUN = rf"[{_SINGLE}]|(?:(?![{_SINGLE}])(?:[A-Za-z]|[^\x00-\x7f]))+"
_PIECE = re.compile(_RUN)
_LOST_WORD = re.compile(rf"((?:(?![{_SINGLE}])[^\W\d_])*{LOST}(?:(?![{_SINGLE}])[^\W\d_]|{LOST})*)")


def pieces(token: str) -> list[str]:
    """What the model counts: runs of letters and non-ASCII signs with one of the latter, and East Asian characters."""
    return [p for p in _PIECE.findall(token) if not p.isascii()]


@lru_cache(4_096)
def _bytes(token: str, enc: str) -> list[int] | None:
    """The bytes of a token as read by enc; -1 for a lost byte. None where enc has no such character."""
    if LOST not in token:
        try:
            return list(token.encode(enc))
        except UnicodeEncodeError:
            pass
    out: list[int] = []
    for ch in token:
        o = ord(ch)
        if o < 128:
            out.append(o)
        elif ch == LOST:
            out.append(-1)
        else:
            try:
                out.append(ch.encode(enc)[0])
            except UnicodeEncodeError:
                # control characters stand for bytes that the code page leaves undefined
                if 0x80 <= o <= 0x9F and enc in ("cp1252", "cp1250", "cp1251"):
                    out.append(o)
                else:
                    return None
    return out


def undefined(enc: str) -> tuple[int, ...]:
    """Bytes that an encoding has no character for, so that they are lost when a text is read by it."""
    out = []
    for b in range(0x80, 0x100):
        try:
            bytes([b]).decode(enc)
        except UnicodeDecodeError:
            out.append(b)
    return tuple(out)


UNSHOWN = {enc: undefined(enc) for enc in READ_AS}


def page(enc: str) -> list[str | None]:
    """The character of each byte of a code page."""
    return [bytes([b]).decode(enc, "ignore") or None for b in range(256)]


PAGES = {enc: page(enc) for enc in MEANT if enc != "utf-8" and enc not in DOUBLE_BYTE}


def one_char(raw: tuple[int, ...], lost: tuple[int, ...], enc: str) -> list[str]:
    """The single characters that some bytes can be in an encoding; -1 is any of the lost ones."""
    out = []
    for b in itertools.product(*[lost if x == -1 else (x,) for x in raw]):
        try:
            t = bytes(b).decode(enc)
        except UnicodeDecodeError:
            continue
        if len(t) == 1:
            out.append(t)
    return out


def asked_of(p: str, here: list[list[str]]) -> str:
    """A word with lost characters, and what each of these may be."""
    return "\t".join([p, *["".join(o) for o in here]])


def agrees(word: str, w: str) -> bool | None:
    """Whether w, of the same length, can be word with its lost characters: True to the letter, False but for case, None not.

    word may say after tabs what each lost character can be; otherwise it is any that isn't ASCII.
    """
    word, *options = word.split("\t")
    lost = [i for i, ch in enumerate(word) if ch == LOST]
    if LOST in w or len(w) != len(word):
        return None
    if not options and any(w[i].isascii() for i in lost):
        return None
    if options:
        if all(w[i] in o for i, o in zip(lost, options, strict=True)) and all(ch in (w[i], LOST) for i, ch in enumerate(word)):
            return True
        if not all(w[i].lower() in o.lower() for i, o in zip(lost, options, strict=True)):
            return None
        return False if all(ch == LOST or w[i].lower() == ch.lower() for i, ch in enumerate(word)) else None
    known = [(i, ch) for i, ch in enumerate(word) if ch != LOST]
    if all(w[i] == ch for i, ch in known):
        return True
    return False if all(w[i].lower() == ch.lower() for i, ch in known) else None


def merged(word: str, w: str) -> str:
    return "".join(ch if ch != LOST else w[i] for i, ch in enumerate(word))


def slot(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w) & (SLOTS - 1)


class Model:
    """Word frequencies, and the likeliest way back for a token through each channel."""

    def __init__(self, counts: list[tuple[str, int]], whole: tuple[int, dict[str, int]] | None = None):
        """whole: the number of words and of each character, where counts don't hold all words."""
        self.counts = dict(counts)
        self.total = max(1, whole[0] if whole else sum(self.counts.values()))
        chars: dict[str, int] = {}
        by_size: dict[int, list[str]] = {}
        for w, c in self.counts.items():
            by_size.setdefault(len(w), []).append(w)
            for ch in w:
                chars[ch] = chars.get(ch, 0) + c
        # the words of a length in one text, so that those of a pattern are found by one scan of it
        self.lines = {n: "\n".join(ws) for n, ws in by_size.items()}
        chars = whole[1] if whole else chars
        self.chars, self.char_total = chars, max(1, sum(chars.values()))
        self.ways = lru_cache(200_000)(self._ways)
        self.score = lru_cache(200_000)(self._score)
        self.fill = lru_cache(50_000)(self._fill)
        self.by_read: dict[str, list[tuple[int, str, int]]] = {}
        self.channels = [(r, m, 1) for r in READ_AS for m in MEANT if r != m] + [(r, "utf-8", n) for r in ("cp1252", "latin-1") for n in (2, 3)]
        for k, (read, meant, times) in enumerate(self.channels):
            self.by_read.setdefault(read, []).append((k, meant, times))

    def _word(self, w: str) -> float:
        """Log frequency. A word seen once or twice is spelt: its own damage may be all that was seen."""
        spelt = sum(math.log((self.chars.get(ch, 0) + 0.01) / self.char_total) for ch in w)
        c = self.counts.get(w, 0)
        if c > RARE or (c and len(w) == 1):
            return math.log(c / self.total)
        low = self.counts.get(w.lower(), 0) or self.counts.get(w.capitalize(), 0)
        if low > RARE:
            return math.log(low / self.total) - 2.0
        return min(math.log(0.3 / self.total), spelt)

    def _score(self, token: str) -> float:
        return sum(self._word(p) for p in pieces(token)) + (0.0 if token.isprintable() else -6.0 * sum(not ch.isprintable() and ch != "\xa0" for ch in token))

    def _known(self, asked: str) -> str | None:
        """The most frequent word that agrees with asked (see ``agrees``); case comes second."""
        word, *options = asked.split("\t")
        it = iter(options)
        pattern = "".join((f"[{re.escape(next(it))}]" if options else r"[^\x00-\x7f]") if ch == LOST else re.escape(ch) for ch in word)
        best, most = None, (False, 0)
        for m in re.finditer(f"^{pattern}$", self.lines.get(len(word), ""), re.M | re.I):
            w = m[0]
            exact = agrees(asked, w)
            if exact is not None and (exact, self.counts[w]) > most:
                best, most = w, (exact, self.counts[w])
        return best

    def _fill(self, word: str) -> str | None:
        """The most frequent word that agrees with word but for its lost characters (one for one); case comes second."""
        if not any(ch.isalpha() for ch in word if ch != LOST):
            return None
        best = self._known(word)
        return None if best is None else merged(word, best)

    def _through(self, token: str, read: str, meant: str) -> str | None:
        raw = _bytes(token, read)
        return None if raw is None else self._decoded(token, raw, read, meant)

    def _decoded(self, token: str, raw: list[int], read: str, meant: str) -> str | None:
        if -1 not in raw:
            try:
                out = bytes(raw).decode(meant)
            except UnicodeDecodeError:
                return None
            return out if out != token else None
        return self._lattice(raw, UNSHOWN[read], meant) if UNSHOWN[read] else None

    def _spelt(self, ch: str) -> float:
        return math.log((self.chars.get(ch, 0) + 0.01) / self.char_total)

    def _lattice(self, raw: list[int], lost: tuple[int, ...], meant: str) -> str | None:
        """Bytes with wildcards: Viterbi over where characters begin and which they are; known words then decide among the characters of a place."""
        if meant in PAGES:
            # a byte is a character, and a lost byte a place to be filled even if only one character can stand there
            p = PAGES[meant]
            options = [c for x in lost if (c := p[x])]
            chars = [options if b == -1 else p[b] for b in raw]
            if not options or None in chars:
                return None
            return self._words(["".join(LOST if isinstance(c, list) else c for c in chars), *[c for c in chars if isinstance(c, list)]], False)
        widest = 4 if meant == "utf-8" else 2
        # per place the likeliest way to it: its weight, the place before, and the characters that lead here
        ways: list[tuple[float, int, list[str]] | None] = [(0.0, -1, [])]
        for i in range(1, len(raw) + 1):
            best = None
            for n in range(1, min(widest, i) + 1):
                if (was := ways[i - n]) is not None and (fit := one_char(tuple(raw[i - n : i]), lost, meant)):
                    weight = was[0] + max(map(self._spelt, fit))
                    if best is None or weight > best[0]:
                        best = (weight, i - n, fit)
            ways.append(best)
        if ways[-1] is None:
            return None
        chars, i = [], len(raw)
        while i > 0:
            _, i, fit = ways[i]
            chars.append(fit)
        chars.reverse()
        return self._words(["".join(c[0] if len(c) == 1 else LOST for c in chars), *[c for c in chars if len(c) > 1]], True)

    def _words(self, spelt: list, free: bool) -> str | None:
        """A text with lost characters, and what each may be: word by word."""
        text, opts, result = spelt[0], iter(spelt[1:]), []
        for p in _LOST_WORD.split(text):
            word = self._best(p, [next(opts) for ch in p if ch == LOST], free) if LOST in p else p
            if word is None:
                return None
            result.append(word)
        return "".join(result)

    def _best(self, p: str, here: list[list[str]], free: bool) -> str | None:
        """A word with lost characters: as the most frequent known word that fits, else, if free, by the commonest character of each place.

        A single lost byte is a character of nearly every code page, so that there only a known word is believed, and only
        if no other word that isn't among its options is seen more often.
        """
        asked = asked_of(p, here)
        known = self._known(asked) if any(ch.isalpha() for ch in p if ch != LOST) else None
        it = iter(here)
        if not free and (known is None or self._known(p) != known or not agrees(asked, known)):
            return None
        if known is None:
            return "".join(max(next(it), key=lambda c: (self.chars.get(c, 0), c)) if ch == LOST else ch for ch in p)
        return "".join(next(c for c in next(it) if c.lower() == known[i].lower()) if ch == LOST else ch for i, ch in enumerate(p)) if agrees(asked, known) is False else known

    def _ways(self, token: str) -> tuple[tuple[int, float, str], ...]:
        """(channel, gain over the token as it stands, what was meant) for the channels that can give it."""
        base, out, seen = self.score(token), [], {}
        for k, t, meant in self._readings(token):
            if t not in seen:
                gain = self.score(t) - base
                if meant == "utf-8":
                    gain += UTF8_WORTH
                elif sum(self.counts.get(p, 0) > RARE for p in pieces(t)) < (4 if meant in DOUBLE_BYTE else 1):
                    # bytes nearly always decode into a code page, so only known words (or several known signs) speak for one
                    gain = min(gain, 0.0) - 1.0
                seen[t] = gain
            # a worse word is passed at less cost by leaving the channel and coming back
            if seen[t] > -(BEGIN + END):
                out.append((k, seen[t], t))
        return tuple(out)

    def _readings(self, token: str) -> Iterator[tuple[int, str, str]]:
        """(channel, what was meant, its encoding) of the channels that the token can have come through."""
        for read, channels in self.by_read.items():
            raw = _bytes(token, read)
            if raw is None:
                continue
            for k, meant, times in channels:
                t = self._decoded(token, raw, read, meant)
                for _ in range(times - 1):
                    t = self._through(t, read, meant) if t is not None and not t.isascii() else None
                if t is not None and t != token:
                    yield k, t, meant

    def repair(self, text: str) -> tuple[str, float]:
        """The text as it was meant, and how much likelier (in nats) the damage is than the text as it stands."""
        found = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
        ways = [self.ways(t) for *_, t in found]
        # all that a channel can gain in this text; below the cost of its beginning no path through it wins
        most: dict[int, float] = {}
        for w in ways:
            for k, g, _ in w:
                if g > 0:
                    most[k] = most.get(k, 0.0) + g
        if max(most.values(), default=0.0) <= BEGIN:
            return self._filled(text, found), 0.0
        # Viterbi; state -1 is the text as it stands
        score: dict[int, float] = {-1: 0.0}
        back: list[dict[int, int]] = []
        for w in ways:
            gain = {k: g for k, g, _ in w}
            top = max(score, key=lambda k: (score[k] - (END if k >= 0 else 0.0), -k))
            leave = score[top] - (END if top >= 0 else 0.0)
            new, came = {-1: max(score[-1], leave)}, {-1: -1 if score[-1] >= leave else top}
            for k, g in gain.items():
                stay = score.get(k, -math.inf)
                enter = max(score[-1], leave) - BEGIN
                new[k], came[k] = (stay + g, k) if stay >= enter else (enter + g, came[-1])
            score = new
            back.append(came)
        state = max(score, key=lambda k: (score[k], -k))
        total, path = score[state], []
        for came in reversed(back):
            path.append(state)
            state = came[state]
        path.reverse()
        if total < LEAST_GAIN:
            return self._filled(text, found), 0.0
        meant = []
        for (a, b, t), w, k in zip(found, ways, path, strict=True):
            meant.append((a, b, next((m for c, _, m in w if c == k), t)))
        return self._joined(text, meant), total

    def _joined(self, text: str, parts: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for a, b, t in parts:
            out += [text[at:a], self._patched(t) if LOST in t else t]
            at = b
        return "".join([*out, text[at:]])

    def _filled(self, text: str, found: list[tuple[int, int, str]]) -> str:
        return self._joined(text, found) if LOST in text else text

    def _patched(self, token: str) -> str:
        """Words of single-byte text that was read as UTF-8: each lost character is one that the word list knows."""
        return re.sub(r"(?:[A-Za-z]|[^\x00-\x7f])*�(?:[A-Za-z]|[^\x00-\x7f])*", lambda m: self.fill(m.group()) or m.group(), token)


class Known(dict):
    """Counts at hand; a word that isn't, but may be one of the corpus, is asked for and counts 0 until then."""

    def __init__(self, counts: dict[str, int], on: np.ndarray):
        super().__init__(counts)
        self.on, self.asked = on, set()

    def get(self, w: str, default: int = 0) -> int:
        n = super().get(w)
        if n is None:
            k = slot(w)
            if self.on[k >> 3] >> (7 - (k & 7)) & 1:
                self.asked.add(w)
        return n or default


class Asking(Model):
    """A model with some counts, and with answers: (word, count, None), or (word with lost characters, 0, the word that fits)."""

    def __init__(self, head: list[tuple[str, int]], whole: tuple[int, dict[str, int]], on: np.ndarray, answers: list[tuple[str, int, str | None]]):
        super().__init__([], whole)
        self.counts = Known(dict(head), on)
        self.counts.update((w, n) for w, n, _ in answers if LOST not in w)
        self.fits = {w: fit for w, _, fit in answers if LOST in w}

    def _known(self, asked: str) -> str | None:
        if asked not in self.fits:
            self.counts.asked.add(asked)
        return self.fits.get(asked)


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(w, n): the words with non-ASCII characters and their counts over all texts."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(_RUN), F.lit(0))
    worded = F.filter(tokens, lambda w: w.rlike(r"[^\x00-\x7f]") & ~w.contains(LOST))
    return docs.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.explode(worded).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def totals(words: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of words, and of each character in them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, int] = {}
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for ch in w:
                    chars[ch] = chars.get(ch, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(chars), pa.string()), pa.array(list(chars.values()), pa.int64())], names=["ch", "n"])

    chars = words.select("w", "n").mapInArrow(count, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n")).collect()
    return words.agg(F.sum("n")).first()[0], {r.ch: r.n for r in chars}


def slots(words: DataFrame) -> np.ndarray:
    """A bit per slot that a word falls on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([slot(w) for w in b.column(0).to_pylist()], pa.int32())], names=["k"])

    on = np.zeros(SLOTS, bool)
    on[np.asarray(words.select("w").mapInArrow(scan, "k int").distinct().toArrow()["k"])] = True
    return np.packbits(on)


def fitting(lost: DataFrame, words: DataFrame) -> DataFrame:
    """(w, n, fit): the most frequent word that agrees with w but for its lost characters; they meet by length and one character."""

    def places(one: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, keys = [], []
                for row, w in enumerate(b.column(0).to_pylist()):
                    w = w.split("\t")[0]
                    mine = [f"{len(w)} {i} {ch.lower()}" for i, ch in enumerate(w) if ch.isalpha()]
                    mine = mine[:1] if one else mine
                    at += [row] * len(mine)
                    keys += mine
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in b.columns], pa.array(keys, pa.string())], names=[*b.schema.names, "k"])

        return scan

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            how = [agrees(p, w) for p, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            at = pa.array([i for i, x in enumerate(how) if x is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns], pa.array([int(x) for x in how if x is not None], pa.int32())], names=["w", "fit", "n", "exact"])

    p = lost.select("w").distinct().mapInArrow(places(True), "w string, k string")
    v = words.select(F.col("w").alias("fit"), "n").mapInArrow(places(False), "fit string, n long, k string")
    met = p.join(v, "k").select("w", "fit", "n").mapInArrow(match, "w string, fit string, n long, exact int")
    best = met.groupBy("w").agg(F.min(F.struct(-F.col("exact"), -F.col("n"), "fit")).alias("b"))
    return best.select("w", F.lit(0).cast("long").alias("n"), F.col("b.fit").alias("fit"))


def restored(docs: DataFrame, key: str, text: str, size: int = 200_000) -> DataFrame:
    """(key, text, restored, gain, lossy) of the damaged texts; lossy is 1 where the text holds U+FFFD. size words are broadcast."""
    spark = docs.sparkSession
    words = written(vocabulary(docs, text), "words")
    head = [(r.w, r.n) for r in words.orderBy(F.desc("n"), "w").limit(size + 1).collect()]
    if len(head) > size:
        return in_blocks(docs, key, text, words, head[:size])
    held = spark.sparkContext.broadcast(head)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}[key]
    d = docs.where(F.col(key).isNotNull() & F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias("__k"), F.col(text).alias("__t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(held.value)
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1).to_pylist()):
                meant, gain = model.repair(t)
                if gain > 0 or LOST in t:
                    rows.append((i, t, meant, gain, int(LOST in t)))
            if rows:
                at, ts, ms, gs, ls = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(ts), pa.array(ms), pa.array(gs, pa.float64()), pa.array(ls, pa.int32())], names=[key, "text", "restored", "gain", "lossy"])

    return d.mapInArrow(scan, f"`{key}` {kind}, text string, restored string, gain double, lossy int")


def in_blocks(docs: DataFrame, key: str, text: str, words: DataFrame, head: list[tuple[str, int]]) -> DataFrame:
    """What ``restored`` gives, where the head isn't all words."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((head, totals(words), slots(words)))
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}[key]
    d = docs.where(F.col(key).isNotNull() & F.col(text).rlike(r"[^\x00-\x7f]")).select(F.shiftright(F.monotonically_increasing_id(), BLOCK).alias("b"), F.col(key).alias("__k"), F.col(text).alias("__t"))
    left = written(d, "blocks")
    answers = spark.createDataFrame([], "b long, w string, n long, fit string")
    names = [key, "text", "restored", "gain", "lossy"]

    def judge(block: pa.Table, known: pa.Table) -> pa.Table:
        model = Asking(*held.value, list(zip(*[known[c].to_pylist() for c in ("w", "n", "fit")], strict=True)))
        rows = []
        for i, t in enumerate(block["__t"].to_pylist()):
            meant, gain = model.repair(t)
            if gain > 0 or LOST in t:
                rows.append((i, t, meant, gain, int(LOST in t)))
        asked = sorted(model.counts.asked)
        if asked:
            rows = [(None, None, None, None, None)] * len(asked)
        at, ts, ms, gs, ls = zip(*rows, strict=True) if rows else [()] * 5
        b = block["b"][0].as_py() if block.num_rows else None
        cols = [pa.array([b] * len(rows), pa.int64()), block["__k"].combine_chunks().take(pa.array(at, pa.int64())), pa.array(ts, pa.string()), pa.array(ms, pa.string()), pa.array(gs, pa.float64()), pa.array(ls, pa.int32()), pa.array(asked or [None] * len(rows), pa.string())]
        return pa.table(cols, names=["b", *names, "asked"])

    out = None
    while True:
        got = written(left.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(judge, f"b long, `{key}` {kind}, text string, restored string, gain double, lossy int, asked string"), "judged")
        done = got.where("asked is null").select(*[F.col(f"`{c}`") for c in names])
        out = done if out is None else out.unionByName(done)
        asked = got.where("asked is not null").select("b", F.col("asked").alias("w"))
        if asked.isEmpty():
            return out
        lost = asked.where(F.col("w").contains(LOST))
        plain = asked.where(~F.col("w").contains(LOST)).join(words, "w", "left").select("b", "w", F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("string").alias("fit"))
        fits = lost.join(fitting(lost, words), "w", "left").select("b", "w", F.coalesce("n", F.lit(0)).alias("n"), "fit")
        open_ = asked.select("b").distinct()
        # only blocks that asked are judged again
        answers = written(answers.join(open_, "b", "left_semi").unionByName(plain).unionByName(fits), "answers")
        left = left.join(open_, "b", "left_semi")
