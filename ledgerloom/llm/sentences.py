"""Sentence units across languages and scripts.

Layout comes first: blank lines, list markers and heading signs end units for certain. Inside a paragraph every gap between words is a place of a hidden event, boundary or
none: behind end marks, at spaces of scripts without end marks, and behind words without any mark. The n-gram model of the events is counted over the whole collection from
the places that layout decides: words before a paragraph's
end, words at its start, and words elsewhere. A word that stands before marks often but never before a paragraph's end doesn't end
sentences; a word that starts paragraphs may start sentences. How often a sentence ends without a mark is what paragraphs of sentences show at their ends. Forward-backward over
a paragraph's places, with a prior
on the lengths of sentences, gives the posterior of each event. Gaps without a mark whose own odds are against a boundary can't get a posterior above one half, as boundaries
nearby only speak against one another, and are left out of the recursion. Quoted or bracketed text has no places inside.

Counts are summed by n-gram and kept with fingerprints of 64 bits, so no n-gram reads the counts of another. The model has 16 bytes for each different
n-gram; their number grows more slowly than the collection.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_LEAST_WORDS = 8  # of a paragraph that tells of ends without marks
_HELD = 1 << 18  # n-grams that a task holds before it sends their counts
TABLES = ("place", "end", "start", "middle")

_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028])"
_BLANK = re.compile(rf"(?:{_BREAK}(?:[^\S\n\r\x0b\x0c\x85\u2028\u2029]*{_BREAK})+|\u2029)")
_LINE = re.compile(_BREAK)
_BULLET = re.compile(r"\s*[-*+•‣◦▪·–—]\s+\S")
_NUMBERED = re.compile(r"\s*[(]?(\d{1,3}|[a-zA-Z])[.)]\s+\S")
_HEADING = re.compile(r"\s*#{1,6}\s+\S")
_MARK = re.compile(r"[.!?…‥。！？।॥؟۔｡．။។៕]+(?:\s[!?]+)?")
_ALWAYS = "!?。！？।॥؟۔｡．။។៕"
_NO_SPACE = re.compile("[\u3040-ヿ㐀-鿿豈-\ufaff\u3000-〿\uff00-\uffef]")
#: Letters of scripts without spaces between words and mostly without end marks: Thai, Lao, Burmese, Khmer.
_OPEN = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
#: A space behind or before such a letter.
_THAI = re.compile(rf"[{_OPEN}]\s+(?=\S)|[^\s.!?…](?P<gap>\s+)(?=[{_OPEN}])")
_EMOJI = re.compile(r"(?:\s*[\U0001F000-\U0001FAFF☀-➿⬀-⯿️\u200d⃣\U000E0020-\U000E007F]+)+")
_BEFORE = re.compile(r"[^\s\"“”„«»「」『』｢｣()（）\[\]¿¡,;:]*$")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"“”„«»「」『』｢｣()（）[]¿¡,;:'’‘"
# What opens a quotation or bracket, and what may close it.
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "｢": "｣", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉"}
_CLOSERS = set("".join(PAIRS.values()))
_SIGNS = re.compile("[" + re.escape('"' + "".join(PAIRS) + "".join(PAIRS.values())) + "]")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Place:
    """A place where a boundary may be: kind of mark, n-grams before and after, offset behind mark and closers, words before it."""

    kind: str
    one: str
    two: str
    after: str
    at: int
    next: int


def spans(text: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of a paragraph as (opening, closing) offsets; unmatched signs are none."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _SIGNS.finditer(text):
        i, ch = m.start(), m.group()
        if ch == '"':
            if any(c == '"' for c, _ in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                out.append((stack.pop()[1], i))
            else:
                stack.append((ch, i))
        elif ch in _CLOSERS and any(ch in PAIRS.get(c, "") for c, _ in stack):
            while ch not in PAIRS.get(stack[-1][0], ""):
                stack.pop()
            out.append((stack.pop()[1], i))
        elif ch in PAIRS:
            stack.append((ch, i))
    out.sort()
    outer: list[tuple[int, int]] = []
    for a, b in out:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
        elif b > outer[-1][1]:
            outer[-1] = (outer[-1][0], b)
    return outer


def segments(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of a text's parts that layout sets apart; whole: the part is one unit, a heading or an item."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            yield from _lines(text, at, end)
        at = m.end() if m else end


def _lines(text: str, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    begin, whole, number = start, False, None
    line = start
    while line < end:
        m = _LINE.search(text, line, end)
        stop = m.end() if m else end
        part = text[line:stop]
        marker, numbered = bool(_BULLET.match(part)), _NUMBERED.match(part)
        if numbered and not marker:
            n = int(numbered[1]) if numbered[1].isdigit() else ord(numbered[1].lower()) - 96
            # "3. May" may begin a line of a paragraph: numbers have to count up from one
            marker = n == (number + 1 if number is not None else 1)
            number = n if marker else number
        heading = bool(_HEADING.match(part))
        if marker or heading:
            if text[begin:line].strip():
                yield begin, line, whole
            begin, whole = line, True
            if heading:
                yield line, stop, True
                begin, whole = stop, False
        line = stop
    if text[begin:end].strip():
        yield begin, end, whole


@lru_cache(maxsize=200_000)
def _norm(token: str) -> str:
    return _DIGITS.sub("0", token.strip(_EDGE))[:24]


_DIGITS = re.compile(r"\d+")


def places(text: str) -> tuple[list[Place], bool]:
    """The places of a paragraph (without white space at its ends), and whether the last one is its end."""
    quoted = spans(text)
    opens = [a for a, _ in quoted]
    closing = {b for _, b in quoted}
    out: list[Place] = []

    def inside(at: int) -> bool:
        k = bisect_left(opens, at) - 1
        return k >= 0 and at <= quoted[k][1]

    for m in _MARK.finditer(text):
        at = m.end()
        closed = False
        while at < len(text):
            if at in closing:
                at, closed = at + 1, True
            elif text[at] in "’'" and not text[at + 1 : at + 2].isalnum():
                at += 1
            elif text[at].isspace() and at + 1 in closing and text[at + 1] in "»›":
                at, closed = at + 2, True
            else:
                break
        if inside(at):
            continue
        emoji = _EMOJI.match(text, at)
        if emoji:
            at = emoji.end()
        if at < len(text) and not text[at].isspace() and not (_NO_SPACE.match(text[at]) or _NO_SPACE.match(m.group()[-1]) or (closed and not text[at].isascii())):
            continue
        sign = m.group()
        kind = "quote" if closed and not emoji and text[at - 1] != sign[-1] else "dots" if sign[0] in "…‥" or sign.startswith("..") and sign[-1] == "." else "sure" if sign[-1] in _ALWAYS else "stop"
        before = _BEFORE.search(text, max(0, m.start() - 40), m.start())
        one = _DIGITS.sub("0", before.group())[-24:] if before else ""
        if _NO_SPACE.search(one):
            one = one[-2:]
        if kind == "quote":
            one = two = "cjk" if at < len(text) and not text[at].isspace() else _script(text, at)
        else:
            head = text[max(0, before.start() - 30) : before.start()].split() if before else []
            two = f"{_norm(head[-1])} {one}" if head else one
        if kind == "sure":
            one = two = _script(text, m.start())
        out.append(_place(kind, one, two, text, at))
    for m in _THAI.finditer(text) if _THAI_LETTER.search(text) else ():
        at = m.start() + 1
        if not inside(at) and text[m.end()] not in _CLOSERS:
            one = text[max(0, at - 4) : at]
            out.append(_place("thai", one, text[max(0, at - 8) : at], text, at))
    out.sort(key=lambda p: p.at)
    return out, bool(out) and out[-1].at >= len(text)


def _place(kind: str, one: str, two: str, text: str, at: int) -> Place:
    m = _TOKEN.search(text, at)
    after, nxt = "", at
    if m:
        nxt, token = m.start(), m.group()
        after = token[:3] if _THAI_LETTER.match(token) else "" if _NO_SPACE.match(token.lstrip(_EDGE)[:1] or "x") else _first(token, text.islower())
    return Place(kind, f"{kind}1 {one}", f"{kind}2 {two}", after, at, nxt)


_THAI_LETTER = re.compile(f"[{_OPEN}]")


def _first(token: str, flat: bool) -> str:
    """A word as it counts for starts; those of paragraphs without capital letters are counted apart."""
    word = token[0] if token[0] in "¿¡" else _norm(_ENDING.sub("", token)) or token[:1]
    return f"~{word}" if flat else word


_ENDING = re.compile(r"[.!?…]+$")


def _script(text: str, at: int) -> str:
    """A coarse name of the script before a place."""
    for ch in reversed(text[max(0, at - 12) : at]):
        if ch.isalpha():
            cp = ord(ch)
            return "lat" if cp < 0x370 else "cyr" if cp < 0x530 else "ara" if cp < 0x900 else "ind" if cp < 0xE00 else "tha" if cp < 0x1100 else "han" if cp < 0xAC00 else "kor"
    return "non"


def _print(gram: str) -> int:
    """A fingerprint of 64 bits."""
    return int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _shape(after: str) -> str:
    """The class of a word that backs off unseen ones."""
    ch = after[:1]
    if ch == "~":
        return "^flat"
    return "^up" if ch.isupper() else "^low" if ch.islower() else "^num" if ch.isdigit() else "^let" if ch.isalpha() else "^sign"


SHAPES = ("^flat", "^up", "^low", "^num", "^let", "^sign")


def count_events(text: str, counts: dict[str, Counter]) -> None:
    """Adds the n-grams of a text's certain events to the counters of the tables."""
    place_counts, end_counts, start_counts, middle_counts = (counts[name] for name in TABLES)
    for start, end, whole in segments(text):
        part = text[start:end].strip()
        flat = part.islower()
        found, _ = places(part)
        for p in found:
            last = p.at >= len(part)
            for gram in (p.one, p.two, f"{p.kind}0"):
                (end_counts if last else place_counts)[gram] += 1
        first = part.split(None, 2)
        if whole and len(first) > 1:
            first = first[1:]
        word = first[0]
        head = word[:3] if _THAI_LETTER.match(word) else "" if _NO_SPACE.match(word[:1]) else _first(word, flat)
        if head:
            start_counts[head] += 1
        if found and found[-1].kind == "thai" or _THAI_LETTER.search(part):
            tail = part.rstrip()
            if _THAI_LETTER.match(tail[-1]):
                for gram in (f"thai1 {tail[-4:]}", f"thai2 {tail[-8:]}", "thai0"):
                    end_counts[gram] += 1
        marked = True
        words = part.split()
        for token in words:
            gram, ending = _inner(token, flat)
            if gram and not marked:
                middle_counts[gram] += 1
            marked = ending
        # a paragraph of sentences with marks whose last one has none; those without any mark may be headings
        if not marked and not whole and found and len(words) >= _LEAST_WORDS and _bare(words[-1]):
            end_counts[f"none1 {gram}"] += 1
            end_counts["none0"] += 1


@lru_cache(maxsize=200_000)
def _inner(token: str, flat: bool) -> tuple[str, bool]:
    """How a word counts that starts no sentence ("" in scripts without spaces), and whether a mark may follow it."""
    gram = "" if _NO_SPACE.match(token[:1]) else token[:3] if _THAI_LETTER.match(token) else _first(token, flat)
    return gram, bool(_MARK.search(token[-3:]))


@lru_cache(maxsize=200_000)
def _bare(token: str) -> bool:
    """Whether a word has a letter at its end and no mark, in a script with spaces between words: there may be a boundary behind it that nothing shows."""
    return token[-1:].isalpha() and not _NO_SPACE.match(token) and not _THAI_LETTER.search(token)


class Counts:
    """How often each n-gram of a table was counted, by fingerprint.

    kinds: how many there are of each class; they count kinds of words rather than occurrences, a word at most twice: they speak for words that were not seen."""

    def __init__(self, prints: np.ndarray, numbers: np.ndarray, shapes: np.ndarray):
        order = np.argsort(prints)
        self.prints, self.numbers = array("q", prints[order].astype(np.int64).tobytes()), array("q", numbers[order].astype(np.int64).tobytes())
        kinds = np.bincount(shapes, np.minimum(numbers, 2), len(SHAPES))
        self.kinds = dict(zip(SHAPES, kinds.tolist()))
        self.all_kinds, self.total = float(kinds.sum()), float(numbers.sum())

    def __getitem__(self, gram: str) -> float:
        own = _print(gram)
        k = bisect_left(self.prints, own)
        return float(self.numbers[k]) if k < len(self.prints) and self.prints[k] == own else 0.0


class _Cached(dict):
    """What a function gives for a word, computed once; forgotten when there are too many words."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = self.of(word)
        return out


_SMOOTH = 200.0  # occurrences that all words' share counts for


class EventModel:
    """Log odds of a boundary at a place, from the tables of certain events."""

    #: Prior log odds by kind of place.
    PRIOR = {"sure": 2.5, "stop": 2.2, "dots": 0.0, "quote": 0.0, "thai": -0.5}

    def __init__(self, tables: dict[str, Counts]):
        self.tables = tables
        ends = sum(tables["end"][f"{k}0"] for k in ("sure", "stop"))
        #: How many of the boundaries are at a paragraph's end.
        self.rate = min(0.5, max(0.02, ends / max(1.0, ends + sum(tables["place"][f"{k}0"] for k in ("sure", "stop")))))
        #: How often a boundary is at a gap without a mark.
        self.bare = min(0.2, tables["end"]["none0"] / max(1.0, self.rate * tables["middle"].total))
        self.gaps = {flat: (_Cached(lambda w, f=flat: self._bare_before(w, f)), _Cached(lambda w, f=flat: self._bare_after(w, f))) for flat in (False, True)}
        self.starts, self.middles = max(1.0, tables["start"].total), max(1.0, tables["middle"].total)

    @lru_cache(maxsize=200_000)
    def _before(self, kind: str, one: str, two: str) -> float:
        """What stands before a mark may end sentences nearly always, or nearly never. With the first, a known share of its marks
        would be at a paragraph's end; where some are, their number tells how often it does."""
        odds = self.PRIOR[kind]
        if kind == "sure":
            return odds
        n, e = self._seen(one)
        if e:
            # the longer n-gram sharpens what the shorter one says
            longer, ends = self._seen(two)
            if not ends:
                return max(-12.0, self._share(kind, n, e) - 0.96 * self.rate * longer)
            return self._share(kind, longer, ends) if longer >= 20 else self._share(kind, n, e)
        return max(-12.0, odds - 0.96 * self.rate * n)

    def _share(self, kind: str, n: float, ends: float) -> float:
        """Log odds of the share of boundaries among n marks, of which `ends` are at a paragraph's end."""
        p = min(0.85 if kind == "quote" else 0.98, max(0.01, (ends + 0.5) / (self.rate * n + 0.5)))
        return log(p / (1 - p))

    def _seen(self, gram: str) -> tuple[float, float]:
        """How often an n-gram was before a mark, and how often of these at a paragraph's end."""
        end = self.tables["end"][gram]
        return end + self.tables["place"][gram], end

    @lru_cache(maxsize=200_000)
    def _after(self, after: str) -> float:
        if not after:
            return 0.0
        start, middle = self.tables["start"], self.tables["middle"]
        shape = _shape(after)
        back_s = (start.kinds[shape] + 0.5) / (start.all_kinds + 1)
        back_m = (middle.kinds[shape] + 0.5) / (middle.all_kinds + 1)
        at_start, at_middle = start[after], middle[after]
        s = (at_start + 4 * back_s) / (self.starts + 4)
        m = (at_middle + 4 * back_m) / (self.middles + 4)
        # a word that was seen nowhere says what its class says
        if at_start + at_middle < 1:
            return max(-5.0, min(5.0, log(back_s / back_m)))
        return max(-7.0, min(7.0, log(s / m)))

    def _bare_before(self, token: str, flat: bool) -> float:
        """Log odds of a boundary behind a word that has no mark: the share of its occurrences that is at a paragraph's end, smoothed by that of all words."""
        gram, _ = _inner(token, flat)
        if not _bare(token):
            return -100.0
        p = (self.tables["end"][f"none1 {gram}"] + _SMOOTH * self.bare) / (self.rate * self.tables["middle"][gram] + _SMOOTH)
        p = min(0.9, max(1e-9, p))
        return log(p / (1 - p))

    def _bare_after(self, token: str, flat: bool) -> float:
        return self._after(_inner(token, flat)[0]) if token[0].isalpha() and not _NO_SPACE.match(token) and not _THAI_LETTER.match(token) else -100.0

    def bare_places(self, text: str) -> list[tuple[float, int, int]]:
        """(log odds, end of a word, start of the next) of the gaps between words without a mark where a boundary is more likely than none; at the others no
        posterior can exceed one half, as neighbouring boundaries only speak against one another."""
        words = text.split()
        before, after = self.gaps[text.islower()]
        if not any(before[a] + after[b] > 0 for a, b in zip(words, words[1:])):
            return []
        quoted, out, last = spans(text), [], None
        for m in _TOKEN.finditer(text):
            if last and (odds := before[last.group()] + after[m.group()]) > 0 and not any(a < last.end() <= b for a, b in quoted):
                out.append((odds, last.end(), m.start()))
            last = m
        return out

    def odds(self, p: Place) -> float:
        return self._before(p.kind, p.one, p.two) + self._after(p.after)

    def boundaries(self, text: str) -> list[tuple[int, int]]:
        """(end of a sentence, start of the next) in a paragraph, where the posterior of the event exceeds one half."""
        events = [(p.at, p.next, self.odds(p)) for p in places(text)[0] if p.next < len(text) and p.at < len(text)]
        events += [(at, nxt, odds) for odds, at, nxt in self.bare_places(text)]
        if not events:
            return []
        events.sort()
        odds = [o for _, _, o in events]
        # words since the place before
        gaps, at = [], 0
        for end, _, _ in events:
            gaps.append(sum(1 for _ in _WORD.finditer(text, at, end)))
            at = end
        short = [-6.0 if g == 0 else -0.7 if g == 1 else 0.0 for g in gaps]
        # forward: log weights of (none, boundary) at each place; two boundaries in a row pay for a short sentence
        forward, none, bound = [], 0.0, 0.0
        for k, o in enumerate(odds):
            if k == 0:
                none, bound = 0.0, o + short[0]
            else:
                none, bound = _add(none, bound), o + _add(none, bound + short[k])
            forward.append((none, bound))
        backward = [(0.0, 0.0)] * len(events)
        for k in range(len(events) - 2, -1, -1):
            n1, b1 = backward[k + 1]
            step = odds[k + 1] + b1
            backward[k] = (_add(n1, step), _add(n1, step + short[k + 1]))
        out = []
        for (at, nxt, _), (fn, fb), (bn, bb) in zip(events, forward, backward):
            if fb + bb > fn + bn:
                out.append((at, nxt))
        return out

    def units(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentence units of a text; none for one that is empty or blank."""
        out = []
        for start, end, whole in segments(text):
            part = text[start:end]
            start += len(part) - len(part.lstrip())
            part = part.strip()
            at = 0
            if not whole:
                for stop, nxt in self.boundaries(part):
                    out.append((start + at, start + stop))
                    at = nxt
            if part[at:]:
                out.append((start + at, start + len(part)))
        return out


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + log(1 + exp(b - a)) if a - b < 30 else a


_FILTER_BITS = 1 << 24
_CHUNK = 1 << 16


def _repeated(docs: DataFrame, text_column: str) -> Column:
    """A column that is true for every text that has a copy in another row, and for few others: hashes of texts that occur more than once are put into a Bloom
    filter of one size (2 MB) whatever the collection. Where very many texts have copies, it says true more often."""
    hashes = docs.where(F.col(text_column).isNotNull()).groupBy(F.xxhash64(text_column).alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_FILTER_BITS, bool)
        for batch in batches:
            for place in _filter_places(batch.column(0).to_numpy()):
                bits[place] = True
        used = [i for i in range(0, _FILTER_BITS, _CHUNK) if bits[i : i + _CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // _CHUNK for i in used], pa.int32()), pa.array([np.packbits(bits[i : i + _CHUNK]).tobytes() for i in used], pa.binary())], names=["chunk", "bits"])

    bits = np.zeros(_FILTER_BITS // 8, np.uint8)
    # at most 256 chunks of 8 KB
    merged = hashes.mapInArrow(put, "chunk int, bits binary").repartition("chunk").mapInArrow(_either, "chunk int, bits binary")
    for row in merged.collect():
        at = row["chunk"] * _CHUNK // 8
        bits[at : at + _CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf(BooleanType())
    def seen(batch: pa.Array) -> pa.Array:
        out = np.ones(len(batch), bool)
        for place in _filter_places(batch.to_numpy()):
            out &= (sent.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        return pa.array(out)

    return seen(F.xxhash64(text_column))


def _filter_places(hashes: np.ndarray) -> list[np.ndarray]:
    h = hashes.view(np.uint64)
    return [((h >> np.uint64(shift)) % np.uint64(_FILTER_BITS)).astype(np.int64) for shift in (0, 26, 40)]


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[chunk] = sums.get(chunk, np.uint8(0)) | np.frombuffer(bits, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "bits"])


def learn_events(docs: DataFrame, text_column: str = "text") -> EventModel:
    """The model of all texts, each different text counted once: copies of one text would make its words look as if they ended no
    sentence. Tasks send what they counted by fingerprint, to be summed by shuffle; the driver gets one number for each different
    n-gram. Null and empty texts count for nothing."""

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        out = [(t, SHAPES.index(_shape(gram)), _print(gram), n) for t, name in enumerate(TABLES) for gram, n in counts[name].items()]
        for counter in counts.values():
            counter.clear()
        types = (pa.int8(), pa.int8(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, types)], names=["part", "shape", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {name: Counter() for name in TABLES}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    count_events(text, counts)
                    if sum(map(len, counts.values())) > _HELD:
                        yield rows(counts)
        yield rows(counts)

    rows_of = docs.select(text_column).where(F.col(text_column).isNotNull()).withColumn("seen", _repeated(docs, text_column))
    kind = "part tinyint, shape tinyint, gram bigint, n bigint"
    # texts that certainly have no copy are counted where they are; only the others are shuffled
    once = rows_of.where("not seen").select(text_column).mapInArrow(count, kind)
    copies = rows_of.where("seen").select(text_column).distinct().mapInArrow(count, kind)
    sums = once.unionByName(copies).groupBy("part", "gram").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))
    part, gram, shape, n = (column.to_numpy() for column in sums.select("part", "gram", "shape", "n").toArrow().columns)
    return EventModel({name: Counts(gram[part == t], n[part == t], shape[part == t]) for t, name in enumerate(TABLES)})


def sentence_units(docs: DataFrame, model: EventModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, start_at, end_at) of each sentence unit of each row, see p9_found in TESTDATA.md.

    Null, empty and blank texts have none; rows with the same id or text have their own; a null id stays null. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = EventModel(sent.value).units
        for batch in batches:
            found = [units(text) if text else [] for text in batch.column(1).to_pylist()]
            sizes = [len(f) for f in found]
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array([a for a, _ in flat], pa.int32()), pa.array([b for _, b in flat], pa.int32())],
                names=[id_column, "start_at", "end_at"],
            )

    own = docs.select(id_column, text_column)
    return own.mapInArrow(run, f"`{id_column}` {own.schema[0].dataType.simpleString()}, start_at int, end_at int")
