"""One consistent form for texts that look the same.

Three steps: compatibility normalisation of single characters (wide, narrow, ligature, font and space variants), deletion of
characters that show nothing, composition; then every token that holds look-alike letters is searched as a lattice.
The lattice of a token has, at each place, all letters that look like the one stored, whichever that is; Viterbi search finds the
path with the best character bigram scores of one script, a change of script inside a token being very
unlikely. As the lattice doesn't depend on which of the look-alikes was stored, equal-looking tokens in equal-looking
surroundings always get the same form. Tokens of look-alikes only (a Cyrillic or a Latin `c` alone) are decided by the scores and by
the scripts of the value's unambiguous letters.

Letter case, punctuation, accents, line breaks, tabs and the number of spaces stay.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that look like the Latin letter named, after the Unicode confusables data.
CYRILLIC_TWINS = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ё": "Ë", "Н": "H", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "е": "e", "ё": "ë", "һ": "h", "і": "i", "ї": "ï", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y",
}
GREEK_TWINS = {
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u",
}
ARMENIAN_TWINS = {"Օ": "O", "Տ": "S", "Ս": "U", "ց": "g", "հ": "h", "ո": "n", "օ": "o", "զ": "q", "ս": "u"}
# Rare letters that always stand for a plain Latin one.
RARE_TWINS = {"Ԍ": "G", "Ԛ": "Q", "Ѵ": "V", "Ԝ": "W", "ɑ": "a", "ԁ": "d", "ɡ": "g", "ɩ": "i", "ӏ": "l", "ԛ": "q", "ѵ": "v", "ԝ": "w"}
# All hyphens are one, the ellipsis is three dots.
HYPHENS = "‐‑﹣－"
ELLIPSIS = {"…": "..."}

LATIN, CYRILLIC, GREEK, ARMENIAN = 0, 1, 2, 3


def _with_marks(twins: dict[str, str], low: int, high: int) -> dict[str, str]:
    """The letters named, and those that are one of them with marks that its Latin look-alike has, too."""
    out = dict(twins)
    for cp in range(low, high):
        apart = unicodedata.normalize("NFD", chr(cp))
        if len(apart) > 1 and apart[0] in twins:
            latin = unicodedata.normalize("NFC", twins[apart[0]] + apart[1:])
            if len(latin) == 1 and ord(latin) < 0x250:
                out.setdefault(chr(cp), latin)
    return out


_TWINS = {CYRILLIC: _with_marks(CYRILLIC_TWINS, 0x400, 0x530), GREEK: _with_marks(GREEK_TWINS, 0x370, 0x400), ARMENIAN: ARMENIAN_TWINS}
#: Blocks of the scripts that share letter shapes.
_BLOCKS = {LATIN: [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)], GREEK: [(0x370, 0x3FF)], CYRILLIC: [(0x400, 0x52F)], ARMENIAN: [(0x531, 0x587)]}

#: Characters that show nothing, besides those of category Cf that are no Arabic or Syriac number marks.
_INVISIBLE = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)]
_VISIBLE_CF = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


@lru_cache(maxsize=1)
def _single() -> dict[int, str | None]:
    """Code point -> its plain characters, for str.translate. Made from the Unicode data, once in each process."""
    out: dict[int, str | None] = {}
    kinds = ("<wide>", "<narrow>", "<font>", "<small>", "<noBreak>")
    for cp in range(0x80, 0x20000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cf" and cp not in _VISIBLE_CF:
            out[cp] = None
        elif cat == "Zs":
            out[cp] = " "
        elif cat[0] in "LNPSM":
            kind, _, codes = unicodedata.decomposition(ch).partition(" ")
            compat = kind == "<compat>" and cat in ("Lu", "Ll", "Lt", "Nl") and not codes.startswith("0020")
            if kind in kinds or compat:
                # one step after the other: a wide form may stand for a letter that has a plain one itself
                out[cp] = "".join(out.get(ord(x), x) or "" for x in unicodedata.normalize("NFKC", ch))
    for low, high in _INVISIBLE:
        out.update(dict.fromkeys(range(low, high + 1)))
    out.update({ord(a): b for a, b in RARE_TWINS.items()} | {ord(a): "-" for a in HYPHENS} | {ord(a): b for a, b in ELLIPSIS.items()})
    return out


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that may compose with one before them: marks, and what stands second in a canonical decomposition (vowels and finals of Hangul, too)."""
    out = {chr(cp) for cp in range(0x300, 0x20000) if unicodedata.combining(chr(cp))} | {chr(cp) for cp in range(0x1161, 0x11C3)}
    for cp in range(0xC0, 0x20000):
        if not 0xAC00 <= cp < 0xE000:
            out.update(unicodedata.normalize("NFD", chr(cp))[1:])
    return frozenset(out)


@lru_cache(maxsize=1)
def _changing() -> re.Pattern:
    """Any character that _single() changes, or that composes with one before it."""
    parts, run = [], None
    codes = sorted({*_single(), *map(ord, _joining()), 0x212A, 0x212B, 0x2126, *range(0xF900, 0xFB00)})
    for cp in [*codes, sys.maxunicode + 1]:
        if run and cp == run[1] + 1:
            run[1] = cp
        else:
            if run:
                parts.append(re.escape(chr(run[0])) + ("-" + re.escape(chr(run[1])) if run[1] > run[0] else ""))
            run = [cp, cp]
    return re.compile("[" + "".join(parts) + "]")


@lru_cache(maxsize=1)
def _combining() -> re.Pattern:
    return re.compile("[" + "".join(sorted(_joining())) + "]")


def _all_letters() -> tuple[dict[str, int], dict[str, dict[int, str]]]:
    """Letter -> script; look-alike class (its Latin letter) -> script -> letter."""
    script, classes = {}, {}
    for s, blocks in _BLOCKS.items():
        for low, high in blocks:
            script.update({chr(cp): s for cp in range(low, high + 1) if chr(cp).isalpha()})
    for s, twins in _TWINS.items():
        for letter, latin in twins.items():
            classes.setdefault(latin, {LATIN: latin})[s] = letter
    return script, classes


SCRIPT, CLASSES = _all_letters()
_CLASS_OF = {letter: latin for latin, variants in CLASSES.items() for letter in variants.values()}
_TO_CLASS = {ord(letter): latin for letter, latin in _CLASS_OF.items()}
_OTHER = "Ͱ-ϿЀ-ԯԱ-և"
_HAS_OTHER = re.compile(f"[{_OTHER}]")
_TWIN_SET = "".join(sorted(_CLASS_OF))
_LATIN_SET = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = "̀-ͯ"
#: A token to be searched: letters of two scripts side by side, or nothing but look-alikes.
_DOUBTFUL = re.compile(
    f"[{_LATIN_SET}{_OTHER}{_MARKS}]*(?:[{_LATIN_SET}][{_MARKS}]*[{_OTHER}]|[{_OTHER}][{_MARKS}]*[{_LATIN_SET}])[{_LATIN_SET}{_OTHER}{_MARKS}]*"
    f"|(?<![{_LATIN_SET}{_OTHER}{_MARKS}])[{_TWIN_SET}{_MARKS}]+(?![{_LATIN_SET}{_OTHER}{_MARKS}])"
)
_SURE = {s: re.compile("[" + "".join(c for c, of in SCRIPT.items() if of == s and c not in _CLASS_OF) + "]+") for s in _BLOCKS}
_CHANGE = -200.0  # log score of a change of script inside a token
_OUT = -1000  # of a script that can't be meant
_FLOOR = -9.0  # log score of a bigram that was never seen


class ScriptScores:
    """Log scores of character bigrams by script: {(script, first, second): log p}; "" stands for a token's border."""

    def __init__(self, counts: dict[tuple[int, str, str], int] | None = None):
        self.log: dict[tuple[int, str, str], float] = {}
        totals: dict[tuple[int, str], int] = {}
        for (s, a, _), n in (counts or {}).items():
            totals[s, a] = totals.get((s, a), 0) + n
        for (s, a, b), n in (counts or {}).items():
            self.log[s, a, b] = math.log(n / totals[s, a])
        self.known: dict[tuple[str, tuple[int, ...]], str] = {}

    def best(self, classes: str, votes: tuple[int, ...]) -> str:
        """The best path through the lattice of a token given by its look-alike classes; votes: rounded log weights of the scripts."""
        out = self.known.get((classes, votes))
        if out is None:
            if len(self.known) > 200_000:
                self.known.clear()
            out = self.known[classes, votes] = self._search(classes, votes)
        return out

    def _search(self, classes: str, votes: tuple[int, ...]) -> str:
        log = self.log
        states: dict[tuple[int, str], tuple[float, str]] = {}
        for i, cls in enumerate(classes):
            options = {s: x for s, x in CLASSES[cls].items() if votes[s] > _OUT} if cls in CLASSES else {SCRIPT.get(cls, -1): cls}
            fresh = {}
            for s, letter in options.items():
                low = letter.lower()
                if s == -1 and states:  # a mark: it follows whatever stands before it
                    for (s0, _), (score, path) in states.items():
                        if (s0, "") not in fresh or score > fresh[s0, ""][0]:
                            fresh[s0, ""] = (score, path + letter)
                    continue
                if not states:
                    fresh[s, low] = (votes[s] + log.get((s, "", low), _FLOOR), letter) if s >= 0 else (0.0, letter)
                    continue
                fresh[s, low] = max(
                    ((score + (log.get((s, a, low), _FLOOR) if s0 == s else _CHANGE), path + letter) for (s0, a), (score, path) in states.items()),
                    key=lambda x: (x[0], -s),
                )
            states = fresh
        ends = [(score + log.get((s, a, ""), _FLOOR), -s, path) for (s, a), (score, path) in states.items()]
        return max(ends)[2]


NO_SCORES = ScriptScores()


def _votes(text: str) -> tuple[int, ...]:
    """Log weights of the scripts by a value's unambiguous letters, the first one 0, none below -9. A script other than Latin without
    any such letter is out: the same value written in Latin letters has nothing that hints at it."""
    sure = [sum(map(len, _SURE[s].findall(text))) for s in (LATIN, CYRILLIC, GREEK, ARMENIAN)]
    logs = [3 * math.log(0.05 + n) for n in sure]
    return tuple(_OUT if s != LATIN and not n else max(-9, round(x - max(logs))) for s, (n, x) in enumerate(zip(sure, logs)))


def _resolve(text: str, scores: ScriptScores) -> str:
    if not _HAS_OTHER.search(text):
        return text
    votes: list[tuple[int, ...]] = []

    def one(m: re.Match) -> str:
        if not votes:
            votes.append(_votes(text))
        return scores.best(m.group().translate(_TO_CLASS), votes[0])

    return _DOUBTFUL.sub(one, text)


def plain(text: str, scores: ScriptScores = NO_SCORES) -> str:
    """The plain form of a text."""
    if text.isascii():
        return text if text.isprintable() else text.translate(_single())
    if _changing().search(text):
        text = unicodedata.normalize("NFC", text.translate(_single()))
    resolved = _resolve(text, scores)
    return text if resolved == text else unicodedata.normalize("NFC", resolved)


def plain_with_offsets(text: str, scores: ScriptScores = NO_SCORES) -> tuple[str, list[int] | None]:
    """The plain form and, for each of its characters, the offset of the stored character that it comes from; None for
    offsets that are the same."""
    form = plain(text, scores)
    if form == text:
        return text, None
    single = _single()
    if not _combining().search(text):
        offsets, at = [], 0
        for m in _changing().finditer(text):
            i = m.start()
            offsets.extend(range(at, i))
            offsets.extend([i] * len(single.get(ord(m.group()), m.group()) or ""))
            at = i + 1
        offsets.extend(range(at, len(text)))
        if len(offsets) == len(form):
            return form, offsets
    joining = _joining()
    units: list[tuple[str, int]] = []
    for i, ch in enumerate(text):
        to = single.get(ord(ch), ch)
        if to:
            units.extend((x, i) for x in to)
    chars, offsets, k = [], [], 0
    while k < len(units):
        end = k + 1
        while end < len(units) and units[end][0] in joining:
            end += 1
        if end == k + 1 and units[k][0] < "̀":
            chars.append(units[k][0])
            offsets.append(units[k][1])
        else:
            for j, x in enumerate(unicodedata.normalize("NFC", "".join(u for u, _ in units[k:end]))):
                chars.append(x)
                offsets.append(units[min(k + j, end - 1)][1])
        k = end
    joined = _resolve("".join(chars), scores)
    if joined != form:  # marks composed with a resolved letter: align by composing piecewise
        again = unicodedata.normalize("NFC", joined)
        if again == form and len(again) < len(joined):
            kept, j = [], 0
            for x in again:
                kept.append(offsets[j])
                j += max(1, len(joined[j : j + 4]) - len(_rest(joined[j : j + 4], x)))
            offsets = kept[: len(form)]
    return form, offsets


def _rest(piece: str, composed: str) -> str:
    """What is left of `piece` after the shortest prefix that composes to `composed`."""
    for n in range(1, len(piece) + 1):
        if unicodedata.normalize("NFC", piece[:n]) == composed and (n == len(piece) or not unicodedata.combining(piece[n])):
            return piece[n:]
    return piece[1:]


#: Texts of these characters only are their own plain form; tested in the JVM, so that most rows never leave it. The rest is decided by plain().
UNTOUCHED = r"^[\t\n\x0b\f\r\x20-\x7e¡-¬®-´¶-İĴ-ľŁ-ňŊ-ž‒-―‘-‟、-〩ぁ-ゖァ-ヺー一-鿿가-힣]*+$"


def plain_column(value: Column, scores: ScriptScores = NO_SCORES) -> Column:
    """The plain form of a string column; null for null. Only values with characters in doubt go to Python, and only changed ones come back."""

    @F.arrow_udf(StringType())
    def changed(batch: pa.Array) -> pa.Array:
        out = []
        for text in batch.to_pylist():
            form = plain(text, scores) if text is not None else None
            out.append(form if form != text else None)
        return pa.array(out, pa.string())

    return F.coalesce(changed(F.when(~value.rlike(UNTOUCHED), value)), value)


def learn_script_scores(rows: DataFrame, column: str) -> ScriptScores:
    """Character bigram scores by script over all values of a column.

    Each task counts pairs of neighbouring letters of one script in an array and sends the counts; the driver gets
    at most one row for each pair of letters of the four scripts, whatever the number of texts. Null and empty
    values count for nothing; without any letters all scores are equal.
    """
    letters = sorted({x.lower() for x in SCRIPT if len(x.lower()) == 1})
    where = {x: i + 1 for i, x in enumerate(letters)}
    script_of = [SCRIPT.get(x, LATIN) for x in letters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(where) + 1
        table = np.zeros(0x590, np.int64)
        for x in SCRIPT:
            low = x.lower()
            if len(low) == 1 and ord(x) < len(table):
                table[ord(x)] = where[low]
        family = np.array([-1, *script_of])
        counts = np.zeros(n * n, np.int64)
        for batch in batches:
            text = "\n".join(x for x in batch.column(0).to_pylist() if x)
            codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            index = table[np.where(codes < len(table), codes, 0)]
            first, second = index[:-1], index[1:]
            same = (family[first] == family[second]) | (first == 0) | (second == 0)
            pairs = (first * n + second)[same]
            counts += np.bincount(pairs, minlength=n * n)
        seen = np.nonzero(counts)[0]
        seen = seen[seen > 0]
        yield pa.RecordBatch.from_arrays([pa.array(seen // n), pa.array(seen % n), pa.array(counts[seen])], names=["a", "b", "n"])

    pairs = rows.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    counts = {}
    for a, b, n in pairs:
        s = script_of[(a or b) - 1]
        counts[s, letters[a - 1] if a else "", letters[b - 1] if b else ""] = n
    return ScriptScores(counts)
