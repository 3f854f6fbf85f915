"""Hashes of texts, computed over the bytes of many texts at once.

The UTF-8 bytes of an Arrow column go through lookup tables, in numpy: bytes to code points, code points to the characters of their plain form (wide, narrow
and ligature forms, marks apart from their letters, nothing for what doesn't show), letters that look alike to those of one script, letter case
folded, and what is no letter or digit flagged. Rolling polynomial hashes (modulo 2^64, two bases) are summed over what remains. No canonical
string is made. A hash is a pair of uint64.

Which script a token's look-alikes belong to is decided by its unambiguous letters, and where it has none, by those of the whole text. This depends only on how the text looks, so
texts of one plain form always have one stream.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm import plainform

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_GAP = np.uint64(0x2545F4914F6CDD1D)  # stands for any run of skipped characters between two words
_TOP = 0x20000  # code points beyond are letters that stand for themselves, or nothing
WORD, SPACE, MARK = 1, 2, 4
#: Characters of a chunk of texts that is worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _mix_table(seed: int) -> np.ndarray:
    return mix(np.arange(_TOP), seed)


def _mixed(codes: np.ndarray, seed: int = 0) -> np.ndarray:
    """mix() of characters, from a table."""
    return _mix_table(seed)[codes] if not len(codes) or codes.max() < _TOP else mix(codes, seed)


@lru_cache(maxsize=1)
def _plain_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number, characters): the plain characters of each code point, marks apart."""
    single = plainform._single()
    number = np.ones(_TOP, np.uint8)
    flat: list[int] = list(range(_TOP))
    start = np.arange(_TOP, dtype=np.int32)
    for cp in range(0x80, _TOP):
        if 0xD800 <= cp < 0xE000:
            continue
        to = single.get(cp, "")
        to = "" if to is None else to or chr(cp)
        apart = unicodedata.normalize("NFD", to)
        if len(apart) != 1 or ord(apart) != cp:
            start[cp], number[cp] = len(flat), len(apart)
            flat.extend(map(ord, apart))
    for cp in range(0x80):
        if cp in single:
            number[cp] = 0
    return start, number, np.array(flat, np.uint32)


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, flags) of each character."""
    lower, flags = np.arange(_TOP, dtype=np.uint32), np.zeros(_TOP, np.uint8)
    for cp in range(_TOP):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        if ch.isalnum():
            lower[cp], flags[cp] = ord(ch.lower()[0]), WORD
        elif ch.isspace():
            flags[cp] = SPACE
        elif unicodedata.combining(ch):
            flags[cp] = MARK
    lower[0x3C2] = 0x3C3  # a final sigma
    return lower, flags


@lru_cache(maxsize=1)
def _twins() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(script or -1, look-alike class or -1) of each character, and the letter of each class and script."""
    script, cls = np.full(_TOP, -1, np.int8), np.full(_TOP, -1, np.int16)
    for ch, s in plainform.SCRIPT.items():
        script[ord(ch)] = s
    # letters with marks are apart: their look-alikes are those of the bare letters
    bare = {k: v for k, v in plainform.CLASSES.items() if len(unicodedata.normalize("NFD", k)) == 1}
    letters = np.zeros((len(bare), 4), np.uint32)
    for k, (latin, variants) in enumerate(bare.items()):
        letters[k] = [ord(variants.get(s, latin)) for s in range(4)]
        for s, ch in variants.items():
            cls[ord(ch)] = k
    return script, cls, letters


@lru_cache(maxsize=10_000)
def _composes(base: int, mark: int) -> bool:
    """Whether a letter, or one that looks like it, has a form of its own with a mark."""
    _, cls, letters = _twins()
    bases = [base, *letters[cls[base]]] if base < _TOP and cls[base] >= 0 else [base]
    return any(len(unicodedata.normalize("NFC", chr(b) + chr(mark))) == 1 for b in bases)


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 bytes, and the byte offset of each (None: one byte each)."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), None
    at = np.nonzero((data & 0xC0) != 0x80)[0]
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    first = data[at]
    codes = first.astype(np.uint32)
    for low, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        k = np.nonzero((first >= low) & ((first < low + (0x20 if more == 1 else 0x10 if more == 2 else 0x08))))[0]
        if len(k):
            value = (first[k] & mask).astype(np.uint32)
            for j in range(1, more + 1):
                value = (value << np.uint32(6)) | (padded[at[k] + j] & 0x3F)
            codes[k] = value
    return codes, at


class Chars:
    """The characters of texts: doc (ascending), code (plain, letter case folded), flags. twins: look-alike letters are those of one script."""

    def __init__(self, texts: pa.Array | list[str], twins: bool = True):
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        array = pc.cast(array, pa.large_binary())
        self.n = len(array)
        offsets = np.frombuffer(array.buffers()[1], np.int64, self.n + 1, array.offset * 8) if self.n else np.zeros(1, np.int64)
        data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if self.n and array.buffers()[2] is not None else np.zeros(0, np.uint8)
        codes, at = _code_points(data)
        edges = offsets - offsets[0]
        if at is not None:
            edges = np.searchsorted(at, edges)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(edges))
        codes, doc = self._plain(codes, doc)
        lower, flags = _kinds()
        far = np.nonzero(codes >= _TOP)[0] if at is not None else ()
        low = codes
        if len(far):
            low = codes.copy()
            low[far] = ord("a")
        self.doc, self.flags = doc, flags[low]
        if at is not None:
            self._marks(codes)
            if twins:
                low = self._one_script(low)
        self.code = lower[low]
        if len(far):
            self.code[far] = codes[far]

    def _plain(self, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters that the plain table has for each code point."""
        start, number, flat = _plain_table()
        at = np.nonzero((codes >= 0x7F) | (codes < 0x20))[0]
        own = codes[at]
        far = own >= _TOP
        known = np.where(far, 0x61, own)
        # tags and private planes don't show
        n = np.where(far, own < 0xE0000, number[known]).astype(np.uint8)
        codes[at] = np.where(far | (n == 0), own, flat[np.minimum(start[known], len(flat) - 1)])
        if (n == 1).all():
            return codes, doc
        counts = np.ones(len(codes), np.uint8)
        counts[at] = n
        where = np.repeat(np.arange(len(codes), dtype=np.int32), counts)
        out, doc = codes[where], doc[where]
        several = at[n > 1]
        if len(several):
            m = counts[several].astype(np.int64)
            ends = np.searchsorted(where, several)  # where the first of each several comes
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat(ends, m) + step] = flat[np.repeat(start[known[n > 1]], m) + step]
        return out, doc

    def _marks(self, codes: np.ndarray) -> None:
        """Marks that compose with the letter before them belong to the word."""
        marks = np.nonzero(self.flags & MARK)[0]
        if not len(marks):
            return
        base = np.where(self.flags & MARK, 0, np.arange(len(codes)))
        base = np.maximum.accumulate(base)[marks]
        fits = (self.doc[base] == self.doc[marks]) & ((self.flags[base] & WORD) != 0)
        pair = codes[base].astype(np.int64) << 32 | codes[marks].astype(np.int64)
        kinds, which = np.unique(pair, return_inverse=True)
        good = np.array([_composes(int(p >> 32), int(p & 0xFFFFFFFF)) for p in kinds], bool)
        self.flags[marks[fits & good[which]]] = WORD | MARK

    def _one_script(self, codes: np.ndarray) -> np.ndarray:
        other = (codes >= 0x370) & (codes < 0x590)
        if not other.any():
            return codes
        mixed = np.zeros(self.n, bool)
        mixed[self.doc[other]] = True
        script, cls, letters = _twins()
        at = np.nonzero(mixed[self.doc])[0]
        own = np.where(codes[at] < _TOP, codes[at], 0)
        doc, scr, c = self.doc[at], script[own], cls[own]
        letter = (scr >= 0) | ((self.flags[at] & MARK) != 0)
        token = np.cumsum(~letter | np.concatenate([[True], doc[1:] != doc[:-1]]))
        sure = (scr >= 0) & (c < 0)
        # a script's letters count once they are more than those of the scripts before it
        in_doc = np.bincount(doc[sure] * 4 + scr[sure], minlength=4 * self.n).reshape(-1, 4)
        in_token = np.bincount(token[sure] * 4 + scr[sure], minlength=4 * (int(token[-1]) + 1)).reshape(-1, 4)
        open_ = np.nonzero(c >= 0)[0]
        own_votes = in_token[token[open_]]
        target = np.where(own_votes.any(1), own_votes.argmax(1), in_doc[doc[open_]].argmax(1))
        codes = codes.copy()
        codes[at[open_]] = letters[c[open_], target]
        return codes


def chunks(array: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(offset, slice) of a column of texts, in slices of about CHUNK bytes."""
    sizes = pc.binary_length(array).fill_null(0).to_numpy()
    ends = np.cumsum(sizes)
    at = 0
    while at < len(array):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield at, array.slice(at, stop - at)
        at = stop


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASES[base])]))


def _power_of(base: int, exponents: np.ndarray) -> np.ndarray:
    top = int(exponents.max()) + 1 if len(exponents) else 1
    return _powers(base, 1 << max(10, (top - 1).bit_length()))[exponents]


def _doc_sums(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of values whose docs ascend."""
    out = np.zeros(n, np.uint64)
    if len(values):
        starts = np.concatenate([[0], np.nonzero(np.diff(docs))[0] + 1])
        with np.errstate(over="ignore"):
            out[docs[starts]] = np.add.reduceat(values, starts)
    return out


class WordStreams:
    """Texts as streams of words, or of all that shows.

    doc, code: of every kept character; first: whether a word begins there (with keep_all: a text). `docs` sets the parts of texts apart, if they are to have streams of their own.
    """

    def __init__(self, texts: pa.Array | list[str] | Chars, keep_all: bool = False, docs: np.ndarray | None = None, n: int | None = None, keep: np.ndarray | None = None):
        chars = texts if isinstance(texts, Chars) else Chars(texts)
        self.n = chars.n if n is None else n
        doc = chars.doc if docs is None else docs
        kept = (chars.flags & SPACE) == 0 if keep_all else (chars.flags & WORD) != 0
        if keep is not None:
            kept &= keep
        at = np.nonzero(kept)[0]
        self.doc, self.code = doc[at], chars.code[at]
        self.first = np.ones(len(at), bool)
        self.first[1:] = self.doc[1:] != self.doc[:-1]
        if not keep_all:
            self.first[1:] |= np.diff(at) > 1

    def text_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each text's words in order; 0 for a text without any."""
        if not len(self.doc):
            return np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        # place in the stream: kept characters and one gap before each word
        place = np.arange(len(self.doc)) + np.cumsum(self.first)
        doc_first = np.concatenate([[True], np.diff(self.doc) > 0])
        base = np.zeros(len(self.doc), np.int64)
        base[doc_first] = place[doc_first]
        place = place - np.maximum.accumulate(base) + 1
        out = []
        for k in range(2):
            values = _mixed(self.code, seed=k)
            with np.errstate(over="ignore"):
                terms = values * _power_of(k, place)
                terms[self.first] += _GAP * _power_of(k, place[self.first] - 1)
            out.append(_doc_sums(terms, self.doc, self.n))
        return out[0], out[1]

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc of each word, hash of each word)."""
        if not len(self.doc):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        starts = np.nonzero(self.first)[0]
        place = np.arange(len(self.doc)) - np.repeat(starts, np.diff(np.append(starts, len(self.doc))))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_mixed(self.code) * _power_of(0, place), starts)
        return self.doc[starts], mix(sums)

    def same_as(self, other: WordStreams) -> np.ndarray:
        """For each text whether the other's text has the same words in order, by comparing the streams themselves."""
        mine, theirs = (np.bincount(s.doc, minlength=s.n) for s in (self, other))
        same = mine == theirs
        a, b = same[self.doc], same[other.doc]
        differs = (self.code[a] != other.code[b]) | (self.first[a] != other.first[b])
        same[self.doc[a][differs]] = False
        return same


def weighted_sums(hashes: tuple[np.ndarray, np.ndarray], owners: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of sets of parts: for each owner the sum of its parts' mixed hashes, each times its weight. Equal weights make the
    order not count. owners ascend."""
    with np.errstate(over="ignore"):
        return tuple(_doc_sums(mix(h, seed=3 + k) * mix(weights, seed=7 + k), owners, n) for k, h in enumerate(hashes))
