"""Records that are the same but for their formatting.

The bytes of every value are streamed through lookup tables that skip and fold (textstream.Chars) into rolling polynomial hashes; for texts that are lists of fields, and for urls,
the parts are found on the same stream, hashed and summed with weights, equal ones where the order doesn't count. Only ids and 128-bit hashes are
grouped. Rows whose hashes collide are then compared with their group's first record, both streams skipping the
same characters up to the first that differs; what differs after all is grouped again by an independent hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.lookalikes import not_blank
from ledgerloom.llm.plainform import plain
from ledgerloom.llm.textstream import SPACE, WORD, Chars, WordStreams, chunks, weighted_sums
from ledgerloom.operators.scratch import Scratch

_BREAK = re.compile(r"[|;\r\n]+")
_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:([a-z][a-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?")
_DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_SPACE = re.compile(r"\s+")
_SCHEME, _HOST, _PARAMETER, _FRAGMENT, _SEGMENT = 1, 2, 3, 4, 1000


def field_parts(text: str) -> list[str]:
    """The fields of a text that is a list of two or more `label: value` fields as a whole; else nothing."""
    parts = [p for p in _BREAK.split(text) if p.strip()]
    return parts if len(parts) > 1 and all(map(_is_field, parts)) else []


def _is_field(part: str) -> bool:
    label, colon, value = part.partition(":")
    return bool(colon) and _WORD.search(label) is not None and not value.isspace() and value != ""


def url_parts(url: str) -> list[tuple[int, str]]:
    """(weight, part) of a plain url, letter case folded: what doesn't count is left out, parameters have one weight, path segments one for each place."""
    scheme, host, path, query, fragment = _URL.fullmatch(_SPACE.sub("", url).lower()).groups()
    out = []
    if scheme:
        out.append((_SCHEME, scheme))
    if host:
        name, colon, port = host.rpartition(":")
        if colon and (not port or port == _DEFAULT_PORTS.get(scheme)) and not port.endswith("]"):
            host = name
        out.append((_HOST, host))
    out.extend((_SEGMENT + i, part) for i, part in enumerate(p for p in path.split("/") if p))
    if query:
        out.extend((_PARAMETER, p) for p in query.split("&") if p)
    if fragment:
        out.append((_FRAGMENT, fragment))
    return out


def same_words(a: str, b: str) -> bool:
    """Two-pointer comparison: both pointers skip what is no word and stop at the first word that differs."""
    return a == b or all(x is not None and y is not None and x.group().lower() == y.group().lower() for x, y in zip_longest(_WORD.finditer(a), _WORD.finditer(b)))


def same_content(field: str, a: str, b: str) -> bool:
    """Whether two values are copies of one another, without any hash."""
    if a == b:
        return True
    a, b = plain(a), plain(b)
    if field == "url":
        (fixed_a, open_a), (fixed_b, open_b) = (([p for p in parts if p[0] != _PARAMETER], sorted(p for p in parts if p[0] == _PARAMETER)) for parts in map(url_parts, (a, b)))
        return fixed_a == fixed_b and open_a == open_b
    if not _WORD.search(a) or not _WORD.search(b):
        return _SPACE.sub("", a) == _SPACE.sub("", b)
    if same_words(a, b):
        return True
    parts_a, parts_b = field_parts(a), field_parts(b)
    if len(parts_a) != len(parts_b) or not parts_a:
        return False
    for part in parts_a:
        match = next((k for k, other in enumerate(parts_b) if same_words(part, other)), None)
        if match is None:
            return False
        parts_b.pop(match)
    return True


def _pack(high: np.ndarray, low: np.ndarray) -> list[bytes]:
    both = np.empty((len(high), 2), ">u8")
    both[:, 0], both[:, 1] = high, low
    data = both.tobytes()
    return [data[i : i + 16] for i in range(0, len(data), 16)]


def _sums(values: np.ndarray, n: int, by: np.ndarray) -> np.ndarray:
    return np.bincount(by[values], minlength=n)


def _any_of(codes: np.ndarray, signs: str) -> np.ndarray:
    return np.logical_or.reduce([codes == ord(x) for x in signs])


def _first_at(where: np.ndarray, by: np.ndarray, n: int, none: np.ndarray) -> np.ndarray:
    """The first of ascending places in each text or part, `none` where there is none."""
    out = none.copy()
    at = np.nonzero(where)[0][::-1]
    out[by[at]] = at
    return out


def _list_keys(chars: Chars) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(whether, hashes): texts that are lists of two or more `label: value` fields, and the hashes that leave the fields' order out."""
    # only texts with a colon and a sign between fields
    colons, cuts = (np.bincount(chars.doc[_any_of(chars.code, signs)], minlength=chars.n) > 0 for signs in (":", "|;\r\n"))
    at = np.nonzero((colons & cuts)[chars.doc])[0]
    code, doc, flags = chars.code[at], chars.doc[at], chars.flags[at]
    cut = _any_of(code, "|;\r\n")
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | cut[1:] | cut[:-1]
    part = np.cumsum(fresh) - 1
    m = int(part[-1]) + 1 if len(part) else 0
    owner = doc[fresh]
    shown = ((flags & SPACE) == 0) & ~cut
    far = np.full(m, len(code))
    colon = _first_at((code == ord(":")) & ~cut, part, m, far)
    place = np.arange(len(code))
    is_part = _sums(shown, m, part) > 0
    label = _sums(((flags & WORD) != 0) & (place < colon[part]), m, part) > 0
    value = _sums(shown & (place > colon[part]), m, part) > 0
    good = is_part & label & value & (colon < len(code))
    parts, fields = np.bincount(owner[is_part], minlength=chars.n), np.bincount(owner[good], minlength=chars.n)
    whole = (parts > 1) & (parts == fields)
    own = np.nonzero(is_part & whole[owner])[0]
    if not len(own):
        return whole, (np.zeros(chars.n, np.uint64), np.zeros(chars.n, np.uint64))
    number = np.full(m, -1)
    number[own] = np.arange(len(own))
    docs = np.full(len(chars.code), -1)
    docs[at] = number[part]
    hashes = WordStreams(chars, docs=docs, n=len(own), keep=docs >= 0).text_hashes()
    return whole, weighted_sums(hashes, owner[own], np.ones(len(own), np.uint64), chars.n)


def text_keys(texts: pa.Array | list[str]) -> tuple[list[bytes], list[bytes | None]]:
    """For each text the key of its words in order, and for lists of fields the key that leaves the order of the fields out."""
    chars = Chars(texts)
    high, low = WordStreams(chars).text_hashes()
    bare = (high == 0) & (low == 0)
    if bare.any():  # no letter and no digit: all that shows counts
        all_high, all_low = WordStreams(chars, keep_all=True, keep=bare[chars.doc]).text_hashes()
        high[bare], low[bare] = all_high[bare] ^ np.uint64(0xFFFF), all_low[bare] ^ np.uint64(0xFFFF)
    whole, sums = _list_keys(chars)
    packed = _pack(*sums) if whole.any() else None
    return _pack(high, low), [packed[i] if is_list else None for i, is_list in enumerate(whole.tolist())]


def url_keys(urls: pa.Array | list[str]) -> list[bytes]:
    """The key of each url: a state machine over its characters finds scheme, host, path, parameters and fragment, each part hashed by itself."""
    chars = Chars(urls)
    shown = np.nonzero((chars.flags & SPACE) == 0)[0]
    code, doc, n = chars.code[shown], chars.doc[shown], chars.n
    place = np.arange(len(code))
    begin = np.searchsorted(doc, np.arange(n))
    end = np.searchsorted(doc, np.arange(n), "right")
    is_ = lambda x: code == ord(x)
    fragment = _first_at(is_("#"), doc, n, end)
    query = np.minimum(_first_at(is_("?"), doc, n, end), fragment)
    colon = _first_at(is_(":"), doc, n, end)
    small = (code >= ord("a")) & (code <= ord("z"))
    in_scheme = small | ((code >= ord("0")) & (code <= ord("9"))) | is_("+") | is_(".") | is_("-")
    strange = _first_at(~in_scheme, doc, n, end)
    first = small[np.minimum(begin, max(0, len(code) - 1))] if len(code) else np.zeros(n, bool)
    has_scheme = (colon < end) & (strange == colon) & first & (colon > begin)
    rest = np.where(has_scheme, colon + 1, begin)
    slash = is_("/")
    padded = np.concatenate([slash, [False, False]])
    has_host = (rest + 1 < end) & padded[np.minimum(rest, len(slash))] & padded[np.minimum(rest + 1, len(slash) + 1)]
    host = np.where(has_host, rest + 2, rest)
    stops = _first_at(slash & (place >= host[doc]), doc, n, end)
    path = np.where(has_host, np.minimum(stops, query), rest)
    # 0 nothing, else the kind of part that a character is in
    kind = np.select(
        [place < (rest - 1)[doc], place < rest[doc], place < host[doc], place < path[doc], place < query[doc], place == query[doc], place < fragment[doc], place == fragment[doc]],
        [np.where(has_scheme[doc], _SCHEME, 0), 0, 0, _HOST, np.where(slash, 0, _SEGMENT), 0, np.where(is_("&"), 0, _PARAMETER), 0],
        _FRAGMENT,
    )
    ported = (kind == _HOST) & is_(":")
    for d in np.unique(doc[ported]).tolist():  # ports are rare
        name, _, port = "".join(map(chr, code[host[d] : path[d]])).rpartition(":")
        scheme = "".join(map(chr, code[begin[d] : rest[d] - 1])) if has_scheme[d] else None
        if (not port or port == _DEFAULT_PORTS.get(scheme)) and not port.endswith("]"):
            kind[host[d] + len(name) : path[d]] = 0
    at = np.nonzero(kind)[0]
    if not len(at):
        return _pack(np.zeros(n, np.uint64), np.zeros(n, np.uint64))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (doc[at][1:] != doc[at][:-1]) | (np.diff(at) > 1) | (np.diff(kind[at]) != 0)
    part = np.cumsum(fresh) - 1
    owner, weight = doc[at][fresh], kind[at][fresh].astype(np.int64)
    # segments count by their place
    segment = weight == _SEGMENT
    before = np.cumsum(segment) - segment
    weight[segment] += (before - before[np.searchsorted(owner, owner)])[segment]
    docs = np.full(len(chars.code), -1)
    docs[shown[at]] = part
    hashes = WordStreams(chars, keep_all=True, docs=docs, n=int(part[-1]) + 1, keep=docs >= 0).text_hashes()
    return _pack(*weighted_sums(hashes, owner, weight.astype(np.uint64), n))


def content_keys(rows: DataFrame, text: str = "captured_text", url: str = "url") -> DataFrame:
    """(field, id, key, list_key) of every value that is neither null nor blank; list_key is null but for lists of fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column, field in ((1, text), (2, url)):
                own = batch.column(column).is_valid()
                ids, values = batch.column(0).filter(own), batch.column(column).filter(own)
                for at, some in chunks(values):
                    keys, lists = text_keys(some) if field == text else (url_keys(some), [None] * len(some))
                    yield pa.RecordBatch.from_arrays([pa.array([field] * len(some), pa.string()), ids.slice(at, len(some)), pa.array(keys, pa.binary()), pa.array(lists, pa.binary())], names=["field", "id", "key", "list_key"])

    shown = (F.when(not_blank(F.col(c)), F.col(c)).alias(c) for c in (text, url))
    return rows.where(F.col("id").isNotNull()).select("id", *shown).mapInArrow(run, "field string, id string, key binary, list_key binary")


def _salt(column: str, salts: int):
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int").alias("salt")


def _grouped(members: DataFrame, salts: int) -> DataFrame:
    """(field, keep_id, copy_id, class, against) of members (field, id, class, against). A group's row is joined back over as many salts as
    its members have, so that a group of any share of the rows is spread, and a small one isn't multiplied."""
    salted = members.select("field", "id", "class", "against", _salt("id", salts))
    parts = salted.groupBy("field", "class", "salt").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    groups = parts.groupBy("field", "class").agg(F.min("least").alias("keep_id"), F.max("most").alias("last"), F.collect_list("salt").alias("salts")).where("keep_id <> last")  # at most `salts` rows a group
    groups = groups.select("field", "class", "keep_id", F.explode("salts").alias("salt"))
    return salted.join(groups, ["field", "class", "salt"]).where("id <> keep_id").select("field", "keep_id", F.col("id").alias("copy_id"), "class", "against").distinct()


def formatting_copies(rows: DataFrame, scratch: Scratch, text: str = "captured_text", url: str = "url", salts: int = 1024) -> DataFrame:
    """(field, keep_id, copy_id): see p4_found in TESTDATA.md; keep_id is the smallest id of the copies, one row for each other record.

    Null and blank values and rows without an id are never a case. Texts without a letter or digit are copies where all they show but white space is the
    same. Equal stored values are copies; repeated deliveries are one record. Other columns are not read.
    A group may hold any share of the rows: it is pre-aggregated, and spread over up to `salts` tasks.
    """
    mark = scratch.mark()
    keys = scratch.save(content_keys(rows, text, url))
    # A text that is no list may have the words of one; it then belongs to that list's class. Lists of one key are spread by their own key's salts.
    lists = keys.where(F.col("list_key").isNotNull()).groupBy("field", "key").agg(F.min("list_key").alias("of_list"), F.min("id").alias("list_id"))
    salted = keys.select("*", _salt("id", salts))
    spread = salted.select("field", "key", "salt").distinct().join(lists, ["field", "key"])
    # Such a text is compared with that list, all others with the record that is kept.
    against = F.when(F.col("list_key").isNull(), F.col("list_id")).alias("against")
    members = salted.join(spread, ["field", "key", "salt"], "left").select("field", "id", against, F.when(F.col("of_list").isNotNull(), F.concat(F.lit(b"L"), "of_list")).otherwise(F.concat(F.lit(b"W"), "key")).alias("class"))
    pairs = scratch.save(_grouped(members, salts))
    checked = scratch.save(_compare(pairs, rows, text, url, salts))
    scratch.release(mark, checked)
    wrong = checked.where(~F.col("same")).select("field", F.col("copy_id").alias("id"), F.lit(None).cast("string").alias("against"), F.concat("class", F.unhex(F.sha2("proof", 256))).alias("class"))
    return checked.where("same").select("field", "keep_id", "copy_id").unionByName(_grouped(wrong, salts).select("field", "keep_id", "copy_id"))


def _proof(field: str, value: str) -> str:
    """What two copies have in common, written out; only for rows whose hashes collide by chance."""
    form = plain(value)
    if field == "url":
        return repr(sorted(url_parts(form)))
    return repr(sorted([w.lower() for w in _WORD.findall(p)] for p in field_parts(form)) or [w.lower() for w in _WORD.findall(form)])


def _same(field: str, a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the values of two columns are copies. Words are compared as they are stored, both streams skipping what is no word; only pairs that
    differ so, by look-alikes, order of fields or in urls, are compared in full."""
    same = np.array(pc.equal(a, b).to_pylist(), bool)
    if field == "text":
        for at, some in chunks(a):
            one, two = (WordStreams(Chars(x, twins=False)) for x in (some, b.slice(at, len(some))))
            same[at : at + len(some)] |= one.same_as(two) & (np.bincount(one.doc, minlength=one.n) > 0)
    for i in np.nonzero(~same)[0].tolist():
        same[i] = same_content("url" if field == "url" else "text", a[i].as_py(), b[i].as_py())
    return same


def _compare(pairs: DataFrame, rows: DataFrame, text: str, url: str, salts: int) -> DataFrame:
    """pairs with same: whether the two stored values are copies, and proof where not."""
    values = rows.where(F.col("id").isNotNull()).select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in (text, url)))).alias("x")).select("id", "x.field", "x.value").where(F.col("value").isNotNull())
    # a kept record's value serves any number of copies: it is sent to the salts that they have
    pairs = pairs.withColumn("other_id", F.coalesce("against", "keep_id"))
    keeps = pairs.select("field", F.col("other_id").alias("id"), _salt("copy_id", salts)).distinct()
    kept = values.join(keeps, ["field", "id"]).groupBy("field", "id", "salt").agg(F.min("value").alias("keep_value")).withColumnRenamed("id", "other_id")
    copies = values.withColumnRenamed("id", "copy_id").join(pairs, ["field", "copy_id"]).withColumn("salt", _salt("copy_id", salts))
    both = copies.join(kept, ["field", "other_id", "salt"]).select("field", "keep_id", "copy_id", "class", "keep_value", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.zeros(batch.num_rows, bool)
            for field in (text, url):
                own = np.nonzero(np.array(pc.equal(batch.column(0), field).to_pylist(), bool))[0]
                if len(own):
                    same[own] = _same("url" if field == url else "text", *(batch.column(k).take(pa.array(own)) for k in (4, 5)))
            proof: list[str | None] = [None] * batch.num_rows
            for i in np.nonzero(~same)[0].tolist():
                proof[i] = _proof("url" if batch.column(0)[i].as_py() == url else "text", batch.column(5)[i].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(same, pa.bool_()), pa.array(proof, pa.string())], names=["field", "keep_id", "copy_id", "class", "same", "proof"])

    return both.mapInArrow(run, "field string, keep_id string, copy_id string, class binary, same boolean, proof string").distinct()
