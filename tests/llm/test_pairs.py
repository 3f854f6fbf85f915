import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import components, copies, neardup
from ledgerloom.llm.copies import _WORD, url_keys, url_parts
from ledgerloom.llm.plainform import plain
from ledgerloom.llm.textstream import WordStreams
from ledgerloom.operators.scratch import Scratch

TEXTS = "id string, captured_text string, url string, class string, key string, text string"


def _table(spark, rows):
    return spark.createDataFrame([(i, t, u, "x", "y", "z") for i, t, u in rows], TEXTS)


def _words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", plain(text))]


def _brute(rows):
    own = {}
    for i, t, _ in rows:
        if i is not None and t:
            w = _words(t)
            if len(w) >= 30:
                own[i] = (tuple(w), set(zip(w, w[1:], w[2:])))
    ids = sorted(own)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if own[a][0] != own[b][0] and len(own[a][1] & own[b][1]) >= 0.8 * len(own[a][1] | own[b][1])}


def _texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 90))]
        rows.append((f"s{k:04d}", " ".join(words), None))
        for v in range(rng.choice([0, 0, 1, 2, 6])):
            other = list(words)
            for _ in range(rng.randrange(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append((f"s{k:04d}v{v}", (" , " if v % 2 else " ").join(other).upper() if v == 1 else " ".join(other), None))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = _texts(1, 60) + [("n1", None, None), ("n2", "", None), ("n3", "too short", None), (None, "w " * 50, None)]
    rows += rows[:10]  # repeated deliveries
    got = {tuple(r) for r in neardup.near_duplicate_records(_table(spark, rows), Scratch(spark)).collect()}
    assert got == _brute(rows)


@pytest.mark.parametrize("limit", [2, 8])
def test_long_lists_lose_no_pair(spark, limit):
    """Many variants of one text: every list is beyond the limit, and the second lists too."""
    rng = random.Random(7)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(40):
        words = list(base)
        words[rng.randrange(60)] = f"x{k}"
        rows.append((f"s{k:03d}", " ".join(words), None))
    scratch = Scratch(spark)
    pairs, members = neardup.near_duplicates(_table(spark, rows), scratch, list_limit=limit)
    names = {bytes(r["class"]): r["id"] for r in members.collect()}
    got = {tuple(sorted((names[bytes(a)], names[bytes(b)]))) for a, b in pairs.collect()}
    assert got == _brute(rows)


def test_near_duplicates_of_an_empty_table(spark):
    assert neardup.near_duplicate_records(spark.createDataFrame([], TEXTS), Scratch(spark)).count() == 0


def test_copies(spark):
    rows = [
        ("b", "One two, three!", "http://Host:80/a//b/?x=1&y=2#"), ("a", "ONE  two\nthree", "http://host/a/b?y=2&x=1"), ("c", "one twothree", "https://host/a/b?y=2&x=1"),
        ("d", "Color: red\nSize: 4", " http://host/A/B/?x=1&&y=2 "), ("e", "size: 4 | COLOR: Red", "http://host:81/a/b?x=1&y=2"), ("f", "color red size 4", None),
        ("g", "size 4 color red", ""), ("h", None, None), ("i", "", "  "), ("j", "🚀 !!", None), ("k", "🚀!!", None), ("l", "🎉", None), (None, "one two three", None), ("a", "ONE  two\nthree", "http://host/a/b?y=2&x=1"),
    ]
    got = {tuple(r) for r in copies.formatting_copies(_table(spark, rows), Scratch(spark)).collect()}
    assert got == {
        ("captured_text", "a", "b"), ("captured_text", "d", "e"), ("captured_text", "d", "f"), ("captured_text", "d", "g"), ("captured_text", "j", "k"),
        ("url", "a", "b"), ("url", "a", "d"),
    }


def test_copies_of_an_empty_table(spark):
    assert copies.formatting_copies(spark.createDataFrame([], TEXTS), Scratch(spark)).count() == 0


def test_content_comparison_needs_no_hash():
    assert copies.same_content("captured_text", "A: x y\nB: z", "b: z ; a: X-y")
    assert not copies.same_content("captured_text", "A: x y\nB: z", "b: z ; a: X")
    assert not copies.same_content("captured_text", "a bc", "ab c")
    assert copies.same_content("url", "HTTPS://h:443/p/", "https://h/p?#")
    assert not copies.same_content("url", "https://h/p?a=1", "https://h/p?a=2")


def test_equal_hashes_are_verified(spark):
    """Texts that only a broken hash takes for copies come out apart, and copies among them together."""
    rows = _table(spark, [("a", "one", None), ("b", "two", None), ("c", "TWO", None)])
    pairs = spark.createDataFrame([("captured_text", "a", "b", bytearray(b"k"), None), ("captured_text", "a", "c", bytearray(b"k"), None)], "field string, keep_id string, copy_id string, class binary, against string")
    checked = copies._compare(pairs, rows, "captured_text", "url", 4)
    assert {r["same"] for r in checked.collect()} == {False}
    assert len({r["proof"] for r in checked.collect()}) == 1


def _union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {(x, find(x)) for x in list(parent)}


@pytest.mark.parametrize("hot", [100_000, 3])
def test_components_equal_union_find(spark, hot):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(80):03d}", f"n{rng.randrange(80):03d}") for _ in range(50)]
    links += [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)]  # a chain
    links += [("hub", f"h{k}") for k in range(40)]  # a hub
    links += [("hub", "h1"), ("h1", "hub"), (None, "x"), ("y", None), ("loop", "loop")]
    table = spark.createDataFrame(links, "a string, b string")
    got = {tuple(r) for r in components.connected_components(table, Scratch(spark), hot_degree=hot).collect()}
    assert got == _union_find(links)


def test_components_without_links(spark):
    assert components.connected_components(spark.createDataFrame([], "a string, b string"), Scratch(spark)).count() == 0


def test_ledger_links(spark):
    review = "array<struct<other_source_id:string,decision:string,reason:string>>"
    rows = spark.createDataFrame(
        [("a", " B ", [("c", "independent", None)]), ("b", None, [("C", "same_source", None)]), ("c", "", []), ("d", "d", None), ("e", "gone", [(None, "same_source", "x")]), (None, "a", None), ("a", " B ", [])],
        f"id string, repost_of string, duplicate_reviews {review}",
    )
    assert {tuple(r) for r in components.ledger_groups(rows, Scratch(spark)).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def _found(spark, rows, **options):
    pairs, members = neardup.near_duplicates(_table(spark, rows), Scratch(spark), **options)
    names = {}
    for r in members.collect():
        names.setdefault(bytes(r["class"]), []).append(r["id"])
    return {tuple(sorted((x, y))) for a, b in pairs.collect() for x in names[bytes(a)] for y in names[bytes(b)]}


@pytest.mark.parametrize("limit", [2, 64])
def test_a_list_of_one_triple_beyond_the_limit_loses_no_pair(spark, limit):
    """70 variants whose sets are the same three shingles: one triple is all that each two of them share."""
    rows = [(f"s{k}", " ".join((["a", "b", "c"] * 34)[:k]), None) for k in range(30, 100)]
    assert _found(spark, rows, list_limit=limit) == _brute(rows)


@pytest.mark.parametrize("block, row", [(8, 10**6), (8, 0)])
def test_lists_split_or_paired_in_blocks_lose_no_pair(spark, monkeypatch, block, row):
    monkeypatch.setattr(neardup, "_BLOCK", block)
    monkeypatch.setattr(neardup, "_ROW", row)
    rows = _texts(5, 30) + [(f"x{k}", " ".join((["a", "b", "c", "d"] * 12)[:k]), None) for k in range(30, 44)] + [(f"y{k}", " ".join(["a"] * k), None) for k in range(30, 44)]
    assert _found(spark, rows, list_limit=1) == _brute(rows)


def test_sets_of_few_shingles(spark):
    """Equal sets of one, two and four shingles in different sequences, and sets of four and five."""
    rows = [(f"o{k}", " ".join(["one"] * k), None) for k in (30, 31, 40)] + [(f"t{k}", " ".join((["up", "down"] * 20)[:k]), None) for k in (30, 31, 33)]
    rows += [(f"f{k}", " ".join((["a", "b", "c", "d"] * 12)[:k]), None) for k in (30, 35, 36)] + [("g", " ".join((["a", "b", "c", "d"] * 12)[:36] + ["e"]), None)]
    assert len(_brute(rows)) > 8
    assert _found(spark, rows) == _brute(rows) == _found(spark, rows, list_limit=2)


@pytest.mark.parametrize(
    "a, b",
    [("Ｗｉｄｅ　text", "Wide text"), ("caf\u0065\u0301", "café"), ("fusiόn aqui", "fusión aqui"), ("ﬁne‑tuned", "fine-tuned"), ("z\u200bero", "zero"), ("Рrоblеm solved", "Problem solved"), ("привет BОТ", "привет ВОТ"), ("𝐁old", "Bold"), ("한글", "\u1112\u1161\u11ab\u1100\u1173\u11af")],
)
def test_streams_of_equal_looking_texts_are_equal(a, b):
    one, two = (list(zip(*map(list, WordStreams([x]).text_hashes()))) for x in (a, b))
    assert one == two and [w.lower() for w in _WORD.findall(plain(a))] == [w.lower() for w in _WORD.findall(plain(b))]


def test_streams_keep_what_differs():
    texts = ["vow", "now", "resume", "résumé", "bot", "вот", "a b", "ab", "ab c", "a bc", ""]
    assert len(set(zip(*map(list, WordStreams(texts).text_hashes())))) == len(texts)


URL_PARTS = st.lists(st.sampled_from(["http", "HTTPS", "ftp:", ":", "//", "/", "a.example", ":80", ":443", "[::1]", "?", "&", "x=1", "y=2", "#", "f", " ", "\t", "Ｋ", "é", "mailto:", "1+", "b"]), max_size=10).map("".join)


@settings(max_examples=300, deadline=None)
@given(urls=st.lists(URL_PARTS, min_size=2, max_size=6))
def test_the_state_machine_parts_urls_as_the_plain_way_does(urls):
    def parts(url):
        found = url_parts(plain(url))
        return [p for p in found if p[0] != 3], sorted(p for p in found if p[0] == 3)

    keys = url_keys(urls)
    for i, a in enumerate(urls):
        for j, b in enumerate(urls):
            assert (keys[i] == keys[j]) == (parts(a) == parts(b)), (a, b)
