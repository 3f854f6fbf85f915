import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import urls as U
from ledgerloom.operators import experiments, exposure, links, records, references, similar, summaries
from ledgerloom.operators.scratch import Scratch
from ledgerloom.sources import artifacts, strict_json


def _one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


def _t(month, day=1):
    return dt.datetime(2026, month, day)


LEDGER = "id string, loaded_at timestamp, repost_of string, query_ids array<string>, target_id string, reason string"
QUERY = "id string, loaded_at timestamp, included_source_ids array<string>, period string"
SIGNAL = "id string, loaded_at timestamp, support_citations array<string>, key string"


def _tables(spark, ledger=(), queries=(), signals=()):
    return {
        "source_ledger": spark.createDataFrame([(*r, "x", "y") for r in ledger], LEDGER),
        "query_log": spark.createDataFrame([(*r, "x") for r in queries], QUERY),
        "signal_catalog": spark.createDataFrame([(*r, "x") for r in signals], SIGNAL),
    }


def test_orphans(spark):
    tables = _tables(
        spark,
        [("a", _t(1), " B ", ["q1", None, "  ", "Q1", "q9"]), ("b", _t(2), None, None), ("b", _t(3), None, None), ("c", _t(2), "gone", []), ("d", _t(3), "a", ["q1"]), (None, _t(1), "zz", None), ("e", None, "nope", None)],
        [("q1", _t(1, 20), ["a", "b", "x", "X "])],
        [("s", _t(1), ["c", "c", "gone"])],
    )
    retracted = spark.createDataFrame([("source_ledger", "GONE"), ("query_log", "x"), ("source_ledger", "a"), (None, None)], "table_name string, id string")
    got = {tuple(r) for r in references.orphan_references(tables, retracted).collect()}
    assert got == {
        ("source_ledger", "repost_of", "a", "b", "late", "2026-01"), ("source_ledger", "query_ids", "a", "q9", "missing", "2026-01"), ("source_ledger", "repost_of", "c", "gone", "deleted", "2026-02"),
        ("source_ledger", "repost_of", "e", "nope", "missing", None), ("query_log", "included_source_ids", "q1", "b", "late", "2026-01"), ("query_log", "included_source_ids", "q1", "x", "missing", "2026-01"),
        ("signal_catalog", "support_citations", "s", "c", "late", "2026-01"), ("signal_catalog", "support_citations", "s", "gone", "deleted", "2026-01"),
    }
    report = {tuple(r) for r in references.orphan_report(references.orphan_references(tables, retracted)).collect()}
    assert ("signal_catalog", "support_citations", "late", "2026-01", 1, 1) in report


def test_orphans_of_empty_tables(spark):
    retracted = spark.createDataFrame([], "table_name string, id string")
    assert references.orphan_references(_tables(spark), retracted).count() == 0


def test_a_hot_target_comes_out_whole(spark):
    tables = _tables(spark, [(f"r{k}", _t(1), "hot", None) for k in range(500)])
    got = references.orphan_references(tables, spark.createDataFrame([], "table_name string, id string"))
    assert got.count() == 500 and got.select("reason").distinct().collect()[0][0] == "missing"


@pytest.mark.parametrize(
    "function, value, expected",
    [
        (T.collapse_white_space, " a b\n\tc ", "a b c"), (T.ascii_lower, "ÀI", "Ài"), (T.normalise, "Ａ　ﬁ", "A fi"), (T.platform, " HN ", "hackernews"), (T.duplicate_text_key, "A &amp; B", "a & b"),
        (T.word_count, "  ", 0), (T.word_count, "one two", 2), (T.csv_safe, " =1", "' =1"), (T.csv_safe, "a=1", "a=1"), (T.sha256_tag, "", "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
        (U.host, "HTTPS://Example.ORG.:8080/x", "example.org"), (U.port, "https://h:81/x", 81), (U.parameter_names, "http://h/?A=1&b&a=2#x?c=1", ["a", "b"]),
    ],
)
def test_functions(spark, function, value, expected):
    assert _one(spark, function, value) == expected


def test_keyed_hashes(spark):
    import hashlib
    import hmac

    from ledgerloom.functions.keys import hmac_sha256, pseudonym

    for key in (b"k", b"x" * 100):
        assert _one(spark, lambda c, key=key: hmac_sha256(key, c), "añb") == hmac.new(key, "añb".encode(), hashlib.sha256).hexdigest()
        assert _one(spark, lambda c, key=key: hmac_sha256(key, c), None) is None
    assert _one(spark, lambda c: pseudonym(b"k", F.lit("p"), c), "h") == "author:" + hmac.new(b"k", b"author-key\0p\0h", hashlib.sha256).hexdigest()[:16]


def test_short_text_pairs(spark):
    rows = spark.createDataFrame([("a", "we have the very same words"), ("b", "we have the very same words"), ("c", "we have the very same words"), ("d", "too short"), ("e", None)], "id string, t string")
    roots = spark.createDataFrame([("b", "a"), ("a", "a")], "id string, root string")
    assert {tuple(r) for r in records.short_text_pairs(rows.where(F.length("t") >= 20).withColumnRenamed("t", "key"), roots).collect()} == {("a", "c")}


def test_word_grams(spark):
    grams = lambda v: _one(spark, lambda c: T.word_grams(c, 2), v)
    assert grams("A b  a B") == ["a b", "b a"] and grams("a") == [] and grams("") == [] and grams(None) == []


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://Ex.org:80/a/../b/./%7ec?q=%c3%a9#F", ("http://ex.org/b/~c?q=%C3%A9#F", None)), ("https://[2001:DB8::0:1]:444", ("https://[2001:db8::1]:444/", None)), ("ftp://x/", (None, "scheme")), ("https://u:p@x/", (None, "userinfo")),
        ("https://x/?access_token=1", (None, "credential")), ("https://-x.org/", (None, "host")), ("https://x:0/", (None, "port")), ("https://x\\y/", (None, "character")), ("https://x:999999/", (None, "syntax")),
    ],
)
def test_canonical_url(url, expected):
    assert U.canonical_url(url) == expected


def test_labels_spread(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(35)] + [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {tuple(r) for r in records.spread_labels(spark.createDataFrame(pairs, "a string, b string"), Scratch(spark)).select("id", "root").collect()}
    assert got == {(x, find(x)) for x in parent}


def test_cycles(spark):
    rows = [("a", "b"), ("b", "C "), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "g"), ("g", None), ("h", "zz")]
    got = {r["id"] for r in records.repost_cycles(spark.createDataFrame(rows, "id string, repost_of string"), Scratch(spark)).collect()}
    assert got == {"a", "b", "c", "e"}


def test_representatives_hide_the_order_of_private_records(spark):
    rows = spark.createDataFrame([("b", _t(1), "public", None), ("a", _t(2), "public", None), ("d", _t(1), "public", None), ("c", _t(2), "private", None)], "id string, published_at timestamp, visibility string, repost_of string")
    roots = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")], "id string, root string")
    assert {(r.root, r.representative) for r in records.representatives(rows, roots).collect()} == {("a", "b"), ("c", "c")}


def test_similar_classes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(200)}" for _ in range(60)]
        rows.append((k * 10, " ".join(words)))
        for v in range(3):
            other = list(words)
            if v:
                other[rng.randrange(v, 60)] = "changed"
            rows.append((k * 10 + v + 1, "  ".join(other).upper()))
    rows += [(9001, None), (9002, ""), (9003, "short")]
    pairs, members = similar.similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark), "doc_id", "text")
    own = {r["class"] for r in members.collect()}
    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows if i in own}
    truth = {(a, b) for a in own for b in own if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]) - 1e-9}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == truth and truth


def test_exposure(spark):
    private = spark.createDataFrame([("p", "our secret plan leaks now"), ("q", "hush hush"), ("r", None)], "id string, t string")
    public = spark.createDataFrame([("a", "the Secret  plan leaks now again"), ("b", "secret plan"), ("c", "say hush hush"), ("d", None)], "id string, t string")
    targets = exposure.unpivot(public, "out", "id", {"t": F.col("t")})
    got = {tuple(r) for r in exposure.output_exposure(targets, private.select(F.col("t").alias("value")), ("id",), ()).collect()}
    assert got == {("out", "a", "t", "private_text"), ("out", "c", "t", "private_text")}


def test_running_total_and_order(spark):
    rows = spark.createDataFrame([(f"k{k:03d}", k) for k in range(100)], "k string, n bigint")
    assert {r.k: r.total for r in links.running_total(rows, "k", "n", Scratch(spark)).collect()}["k099"] == 4950
    placed = experiments.keyed_order(rows, "k", "key", Scratch(spark)).collect()
    assert sorted(r.position for r in placed) == list(range(100)) and [r.id for r in sorted(placed, key=lambda r: r.position)] != sorted(r.id for r in placed)


def test_ratings_and_bootstrap(spark):
    ratings = spark.createDataFrame([(1, 1, 0, 4, 3), (1, 2, 2, 3, 0), (2, 1, None, 1, 1)], "blind_id int, dimension int, rater_a int, rater_b int, adjudicator int")
    assert {(r.blind_id, r.dimension, r.rating) for r in experiments.resolved_ratings(ratings).collect()} == {(1, 1, 3.0), (1, 2, 2.5), (2, 1, None)}
    row = experiments.bootstrap_interval(spark, {"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0]}, draws=500).first()
    assert 1.0 <= row.low <= 2.5 <= row.high <= 4.0
    assert row == experiments.bootstrap_interval(spark, {"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0]}, draws=500).first()
    assert experiments.bootstrap_interval(spark, {}).count() == 0


def test_fingerprint_is_independent_of_order(spark):
    rows = [(f"{k}", None if k % 3 else "x") for k in range(50)]
    one = summaries.fingerprint(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first()
    two = summaries.fingerprint(spark.createDataFrame(rows[::-1], "a string, b string").repartition(7), ["a", "b"]).first()
    assert one == two and one != summaries.fingerprint(spark.createDataFrame(rows[1:], "a string, b string"), ["a", "b"]).first()


@pytest.mark.parametrize(
    "text, fault",
    [('{"a":1}', None), ('{"a":1,"a":2}', "repeated_key"), ('{"a":NaN}', "not_finite"), ('{"a":1} x', "syntax"), ('{"a":"\\ud800"}', "surrogate"), ("[1]", "no_object"), ('{"a":' + "[" * 101 + "]" * 101 + "}", "depth"), ('{"a":1' + "0" * 300 + "}", "long_number"), ('{"a":1e999}', "not_finite")],
)
def test_strict_json(text, fault):
    assert strict_json.check_json(text) == fault


def test_jsonl(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    (tmp_path / "x.jsonl").write_text('{"id":"a","n":1}\n\n{"id":"b","n":2,"z":1}\n{"id":"c"}\n{bad\n{"id":"d","n":4}\n')
    (tmp_path / "y.jsonl").write_bytes(b"\xff\xfe")
    rows, faults = strict_json.read_jsonl(spark, str(tmp_path), StructType([StructField("id", StringType()), StructField("n", LongType())]))
    assert {(r.line, r.id, r.n) for r in rows.collect()} == {(1, "a", 1), (6, "d", 4)}
    assert {(r.line, r.fault) for r in faults.collect()} == {(3, "unknown_key"), (4, "missing_key"), (5, "syntax"), (0, "encoding")}
    assert {r.path for r in strict_json.file_manifest(spark, str(tmp_path)).collect()} == {"x.jsonl", "y.jsonl"}


def test_artifacts(tmp_path):
    folder = str(tmp_path / "out")
    contents = {"a.csv": artifacts.render_csv(["x", "y"], [["=1", None], [["b", "a"], 2]]), "b.json": artifacts.render_json({"b": 1, "a": "é"})}
    assert contents["a.csv"] == "x,y\n'=1,\nb;a,2\n" and json.loads(contents["b.json"]) == {"a": "é", "b": 1}
    artifacts.write_artifacts(folder, contents)
    assert artifacts.compare_artifacts(folder, contents) == {}
    artifacts.write_artifacts(folder, {"a.csv": "new"})
    assert artifacts.compare_artifacts(folder, contents) == {"a.csv": "modified", "b.json": "missing"}
    with pytest.raises(ValueError):
        artifacts.write_artifacts(folder, {"../x": ""})
    assert artifacts.escape_markdown("<b>*‮") == "&lt;b&gt;\\*\\\\u202e"


def test_stream_without_repeats(spark, tmp_path):
    from ledgerloom.streaming.deliveries import deliveries_per_window, delivered, without_repeats

    folder = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", _t(1), "p"), ("a", _t(1, 3), "p"), ("b", _t(1, 5), "q"), ("c", _t(2), "q")], "id string, loaded_at timestamp, platform string")
    rows.coalesce(1).write.parquet(folder)
    stream = delivered(spark, folder, rows.schema)
    for name, out, n in (("one", without_repeats(stream), 3), ("two", deliveries_per_window(stream), 3)):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(name).count() >= n - 1


def test_optional_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("ledgerloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ledgerloom.llm", None)
    try:
        alone = importlib.reload(__spark_entry__)
        assert "p3_found" in alone.queries() and "p7_ids" not in alone.queries()
        assert set(alone.oracle_sql()) <= set(alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_bootstrap_of_effects_draws_pairs(spark):
    """Cases of one mean: all variation is between pairs within them."""
    lifts = [float(x) for x in range(-10, 11)]
    rows = [(c, x) for c in range(4) for x in lifts] + [(1, None), (None, 3.0)]
    row = experiments.bootstrap_interval_of_effects(spark.createDataFrame(rows, "case_id int, lift double"), draws=4_000).first()
    spread = 1.96 * (sum(x * x for x in lifts) / len(lifts) / len(lifts) / 4) ** 0.5
    assert abs(row.low + spread) < 0.15 * spread and abs(row.high - spread) < 0.15 * spread
    own = experiments.bootstrap_interval(spark, {str(c): lifts for c in range(4)}, draws=4_000).first()
    assert abs(row.low - own.low) < 0.15 * spread and abs(row.high - own.high) < 0.15 * spread
    assert experiments.bootstrap_interval_of_effects(spark.createDataFrame([], "case_id int, lift double")).count() == 0


def test_the_bootstrap_query_draws_pairs(spark, monkeypatch):
    from ledgerloom.plans import experiment_queries

    totals = [(p % 2, p, c, float(p // 2 % 5) if c == "skill" else 0.0) for p in range(40) for c in ("baseline", "skill")]
    monkeypatch.setattr(experiment_queries, "_totals", lambda *_: spark.createDataFrame(totals, "case_id bigint, pair_id bigint, condition string, total double"))
    row = experiment_queries.bootstrap_interval(spark, "").first()
    assert row.low < 1.8 and row.high > 2.2  # both cases have the mean 2
