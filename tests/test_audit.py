import datetime as dt
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ledgerloom.functions import checks as C
from ledgerloom.functions import text as T
from ledgerloom.functions import urls as U
from ledgerloom.operators import contracts, experiments, exposure, issues, links, records, references, summaries
from ledgerloom.operators.scratch import Scratch
from ledgerloom.sources import reports, strict_json


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://a.example/?jwt=1", (None, "credential")), ("https://a.example/?credentials=1", (None, "credential")), ("https://a.example/?%2574oken=1", (None, "credential")), ("https://a.example/?t%6Fken=1", (None, "credential")),
        ("https://a.example/?auth[user]=1", (None, "credential")), ("https://a.example/?X-Amz-Date=1", (None, "credential")), ("https://a.example/?monkey=1", ("https://a.example/?monkey=1", None)),
        ("https://a.example/#access_token=1", (None, "credential")), ("https://a.example/x;token=1", (None, "credential")), ("https://a.example/?q=joe@x.com", (None, "personal")), ("https://a.example/?tel=2025550123", (None, "personal")),
        ("https://a.example/?n=2025550123", ("https://a.example/?n=2025550123", None)), ("https://a.example/#+1 202 555 0123", (None, "personal")),
        ("https://a.example/%zz", (None, "escape")), ("https://a_b.example/", (None, "host")), ("https://é.example/", (None, "host")), ("https://[1.2.3.4]/", (None, "syntax")), ("https://a.example:000443/", (None, "port")),
        ("HTTPS://Old.Reddit.com//en/r/x/", ("https://www.reddit.com/r/x/", None)), ("http://reddit.com/de/r/Foo/Comments/00aBc/t/0D?utm_source=1#x", ("https://www.reddit.com/r/foo/comments/abc/t/d/", None)),
        ("https://reddit.com:8443/r/x/", (None, "port")), ("https://reddit.com/r/x/comments/0/", (None, "native_id")),
        ("https://github.com/A/b/issues/007/?notification_referrer_id=3&utm_term=z#issuecomment-5", ("https://github.com/A/b/issues/7#issuecomment-5", None)), ("https://github.com/A/b/?x=1#L3", ("https://github.com/A/b?x=1", None)),
        ("http://www.news.ycombinator.com/item?id=0042&utm_medium=m", ("https://news.ycombinator.com/item?id=42", None)), ("https://news.ycombinator.com/item?id=1&id=2", (None, "native_id")), ("https://news.ycombinator.com/item?id=0", (None, "native_id")),
        ("", (None, "host")), ("https://a.example/a b/./c/../?x=é#é", ("https://a.example/a%20b/?x=%C3%A9#%C3%A9", None)),
    ],
)
def test_addresses(url, expected):
    assert U.canonical_url(url) == expected


HN, GH, RD = "https://news.ycombinator.com/item?id=", "https://github.com/o/R/", "https://www.reddit.com/r/A/comments/"


@pytest.mark.parametrize(
    "row, expected",
    [
        (("HN", HN + "5", HN + "4", "comment"), ("hackernews:item:5", "hackernews:item:4", None, None)), (("hackernews", HN + "4", HN + "4", "comment"), (None, None, "comment_is_thread", "url")), (("hn", HN + "5", HN + "4", "story"), (None, None, "thread_mismatch", "thread_url")),
        (("hn", "https://news.ycombinator.com/", HN + "4", "story"), (None, None, "thread_permalink", "url")), (("hn", HN + "4", HN + "4", "post"), (None, None, "source_type", "source_type")),
        (("GitHub", GH + "issues/07#issuecomment-9", GH + "Issues/7", "comment"), ("github:o/r:issue:7#issuecomment-9", "github:o/r:issue:7", None, None)), (("github", GH + "discussions/7", GH + "discussions/7", "discussion"), ("github:o/r:discussion:7", "github:o/r:discussion:7", None, None)),
        (("github", GH + "issues/7", GH + "issues/8", "issue"), (None, None, "thread_mismatch", "thread_url")), (("github", GH + "issues/7", GH + "issues/7", "comment"), (None, None, "comment_permalink", "url")), (("github", GH + "issues/7", GH, "issue"), (None, None, "thread_permalink", "thread_url")),
        (("reddit", RD + "1a/t/2b/", RD + "1a/t/", "comment"), ("reddit:t1_2b", "reddit:t3_1a", None, None)), (("reddit", RD + "1a/t/", RD + "1A/", "post"), ("reddit:t3_1a", "reddit:t3_1a", None, None)), (("reddit", RD + "1a/t/", RD + "1a/", "comment"), (None, None, "comment_permalink", "url")),
        (("reddit", RD + "1a/t/2b/", RD + "1a/t/2b/", "comment"), (None, None, "thread_permalink", "thread_url")), (("reddit", RD + "1a/t/2b/", RD + "1a/", "post"), (None, None, "source_type", "source_type")),
        (("web", "https://a.example/x", "https://a.example/t", "other"), ("https://a.example/x", "https://a.example/t", None, None)), (("web", "https://a.example/x", "https://b.example/t", "other"), (None, None, "thread_host", "thread_url")),
        (("web", None, "https://b.example/t", "other"), (None, None, "host", "url")), ((None, "https://a.example/", "https://a.example/", None), ("https://a.example/", "https://a.example/", None, None)),
    ],
)
def test_identity(row, expected):
    unit, thread, key, fault, field = U.public_identity(*row)
    assert (unit, thread, fault, field) == expected and (key is None) == (thread is None)


def test_hosts_and_families():
    private = ("localhost", "10.0.0.1", "192.168.3.4", "0x7f.1", "2130706433", "a.lan", "printer", "x.home.arpa", "::1", "fe80::1%eth0", "2001:db8::1")
    assert all(map(U.private_host, private)) and not any(map(U.private_host, ("8.8.8.8", "a.example", "2606:4700::1", "planet.org")))
    assert U.platform_family("public", "http://reddit.com/r/x") == "reddit" and U.platform_family("public", "https://b.example/") == "web:b.example"
    assert U.platform_family("supplied_private", None) == "export" and U.platform_family("public", "x") == "invalid-public-platform"
    assert U.derived_community("reddit", RD + "1a/") == "r/a" and U.derived_community("github", GH) == "o/R" and U.derived_community("hn", HN + "1") == "news.ycombinator.com" and U.derived_community("web", GH) is None
    assert U.thread_key("public", "hn", HN + "5", HN + "4", "comment", "t") == "hackernews:item:4" and U.thread_key("public", "hn", "x", HN + "4", "comment", "t") == "url:" + HN + "4"
    assert U.thread_key("public", "web", None, None, None, None) == "invalid-public-thread" and U.thread_key("supplied_private", " Export", None, None, None, "A  b") == "private:export:a b"
    assert U.reserved_example("https://x.Example./") and not U.reserved_example("https://example.org/")


def test_times(spark):
    cases = {
        "2026-02-03T04:05:06Z": dt.datetime(2026, 2, 3, 4, 5, 6), "2026-02-03T04:05:06.25+05:30": dt.datetime(2026, 2, 2, 22, 35, 6, 250000), "2026-02-03T04:05:06-23:59": dt.datetime(2026, 2, 4, 4, 4, 6), "2026-02-30T00:00:00Z": None, "2026-02-03T24:00:00Z": None,
        "2026-02-03T04:05:06": None, "2026-02-03T04:05:06+24:00": None, "2026-02-03 04:05:06Z": None, "0000-01-01T00:00:00Z": None, "0001-01-01T00:00:00+01:00": None, "2026-02-03T04:05:06.1234567Z": None, "": None,
    }
    rows = spark.createDataFrame([(x,) for x in [*cases, None]], "t string")
    got = {r.t: r.x for r in rows.select("t", C.parsed_time(F.col("t")).alias("x")).collect()}
    assert got == {**cases, None: None}
    days = {"2026-02-28": dt.date(2026, 2, 28), "2026-02-30": None, "2026-2-3": None, "0000-01-01": None, "x": None}
    assert {r.t: r.x for r in spark.createDataFrame([(x,) for x in days], "t string").select("t", C.parsed_date(F.col("t")).alias("x")).collect()} == days


def test_value_faults(spark):
    one = lambda c, kind, v: spark.createDataFrame([(v,)], f"x {kind}").select(c(F.col("x")).alias("y")).first()["y"]
    text = lambda v, **k: one(lambda c: C.string_faults(c, **k), "string", v)
    assert text(None) == ["type"] and text(" 　") == ["empty"] and text("", empty_ok=True) == [] and text("a\x07") == ["control"] and text("a‮") == ["direction"] and text("x" * 11, most=10) == ["too_long"] and text("a\tb") == []
    items = lambda v, **k: one(lambda c: C.list_faults(c, **k), "array<string>", v)
    assert items(None) == ["type"] and items([]) == [] and items([], empty_ok=False) == ["empty_list"] and items(["a", "a", None, " "]) == ["item_type", "repeated"] and items(["a"] * 3, most=2) == ["too_many", "repeated"]
    assert one(lambda c: C.enum_faults(c, ("a",)), "string", "b") == ["enum"] and one(lambda c: C.enum_faults(c, ("a",)), "string", "a") == []
    assert one(C.count_faults, "int", -1) == ["type"] and one(C.count_faults, "int", 0) == []
    assert one(lambda c: C.version_faults(c, "1.0"), "string", "1") == ["version"]
    assert str(one(lambda c: C.rounded(c, 2), "double", 2.675)).rstrip("0") == "2.68"
    assert one(lambda c: issues.shape_faults(c, ("a", "b"), ("c",)), "array<string>", ["a", "c", "z"]) == ["missing:b", "unknown:z"]


def test_a_report_says_what_it_leaves_out(spark):
    rows = spark.createDataFrame([("t", f"r{k}", "f", "x") for k in range(7)], "table_name string, id string, field string, fault string")
    got = issues.report(rows, 3).orderBy("rank").collect()
    assert [r.id for r in got] == ["r0", "r1", "r2", ""] and got[-1].fault == "issue_limit" and issues.report(rows, 7).count() == 7


KIND = StructType([StructField("a", StringType()), StructField("n", LongType()), StructField("f", DoubleType()), StructField("b", BooleanType()), StructField("l", ArrayType(StringType())), StructField("o", StructType([StructField("k", LongType())]))])


def test_types_are_not_converted(spark, tmp_path):
    good = {"a": "x", "n": 1, "f": 2, "b": True, "l": ["y"], "o": {"k": 1}}
    bad = [{"a": 5}, {"n": "1"}, {"n": 3.7}, {"n": True}, {"f": "2"}, {"b": 1}, {"l": "y"}, {"l": [1]}, {"o": {"k": "1"}}, {"o": 3}, {"n": 10**30}]
    nulls = dict.fromkeys(good)
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(x) for x in [good, nulls, *({**good, **b} for b in bad)]))
    rows, faults = strict_json.read_jsonl(spark, str(tmp_path), KIND)
    assert {r.line for r in rows.collect()} == {1, 2} and {(r.line, r.fault) for r in faults.collect()} == {(k + 3, "wrong_type") for k in range(len(bad))}
    _, faults = strict_json.read_jsonl(spark, str(tmp_path), KIND, most_lines=4)
    assert {r.line for r in faults.where("fault = 'too_many_lines'").collect()} == set(range(5, 3 + len(bad)))


def test_objects_and_score_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"k": 1}))
    (tmp_path / "b.json").write_text(json.dumps({"k": "1"}))
    (tmp_path / "c.json").write_bytes(b'{"k": "\xff"}')
    (tmp_path / "d.json").write_text(" " * 200)
    rows, faults = strict_json.read_object(spark, str(tmp_path), StructType([StructField("k", LongType())]), most_bytes=100)
    assert [r.k for r in rows.collect()] == [1] and {(os.path.basename(r.path), r.fault) for r in faults.collect()} == {("b.json", "wrong_type"), ("c.json", "encoding"), ("d.json", "too_large")}
    one, two = tmp_path / "one.jsonl", tmp_path / "two.jsonl"
    one.write_text('{"a":1}\n\n{"a":1,"a":2}\n')
    two.write_text("")
    groups, found = strict_json.score_file_groups(spark, {"initial": [str(one), str(two)]})
    assert {(r.role, r.file_index, r.sha256, r.bytes, r.records) for r in groups.collect()} == {("initial", k, hashlib.sha256(p.read_bytes()).hexdigest(), len(p.read_bytes()), n) for k, (p, n) in enumerate([(one, 2), (two, 0)])}
    assert {(r.line, r.fault) for r in found.collect()} == {(1, None), (3, "repeated_key")}
    assert strict_json.score_file_groups(spark, {})[0].count() == 0


def test_verified_objects_and_answers(spark, tmp_path):
    for name, data in (("a.json", b'{"x":1}'), ("b.json", b'{"x":2}'), ("c.json", b"[1]"), ("e.json", b"```{}```")):
        (tmp_path / name).write_bytes(data)
    manifest = spark.createDataFrame([("a.json", hashlib.sha256(b'{"x":1}').hexdigest()), ("b.json", "0"), ("c.json", hashlib.sha256(b"[1]").hexdigest()), ("d.json", "0")], "path string, sha256 string")
    got = {r.path: (r.text, r.fault) for r in strict_json.verified_objects(spark, str(tmp_path), manifest).collect()}
    assert got == {"a.json": ('{"x":1}', None), "b.json": (None, "modified"), "c.json": (None, "no_object"), "d.json": (None, "missing"), "e.json": (None, "extra")}
    assert {os.path.basename(r.path): r.fault for r in strict_json.model_outputs(spark, str(tmp_path)).collect()}["e.json"] == "syntax"


def test_reports(tmp_path):
    private = {"id": "p", "visibility": "supplied_private", "record_ref": "r`1", "source_file_sha256": "sha256:0", "captured_text": "secret", "published_at": "2026-01-01"}
    public = {"id": "a_b", "visibility": "public", "url": "https://x.example/a(b)", "excerpt": "<b>", "published_at": "2026-01-02T00:00:00Z", "evidence_types": ["problem"], "promotional": "yes", "author_key": "unknown"}
    assert "secret" not in reports.cited_record(private) and "2026" not in reports.cited_record(private) and "r&#96;1" in reports.cited_record(private)
    assert reports.cited_record(public) == '> "&lt;b&gt;" - [a\\_b](https://x.example/a%28b%29), 2026\\-01\\-02; `problem`; promotion: yes, author: unknown'
    text = reports.findings("T", [("S", ["x"], [("a|b",)]), ("E", ["x"], [])], {"s2": [], "s1": [public, private]})
    assert text.index("s1") < text.index("s2") and "a\\|b" in text and "None." in text and text.index("a\\_b") < text.index("Content withheld")
    files = reports.audit_files({"status": "pass"}, ["x"], [("=1",)], text)
    assert json.loads(files["audit.json"])["artifact_hashes"]["findings.md"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest() and reports.audit_files({"status": "fail"}, ["x"], [(1,)], "")["signals.csv"] == "x\n"
    assert reports.terminal_safe("a\x1b‮é🎉", "latin-1") == "a\\u001b\\u202eé\\U0001f389"
    assert reports.report_lines("fail", "f", [("warning", "W", "p")]) == (["status: fail", "inputs: f", "errors: 0, warnings: 1", "WARNING W p"], 0) and reports.report_lines("x", "f", [("warning", "W", "p")], strict=True)[1] == 1
    bundle = reports.blind_packets(["b", "a"], {"a": {"x": 1, "condition": "skill"}, "b": {"x": 2}}, ["condition"])
    assert json.loads(bundle["bundle.json"])["blind_order"] == ["b", "a"] and json.loads(bundle["packets/a.json"]) == {"x": 1}
    with pytest.raises(ValueError):
        reports.blind_packets(["a", "a"], {"a": {}}, [])


def test_files_are_read_and_written_safely(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"abc")
    (tmp_path / "link").symlink_to(path)
    assert reports.read_stable(str(path), 3) == b"abc"
    for name, most, fault in (("x", 2, "too_large"), ("link", 9, "link"), ("none", 9, "missing")):
        with pytest.raises(reports.UnsafeFile, match=fault):
            reports.read_stable(str(tmp_path / name), most)
    reports.new_file(str(tmp_path / "out" / "y"), "1", [str(tmp_path / "in")])
    for name, apart, fault in (("out/y", [], "exists"), ("in/z", ["in"], "overlap"), ("in", ["in/deep"], "overlap")):
        with pytest.raises(reports.UnsafeFile, match=fault):
            reports.new_file(str(tmp_path / name), "1", [str(tmp_path / a) for a in apart])


def test_a_hub_spreads_its_label(spark):
    pairs = [("hub", f"s{k:05d}") for k in range(3000)] + [(f"s{k:05d}", f"t{k:05d}") for k in range(0, 3000, 7)] + [("zz", "zz"), (None, "q")]
    got = records.spread_labels(spark.createDataFrame(pairs, "a string, b string"), Scratch(spark)).collect()
    assert {r.root for r in got} == {"hub"} and len({r.id for r in got}) == len(got) == 1 + 3000 + 429
    assert records.spread_labels(spark.createDataFrame([], "a string, b string"), Scratch(spark)).count() == 0


def test_text_keys_decode_entities_and_forms(spark):
    rows = spark.createDataFrame([("Ａ &lt; b c",), ("a < B c",)], "t string")
    assert rows.select(T.duplicate_text_key(F.col("t")).alias("k")).distinct().collect()[0].k == "a < b c"


def test_months_are_those_of_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.sql("SELECT timestamp_micros(1767225600000000) AS t UNION ALL SELECT timestamp_micros(1767225599999999)")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert {r.m for r in rows.select(references._month(F.col("t")).alias("m")).collect()} == {"2026-01", "2025-12"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_link_faults(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    pairs = "signal_id string, source_id string"
    people = df([("A", True, "x"), ("b", False, "y"), ("c", None, None)], "id string, ok boolean, excerpt string")
    got = links.citation_faults(df([("s", "a"), ("s", "b"), ("s", "zz"), ("s", "c")], pairs), df([("s", "a"), ("s", "b")], pairs), people, F.col("ok"))
    assert {tuple(r) for r in got.collect()} == {("s", "b", "not_eligible"), ("s", "zz", "unknown"), ("s", "c", "not_support"), ("s", "c", "not_eligible")}
    quotes = links.quote_faults(df([("q1", "a", "x"), ("q2", "b", "x"), ("q3", "zz", "x"), ("q4", "c", None)], "id string, source_id string, excerpt string"), people)
    assert {tuple(r) for r in quotes.collect()} == {("q2", "b", "other_excerpt"), ("q3", "zz", "unknown")}
    roots = df([("a", "a"), ("b", "a")], "id string, root string")
    assert {tuple(r) for r in links.root_clashes(df([("s", "a"), ("t", "a")], pairs), df([("s", "b"), ("t", "c")], pairs), roots).collect()} == {("s", "a")}
    heads = df([("a", "a", True)], "root string, representative string, private boolean")
    assert {tuple(r) for r in links.non_representative(df([("s", "a"), ("s", "b")], pairs), roots, heads).collect()} == {("s", "b", "a", True)}
    totals = df([("a", 1, 1), ("b", 5, 6), ("c", 5, 11)], "id string, n int, total int")
    assert links.first_crossing(totals, "id", 5).first().id == "b" and links.first_crossing(totals, "id", 50).count() == 0


def test_experiment_records(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = experiments.score_coverage(df([("p",), ("q",)], "blind_id string"), df([("p", "a"), ("p", "a"), ("z", "a")], "blind_id string, scorer string"), 2)
    assert {tuple(r) for r in got.collect()} == {("p", "repeated"), ("p", "missing"), ("q", "missing"), ("z", "unknown")}
    scores = df([("p", "a", "d", 5), ("p", "a", "e", 1), ("p", "b", "d", 0)], "blind_id string, scorer string, dimension string, rating int")
    assert {tuple(r) for r in experiments.score_faults(scores, df([("p", "d"), ("p", "f")], "blind_id string, dimension string")).collect()} == {("p", "a", "d", "rating"), ("p", "a", "e", "not_applicable"), ("p", "a", "f", "missing"), ("p", "b", "f", "missing")}
    votes = df([("p", "a", ["X"]), ("p", "b", []), ("q", "a", ["Y"]), ("q", "b", ["X"])], "blind_id string, scorer string, codes array<string>")
    assert {tuple(r) for r in experiments.critical_codes(votes).collect()} == {("p", 2, 1, False, True, ""), ("q", 2, 2, True, False, "X;Y")}
    ratings = df([("p", s, "d", r) for s, r in (("a", 0), ("b", 2))] + [("q", s, "d", 1) for s in "ab"], "blind_id string, scorer string, dimension string, rating int")
    assert {tuple(r) for r in experiments.disputes(ratings, votes).collect()} == {("p", "d", True)}
    facts = df([(1, None)], "a int, b int")
    got = {(r.stage, r.gate): r.passed for r in experiments.gates(facts, {"x": ("one", F.col("a") == 1), "y": ("two", F.col("b") == 1), "z": ("three", F.col("a") == 1)}).collect()}
    assert got == {("one", "x"): True, ("one", "all"): True, ("two", "y"): False, ("two", "all"): False, ("three", "z"): True, ("three", "all"): False}
    plan = experiments.allocation(df([("c1",), ("c2",), ("c1",)], "case_id string"), 3, ("x", "y"), 5).collect()
    assert len(plan) == len({r.trial_id for r in plan}) == 12 and len({r.pair_id for r in plan}) == 6 and plan == experiments.allocation(df([("c1",), ("c2",)], "case_id string"), 3, ("x", "y"), 5).collect()


def test_bootstrap_pools_the_drawn_pairs(spark):
    lifts = {"a": [10.0], "b": [0.0] * 99}
    rng = random.Random(3)
    means = []
    for _ in range(4000):
        drawn = [x for c in (rng.choice("ab") for _ in lifts) for x in (rng.choice(lifts[c]) for _ in lifts[c])]
        means.append(sum(drawn) / len(drawn))
    means.sort()
    effects = spark.createDataFrame([(c, x) for c, own in lifts.items() for x in own], "case_id string, lift double")
    row = experiments.bootstrap_interval_of_effects(effects, draws=4000).first()
    assert abs(row.low - means[100]) < 1e-9 and abs(row.high - means[3900]) < 1e-9
    row = experiments.bootstrap_interval(spark, lifts, draws=4000).first()
    assert abs(row.low - means[100]) < 1e-9 and abs(row.high - means[3900]) < 1e-9


def test_what_may_be_published(spark):
    kind = "id string, visibility string, record_ref string, source_file_sha256 string, title string"
    rows = [("src-a", "public", "r", "x", "t"), ("src-b", "supplied_private", "form:1", "sha256:" + "0" * 64, "secret"), ("B", "supplied_private", "joe@x.org", "sha256:zz", "secret"), ("src-c", None, "+1 202 555 0123", None, "secret")]
    got = {tuple(r) for r in exposure.publishable(spark.createDataFrame(rows, kind), ("title",)).collect()}
    assert got == {("src-a", "r", "x", "t"), ("src-b", "form:1", "sha256:" + "0" * 64, None), (None, None, None, None), ("src-c", None, None, None)}
    terms = spark.createDataFrame([("c", "Top Secret"), ("c", " "), ("d", "x")], "case_id string, term string")
    texts = spark.createDataFrame([("1", "c", "a TOP SECRET b"), ("2", "c", "x"), ("3", "d", None)], "id string, case_id string, text string")
    assert {tuple(r) for r in exposure.protected_terms(texts, terms).collect()} == {("1", "top secret")}


def test_fingerprint_of_confusable_rows(spark):
    one = summaries.fingerprint(spark.createDataFrame([("a", "bc")], "x string, y string"), ["x", "y"]).first()
    two = summaries.fingerprint(spark.createDataFrame([("ab", "c")], "x string, y string"), ["x", "y"]).first()
    none = summaries.fingerprint(spark.createDataFrame([], "x string, y string"), ["x", "y"]).first()
    assert len({one.fingerprint, two.fingerprint, none.fingerprint}) == 3 and none.n == 0


def test_documents_against_a_contract(spark):
    good = {"a": "x", "n": None, "f": 1, "b": True, "l": ["y"], "o": {"k": 1}}
    cases = {"ok": good, "int": {**good, "n": 1.5}, "keys": {k: v for k, v in good.items() if k != "a"} | {"z": 1}, "deep": {**good, "o": {"k": "1", "m": 2}}, "list": {**good, "l": ["y", 1, 2, None]}, "flat": {**good, "o": 3}}
    rows = [(k, json.dumps(v)) for k, v in cases.items()] + [("bad", "{"), ("none", None), ("array", "[]")]
    contract = StructType([StructField("a", StringType(), False), *KIND.fields[1:4], StructField("l", ArrayType(StringType(), False)), KIND["o"]])
    got = {tuple(r) for r in contracts.document_faults(spark.createDataFrame([(*r, "x") for r in rows], "id string, text string, path string"), "id", "text", contract).collect()}
    assert got == {
        ("int", "$.n", "wrong_type"), ("keys", "$", "missing:a"), ("keys", "$", "unknown:z"), ("deep", "$.o", "unknown:m"), ("deep", "$.o.k", "wrong_type"), ("list", "$.l[]", "wrong_type"), ("list", "$.l[]", "null"), ("flat", "$.o", "wrong_type"),
        ("bad", "$", "json:syntax"), ("none", "$", "null"), ("array", "$", "json:no_object"),
    }
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id string")
    assert {tuple(r) for r in contracts.set_faults({"a": ids("1", "2", None), "b": ids("2", "3", "3")}).collect()} == {("1", "b"), ("3", "a")}


def test_scratch_releases_what_is_no_longer_needed(spark):
    scratch = Scratch(spark)
    before = scratch.save(spark.range(1))
    mark = scratch.mark()
    one, two = scratch.save(spark.range(2)), scratch.save(spark.range(3))
    scratch.release(mark, two)
    there = lambda df: os.path.isdir(df.scratch_path.removeprefix("file://"))
    assert there(before) and there(two) and not there(one) and two.count() == 3
    scratch.close()
    assert not there(before)
