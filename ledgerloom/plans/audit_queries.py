"""Registered queries that audit the tables field by field, and the addresses and output of the ledger, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ledgerloom.functions import checks as C
from ledgerloom.functions import text as T
from ledgerloom.functions import urls as U
from ledgerloom.operators import contracts, exposure, issues, links, records, similar, summaries
from ledgerloom.operators.references import match_key
from ledgerloom.operators.scratch import Scratch
from ledgerloom.plans import sql_text as X
from ledgerloom.plans.ledger_queries import _KEY, _L, _LINKS, _Q, _groups
from ledgerloom.sources.tables import read_table

# What the fields of the contracts allow.
INTENTS = ("counter", "neutral", "support")
SOURCE_TYPES = ("comment", "discussion", "export_record", "issue", "other", "post", "review", "story")
STANCES = ("counter", "neutral", "support")
PROMOTIONAL = ("no", "unclear", "yes")
VISIBILITY = ("public", "supplied_private")
METHODS = ("api", "browser", "connector", "export", "manual", "web_search")
STATUSES = ("available", "deleted", "edited", "unavailable", "unknown")
LEVELS = ("anecdotal", "recurring", "unsupported", "well-corroborated")
VERSION = "1.0"

#: Field -> (kind of check, what it takes).
RULES = {
    "source_ledger": {
        "schema_version": ("version", VERSION), "id": ("string", False), "platform": ("string", False), "community": ("string", False), "source_type": ("enum", SOURCE_TYPES), "visibility": ("enum", VISIBILITY),
        "capture_method": ("enum", METHODS), "author_key": ("string", False), "source_status": ("enum", STATUSES), "title": ("string", True), "captured_text": ("string", False), "excerpt": ("string", True), "language": ("string", False),
        "stance": ("enum", STANCES), "promotional": ("enum", PROMOTIONAL), "evidence_types": ("list", True), "query_ids": ("list", False), "signal_ids": ("list", True),
    },
    "query_log": {
        "schema_version": ("version", VERSION), "id": ("string", False), "platform": ("string", False), "query": ("string", False), "sort": ("string", False), "notes": ("string", True), "intent": ("enum", INTENTS),
        "results_seen": ("count", None), "results_screened": ("count", None), "pages_seen": ("count", None), "included_source_ids": ("list", True), "signal_ids": ("list", True),
    },
    "signal_catalog": {
        "id": ("string", False), "name": ("string", False), "hypothesis": ("string", False), "decision_relevance": ("string", False), "claimed_level": ("enum", LEVELS), "support_citations": ("list", True),
        "counter_citations": ("list", True), "wtp_citations": ("list", True), "alternative_explanations": ("list", False), "disconfirming_evidence_needed": ("string", False),
    },
}
_CHECKS = {"version": C.version_faults, "string": C.string_faults, "enum": C.enum_faults, "count": lambda c, _: C.count_faults(c), "list": C.list_faults}


def _first(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    return records.first_deliveries(read_table(spark, folder, table), *columns)


def _issues(spark: SparkSession, folder: str) -> DataFrame:
    parts = {}
    for table, rules in RULES.items():
        own = _first(spark, folder, table, *(f for f in rules if f != "id"))
        parts[table] = issues.field_issues(own, "id", {f: _CHECKS[kind](F.col(f), arg) for f, (kind, arg) in rules.items()})
    times = _first(spark, folder, "source_ledger", "published_at", "collected_at", "engagement").withColumn("snapshot_at", F.col("engagement.snapshot_at"))
    late = issues.order_faults(times, "id", {"published_at": ("published_at", "collected_at"), "engagement.snapshot_at": ("published_at", "snapshot_at")})
    parts["source_ledger"] = parts["source_ledger"].unionByName(late)
    return issues.union_issues(parts)


def field_issues(spark, folder):
    return _issues(spark, folder)


def issue_summary(spark, folder):
    return issues.summary(_issues(spark, folder))


def issue_report(spark, folder):
    """A report of the first hundred issues in order, and the row that says that there are more."""
    return issues.report(_issues(spark, folder), 100)


def parsed_times(spark, folder):
    """Days and instants of the documents' times as texts, some in the local time of an offset, some spoiled."""
    at = F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("doc_id") % 6
    text = F.when(k == 0, F.concat(at, F.lit("Z"))).when(k == 1, F.concat(at, F.lit("+05:30"))).when(k == 2, F.concat(at, F.lit("-23:59"))).when(k == 3, at).when(k == 4, F.concat(F.substring(at, 1, 8), F.lit("31"), F.substring(at, 11, 9), F.lit(".25Z"))).otherwise(F.concat(at, F.lit("+24:00")))
    own = read_table(spark, folder, "documents").where("collected_at is not null").select("doc_id", text.alias("t"))
    return own.select("doc_id", F.date_format(C.parsed_time(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSS").alias("instant"), C.parsed_date(F.substring("t", 1, 10)).cast("string").alias("day"))


_ADDRESS = ("url", "thread_url", "platform", "source_type", "visibility", "thread_id", "community")


# The invented sites of the test tables, and the sites whose addresses they imitate.
_STAND_INS = {"www.threadit.example": "www.reddit.com", "codeforge.example": "github.com", "newswell.example": "news.ycombinator.com"}
_PLATFORMS = {"threadit": "reddit", "codeforge": "github", "newswell": "hn"}


def _addressed(spark, folder):
    """The ledger's addresses with the invented sites replaced by those that they imitate, so that the rules of known sites have cases."""
    own = _first(spark, folder, "source_ledger", *_ADDRESS)
    for column in ("url", "thread_url"):
        value = F.regexp_replace(column, "(/issues/|[?&]id=)0*([0-9]+)[a-z0-9]*", "$1$2")
        for host, real in _STAND_INS.items():
            value = F.regexp_replace(value, f"(?i)^(https?://){host}", f"$1{real}")
        own = own.withColumn(column, value)
    name = T.platform(F.col("platform"))
    for invented, real in _PLATFORMS.items():
        name = F.when(T.platform(F.col("platform")) == invented, real).otherwise(name)
    return own.withColumn("platform", name)


def url_identity(spark, folder):
    own = _addressed(spark, folder).where("visibility = 'public'")
    return own.select("id", U.identity(F.col("platform"), F.col("url"), F.col("thread_url"), F.col("source_type")).alias("x")).select("id", "x.*")


def url_faults(spark, folder):
    own = _addressed(spark, folder).where("url is not null").select(U.canonical(F.col("url")).alias("u"), U.host(F.col("url")).alias("host"))
    return own.select(F.coalesce("u.error", F.when(U.reach(F.col("host")) == "private", "private_host"), F.lit("")).alias("fault")).groupBy("fault").agg(F.count("*").alias("records"))


def url_reach(spark, folder):
    hosts = _first(spark, folder, "source_ledger", "url").select(U.host(F.col("url")).alias("host")).where("host is not null").distinct()
    return hosts.select("host", U.reach(F.col("host")).alias("reach"))


def platform_families(spark, folder):
    return _addressed(spark, folder).select(U.families(F.col("visibility"), F.col("url")).alias("family")).groupBy("family").agg(F.count("*").alias("records"))


def thread_identities(spark, folder):
    """Records of each thread by what the thread's address identifies, not by the declared id."""
    key = U.thread_keys(*(F.col(c) for c in ("visibility", "platform", "url", "thread_url", "source_type", "thread_id")))
    return _addressed(spark, folder).select(key.alias("thread_key")).groupBy("thread_key").agg(F.count("*").alias("records"))


def community_mismatches(spark, folder):
    own = _addressed(spark, folder).where("visibility = 'public'").select("id", T.label(F.col("community")).alias("declared"), T.label(U.communities(F.col("platform"), F.col("url"))).alias("implied"))
    return own.where("implied is not null and not declared <=> implied")


def _targets(spark, folder):
    col = F.col
    plan = read_table(spark, folder, "study_plan")
    scope = {f"scope.{n}": col(f"scope.{n}") for n in ("platforms", "communities", "languages")}
    parts = [
        exposure.unpivot(plan, "study_plan", "study_id", {n: col(n) for n in ("question", "decision", "population", "stop_condition", "inclusion_criteria", "exclusion_criteria", "limitations")} | scope),
        exposure.unpivot(_first(spark, folder, "query_log", "platform", "query", "sort", "notes"), "query_log", "id", {n: col(n) for n in ("id", "platform", "query", "sort", "notes")}),
    ]
    names = ("name", "hypothesis", "decision_relevance", "wtp_statement", "disconfirming_evidence_needed", "alternative_explanations")
    parts.append(exposure.unpivot(_first(spark, folder, "signal_catalog", *names), "signal_catalog", "id", {n: col(n) for n in ("id", *names)}))
    public, private = col("visibility") == "public", col("visibility") == "supplied_private"
    own = _first(spark, folder, "source_ledger", "visibility", "record_ref", "url", "thread_url", "title", "excerpt", "notes")
    parts.append(exposure.unpivot(own, "source_ledger", "id", {"id": col("id"), "record_ref": F.when(private, col("record_ref"))} | {n: F.when(public, col(n)) for n in ("url", "thread_url", "title", "excerpt", "notes")}))
    return records.union_all(parts)


def private_exposure(spark, folder):
    own = _first(spark, folder, "source_ledger", "visibility", "captured_text", "excerpt", "title", "notes").where("visibility = 'supplied_private'")
    private = exposure.unpivot(own, "source_ledger", "id", {n: F.col(n) for n in ("captured_text", "excerpt", "title", "notes")}).select("value")
    return exposure.output_exposure(_targets(spark, folder), private, ("id", "record_ref", "url", "thread_url"), ("url", "thread_url"))


_PUBLISHED = ("platform", "community", "url", "thread_url", "captured_text", "excerpt", "title", "language")


def publishable_records(spark, folder):
    own = _first(spark, folder, "source_ledger", "visibility", "record_ref", "source_file_sha256", *_PUBLISHED)
    return exposure.publishable(own, _PUBLISHED)


def ledger_fingerprint(spark, folder):
    return summaries.fingerprint(publishable_records(spark, folder), ["id", "record_ref", "source_file_sha256", *_PUBLISHED])


_MATERIAL = ("community", "unit_id", "thread_id", "published_at", "author_key", "language", "source_status", "title", "captured_text", "excerpt", "stance", "evidence_types", "promotional")


def private_conflicts(spark, folder):
    """Records of one file as if they were of one provenance: the test tables repeat no reference within a file."""
    own = _first(spark, folder, "source_ledger", "visibility", "source_file_sha256", "record_ref", *_MATERIAL)
    return records.private_conflicts(own, ("source_file_sha256",), _MATERIAL)


def _citations(spark, folder, *fields):
    table = read_table(spark, folder, "signal_catalog")
    return records.union_all([links.bridge(table, f, "signal_id", "source_id") for f in fields]).distinct()


def wtp_citations(spark, folder):
    own = _first(spark, folder, "source_ledger", "evidence_types")
    good = F.arrays_overlap("evidence_types", F.array(F.lit("purchase_intent"), F.lit("observed_payment")))
    return links.citation_faults(_citations(spark, folder, "wtp_citations"), _citations(spark, folder, "support_citations"), own, good)


def counter_queries(spark, folder):
    return links.linked_queries(_first(spark, folder, "query_log", "platform", "intent", "signal_ids"), read_table(spark, folder, "signal_catalog"), "counter")


def root_clashes(spark, folder):
    _, _, roots = _groups(spark, folder)
    return links.root_clashes(_citations(spark, folder, "support_citations"), _citations(spark, folder, "counter_citations"), roots)


def non_representative_citations(spark, folder):
    own, _, roots = _groups(spark, folder)
    roots = Scratch(spark).save(roots)
    return links.non_representative(_citations(spark, folder, "support_citations", "counter_citations"), roots, records.representatives(own, roots))


def stance_mismatches(spark, folder):
    """Links of signals and records on one side of the catalog whose record declares another stance, or that only one table has."""
    cited = records.union_all([links.bridge(read_table(spark, folder, "signal_catalog"), f"{side}_citations", "signal_id", "source_key").withColumn("stance", F.lit(side)) for side in ("support", "counter")])
    own = _first(spark, folder, "source_ledger", "stance", "signal_ids").select(match_key(F.col("id")).alias("source_key"), "stance", F.explode("signal_ids").alias("raw"))
    declared = own.select(match_key(F.col("raw")).alias("signal_key"), "source_key", "stance").where("signal_key is not null")
    return links.stance_faults(declared, cited.select(match_key(F.col("signal_id")).alias("signal_key"), "source_key", "stance"))


def quote_faults(spark, folder):
    """Excerpts of later deliveries, as quotes of the records' first ones."""
    quotes = read_table(spark, folder, "source_ledger").where("excerpt is not null").select("id", F.lower(F.trim(F.coalesce("repost_of", "id"))).alias("source_id"), "excerpt").distinct()
    return links.quote_faults(quotes, _first(spark, folder, "source_ledger", "excerpt")).distinct()


def citation_crossing(spark, folder):
    """The signal with which the catalog's citations first exceed a budget of a hundred."""
    own = _first(spark, folder, "signal_catalog", "support_citations", "counter_citations").select("id", (F.size("support_citations") + F.size("counter_citations")).cast("bigint").alias("citations"))
    return links.first_crossing(links.running_total(own, "id", "citations", Scratch(spark)), "id", 100)


def near_duplicate_records(spark, folder):
    """Pairs of texts of the ledger, nine tenths alike in length and in runs of five words, whose records no group links."""
    scratch = Scratch(spark)
    own, _, roots = _groups(spark, folder)
    keyed = own.select("id", T.duplicate_text_key(F.col("captured_text")).alias("text"))
    pairs, members = similar.similar_classes(keyed, scratch, "id", "text", least_words=12)
    return similar.between_groups(pairs, members, keyed.select("id", F.length("text").alias("length")), roots, 0.9)


_CONTRACT = StructType([
    StructField("id", StringType(), False), StructField("name", StringType(), False), StructField("level", StringType(), False), StructField("citations", ArrayType(StringType(), False), False),
    StructField("claim", StructType([StructField("statement", StringType(), True), StructField("count", LongType(), False)]), False),
])


def contract_faults(spark, folder):
    """The signals as JSON texts against a contract, spoiled by the length of their names: types, nulls, unknown and missing keys, repeated keys."""
    own = _first(spark, folder, "signal_catalog", "name", "claimed_level", "support_citations", "wtp_statement")
    k = F.length("name") % 7
    value = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    claim = F.concat(F.lit('{"statement":'), F.when(F.col("wtp_statement").isNull(), "null").otherwise(value(F.col("wtp_statement"))), F.when(k == 2, "").otherwise(F.concat(F.lit(',"count":'), F.when(k == 3, "1.5").otherwise("2"))), F.when(k == 4, ',"more":1').otherwise(""), F.lit("}"))
    text = F.concat(F.lit('{"id":'), value(F.col("id")), F.lit(',"name":'), F.when(k == 5, "null").otherwise(value(F.col("name"))), F.lit(',"level":'), F.when(k == 1, "7").otherwise(value(F.col("claimed_level"))), F.lit(',"citations":'), F.to_json("support_citations"), F.lit(',"claim":'), claim, F.when(k == 6, ',"id":1').otherwise(""), F.lit("}"))
    return contracts.document_faults(own.select("id", text.alias("text")), "id", "text", _CONTRACT)


def id_set_faults(spark, folder):
    """Ids of records that some of three places lack: the ledger, the query log's inclusions and the catalog's support."""
    key = lambda c: match_key(F.col(c)).alias("key")
    linked = lambda t, f: read_table(spark, folder, t).select(F.explode(f).alias("x")).select(key("x"))
    return contracts.set_faults({"catalog": linked("signal_catalog", "support_citations"), "ledger": read_table(spark, folder, "source_ledger").select(key("id")), "queries": linked("query_log", "included_source_ids")})


QUERIES = {
    f.__name__: f
    for f in (field_issues, issue_summary, issue_report, parsed_times, url_identity, url_faults, url_reach, platform_families, thread_identities, community_mismatches, private_exposure, publishable_records, ledger_fingerprint, private_conflicts, wtp_citations, counter_queries, root_clashes, non_representative_citations, stance_mismatches, quote_faults, citation_crossing, near_duplicate_records, contract_faults, id_set_faults)
}


_S = "s AS (SELECT * FROM signal_catalog WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
_CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]"
_BIDI = "[\\x{061c}\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}]"


def _string_sql(x: str, empty_ok: bool) -> str:
    empty = "" if empty_ok else f"CASE WHEN {X.flat(x)} = '' THEN 'empty' END, "
    return f"CASE WHEN {x} IS NULL THEN ['type'] WHEN length({x}) > 20000 THEN ['too_long'] ELSE [{empty}CASE WHEN regexp_matches({x}, '{_CONTROL}') THEN 'control' WHEN regexp_matches({x}, '{_BIDI}') THEN 'direction' END] END"


def _then(x: str, bad: str, fault: str) -> str:
    own = f"list_filter({_string_sql(x, False)}, lambda y: y IS NOT NULL)"
    return f"CASE WHEN len({own}) > 0 THEN {own} WHEN {bad} THEN ['{fault}'] ELSE [] END"


def _rule_sql(x: str, kind: str, arg: object) -> str:
    if kind == "string":
        return _string_sql(x, bool(arg))
    if kind == "enum":
        return _then(x, f"{x} NOT IN ({', '.join(map(X.literal, arg))})", "enum")
    if kind == "version":
        return _then(x, f"{x} <> {X.literal(arg)}", "version")
    if kind == "count":
        return f"[CASE WHEN {x} IS NULL OR {x} < 0 THEN 'type' END]"
    kept = f"list_filter({x}, lambda y: y IS NOT NULL AND {X.flat('y')} <> '')"
    empty = "" if arg else f", CASE WHEN len({kept}) = 0 THEN 'empty_list' END"
    return f"CASE WHEN {x} IS NULL THEN ['type'] ELSE [CASE WHEN len({x}) > 10000 THEN 'too_many' END, CASE WHEN len({kept}) < len({x}) THEN 'item_type' END, CASE WHEN len(list_distinct({kept})) < len({kept}) THEN 'repeated' END{empty}] END"


def _issues_sql() -> str:
    alias = {"source_ledger": "l", "query_log": "q", "signal_catalog": "s"}
    parts = [f"SELECT '{t}' AS table_name, id, '{f}' AS field, unnest({_rule_sql(f, *rule)}) AS fault FROM {alias[t]}" for t, rules in RULES.items() for f, rule in rules.items()]
    parts.append("SELECT 'source_ledger', id, 'published_at', 'time_order' FROM l WHERE published_at > collected_at")
    parts.append("SELECT 'source_ledger', id, 'engagement.snapshot_at', 'time_order' FROM l WHERE published_at > engagement.snapshot_at")
    return f"WITH {_L}, {_Q}, {_S}, i AS ({' UNION ALL '.join(parts)}), issues AS (SELECT * FROM i WHERE fault IS NOT NULL)"


def _cited_sql(*fields: str) -> str:
    return " UNION ".join(f"SELECT id AS signal_id, {_KEY.format('x')} AS source_id FROM (SELECT id, unnest({f}) AS x FROM signal_catalog) WHERE {_KEY.format('x')} <> ''" for f in fields)


def _netstring(x: str) -> str:
    return f"coalesce(CAST(length({x}) AS VARCHAR) || ':' || {x}, 'n')"


_PII = "'(^|[^A-Za-z0-9_])[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}([^A-Za-z0-9_]|$)'"
_TEL = "'(^|[^A-Za-z0-9_])\\+?[0-9][0-9 .()\\-]{7,}[0-9]([^A-Za-z0-9_]|$)'"
def _label(x: str) -> str:
    return X.ascii_lower(X.flat(X.nfkc(x)))


_PUBLIC = "CASE WHEN visibility = 'public' THEN {0} END AS {0}"
_PUBLISHABLE = (
    "CASE WHEN visibility = 'public' OR regexp_matches(id, '^src[-_][a-z0-9][a-z0-9_-]*$') THEN id END AS id, "
    f"CASE WHEN visibility = 'public' OR (regexp_matches(record_ref, '^[A-Za-z0-9][A-Za-z0-9._:/#-]{{0,255}}$') AND NOT regexp_matches(record_ref, {_PII}) AND NOT regexp_matches(record_ref, {_TEL})) THEN record_ref END AS record_ref, "
    "CASE WHEN visibility = 'public' OR regexp_matches(source_file_sha256, '^sha256:[0-9a-f]{64}$') THEN source_file_sha256 END AS source_file_sha256, " + ", ".join(_PUBLIC.format(c) for c in _PUBLISHED)
)


def _exposure_sql() -> str:
    def fields(table: str, alias: str, names: tuple[str, ...], where: str = "true", key: str = "id") -> list[str]:
        return [f"SELECT '{table}' AS table_name, {key} AS record_id, '{n}' AS field, {n} AS value FROM {alias} WHERE {where}" for n in names]

    def items(table: str, alias: str, names: tuple[str, ...], key: str) -> list[str]:
        return [f"SELECT '{table}', {key}, '{n}', unnest({n}) FROM {alias}" for n in names]

    targets = [
        *fields("study_plan", "study_plan", ("question", "decision", "population", "stop_condition"), key="study_id"),
        *items("study_plan", "study_plan", ("inclusion_criteria", "exclusion_criteria", "limitations", "scope.platforms", "scope.communities", "scope.languages"), "study_id"),
        *fields("query_log", "q", ("id", "platform", "query", "sort", "notes")),
        *fields("signal_catalog", "s", ("id", "name", "hypothesis", "decision_relevance", "wtp_statement", "disconfirming_evidence_needed")), *items("signal_catalog", "s", ("alternative_explanations",), "id"),
        *fields("source_ledger", "l", ("id",)), *fields("source_ledger", "l", ("record_ref",), "visibility = 'supplied_private'"),
        *fields("source_ledger", "l", ("url", "thread_url", "title", "excerpt", "notes"), "visibility = 'public'"),
    ]
    private = fields("source_ledger", "l", ("captured_text", "excerpt", "title", "notes"), "visibility = 'supplied_private'")
    words = "list_filter(string_split(k, ' '), lambda y: y <> '')"
    gram = "array_to_string(list_slice(w, i, i + n - 1), ' ')"
    return (
        f"WITH {_L}, {_Q}, {_S}, t0 AS ({' UNION ALL '.join(targets)}), t AS MATERIALIZED (SELECT *, {_label('value')} AS k FROM t0 WHERE value <> ''), "
        f"p0 AS ({' UNION ALL '.join(private)}), p AS MATERIALIZED (SELECT {_label('value')} AS k FROM p0 WHERE value <> ''), "
        f"pw AS (SELECT k, {words} AS w FROM p), ps AS (SELECT w, CASE WHEN len(w) >= 4 THEN 4 WHEN length(k) >= 8 THEN len(w) END AS n FROM pw WHERE len(w) > 0), "
        f"g AS (SELECT DISTINCT n, {gram} AS gram FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM ps WHERE n IS NOT NULL)), "
        f"tw AS (SELECT table_name, record_id, field, {words} AS w FROM t), tg AS (SELECT DISTINCT table_name, record_id, field, n, {gram} AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM tw, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)), "
        "pp AS (SELECT DISTINCT unnest(regexp_extract_all(k, '[a-z0-9]{12,}')) AS part FROM p), tp AS (SELECT table_name, record_id, field, unnest(regexp_extract_all(k, '[a-z0-9]{12,}')) AS part FROM t WHERE field IN ('id', 'record_ref', 'url', 'thread_url')) "
        f"SELECT DISTINCT table_name, record_id, field, 'pii' AS fault FROM t WHERE regexp_matches(value, {_PII}) OR (field NOT IN ('url', 'thread_url') AND regexp_matches(value, {_TEL})) "
        "UNION SELECT table_name, record_id, field, 'private_text' FROM tg SEMI JOIN g USING (n, gram) UNION SELECT table_name, record_id, field, 'private_text' FROM tp SEMI JOIN pp USING (part)"
    )


_TIME = "try_strptime(substr(t, 1, 19), '%Y-%m-%dT%H:%M:%S')"
def _near_sql() -> str:
    grams = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))"
    return (
        f"WITH RECURSIVE {_L}, {_LINKS}, w AS (SELECT id, k, string_split(lower(k), ' ') AS w FROM dup), nd AS (SELECT id, min(id) OVER (PARTITION BY array_to_string(w, ' ')) AS class, length(k) AS n, {grams} AS g FROM w WHERE len(w) >= 12), "
        "c AS MATERIALIZED (SELECT nd.id AS class, n, g, coalesce(root, nd.id) AS root FROM nd LEFT JOIN roots USING (id) WHERE nd.id = class), s AS MATERIALIZED (SELECT class, len(g) AS m, unnest(g) AS x FROM c), "
        "p AS (SELECT a.class AS a, b.class AS b FROM s a JOIN s b ON a.x = b.x AND a.class < b.class GROUP BY ALL HAVING count(*) >= 0.9 * (any_value(a.m) + any_value(b.m) - count(*)) - 1e-9) "
        "SELECT p.a, p.b, x.root AS root_a, y.root AS root_b FROM p JOIN c x ON x.class = p.a JOIN c y ON y.class = p.b WHERE least(x.n, y.n) >= 0.9 * greatest(x.n, y.n) - 1e-9 AND x.root <> y.root"
    )


_SPECIAL = "regexp_matches(host, '^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\\.|^100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\.|^169\\.254\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.|^192\\.(168|0\\.0|0\\.2|88\\.99)\\.|^198\\.(1[89]|51\\.100)\\.|^203\\.0\\.113\\.')"
SQL = {
    "near_duplicate_records": _near_sql(),
    "url_reach": f"WITH {_L}, h AS (SELECT DISTINCT nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\\-]*://([^/?#:@]+)', 1), '\\.+$', ''), '') AS host FROM l), m AS (SELECT DISTINCT host FROM h WHERE host IS NOT NULL) SELECT host, CASE WHEN regexp_full_match(host, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') THEN CASE WHEN {_SPECIAL} THEN 'private' ELSE 'public' END WHEN NOT contains(host, '.') OR regexp_matches(host, '(^|\\.)(home\\.arpa|internal|lan|local|localdomain|localhost)$') OR regexp_full_match(host, '(0x[0-9a-f]+|[0-9]+)(\\.(0x[0-9a-f]+|[0-9]+))*') THEN 'private' ELSE 'public' END AS reach FROM m",
    "contract_faults": f"WITH {_S}, k AS (SELECT id, length(name) % 7 AS k, support_citations AS c FROM s) SELECT id, '$.level' AS path, 'wrong_type' AS fault FROM k WHERE k = 1 UNION ALL SELECT id, '$.claim', 'missing:count' FROM k WHERE k = 2 UNION ALL SELECT id, '$.claim.count', 'wrong_type' FROM k WHERE k = 3 UNION ALL SELECT id, '$.claim', 'unknown:more' FROM k WHERE k = 4 UNION ALL SELECT id, '$.name', 'null' FROM k WHERE k = 5 UNION ALL SELECT id, '$', 'json:repeated_key' FROM k WHERE k = 6 UNION ALL SELECT id, '$.citations[]', 'null' FROM k WHERE k <> 6 AND len(list_filter(c, lambda y: y IS NULL)) > 0",
    "id_set_faults": f"WITH k AS (SELECT {_KEY.format('x')} AS key, 'catalog' AS t FROM (SELECT unnest(support_citations) AS x FROM signal_catalog) UNION SELECT {_KEY.format('id')}, 'ledger' FROM source_ledger UNION SELECT {_KEY.format('x')}, 'queries' FROM (SELECT unnest(included_source_ids) AS x FROM query_log)), g AS (SELECT key, list(t) AS h FROM k WHERE key <> '' GROUP BY key) SELECT key, array_to_string(list_filter(['catalog', 'ledger', 'queries'], lambda y: NOT list_contains(h, y)), ';') AS lacking FROM g WHERE len(h) < 3",
    "field_issues": f"{_issues_sql()} SELECT * FROM issues",
    "issue_summary": f"{_issues_sql()} SELECT table_name, field, fault, count(*) AS n FROM issues GROUP BY ALL",
    "issue_report": f"{_issues_sql()}, r AS (SELECT row_number() OVER (ORDER BY fault, table_name, field, id) AS rank, * FROM issues) SELECT CAST(rank AS INTEGER) AS rank, CASE WHEN rank > 100 THEN '' ELSE table_name END AS table_name, CASE WHEN rank > 100 THEN '' ELSE id END AS id, CASE WHEN rank > 100 THEN '' ELSE field END AS field, CASE WHEN rank > 100 THEN 'issue_limit' ELSE fault END AS fault FROM r WHERE rank <= 101",
    "parsed_times": f"WITH d AS (SELECT doc_id, doc_id % 6 AS k, strftime(collected_at, '%Y-%m-%dT%H:%M:%S') AS at_text FROM documents WHERE collected_at IS NOT NULL), x AS (SELECT doc_id, k, CASE WHEN k = 4 THEN substr(at_text, 1, 8) || '31' || substr(at_text, 11, 9) ELSE at_text END AS t FROM d) SELECT doc_id, strftime(CASE k WHEN 0 THEN {_TIME} WHEN 1 THEN {_TIME} - INTERVAL 330 MINUTE WHEN 2 THEN {_TIME} + INTERVAL 1439 MINUTE WHEN 4 THEN {_TIME} + INTERVAL 250 MILLISECOND END, '%Y-%m-%d %H:%M:%S.%g') AS instant, CAST(CAST({_TIME} AS DATE) AS VARCHAR) AS day FROM x",
    "publishable_records": f"WITH {_L} SELECT {_PUBLISHABLE} FROM l",
    "ledger_fingerprint": f"WITH {_L}, p AS (SELECT {_PUBLISHABLE} FROM l), h AS (SELECT sha256({' || '.join(_netstring(c) for c in ('id', 'record_ref', 'source_file_sha256', *_PUBLISHED))}) AS h FROM p), g AS (SELECT substr(h, 1, 3) AS part, sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*) AS n FROM h GROUP BY 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, sha256(coalesce(string_agg(part || digest, '' ORDER BY part), '')) AS fingerprint FROM g",
    "private_exposure": _exposure_sql(),
    "private_conflicts": f"WITH {_L} SELECT min(id) AS first_id, count(*) AS records FROM l WHERE visibility = 'supplied_private' AND coalesce(source_file_sha256, '') <> '' GROUP BY source_file_sha256 HAVING count(DISTINCT CAST(({', '.join(_MATERIAL)}) AS VARCHAR)) > 1",
    "wtp_citations": f"WITH {_L}, c AS ({_cited_sql('wtp_citations')}), s AS ({_cited_sql('support_citations')}), j AS (SELECT c.*, l.id AS known, s.source_id AS backed, coalesce(list_has_any(l.evidence_types, ['purchase_intent', 'observed_payment']), false) AS good FROM c LEFT JOIN l ON lower(trim(l.id)) = c.source_id LEFT JOIN s ON s.signal_id = c.signal_id AND s.source_id = c.source_id) SELECT signal_id, source_id, 'unknown' AS fault FROM j WHERE known IS NULL UNION ALL SELECT signal_id, source_id, 'not_support' FROM j WHERE known IS NOT NULL AND backed IS NULL UNION ALL SELECT signal_id, source_id, 'not_eligible' FROM j WHERE known IS NOT NULL AND NOT good",
    "counter_queries": f"WITH {_Q}, k AS (SELECT id, CASE WHEN lower(trim(regexp_replace(platform, '\\s+', ' ', 'g'))) = 'hn' THEN 'hackernews' ELSE {_label('platform')} END AS platform, {_KEY.format('x')} AS key FROM (SELECT id, platform, unnest(signal_ids) AS x FROM q WHERE intent = 'counter')) SELECT n.id AS signal_id, count(DISTINCT k.id) AS queries, count(DISTINCT k.platform) AS platforms FROM (SELECT DISTINCT id FROM signal_catalog) n LEFT JOIN k ON k.key = lower(trim(n.id)) GROUP BY n.id",
    "root_clashes": f"WITH RECURSIVE {_L}, {_LINKS}, s AS ({_cited_sql('support_citations')}), c AS ({_cited_sql('counter_citations')}) SELECT signal_id, coalesce(root, source_id) AS root FROM s LEFT JOIN roots ON lower(trim(roots.id)) = source_id INTERSECT SELECT signal_id, coalesce(root, source_id) FROM c LEFT JOIN roots ON lower(trim(roots.id)) = source_id",
    "non_representative_citations": f"WITH RECURSIVE {_L}, {_LINKS}, o AS (SELECT DISTINCT {_KEY.format('repost_of')} AS k FROM l), m AS (SELECT roots.root, l.id, l.visibility, row_number() OVER (PARTITION BY root ORDER BY o.k IS NULL, published_at NULLS LAST, l.id) AS n FROM roots JOIN l USING (id) LEFT JOIN o ON o.k = lower(trim(l.id))), h AS (SELECT root, bool_or(visibility <> 'public') AS withheld, CASE WHEN bool_or(visibility <> 'public') THEN min(id) ELSE min(CASE WHEN n = 1 THEN id END) END AS representative FROM m GROUP BY root), c AS ({_cited_sql('support_citations', 'counter_citations')}) SELECT DISTINCT signal_id, source_id, representative, withheld FROM c JOIN roots ON lower(trim(roots.id)) = source_id JOIN h USING (root) WHERE lower(trim(representative)) <> source_id",
    "stance_mismatches": f"WITH {_L}, c AS (SELECT lower(trim(signal_id)) AS signal_key, source_id AS source_key, 'support' AS side FROM ({_cited_sql('support_citations')}) UNION SELECT lower(trim(signal_id)), source_id, 'counter' FROM ({_cited_sql('counter_citations')})), d AS (SELECT DISTINCT {_KEY.format('x')} AS signal_key, lower(trim(id)) AS source_key, stance FROM (SELECT id, stance, unnest(signal_ids) AS x FROM l) WHERE {_KEY.format('x')} <> ''), j AS (SELECT signal_key, source_key, CASE WHEN side IS NULL THEN CASE WHEN stance IN ('support', 'counter') THEN 'not_cited' END WHEN d.stance IS NULL THEN 'not_declared' WHEN d.stance <> side THEN 'stance' END AS fault FROM d FULL JOIN c USING (signal_key, source_key)) SELECT DISTINCT * FROM j WHERE fault IS NOT NULL",
    "quote_faults": f"WITH {_L}, quotes AS (SELECT DISTINCT id, lower(trim(coalesce(repost_of, id))) AS source_id, excerpt FROM source_ledger WHERE excerpt IS NOT NULL) SELECT DISTINCT quotes.id, quotes.source_id, CASE WHEN l.id IS NULL THEN 'unknown' ELSE 'other_excerpt' END AS fault FROM quotes LEFT JOIN l ON lower(trim(l.id)) = quotes.source_id WHERE l.id IS NULL OR quotes.excerpt IS DISTINCT FROM l.excerpt",
    "citation_crossing": f"WITH {_S}, c AS (SELECT id, CAST(len(support_citations) + len(counter_citations) AS BIGINT) AS citations FROM s), t AS (SELECT id, citations, CAST(sum(citations) OVER (ORDER BY id) AS BIGINT) AS total FROM c) SELECT id, citations, total FROM t WHERE total > 100 ORDER BY id LIMIT 1",
}
