"""Registered queries over the ledger, its queries and signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import urls as U
from ledgerloom.operators import links, records, summaries
from ledgerloom.operators.references import match_key
from ledgerloom.operators.scratch import Scratch
from ledgerloom.plans import sql_text as X
from ledgerloom.sources.tables import read_table

_COLUMNS = ("platform", "community", "url", "visibility", "unit_id", "thread_id", "published_at", "author_key", "captured_text", "excerpt", "stance", "repost_of", "duplicate_reviews", "source_file_sha256", "record_ref")


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return records.first_deliveries(read_table(spark, folder, "source_ledger"), *(columns or _COLUMNS))


def _ledger(spark, folder):
    return read_table(spark, folder, "source_ledger")


def _queries(spark, folder):
    return records.first_deliveries(read_table(spark, folder, "query_log"), "platform", "query", "run_at", "sort", "included_source_ids", "signal_ids")


def _both_bridges(spark, folder):
    right = links.bridge(read_table(spark, folder, "query_log"), "included_source_ids", "query_key", "source_key").select(F.lower(F.trim("query_key")).alias("query_key"), "source_key").distinct()
    left = links.bridge(_ledger(spark, folder), "query_ids", "source_key", "query_key").select("query_key", F.lower(F.trim("source_key")).alias("source_key")).distinct()
    return left, right


def _long_text(key):
    """Long enough a text to link its records by itself."""
    return (F.length(key) >= 80) & (T.word_count(key) >= 12)


def _groups(spark, folder):
    scratch = Scratch(spark)
    own = scratch.save(_records(spark, folder))
    # made once: the key's expression would be evaluated anew at each use
    keyed = scratch.save(own.select("id", T.duplicate_text_key(F.col("captured_text")).alias("text_key")))
    parts = records.union_all([
        records.declared_links(own),
        records.star_links(own.where("visibility = 'public'"), F.col("unit_id"), "unit"),
        records.star_links(own.where("visibility = 'supplied_private' and source_file_sha256 <> '' and record_ref <> ''"), F.concat_ws("\0", "source_file_sha256", "record_ref"), "provenance"),
        records.star_links(keyed.where(_long_text(F.col("text_key"))), F.md5("text_key"), "text"),
    ])
    found = scratch.save(parts)
    return own, found, records.spread_labels(found, scratch)


def repeated_deliveries(spark, folder):
    return records.repeated_deliveries(_ledger(spark, folder)).select("id", "deliveries", F.date_format("first_load", "yyyy-MM-dd HH:mm:ss").alias("first_load"), F.date_format("last_load", "yyyy-MM-dd HH:mm:ss").alias("last_load"))


def link_mismatches(spark, folder):
    left, right = _both_bridges(spark, folder)
    return links.one_sided(left, right, ("query_key", "source_key"))


def late_publications(spark, folder):
    own = links.bridge(read_table(spark, folder, "query_log"), "included_source_ids", "query_id", "source_id")
    # the runs half a year back: the test tables have no source that was published after a query that found it
    return links.late_publications(own, _records(spark, folder, "published_at"), _queries(spark, folder).withColumn("run_at", F.expr("run_at - INTERVAL 180 DAYS")))


def platform_mismatches(spark, folder):
    own = links.bridge(read_table(spark, folder, "query_log"), "included_source_ids", "query_id", "source_id")
    # queries of every other length count as run on another site
    return links.platform_mismatches(own, _records(spark, folder, "platform"), _queries(spark, folder).withColumn("platform", F.when(F.length("query") % 2 == 0, " HN ").otherwise(F.col("platform"))))


def repeated_executions(spark, folder):
    # a day's runs in one order count as one: no two of the test tables have one instant
    return links.repeated_executions(_queries(spark, folder).withColumn("run_at", F.expr("date_trunc('month', run_at)")).withColumn("query", F.substring("query", 1, 4)))


def review_conflicts(spark, folder):
    # decisions by the length of their reasons, so that some of a pair differ, and each pair is reviewed from the other side, too
    own = _records(spark, folder, "duplicate_reviews").select("id", F.explode("duplicate_reviews").alias("r")).select("id", F.col("r.other_source_id").alias("other_source_id"), F.when(F.length("r.reason") % 2 == 0, "independent").otherwise(F.col("r.decision")).alias("decision"))
    own = own.unionByName(own.select(F.col("other_source_id").alias("id"), F.col("id").alias("other_source_id"), F.lit("same_source").alias("decision")))
    return links.review_conflicts(own.select("id", F.array(F.struct("other_source_id", "decision")).alias("duplicate_reviews")))


def repost_faults(spark, folder):
    return records.repost_faults(_records(spark, folder, "repost_of", "published_at"))


def repost_cycles(spark, folder):
    # originals as reposts of their smallest repost: the test tables have no cycles
    own = _records(spark, folder, "repost_of")
    back = own.select(match_key(F.col("repost_of")).alias("key"), "id").where("key is not null").groupBy("key").agg(F.min("id").alias("back"))
    own = own.withColumn("key", match_key(F.col("id"))).join(back, "key", "left").select("id", F.coalesce("repost_of", "back").alias("repost_of"))
    return records.repost_cycles(own, Scratch(spark))


def group_representatives(spark, folder):
    own, _, roots = _groups(spark, folder)
    return records.representatives(own, roots).drop("private")


def group_reasons(spark, folder):
    own, found, roots = _groups(spark, folder)
    return records.group_reasons(found, roots, own)


def short_text_pairs(spark, folder):
    own, _, roots = _groups(spark, folder)
    keyed = own.select("id", T.duplicate_text_key(F.col("captured_text")).alias("key"))
    short = (F.length("key") >= 20) & (T.word_count(F.col("key")) >= 4) & ~_long_text(F.col("key"))
    return records.short_text_pairs(keyed.where(short), roots)


def conflicting_units(spark, folder):
    own = _records(spark, folder, "unit_id", "visibility", "community", "author_key", "thread_id", "captured_text").where("visibility = 'public'")
    return records.conflicting_units(own, "unit_id", ("author_key", "captured_text", "community", "thread_id"))


def excerpt_faults(spark, folder):
    return links.excerpt_faults(_records(spark, folder, "captured_text", "excerpt"))


def exact_text_groups(spark, folder):
    own = _records(spark, folder, "captured_text").select("id", T.duplicate_text_key(F.col("captured_text")).alias("t")).where("t <> ''")
    return own.groupBy(F.md5("t").alias("text_key")).agg(F.count("*").alias("records"), F.min("id").alias("first_id")).where("records > 1")


def url_hosts(spark, folder):
    own = _records(spark, folder, "url").select(U.host(F.col("url")).alias("host"), F.coalesce(U.port(F.col("url")).cast("string"), F.lit("")).alias("port"))
    return own.where("host is not null").groupBy("host", "port").agg(F.count("*").alias("records"))


def url_parameters(spark, folder):
    return _records(spark, folder, "url").select(F.explode(U.parameter_names(F.col("url"))).alias("parameter")).groupBy("parameter").agg(F.count("*").alias("records"))


def url_canonical(spark, folder):
    return _records(spark, folder, "url").where("url is not null").select("id", U.canonical(F.col("url")).alias("u")).select("id", "u.canonical", "u.error")


def address_groups(spark, folder):
    """Public records of one canonical address, however it is written."""
    own = _records(spark, folder, "url", "visibility").where("visibility = 'public'").select("id", U.canonical(F.col("url")).alias("u")).where("u.canonical is not null")
    return own.groupBy("u.canonical").agg(F.count("*").alias("records"), F.min("id").alias("first_id")).where("records > 1")


def thread_concentration(spark, folder):
    return summaries.concentration(_records(spark, folder, "community", "thread_id"), "community", "thread_id")


def coverage(spark, folder):
    own = _records(spark, folder)
    return summaries.coverage(own, {"authors": F.col("author_key"), "communities": F.col("community"), "threads": F.col("thread_id"), "platforms": F.lower(F.trim("platform")), "units": F.col("unit_id")})


def citation_running_total(spark, folder):
    own = records.first_deliveries(read_table(spark, folder, "signal_catalog"), "support_citations", "counter_citations").select("id", (F.size("support_citations") + F.size("counter_citations")).cast("bigint").alias("citations"))
    return links.running_total(own, "id", "citations", Scratch(spark))


def signal_support(spark, folder):
    """Distinct cited records, authors, threads and communities of each signal; signals without support stay."""
    signals = read_table(spark, folder, "signal_catalog").select("id").distinct()
    cited = links.bridge(read_table(spark, folder, "signal_catalog"), "support_citations", "id", "key")
    own = _records(spark, folder, "author_key", "thread_id", "community").select(F.lower(F.trim("id")).alias("key"), "author_key", "thread_id", "community")
    by = cited.join(own, "key").groupBy("id").agg(F.count("*").alias("records"), F.count_distinct("author_key").alias("authors"), F.count_distinct("thread_id").alias("threads"), F.count_distinct("community").alias("communities"))
    return signals.join(by, "id", "left").fillna(0)


def one_sided_signal_links(spark, folder):
    """Links of records and signals that only the record or only the catalog has."""
    catalog = read_table(spark, folder, "signal_catalog").withColumn("cited", F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("support_citations", "counter_citations"))))
    right = links.bridge(catalog, "cited", "signal_key", "source_key").select(F.lower(F.trim("signal_key")).alias("signal_key"), "source_key").distinct()
    left = links.bridge(_ledger(spark, folder), "signal_ids", "source_key", "signal_key").select("signal_key", F.lower(F.trim("source_key")).alias("source_key")).distinct()
    return links.one_sided(left, right, ("signal_key", "source_key"))


def top_threads(spark, folder):
    by = _records(spark, folder, "platform", "thread_id").select(F.lower(F.trim("platform")).alias("platform"), "thread_id").groupBy("platform", "thread_id").agg(F.count("*").alias("records"))
    return summaries.ranked(by, "platform", [F.desc("records"), F.asc("thread_id")], 5)


QUERIES = {
    f.__name__: f
    for f in (repeated_deliveries, link_mismatches, late_publications, platform_mismatches, repeated_executions, review_conflicts, repost_faults, repost_cycles, group_representatives, group_reasons, short_text_pairs, conflicting_units, excerpt_faults, exact_text_groups, url_hosts, url_parameters, url_canonical, address_groups, thread_concentration, coverage, citation_running_total, signal_support, one_sided_signal_links, top_threads)
}

_L = "l AS (SELECT * FROM source_ledger WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
_Q = "q AS (SELECT * FROM query_log WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
_KEY = "lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_REF = "b AS (SELECT DISTINCT query_id, source_id FROM (SELECT id AS query_id, " + _KEY.format("x") + " AS source_id FROM (SELECT id, unnest(included_source_ids) AS x FROM query_log)) WHERE source_id <> '')"
_PLATFORM = "CASE WHEN lower(trim(regexp_replace({0}.platform, '\\s+', ' ', 'g'))) = 'hn' THEN 'hackernews' ELSE lower(trim(regexp_replace({0}.platform, '\\s+', ' ', 'g'))) END"
_FLAT = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0d\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{180e}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
_DUP = "dup AS MATERIALIZED (SELECT id, " + X.duplicate_key("captured_text") + " AS k FROM l WHERE captured_text IS NOT NULL)"
_LINKS = (
    _DUP + ", d AS (SELECT id AS a, " + _KEY.format("repost_of") + " AS k, 'repost' AS reason FROM l UNION ALL SELECT a, " + _KEY.format("r.other_source_id") + ", 'review' FROM (SELECT id AS a, unnest(duplicate_reviews) AS r FROM l) WHERE r.decision = 'same_source'), "
    "unit AS (SELECT id, unit_id AS k, 'unit' AS reason FROM l WHERE visibility = 'public' AND unit_id IS NOT NULL UNION ALL SELECT id, source_file_sha256 || chr(1) || record_ref, 'provenance' FROM l WHERE visibility = 'supplied_private' AND source_file_sha256 <> '' AND record_ref <> '' UNION ALL SELECT id, k, 'text' FROM dup WHERE length(k) >= 80 AND " + X.words("k") + " >= 12), "
    "star AS (SELECT min(id) OVER (PARTITION BY k, reason) AS a, id AS b, reason FROM unit), "
    "links AS (SELECT d.a, l.id AS b, d.reason FROM d JOIN l ON lower(trim(l.id)) = d.k WHERE d.a <> l.id UNION ALL SELECT * FROM star WHERE a <> b), "
    "ends AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links), "
    "reach(id, other) AS (SELECT x, x FROM ends UNION SELECT reach.id, ends.y FROM reach JOIN ends ON reach.other = ends.x), "
    "roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id)"
)
SQL = {
    "repeated_deliveries": "SELECT id, count(*) AS deliveries, strftime(min(loaded_at), '%Y-%m-%d %H:%M:%S') AS first_load, strftime(max(loaded_at), '%Y-%m-%d %H:%M:%S') AS last_load FROM source_ledger WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
    "link_mismatches": "WITH r AS (SELECT DISTINCT lower(trim(id)) AS query_key, " + _KEY.format("x") + " AS source_key FROM (SELECT id, unnest(included_source_ids) AS x FROM query_log) WHERE x IS NOT NULL), s AS (SELECT DISTINCT " + _KEY.format("x") + " AS query_key, lower(trim(id)) AS source_key FROM (SELECT id, unnest(query_ids) AS x FROM source_ledger) WHERE x IS NOT NULL), r2 AS (SELECT * FROM r WHERE source_key <> ''), s2 AS (SELECT * FROM s WHERE query_key <> '') SELECT *, 'left' AS side FROM (FROM s2 EXCEPT FROM r2) UNION ALL SELECT *, 'right' FROM (FROM r2 EXCEPT FROM s2)",
    "late_publications": f"WITH {_L}, {_Q}, {_REF} SELECT DISTINCT query_id, source_id FROM b JOIN l ON lower(trim(l.id)) = source_id JOIN q ON q.id = query_id WHERE l.published_at > q.run_at - INTERVAL 180 DAY",
    "platform_mismatches": f"WITH {_L}, {_Q}, {_REF} SELECT DISTINCT query_id, source_id FROM b JOIN l ON lower(trim(l.id)) = source_id JOIN q ON q.id = query_id WHERE {_PLATFORM.format('l')} <> CASE WHEN length(q.query) % 2 = 0 THEN 'hackernews' ELSE {_PLATFORM.format('q')} END",
    "repeated_executions": f"WITH {_Q}, k AS (SELECT id, min(id) OVER (PARTITION BY {_PLATFORM.format('q')}, substr(query, 1, 4), date_trunc('month', run_at), sort) AS first_id FROM q) SELECT first_id, id FROM k WHERE id <> first_id",
    "review_conflicts": f"WITH {_L}, v AS (SELECT {_KEY.format('id')} AS x, {_KEY.format('r.other_source_id')} AS y, CASE WHEN length(r.reason) % 2 = 0 THEN 'independent' ELSE r.decision END AS d FROM (SELECT id, unnest(duplicate_reviews) AS r FROM l)), p AS (SELECT * FROM v WHERE x <> '' AND y <> '' UNION ALL SELECT y, x, 'same_source' FROM v WHERE x <> '' AND y <> '') SELECT least(x, y) AS a, greatest(x, y) AS b FROM p WHERE x <> y AND d IS NOT NULL GROUP BY ALL HAVING count(DISTINCT d) > 1",
    "repost_faults": f"WITH {_L}, c AS (SELECT id, lower(trim(id)) AS own, nullif({_KEY.format('repost_of')}, '') AS target_id, published_at FROM l), p AS (SELECT c.id, c.own, c.target_id, c.published_at AS own_at, o.target_id AS above, o.published_at AS parent_at FROM c JOIN c o ON o.own = c.target_id) SELECT id, target_id, 'self' AS fault FROM p WHERE own = target_id UNION ALL SELECT id, target_id, 'chain' FROM p WHERE above IS NOT NULL AND own <> target_id UNION ALL SELECT id, target_id, 'before_origin' FROM p WHERE own_at < parent_at",
    "repost_cycles": f"WITH RECURSIVE {_L}, back AS (SELECT {_KEY.format('repost_of')} AS k, min(id) AS back FROM l WHERE {_KEY.format('repost_of')} <> '' GROUP BY 1), s AS (SELECT lower(trim(l.id)) AS a, {_KEY.format('coalesce(repost_of, back)')} AS b FROM l LEFT JOIN back ON k = lower(trim(l.id))), walk(first, here) AS (SELECT a, b FROM s UNION SELECT first, s.b FROM walk JOIN s ON s.a = walk.here) SELECT DISTINCT first AS id FROM walk WHERE first = here",
    "group_representatives": f"WITH RECURSIVE {_L}, {_LINKS}, o AS (SELECT DISTINCT {_KEY.format('repost_of')} AS k FROM l), m AS (SELECT roots.root, l.id, l.visibility, row_number() OVER (PARTITION BY root ORDER BY o.k IS NULL, published_at NULLS LAST, l.id) AS n FROM roots JOIN l USING (id) LEFT JOIN o ON o.k = lower(trim(l.id))) SELECT root, CASE WHEN bool_or(visibility <> 'public') THEN min(id) ELSE min(CASE WHEN n = 1 THEN id END) END AS representative, count(*) AS members FROM m GROUP BY root",
    "group_reasons": f"WITH RECURSIVE {_L}, {_LINKS}, why AS (SELECT root, string_agg(DISTINCT reason, ';' ORDER BY reason) AS reasons FROM links JOIN roots ON roots.id = links.a GROUP BY root), n AS (SELECT root, count(*) AS members, bool_or(visibility <> 'public') AS private FROM roots JOIN l USING (id) GROUP BY root) SELECT root, members, CASE WHEN private THEN 'withheld' ELSE reasons END AS reasons FROM n JOIN why USING (root)",
    "short_text_pairs": f"WITH RECURSIVE {_L}, {_LINKS}, k AS (SELECT dup.id, dup.k AS key, coalesce(root, dup.id) AS root FROM dup LEFT JOIN roots USING (id)), h AS (SELECT key, root, min(id) AS id FROM k WHERE length(key) >= 20 AND {X.words('key')} >= 4 AND NOT (length(key) >= 80 AND {X.words('key')} >= 12) GROUP BY ALL), f AS (SELECT key, arg_min(root, id) AS first_root, min(id) AS a FROM h GROUP BY key) SELECT a, min(id) AS b FROM h JOIN f USING (key) WHERE root <> first_root GROUP BY key, a",
    "conflicting_units": f"WITH {_L}, u AS (SELECT unit_id, count(*) AS records, concat_ws(';', CASE WHEN count(DISTINCT coalesce(author_key, chr(0))) > 1 THEN 'author_key' END, CASE WHEN count(DISTINCT coalesce(captured_text, chr(0))) > 1 THEN 'captured_text' END, CASE WHEN count(DISTINCT coalesce(community, chr(0))) > 1 THEN 'community' END, CASE WHEN count(DISTINCT coalesce(thread_id, chr(0))) > 1 THEN 'thread_id' END) AS fields FROM l WHERE visibility = 'public' AND unit_id IS NOT NULL GROUP BY unit_id) SELECT * FROM u WHERE records > 1 AND fields <> ''",
    "excerpt_faults": f"WITH {_L}, e AS (SELECT id, captured_text, excerpt, {_FLAT.format('excerpt')} AS f FROM l WHERE excerpt IS NOT NULL) SELECT id, 'too_long' AS fault FROM e WHERE f <> '' AND len(string_split(f, ' ')) > 25 UNION ALL SELECT id, 'no_part' FROM e WHERE NOT contains(captured_text, excerpt)",
    "exact_text_groups": f"WITH {_L}, {_DUP}, t AS (SELECT id, k AS t FROM dup) SELECT md5(t) AS text_key, count(*) AS records, min(id) AS first_id FROM t WHERE t <> '' GROUP BY t HAVING count(*) > 1",
    "url_hosts": f"WITH {_L}, h AS (SELECT nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\\-]*://([^/?#:@]+)', 1), '\\.+$', ''), '') AS host, regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#:@]+:([0-9]{{1,5}})(?:[/?#]|$)', 1) AS port FROM l) SELECT host, port, count(*) AS records FROM h WHERE host IS NOT NULL GROUP BY ALL",
    "url_parameters": f"WITH {_L}, p AS (SELECT DISTINCT id, lower(split_part(unnest(regexp_split_to_array(regexp_extract(url, '\\?([^#]*)', 1), '[&;]')), '=', 1)) AS parameter FROM l) SELECT parameter, count(*) AS records FROM p WHERE parameter <> '' GROUP BY parameter",
    "thread_concentration": f"WITH {_L}, n AS (SELECT community, thread_id, count(*) AS n FROM l WHERE thread_id IS NOT NULL GROUP BY ALL) SELECT community, CAST(sum(n) AS BIGINT) AS n, count(*) AS keys, arg_min(thread_id, (-n, thread_id)) AS top_key, max(n) AS top_n FROM n GROUP BY community",
    "coverage": f"WITH {_L} SELECT 'authors' AS measure, count(DISTINCT author_key) AS distinct_values FROM l UNION ALL SELECT 'communities', count(DISTINCT community) FROM l UNION ALL SELECT 'threads', count(DISTINCT thread_id) FROM l UNION ALL SELECT 'platforms', count(DISTINCT lower(trim(platform))) FROM l UNION ALL SELECT 'units', count(DISTINCT unit_id) FROM l",
    "citation_running_total": "WITH c AS (SELECT id, CAST(len(support_citations) + len(counter_citations) AS BIGINT) AS citations FROM signal_catalog) SELECT id, citations, CAST(sum(citations) OVER (ORDER BY id) AS BIGINT) AS total FROM c",
    "signal_support": f"WITH {_L}, c AS (SELECT DISTINCT id, {_KEY.format('x')} AS k FROM (SELECT id, unnest(support_citations) AS x FROM signal_catalog)), m AS (SELECT c.id, count(*) AS records, count(DISTINCT author_key) AS authors, count(DISTINCT thread_id) AS threads, count(DISTINCT community) AS communities FROM c JOIN l ON lower(trim(l.id)) = c.k GROUP BY c.id) SELECT s.id, coalesce(records, 0) AS records, coalesce(authors, 0) AS authors, coalesce(threads, 0) AS threads, coalesce(communities, 0) AS communities FROM (SELECT DISTINCT id FROM signal_catalog) s LEFT JOIN m USING (id)",
    "one_sided_signal_links": "WITH r AS (SELECT DISTINCT lower(trim(id)) AS signal_key, " + _KEY.format("x") + " AS source_key FROM (SELECT id, unnest(support_citations) AS x FROM signal_catalog UNION ALL SELECT id, unnest(counter_citations) FROM signal_catalog)), s AS (SELECT DISTINCT " + _KEY.format("x") + " AS signal_key, lower(trim(id)) AS source_key FROM (SELECT id, unnest(signal_ids) AS x FROM source_ledger)), r2 AS (SELECT * FROM r WHERE source_key <> ''), s2 AS (SELECT * FROM s WHERE signal_key <> '') SELECT *, 'left' AS side FROM (FROM s2 EXCEPT FROM r2) UNION ALL SELECT *, 'right' FROM (FROM r2 EXCEPT FROM s2)",
    "top_threads": f"WITH {_L}, n AS (SELECT lower(trim(platform)) AS platform, thread_id, count(*) AS records FROM l GROUP BY ALL) SELECT platform, thread_id, records, CAST(row_number() OVER (PARTITION BY platform ORDER BY records DESC, thread_id) AS INTEGER) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY platform ORDER BY records DESC, thread_id) <= 5",
}
