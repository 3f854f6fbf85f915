"""Registered queries of experiment analysis, over ratings derived from lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import experiments
from ledgerloom.operators.records import first_deliveries
from ledgerloom.operators.references import match_key
from ledgerloom.operators.scratch import Scratch
from ledgerloom.plans import sql_text as X
from ledgerloom.sources.tables import read_table

_KEY = "blind-order"


def _ratings(spark: SparkSession, folder: str) -> DataFrame:
    whole = lambda c: F.floor(F.col(c)).cast("bigint")
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("blind_id"), F.col("l_linenumber").alias("dimension"), (whole("l_quantity") % 5).alias("rater_a"), (whole("l_extendedprice") % 5).alias("rater_b"), (F.col("l_partkey") % 5).alias("adjudicator"),
    )


def _unique(spark, folder):
    """One rating per trial and dimension."""
    return _ratings(spark, folder).groupBy("blind_id", "dimension").agg(F.min(F.struct("rater_a", "rater_b", "adjudicator")).alias("r")).select("blind_id", "dimension", "r.*")


def _totals(spark, folder):
    resolved = experiments.resolved_ratings(_unique(spark, folder))
    by = resolved.groupBy("blind_id").agg((40 * F.sum(F.col("rating").cast("decimal(12,2)")) / F.count("*") / 4).cast("decimal(12,4)").alias("total"))
    return by.select("blind_id", (F.floor(F.col("blind_id") / 2).cast("bigint") % 12).alias("case_id"), F.floor(F.col("blind_id") / 2).cast("bigint").alias("pair_id"), F.when(F.col("blind_id") % 2 == 0, "baseline").otherwise("skill").alias("condition"), "total")


def trial_ratings(spark, folder):
    return experiments.resolved_ratings(_unique(spark, folder))


def adjudication_targets(spark, folder):
    return experiments.adjudication_targets(_ratings(spark, folder))


def rater_agreement(spark, folder):
    return experiments.agreement(_ratings(spark, folder))


def critical_majority(spark, folder):
    return experiments.critical_majority(_ratings(spark, folder).select("blind_id", (F.col("rater_a") == 0).alias("vote")))


def condition_summary(spark, folder):
    own = experiments.condition_summary(_totals(spark, folder))
    return own.select("condition", "n", F.round(F.col("mean").cast("double"), 6).alias("mean"), F.round(F.col("median").cast("double"), 6).alias("median"))


def paired_effects(spark, folder):
    own = experiments.effect_summary(experiments.paired_effects(_totals(spark, folder), "baseline", "skill"))
    return own.select("case_id", "pairs", "wins", "ties", F.round(F.col("mean_lift").cast("double"), 6).alias("mean_lift"))


def bootstrap_interval(spark, folder):
    return experiments.bootstrap_interval_of_effects(experiments.paired_effects(_totals(spark, folder), "baseline", "skill"))


def blind_order(spark, folder):
    return experiments.keyed_order(read_table(spark, folder, "orders").select("o_orderkey").distinct(), "o_orderkey", _KEY, Scratch(spark))


def blind_order_faults(spark, folder):
    """Places of an order by customers that aren't those of the secret key."""
    claimed = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - 1).alias("position"))
    return experiments.order_faults(claimed, "id", _KEY, Scratch(spark))


def trial_allocation(spark, folder):
    cases = read_table(spark, folder, "nation").select(F.concat(F.lit("case-"), F.col("n_nationkey").cast("string")).alias("case_id"))
    return experiments.allocation(cases, 5, ("baseline", "skill"), 7)


def score_coverage(spark, folder):
    scores = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("blind_id"), (F.col("l_linenumber") % 3).alias("scorer"))
    packets = read_table(spark, folder, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("blind_id"))
    return experiments.score_coverage(packets, scores, 2)


def score_faults(spark, folder):
    scores = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("blind_id"), (F.col("l_linenumber") % 2).alias("scorer"), F.floor(F.col("l_linenumber") / 2).cast("bigint").alias("dimension"), F.nullif(F.floor("l_quantity").cast("bigint") % 7, F.lit(6)).alias("rating"))
    orders = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("blind_id"))
    return experiments.score_faults(scores, orders.withColumn("dimension", F.explode(F.array(*(F.lit(k).cast("bigint") for k in range(3))))))


def _scores(spark, folder):
    """Two scorers' ratings, in long form."""
    own = _unique(spark, folder)
    return own.select("blind_id", "dimension", F.explode(F.array(F.struct(F.lit("a").alias("scorer"), F.col("rater_a").alias("rating")), F.struct(F.lit("b").alias("scorer"), F.col("rater_b").alias("rating")))).alias("x")).select("blind_id", "dimension", "x.*")


def _codes(spark, folder):
    """The critical failures that each scorer saw: a code for each dimension rated 0."""
    return _scores(spark, folder).groupBy("blind_id", "scorer").agg(F.sort_array(F.collect_set(F.when(F.col("rating") == 0, F.concat(F.lit("CODE_"), F.col("dimension").cast("string"))))).alias("codes"))  # one trial's dimensions


def rating_disputes(spark, folder):
    return experiments.disputes(_scores(spark, folder), _codes(spark, folder))


def critical_codes(spark, folder):
    return experiments.critical_codes(_codes(spark, folder))


def _outcomes(spark, folder):
    quality = _totals(spark, folder).select("blind_id", "pair_id", "case_id", "condition", F.col("total").alias("quality"))
    hard = read_table(spark, folder, "orders").groupBy(F.col("o_orderkey").alias("blind_id")).agg((F.max("o_orderkey") % 61).cast("decimal(12,4)").alias("hard"))
    totals = experiments.trial_totals(quality.join(hard, "blind_id").select("blind_id", "hard", "quality"), critical_codes(spark, folder), 49.0, 75.0)
    return totals.join(quality.drop("quality"), "blind_id").withColumn("total", F.col("total").cast("decimal(12,4)"))


def trial_outcomes(spark, folder):
    return _outcomes(spark, folder).select("blind_id", F.col("total").cast("double").alias("total"), "critical", "passed")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(F.col(c).cast("double"), 3).alias(c) if c in columns else c for c in df.columns))


def condition_outcomes(spark, folder):
    return _rounded(experiments.outcome_summary(_outcomes(spark, folder), "condition"), "mean", "median", "pass_rate")


def case_outcomes(spark, folder):
    return _rounded(experiments.outcome_summary(_outcomes(spark, folder), "condition", "case_id"), "mean", "median", "pass_rate")


def overall_effect(spark, folder):
    effects = experiments.paired_effects(_outcomes(spark, folder).withColumn("total", F.col("total").cast("double")), "baseline", "skill")
    return _rounded(experiments.overall_effect(effects), "win_rate", "mean_lift")


def outcome_gates(spark, folder):
    """Two stages of gates over the experiment's figures, with thresholds of the query's own."""
    outcomes = _outcomes(spark, folder)
    skill = experiments.outcome_summary(outcomes.where("condition = 'skill'"), "condition").select(F.col("mean").cast("double").alias("mean"), "pass_rate")
    least = experiments.outcome_summary(outcomes, "condition", "case_id").agg(F.min("n").alias("replicates"))
    facts = skill.crossJoin(least).crossJoin(experiments.overall_effect(experiments.paired_effects(outcomes.withColumn("total", F.col("total").cast("double")), "baseline", "skill")).drop("n"))  # one row each
    return experiments.gates(facts, {"replicates": ("protocol", F.col("replicates") >= 5), "mean_total": ("acceptance", F.col("mean") >= 30), "pass_rate": ("acceptance", F.col("pass_rate") >= 0.8), "win_rate": ("effect", F.col("win_rate") >= 0.3)})


def citation_integrity(spark, folder):
    """Each signal as a trial and case of its own: its citations in order against the records, some with another locator or quotation."""
    records_of = first_deliveries(read_table(spark, folder, "source_ledger"), "visibility", "url", "record_ref", "thread_url", "source_file_sha256", "captured_text", "excerpt")
    known = records_of.select(match_key(F.col("id")).alias("source_id"), "visibility", F.coalesce("url", "record_ref").alias("locator"), F.when(F.col("visibility") != "public", F.col("source_file_sha256")).alias("hash"), "captured_text", "excerpt", "thread_url")
    catalog = first_deliveries(read_table(spark, folder, "signal_catalog"), "support_citations", "wtp_citations")
    named = catalog.select(F.col("id").alias("trial_id"), F.posexplode(F.concat("support_citations", "wtp_citations")).alias("place", "raw")).select("trial_id", "place", match_key(F.col("raw")).alias("source_id")).where("source_id is not null")
    cited = named.join(known.drop("captured_text"), "source_id", "left").select("trial_id", F.col("trial_id").alias("case_id"), "place", "source_id", "visibility", F.when(F.col("place") % 5 == 3, F.col("thread_url")).otherwise(F.col("locator")).alias("locator"), "hash", F.when((F.col("visibility") == "public") | (F.col("place") % 7 == 2), F.col("excerpt")).alias("excerpt"))
    pairs = named.select(F.col("trial_id").alias("case_id"), "source_id").distinct()
    required = catalog.select(F.col("id").alias("case_id"), F.explode("support_citations").alias("raw")).select("case_id", match_key(F.col("raw")).alias("source_id")).where("source_id is not null")
    return experiments.citation_integrity(cited, pairs.join(known, "source_id").drop("excerpt", "thread_url"), required)


QUERIES = {f.__name__: f for f in (trial_ratings, adjudication_targets, rater_agreement, critical_majority, condition_summary, paired_effects, bootstrap_interval, blind_order, blind_order_faults, trial_allocation, score_coverage, score_faults, rating_disputes, critical_codes, trial_outcomes, condition_outcomes, case_outcomes, overall_effect, outcome_gates, citation_integrity)}

_R = "r AS (SELECT l_orderkey AS blind_id, l_linenumber AS dimension, CAST(floor(l_quantity) AS BIGINT) % 5 AS rater_a, CAST(floor(l_extendedprice) AS BIGINT) % 5 AS rater_b, l_partkey % 5 AS adjudicator FROM lineitem)"
_U = _R + ", u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY blind_id, dimension ORDER BY rater_a, rater_b, adjudicator) = 1)"
_T = _U + ", v AS (SELECT blind_id, dimension, CASE WHEN abs(rater_a - rater_b) >= 2 THEN CAST(list_sort([rater_a, rater_b, adjudicator])[2] AS DOUBLE) ELSE (rater_a + rater_b) / 2.0 END AS rating, abs(rater_a - rater_b) >= 2 AS adjudicated FROM u), t AS (SELECT blind_id, (blind_id // 2) % 12 AS case_id, blind_id // 2 AS pair_id, CASE WHEN blind_id % 2 = 0 THEN 'baseline' ELSE 'skill' END AS condition, round(10 * sum(rating) / count(*) + 1e-9, 4) AS total FROM v GROUP BY blind_id)"
_C = _U + ", z AS (SELECT blind_id, dimension, rater_a = 0 AS a, rater_b = 0 AS b FROM u), c AS (SELECT blind_id, CAST(bool_or(a) AS INTEGER) + CAST(bool_or(b) AS INTEGER) AS seen, coalesce(string_agg('CODE_' || dimension, ';' ORDER BY 'CODE_' || dimension) FILTER (a OR b), '') AS codes FROM z GROUP BY 1)"
_O = _T + ", z AS (SELECT blind_id, bool_or(rater_a = 0) AND bool_or(rater_b = 0) AS critical FROM u GROUP BY 1), h AS (SELECT blind_id, pair_id, case_id, condition, critical, CAST(CASE WHEN critical THEN least(o_orderkey % 61 + total, 49) ELSE o_orderkey % 61 + total END AS DOUBLE) AS total FROM t JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey = blind_id JOIN z USING (blind_id)), o AS (SELECT *, total >= 75 AND NOT critical AS passed FROM h)"
_PADS = tuple("".join(f"{b ^ pad:02x}" for b in _KEY.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C))
_HMAC = f"sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(t))))"
_MATCH = "lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_WORDS = X.words("excerpt")
_FIRST = "l AS (SELECT * FROM source_ledger WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1), sg AS (SELECT * FROM signal_catalog WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1), k AS (SELECT *, lower(trim(id)) AS source_id, coalesce(url, record_ref) AS locator FROM l)"
SQL = {
    "trial_ratings": f"WITH {_T} SELECT * FROM v",
    "adjudication_targets": f"WITH {_R} SELECT blind_id, string_agg(DISTINCT CAST(dimension AS VARCHAR), ';' ORDER BY CAST(dimension AS VARCHAR)) AS dimensions FROM r WHERE abs(rater_a - rater_b) >= 2 GROUP BY blind_id",
    "rater_agreement": f"WITH {_R} SELECT dimension, count(*) AS n, count(*) FILTER (rater_a = rater_b) AS same, count(*) FILTER (abs(rater_a - rater_b) <= 1) AS near FROM r GROUP BY dimension",
    "critical_majority": f"WITH {_R} SELECT blind_id, count(*) AS n, count(*) FILTER (rater_a = 0) AS votes, count(*) FILTER (rater_a = 0) >= count(*) // 2 + 1 AS critical FROM r GROUP BY blind_id",
    "condition_summary": f"WITH {_T} SELECT condition, count(*) AS n, round(avg(total), 6) AS mean, round(median(total), 6) AS median FROM t GROUP BY condition",
    "paired_effects": f"WITH {_T}, p AS (SELECT pair_id, case_id, sum(total) FILTER (condition = 'skill') - sum(total) FILTER (condition = 'baseline') AS lift FROM t GROUP BY ALL) SELECT case_id, count(*) AS pairs, count(*) FILTER (lift > 1e-7) AS wins, count(*) FILTER (abs(lift) <= 1e-7) AS ties, round(avg(lift), 6) AS mean_lift FROM p WHERE lift IS NOT NULL GROUP BY case_id",
    "blind_order": f"WITH k AS (SELECT DISTINCT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS t FROM orders) SELECT id, row_number() OVER (ORDER BY {_HMAC}, id) - 1 AS position FROM k",
    "blind_order_faults": f"WITH k AS (SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS t FROM customer), o AS (SELECT id, id - 1 AS claimed, row_number() OVER (ORDER BY {_HMAC}, id) - 1 AS position FROM k) SELECT * FROM o WHERE claimed <> position",
    "trial_allocation": "WITH g AS (SELECT 'case-' || n_nationkey AS case_id, CAST(r AS INTEGER) AS replicate, c AS condition FROM (SELECT DISTINCT n_nationkey FROM nation), range(1, 6) t(r), (VALUES ('baseline'), ('skill')) v(c)), i AS (SELECT *, 'pair-' || substr(sha256(concat_ws(chr(31), '7', case_id, CAST(replicate AS VARCHAR))), 1, 16) AS pair_id, 'trial-' || substr(sha256(concat_ws(chr(31), '7', case_id, CAST(replicate AS VARCHAR), condition)), 1, 16) AS trial_id FROM g) SELECT *, CAST('0x' || substr(sha256(concat_ws(chr(31), '7', pair_id, 'model-seed')), 1, 8) AS BIGINT) AS model_seed, sha256(concat_ws(chr(31), '7', trial_id, 'dispatch')) AS dispatch FROM i",
    "score_coverage": "WITH s AS (SELECT l_orderkey AS blind_id, l_linenumber % 3 AS scorer, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT blind_id, count(*) AS scorers, max(n) AS most FROM s GROUP BY 1), p AS (SELECT DISTINCT o_orderkey AS blind_id FROM orders WHERE o_orderkey % 7 <> 0) SELECT blind_id, 'unknown' AS fault FROM b ANTI JOIN p USING (blind_id) UNION ALL SELECT blind_id, 'repeated' FROM b WHERE most > 1 UNION ALL SELECT p.blind_id, 'missing' FROM p LEFT JOIN b USING (blind_id) WHERE coalesce(scorers, 0) < 2",
    "score_faults": "WITH s AS (SELECT l_orderkey AS blind_id, l_linenumber % 2 AS scorer, CAST(l_linenumber // 2 AS BIGINT) AS dimension, nullif(CAST(floor(l_quantity) AS BIGINT) % 7, 6) AS rating FROM lineitem), d AS (SELECT o_orderkey AS blind_id, k AS dimension FROM orders, range(3) t(k)), e AS (SELECT DISTINCT s.blind_id, scorer, d.dimension FROM s JOIN d USING (blind_id)) SELECT blind_id, scorer, dimension, 'missing' AS fault FROM e ANTI JOIN s USING (blind_id, scorer, dimension) UNION ALL SELECT blind_id, scorer, dimension, 'not_applicable' FROM s ANTI JOIN e USING (blind_id, scorer, dimension) WHERE rating IS NOT NULL UNION ALL SELECT blind_id, scorer, dimension, 'rating' FROM s SEMI JOIN e USING (blind_id, scorer, dimension) WHERE rating IS NULL OR rating > 4",
    "rating_disputes": f"WITH {_C} SELECT blind_id, dimensions, seen = 1 AS critical_disputed FROM (SELECT blind_id, coalesce(string_agg(CAST(dimension AS VARCHAR), ';' ORDER BY CAST(dimension AS VARCHAR)) FILTER (abs(rater_a - rater_b) >= 2), '') AS dimensions FROM u GROUP BY 1) JOIN c USING (blind_id) WHERE dimensions <> '' OR seen = 1",
    "critical_codes": f"WITH {_C} SELECT blind_id, 2 AS scorers, CAST(seen AS BIGINT) AS votes, seen = 2 AS critical, seen = 1 AS tie, CASE WHEN seen = 2 THEN codes ELSE '' END AS codes FROM c",
    "trial_outcomes": f"WITH {_O} SELECT blind_id, total, critical, passed FROM o",
    "condition_outcomes": f"WITH {_O} SELECT condition, count(*) AS n, round(avg(total), 3) AS mean, round(median(total), 3) AS median, round(count(*) FILTER (passed) / count(*), 3) AS pass_rate, count(*) FILTER (critical) AS critical FROM o GROUP BY 1",
    "case_outcomes": f"WITH {_O} SELECT condition, case_id, count(*) AS n, round(avg(total), 3) AS mean, round(median(total), 3) AS median, round(count(*) FILTER (passed) / count(*), 3) AS pass_rate, count(*) FILTER (critical) AS critical FROM o GROUP BY ALL",
    "overall_effect": f"WITH {_O}, p AS (SELECT pair_id, case_id, sum(total) FILTER (condition = 'skill') - sum(total) FILTER (condition = 'baseline') AS lift FROM o GROUP BY ALL) SELECT count(lift) AS pairs, count(*) FILTER (lift > 1e-7) AS wins, count(*) FILTER (abs(lift) <= 1e-7) AS ties, round(count(*) FILTER (lift > 1e-7) / count(lift), 3) AS win_rate, round(avg(lift), 3) AS mean_lift, count(*) FILTER (lift IS NULL) AS unpaired FROM p",
    "outcome_gates": f"WITH {_O}, s AS (SELECT avg(total) >= 30 AS m, count(*) FILTER (passed) / count(*) >= 0.8 AS r FROM o WHERE condition = 'skill'), k AS (SELECT min(n) >= 5 AS k FROM (SELECT count(*) AS n FROM o GROUP BY condition, case_id)), p AS (SELECT sum(total) FILTER (condition = 'skill') - sum(total) FILTER (condition = 'baseline') AS lift FROM o GROUP BY pair_id, case_id), w AS (SELECT count(*) FILTER (lift > 1e-7) / count(lift) >= 0.3 AS w FROM p), f AS (SELECT * FROM s, k, w) SELECT 'protocol' AS stage, 'replicates' AS gate, k AS passed FROM f UNION ALL SELECT 'protocol', 'all', k FROM f UNION ALL SELECT 'acceptance', 'mean_total', m FROM f UNION ALL SELECT 'acceptance', 'pass_rate', r FROM f UNION ALL SELECT 'acceptance', 'all', k AND m AND r FROM f UNION ALL SELECT 'effect', 'win_rate', w FROM f UNION ALL SELECT 'effect', 'all', k AND m AND r AND w FROM f",
    "citation_integrity": f"WITH {_FIRST}, n AS (SELECT id AS trial_id, i - 1 AS place, {_MATCH.format('x[i]')} AS source_id FROM (SELECT id, list_concat(support_citations, wtp_citations) AS x, unnest(range(1, len(support_citations) + len(wtp_citations) + 1)) AS i FROM sg)), c AS (SELECT n.*, k.id IS NOT NULL AS known, k.visibility, k.captured_text, CASE WHEN place % 5 = 3 THEN thread_url ELSE locator END IS NOT DISTINCT FROM locator AS located, CASE WHEN k.visibility = 'public' OR place % 7 = 2 THEN k.excerpt END AS excerpt, row_number() OVER (PARTITION BY trial_id, n.source_id ORDER BY place) AS nth FROM n LEFT JOIN k ON k.source_id = n.source_id WHERE n.source_id <> ''), g AS (SELECT *, known AND nth = 1 AND located AND CASE WHEN visibility = 'public' THEN coalesce(contains(captured_text, excerpt) AND {_WORDS} <= 25, false) ELSE excerpt IS NULL END AS good FROM c), r AS (SELECT DISTINCT id AS trial_id, {_MATCH.format('x')} AS source_id FROM (SELECT id, unnest(support_citations) AS x FROM sg)), v AS (SELECT trial_id, count(DISTINCT source_id) AS covered FROM c SEMI JOIN r USING (trial_id, source_id) GROUP BY 1), q AS (SELECT trial_id, count(*) AS required FROM r WHERE source_id <> '' GROUP BY 1) SELECT trial_id, count(*) AS cited, count(*) FILTER (good) AS valid, any_value(coalesce(required, 0)) AS required, any_value(coalesce(covered, 0)) AS covered, count(*) FILTER (NOT coalesce(good, false)) AS fabricated, count(*) FILTER (known AND nth = 1 AND visibility <> 'public' AND excerpt IS NOT NULL) AS disclosed FROM g LEFT JOIN q USING (trial_id) LEFT JOIN v USING (trial_id) GROUP BY trial_id",
}
