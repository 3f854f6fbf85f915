"""Links that two tables keep on both sides, and what doesn't agree between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import platform
from ledgerloom.operators.references import match_key
from ledgerloom.operators.scratch import Scratch


def bridge(rows: DataFrame, field: str, own: str, other: str) -> DataFrame:
    """Distinct (own, other) pairs of an array of ids; null and blank elements are no links."""
    return rows.where(F.col("id").isNotNull()).select(F.col("id").alias(own), F.explode(field).alias("raw")).select(own, match_key(F.col("raw")).alias(other)).where(F.col(other).isNotNull()).distinct()


def one_sided(left: DataFrame, right: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """(keys, side): links that only one of two bridges has."""
    both = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), list(keys), "full_outer")
    return both.where(F.col("l").isNull() | F.col("r").isNull()).select(*keys, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def late_publications(links: DataFrame, sources: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source_id) of links to sources that were published after the query had run."""
    s = sources.select(match_key(F.col("id")).alias("source_id"), "published_at")
    q = queries.select(F.col("id").alias("query_id"), "run_at")
    return links.join(s, "source_id").join(q, "query_id").where("published_at > run_at").select("query_id", "source_id").distinct()


def platform_mismatches(links: DataFrame, sources: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source_id) of links between different platforms."""
    s = sources.select(match_key(F.col("id")).alias("source_id"), platform(F.col("platform")).alias("ps"))
    q = queries.select(F.col("id").alias("query_id"), platform(F.col("platform")).alias("pq"))
    return links.join(s, "source_id").join(q, "query_id").where("ps <> pq").select("query_id", "source_id").distinct()


def repeated_executions(queries: DataFrame) -> DataFrame:
    """(first_id, id): queries that repeat the platform, text, time and order of another one."""
    from pyspark.sql import Window

    w = Window.partitionBy("p", "query", "run_at", "sort")
    keyed = queries.select("id", platform(F.col("platform")).alias("p"), "query", "run_at", "sort")
    return keyed.withColumn("first_id", F.min("id").over(w)).where("id <> first_id").select("first_id", "id")


def review_conflicts(records: DataFrame) -> DataFrame:
    """(a, b) of record pairs whose reviews decide differently, a < b."""
    pairs = records.select(match_key(F.col("id")).alias("x"), F.explode("duplicate_reviews").alias("r")).select("x", match_key(F.col("r.other_source_id")).alias("y"), F.col("r.decision").alias("decision")).where("x <> y and decision is not null")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("decision").alias("low"), F.max("decision").alias("high")).where("low <> high").select("a", "b")


def running_total(rows: DataFrame, order: str, amount: str, scratch: Scratch) -> DataFrame:
    """rows with `total`, the sum of `amount` up to each row in the order of `order` (unique).

    No window over the whole table: the rows are sorted into ranges, each range summed up by itself, and the sums of the ranges before,
    one row per range, are added."""
    from pyspark.sql import Window

    # written once: both uses must see the same ranges
    placed = scratch.save(rows.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    sums = placed.groupBy("range").agg(F.sum(amount).alias("s"))
    before = sums.select("range", (F.sum("s").over(Window.orderBy("range")) - F.col("s")).alias("before"))
    within = F.sum(amount).over(Window.partitionBy("range").orderBy(order))
    return placed.withColumn("within", within).join(F.broadcast(before), "range").withColumn("total", F.col("before") + F.col("within")).drop("range", "within", "before")  # a row per range


def excerpt_faults(records: DataFrame, most_words: int = 25) -> DataFrame:
    """(id, fault): excerpts with too many words, and those that are no literal part of their text."""
    from ledgerloom.functions.text import word_count

    faults = F.array_compact(F.array(F.when(word_count(F.col("excerpt")) > most_words, "too_long"), F.when(~F.contains(F.col("captured_text"), F.col("excerpt")), "no_part")))
    return records.where(F.col("excerpt").isNotNull()).select("id", F.explode(faults).alias("fault"))


def first_crossing(totals: DataFrame, order: str, most: int) -> DataFrame:
    """The one row at which a running total first exceeds `most`; none if it never does."""
    return totals.where(F.col("total") > most).agg(F.min_by(F.struct(*totals.columns), order).alias("x")).where("x is not null").select("x.*")


def citation_faults(cited: DataFrame, support: DataFrame, records: DataFrame, good) -> DataFrame:
    """(signal_id, source_id, fault) of citations (signal_id, source_id): `unknown` without a record, `not_support` if they are no support citation of their
    signal, `not_eligible` where the record isn't `good` (a column of its fields)."""
    known = records.select(match_key(F.col("id")).alias("source_id"), F.coalesce(good, F.lit(False)).alias("good"))
    backed = support.select("signal_id", "source_id").distinct().withColumn("backed", F.lit(True))
    both = cited.join(known, "source_id", "left").join(backed, ["signal_id", "source_id"], "left")
    faults = F.when(F.col("good").isNull(), F.array(F.lit("unknown"))).otherwise(F.array_compact(F.array(F.when(F.col("backed").isNull(), "not_support"), F.when(~F.col("good"), "not_eligible"))))
    return both.select("signal_id", "source_id", F.explode(faults).alias("fault"))


def linked_queries(queries: DataFrame, signals: DataFrame, intent: str) -> DataFrame:
    """(signal_id, queries, platforms) of the queries of one intent that are linked with each signal; signals without any stay."""
    own = queries.where(F.col("intent") == intent).select("id", platform(F.col("platform")).alias("platform"), F.explode("signal_ids").alias("raw")).select("id", "platform", match_key(F.col("raw")).alias("key")).where("key is not null")
    by = own.groupBy("key").agg(F.count_distinct("id").alias("queries"), F.count_distinct("platform").alias("platforms"))
    names = signals.select(F.col("id").alias("signal_id"), match_key(F.col("id")).alias("key")).distinct()
    return names.join(by, "key", "left").select("signal_id", F.coalesce("queries", F.lit(0)).alias("queries"), F.coalesce("platforms", F.lit(0)).alias("platforms"))


def root_clashes(support: DataFrame, counter: DataFrame, roots: DataFrame) -> DataFrame:
    """(signal_id, root): groups of records that a signal cites both for and against itself. Records without a group are their own root."""
    own = roots.select(match_key(F.col("id")).alias("source_id"), "root")
    rooted = lambda c: c.join(own, "source_id", "left").select("signal_id", F.coalesce("root", "source_id").alias("root"))
    return rooted(support).intersect(rooted(counter))


def non_representative(cited: DataFrame, roots: DataFrame, representatives: DataFrame) -> DataFrame:
    """(signal_id, source_id, representative, withheld): citations of a group's member that doesn't stand for it; withheld: a member isn't public, so why stays untold."""
    member = roots.select(match_key(F.col("id")).alias("source_id"), "root")
    heads = representatives.select("root", "representative", "private")
    found = cited.join(member, "source_id").join(heads, "root").where(F.col("source_id") != match_key(F.col("representative")))
    return found.select("signal_id", "source_id", "representative", F.col("private").alias("withheld")).distinct()


def quote_faults(quotes: DataFrame, records: DataFrame) -> DataFrame:
    """(id, source_id, fault) of quotes (id, source_id, excerpt): `unknown` without a record, `other_excerpt` where the text isn't that record's excerpt."""
    known = records.select(match_key(F.col("id")).alias("source_id"), F.col("excerpt").alias("own"), F.lit(True).alias("there"))
    fault = F.when(F.col("there").isNull(), "unknown").when(~F.col("excerpt").eqNullSafe(F.col("own")), "other_excerpt")
    return quotes.join(known, "source_id", "left").select("id", "source_id", fault.alias("fault")).where("fault is not null")


def stance_faults(declared: DataFrame, cited: DataFrame) -> DataFrame:
    """(signal_key, source_key, fault) of links (signal_key, source_key, stance) that records declare against citations (signal_key, source_key, stance): `not_cited`, `not_declared`,
    or `stance` where a citation is on another side than the record. Records of another stance than those that are cited needn't be cited."""
    sides = [r["stance"] for r in cited.select("stance").distinct().limit(3).collect()]  # for and against
    own = declared.select("signal_key", "source_key", F.col("stance").alias("own")).distinct()
    both = own.join(cited.select("signal_key", "source_key", F.col("stance").alias("side")).distinct(), ["signal_key", "source_key"], "full_outer")
    fault = F.when(F.col("side").isNull(), F.when(F.col("own").isin(*sides), "not_cited")).when(F.col("own").isNull(), "not_declared").when(F.col("own") != F.col("side"), "stance")
    return both.select("signal_key", "source_key", fault.alias("fault")).where("fault is not null").distinct()
