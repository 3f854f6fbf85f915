"""Records out of repeated deliveries, and groups of records that stand for one source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.references import match_key
from ledgerloom.operators.scratch import Scratch


def first_deliveries(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per id: the columns of its first delivery. Only these columns are shuffled, pre-aggregated."""
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("loaded_at", *columns)).alias("x")).select("id", *(F.col(f"x.{c}").alias(c) for c in columns))


def repeated_deliveries(rows: DataFrame) -> DataFrame:
    """(id, deliveries, first_load, last_load) of records that were delivered more than once."""
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("deliveries"), F.min("loaded_at").alias("first_load"), F.max("loaded_at").alias("last_load")).where("deliveries > 1")


def star_links(rows: DataFrame, key: Column, reason: str) -> DataFrame:
    """(a, b, reason): each record linked to the smallest of its key. A key of k records gives k - 1 links, not k squared; its
    smallest id comes from an aggregate with partial minima, joined back on keys that have several ids."""
    keyed = rows.select("id", key.alias("key")).where(F.col("key").isNotNull())
    heads = keyed.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").select("key", "head")
    return keyed.join(heads, "key").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(reason).alias("reason"))


def declared_links(records: DataFrame) -> DataFrame:
    """(a, b, reason) of reposts and of reviews that found one source."""
    known = records.select(F.col("id").alias("b"), match_key(F.col("id")).alias("key"))
    reposts = records.select(F.col("id").alias("a"), match_key(F.col("repost_of")).alias("key"), F.lit("repost").alias("reason"))
    reviews = records.select(F.col("id").alias("a"), F.explode("duplicate_reviews").alias("r")).where("r.decision = 'same_source'").select("a", match_key(F.col("r.other_source_id")).alias("key"), F.lit("review").alias("reason"))
    return reposts.unionByName(reviews).where(F.col("key").isNotNull()).join(known, "key").where("a <> b").select("a", "b", "reason")


def lookup(rows: DataFrame, key: str, table: DataFrame, other: str, salts: int = 256) -> DataFrame:
    """rows joined with a table that has one row for each key. A key may have any share of the rows: its table row is sent to as many salts as its
    rows have, at most `salts`, so neither side gathers it. Where no key is known to have many rows, `salts` may be 1: a plain join with the same result."""
    if salts == 1:
        return rows.join(table, key)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(salts)).cast("int"))
    spread = salted.select(key, "salt").distinct().join(table, key)
    return salted.join(spread, [key, "salt"]).drop("salt")


_HUB = 100_000  # links from which on a node is split


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _star(links: DataFrame, both_ways: bool, salts: int) -> DataFrame:
    """(b, a), b > a: every node's neighbours linked to the smallest node among them and itself; of each node all larger neighbours (both_ways), or the smaller ones and itself."""
    near = _ends(links) if both_ways else links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = lookup(near, "u", least, "v", salts)
    if both_ways:
        moved = met.where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        moved = met.select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return moved.where("b <> a").distinct()


def spread_labels(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id linked to each id, directly or through others.

    The two star rewrites alternate until nothing changes, which takes a number of rounds logarithmic in the length of chains. Hubs are split by lookup(); what
    a round made is written to the shared folder once. Rows that link an id with itself or with null don't count.
    """
    now = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct())
    state, salts = None, 256
    for _ in range(max_rounds):
        after = scratch.save(_star(_star(now, True, salts), False, salts))
        scratch.drop(now)
        now = after
        degrees = _ends(now).groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
        *was, most = degrees.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if was == state:
            return now.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
        # a round at most squares what a node has; only nodes far from being hubs are joined plainly
        state, salts = was, 1 if (most or 0) ** 2 < _HUB else 256
    raise RuntimeError(f"links still change after {max_rounds} rounds")


def representatives(records: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, representative, members, private): the record that stands for each group of several, and whether a member isn't public.

    It is the origin of a repost inside the group, else the earliest published one, else the smallest id; in groups with a record that isn't public
    it is the smallest id, so that nothing about the order of private records shows.
    """
    members = roots.join(records.select("id", "published_at", "visibility"), "id")
    origins = records.select(match_key(F.col("repost_of")).alias("key")).where(F.col("key").isNotNull()).distinct()
    members = members.withColumn("key", match_key(F.col("id"))).join(origins.withColumn("origin", F.lit(0)), "key", "left")
    order = F.struct(F.coalesce("origin", F.lit(1)).alias("o"), F.col("published_at").isNull().alias("n"), "published_at", "id")
    return (
        members.groupBy("root")
        .agg(F.min_by("id", order).alias("first"), F.min("id").alias("least"), F.count("*").alias("members"), F.max(F.col("visibility") != "public").alias("private"))
        .select("root", F.when(F.col("private"), F.col("least")).otherwise(F.col("first")).alias("representative"), "members", "private")
    )


def group_reasons(links: DataFrame, roots: DataFrame, records: DataFrame) -> DataFrame:
    """(root, members, reasons) of each group, the reasons joined by `;` and withheld for groups with a record that isn't public."""
    own = links.join(roots, links["a"] == roots["id"]).groupBy("root").agg(F.array_join(F.sort_array(F.collect_set("reason")), ";").alias("reasons"))  # a handful of reasons
    size = roots.join(records.select("id", "visibility"), "id").groupBy("root").agg(F.count("*").alias("members"), F.max(F.col("visibility") != "public").alias("private"))
    return size.join(own, "root").select("root", "members", F.when(F.col("private"), "withheld").otherwise(F.col("reasons")).alias("reasons"))


def repost_faults(records: DataFrame) -> DataFrame:
    """(id, target_id, fault): `self`, `chain` (the target is a repost itself), `before_origin` (published before its origin)."""
    child = records.select("id", match_key(F.col("id")).alias("own"), match_key(F.col("repost_of")).alias("target_id"), F.col("published_at").alias("at")).where(F.col("target_id").isNotNull())
    parent = records.select(match_key(F.col("id")).alias("target_id"), match_key(F.col("repost_of")).alias("above"), F.col("published_at").alias("parent_at"))
    pairs = child.join(parent, "target_id")
    faults = F.array_compact(F.array(F.when(F.col("own") == F.col("target_id"), "self"), F.when(F.col("above").isNotNull() & (F.col("own") != F.col("target_id")), "chain"), F.when(F.col("at") < F.col("parent_at"), "before_origin")))
    return pairs.select("id", "target_id", F.explode(faults).alias("fault"))


def repost_cycles(records: DataFrame, scratch: Scratch) -> DataFrame:
    """(id) of records on a cycle of reposts, by pointer doubling: after k rounds each pointer leads 2^k steps on, and those
    still on their way after as many steps as there are records go round. Logarithmic rounds of one join."""
    steps = records.select(match_key(F.col("id")).alias("id"), match_key(F.col("repost_of")).alias("to")).where(F.col("to").isNotNull())
    steps = scratch.save(steps.join(steps.select(F.col("id").alias("to")), "to", "left_semi"))
    total, far, start = steps.count(), 1, steps
    while far <= total:
        ahead = steps.select(F.col("id").alias("to"), F.col("to").alias("next"))
        steps = scratch.save(steps.join(ahead, "to").select("id", F.col("next").alias("to")))
        far *= 2
    return start.join(steps.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select("id").distinct()


def conflicting_units(records: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, records, fields): units that several records describe differently, with the names of the fields that differ."""
    differ = [F.when(F.min(F.coalesce(f, F.lit("\0"))) != F.max(F.coalesce(f, F.lit("\0"))), f) for f in fields]
    return (
        records.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("records"), F.array_join(F.array_compact(F.array(*differ)), ";").alias("fields"))
        .where("records > 1 and fields <> ''")
    )


def private_conflicts(records: DataFrame, key: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """(first_id, records): records that aren't public and have one provenance, but not the same content. Which fields differ is withheld. Records without
    the whole provenance don't count. Groups are compared by hashes of their fields, pre-aggregated."""
    own = records.where(F.col("visibility") == "supplied_private")
    for c in key:
        own = own.where(F.coalesce(F.col(c), F.lit("")) != "")
    content = F.xxhash64(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    by = own.groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("records"), F.min(content).alias("low"), F.max(content).alias("high"))
    return by.where("low <> high").select("first_id", "records")


def short_text_pairs(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): of each short text (id, key) that records of several groups share, the smallest ids of its two first groups, for somebody to review.

    Too short a text to link its records by itself. Two aggregates find the pair, so a text that very many records share isn't gathered.
    """
    placed = keyed.select("id", "key").join(roots.select("id", "root"), "id", "left").select("id", "key", F.coalesce("root", "id").alias("root"))
    heads = placed.groupBy("key", "root").agg(F.min("id").alias("id"))
    first = heads.groupBy("key").agg(F.min_by("root", "id").alias("first_root"), F.min("id").alias("a"))
    return heads.join(first, "key").where("root <> first_root").groupBy("key", "a").agg(F.min("id").alias("b")).select("a", "b")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
