"""Connected components by alternating large-star and small-star rewrites.

Every round looks at each node's neighbourhood. Large-star ties the larger neighbours to the smallest node seen;
small-star ties the node and its smaller neighbours to the smallest of them. Both keep the components; the edges end as one star per
component around its smallest node. Rounds are bounded by the logarithm of the component's size in practice,
whatever the length of the chains.

A node may be linked to a third of all others. A neighbourhood is therefore never gathered: its minimum is an aggregate with
partial sums before the shuffle, and the minimum goes back to the edges by a join in which nodes of a degree above
`hot_degree` are taken out. There can be no more than edges / hot_degree of them, so that list is small enough to send to all
tasks; the other edges are joined by a shuffle on the node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.scratch import Scratch


def _with_least(edges: DataFrame, scratch: Scratch, n_edges: int, hot_degree: int) -> DataFrame:
    """(u, v, m): m the smallest of u and its neighbours v."""
    hot_degree = max(hot_degree, n_edges // 10_000)  # at most 10,000 hot nodes
    least = edges.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("degree")).select("u", F.least("u", "v").alias("m"), "degree")
    if n_edges <= hot_degree:
        return edges.join(least.select("u", "m"), "u")
    least = scratch.save(least)
    hot = least.where(F.col("degree") > hot_degree).select("u", "m")
    cold = least.where(F.col("degree") <= hot_degree).select("u", "m")
    of_hot = edges.join(F.broadcast(hot), "u")
    of_cold = edges.join(F.broadcast(hot), "u", "left_anti").join(cold, "u")
    return of_hot.unionByName(of_cold)


def _large_star(edges: DataFrame, scratch: Scratch, n: int, hot: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, scratch, 2 * n, hot).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch, n: int, hot: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tied = _with_least(down, scratch, n, hot)
    pairs = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
    return pairs.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, scratch: Scratch, source: str = "a", target: str = "b", hot_degree: int = 100_000, max_rounds: int = 100) -> DataFrame:
    """(id, group_id): every value that occurs in a link, with the smallest value linked to it directly or through others.

    Links with a null end count for nothing; a link of a value with itself gives a group of one only if the value has no other
    link; repeated links, either way round, count once. No links give an empty result. Values compare as their type does (strings by bytes).
    Each round's edges are written to the shared folder, so lost executors cost a round at most.
    """
    ends = links.select(F.col(source).alias("u"), F.col(target).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    edges = scratch.save(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = edges.where(F.col("u") == F.col("v")).select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    current = edges.where(F.col("u") != F.col("v"))
    before, held = _state(current), None
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = scratch.save(_large_star(current, scratch, before[0], hot_degree))
        after = scratch.save(_small_star(large, scratch, before[0], hot_degree))
        scratch.drop(large)
        if held is not None:
            scratch.drop(held)
        current = held = after
        now = _state(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    return stars.unionByName(stars.select(F.col("group_id").alias("id"), "group_id")).unionByName(loops).groupBy("id").agg(F.min("group_id").alias("group_id"))


def ledger_links(ledger: DataFrame) -> DataFrame:
    """(a, b): links of records by repost_of and by duplicate_reviews of decision `same_source`.

    Ids match trimmed and in lower case. A link to an id without a row, to the record itself, or with a null or blank end is none.
    Null and empty review lists hold no link; repeated deliveries repeat their links.
    """
    from ledgerloom.operators.references import match_key

    rows = ledger.where(F.col("id").isNotNull())
    reviews = F.transform(
        F.filter(F.coalesce(F.col("duplicate_reviews"), F.array().cast(ledger.schema["duplicate_reviews"].dataType)), lambda r: r["decision"] == "same_source"),
        lambda r: r["other_source_id"],
    )
    named = (
        rows.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.transform(F.concat(F.array("repost_of"), reviews), match_key))).alias("key"))
        .where(F.col("key").isNotNull())
    )
    known = rows.select(F.col("id").alias("b"), match_key(F.col("id")).alias("key")).distinct()
    return named.join(known, "key").where(F.col("a") != F.col("b")).select("a", "b")


def ledger_groups(ledger: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, group_id) of all records with at least one link, see ledger_links() and connected_components()."""
    return connected_components(ledger_links(ledger), scratch)
