"""Items of varying length in containers of fixed capacity.

Lengths are cut into buckets by dynamic programming over the histogram of all lengths, with the boundaries that cost the
least padding for their number. Batches form inside the buckets: a recipe says how many items of which bucket make up a container
within the token budget, whatever the items' exact lengths, as each counts as its bucket's boundary. Recipes start with the largest
bucket and fill what it leaves with smaller ones, and are used as often as their buckets' items last. Only the histogram, which has at most a
row per length up to the capacity, is brought together; items find their container by their rank in the bucket.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import count_tokens
from ledgerloom.operators.scratch import Scratch

#: Most buckets of one capacity.
BUCKETS = 256
#: Rows ranked by one task at most, about.
CELL_ROWS = 100_000


def bucket_boundaries(lengths: list[int], counts: list[int], most: int) -> list[int]:
    """Upper boundaries of at most `most` buckets with the least padding, the sum over all items of boundary minus length.

    For a price per bucket the best cut is found in one sweep with a hull of lines (the padding of a bucket is linear in its boundary);
    the price is raised until there are few enough buckets. lengths ascend.
    """
    if len(lengths) <= most:
        return list(lengths)
    low, high, best = 0.0, float(max(lengths)) * float(sum(counts)) + 1.0, None
    for _ in range(60):
        price = (low + high) / 2
        cut = _cheapest(lengths, counts, price)
        if len(cut) <= most:
            best, high = cut, price
        else:
            low = price
        if best is not None and len(best) == most:
            break
    return best


def _cheapest(lengths: list[int], counts: list[int], price: float) -> list[int]:
    n = len(lengths)
    before = np.concatenate([[0.0], np.cumsum(np.array(counts, float))])
    mass = np.concatenate([[0.0], np.cumsum(np.array(lengths, float) * np.array(counts, float))])
    # cost[j] = min over i < j of cost[i] + price + length[j-1] * (before[j] - before[i]) - (mass[j] - mass[i])
    cost, back = [0.0] * (n + 1), [0] * (n + 1)
    hull: list[tuple[float, float, int]] = [(0.0, 0.0, 0)]  # lines slope * x + value with slope = -before[i]
    head = 0
    for j in range(1, n + 1):
        x = lengths[j - 1]
        while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
            head += 1
        slope, value, i = hull[head]
        cost[j] = slope * x + value + price + x * before[j] - mass[j]
        back[j] = i
        line = (-before[j], cost[j] + mass[j], j)
        while len(hull) - head >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]) >= (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
            hull.pop()
        hull.append(line)
    out, j = [], n
    while j:
        out.append(lengths[j - 1])
        j = back[j]
    return out[::-1]


def recipes(boundaries: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(bucket -> items of it, number of containers) until no item is left. Each recipe takes the largest bucket that has items, as many as fit, then
    of what fits into the rest always the largest."""
    left, out = list(counts), []
    live = [b for b in range(len(boundaries)) if left[b]]
    while live:
        room, own = capacity, {}
        at = len(live) - 1
        while at >= 0 and room > 0:
            b = live[at]
            fit = min(left[b], room // max(1, boundaries[b]))
            if fit:
                own[b] = fit
                room -= fit * boundaries[b]
            # the largest bucket that still fits
            at = min(at - 1, bisect_left([boundaries[x] for x in live], room + 1) - 1)
        times = min(left[b] // k for b, k in own.items())
        out.append((own, times))
        for b, k in own.items():
            left[b] -= k * times
        live = [b for b in live if left[b]]
    return out


def _pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, start_token, n_tokens): whole items, or full parts and a rest of those beyond the capacity."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    return (
        sizes.select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), parts - 1)).alias("part", "k"))
        .withColumn("start_token", F.col("k").cast("bigint") * capacity)
        .select("doc_id", "part", "start_token", F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("start_token")).alias("n_tokens"))
    )


def pack(sizes: DataFrame, capacity: int, scratch: Scratch, buckets: int = BUCKETS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(container_id, doc_id, part, start_token, n_tokens) of sizes (doc_id, n_tokens).

    A container's items have at most `capacity` tokens together; an item is split only if it alone has more. Items without tokens go to
    containers like others and take no room. No items give no containers. Ids needn't be unique.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least one token")
    spark = sizes.sparkSession
    pieces = _pieces(sizes, capacity)
    histogram = pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most capacity + 1 rows
    known = sorted((r["n_tokens"], r["n"]) for r in histogram)
    lengths, counts = [a for a, _ in known], [b for _, b in known]
    if not known:
        return pieces.select(F.lit(0).cast("bigint").alias("container_id"), "doc_id", "part", "start_token", "n_tokens")
    full = [capacity] if capacity in lengths else []
    cut = bucket_boundaries([x for x in lengths if x < capacity], [c for x, c in known if x < capacity], buckets) + full
    in_bucket = [0] * len(cut)
    for x, c in known:
        in_bucket[bisect_left(cut, x)] += c
    plan = _plan(recipes(cut, in_bucket, capacity))
    bucket = F.lit(len(cut) - 1)
    edges = F.array(*(F.lit(int(x)) for x in cut))
    bucket = F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))
    placed = _ranked(pieces.withColumn("bucket", bucket), scratch, sum(counts), cell_rows)
    ranges = F.broadcast(spark.createDataFrame(plan, "bucket int, first bigint, last bigint, each bigint, base bigint"))  # a few rows for each bucket
    joined = placed.join(ranges, (placed["bucket"] == ranges["bucket"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    return joined.select((F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("bigint").alias("container_id"), "doc_id", "part", "start_token", "n_tokens")


def _plan(used: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(bucket, first rank, rank behind the last, items in each container, first container)."""
    out, taken, base = [], {}, 0
    for own, times in used:
        for b, k in own.items():
            first = taken.get(b, 0)
            taken[b] = first + k * times
            out.append((b, first, first + k * times, k, base))
        base += times
    return out


def _ranked(pieces: DataFrame, scratch: Scratch, n: int, cell_rows: int) -> DataFrame:
    """pieces with their rank in the bucket, from 0. Buckets are ranked in cells of bounded size, whose counts are summed up."""
    cells = max(1, -(-n // cell_rows)) * 4
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "part"), F.lit(cells)).cast("int"))
    pieces = scratch.save(pieces)
    sizes = pieces.groupBy("bucket", "cell").agg(F.count("*").alias("m"))
    from pyspark.sql import Window

    before = F.sum("m").over(Window.partitionBy("bucket").orderBy("cell")) - F.col("m")
    offsets = sizes.select("bucket", "cell", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy(F.desc("n_tokens"), "doc_id", "part")) - 1
    return pieces.withColumn("within", within).join(offsets, ["bucket", "cell"]).withColumn("rank", F.col("before") + F.col("within"))


def pack_documents(docs: DataFrame, budgets: DataFrame, rank_file: str, scratch: Scratch, buckets: int = BUCKETS) -> DataFrame:
    """(budget_id, container_id, doc_id, part, start_token, n_tokens) of all documents for each budget (budget_id, capacity_tokens).

    Sizes are in tokens of the vocabulary in `rank_file`; null and empty texts have none. Budgets without a capacity are left out. Other columns are not read.
    """
    sizes = scratch.save(count_tokens(docs, rank_file))
    out = None
    for row in budgets.where("capacity_tokens > 0").select("budget_id", "capacity_tokens").distinct().orderBy("budget_id").collect():  # the budgets, a handful
        own = pack(sizes, row["capacity_tokens"], scratch, buckets).select(F.lit(row["budget_id"]).alias("budget_id"), "*")
        out = own if out is None else out.unionByName(own)
    if out is None:
        empty = _pieces(sizes, 1).where("false")
        return empty.select(F.lit(0).alias("budget_id"), F.lit(0).cast("bigint").alias("container_id"), "doc_id", "part", "start_token", "n_tokens")
    return out


def container_use(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, containers, tokens, use): the share of all containers' room that is used."""
    by = packed.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return by.join(budgets.select("budget_id", "capacity_tokens").distinct(), "budget_id").select("budget_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("use"))
