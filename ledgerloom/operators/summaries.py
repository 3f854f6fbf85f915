"""Counts, concentration, coverage and fingerprints of record tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concentration(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, n, keys, top_key, top_n): rows and distinct keys of each group and its most frequent key, of equal ones the smallest. Two levels of
    aggregation, so a frequent key is counted map-side."""
    by = rows.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.count("*").alias("n"))
    top = by.groupBy(group).agg(F.max("n").alias("top_n"), F.sum("n").alias("n"), F.count("*").alias("keys"))
    first = by.join(top.select(group, F.col("top_n").alias("n")), [group, "n"]).groupBy(group).agg(F.min(key).alias("top_key"))
    return top.join(first, group).select(group, "n", "keys", "top_key", "top_n")


def coverage(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(measure, distinct_values): distinct values of several expressions in one pass: values are unpivoted, deduplicated and counted."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), value.cast("string").alias("value")) for name, value in columns.items()))).alias("x")).select("x.measure", "x.value")
    return long.where(F.col("value").isNotNull()).distinct().groupBy("measure").agg(F.count("*").alias("distinct_values"))


def ranked(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group in an order, with their rank from 1."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(n, fingerprint): a hash of the multiset of rows that doesn't depend on their order or partitions.

    A row is the text of its columns, each with its length before it (`n` for null), hashed. The rows' hashes are put into 4,096 groups by their first three hex digits; each group flows through one task
    in order and is hashed as it passes, never held; the groups' hashes are hashed in order. An empty table has a fingerprint, too."""
    text = lambda c: F.col(c).cast("string")
    row = F.concat(*(F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("n")) for c in columns))
    hashed = rows.select(F.sha2(row, 256).alias("h")).withColumn("part", F.substring("h", 1, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, digest, n = None, None, 0
        done = []
        for batch in batches:
            for name, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != part:
                    if part is not None:
                        done.append((part, digest.hexdigest(), n))
                    part, digest, n = name, hashlib.sha256(), 0
                digest.update(h.encode())
                n += 1
        if part is not None:
            done.append((part, digest.hexdigest(), n))
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["part", "digest", "n"])

    parts = hashed.repartition("part").sortWithinPartitions("part", "h").select("part", "h").mapInArrow(run, "part string, digest string, n bigint")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: F.concat(x.part, x.digest)), "")  # 4,096 rows
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(whole, 256).alias("fingerprint"))
