"""Issues: what is wrong with which field of which record, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_issues(rows: DataFrame, id_column: str, rules: dict[str, Column]) -> DataFrame:
    """(id, field, fault) of rules, each an array of fault names for a field; one pass over the rows, whatever the number of rules."""
    found = F.array(*(F.struct(F.lit(field).alias("field"), faults.alias("faults")) for field, faults in rules.items()))
    return (
        rows.select(F.col(id_column).alias("id"), F.explode(F.filter(found, lambda x: F.size(x.faults) > 0)).alias("x"))
        .select("id", "x.field", F.explode("x.faults").alias("fault"))
    )


def order_faults(rows: DataFrame, id_column: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(id, field, fault) `time_order` for pairs field -> (earlier, later) of times whose order is wrong."""
    return field_issues(rows, id_column, {f: F.array_compact(F.array(F.when(F.col(a) > F.col(b), "time_order"))) for f, (a, b) in pairs.items()})


def union_issues(parts: dict[str, DataFrame]) -> DataFrame:
    """(table_name, id, field, fault) of several tables' issues."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("table_name"), "id", "field", "fault") for name, df in parts.items()))


def summary(issues: DataFrame) -> DataFrame:
    """(table_name, field, fault, n)."""
    return issues.groupBy("table_name", "field", "fault").agg(F.count("*").alias("n"))


def report(issues: DataFrame, most: int = 10_000) -> DataFrame:
    """(rank, table_name, id, field, fault): a report's issues in order, at most `most` of them and then one row `issue_limit` that says so.

    The cap is the report's feature; issues as such are never capped. Each table is ranked by itself before the whole, so no more than `most` rows of each table
    come together."""
    order = ("fault", "table_name", "field", "id")
    first = issues.withColumn("k", F.row_number().over(Window.partitionBy("table_name", "fault").orderBy("field", "id"))).where(F.col("k") <= most + 1)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= most + 1)
    over = F.col("rank") > most
    return ranked.select("rank", *(F.when(over, "issue_limit" if c == "fault" else "").otherwise(F.col(c)).alias(c) for c in ("table_name", "id", "field", "fault")))


def shape_faults(keys: Column, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """Names of missing and unknown keys of an object, as `missing:key` and `unknown:key`."""
    need, allowed = F.array(*map(F.lit, required)), F.array(*map(F.lit, required + optional))
    missing, unknown = F.array_except(need, keys), F.array_except(keys, allowed)
    return F.concat(F.transform(F.sort_array(missing), lambda k: F.concat(F.lit("missing:"), k)), F.transform(F.sort_array(unknown), lambda k: F.concat(F.lit("unknown:"), k)))
