"""References to records that do not exist, were deleted, or arrived later.

References of all fields and the keys they may point to are put into one long table, tagged as child or
parent, and grouped by parent table and key. Only groups that lack a parent, or whose parent arrived late for one of
its references, go on; the references of those groups are then labelled. The grouping is pre-aggregated
before its shuffle, so a key with a third of all references sends one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.scratch import Scratch

#: White space at the ends of ids, beyond ASCII as well.
_EDGES = r"^[\s\p{Z}\u200b\ufeff]+|[\s\p{Z}\u200b\ufeff]+$"


def match_key(value: Column) -> Column:
    """The form in which ids match: trimmed, lower case; null for null and blank ones."""
    trimmed = F.lower(F.regexp_replace(value, _EDGES, ""))
    return F.when(trimmed != "", trimmed)


@dataclass(frozen=True)
class Reference:
    """Field `field` of table `table`, a string or an array of strings, refers to ids of `parent`."""

    table: str
    field: str
    parent: str


LEDGER_REFERENCES = (
    Reference("source_ledger", "repost_of", "source_ledger"),
    Reference("source_ledger", "query_ids", "query_log"),
    Reference("query_log", "included_source_ids", "source_ledger"),
    Reference("signal_catalog", "support_citations", "source_ledger"),
)


def first_loads(rows: DataFrame) -> DataFrame:
    """(id, first_load) of a table's records; rows without an id are no records."""
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("loaded_at").alias("first_load"))


def _entry(r: Reference):
    return lambda x: F.struct(F.lit(r.field).alias("ref_field"), F.lit(r.parent).alias("parent_table"), match_key(x).alias("target_id"))


def child_references(tables: dict[str, DataFrame], references=LEDGER_REFERENCES) -> DataFrame:
    """(ref_table, ref_field, parent_table, record_id, target_id, load): one row per delivered reference.

    Null and blank elements are no references; null arrays hold none. A record delivered twice yields its
    references twice; `load` is that delivery's.
    """
    parts = []
    for table in dict.fromkeys(r.table for r in references):
        rows, own = tables[table], [r for r in references if r.table == table]
        entries = []
        for r in own:
            value = F.col(r.field)
            if not rows.schema[r.field].dataType.typeName() == "array":
                value = F.array(value)
            entries.append(F.transform(F.coalesce(value, F.array().cast("array<string>")), _entry(r)))
        entry = F.explode(F.concat(*entries)).alias("entry")
        parts.append(
            rows.where(F.col("id").isNotNull())
            .select(F.lit(table).alias("ref_table"), F.col("id").alias("record_id"), F.col("loaded_at").alias("load"), entry)
            .select("ref_table", "entry.ref_field", "entry.parent_table", "record_id", "entry.target_id", "load")
            .where(F.col("target_id").isNotNull())
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _month(ts: Column) -> Column:
    """The UTC month, whatever the session's time zone: months counted from the epoch's seconds."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))
    return F.date_format(day, "yyyy-MM")


def orphan_references(tables: dict[str, DataFrame], retracted: DataFrame, references=LEDGER_REFERENCES, salts: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """(ref_table, ref_field, record_id, target_id, reason, period), one row per record, field and target.

    tables: name -> rows with id, loaded_at and the reference fields; extra columns are not read.
    retracted: (table_name, id). reason: `deleted`, `missing` or `late`; period: the UTC month of the record's
    first load, null where no load time is known. A reference whose record or
    target has no load time is never late. Empty tables give an empty result.

    With scratch, the references are made once and written; without, each table is read twice. One target may hold any share of the references: groups are aggregated map-side, and the labels are
    joined back over `salts` copies of each label.
    """
    children = (
        child_references(tables, references)
        .groupBy("ref_table", "ref_field", "parent_table", "record_id", "target_id")
        .agg(F.min("load").alias("first_load"))
        .withColumn("period", _month(F.col("first_load")))
    )
    if scratch is not None:
        children = scratch.save(children)
    nothing = F.lit(None).cast("timestamp")
    months = F.lit(None).cast("string")
    long = children.select("parent_table", F.col("target_id").alias("key"), F.lit(0).alias("parent"), F.lit(0).alias("gone"), nothing.alias("load"), F.col("period").alias("child_month"))
    for name in dict.fromkeys(r.parent for r in references):
        long = long.unionByName(
            tables[name].select(F.lit(name).alias("parent_table"), match_key(F.col("id")).alias("key"), F.lit(1).alias("parent"), F.lit(0).alias("gone"), F.col("loaded_at").alias("load"), months.alias("child_month"))
        )
    long = long.unionByName(
        retracted.select(F.col("table_name").alias("parent_table"), match_key(F.col("id")).alias("key"), F.lit(0).alias("parent"), F.lit(1).alias("gone"), nothing.alias("load"), months.alias("child_month"))
    )
    groups = (
        long.where(F.col("key").isNotNull())
        .groupBy("parent_table", "key")
        .agg(F.max("parent").alias("parent"), F.max("gone").alias("gone"), _month(F.min("load")).alias("arrived"), F.min("child_month").alias("earliest"), F.max(1 - F.col("parent") - F.col("gone")).alias("child"))
        .where((F.col("child") == 1) & ((F.col("parent") == 0) | (F.col("arrived") > F.col("earliest"))))
        .select("parent_table", F.col("key").alias("target_id"), "parent", "gone", "arrived", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = children.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    reason = F.when(F.col("parent") == 1, F.when(F.col("arrived") > F.col("period"), "late")).when(F.col("gone") == 1, "deleted").otherwise("missing")
    return (
        salted.join(groups, ["parent_table", "target_id", "salt"])
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("ref_table", "ref_field", "record_id", "target_id", "reason", "period")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(ref_table, ref_field, reason, period, n_references, n_targets) of orphan_references()."""
    return orphans.groupBy("ref_table", "ref_field", "reason", "period").agg(F.count("*").alias("n_references"), F.count_distinct("target_id").alias("n_targets"))
