"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, components, copies, lookalikes, neardup, packing, personal, plainform, sentences
from ledgerloom.operators.scratch import Scratch
from ledgerloom.sources.tables import read_table

#: The vocabulary of the registered queries; every worker must find it under this path.
RANK_FILE = bpe.default_rank_file()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    ledger = read_table(spark, folder, "source_ledger")
    return lookalikes.equal_looking(ledger, Scratch(spark), plainform.learn_script_scores(ledger, "captured_text"))


def p1_plain(spark: SparkSession, folder: str) -> DataFrame:
    ledger = read_table(spark, folder, "source_ledger")
    scores = plainform.learn_script_scores(ledger, "captured_text")
    return lookalikes.plain_values(ledger, ("captured_text", "excerpt", "url"), scores)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_records(read_table(spark, folder, "source_ledger"), Scratch(spark))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.formatting_copies(read_table(spark, folder, "source_ledger"), Scratch(spark))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.ledger_groups(read_table(spark, folder, "source_ledger"), Scratch(spark))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    ledger = read_table(spark, folder, "source_ledger")
    return personal.personal_items(ledger, read_table(spark, folder, "given_names"), Scratch(spark), scores=plainform.learn_script_scores(ledger, "captured_text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _items(spark, folder).select("id", "field", "kind", "start_at")


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redacted(read_table(spark, folder, "source_ledger"), _items(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, folder, "documents"), RANK_FILE)


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "pack_budget"), RANK_FILE, Scratch(spark))


def p8_use(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_use(p8_packed(spark, folder), read_table(spark, folder, "pack_budget"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return sentences.sentence_units(docs, sentences.learn_events(docs))


QUERIES = {"p1_found": p1_found, "p1_plain": p1_plain, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_ids": p7_ids, "p8_packed": p8_packed, "p8_use": p8_use, "p9_found": p9_found}
SQL = {
    "p5_found": r"""
WITH RECURSIVE named AS (
  SELECT id AS a, lower(trim(repost_of)) AS k FROM source_ledger
  UNION SELECT id, lower(trim(r.other_source_id)) FROM (SELECT id, unnest(duplicate_reviews) AS r FROM source_ledger) WHERE r.decision = 'same_source'
), link AS (
  SELECT DISTINCT a, l.id AS b FROM named JOIN source_ledger l ON lower(trim(l.id)) = k WHERE a <> l.id
), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, other) AS (
  SELECT a, a FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
)
SELECT id, min(other) AS group_id FROM reach GROUP BY id
""",
}
