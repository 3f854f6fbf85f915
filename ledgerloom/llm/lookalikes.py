"""Records whose values look the same but are stored with different characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.plainform import NO_SCORES, ScriptScores, plain_column
from ledgerloom.operators.scratch import Scratch

#: Something that shows.
_VISIBLE = r"[^\s\p{Z}\p{C}]"


def not_blank(value: Column) -> Column:
    """False for null, and for values of white space and invisible characters only."""
    return F.coalesce(value.rlike(_VISIBLE), F.lit(False))


_SALTS = 1024


def form_members(rows: DataFrame, scratch: Scratch, scores: ScriptScores = NO_SCORES, fields: tuple[str, ...] = ("captured_text", "url")) -> DataFrame:
    """(field, form, stored, id): records of the plain forms that several stored values have, as hashes. One row for each record and stored value; this is the
    membership that pairs come from, in size proportional to the rows however many look the same."""
    values = rows.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("id", "x.field", "x.value").where(not_blank(F.col("value")))
    # the plain form is made once; a form that very many records have is spread over salts
    members = scratch.save(values.select("field", "id", F.md5(plain_column(F.col("value"), scores)).alias("form"), F.xxhash64("value").alias("stored"), F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int").alias("salt")))
    parts = members.groupBy("field", "form", "salt").agg(F.min("stored").alias("low"), F.max("stored").alias("high"))
    mixed = parts.groupBy("field", "form").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("salt").alias("salts")).where("low <> high")  # at most _SALTS rows a form
    return members.join(mixed.select("field", "form", F.explode("salts").alias("salt")), ["field", "form", "salt"], "left_semi").select("field", "form", "stored", "id").distinct()


def _equal_looking_pairs(rows: DataFrame, scratch: Scratch, fields: tuple[str, ...], scores: ScriptScores) -> DataFrame:
    # Pairs are made of stored values, and then of their records.
    mark = scratch.mark()
    members = scratch.save(form_members(rows, scratch, scores, fields))
    scratch.release(mark, members)
    kinds = members.select("field", "form", "stored").distinct()
    pairs = kinds.withColumnRenamed("stored", "s1").join(kinds.withColumnRenamed("stored", "s2"), ["field", "form"]).where("s1 < s2")
    one = members.select("field", "form", F.col("stored").alias("s1"), F.col("id").alias("x"))
    two = members.select("field", "form", F.col("stored").alias("s2"), F.col("id").alias("y"))
    return (
        pairs.join(one, ["field", "form", "s1"]).join(two, ["field", "form", "s2"]).where("x <> y")
        .select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    )


def _hidden_excerpts(rows: DataFrame, text: str, excerpt: str, scores: ScriptScores) -> DataFrame:
    apart = rows.select("id", text, excerpt).where(not_blank(F.col(excerpt)) & not_blank(F.col(text)) & ~F.contains(F.col(text), F.col(excerpt)))
    return apart.where(F.contains(plain_column(F.col(text), scores), plain_column(F.col(excerpt), scores))).select(F.lit(excerpt).alias("field"), F.col("id").alias("id_a"), F.col("id").alias("id_b")).distinct()


def equal_looking(rows: DataFrame, scratch: Scratch, scores: ScriptScores = NO_SCORES, fields: tuple[str, ...] = ("captured_text", "url"), text: str = "captured_text", excerpt: str = "excerpt") -> DataFrame:
    """(field, id_a, id_b): see p1_found in TESTDATA.md.

    For each of `fields`: pairs of different records, id_a < id_b, whose stored values differ and have one plain form. For `excerpt`:
    records (id_a = id_b) whose stored excerpt is no part of the stored text, though its plain form is part of the text's.
    Null and blank values, and rows without an id, are never a case; repeated deliveries are one record; other columns are not read.
    Only hashes of the values are shuffled. The result has all pairs, as the query asks for them; form_members() has the same without pairs.
    """
    rows = rows.where(F.col("id").isNotNull())
    return _equal_looking_pairs(rows, scratch, fields, scores).unionByName(_hidden_excerpts(rows, text, excerpt, scores))


def plain_values(rows: DataFrame, fields: tuple[str, ...], scores: ScriptScores = NO_SCORES) -> DataFrame:
    """The rows' ids with the plain form of each field; nulls stay null, empty and blank values lose only what doesn't show."""
    return rows.select("id", *(plain_column(F.col(f), scores).alias(f) for f in fields))
