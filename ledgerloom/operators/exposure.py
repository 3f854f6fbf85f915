"""Where private text shows in public output, and fingerprints that tell nothing of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.text import identifier_parts

GRAM = 4
LEAST_CHARACTERS = 8
# What the fingerprint may hold of a record that isn't public, and how it must be written.
_ID = r"^src[-_][a-z0-9][a-z0-9_-]*$"
_REFERENCE = r"^[A-Za-z0-9][A-Za-z0-9._:/#-]{0,255}$"
_FILE_HASH = r"^sha256:[0-9a-f]{64}$"


def _named(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))


def unpivot(rows: DataFrame, table: str, id_column: str, fields: dict[str, Column]) -> DataFrame:
    """(table_name, record_id, field, value) of string fields and of the items of array fields; nulls and empty strings are left out."""
    entries = []
    for name, value in fields.items():
        items = value if rows.select(value.alias("x")).schema[0].dataType.typeName() == "array" else F.array(value)
        entries.append(F.transform(F.coalesce(items, F.array().cast("array<string>")), _named(name)))
    return rows.select(F.lit(table).alias("table_name"), F.col(id_column).alias("record_id"), F.explode(F.concat(*entries)).alias("x")).select("table_name", "record_id", "x.field", "x.value").where("value <> ''")


def _grams(words: Column, size: Column | int) -> Column:
    """Hashes of the runs of `size` words of an array of words."""
    size = F.lit(size) if isinstance(size, int) else size
    runs = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " "))))
    return F.when(F.size(words) >= size, F.array_distinct(F.element_at(runs, 1))).otherwise(F.array().cast("array<bigint>"))


def private_grams(private: DataFrame) -> DataFrame:
    """(size, gram) of private values: hashes of all runs of four words; a value of fewer words is one run if it has eight characters."""
    key = T.label(F.col("value"))
    own = private.select(key.alias("key"), F.filter(F.split(key, " "), lambda w: w != "").alias("words")).where("size(words) > 0")
    size = F.when(F.size("words") >= GRAM, GRAM).when(F.length("key") >= LEAST_CHARACTERS, F.size("words"))
    return own.select(size.alias("size"), "words").where("size is not null").select("size", F.explode(_grams(F.col("words"), F.col("size"))).alias("gram")).distinct()


def output_exposure(targets: DataFrame, private: DataFrame, identifiers: tuple[str, ...], addresses: tuple[str, ...]) -> DataFrame:
    """(table_name, record_id, field, fault) of targets (table_name, record_id, field, value), output for the public: `pii` for an address of mail or a telephone number
    (which addresses of the web may look like), `private_text` for a run of words, or in `identifiers` for a long part, that a private value (value) has.

    Runs and parts are compared as hashes by semi joins; neither side is collected but for the up to four lengths of runs that the private side has. Any run
    may be hot on either side: both are distinct before the join."""
    place = ["table_name", "record_id", "field"]
    pii = targets.where(F.col("value").rlike(T.EMAIL) | (~F.col("field").isin(*addresses) & F.col("value").rlike(T.PHONE))).select(*place, F.lit("pii").alias("fault"))
    grams = private_grams(private)
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # 1 to 4
    found = []
    if sizes:
        words = targets.select(*place, F.filter(F.split(T.label(F.col("value")), " "), lambda w: w != "").alias("words"))
        runs = F.array(*(F.struct(F.lit(s).alias("size"), _grams(F.col("words"), s).alias("grams")) for s in sizes))
        own = words.select(*place, F.explode(runs).alias("x")).select(*place, "x.size", F.explode("x.grams").alias("gram"))
        found.append(own.join(grams, ["size", "gram"], "left_semi").select(*place))
    part = lambda df: df.select("*", F.explode(identifier_parts(T.label(F.col("value")))).alias("part"))
    parts = part(private).select("part").distinct()
    found.append(part(targets.where(F.col("field").isin(*identifiers))).join(parts, "part", "left_semi").select(*place))
    shown = reduce(DataFrame.unionByName, found).select(*place, F.lit("private_text").alias("fault"))
    return pii.unionByName(shown).distinct()


def shared_identifiers(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str) -> DataFrame:
    """(left_id, right_id, part): long identifiers that both texts hold, each once."""
    a = left.select(F.col(left_id).alias("left_id"), F.explode(identifier_parts(F.col(left_text))).alias("part"))
    b = right.select(F.col(right_id).alias("right_id"), F.explode(identifier_parts(F.col(right_text))).alias("part"))
    return a.join(b, "part").select("left_id", "right_id", "part").distinct()


def publishable(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, record_ref, source_file_sha256, and fields) as they may go into what is published: of a record that isn't public only its id, reference and file hash,
    each null if it is malformed or holds personal data, all other fields null."""
    public = F.col("visibility") == "public"
    clean = lambda c, form: F.when(F.col(c).rlike(form) & ~F.col(c).rlike(T.EMAIL) & ~F.col(c).rlike(T.PHONE), F.col(c))
    narrow = {"id": F.when(F.col("id").rlike(_ID), F.col("id")), "record_ref": clean("record_ref", _REFERENCE), "source_file_sha256": F.when(F.col("source_file_sha256").rlike(_FILE_HASH), F.col("source_file_sha256"))}
    public = F.coalesce(public, F.lit(False))
    return records.select(*(F.when(public, F.col(c)).otherwise(v).alias(c) for c, v in narrow.items()), *(F.when(public, F.col(c)).alias(c) for c in fields if c not in narrow))


def protected_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term) of protected terms (case_id, term) that a text (id, case_id, text) of their case holds, whatever the letter case. Blank terms are none."""
    own = terms.where(F.trim("term") != "").select("case_id", F.lower("term").alias("term")).distinct()
    return texts.join(own, "case_id").where(F.contains(F.lower("text"), F.col("term"))).select("id", "term").distinct()
