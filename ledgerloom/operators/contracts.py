"""Documents against a contract: JSON texts whose keys, types and bounds are declared by a schema, each fault with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ledgerloom.operators.issues import shape_faults
from ledgerloom.sources.strict_json import json_fault, type_fault

_FAULT = "array<struct<path:string,fault:string>>"


def _one(path: str, fault: Column) -> Column:
    return F.when(fault.isNotNull(), F.array(F.struct(F.lit(path).alias("path"), fault.alias("fault")))).otherwise(F.array().cast(_FAULT))


def _faults(value: Column, kind: DataType, path: str, required: bool) -> Column:
    """The faults of a variant value and all below it: `null` where a value must be there, `wrong_type`, and `missing:key` or `unknown:key` of objects."""
    name = F.schema_of_variant(value)
    absent = value.isNull() | (name == "VOID")
    own = _one(path, F.when(absent, "null") if required else F.lit(None).cast("string"))
    if isinstance(kind, StructType):
        is_object = name.rlike("^OBJECT<")
        keys = F.json_object_keys(F.to_json(value))
        shape = F.transform(F.when(is_object, shape_faults(keys, tuple(kind.names))).otherwise(F.array().cast("array<string>")), lambda x: F.struct(F.lit(path).alias("path"), x.alias("fault")))
        inner = [_faults(F.try_variant_get(value, f"$['{f.name}']", "variant"), f.dataType, f"{path}.{f.name}", not f.nullable) for f in kind.fields]
        # what is missing is told once, by its key
        inner = [F.when(F.array_contains(keys, f.name), x).otherwise(F.array().cast(_FAULT)) for f, x in zip(kind.fields, inner)]
        below = F.when(is_object, F.concat(shape, *inner)).otherwise(_one(path, F.lit("wrong_type")))
    elif isinstance(kind, ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        many = F.flatten(F.transform(items, lambda x: _faults(x, kind.elementType, f"{path}[]", not kind.containsNull)))
        below = F.when(name.rlike("^ARRAY<"), F.array_distinct(many)).otherwise(_one(path, F.lit("wrong_type")))
    else:
        below = _one(path, type_fault(value, kind))
    return F.concat(own, F.when(absent, F.array().cast(_FAULT)).otherwise(below))


def document_faults(documents: DataFrame, id_column: str, text_column: str, contract: StructType) -> DataFrame:
    """(id, path, fault) of JSON texts against a contract: `json:` and why a text isn't accepted at all; `missing:key` and `unknown:key` at the path of their object; `null` for nulls of
    fields that aren't nullable; `wrong_type`. Equal faults of a list's items are told once. Null texts have the fault `null`; an acceptable text has no rows."""
    gate = F.when(F.col(text_column).isNull(), "null").otherwise(F.concat(F.lit("json:"), json_fault(F.col(text_column))))
    own = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), gate.alias("gate"))
    value = F.try_parse_json(F.when(F.col("gate").isNull(), F.col("text")))
    parsed = own.withColumn("value", value)
    found = F.when(F.col("gate").isNotNull(), F.array(F.struct(F.lit("$").alias("path"), F.col("gate").alias("fault")))).otherwise(_faults(F.col("value"), contract, "$", True))
    return parsed.select("id", F.explode(found).alias("x")).select("id", "x.path", "x.fault")


def set_faults(named: dict[str, DataFrame]) -> DataFrame:
    """(key, lacking): keys that some of several tables (key) lack, with the names of those tables, joined by `;`. Tables are pre-aggregated by key."""
    tagged = None
    for name, df in named.items():
        part = df.select(F.col(df.columns[0]).cast("string").alias("key"), F.lit(name).alias("t")).where("key is not null")
        tagged = part if tagged is None else tagged.unionByName(part)
    have = tagged.groupBy("key").agg(F.collect_set("t").alias("have"))  # as many as there are tables
    lacking = F.array_except(F.array(*map(F.lit, sorted(named))), "have")
    return have.where(F.size(lacking) > 0).select("key", F.array_join(lacking, ";").alias("lacking"))
