"""JSON and JSON lines read strictly, with the place of every fault.

Text is read as whole files, so that line numbers are those of the file; the gate that rejects repeated keys, numbers that are none,
lone surrogates, deep nesting and anything behind the value runs in Python on batches, and what passes is parsed by Spark
with a declared schema.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, StringType, StructType

MOST_DEPTH = 100
MOST_DIGITS = 256


class Fault(ValueError):
    """Why a text isn't accepted."""


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Fault("repeated_key")
    return out


def _number(kind):
    def parse(text: str):
        if len(text) > MOST_DIGITS:
            raise Fault("long_number")
        value = kind(text)
        if value != value or value in (float("inf"), float("-inf")):
            raise Fault("not_finite")
        return value

    return parse


def _constant(text: str):
    raise Fault("not_finite")


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)
_BRACKET = re.compile(r"[\[\]{}]")


def depth_of(text: str) -> int:
    """The deepest nesting of brackets outside strings."""
    signs = _BRACKET.findall(_STRING.sub("", text))
    return max(0, *accumulate(1 if s in "[{" else -1 for s in signs)) if signs else 0


def check_json(text: str) -> str | None:
    """None for an acceptable JSON object, else the name of its first fault."""
    if depth_of(text) > MOST_DEPTH:
        return "depth"
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant, parse_int=_number(int), parse_float=_number(float))
        json.dumps(value, ensure_ascii=False).encode("utf-8")
    except Fault as fault:
        return str(fault)
    except UnicodeEncodeError:
        return "surrogate"
    except (ValueError, RecursionError):
        return "syntax"
    return None if isinstance(value, dict) else "no_object"


def canonical_json(value: object) -> str:
    """Sorted keys, no white space, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, line, text, fault) of all lines of files that aren't blank, lines counted from 1. A file that isn't UTF-8 gives one row with fault `encoding`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    lines = content.decode("utf-8").split("\n")
                except UnicodeDecodeError:
                    yield _batch([(path, 0, None, "encoding")])
                    continue
                for start in range(0, len(lines), 10_000):
                    yield _batch([(path, start + k + 1, x, None) for k, x in enumerate(lines[start : start + 10_000]) if x.strip()])

    def _batch(rows):
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "line", "text", "fault"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, line int, text string, fault string")


@F.arrow_udf(StringType())
def _fault_of(batch: pa.Array) -> pa.Array:
    return pa.array([None if x is None else check_json(x) for x in batch.to_pylist()], pa.string())


def json_fault(text: Column) -> Column:
    """check_json() of a column, null for acceptable texts and for null."""
    return _fault_of(text)


def type_fault(value: Column, kind: DataType) -> Column:
    """`wrong_type` where a value (a variant) isn't of a declared type: nothing is converted. Null is of every type. Whole numbers have no point or exponent."""
    name = F.schema_of_variant(value)
    if isinstance(kind, StringType):
        good = name == "STRING"
    elif isinstance(kind, BooleanType):
        good = name == "BOOLEAN"
    elif isinstance(kind, IntegralType):
        good = (name == "BIGINT") & F.try_variant_get(value, "$", kind.simpleString()).isNotNull()
    elif isinstance(kind, FractionalType):
        good = name.rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    elif isinstance(kind, ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.when(name.isNull() | (name == "VOID"), None).when(~name.rlike("^ARRAY<"), "wrong_type").otherwise(F.get(F.array_compact(F.transform(items, lambda x: type_fault(x, kind.elementType))), 0))
    elif isinstance(kind, StructType):
        inner = [type_fault(F.try_variant_get(value, f"$['{f.name}']", "variant"), f.dataType) for f in kind.fields]
        return F.when(name.isNull() | (name == "VOID"), None).when(~name.rlike("^OBJECT<"), "wrong_type").otherwise(F.coalesce(*inner, F.lit(None).cast("string")))
    else:
        return F.lit(None).cast("string")
    return F.when(name.isNotNull() & (name != "VOID") & ~good, "wrong_type")


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: StructType, most_lines: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema with their path and line, faults (path, line, fault)).

    Lines with a key that the schema doesn't have, or without one that it has, are faults: `unknown_key`, `missing_key`; so are values of another type than
    declared: `wrong_type`. With most_lines, each line beyond it is a fault `too_many_lines`; nothing is dropped silently.
    """
    gated = read_lines(spark, paths).withColumn("fault", F.coalesce("fault", _fault_of(F.col("text"))))
    keys = F.json_object_keys("text")
    names = F.array(*(F.lit(f.name) for f in schema.fields))
    shape = F.when(F.size(F.array_except(keys, names)) > 0, "unknown_key").when(F.size(F.array_except(names, keys)) > 0, "missing_key")
    beyond = F.when(F.col("line") > most_lines, "too_many_lines") if most_lines is not None else F.lit(None).cast("string")
    checked = gated.withColumn("fault", F.coalesce("fault", beyond, shape))
    value = F.try_parse_json(F.when(F.col("fault").isNull(), F.col("text")))
    checked = checked.withColumn("fault", F.coalesce("fault", type_fault(value, schema)))
    rows = checked.where("fault is null").select("path", "line", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("x")).select("path", "line", "x.*")
    return rows, checked.where("fault is not null").select("path", "line", "fault")


def read_object(spark: SparkSession, path: str, schema: StructType, most_bytes: int = 10 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """(row of the schema, faults (path, fault)) of files that hold one JSON object each. Faults besides those of lines: `too_large`, `encoding`."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(F.col("length") <= most_bytes, F.try_validate_utf8(F.col("content").cast("string")))
    gate = F.when(F.col("length") > most_bytes, "too_large").when(text.isNull(), "encoding")
    gated = files.select("path", text.alias("text"), gate.alias("fault")).withColumn("fault", F.coalesce("fault", _fault_of(F.col("text"))))
    names = F.array(*(F.lit(f.name) for f in schema.fields))
    shape = F.when(F.size(F.array_except(F.json_object_keys("text"), names)) > 0, "unknown_key").when(F.size(F.array_except(names, F.json_object_keys("text"))) > 0, "missing_key")
    checked = gated.withColumn("fault", F.coalesce("fault", shape, type_fault(F.try_parse_json(F.when(F.col("fault").isNull(), F.col("text"))), schema)))
    rows = checked.where("fault is null").select("path", F.from_json("text", schema).alias("x")).select("path", "x.*")
    return rows, checked.where("fault is not null").select("path", "fault")


def score_file_groups(spark: SparkSession, roles: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(groups, records) of scorers' files by role: groups (role, file_index, path, sha256, bytes, records), records (role, file_index, line, text, fault), in one read of
    each file. Files of a role count from 0 in the order given; a file without records has its group, too."""
    place = {os.path.abspath(p): (role, k) for role, paths in roles.items() for k, p in enumerate(paths)}
    if not place:
        return spark.createDataFrame([], "role string, file_index int, path string, sha256 string, bytes bigint, records bigint"), spark.createDataFrame([], "role string, file_index int, line int, text string, fault string")
    files = spark.read.format("binaryFile").load(list(place)).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length", "content")
    known = spark.createDataFrame([(p, *x) for p, x in place.items()], "path string, role string, file_index int")
    lines = read_lines(spark, list(place)).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "line", "text", "fault").withColumn("fault", F.coalesce("fault", _fault_of(F.col("text"))))
    records = lines.join(F.broadcast(known), "path").select("role", "file_index", "line", "text", "fault")  # a row for each file named
    number = lines.groupBy("path").agg(F.count("*").alias("records"))
    # Spark reads no empty files, but they are files
    groups = F.broadcast(known).join(files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")), "path", "left").join(number, "path", "left")
    groups = groups.withColumn("sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    return groups.select("role", "file_index", "path", "sha256", "bytes", F.coalesce("records", F.lit(0)).alias("records")), records


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of all files below a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.escape(folder.rstrip("/").split("://", 1)[-1])
    return files.select(F.regexp_replace("path", f"^.*{root}/", "").alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def verified_objects(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, text, fault) of a folder's JSON files against a manifest (path, sha256): text of the very bytes that were hashed, in one read. Faults:
    `missing`, `extra`, `modified`, `encoding`, or why the JSON isn't accepted."""
    root = re.escape(folder.rstrip("/").split("://", 1)[-1])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    own = files.select(F.regexp_replace("path", f"^.*{root}/", "").alias("path"), F.sha2("content", 256).alias("own"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.lit(True).alias("there"))
    both = own.join(manifest.select("path", "sha256"), "path", "full_outer")
    fault = F.when(F.col("there").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("own") != F.col("sha256"), "modified").when(F.col("text").isNull(), "encoding")
    return both.select("path", "text", fault.alias("fault")).withColumn("fault", F.coalesce("fault", _fault_of(F.col("text")))).select("path", F.when(F.col("fault").isNull(), F.col("text")).alias("text"), "fault")


def model_outputs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, sha256, text, fault) of raw answers of models: the exact bytes are hashed; JSON as it stands, nothing is repaired or cut out of a fence."""
    files = spark.read.format("binaryFile").load(paths)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = files.select("path", F.sha2("content", 256).alias("sha256"), text.alias("text"), F.when(text.isNull(), "encoding").alias("fault"))
    return read.withColumn("fault", F.coalesce("fault", _fault_of(F.col("text"))))
