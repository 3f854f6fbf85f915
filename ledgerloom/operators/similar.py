"""Exact set-similarity join of texts by their word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import word_grams
from ledgerloom.operators.records import lookup
from ledgerloom.operators.scratch import Scratch


def shingle_statistics(rows: DataFrame, text: str, size: int = 5) -> DataFrame:
    """(n_rows, n_shingles, most_in_a_row) of the distinct shingles of each row."""
    sizes = rows.select(F.size(word_grams(F.col(text), size)).alias("n")).where("n > 0")
    return sizes.agg(F.count("*").alias("n_rows"), F.sum("n").cast("bigint").alias("n_shingles"), F.max("n").cast("bigint").alias("most_in_a_row"))


_BLOCK = 512  # texts of a block of a shingle that many texts share


def _blocks(keys: DataFrame) -> DataFrame:
    """keys (class, n, gram) with `low` and `high`: a shingle that more than a block of texts have in their prefix is split into pairs of blocks, so that any two of its texts meet in
    one join key, and no key has more rows than two blocks."""
    sizes = keys.groupBy("gram").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("m"))
    placed = lookup(keys, "gram", sizes, "class").withColumn("block", F.pmod(F.xxhash64("class"), F.col("m")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return spread.select("class", "n", "gram", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def similar_classes(rows: DataFrame, scratch: Scratch, id_column: str, text: str, size: int = 5, least_words: int = 30, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, shared, apart) of classes of texts whose shingle sets share at least `threshold` of their union, and members
    (class, id). Texts of one shingle sequence are one class, named by its smallest id.

    Prefix filter: with the shingles of each text in one order, the rarest first, two texts can only reach the threshold if they share one of the first
    n - ceil(threshold * n) + 1. Only those are joined, and only with texts of a size that can reach the threshold. Candidates are
    verified by joining the whole sets, as hashes of 64 bits.
    """
    mark = scratch.mark()
    words = F.split(F.lower(F.regexp_replace(F.trim(F.col(text)), r"\s+", " ")), " ")
    own = rows.where(F.col(text).isNotNull() & (F.size(words) >= max(size, least_words))).select(F.col(id_column).alias("id"), F.md5(F.array_join(words, " ")).alias("key"), F.transform(word_grams(F.col(text), size), lambda x: F.xxhash64(x)).alias("grams"))
    heads = own.groupBy("key").agg(F.min_by(F.struct("id", "grams"), "id").alias("x"))
    classes = scratch.save(heads.select(F.col("x.id").alias("class"), "key", F.array_distinct("x.grams").alias("grams")))
    # a text that very many rows have is spread
    members = lookup(own.select("id", "key"), "key", classes.select("key", "class"), "id").select("class", "id")
    single = scratch.save(classes.select("class", F.size("grams").alias("n"), F.explode("grams").alias("gram")))
    often = single.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one text only lead nowhere, but hold their places in the order: they come first
    counted = single.join(often, "gram", "left").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "gram"))).alias("order"))  # one text's shingles
    prefix = F.slice("order", 1, F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
    keys = scratch.save(counted.select("class", "n", F.explode(F.filter(prefix, lambda x: x["df"] > 1)).alias("x")).select("class", "n", "x.gram"))
    blocked = _blocks(keys)
    left, right = blocked.select("gram", "low", "high", F.col("class").alias("a"), F.col("n").alias("na")), blocked.select("gram", "low", "high", F.col("class").alias("b"), F.col("n").alias("nb"))
    found = left.join(right, ["gram", "low", "high"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)).select("a", "b").distinct()
    sets = classes.select("class", "grams")
    both = found.join(sets.withColumnRenamed("class", "a").withColumnRenamed("grams", "ga"), "a").join(sets.withColumnRenamed("class", "b").withColumnRenamed("grams", "gb"), "b")
    shared = F.size(F.array_intersect("ga", "gb")).cast("bigint")
    total = (F.size("ga") + F.size("gb")).cast("bigint")
    pairs = both.select("a", "b", shared.alias("shared"), (total - 2 * shared).alias("apart")).where(F.col("shared") >= threshold * (F.col("shared") + F.col("apart")) - 1e-9)
    saved_pairs, saved_members = scratch.save(pairs), scratch.save(members)
    scratch.release(mark, saved_pairs, saved_members)
    return saved_pairs, saved_members


def between_groups(pairs: DataFrame, members: DataFrame, texts: DataFrame, roots: DataFrame, length_ratio: float) -> DataFrame:
    """(a, b, root_a, root_b): pairs of classes whose texts' lengths are near enough and whose first records are in different groups, so that somebody has to look at them. texts: (id, length)
    of the classes' first records; records without a group are their own root."""
    own = texts.join(roots.select("id", "root"), "id", "left").select("id", "length", F.coalesce("root", "id").alias("root"))
    side = lambda x: own.select(F.col("id").alias(x), F.col("length").alias(f"length_{x}"), F.col("root").alias(f"root_{x}"))
    near = F.least("length_a", "length_b") >= F.greatest("length_a", "length_b") * length_ratio - 1e-9
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(near & (F.col("root_a") != F.col("root_b"))).select("a", "b", "root_a", "root_b")
