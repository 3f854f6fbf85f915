"""Deliveries of records as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def delivered(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """Records as their files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def without_repeats(stream: DataFrame, key: str = "id", time: str = "loaded_at", within: str = "90 days") -> DataFrame:
    """The first delivery of each record; repeats are recognised as long as they arrive within the span, after which a
    record's state is dropped."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def deliveries_per_window(stream: DataFrame, time: str = "loaded_at", length: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, platform, deliveries) by tumbling windows, each given out once it is certain that nothing comes late."""
    own = stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "platform").agg(F.count("*").alias("deliveries"))
    return own.select(F.col("w.start").alias("start"), "platform", "deliveries")
