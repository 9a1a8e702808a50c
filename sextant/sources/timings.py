"""Timing events and merged timings as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "file STRING, method STRING, micros BIGINT"
MERGED = "MAP<STRING, STRUCT<calls: BIGINT, totalMicros: BIGINT, minMicros: BIGINT, maxMicros: BIGINT>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, method, calls, total_micros, min_micros, max_micros of JSON maps with keys `file|method`, a whole file each.

    Text that isn't JSON has no rows."""
    return unpacked(spark.read.text(path, wholetext=True))


def unpacked(texts: DataFrame) -> DataFrame:
    each = texts.select(F.explode(F.from_json("value", MERGED)).alias("key", "t"))
    file = F.regexp_extract("key", r"^(.*)\|[^|]*$", 1)
    return each.select(
        file.alias("file"), F.substring_index("key", "|", -1).alias("method"), F.col("t.calls").alias("calls"), F.col("t.totalMicros").alias("total_micros"), F.col("t.minMicros").alias("min_micros"), F.col("t.maxMicros").alias("max_micros")
    )


def events(spark: SparkSession, path: str) -> DataFrame:
    """Events, one JSON object to a line."""
    return spark.read.schema(EVENT).json(path)
