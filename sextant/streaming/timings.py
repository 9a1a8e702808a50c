"""Timings kept up to date from a stream of events: an extension, the batch form is operators.profile.timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.profile import timings
from ..sources.timings import EVENT


def events(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """A stream of the JSON-lines files that arrive in a folder, so many to a batch; each is read once."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).json(folder)


def totals(stream: DataFrame) -> DataFrame:
    """Running timings by function. The state is a row for each function, which is few, so there is no watermark."""
    return timings(stream, ["file", "method"])


def start(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Totals in an in-memory table that a query can read; a restart with the checkpoint counts no event twice."""
    return totals(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
