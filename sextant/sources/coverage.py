"""Coverage documents: JSON maps from file to its statements and their hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POSITION = "STRUCT<line: INT, column: INT>"
SCHEMA = f"MAP<STRING, STRUCT<statementMap: MAP<STRING, STRUCT<start: {_POSITION}, `end`: {_POSITION}>>, s: MAP<STRING, BIGINT>>>"


def read(spark: SparkSession, path: str, root: str) -> DataFrame:
    """statements() of the documents at a path, a whole file each."""
    return statements(spark.read.text(path, wholetext=True), root)


def files(documents: DataFrame, root: str) -> DataFrame:
    """rel_path and document of each file under root in JSON texts (value); what isn't JSON or lies outside is dropped.

    A file named twice in a document keeps its last entry; one in several documents keeps them all."""
    prefix = root.rstrip("/") + "/"
    each = documents.select(F.explode(F.from_json("value", SCHEMA)).alias("path", "document"))
    inside = F.col("path").startswith(prefix)
    rel = F.when(inside, F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))).when(~F.col("path").startswith("/"), F.col("path"))
    return each.select(rel.alias("rel_path"), "document").filter("rel_path is not null and not startswith(rel_path, '..')")


def statements(documents: DataFrame, root: str) -> DataFrame:
    """rel_path, stmt_id, start_line, end_line, hits; a statement without hits has null ones, and lines may be null."""
    each = files(documents, root).select("rel_path", F.col("document.s").alias("s"), F.explode("document.statementMap").alias("stmt_id", "at"))
    return each.select("rel_path", "stmt_id", F.col("at.start.line").alias("start_line"), F.col("at.end.line").alias("end_line"), F.try_element_at("s", F.col("stmt_id")).alias("hits"))
