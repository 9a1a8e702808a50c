"""Change risk of functions: cyclomatic complexity combined with statement coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import overlaps


def crap_score(complexity: Column, coverage: Column) -> Column:
    """complexity squared times the uncovered share cubed, plus complexity; null where coverage is.

    The product keeps this order of factors, so that doubles come out alike in every engine; coverage isn't clamped."""
    c, u = complexity.cast("double"), F.lit(1.0) - coverage
    return c * c * u * u * u + c


def method_coverage(methods: DataFrame, statements: DataFrame, keys: list[str], method_id: str = "method_id") -> DataFrame:
    """methods with coverage: the share of the statements meeting a method's lines that were hit; null if there are none.

    A statement of a nested function counts for both; one without hits isn't covered. The statements are counted by
    method before they meet the methods again.
    """
    own = methods.select(*keys, method_id, "start_line", "end_line")
    st = statements.select(*keys, F.col("start_line").alias("other_start"), F.col("end_line").alias("other_end"), (F.coalesce("hits", F.lit(0)) > 0).cast("int").alias("hit"))
    share = overlaps(own, st, keys).groupBy(*keys, method_id).agg((F.sum("hit") / F.count("*")).alias("coverage"))
    return methods.join(share, [*keys, method_id], "left")


def crap_metrics(methods: DataFrame, statements: DataFrame, keys: list[str], method_id: str = "method_id") -> DataFrame:
    """methods with coverage and crap_score."""
    m = method_coverage(methods, statements, keys, method_id)
    return m.withColumn("crap_score", crap_score(F.col("complexity"), F.col("coverage")))


def ranked(metrics: DataFrame, *ties: str) -> DataFrame:
    """Riskiest first, unknown last, ties by the columns named (file, start line, order in the file)."""
    return metrics.orderBy(F.desc_nulls_last("crap_score"), *ties)


def verdict(metrics: DataFrame, threshold: float = 8.0) -> DataFrame:
    """One row: methods, the largest score (at least 0; unknown ones don't count), how many are over, and failed.

    A score equal to the threshold passes."""
    over = F.count_if(F.col("crap_score") > threshold)
    top = F.greatest(F.coalesce(F.max("crap_score"), F.lit(0.0)), F.lit(0.0))
    return metrics.agg(F.count("*").alias("methods"), top.alias("max_crap"), over.alias("over_threshold")).withColumn("failed", F.col("max_crap") > threshold)
