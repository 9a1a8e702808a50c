"""Interval overlap inside a key, without comparing all of a key's intervals with one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines to a bin.
WIDTH = 64


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """Pairs of rows of equal keys whose [start_line, end_line] meet, bounds included; null lines meet nothing.

    left has start_line and end_line, right has other_start and other_end. Both sides are unfolded to the bins that they
    touch, so the join has an equality on key and bin and a bundle with very many lines is spread over them; a pair is
    kept in the bin where the later of the two starts.
    """
    a = left.filter("start_line <= end_line").withColumn("bin", F.expr(f"explode(sequence(start_line div {width}, end_line div {width}))"))
    b = right.filter("other_start <= other_end").withColumn("bin", F.expr(f"explode(sequence(other_start div {width}, other_end div {width}))"))
    met = (F.col("other_end") >= F.col("start_line")) & (F.col("other_start") <= F.col("end_line")) & (F.col("bin") == F.expr(f"greatest(start_line, other_start) div {width}"))
    return a.join(b, [*keys, "bin"]).filter(met).drop("bin")
