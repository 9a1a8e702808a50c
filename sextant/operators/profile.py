"""Timing profiles: calls of functions added up, joined to the inventory, with shares of the total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means below this many microseconds are mostly the cost of measuring.
NOISE_FLOOR = 30.0


def micros(milliseconds: Column) -> Column:
    """Whole microseconds, half up, never negative."""
    return F.greatest(F.lit(0), F.floor(milliseconds * 1000 + 0.5)).cast("long")


def timings(events: DataFrame, keys: list[str]) -> DataFrame:
    """calls, total_micros, min_micros, max_micros by key from events with micros; each event counts once."""
    return events.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("micros").alias("total_micros"), F.min("micros").alias("min_micros"), F.max("micros").alias("max_micros"))


def merged(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Timings of several processes as one."""
    return partials.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("total_micros").alias("total_micros"), F.min("min_micros").alias("min_micros"), F.max("max_micros").alias("max_micros"))


def attributed(timing: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Timings of the functions in the inventory; functions that share a key all get its timing, others are dropped."""
    return inventory.join(timing, keys)


def profiled(rows: DataFrame) -> DataFrame:
    """rows with pct of the total of all rows, mean_micros, noisy, and the milliseconds of 60 calls.

    The total is a scalar subquery: no window gathers the rows in one task."""
    total = rows.agg(F.coalesce(F.sum("total_micros"), F.lit(0)).alias("total")).scalar()
    mean = F.when(F.col("calls") > 0, F.col("total_micros") / F.col("calls")).otherwise(F.lit(0.0))
    return (
        rows.withColumn("pct", F.when(total > 0, F.col("total_micros") / total * 100).otherwise(F.lit(0.0)))
        .withColumn("mean_micros", mean)
        .withColumn("noisy", F.col("mean_micros") < NOISE_FLOOR)
        .withColumn("ms_at_60", F.col("mean_micros") * 60 / 1000)
    )


def hottest(rows: DataFrame, top: int, *ties: str) -> DataFrame:
    """The largest totals first; top 0 is all of them."""
    out = rows.orderBy(F.desc("total_micros"), *ties)
    return out.limit(top) if top > 0 else out


def over_threshold(rows: DataFrame, milliseconds: float) -> DataFrame:
    """One row: functions, their total, and how many took strictly longer."""
    return rows.agg(F.count("*").alias("methods"), F.coalesce(F.sum("total_micros"), F.lit(0)).alias("total_micros"), F.count_if(F.col("total_micros") / 1000 > F.lit(milliseconds)).alias("over_threshold"))
