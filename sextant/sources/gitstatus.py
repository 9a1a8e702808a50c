"""Changed source files from porcelain status lines."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import CHANGE_STATUS, is_source, is_test_file


def changed(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct rel_path by key of changed source files inside src, from lines (line): `XY path` or `XY old -> new`."""
    keys = keys or []
    either = F.substring("line", 1, 1).isin(CHANGE_STATUS) | F.substring("line", 2, 1).isin(CHANGE_STATUS)
    rest = F.trim(F.expr("substring(line, 4)"))
    target = F.when(F.instr(rest, " -> ") > 0, F.regexp_extract(rest, "^.*? -> (.*)$", 1)).otherwise(rest)
    path = lines.filter((F.length("line") >= 4) & either).select(*keys, target.alias("rel_path"))
    return path.filter(is_source(F.col("rel_path")) & ~is_test_file(F.col("rel_path")) & F.col("rel_path").startswith("src/")).distinct()


def read(spark: SparkSession, root: str) -> DataFrame:
    """Lines of `git status --porcelain` in a working tree; raises where git does."""
    out = subprocess.run(["git", "-C", root, "status", "--porcelain"], check=True, capture_output=True, text=True).stdout
    return spark.createDataFrame([(line,) for line in out.splitlines()], "line string")


def staged(spark: SparkSession, root: str) -> DataFrame:
    """rel_path of added, copied and modified files in the index with a plain script extension."""
    out = subprocess.run(["git", "-C", root, "diff", "--cached", "--name-only", "--diff-filter=ACM"], check=True, capture_output=True, text=True).stdout
    return spark.createDataFrame([(line,) for line in out.splitlines()], "rel_path string").filter(F.col("rel_path").rlike(r"\.(js|mjs|cjs)\z"))
