"""Files of projects as (project, rel_path, ext, content): walks, explicit paths, and the file sets of the checks.

Spark's own readers hide names that start with a point or an underscore, which count here, so listing is a walk; each
project is walked by a task, as contents are read where the rows are, from a folder that all executors see.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension, is_loose, is_source, is_test_file, is_test_path

LISTED = "project string, root string, rel_path string"


def walk(root: str, inside: str = "") -> Iterator[str]:
    """Paths of the regular files under a folder, relative to root; node_modules is passed by, unreadable folders are empty."""
    for folder, names, files in os.walk(os.path.join(root, inside)):
        names[:] = sorted(n for n in names if n != "node_modules")
        for f in sorted(files):
            full = os.path.join(folder, f)
            if os.path.isfile(full):
                yield os.path.relpath(full, root).replace(os.sep, "/")


def listing(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """All files of projects by their roots, sources or not."""
    df = spark.createDataFrame([(p, os.path.abspath(root)) for p, root in roots.items()], "project string, root string").repartition(max(1, len(roots)), "project")
    return df.mapInArrow(_walked, LISTED).withColumn("ext", extension(F.col("rel_path")))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            paths = walk(r["root"])
            while some := list(itertools.islice(paths, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array([r[c]] * len(some)) for c in ("project", "root")] + [pa.array(some)], names=["project", "root", "rel_path"])


def explicit(spark: SparkSession, project: str, root: str, paths: list[str], tests: bool = False) -> DataFrame:
    """Source files that paths name, folders walked; paths that don't exist are skipped, each file comes once. Test files
    are left out unless they are asked for."""
    out: set[str] = set()
    for p in paths:
        full = os.path.normpath(os.path.join(root, p))
        if os.path.isdir(full):
            out.update(walk(root, os.path.relpath(full, root)))
        elif os.path.isfile(full):
            out.add(os.path.relpath(full, root).replace(os.sep, "/"))
    df = spark.createDataFrame([(project, root, p) for p in sorted(out)], LISTED).withColumn("ext", extension(F.col("rel_path")))
    return df.filter(is_source(F.col("rel_path")) & (F.lit(tests) | ~is_test_file(F.col("rel_path"))))


def sources(files: DataFrame) -> DataFrame:
    """Sources under src that are no test files."""
    p = F.col("rel_path")
    return files.filter(p.startswith("src/") & is_source(p) & ~is_test_file(p))


def gate_files(files: DataFrame) -> DataFrame:
    """Sources that are in no test folder either; the path inside the project decides."""
    return sources(files).filter(~is_test_path(F.col("rel_path")))


def test_files(files: DataFrame) -> DataFrame:
    """All sources under test, and test files under src."""
    p = F.col("rel_path")
    tests = files.filter(p.startswith("test/") & is_source(p))
    return tests.unionByName(files.filter(p.startswith("src/") & is_source(p) & is_test_file(p)))


def loose(files: DataFrame) -> DataFrame:
    """Sources directly in src, tests too."""
    return files.filter(is_loose(F.col("rel_path")))


def read(files: DataFrame) -> DataFrame:
    """Listed files with their contents; bytes that aren't UTF-8 become U+FFFD, as does a file that went away's text null."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # a bounded number of files in memory
                part = batch.slice(i, 64)
                out = []
                for r in part.to_pylist():
                    try:
                        with open(os.path.join(r["root"], r["rel_path"]), "rb") as f:
                            out.append(f.read().decode("utf-8", "replace"))
                    except OSError:
                        out.append(None)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("project", "rel_path", "ext")), pa.array(out, pa.string())], names=["project", "rel_path", "ext", "content"])

    return files.select("project", "root", "rel_path", "ext").mapInArrow(contents, "project string, rel_path string, ext string, content string")
