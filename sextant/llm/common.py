"""What the corpus operators share: reading tables, cutting lineage, joins with hot keys, connected components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has more than one in so many of all rows; there are fewer hot keys than this.
HOT_SHARE = 1000
#: Settings under which phases run.
PHASE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at_exit(spark: SparkSession, path: str) -> None:
    """Marks a folder for removal when the driver ends, whichever way."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for intermediate rows, inside spark.checkpoint.dir; where that is unset, inside the warehouse,
    which driver and executors share. It goes when the driver ends."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    folder = context.getCheckpointDir()
    if getattr(context, "_sextant_folder", None) != folder:
        _at_exit(spark, folder)
        context._sextant_folder = folder
    return folder


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """While a phase is run: shuffle files go when it ends, and texts come to Python few at a time, as some are long."""
    before = {k: spark.conf.get(k, None) for k in PHASE}
    for k, v in PHASE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage, so that a lost executor costs no more than a reread; the shuffle files that led
    to them are dropped at once."""
    shared_folder(df.sparkSession)
    with _settings(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan made under the settings


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table of their own in the shared folder, where they stay as they are however often read."""
    where = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _settings(df.sparkSession):
        df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def pieces(spark: SparkSession) -> int:
    """Partitions of an explicit exchange: as many as Spark's own."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, facts: DataFrame, key: str, copies: str, total: int, row: str) -> DataFrame:
    """rows left-joined with facts (one row for each key, with the number of rows that have it in `copies`, which is not
    kept), whatever share of the rows a key has.

    Facts of hot keys, those of more than one row in HOT_SHARE, are fewer than HOT_SHARE and are broadcast; rows that
    they serve, and rows without key, then go through the other join spread by a hash of the column `row`, where they meet
    nothing. facts must have been cut, as they are read twice. Names that start with _hot_ are taken.
    """
    names = [c for c in facts.columns if c not in (key, copies)]
    limit = F.col(copies) * HOT_SHARE > F.lit(int(total))
    hot = facts.filter(limit).select(F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot_facts"))
    rare = facts.filter(~limit).select(F.col(key).alias("_hot_rare"), F.struct(*names).alias("_hot_more"), F.lit(False).alias("_hot_no"))
    served = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn("_hot_done", F.col("_hot_facts").isNotNull() | F.col(key).isNull())
    kind = rows.schema[key].dataType
    filler = F.xxhash64(row).cast("string").cast(kind)
    out = served.withColumn("_hot_on", F.when(F.col("_hot_done"), filler).otherwise(F.col(key)))
    out = out.join(rare, (F.col("_hot_on") == F.col("_hot_rare")) & (F.col("_hot_done") == F.col("_hot_no")), "left")
    found = F.coalesce("_hot_facts", "_hot_more")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(found[n].alias(n) for n in names))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (v, label) for each vertex of edges (a, b), label the smallest vertex reachable.

    Rounds of neighbour minimum and pointer jumping; each is a few joins on the vertex, of which AQE splits what is larger
    than a partition should be, and is cut by a checkpoint. Nothing is gathered but whether a label changed.
    """
    e = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("v"), F.col("b").alias("label"))
    labels = cut(e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        near = e.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        low = labels.join(near, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("jump"))
        new = cut(low.join(jump, "label").select("v", F.least("label", "jump").alias("label"), "was"))
        if new.filter("label <> was").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")
