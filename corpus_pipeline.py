"""A corpus pipeline over documents: quality, near-duplicates, personal data, mixture, packing.

Each stage takes what the one before has kept and written; all but the last return the columns of documents. Rows
without doc_id pass the second stage and are otherwise treated as any row. Null and empty texts are judged by quality
like others, link with nothing and have no words that the mixture could take. An empty table passes as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import WORD, drop, shared_folder, table, written
from sextant.llm.discriminant import accepted
from sextant.llm.minhash import near_duplicates
from sextant.llm.mixing import mixed_spans
from sextant.llm.packing import packed
from sextant.llm.pseudonyms import pseudonymised
from sextant.llm.registry import pseudonym_key, vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL has neither the classifier's fit nor pseudonyms nor token ids; the stages are tested against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; it learns from the labels of the documents that are there."""
    return accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; its rows of equal text are one, those of other
    texts stay."""
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    one = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    alone = docs.join(kept, "doc_id").withColumn("_nth", one).filter("_nth = 1").select(*COLUMNS)
    return alone.union(docs.filter("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with pseudonyms in their texts and n_chars taken anew."""
    return pseudonymised(docs.select(*COLUMNS), pseudonym_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each document that lie in the blocks the mix draws, as often as it draws them: a row for each stretch
    of adjoining blocks, which is the text itself where all of it is drawn. Each row has a draw of its own."""
    docs = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "mixture")  # numbers must stay as they are
    mixed = docs.join(mixed_spans(docs, "_row"), "_row")
    words = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # a one-element transform serves as a binding: the text is split once for all of its spans
    spelt = F.transform(F.array(words), lambda w: F.transform("spans", lambda s: F.when(s.stop - s.first == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(w, (s.first + 1).cast("int"), (s.stop - s.first).cast("int")), ""))))
    out = mixed.select(*(c for c in COLUMNS if c not in ("text", "n_chars")), F.explode(spelt[0]).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' token pieces and their places in sequences."""
    return packed(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again; what a stage has taken in is
    deleted when it has been written."""
    docs, last = table(spark, sf_dir, "documents"), None
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        if last is not None:
            drop(spark, last)
        last = f"{where}/{name}"
        docs = spark.read.parquet(last)
    return STAGES[-1][1](spark, docs, sf_dir)
