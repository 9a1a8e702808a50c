"""Quality scores by a regularised quadratic discriminant over document statistics.

One pass turns each whole text into a few transformed statistics. Counts, sums and products of the labelled documents
are added up by Spark, so fitting takes every label whatever their number. Each class has its own covariance, shrunk
towards the pooled one and towards a multiple of the identity; its Cholesky factor is taken once and sent with the
scoring function, with its inverse, and a document's score is the logistic of the difference of the two log densities, whose
Mahalanobis distances are one product with that inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut

U = np.uint64


def _group(codes: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(codes)] = 1
    return out


_GROUPS = (_group(b"#$%&*+=<>@^_~\\{}[]"), _group(bytes(range(65, 91))), _group(b"|"), _group(b"0123456789"), _group(b"!?"), _group(b".,;:"))


def _per(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    return counts / np.maximum(of, 1)


def _distinct(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct hashes in each row."""
    if not len(h):
        return np.zeros(rows, np.int64)
    both = np.unique(T.mix(h) ^ T.mix(row.astype(U) + U(77)), return_index=True)[1]
    return np.bincount(row[both], minlength=rows)


def statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics, a row for each text; shares are square roots, sizes logarithms."""
    buf, at = T.flat(column)
    rows = len(at) - 1
    starts, ends, first = T.words(buf, at)
    h = T.hash_spans(buf, starts, ends, lower=True)
    n, size = np.diff(first), np.diff(at)
    row = np.repeat(np.arange(rows), n)
    lead = np.concatenate(([0], np.cumsum((buf < 0x80) | (buf >= 0xC0))))  # characters before each byte
    chars = lead[at[1:]] - lead[at[:-1]]
    share = []
    for g in _GROUPS:
        c = np.concatenate(([0], np.cumsum(g[buf])))
        share.append(_per(c[at[1:]] - c[at[:-1]], chars))
    same = np.zeros(len(h), np.int64)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    two = np.zeros(len(h), np.int64)
    two[2:] = (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    length = (lead[ends] - lead[starts]).astype(float)
    mean = _per(np.bincount(row, weights=length, minlength=rows), n)
    spread = np.sqrt(np.maximum(0, _per(np.bincount(row, weights=length**2, minlength=rows), n) - mean**2))
    # distinct words against the square root of their number, which long texts follow roughly
    distinct = np.log((_distinct(h, row, rows) + 1) / np.sqrt(n + 1))
    # lines: spans between line feeds and row limits
    feed = np.zeros(len(buf) + 1, bool)
    feed[:-1] = buf == 10
    begin = np.union1d(np.flatnonzero(feed[:-1]) + 1, at[:-1][size > 0])
    begin = begin[begin < len(buf)]
    stop = np.append(begin[1:], len(buf))
    line_row = np.searchsorted(at, begin, side="right") - 1
    lines = np.bincount(line_row, minlength=rows) if len(begin) else np.zeros(rows, np.int64)
    line_hash = T.hash_spans(buf, begin, stop, lower=False) if len(begin) else np.empty(0, dtype=U)
    line_repeats = _per(lines - _distinct(line_hash, line_row, rows), lines)
    sums = [np.sqrt(x) for x in (*share, _per(np.bincount(row, weights=same, minlength=rows), n), _per(np.bincount(row, weights=two, minlength=rows), n))]
    return np.stack([*sums, distinct, np.log1p(mean), np.log1p(spread), np.sqrt(line_repeats), np.log1p(n)], axis=1)


NAMES = ("symbols", "upper", "bars", "digits", "cries", "stops", "repeats", "echo", "distinct", "word_length", "word_spread", "line_repeats", "size")


@T.frugal
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in T.slices(batch.column(1)):
            part = batch.slice(i, j - i)
            x = statistics(part.column(1))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), values], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of (1, x) times (1, x) for each class."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            z = np.concatenate((np.ones((len(x), 1)), x), axis=1)
            y = batch.column(1).to_numpy()
            for k in (0, 1):
                total[k] = total.get(k, 0) + z[y == k].T @ z[y == k]
    for k, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k] * m.size, pa.int32()), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], names=["label", "cell", "value"])


class Discriminant:
    """Class means and the inverses of their Cholesky factors, from moments."""

    def __init__(self, moments: dict[int, np.ndarray], towards_pooled: float, towards_identity: float) -> None:
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        if set(moments) != {0, 1} or any(m[0, 0] < 2 for m in moments.values()):
            return
        counts = {k: m[0, 0] for k, m in moments.items()}
        means = {k: m[0, 1:] / m[0, 0] for k, m in moments.items()}
        covs = {k: m[1:, 1:] / m[0, 0] - np.outer(means[k], means[k]) for k, m in moments.items()}
        total = sum(counts.values())
        pooled = sum(counts[k] * covs[k] for k in covs) / total
        scale = np.diag(pooled).clip(1e-9)
        for k in (0, 1):
            c = (1 - towards_pooled) * covs[k] + towards_pooled * pooled
            c = (1 - towards_identity) * c + towards_identity * np.diag(scale)
            factor = np.linalg.cholesky(c)
            self.classes.append((means[k], np.tril(np.linalg.inv(factor)), float(np.log(counts[k] / total) - np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; a half for all if a class had no labels."""
        if not self.classes:
            return np.full(len(x), 0.5)
        zero, one = (base - 0.5 * ((inverse @ (x - mean).T) ** 2).sum(axis=0) for mean, inverse, base in self.classes)
        return 1 / (1 + np.exp(-np.clip(one - zero, -500, 500)))


def held_out(doc_id: str) -> Column:
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _learnt(x: DataFrame, labels: DataFrame, towards_pooled: float, towards_identity: float) -> Discriminant:
    """The discriminant of labelled rows of x (doc_id, x)."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    moments = x.join(known, "doc_id").select("x", "quality").mapInArrow(_moments, "label int, cell int, value double")
    got: dict[int, np.ndarray] = {}
    d = len(NAMES) + 1
    for r in moments.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():  # two matrices
        got.setdefault(r["label"], np.zeros(d * d))[r["cell"]] = r["value"]
    return Discriminant({k: m.reshape(d, d) for k, m in got.items()}, towards_pooled, towards_identity)


def quality_scores(docs: DataFrame, labels: DataFrame, towards_pooled: float = 0.1, towards_identity: float = 0.05) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text), learnt from labels (doc_id, quality).

    Labels other than 0 and 1, and those of held-out documents, are not used; if a class has fewer than two, every score
    is a half. Null and empty texts score by their statistics, which are those of no words. A row without doc_id is
    scored and not held out; rows of one doc_id are scored each. A label counts for every row of its doc_id, and every label
    where one has several. A score of exactly a half is predicted 1. A text of any length is one row of statistics and takes
    about 40 bytes of a task's memory for each of its own. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    x = cut(docs.mapInArrow(_features, "doc_id long, x array<double>"))
    model = _learnt(x, labels, towards_pooled, towards_identity)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(1))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    out = x.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, towards_pooled: float = 0.1, towards_identity: float = 0.05) -> DataFrame:
    """The rows of docs that quality_scores would give a half or more, with all their columns; they are not moved."""
    x = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_features, "doc_id long, x array<double>")
    model = _learnt(x, labels, towards_pooled, towards_identity)
    place = docs.columns.index("text")

    @T.frugal
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in T.slices(batch.column(place)):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(model.score(statistics(part.column(place))) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
