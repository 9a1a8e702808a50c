"""Packing documents' tokens into sequences of one length by non-negative least squares.

Documents end in a separator and are cut at whole windows; windows that one document fills are sequences of their own.
What is left of each document is a piece shorter than the window, and there are only as many lengths as the window has
tokens. So the plan is made from their histogram, whatever the size of the corpus:

1. Shallow combinations of lengths that fill a window exactly are enumerated: all pairs, and triples and quadruples of
   the most frequent lengths with the length that completes them.
2. How often to repeat each is solved as non-negative least squares against the histogram, and rounded.
3. Lengths that are left are packed greedily, the longest first, each pattern as often as its lengths allow.

Pieces find their place by their rank among those of their length: a count for each partition and length is summed up
over the partitions, and the plan is a table of rank intervals with at most a few entries for each combination.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import cut

#: Most frequent lengths that triples and quadruples are made of, and rounds of the solver.
FREQUENT, ROUNDS = 48, 400
_PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part long, rank long"


def _pieces(path: str, window: int, separator: int):
    @T.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import tokens

        vocabulary = tokens.vocabulary(path)
        seen = np.zeros(window + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for i, j in T.slices(batch.column(1), 2 << 20):
                docs = batch.slice(i, j - i)
                ids, at = vocabulary.encode(docs.column(1))
                n = np.diff(at) + 1
                flat = np.full(int(n.sum()), separator, dtype="<u4")
                own = np.arange(len(ids)) + np.repeat(np.arange(len(docs)), n - 1)
                flat[own] = ids
                count = -(-n // window)
                row = np.repeat(np.arange(len(docs)), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = nth * window
                length = np.minimum(n[row] - start, window)
                first = (np.cumsum(n) - n)[row] + start
                raw = memoryview(flat.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                new = np.bincount(length, minlength=window + 1)
                rank = np.empty(len(row), dtype=np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(np.cumsum(new) - new, new) + np.repeat(seen, new)
                seen += new
                yield pa.RecordBatch.from_arrays(
                    [docs.column(0).take(pa.array(row)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(np.full(len(row), part, dtype=np.int64)), pa.array(rank)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"],
                )

    return run


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to four lengths (0: none) that add up to the window, of lengths that occur."""
    there = np.flatnonzero(histogram[:window])
    out = [(a, window - a, 0, 0) for a in there.tolist() if a <= window - a and histogram[window - a]]
    top = sorted(there[np.argsort(-histogram[there], kind="stable")][:FREQUENT].tolist())
    for k in (2, 3):
        for c in itertools.combinations_with_replacement(top, k):
            rest = window - sum(c)
            if rest > 0 and histogram[rest]:
                out.append((*c, rest, *[0] * (3 - k)))
    return np.unique(np.sort(np.array(out, dtype=np.int64).reshape(-1, 4), axis=1), axis=0)


def repeats(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares: how often each combination is used so that the lengths' sums come near the histogram.

    Accelerated projected gradient; the matrix has four entries in a column and is never formed.
    """
    real = combos > 0
    target = histogram.astype(float)
    target[0] = 0

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), weights=(real * x[:, None]).ravel(), minlength=len(histogram)) * (np.arange(len(histogram)) > 0)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * real).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue, for the step
        w = back(use(v))
        scale = np.linalg.norm(w)
        v = w / max(scale, 1e-300)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - back(use(y) - target) / max(1.05 * scale, 1e-300))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences have each; every piece of the histogram is in one."""
    left = histogram.astype(np.int64).copy()
    left[0] = left[window] = 0
    out: list[tuple[list[int], int]] = []

    def take(lengths: list[int], most: int) -> None:
        need = {n: lengths.count(n) for n in lengths}
        times = int(min(most, *(left[n] // k for n, k in need.items()), most))
        if times > 0:
            for n, k in need.items():
                left[n] -= times * k
            out.append((lengths, times))

    combos = combinations(left, window)
    if len(combos):
        x = repeats(combos, left)
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] >= 0.5:
                take([n for n in combos[k].tolist() if n], int(x[k] + 0.5))
    while left.any():
        space, pattern = window, []
        spare = left.copy()
        while space > 0 and len(there := np.flatnonzero(spare[: space + 1])):
            pattern.append(int(there[-1]))
            spare[there[-1]] -= 1
            space -= int(there[-1])
        take(pattern, int(left.max()))
    return out


def _intervals(histogram: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """The plan by length and rank: from `first` on, a piece is in sequence + (rank - first) at offset."""
    done = np.zeros(window + 1, dtype=np.int64)
    rows, sequence = [(window, 0, 0, 0)], int(histogram[window])
    for lengths, times in plan(histogram, window):
        offset = 0
        for n in lengths:
            rows.append((n, int(done[n]), sequence, offset))
            done[n] += times
            offset += n
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "sequence", "offset"), np.array(rows, dtype=np.int64).T.copy(), strict=True))


def _placed(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.searchsorted(table["length"], np.arange(table["length"][-1] + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            k = np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts):
                if len(own):
                    a, b = starts[length[own[0]]], starts[length[own[0]] + 1]
                    k[own] = a + np.searchsorted(table["first"][a:b], rank[own], side="right") - 1
            keep = [batch.column(c) for c in ("doc_id", "start")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(length), *(batch.column(c) for c in ("ids_crc32", "doc_tokens")), pa.array(table["sequence"][k] + rank - table["first"][k]), pa.array(table["offset"][k])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def packed(docs: DataFrame, path: str, window: int = 2048, separator: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of docs (doc_id, text).

    path is the vocabulary file; each document's ids end in the separator. Null and empty texts are the separator alone.
    Rows are documents each, whatever their doc_id, null or repeated; pieces of equal length change places freely, and are
    taken in the order of their partitions. A text of any length is encoded whole and takes about 60 bytes of a task's memory
    for each of its own. Other columns are ignored, whatever their names. An empty table gives an empty result. Sequences are
    numbered from 0; all but those of the last patterns are full.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = cut(docs.mapInArrow(_pieces(path, window, separator), _PIECE))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row for each length at most
        histogram[length] = n
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        _placed(_intervals(histogram, window)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
