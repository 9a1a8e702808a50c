"""Near-duplicate vectors by an inverted multi-index.

Each half of the (unit) vectors has a codebook of its own; the product of the two is a grid of cells, and each vector is
indexed in the cell of its nearest centres. A query visits cells by a multi-sequence traversal: with the centres of each
half sorted by their distance, the next cell is the nearest of a frontier that holds, for each centre of the first half,
its nearest unvisited partner. It stops when the target recall is reached: how many cells that takes is measured on pairs at
the threshold itself, the hardest there are, made from the fitting sample. Pairs found from either side are verified by
their cosine in double precision.

The codebooks grow with the root of the number of vectors, so that a cell holds about CELL of them, up to MOST centres a
half, which a million cells make. Equal vectors are one class, so a common vector costs no more than a rare one. Cells are
cut into blocks of members and of visiting queries, so a dense cell is many tasks; what leaves a task are counts by vector
and spanning edges, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .blocks import groups
from .common import components, cut, join_hot, pieces

U = np.uint64
#: Vectors that the codebooks are fitted on, at least and for each centre, and the largest blocks of members and queries of a cell.
FIT_ROWS, FIT_EACH, MEMBERS, QUERIES = 4096, 32, 1024, 4096
#: Vectors of a cell, about; most centres of a half; vectors of one length that need no grid.
CELL, MOST, FEW = 800, 1024, 256


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the most frequent length as unit vectors, and which rows those are.

    Null, zero and non-finite vectors, and those with null components, are none of them."""
    sizes = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
    if not len(sizes) or sizes.max() <= 0:
        return np.empty((0, 0)), np.empty(0, np.int64)
    values = column.flatten()
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    d = int(np.bincount(sizes[sizes > 0]).argmax())
    rows = np.flatnonzero(sizes == d)
    x = flat[at[rows][:, None] + np.arange(d)]
    good = np.isfinite(x).all(axis=1)
    x, rows = x[good], rows[good]
    scale = np.abs(x).max(axis=1, initial=0)
    x, rows, scale = x[scale > 0], rows[scale > 0], scale[scale > 0]
    x = x / scale[:, None]  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None], rows


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_pylist()
        for d in sorted({n for n in sizes if n}):
            own = batch.filter(pa.array([n == d for n in sizes]))
            x, rows = unit(own.column(1))
            if len(rows):
                x += 0.0  # no negative zeros: equal vectors are equal bytes
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "v"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def _codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's algorithm from rows drawn far apart."""
    r = np.random.default_rng(seed)
    centres = x[r.integers(len(x))][None].copy()
    while len(centres) < min(k, len(x)):
        near = _distances(x, centres).min(axis=1)
        total = near.sum()
        if total <= 0:
            break
        centres = np.concatenate((centres, x[r.choice(len(x), p=near / total)][None]))
    for _ in range(15):
        of = _distances(x, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = x[of == c].mean(axis=0)
    return centres


class Grid:
    """Two codebooks, and how many cells a query visits."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float) -> None:
        self.half = sample.shape[1] // 2
        self.books = [_codebook(sample[:, : self.half], k, 1), _codebook(sample[:, self.half :], k, 2)]
        self.visits = self._needed(sample[:FIT_ROWS], cosine, recall)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of each row's halves to their centres."""
        return _distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])

    def order(self, x: np.ndarray, cells: int) -> np.ndarray:
        """The nearest cells of each row, nearest first, by a multi-sequence traversal of all rows in step.

        Of the sorted centres of the first half, the i-th has been paired with the first next_[i] of the second. Its next pair
        can be the nearest unvisited one only if the centre before it is further on; ties go to the smaller i."""
        one, two = self.halves(x)
        by_one, by_two = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        one, two = np.take_along_axis(one, by_one, 1), np.take_along_axis(two, by_two, 1)
        rows, width, last = np.arange(len(x)), min(one.shape[1], cells), two.shape[1]
        two = np.concatenate((two, np.full((len(x), 1), np.inf)), axis=1)
        next_ = np.zeros((len(x), width), dtype=np.int64)
        front = np.full((len(x), width), np.inf)
        front[:, 0] = one[:, 0] + two[:, 0]
        out = np.empty((len(x), min(cells, one.shape[1] * last)), dtype=np.int64)
        for n in range(out.shape[1]):
            i = front.argmin(axis=1)
            out[:, n] = by_one[rows, i] * last + by_two[rows, next_[rows, i]]
            next_[rows, i] += 1
            front[rows, i] = one[rows, i] + two[rows, next_[rows, i]]
            after = np.minimum(i + 1, width - 1)
            opens = (i + 1 < width) & np.isinf(front[rows, after]) & (next_[rows, after] == 0)
            front[rows[opens], after[opens]] = one[rows[opens], after[opens]] + two[rows[opens], 0]
        return out

    def _needed(self, sample: np.ndarray, cosine: float, recall: float) -> int:
        """Cells until the target share of pairs at the threshold has been met from at least one side."""
        r = np.random.default_rng(3)
        noise = r.standard_normal(sample.shape)
        noise -= (noise * sample).sum(1)[:, None] * sample
        noise /= np.maximum(np.sqrt((noise * noise).sum(1))[:, None], 1e-300)
        other = cosine * sample + (1 - cosine**2) ** 0.5 * noise
        ranks = []
        for x, y in ((sample, other), (other, sample)):
            one, two = self.halves(x)
            at_one, at_two = (d.argmin(axis=1) for d in self.halves(y))
            home = one[np.arange(len(x)), at_one] + two[np.arange(len(x)), at_two]
            ranks.append(np.array([np.searchsorted(np.sort(b), s - a, side="left").sum() for a, b, s in zip(one, two, home, strict=True)]))
        return int(np.quantile(np.minimum(*ranks), recall, method="higher")) + 1


def _indexed(grid: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                order = grid.order(_matrix(batch.column(1)), grid.visits)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order[:, 0].astype(np.int32)), cells], names=["rep", "v", "copies", "home", "cells"])

    return run


def _verified(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["cell", "mb", "qb"]):
            kind = t["query"].to_numpy(zero_copy_only=False).astype(bool)
            if kind.all() or not kind.any():
                continue
            m, q = t.filter(pa.array(~kind)), t.filter(pa.array(kind))
            mi, qi = m["rep"].to_numpy(), q["rep"].to_numpy()
            mc, qc = m["copies"].to_numpy(), q["copies"].to_numpy()
            near = _matrix(q["v"]) @ _matrix(m["v"]).T >= cosine
            near &= qi[:, None] != mi[None, :]
            home = q["home"].to_numpy()
            # a pair is met twice if the member's own traversal comes by the query's cell: then each side is told about its
            # partner by its own visit, else the member is told here
            cells = m["cells"].combine_chunks().flatten().to_numpy().reshape(len(mi), -1)
            back = near.copy()
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                own = np.flatnonzero(near[k])
                back[k, own] = ~(cells[own] == home[k]).any(axis=1)
            told_q, told_m = (near * mc).sum(axis=1), (back * qc[:, None]).sum(axis=0)
            ids, links = np.concatenate((qi, mi)), np.concatenate((told_q, told_m))
            low = _low_labels(near, qi, mi)
            some = (links > 0) | (low != ids)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(low[some])], names=["rep", "links", "low"])

    return run


def _low_labels(near: np.ndarray, qi: np.ndarray, mi: np.ndarray) -> np.ndarray:
    """For each query and then each member, the smallest id it reaches through the pairs of this block."""
    q, m = qi.copy(), mi.copy()
    big = np.iinfo(np.int64).max
    rows, cols = np.nonzero(near)
    while len(rows):
        new_q, new_m = q.copy(), m.copy()
        low_q, low_m = np.full(len(q), big), np.full(len(m), big)
        np.minimum.at(low_q, rows, m[cols])
        np.minimum.at(low_m, cols, q[rows])
        new_q, new_m = np.minimum(q, low_q), np.minimum(m, low_m)
        if (new_q == q).all() and (new_m == m).all():
            break
        q, m = new_q, new_m
    return np.concatenate((q, m))


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of rare lengths, in one cell for each length."""
    for b in batches:
        cell = pa.array(np.array([-len(v) for v in b.column(1).to_pylist()], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*b.columns, cell, pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32)), cell)], names=["rep", "v", "copies", "home", "cells"])


def _met(indexed: DataFrame) -> DataFrame:
    """Members and visiting queries of each cell, in blocks."""
    members = indexed.groupBy("home").agg(F.count("*").alias("n")).select(F.col("home").alias("cell"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("mbs"))
    asked = indexed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qbs"))
    blocks = F.broadcast(members.join(asked, "cell"))  # a row for each cell: MOST * MOST of 12 bytes at most
    mine = indexed.withColumn("cell", F.col("home")).join(blocks, "cell").withColumn("mb", F.expr("cast(pmod(xxhash64(rep), mbs) as int)")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1))).withColumn("query", F.lit(False))
    theirs = indexed.withColumn("cell", F.explode("cells")).join(blocks, "cell").withColumn("qb", F.expr("cast(pmod(xxhash64(rep, 1), qbs) as int)")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("mbs") - 1))).withColumn("query", F.lit(True)).withColumn("cells", F.lit(None).cast("array<int>"))
    cols = ["cell", "mb", "qb", "query", "rep", "v", "copies", "home", "cells"]
    return mine.select(*cols).union(theirs.select(*cols)).repartition(pieces(indexed.sparkSession), "cell", "mb", "qb").sortWithinPartitions("cell", "mb", "qb")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors.

    n_links counts the other vectors at the cosine or above that were found; component_id is the smallest vec_id
    reachable by links; kept marks that vector. Null, zero and non-finite vectors link with nothing, as do those without
    vec_id (which have no component and are kept); vectors of different lengths don't link with each other, and those of a
    length that FEW or less have are compared with all of that length. Rows of one vec_id with equal vectors are one; with
    different ones they are linked as one vertex, with the largest of their counts. Equally near centres are taken in their
    order, which is that of the codebook. An empty table gives an empty result; other columns of vectors are ignored,
    whatever their names.
    """
    all_ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id"))
    normal = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).filter("vec_id is not null").mapInArrow(_normal, "vec_id long, v binary")
    rows = cut(normal.dropDuplicates(["vec_id", "v"]).withColumn("row", F.monotonically_increasing_id()))
    classes = cut(rows.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    sizes = classes.groupBy(F.octet_length("v").alias("size")).agg(F.count("*").alias("n"))
    found, schema = None, "rep long, v binary, copies long, home int, cells array<int>"
    for size, n in sizes.filter(F.col("n") > FEW).orderBy("size").collect():  # lengths that over FEW vectors have
        part = classes.filter(F.octet_length("v") == size).select("rep", "v", "copies")
        k = int(np.clip(np.ceil((n / CELL) ** 0.5), 2, MOST))
        want = max(FIT_ROWS, FIT_EACH * k)
        sample = _matrix(part.filter(F.expr(f"pmod(xxhash64(v), 4294967296) < {min(1.0, want / n) * 2**32:.0f}")).select("v").orderBy("v").limit(2 * want).toArrow().column("v"))
        grid = Grid(sample if len(sample) else np.eye(1, size // 8), k, cosine, recall)
        got = _met(cut(part.mapInArrow(_indexed(grid), schema))).mapInArrow(_verified(cosine), "rep long, links long, low long")
        found = got if found is None else found.union(got)
    rare = sizes.filter(F.col("n") <= FEW).select("size")
    few = cut(classes.withColumn("size", F.octet_length("v")).join(rare, "size").select("rep", "v", "copies").mapInArrow(_alone, schema))
    got = _met(few).mapInArrow(_verified(cosine), "rep long, links long, low long")
    found = cut(got if found is None else found.union(got))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = cut(classes.join(counts, "rep", "left").select("v", "copies", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    of = cut(join_hot(rows, facts, "v", "copies", rows.count(), "row").select("vec_id", "rep", "links"))
    several = of.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a < last").select("vec_id", "a")
    several = of.join(several, "vec_id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    label = components(found.filter("low <> rep").select(F.col("rep").alias("a"), F.col("low").alias("b")).union(several)).join(classes.select(F.col("rep").alias("v"), "low"), "v")
    lows = label.select(F.col("v").alias("rep"), "label").join(label.groupBy("label").agg(F.min("low").alias("low")), "label").select("rep", "low")
    # components are of classes; what most classes have is their own smallest id
    facts = cut(classes.join(lows.withColumnRenamed("low", "all_low"), "rep", "left").select("rep", "copies", F.coalesce("all_low", "low").alias("low")))
    of = join_hot(of.withColumn("row", F.monotonically_increasing_id()), facts, "rep", "copies", of.count(), "row")
    of = of.groupBy("vec_id").agg(F.max("links").alias("n_links"), F.min("low").alias("component_id"))
    out = all_ids.join(of, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(True)))
