"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts gives each document's shingle-set size, a hash of the set, band keys of its minima and the
   minima's low bits packed into a short signature.
2. Documents with equal sets are one class, so that a group of copies is one vertex however large it is.
3. Classes that share a band key are candidates. Inside a bucket the similarity is estimated from bit counts of the
   signatures, corrected for chance collisions; what passes a bound four standard deviations below the threshold is kept
   as a spanning forest, never as all pairs.
4. The components of that graph are clusters that contain every link. Their members' full shingle sets meet once more,
   and links are confirmed by exact counts; again only a spanning forest leaves the task.
5. The components of the confirmed links are the result.

Buckets and clusters are cut into blocks of bounded size. Each block first meets itself and a few pivots of its group,
drawn by a hash. Members that hang together with the pivot that most of them join need not meet each other; only the rest
go on to the other blocks. So a group of n copies with small differences costs about n, not n * n, and no link is left out.

A pair at the threshold shares no band with probability (1 - 0.75**4)**32 = 6e-6, and fails the bound with 3e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .blocks import Forest, groups
from .common import components, cut, join_hot, pieces

U = np.uint64
#: Rows of a band block and shingles of a verification block: what one task holds of a bucket or cluster at once.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19
#: Pivots of a group of several blocks, about.
PIVOTS = 64


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's n-word shingles; the whole sequence if it has fewer words; empty if none."""
    h, at = T.word_hashes(column, lower=True)
    g = T.grams(h, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        else:
            out.append(T.grams(h[a:b], b - a) if b > a else np.empty(0, dtype=U))
    return out


def _minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash minima, a row for each set; none may be empty."""
    r = T.sequence(2 * count, 3)
    mul, add = (r[:count] >> U(32)).astype(np.uint32) | np.uint32(1), (r[count:] >> U(32)).astype(np.uint32)
    out = np.empty((len(sets), count), dtype=np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 1 << 16):
            n += len(sets[j])
            j += 1
        x = (T.mix(np.concatenate(sets[i:j])) >> U(32)).astype(np.uint32)
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets[i:j]])[:-1]))
        for k in range(count):
            out[i:j, k] = np.minimum.reduceat(x * mul[k] + add[k], at)
        i = j
    return out


def _pack(minima: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the minima, packed into unsigned 64-bit integers (bits: 1, 2, 4 or 8)."""
    per = 64 // bits
    low = (minima.astype(U) & U((1 << bits) - 1)).reshape(len(minima), -1, per)
    return (low << (np.arange(per, dtype=U) * U(bits))).sum(axis=2, dtype=U)


def estimate(one: np.ndarray, many: np.ndarray, bits: int) -> np.ndarray:
    """Similarity of one packed signature to many, corrected for lanes that agree by chance."""
    x = one ^ many
    step = 1
    while step < bits:
        x = x | (x >> U(step))
        step *= 2
    lane = U(sum(1 << i for i in range(0, 64, bits)))
    total = many.shape[1] * (64 // bits)
    equal = total - np.bitwise_count(x & lane).sum(axis=1, dtype=np.int64)
    chance = 0.5**bits
    return (equal / total - chance) / (1 - chance)


def _set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set of shingle hashes, from its size and two sums."""
    one, two = np.zeros(len(sets), dtype=U), np.zeros(len(sets), dtype=U)
    for k, s in enumerate(sets):
        x = T.mix(s)
        one[k], two[k] = x.sum(dtype=U), T.mix(x ^ U(0x5851F42D4C957F2D)).sum(dtype=U)
    return T.mix(one ^ T.mix(two + np.array([len(s) for s in sets], dtype=U)))


def _features(words: int, bands: int, rows: int, bits: int):
    @T.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in T.slices(batch.column(1)):
                part = batch.slice(i, j - i)
                sets = shingle_sets(part.column(1), words)
                full = [s for s in sets if len(s)]
                size = np.array([len(s) for s in sets], dtype=np.int64)
                sig, keys = [None] * len(sets), [None] * len(sets)
                if full:
                    m = _minima(full, bands * rows)
                    wide = T.mix(m.astype(U).reshape(len(full), bands, rows) * T.sequence(rows, 4) + T.sequence(bands, 5)[:, None])
                    key = T.mix(wide.sum(axis=2, dtype=U) + T.sequence(bands, 6)).view(np.int64)
                    packed = _pack(m, bits)
                    for k, r in enumerate(np.flatnonzero(size).tolist()):
                        sig[r], keys[r] = packed[k].tobytes(), key[k]
                v = pa.array(_set_hashes(sets).view(np.int64), mask=size == 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), v, pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "v", "sig", "bands"])

    return run


class _Soft:
    """Members of a bucket, near by their signatures."""

    def __init__(self, t: pa.Table, bits: int, bound: float, per_10000: int) -> None:
        self.sig, self.bits, self.bound = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=U).reshape(len(t), -1), bits, bound

    def candidates(self, i: int, rest: np.ndarray) -> np.ndarray:
        return rest[estimate(self.sig[i], self.sig[rest], self.bits) >= self.bound]

    def sure(self, i: int, j: int) -> bool:
        return True


class _Exact(_Soft):
    """Members of a cluster, near by exact counts of their sets."""

    def __init__(self, t: pa.Table, bits: int, bound: float, per_10000: int) -> None:
        super().__init__(t, bits, bound, per_10000)
        self.sets, self.per_10000 = [np.frombuffer(x, dtype=U) for x in t["hashes"].to_pylist()], per_10000
        self.size = np.array([len(s) for s in self.sets])

    def candidates(self, i: int, rest: np.ndarray) -> np.ndarray:
        n = self.size[rest]
        return super().candidates(i, rest[10_000 * np.minimum(n, self.size[i]) >= self.per_10000 * np.maximum(n, self.size[i])])

    def sure(self, i: int, j: int) -> bool:
        a, b = (self.sets[i], self.sets[j]) if self.size[i] > self.size[j] else (self.sets[j], self.sets[i])
        both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
        return 10_000 * both >= self.per_10000 * (len(a) + len(b) - both)


def _meet(forest: Forest, near: _Soft, i: int, rest: np.ndarray) -> None:
    rest = rest[forest.label[rest] != forest.label[i]]
    if len(rest):
        for j in near.candidates(i, rest).tolist():
            if forest.label[i] != forest.label[j] and near.sure(i, j):
                forest.join(i, j)


_TOLD = "a long, b long, grp long, v long, colour long"


def _told(edges: np.ndarray, grp: int = 0, ids: np.ndarray = (), colour: np.ndarray = ()) -> pa.RecordBatch:
    """Edges, and members with the pivot that they hang together with."""
    m, n = len(edges), len(ids)
    one = lambda x, k: pa.array(np.concatenate((x, np.zeros(k, np.int64))), mask=np.arange(m + n) >= m)
    two = lambda x: pa.array(np.concatenate((np.zeros(m, np.int64), x)).astype(np.int64), mask=np.arange(m + n) < m)
    c = np.concatenate((np.zeros(m, np.int64), colour)).astype(np.int64)
    missing = np.concatenate((np.ones(m, bool), np.asarray(colour) == 0)) if n else np.ones(m, bool)
    return pa.RecordBatch.from_arrays([one(edges[:, 0], n), one(edges[:, 1], n), two(np.full(n, grp)), two(np.asarray(ids)), pa.array(c, mask=missing)], names=["a", "b", "grp", "v", "colour"])


def _within(kind: type[_Soft], *limits):
    """Each block with itself and with its group's pivots."""

    @T.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["grp", "block"]):
            pivot = t["pivot"].to_numpy(zero_copy_only=False).astype(bool)
            v = t["v"].to_numpy()
            at = np.unique(np.where(pivot, 0, 1) + 2 * np.unique(v, return_inverse=True)[1], return_index=True)[1]  # one row for each role of a set
            t, v, pivot = t.take(pa.array(at)), v[at], pivot[at]
            near, forest = kind(t, *limits), Forest(len(v))
            for i in range(len(v)):
                _meet(forest, near, i, np.arange(i + 1, len(v)))
            edges = forest.stars(v)
            if t["blocks"][0].as_py() == 1:
                if len(edges):
                    yield _told(edges)
                continue
            low = np.zeros(len(v), np.int64)
            for k in np.flatnonzero(pivot).tolist():
                own = (forest.label == forest.label[k]) & (low == 0)
                low[own] = v[k]
            yield _told(edges, t["grp"][0].as_py(), v[~pivot], low[~pivot])

    return run


def _across(kind: type[_Soft], *limits):
    """A block's members with those that did not join most of the group's."""

    @T.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["grp", "block", "asks"]):
            asked = ~t["query"].to_numpy(zero_copy_only=False).astype(bool)
            v, near, forest = t["v"].to_numpy(), kind(t, *limits), Forest(len(t))
            colour = t["colour"].fill_null(0).to_numpy()
            for c in np.unique(colour[colour != 0]).tolist():  # these hang together already
                own = np.flatnonzero(colour == c)
                forest.label[own] = own[0]
            targets = np.flatnonzero(asked)
            for i in np.flatnonzero(~asked).tolist():
                _meet(forest, near, i, targets)
            edges = forest.stars(v)
            if len(edges):
                yield _told(edges)

    return run


def _sets(words: int):
    @T.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in T.slices(batch.column("text")):
                part = batch.slice(i, j - i)
                sets = shingle_sets(part.column("text"), words)
                mine = np.flatnonzero(_set_hashes(sets).view(np.int64) == part.column("v").to_numpy())  # a doc_id may have other texts
                if len(mine):
                    rest = [part.column(c).take(pa.array(mine)) for c in ("grp", "v", "sig", "block", "blocks", "members")]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([sets[k].tobytes() for k in mine], pa.binary())], names=["grp", "v", "sig", "block", "blocks", "members", "hashes"])

    return run


def _linked(rows: DataFrame, kind: type[_Soft], *limits) -> DataFrame:
    """A spanning forest (a, b) of the links inside groups, of rows (grp, v, block, blocks, members and what kind reads)."""
    n = pieces(rows.sparkSession)
    big = rows.filter("blocks > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pivots = big.filter(F.expr(f"pmod(xxhash64(v, 3), members) < {PIVOTS}")).withColumn("block", every)
    met = rows.withColumn("pivot", F.lit(False)).unionByName(pivots.withColumn("pivot", F.lit(True)))
    told = cut(met.drop("members").repartition(n, "grp", "block").sortWithinPartitions("grp", "block").mapInArrow(_within(kind, *limits), _TOLD))
    edges = told.filter("a is not null").select("a", "b")
    members = told.filter("a is null").select("grp", "v", "colour")
    if members.isEmpty():  # no group has several blocks
        return edges
    most = members.filter("colour is not null").groupBy("grp", "colour").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("colour", "n").alias("most"))
    rest = cut(members.join(most, "grp", "left").filter("colour is null or most is null or colour <> most").select("grp", "v", "colour"))
    if rest.isEmpty():
        return edges
    asks = rest.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("asking"))
    queries = big.join(rest, ["grp", "v"]).join(asks, "grp").withColumn("asks", F.expr("cast(pmod(xxhash64(v, 5), asking) as int)")).withColumn("block", every).withColumn("query", F.lit(True))
    targets = big.join(members, ["grp", "v"]).join(asks, "grp").withColumn("asks", F.explode(F.sequence(F.lit(0), F.col("asking") - 1))).withColumn("query", F.lit(False))
    both = targets.unionByName(queries).drop("asking", "blocks", "members").repartition(n, "grp", "block", "asks").sortWithinPartitions("grp", "block", "asks")
    return edges.union(both.mapInArrow(_across(kind, *limits), _TOLD).select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.75, bands: int = 32, rows: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Documents are linked whose sets of `words`-word shingles (A-Z folded; the whole sequence if shorter) have at least
    the similarity. component_id is the smallest doc_id reachable; kept marks that document.

    Null, empty or white texts have no shingles and link with nothing. Rows of one doc_id are linked with each other,
    whatever their texts, if these have words. A row without doc_id links with nothing, has no component_id and is kept.
    A text of any length is taken whole; it takes about 50 bytes of a task's memory for each of its own. There are no ties:
    every link counts, and repeated rows come out alike. An empty table gives an empty result; other columns of docs are
    ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    deviation = (similarity * (1 - similarity) / (bands * rows)) ** 0.5 / (1 - 0.5**bits)
    limits = (bits, similarity - 4.2 * deviation, round(10_000 * similarity))
    features = cut(docs.mapInArrow(_features(words, bands, rows, bits), "doc_id long, n_shingles long, v long, sig binary, bands array<long>"))
    real = features.filter("v is not null and doc_id is not null")
    classes = cut(real.groupBy("v").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))

    keys = classes.select(F.explode("bands").alias("grp"), "v")
    shared = keys.groupBy("grp").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = keys.join(shared, "grp").join(classes.select("v", "sig"), "v").withColumn("blocks", F.expr(f"cast(ceil(members / {BLOCK_ROWS}) as int)")).withColumn("block", F.expr("cast(pmod(xxhash64(v), blocks) as int)"))
    soft = components(_linked(buckets, _Soft, *limits))

    cluster = cut(soft.select("v", F.col("label").alias("grp")).join(classes.select("v", "doc_id", "n_shingles", "sig"), "v"))
    weight = cluster.groupBy("grp").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.count("*").alias("members"))
    placed = cluster.join(weight, "grp").select("grp", "doc_id", "v", "sig", F.expr("cast(pmod(xxhash64(v, 7), blocks) as int)").alias("block"), "blocks", "members")
    sets = docs.join(placed, "doc_id").mapInArrow(_sets(words), "grp long, v long, sig binary, block int, blocks int, members long, hashes binary")
    links = _linked(sets, _Exact, *limits)
    several = real.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("last")).filter("a < last").drop("last")
    several = real.select("doc_id", F.col("v").alias("b")).join(several, "doc_id").select("a", "b").distinct().filter("a <> b")

    found = components(links.union(several)).join(classes.select("v", "doc_id"), "v")
    low = found.select("v", "label").join(found.groupBy("label").agg(F.min("doc_id").alias("low")), "label").select("v", "low")
    facts = cut(classes.select("v", "copies", "doc_id").join(low, "v", "left").select("v", "copies", F.coalesce("low", "doc_id").alias("low")))
    mine = features.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("v")).alias("v"), F.monotonically_increasing_id().alias("row"))
    out = join_hot(mine, facts, "v", "copies", features.count(), "row")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))
