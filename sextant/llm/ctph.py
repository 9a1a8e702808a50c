"""Context-triggered piecewise hashes of texts, and how alike two of them are.

A rolling hash over seven bytes ends a chunk wherever it is one less than a multiple of the block size; each chunk
gives one of 64 characters. A fingerprint is `size:signature:signature at twice the size`; the block size is the
largest of 3, 6, 12, ... at which the text is expected to have 64 chunks, made smaller while it has too few. The last
of 64 characters stands for all that is left, so nothing of a text is left out.

Fingerprints compare at equal block sizes, or where one's is twice the other's, by the edit distance of insertions and
deletions; signatures that share no run of seven characters are not alike.

Each document is also compared with the next one by doc_id. Documents are sorted by ranges, so a task sees its
documents' neighbours as they pass; only the first and last of each range meet in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut, pieces

U = np.uint64
WINDOW, SMALLEST, LENGTH, RUN = 7, 3, 64, 7
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_BYTES = (T.sequence(256, 11) >> U(32)).astype(np.uint32)
_FACTORS = (T.sequence(WINDOW, 12) >> U(32)).astype(np.uint32) | np.uint32(1)


def _levels(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte, 1 + the k of the largest block size 3 * 2**k at which a chunk ends there; 0: at none."""
    t = _BYTES[buf]
    r = np.zeros(len(buf), dtype=np.uint32)
    since = np.arange(len(buf)) - np.repeat(at[:-1], np.diff(at))
    for k in range(WINDOW):
        if k < len(buf):
            r[k:] += np.where(since[k:] >= k, t[: len(buf) - k] * _FACTORS[k], np.uint32(0))
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x2C1B3C6D)
    r ^= r >> np.uint32(13)
    third, rest = np.divmod(r, np.uint32(SMALLEST))
    v = third.astype(U) + U(1)
    zeros = np.bitwise_count((v & (~v + U(1))) - U(1))
    return np.where(rest == SMALLEST - 1, 1 + np.minimum(zeros, 40), 0).astype(np.int8)


def _signatures(buf: np.ndarray, at: np.ndarray, levels: np.ndarray, wanted: np.ndarray) -> list[bytes]:
    """Each row's signature at its wanted level."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    ends = np.flatnonzero(levels > wanted[row])
    nth = np.arange(len(ends)) - np.searchsorted(ends, at[:-1])[row[ends]]
    ends = ends[nth < LENGTH - 1] + 1
    ends = np.union1d(ends, at[1:][np.diff(at) > 0])
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    letters = _CHARS[(T.hash_spans(buf, starts, ends, lower=False) >> U(58)).astype(np.int64)] if len(ends) else np.empty(0, np.uint8)
    first = np.searchsorted(ends, at, side="right")
    raw = letters.tobytes()
    return [raw[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def fingerprints(texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
    """Block size and the two signatures of each text."""
    out: list[tuple[int, bytes, bytes]] = []
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= 1 << 20):
            n += len(texts[j])
            j += 1
        buf = np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts[i:j]]))).astype(np.int64)
        levels = _levels(buf, at)
        size = np.diff(at)
        level = np.zeros(j - i, dtype=np.int64)
        while (big := SMALLEST * 2.0**level * LENGTH < size).any():
            level[big] += 1
        row = np.repeat(np.arange(j - i), size)
        some = np.flatnonzero(levels)
        counts = np.bincount(row[some] * 64 + levels[some], minlength=64 * (j - i)).reshape(j - i, 64)
        beyond = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # chunk ends at a level and above
        few = np.ones(j - i, bool)
        while (few := few & (level > 0) & (beyond[np.arange(j - i), level + 1] < LENGTH // 2)).any():
            level[few] -= 1
        one, two = _signatures(buf, at, levels, level), _signatures(buf, at, levels, level + 1)
        out += [(SMALLEST << k, a, b) for k, a, b in zip(level.tolist(), one, two, strict=True)]
        i = j
    return out


def _runs(s: bytes, n: int) -> set[bytes]:
    return {s[k : k + n] for k in range(len(s) - n + 1)}


def _alike(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Twice the longest common subsequence over both lengths, which is 1 less the scaled edit distance; bit-parallel."""
    out = np.zeros(len(pairs))
    todo = []
    for k, (a, b) in enumerate(pairs):
        if a == b:
            out[k] = 1.0
        elif a and b:
            n = min(RUN, max(1, min(len(a), len(b)) // 2))
            if not _runs(a, n).isdisjoint(_runs(b, n)):
                todo.append(k)
    for i in range(0, len(todo), 4096):
        own = todo[i : i + 4096]
        m = len(own)
        a = np.frombuffer(b"".join(pairs[k][0].ljust(LENGTH, b"\0") for k in own), dtype=np.uint8).reshape(m, LENGTH)
        b = np.frombuffer(b"".join(pairs[k][1].ljust(LENGTH, b"\1") for k in own), dtype=np.uint8).reshape(m, LENGTH)
        mask = np.zeros((m, 128), dtype=U)
        r = np.arange(m)
        for j in range(LENGTH):
            mask[r, a[:, j]] |= U(1 << j)
        v = np.full(m, ~U(0))
        for j in range(LENGTH):
            u = v & mask[r, b[:, j]]
            v = (v + u) | (v - u)
        lcs = np.bitwise_count(~v)
        out[own] = 2 * lcs / np.array([len(pairs[k][0]) + len(pairs[k][1]) for k in own])
    return out


def likeness(one: list[tuple[int, bytes, bytes]], two: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """How alike fingerprints are, 0 to 1: the larger of the comparisons at sizes that both have."""
    pairs, of = [], []
    for k, ((n, a, a2), (m, b, b2)) in enumerate(zip(one, two, strict=True)):
        both = [(a, b), (a2, b2)] if n == m else [(a, b2)] if n == 2 * m else [(a2, b)] if m == 2 * n else []
        pairs += both
        of += [k] * len(both)
    out = np.zeros(len(one))
    np.maximum.at(out, np.array(of, dtype=np.int64), _alike(pairs))
    return out


def _spelt(f: tuple[int, bytes, bytes]) -> str:
    return f"{f[0]}:{f[1].decode()}:{f[2].decode()}"


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _compared(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The result's columns for documents and the texts that come next."""
    edited = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode() for t, n in zip(texts, following, strict=True)]
    new = fingerprints(edited)
    if following[:-1] == texts[1:]:  # neighbours in order: each is fingerprinted once
        own = fingerprints([t.encode() for t in [*texts, following[-1]]])
        own, after = own[:-1], own[1:]
    else:
        own, after = fingerprints([t.encode() for t in texts]), fingerprints([n.encode() for n in following])
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([_spelt(f) for f in own], pa.string()), pa.array([_spelt(f) for f in new], pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, after)),
    ]


@T.frugal
def _sorted_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results for all but the last document of the partition; that one's text and the first one's on rows of their own."""
    part = TaskContext.get().partitionId()
    names = [*_NAMES, "part", "place", "text"]
    last: tuple | None = None

    def ends(place: str, doc_id, text: str) -> pa.RecordBatch:
        row = {"doc_id": doc_id, "part": part, "place": place, "text": text}
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in zip(names, types, strict=True)], names=names)

    for batch in batches:
        for i, j in T.slices(batch.column(1)):
            ids, texts = batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()
            if last is None:
                yield ends("first", None, texts[0])
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = (ids[-1], texts[-1])
            if len(ids) > 1:
                got = _compared(ids[:-1], texts[:-1], texts[1:])
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([*got, pa.array([part] * n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
    if last is not None:
        yield ends("last", *last)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in T.slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays(_compared(*(batch.column(k).slice(i, j - i).to_pylist() for k in range(3))), names=_NAMES)


def compared_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs (doc_id, text).

    The next document is the one with the next larger doc_id, after the last the first; null ids come last, and rows of
    one id are ordered by a hash of their text. A single document is its own next. Null texts are empty; an empty text
    has no chunks and is like another empty one only. Rows of one id and one text are alike, so their order among each other
    changes nothing. A text of any length is taken whole, with its neighbour, and takes about 60 bytes of a task's memory for
    each of their own. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows alike in id and text may lie in any order, so where they are read from parts them: many share no range
    docs = docs.withColumn("at", F.monotonically_increasing_id())
    by = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.col("at")]
    schema = f"{_RESULT}, part long, place string, text string"
    runs = cut(docs.repartitionByRange(pieces(spark), *by).sortWithinPartitions(*by).select("doc_id", "text").mapInArrow(_sorted_run, schema))
    parts = sorted(r["part"] for r in runs.filter("place = 'first'").select("part").collect())  # a number for each range
    edges = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, next long")
    last = runs.filter("place = 'last'").select("doc_id", F.col("text"), "part").join(edges, "part")
    first = runs.filter("place = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    rest = last.join(first, "next").select("doc_id", "text", "following").mapInArrow(_joined, _RESULT)
    return runs.filter("place is null").select(*_NAMES).unionByName(rest)
