"""Batches of documents, and integers packed into columns: what operators send that would be too many rows.

A batch is some documents of a partition, written once so that all phases read the same. A phase explodes a batch into
hashes, states each distinct one once to the part of the hash range it belongs to, and is answered in the same order. A row
of such an exchange is one batch's share of one part, so a frequent hash meets as one entry for each batch and no key is
hot. The rows are batches times parts. With batches of 8 MB (1.3 million words) and parts of two million entries, 100 GB of
text make 10^8 rows of some 160 entries each. Both sizes should grow with the memory of an executor, of which a task takes
about 40 bytes for each byte of a batch and 30 for each entry of a part: at 100 TB, 128 MB and 64 million make 2 * 10^11 rows
of about 80 entries, which is 6 bytes an entry and one more for its share of the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import written

U = np.uint64
BATCH_BYTES, PART_ENTRIES = 8 << 20, 2_000_000
#: Most documents of a batch, which empty ones would otherwise fill without end.
BATCH_ROWS = 1 << 20
_BATCH = "batch long, words long, docs binary"


def schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(x: bytes) -> bytes:
    n = int.from_bytes(x[:8], "little")
    return pa.decompress(x[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def packed(a: np.ndarray) -> bytes:
    """Integers of 64 bits by planes of equal bytes, of which the high ones shrink to nothing."""
    return squeeze(np.ascontiguousarray(a.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(x: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(x), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(U).ravel()


def rising(h: np.ndarray) -> bytes:
    """Rising hashes as their differences."""
    return packed(np.diff(h, prepend=U(0)))


def risen(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x), dtype=U)


def parts(hashes: np.ndarray, count: int) -> np.ndarray:
    """Where sorted hashes pass from one of `count` equal parts of their range to the next: count + 1 offsets."""
    return np.searchsorted((hashes >> U(32)) * U(count) >> U(32), np.arange(count + 1, dtype=U))


def _batches(most: int):
    @T.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, nth, held, size, rows = TaskContext.get().partitionId() << 20, 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            n = sum(len(T.words(*T.flat(c.slice(i, j - i)))[0]) for c in t["text"].chunks for i, j in T.slices(c))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            return pa.RecordBatch.from_arrays([pa.array([first + nth]), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema(_BATCH))

        for batch in batches:
            for i, j in T.slices(batch.column(1)):
                part = batch.slice(i, j - i)
                now = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if held and (size + now > most or rows + len(part) > BATCH_ROWS):
                    yield flush()
                    nth, held, size, rows = nth + 1, [], 0, 0
                held.append(part)
                size, rows = size + now, rows + len(part)
        if held:
            yield flush()

    return run


def batches(docs: DataFrame, most: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """Batches (batch, words, docs) of documents (doc_id, text), null texts empty, and the number of all words."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = written(docs.mapInArrow(_batches(most), _BATCH), "batches")
    return out.select("batch", "docs"), out.agg(F.sum("words")).first()[0] or 0


class Documents:
    """A batch's documents, and the hashes of their words in order."""

    def __init__(self, docs: bytes, lower: bool) -> None:
        with pa.ipc.open_stream(docs) as r:
            t = r.read_all().combine_chunks()
        self.ids = t["doc_id"].combine_chunks()
        self.texts = t["text"].combine_chunks()
        h = [T.word_hashes(self.texts.slice(i, j - i), lower) for i, j in T.slices(self.texts)]
        self.words = np.concatenate([x[0] for x in h]) if h else np.empty(0, dtype=U)
        size = np.concatenate([np.diff(x[1]) for x in h]) if h else np.empty(0, np.int64)
        self.at = np.concatenate(([0], np.cumsum(size)))
        self.row = np.repeat(np.arange(len(size)), size)
        self.left = np.arange(len(self.words)) - self.at[self.row]
