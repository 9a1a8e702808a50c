"""Removal of repeated passages by compaction of a De Bruijn graph of words.

An edge of the graph is a window of `window` consecutive words; it leads from the node of its first words to that of its
last. Edges that occur in two documents count. An edge's source is its first occurrence in the document with the smallest
doc_id, and its source coordinates (that row and the position there) name it; the node between two neighbouring edges of
a source has the later one's coordinates.

1. Minimizers. Each window has a smallest word `minimizer`-gram; equal windows have the same one. Batches of documents state
   theirs to parts of the hash range, and learn which of them other documents have: most windows go no further.
2. Edges. Windows with a shared minimizer are stated with their occurrences; the part finds the source of each edge, and
   answers.
3. Paths. A document's walk along edges is contracted where it stands while the next edge follows in source coordinates;
   where another path enters or leaves, the node branches, and the walk goes on from there as another. What is left of the
   graph are the nodes at which contracted walks begin or end: branching ones, with the numbers of walks that leave and enter
   them. They are far fewer than edges, and of a source not more than it has words, however many copy it.
4. Verification. The source gives each of its nodes a second, independent hash of its words up to there. Walks are joined
   to the nodes at both their ends; the difference must be the hash of the words that the walk itself goes over. Only
   spans that agree are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as E
from . import text as T
from .common import cut, join_hot

U = np.uint64
#: Bits of a row's number in its batch, in the number that names the row.
ROW = 23
_STATED = "part int, batch long, hashes binary, more binary, ids binary, rows binary, pos binary"
_ANSWER = "batch long, kind int, part int, ids binary, places binary, pos binary"
_WALK = "place long, start long, length long, src_place long, src_start long, check long"
_NODE = "place long, coordinate long, walks long, prefix long"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _windows(h: np.ndarray, row: np.ndarray, window: int, minimizer: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows inside rows, and the minimizer of each."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, dtype=U)
    low = T.grams(h, minimizer, seed=1)
    left, span = window - minimizer + 1, 1
    while span < left:
        step = min(span, left - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    start = np.flatnonzero(row[: len(low)] == row[window - 1 :])
    return start, low[start]


class _Walked(E.Documents):
    """A batch's documents as walks along edges."""

    def __init__(self, docs: bytes, window: int, minimizer: int) -> None:
        super().__init__(docs, lower=False)
        if len(self.at) > 1 << ROW:
            raise ValueError(f"{len(self.at) - 1} documents in a batch")
        self.window = window
        self.id = np.asarray(self.ids.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        named = ~np.asarray(self.ids.is_null().to_numpy(zero_copy_only=False), dtype=bool)
        start, low = _windows(self.words, self.row, window, minimizer)
        keep = named[self.row[start]] if len(start) else np.empty(0, bool)
        self.start, low = start[keep], low[keep]
        self.minimizers, self.of_minimizer = np.unique(low, return_inverse=True)

    def several(self) -> np.ndarray:
        """Whether two documents of the batch have a minimizer."""
        id_ = self.id[self.row[self.start]]
        order = np.argsort(self.of_minimizer, kind="stable")
        first = np.searchsorted(self.of_minimizer[order], np.arange(len(self.minimizers)))
        return np.minimum.reduceat(id_[order], first) < np.maximum.reduceat(id_[order], first) if len(first) else np.empty(0, bool)

    def edges(self, shared: np.ndarray) -> None:
        """Takes windows whose minimizer is shared, and their distinct hashes."""
        self.start = self.start[shared[self.of_minimizer]]
        self.edge, self.of_edge = np.unique(T.grams(self.words, self.window)[self.start] if len(self.start) else np.empty(0, U), return_inverse=True)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct edge its first window in the document of smallest id, and the smallest and largest id."""
        id_ = self.id[self.row[self.start]]
        order = np.lexsort((self.start, id_, self.of_edge))
        of = self.of_edge[order]
        first, last = np.searchsorted(of, np.arange(len(self.edge))), np.searchsorted(of, np.arange(len(self.edge)), side="right") - 1
        return self.start[order][first], id_[order][first], id_[order][last]

    def prefixes(self, row: int) -> np.ndarray:
        """Hashes of a row's words up to each of its nodes, independent of the windows' hashes."""
        h = self.words[self.at[row] : self.at[row + 1]]
        p, _ = T._power_table(len(h) + 1)
        return np.concatenate((np.zeros(1, U), np.cumsum(T.mix(h ^ U(0xA0761D6478BD642F)) * p[: len(h)], dtype=U)))


def _shifted(prefix: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Differences of prefixes as if their span began with its row."""
    _, q = T._power_table(int(start.max(initial=0)) + 1)
    return prefix * q[start]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def _stated(batch: int, hashes: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Sorted hashes and what goes with them, a row for each part that has some."""
    at = E.parts(hashes, parts)
    full = np.flatnonzero(np.diff(at))
    spans = [(at[k], at[k + 1]) for k in full]
    blobs = [[E.rising(hashes[i:j]) for i, j in spans], *([E.packed(c[i:j]) for i, j in spans] for c in columns)]
    blobs += [[None] * len(full)] * (5 - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([batch] * len(full), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], schema=E.schema(_STATED))


def _minimizers(window: int, minimizer: int, parts: int):
    @T.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in _each(batches):
            w = _Walked(docs, window, minimizer)
            yield _stated(batch, w.minimizers, parts, w.several())

    return run


def _met(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a part's statements, the order that sorts them, and where each distinct one begins there."""
    hashes = np.concatenate([E.risen(x) for x in rows["hashes"].to_pylist()])
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    return hashes, order, np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([E.unpacked(x) for x in rows[name].to_pylist()]).astype(np.int64)


def _answers(rows: pa.Table, kind: int, sizes: list[int], *columns: np.ndarray) -> pa.Table:
    at = np.cumsum([0, *sizes])
    blobs = [[E.packed(c[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)] for c in columns]
    blobs += [[None] * len(sizes)] * (3 - len(blobs))
    return pa.Table.from_arrays([rows["batch"].combine_chunks(), pa.array([kind] * len(rows), pa.int32()), rows["part"].combine_chunks(), *(pa.array(x, pa.binary()) for x in blobs)], schema=E.schema(_ANSWER))


def _shared(rows: pa.Table) -> pa.Table:
    """Which minimizers of a part two documents have, or two batches: the edges tell."""
    sizes = [len(E.unpacked(x)) for x in rows["hashes"].to_pylist()]
    hashes, order, first = _met(rows)
    n = np.diff(np.append(first, len(hashes)))
    many = (np.add.reduceat(_column(rows, "more")[order], first) > 0) | (n > 1)
    out = np.empty(len(hashes), np.int64)
    out[order] = np.repeat(many, n)
    return _answers(rows, 0, sizes, out)


def _sources(rows: pa.Table) -> pa.Table:
    """The source of each edge of a part that two documents have: doc_id, 1 + the row's number, position; else 0."""
    sizes = [len(E.unpacked(x)) for x in rows["hashes"].to_pylist()]
    hashes, order, first = _met(rows)
    ids, pos = _column(rows, "ids"), _column(rows, "pos")
    place = (np.repeat(np.array(rows["batch"].to_pylist(), np.int64), sizes) << ROW) + _column(rows, "rows")
    group = np.empty(len(hashes), np.int64)
    n = np.diff(np.append(first, len(hashes)))
    group[order] = np.repeat(np.arange(len(first)), n)
    best = np.lexsort((place, ids, group))[first]
    high = np.maximum.reduceat((ids + _column(rows, "more"))[order], first)
    repeated = (ids[best] < high)[group]
    best = best[group]
    return _answers(rows, 1, sizes, *(np.where(repeated, x[best], 0) for x in (ids, place + 1, pos)))


def _answer(t: pa.Table, kind: int, name: str) -> np.ndarray:
    """A batch's answers in the order of its sorted hashes."""
    own = t.filter(pa.compute.equal(t["kind"], kind)).sort_by("part")
    return np.concatenate([np.empty(0, U), *(E.unpacked(x) for x in own[name].to_pylist())]).astype(np.int64)


def _edges(window: int, minimizer: int, parts: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = [E.schema(_STATED).empty_table()]
        for batch, raw in zip(docs["batch"].to_pylist(), docs["docs"].to_pylist(), strict=True):
            w = _Walked(raw, window, minimizer)
            w.edges(_answer(answers, 0, "ids") > 0)
            first, low, high = w.occurrences()
            row = w.row[first]
            out.append(pa.Table.from_batches([_stated(batch, w.edge, parts, high - low, low, row, first - w.at[row])]))
        return pa.concat_tables(out)

    return run


def _walks(window: int, minimizer: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = [E.schema(_WALK).empty_table()]
        for batch, raw in zip(docs["batch"].to_pylist(), docs["docs"].to_pylist(), strict=True):
            w = _Walked(raw, window, minimizer)
            w.edges(_answer(answers, 0, "ids") > 0)
            src, place, pos = (_answer(answers, 1, c)[w.of_edge] for c in ("ids", "places", "pos"))
            start, row = w.start, w.row[w.start] if len(w.start) else np.empty(0, np.int64)
            later = (place > 0) & (src < w.id[row]) if len(row) else np.empty(0, bool)
            start, row, place, pos = start[later], row[later], place[later] - 1, pos[later]
            if not len(start):
                continue
            new = np.append(True, (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (pos[1:] != pos[:-1] + 1))
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(start))) + window - 1
            check = np.empty(len(first), dtype=U)
            begin = start[first] - w.at[row[first]]
            for r in np.unique(row[first]).tolist():
                own = row[first] == r
                p = w.prefixes(r)
                check[own] = _shifted(p[begin[own] + length[own]] - p[begin[own]], begin[own])
            own_place = (np.int64(batch) << ROW) + row[first]
            out.append(pa.Table.from_arrays([pa.array(x) for x in (own_place, begin, length, place[first], pos[first], check.view(np.int64))], schema=E.schema(_WALK)))
        return pa.concat_tables(out)

    return run


def _node_prefixes(window: int, minimizer: int):
    def run(key: tuple, docs: pa.Table, nodes: pa.Table) -> pa.Table:
        if not docs.num_rows or not nodes.num_rows:
            return E.schema(_NODE).empty_table()
        w = _Walked(docs["docs"][0].as_py(), window, minimizer)
        row, at = nodes["place"].to_numpy() & ((1 << ROW) - 1), nodes["coordinate"].to_numpy()
        out = np.empty(len(row), dtype=U)
        order = np.argsort(row, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
            out[own] = w.prefixes(int(row[own[0]]))[at[own]]
        return pa.Table.from_arrays([*(nodes[c].combine_chunks() for c in ("place", "coordinate", "walks")), pa.array(out.view(np.int64))], schema=E.schema(_NODE))

    return run


def _removed(key: tuple, docs: pa.Table, walks: pa.Table) -> pa.Table:
    out = [E.schema(_RESULT).empty_table()]
    for raw in docs["docs"].to_pylist():
        with pa.ipc.open_stream(raw) as r:
            t = r.read_all().combine_chunks()
        row = walks["place"].to_numpy() & ((1 << ROW) - 1)
        start, length, src, check, low, high = (walks[c].to_numpy() for c in ("start", "length", "src_start", "check", "low", "high"))
        good = _shifted((high - low).view(U), src) == check.view(U)
        row, start, length = row[good], start[good], length[good]
        texts = t["text"].combine_chunks()
        for i, j in T.slices(texts):
            buf, at_byte = T.flat(texts.slice(i, j - i))
            starts, ends, at = T.words(buf, at_byte)
            own = (row >= i) & (row < j)
            gone = np.zeros(len(starts) + 1, dtype=np.int64)
            a = at[row[own] - i] + start[own]
            np.add.at(gone, a, 1)
            np.add.at(gone, a + length[own], -1)
            out.append(pa.Table.from_arrays([t["doc_id"].slice(i, j - i).combine_chunks(), *_kept(buf, starts, ends, at, np.cumsum(gone)[:-1] == 0)], schema=E.schema(_RESULT)))
    return pa.concat_tables(out)


def _kept(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, keep: np.ndarray) -> list[pa.Array]:
    """Words, removed words and the hash of the kept ones, of each row."""
    edge = np.zeros(len(buf) + 2, dtype=np.int8)
    edge[starts[keep]] += 1
    edge[ends[keep] + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0  # kept words, each with the byte behind it
    n = np.diff(at)
    kept = np.diff(np.concatenate(([0], np.cumsum(keep)))[at])
    sha = []
    for r in range(len(n)):
        own = np.flatnonzero(keep[at[r] : at[r + 1]]) + at[r]
        if not len(own):
            sha.append(hashlib.sha256(b"").hexdigest())
            continue
        a, b = starts[own[0]], ends[own[-1]]
        piece = buf[a:b].copy()
        piece[ends[own[:-1]] - a] = 0x20
        sha.append(hashlib.sha256(piece[inside[a:b]].tobytes()).hexdigest())
    return [pa.array(n), pa.array(n - kept), pa.array(sha, pa.string())]


def repeated_walks(texts: DataFrame, words: int, window: int = 13, minimizer: int = 7, part_entries: int = E.PART_ENTRIES) -> DataFrame:
    """Contracted walks along edges whose source is a document with a smaller doc_id, of batches of documents: place (of the
    row), start, length in words, src_place, src_start, check (a hash of the words)."""
    parts = max(1, -(-words // (4 * part_entries)))  # of the windows, about a quarter have a minimizer of their own
    low = texts.mapInArrow(_minimizers(window, minimizer, parts), _STATED)
    shared = cut(low.groupBy("part").applyInArrow(_shared, _ANSWER))
    parts = max(1, -(-words // part_entries))
    edges = texts.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(_edges(window, minimizer, parts), _STATED)
    sources = cut(edges.groupBy("part").applyInArrow(_sources, _ANSWER))
    return cut(texts.groupBy("batch").cogroup(shared.union(sources).groupBy("batch")).applyInArrow(_walks(window, minimizer), _WALK))


def nodes_of(walks: DataFrame) -> DataFrame:
    """Nodes of the contracted graph: place, coordinate, and the numbers of walks that leave and enter them."""
    ends = F.explode(F.array(F.struct(F.col("src_start").alias("coordinate"), F.lit(1).alias("leave"), F.lit(0).alias("enter")), F.struct((F.col("src_start") + F.col("length")).alias("coordinate"), F.lit(0).alias("leave"), F.lit(1).alias("enter"))))
    return walks.select(F.col("src_place").alias("place"), ends.alias("e")).groupBy("place", "e.coordinate").agg(F.sum("e.leave").alias("leave"), F.sum("e.enter").alias("enter"))


def remove_repeats(docs: DataFrame, window: int = 13, minimizer: int = 7, batch_bytes: int = E.BATCH_BYTES, part_entries: int = E.PART_ENTRIES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs (doc_id, text).

    A word goes if a window of the input over it also starts in a document with a smaller doc_id. kept_sha256 is of the
    kept words joined by single spaces. A null or empty text has no words; a row without doc_id loses none; rows of one
    doc_id are judged alike and don't remove each other's words; of those with the same window the first in the order of
    batches is its source, which changes no result. A text of any length is taken whole and takes about 60 bytes of a task's
    memory for each of its own. An empty table gives an empty result; other columns of docs are ignored, whatever their names.
    """
    texts, words = E.batches(docs, batch_bytes)
    walks = repeated_walks(texts, words, window, minimizer, part_entries).withColumn("_row", F.monotonically_increasing_id())
    nodes = nodes_of(walks).selectExpr("place", "coordinate", "leave + enter AS walks", f"place div {1 << ROW} AS batch")
    told = cut(texts.groupBy("batch").cogroup(nodes.groupBy("batch")).applyInArrow(_node_prefixes(window, minimizer), _NODE))
    name = lambda place, at: F.concat_ws(":", place, at)
    facts = cut(told.select(name("place", "coordinate").alias("node"), "walks", "prefix"))
    total = walks.count()
    ends = walks.withColumn("_from", name("src_place", "src_start")).withColumn("_to", name("src_place", F.col("src_start") + F.col("length")))
    for at, value in (("_from", "low"), ("_to", "high")):
        ends = join_hot(ends, facts.select(F.col("node").alias(at), "walks", F.col("prefix").alias(value)), at, "walks", total, "_row").drop(at)
    checked = ends.select(F.expr(f"place div {1 << ROW}").alias("batch"), "place", "start", "length", "src_start", "check", "low", "high")
    return texts.groupBy("batch").cogroup(checked.groupBy("batch")).applyInArrow(_removed, _RESULT)
