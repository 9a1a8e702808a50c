"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

A document is scored by the others: its own occurrences are taken from every count, else each of its n-grams would be
known and nothing would back off. No count is left out and none has a floor.

1. Texts are put into batches, which are written once: what follows reads the same rows however often.
2. For each order, batches are exploded into n-grams. An exploded row holds the distinct n-gram hashes of one batch that
   belong to one part of the hash range, sorted, as packed columns (see exchange): an n-gram takes six bytes on the wire,
   once for each batch, and a frequent one meets as one entry for each batch, never as rows.
3. The count table of the order, partitioned by hash: a grouped aggregate of the exploded rows, one row for each part with
   its hashes and totals. N-grams that occur once are not stored: less their own document's occurrence they are 0.
4. The exploded rows are joined to the table by part and answered with totals in the order asked.
5. Answers meet their batch, where a document's own counts are taken off, words are scored and documents summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as E
from . import text as T
from .common import cut

U = np.uint64
_EXPLODED = "part int, batch long, hashes binary, counts binary"
_TABLE = "part int, hashes binary, totals binary"
_ANSWER = "batch long, n int, part int, totals binary"
_SCORED = "doc_id long, n_words long, score_micro long"


class _Grams(E.Documents):
    """A batch's documents and, for each order, its n-grams."""

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the last words of the n-grams inside documents, and the n-grams' hashes."""
        g = T.grams(self.words, n)
        end = np.arange(len(g)) + n - 1
        keep = self.left[end] >= n - 1
        return end[keep], g[keep]

    def others(self, n: int, totals: np.ndarray) -> np.ndarray:
        """For each position, how often other documents have the n-gram that ends there, by the totals of the distinct
        n-grams in order; 0 where none ends."""
        end, g = self.of(n)
        distinct, inverse = np.unique(g, return_inverse=True)
        if len(totals) != len(distinct):
            raise ValueError(f"{len(totals)} answers to {len(distinct)} n-grams")
        out = np.zeros(len(self.words), dtype=np.int64)
        some = totals[inverse] > 1
        end, inverse = end[some], inverse[some]
        _, own, own_count = np.unique(inverse * len(self.at) + self.row[end], return_inverse=True, return_counts=True)
        out[end] = totals[inverse] - own_count[own]
        return out


def _exploded(n: int, parts: int):
    @T.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, docs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                distinct, count = np.unique(_Grams(docs, lower=True).of(n)[1], return_counts=True)
                at = E.parts(distinct, parts)
                full = np.flatnonzero(np.diff(at))
                blobs = [[f(a[at[k] : at[k + 1]]) for k in full] for f, a in ((E.rising, distinct), (E.packed, count))]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([batch] * len(full), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], schema=E.schema(_EXPLODED))

    return run


def _counted(rows: pa.Table) -> pa.Table:
    """One part of the count table."""
    hashes = np.concatenate([E.risen(x) for x in rows["hashes"].to_pylist()])
    order = np.argsort(hashes, kind="stable")  # runs that are sorted already
    hashes, counts = hashes[order], np.concatenate([E.unpacked(x) for x in rows["counts"].to_pylist()])[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, np.int64)
    hashes, totals = hashes[first], np.add.reduceat(counts, first) if len(first) else counts
    some = totals > 1
    return pa.Table.from_arrays([rows["part"].slice(0, 1).combine_chunks(), pa.array([E.rising(hashes[some])], pa.binary()), pa.array([E.packed(totals[some])], pa.binary())], schema=E.schema(_TABLE))


def _answered(n: int):
    """The exploded rows of a part joined to its row of the table: each one's totals, 0 for n-grams it has not."""

    def run(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return E.schema(_ANSWER).empty_table()
        known, totals = E.risen(counts["hashes"][0].as_py()), E.unpacked(counts["totals"][0].as_py())
        out = []
        for x in rows["hashes"].to_pylist():
            asked = E.risen(x)
            place = np.searchsorted(known, asked)
            hit = place < len(known)
            hit[hit] = known[place[hit]] == asked[hit]
            got = np.zeros(len(asked), dtype=U)
            got[hit] = totals[place[hit]]
            out.append(E.packed(got))
        return pa.Table.from_arrays([rows["batch"].combine_chunks(), pa.array([n] * len(rows), pa.int32()), rows["part"].combine_chunks(), pa.array(out, pa.binary())], schema=E.schema(_ANSWER))

    return run


def _scores(order: int, alpha: float, words: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        done = []
        for raw in docs["docs"].to_pylist():  # one
            b = _Grams(raw, lower=True)
            count = []
            for n in range(1, order + 1):
                t = answers.filter(pc.equal(answers["n"], n)).sort_by("part")
                count.append(b.others(n, np.concatenate([np.empty(0, U), *map(E.unpacked, t["totals"].to_pylist())]).astype(np.int64)))
            most = np.minimum(b.left, order - 1)  # words of history that a word can have
            rest = np.maximum(words - np.diff(b.at), 1)[b.row]
            score = np.log(np.maximum(count[0], 1) / rest) + most * np.log(alpha)
            for n in range(2, order + 1):
                has = count[n - 1] > 0
                before = np.concatenate(([0], count[n - 2][:-1]))
                score[has] = np.log(count[n - 1][has] / before[has]) + (most[has] - (n - 1)) * np.log(alpha)
            micro = np.concatenate(([0], np.cumsum(np.floor(score * 1e6 + 0.5).astype(np.int64))))
            done.append(pa.Table.from_arrays([b.ids, pa.array(np.diff(b.at)), pa.array(micro[b.at[1:]] - micro[b.at[:-1]])], schema=E.schema(_SCORED)))
        return pa.concat_tables(done) if done else E.schema(_SCORED).empty_table()

    return run


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, batch_bytes: int = E.BATCH_BYTES, part_words: int = E.PART_ENTRIES) -> DataFrame:
    """doc_id, n_words, score_micro, mean_micro for each row of docs (doc_id, text).

    score_micro is the document's summed log score in millionths, each word's rounded; mean_micro is that for a word,
    rounded down, null without words. A word scores log(c(n-gram) / c(its first words)) under the longest n-gram up to
    `order` that other rows have, plus log(alpha) for each word of history given up for that; one that no other row has
    scores as if one had it once, of all their words. Words are runs of other than white space, A-Z folded; n-grams
    don't cross documents, and a document's first words have no longer ones and pay nothing for it.

    Null and empty texts have no words and score 0. Rows are documents each, whatever their doc_id, null or repeated:
    repeated rows know each other. A text of any length is one row, scored whole, and takes about 40 bytes of a task's
    memory for each of its own. There are no ties to break. Other columns of docs are ignored, whatever their names. An
    empty table gives an empty result.
    """
    texts, words = E.batches(docs, batch_bytes)
    parts = max(1, -(-words // part_words))
    answers = None
    for n in range(1, order + 1):
        exploded = texts.mapInArrow(_exploded(n, parts), _EXPLODED).groupBy("part")
        counts = exploded.applyInArrow(_counted, _TABLE)
        got = cut(exploded.cogroup(counts.groupBy("part")).applyInArrow(_answered(n), _ANSWER))
        answers = got if answers is None else answers.union(got)
    out = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scores(order, alpha, words), _SCORED)
    return out.withColumn("mean_micro", F.expr("if(n_words > 0, cast(floor(score_micro / n_words) as bigint), null)"))
