"""Token ids of many texts under a public word-end BPE vocabulary, as the `tokenizers` library gives them.

The vocabulary lower-cases, splits text into runs of letters, single digits and runs of other characters, and merges
bytes inside each run. So words between white space are independent, and equal runs have equal ids: each distinct run
of a slice of text is merged once, all of them together in numpy, and its ids are copied to where it occurs. Words with
other than ASCII and Latin-1 letters, with an apostrophe or with the beginning of a special token go to the library.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from . import text as T

U = np.uint64
_WHITE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _classes() -> np.ndarray:
    c = np.full(256, _HARD, dtype=np.uint8)
    c[0x21:0x7F] = _OTHER
    c[0x30:0x3A] = _DIGIT
    c[0x41:0x5B] = c[0x61:0x7B] = _LETTER
    c[0xC3] = _LETTER
    c[0x80:0xC0] = _LETTER  # where it follows 0xC3; other leads are hard, and so is the word around them
    c[[0x20, 9, 10, 11, 12, 13]] = _WHITE
    c[0x27] = _HARD
    return c


_CLASS = _classes()


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [rest.get(b, chr(b)) for b in range(256)]


class Vocabulary:
    """A vocabulary file: merges as a hash table for numpy, and the library's tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.inside = np.array([ids[c] for c in _byte_characters()], dtype=np.int64)
        self.last = np.array([ids[c + end] for c in _byte_characters()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=U)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.mask = (1 << (4 * len(keys)).bit_length()) - 1
        self.keys = np.full(self.mask + 1, _EMPTY)
        self.ranks = np.full(self.mask + 1, len(keys), dtype=np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), (T.mix(keys) & U(self.mask)).tolist(), strict=True)):
            while self.keys[slot] != _EMPTY:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ranks[slot] = key, rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of symbol pairs; the number of merges where there is none."""
        key = left.astype(U) << U(32) | right.astype(U)
        slot = (T.mix(key) & U(self.mask)).astype(np.int64)
        out = np.full(len(key), len(self.merged), dtype=np.int64)
        at = np.arange(len(key))
        while len(at):
            here = self.keys[slot]
            hit = here == key[at]
            out[at[hit]] = self.ranks[slot[hit]]
            go = ~hit & (here != _EMPTY)
            at, slot = at[go], (slot[go] + 1) & self.mask
        return out

    def merge(self, bytes_: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte runs, which start at `at` (one more than runs), and where each run's ids start."""
        runs = len(at) - 1
        sym = self.inside[bytes_]
        sym[at[1:] - 1] = self.last[bytes_[at[1:] - 1]]
        run = np.repeat(np.arange(runs), np.diff(at))
        none = len(self.merged)
        done_sym, done_run = [], []
        while len(sym):
            rank = np.full(len(sym), none, dtype=np.int64)
            inner = np.flatnonzero(run[1:] == run[:-1])
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
            first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            low_here = np.repeat(low, size)
            take = (rank == low_here) & (rank < none)
            # of a chain of overlapping equal pairs every second one merges, from the left
            start = take & ~np.concatenate(([False], take[:-1] & (run[1:] == run[:-1])))
            pos = np.arange(len(sym))
            origin = np.maximum.accumulate(np.where(start, pos, 0))
            take &= (pos - origin) % 2 == 0
            at_ = np.flatnonzero(take)
            sym[at_] = self.merged[rank[at_]]
            keep = np.ones(len(sym), bool)
            keep[at_ + 1] = False
            over = low_here >= none
            done_sym.append(sym[over])
            done_run.append(run[over])
            keep &= ~over
            sym, run = sym[keep], run[keep]
        sym, run = np.concatenate(done_sym or [sym]), np.concatenate(done_run or [run])
        order = np.argsort(run, kind="stable")
        return sym[order], np.concatenate(([0], np.cumsum(np.bincount(run, minlength=runs))))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order and where each row's start (one more than rows); null is empty."""
        raw, at = T.flat(column)
        rows = len(at) - 1
        if not len(raw):
            return np.empty(0, np.int64), np.zeros(rows + 1, np.int64)
        buf = T._LOWER[raw]
        after_c3 = np.concatenate(([False], raw[:-1] == 0xC3))
        upper = after_c3 & (raw >= 0x80) & (raw <= 0x9E)
        buf = np.where(upper, buf + np.uint8(0x20), buf)
        cls = _CLASS[raw]
        hard = (cls == _HARD) | ((raw >= 0x80) & (raw < 0xC0) & ~after_c3) | (after_c3 & ((raw == 0x97) | (raw == 0xB7)))
        hard[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        starts, ends, _ = T.words(raw, at)
        bad = np.concatenate(([0], np.cumsum(hard)))
        bad = bad[ends] > bad[starts]
        # where units start: hard words whole, others at each change of class and each digit
        begin = np.zeros(len(raw), bool)
        begin[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _DIGIT)
        depth = np.zeros(len(raw) + 1, dtype=np.int32)
        depth[starts[bad]] += 1
        depth[ends[bad]] -= 1
        whole = np.cumsum(depth)[:-1] > 0
        begin &= ~whole
        begin[starts] = True
        begin &= cls != _WHITE
        begin[starts] = True
        unit = np.flatnonzero(begin)
        stop = np.append(unit[1:], len(raw))
        word = np.searchsorted(starts, unit, side="right") - 1
        stop = np.minimum(stop, ends[word])
        is_hard = bad[word]
        h = T.hash_spans(buf, unit, stop, lower=False)
        if is_hard.any():
            h[is_hard] = T.mix(T.hash_spans(raw, unit[is_hard], stop[is_hard], lower=False) ^ U(0x9FB21C651E98DF25))
        _, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids, ids_at = self._distinct(raw, buf, unit[where], stop[where], is_hard[where])
        n = np.diff(ids_at)[inverse]
        total = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.repeat(ids_at[inverse] - total[:-1], n) + np.arange(total[-1])]
        return out, total[np.searchsorted(unit, at)]

    def _distinct(self, raw: np.ndarray, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, and where each one's start."""
        count = np.zeros(len(start), dtype=np.int64)
        easy = np.flatnonzero(~hard)
        size = stop[easy] - start[easy]
        at = np.concatenate(([0], np.cumsum(size)))
        ids, ids_at = self.merge(buf[np.repeat(start[easy] - at[:-1], size) + np.arange(at[-1])], at)
        count[easy] = np.diff(ids_at)
        rest = np.flatnonzero(hard)
        told = self.tokenizer.encode_batch_fast([raw[start[k] : stop[k]].tobytes().decode("utf-8", "replace") for k in rest], add_special_tokens=False) if len(rest) else []
        count[rest] = [len(e.ids) for e in told]
        all_at = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(all_at[-1], dtype=np.int64)
        out[np.repeat(all_at[easy] - ids_at[:-1], count[easy]) + np.arange(len(ids))] = ids
        for k, e in zip(rest.tolist(), told, strict=True):
            out[all_at[k] : all_at[k + 1]] = e.ids
        return out, all_at


_open: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each process."""
    if path not in _open:
        _open[path] = Vocabulary(path)
    return _open[path]
