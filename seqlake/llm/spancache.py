"""Encode each distinct byte span of a batch once and spread the ids over all its occurrences.

A tokenizer whose pieces never cross a span's edge encodes a text as the
concatenation of its spans. Spans are told apart by 64-bit hashes and their lengths; ids of known
spans stay in flat arrays for the life of the Python worker, up to
``MAX_SPANS`` (then the store starts afresh), so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

MAX_SPANS = 2_000_000


class SpanCache:
    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], dtype=np.int32, max_spans: int = MAX_SPANS):
        self.encode, self.dtype, self.max_spans = encode, dtype, max_spans
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.size = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def _learn(self, hashes: np.ndarray, size: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(hashes) > self.max_spans:
            self._clear()
        ids = self.encode(texts)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for i in ids for x in i), self.dtype, int(count.sum()))
        at = len(self.flat) + np.cumsum(count) - count
        keys = np.concatenate((self.keys, hashes))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.size = np.concatenate((self.size, size))[order]
        self.at = np.concatenate((self.at, at))[order]
        self.count = np.concatenate((self.count, count))[order]
        self.flat = np.concatenate((self.flat, flat))

    def _find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos = np.searchsorted(self.keys, u)
        pos[pos == len(self.keys)] = 0
        return pos, (self.keys[pos] == u) if len(self.keys) else np.zeros(len(u), bool)

    def ids(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all spans in order, ids per span)``."""
        if not len(hashes):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        size = ends - starts
        u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        pos, known = self._find(u)
        odd = (size != size[first][inverse]).any() or (len(self.keys) and (self.size[pos] != size[first])[known].any())
        if odd:  # one hash, two lengths: every span of this batch by itself, nothing kept
            raw = data.tobytes()
            ids = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())])
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for i in ids for x in i), self.dtype, int(count.sum())), count
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.max_spans:
                known[:] = False  # the store is emptied: learn all of this batch's spans
            raw = data.tobytes()
            new = first[~known]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            self._learn(u[~known], size[new], texts)
            pos, _ = self._find(u)
        at, count = self.at[pos][inverse], self.count[pos][inverse]
        return self.flat[ragged(at, count)], count


def ragged(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions ``at[i] .. at[i] + count[i] - 1`` for all ``i``, one after another."""
    before = np.cumsum(count) - count
    return np.repeat(at - before, count) + np.arange(int(count.sum()))


def row_counts(per_span: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ids per row from ids per span, given each row's first span."""
    total = np.concatenate(([0], np.cumsum(per_span)))
    return total[bounds[1:]] - total[bounds[:-1]]
