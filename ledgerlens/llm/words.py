"""Words of whole texts as numpy arrays, a slice of an Arrow batch at a time.

A word is a run of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII. In UTF-8 all bytes of the latter are
0x80 or more, so words are found on bytes. Null and empty texts have no words. Memory is bounded by `SLICE_BYTES` times a small
factor, or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once.
SLICE_BYTES = 1 << 21
#: Bytes whose hashes are summed at once.
_RUN = 1 << 19

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IS_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | (_BYTES >= 128)
#: bytes.translate table: words in lower case, one space for any other byte.
SPACED = bytes(int(LOWER[b]) if IS_WORD[b] else 32 for b in range(256))

_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD6E8FEB86659FD93
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mixed(LOWER.astype(np.uint64) + np.uint64(0x51ED2701))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = np.cumprod(steps[0], dtype=np.uint64), np.cumprod(steps[1], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_GRAM)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of `batch` whose texts have at most `limit` bytes together; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins (one more entry at the end). Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """All words of a slice: `start` and `end` are byte positions in `data`, `hash` is 64 bits wide; the words of text i are
    those from first[i] to before first[i + 1], and `doc` names each word's text."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = IS_WORD[data]
        turn = np.flatnonzero(np.diff(inside))
        start, end = turn[0::2], turn[1::2]
        # A run may go on from one text into the next: cut it there.
        cut = offsets[1:-1]
        if len(start) and len(cut):
            k = np.searchsorted(start, cut, side="left") - 1
            hit = np.unique(cut[(k >= 0) & (end[np.maximum(k, 0)] > cut)])
            if len(hit):
                start, end = np.sort(np.concatenate([start, hit])), np.sort(np.concatenate([end, hit]))
        self.data, self.offsets, self.start, self.end = data, offsets, start, end
        self.first = np.searchsorted(start, offsets, side="left")
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            stop = max(at + 1, int(np.searchsorted(self.end, self.start[at] + _RUN, side="right")))
            low, high = self.start[at], self.end[stop - 1]
            up, down = _BYTE_POWERS.upto(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data[low:high]] * up, out=sums[1:])
            s, e = self.start[at:stop] - low, self.end[at:stop] - low
            out[at:stop] = mixed((sums[e] - sums[s]) * down[s])
            at = stop
        return out

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all runs of k words inside one text, as the first word's number, and their hashes."""
        at, values = grams(self.hash, k)
        own = self.doc[at + k - 1] == self.doc[at] if len(at) else np.empty(0, bool)
        return at[own], values[own]


def runs(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the runs [low, high) of neighbouring values; equal runs are equal wherever they stand."""
    up, down = _WORD_POWERS.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mixed((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k neighbouring values."""
    at = np.arange(max(0, len(hashes) - k + 1))
    return at, runs(hashes, at, at + k)


def _sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each window of w values."""
    width, out = 1, values
    while 2 * width <= w:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[: len(values) - w + 1], out[w - width: w - width + len(values) - w + 1]) if width < w else out


def minimisers(values: np.ndarray, groups: np.ndarray, w: int) -> np.ndarray:
    """Which values are the least of some window of w neighbours within their group (groups ascend). Two groups that share w
    neighbouring values have at least one chosen value in common there: all least values of a window are chosen. Windows are
    shorter at a group's ends."""
    if not len(values):
        return np.empty(0, bool)
    number = np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]]))
    place = np.arange(len(values)) + number * (w - 1) + (w - 1)
    spread = np.full(place[-1] + w, MAX)
    spread[place] = np.minimum(values, MAX - np.uint64(1))
    least = _sliding(spread, w, np.minimum)
    most = _sliding(least, w, np.maximum)
    return most[place - (w - 1)] == spread[place]
