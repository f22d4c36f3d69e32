"""Vectorised hashing of texts: an Arrow string column's bytes in, arrays of word or byte-gram hashes out."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@functools.lru_cache(maxsize=2)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for n places at least."""
    return _powers(1 << max(16, int(n).bit_length()), base)


def forget() -> None:
    """Drop the powers that are kept: as many as the largest batch has bytes, 16 bytes each."""
    _powers.cache_clear()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts of a column, and where each text begins (one entry more, for the end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, or those between other separators; a word never spans two
    texts. ``fold`` gives the byte that stands for each byte.

    start, end: byte positions; row: the text of each word; first: the first word of each text (one entry more).
    """

    def __init__(self, column: pa.Array, separator: np.ndarray = _SEPARATOR, fold: np.ndarray | None = None):
        self.data, self.offsets = text_bytes(column)
        if fold is not None:
            self.data = fold[self.data]
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1 : n + 1] = ~separator[self.data]
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        cuts = cuts[inside[cuts] & inside[cuts + 1]]
        begins[cuts] = True
        ends[cuts] = True
        self.start, self.end = np.flatnonzero(begins[: n + 1]), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self, base: int = _BASE) -> np.ndarray:
        up, down = powers(len(self.data) + 1, base)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def grams_of_words(hashes: np.ndarray, m: int) -> np.ndarray:
    """A hash of each m consecutive entries; entries near the end, without m followers, hash what is left."""
    out = hashes.copy()
    for j in range(1, m):
        out[: len(hashes) - j] = out[: len(hashes) - j] * np.uint64(_BASE) + hashes[j:]
    return mix(out)


def grams_of_bytes(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes from each position on; 0 where fewer are left."""
    out = np.zeros(len(data), np.uint64)
    n = len(data) - q + 1
    if n > 0:
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        out[:n] = mix((sums[q:] - sums[:n]) * down[:n])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive entries (len(x) - w + 1 of them), by block prefixes and suffixes."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = np.full((-(-len(x) // w)) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
