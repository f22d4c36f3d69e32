"""A minimal perfect hash of 64-bit keys: levels of bits, vectorised.

A key is placed at the first level where no other key that is left has its position; the place's rank among the bits set
is its slot. Some three bits a key. Keys that are not of the set may get a slot too: who asks has to compare stored keys.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.hashing import mix

_GAMMA = 2


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, before = levels, [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + before)
            before += int(bits.sum())
        self.n = before

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """For keys that differ."""
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left):
            if len(levels) == 200:
                raise ValueError("keys of a perfect hash repeat")
            size = -(-_GAMMA * len(left) // 64) * 64
            at = _positions(left, len(levels), size)
            times = np.bincount(at, minlength=size)
            levels.append(times == 1)
            left = left[times[at] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key of the set; of others, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _positions(keys[rest], level, len(bits))
            hit = bits[at]
            out[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *(len(b) for b in self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        count = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, count, 8).tolist(), 8 * (count + 1), []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at)).view(bool))
            at += size // 8
        return cls(levels)
