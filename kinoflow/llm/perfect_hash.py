"""A minimal perfect hash in numpy: bit arrays by level, each key's place is the rank of its bit."""

from __future__ import annotations

import io

import numpy as np

from kinoflow.llm.hashing import mix64

GAMMA = 2.0
LEVELS = 48


class PerfectHash:
    """Maps distinct 64-bit keys to 0..n-1; ``find`` says -1 or any place for other keys, so compare fingerprints."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], rest: np.ndarray):
        self.levels, self.rest = levels, rest

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
        return (mix64(keys + salt) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, done = [], 0
        keys = np.unique(keys.astype(np.uint64))
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, int(np.ceil(GAMMA * len(keys) / 64)) * 64)
            at = cls._place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = done + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
            levels.append((size, words, ranks.astype(np.int64)))
            done += int(alone.sum())
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        placed = 0
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(keys[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (ranks[at >> 6] + below)[hit]
            left = left[~hit]
            placed = int(ranks[-1] + np.bitwise_count(words[-1]))
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = placed + at[hit]
        return out


class Shard:
    """A perfect hash with compact arrays: fingerprint, count and keeper of each key."""

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.index, self.prints, self.counts, self.keepers = index, prints, counts, keepers

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        """Of keys that are equal with different prints (2**-64), the first stays."""
        keys, first = np.unique(keys.astype(np.uint64), return_index=True)
        index = PerfectHash.build(keys)
        at = index.find(keys)
        out = cls(index, np.empty(len(keys), np.uint64), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64))
        out.prints[at] = prints[first].astype(np.uint64)
        out.counts[at] = np.minimum(counts[first], 0xFFFFFFFF)
        out.keepers[at] = keepers[first]
        return out

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, count, keeper) for each key."""
        if not len(self.prints):
            zero = np.zeros(len(keys), np.int64)
            return zero.astype(bool), zero, zero
        at = self.index.find(keys)
        safe = np.maximum(at, 0)
        known = (at >= 0) & (self.prints[safe] == prints.astype(np.uint64, copy=False))
        return known, np.where(known, self.counts[safe], 0), np.where(known, self.keepers[safe], 0)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"w{i}": x[1] for i, x in enumerate(self.index.levels)} | {f"r{i}": x[2] for i, x in enumerate(self.index.levels)}
        sizes = np.array([x[0] for x in self.index.levels], np.int64)
        np.savez(out, sizes=sizes, rest=self.index.rest, prints=self.prints, counts=self.counts, keepers=self.keepers, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        x = np.load(io.BytesIO(data), allow_pickle=False)
        levels = [(int(s), x[f"w{i}"], x[f"r{i}"]) for i, s in enumerate(x["sizes"])]
        return cls(PerfectHash(levels, x["rest"]), x["prints"], x["counts"], x["keepers"])
