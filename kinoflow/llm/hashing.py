"""Vectorised hashes on numpy arrays and words, used inside Arrow batches."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix32(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A bijection on 32 bits, in place; ``spare`` is scratch room of the same shape."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 0)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)
    return x


class WordHashes(dict):
    """64-bit hashes of words, kept for up to ``most`` of them."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_shingles(texts: list[bytes | None], size: int, hashes: WordHashes) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``size`` words.

    Words are what ASCII white space separates, A-Z lower-cased. A text of fewer words has one shingle, all of them;
    one without words, or null, has none.
    """
    words = [t.lower().split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    total = int(counts.sum())
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, total)
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = mix64(flat)
    for j in range(1, size):
        rolled = mix64(rolled[: max(total - j, 0)] * step + flat[j:]) if total > j else rolled[:0]
    ends = np.cumsum(counts)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(rolled[end - n : end - size + 1]))
        elif n:
            h = np.array([n], dtype=np.uint64)
            for w in flat[end - n : end]:
                h = mix64(h * step + w)
            out.append(h)
        else:
            out.append(flat[:0])
    return out
