"""Encodings of words that a Python worker has met, a bounded number of them, kept from task to task.

Words are found, hashed and looked up as arrays: prefix sums of weighted bytes give each word's 64-bit hash, an
open-addressed table of hashes gives its entry, and one gather puts the ids of all words of a batch together. An entry
is taken only if all bytes agree: the first eight and the last eight beside the hash, and those between them eight by
eight, which the table keeps for words of more than 16.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from kinoflow.llm.hashing import mix64

MOST = 690_000
KEPT = 1 << 20  # eights of bytes that a table keeps of long words before it begins anew
SPAN = 1 << 20  # bytes whose new words are encoded together; a longer word is taken alone
NEW = 1 << 14  # new words encoded at once: as Python's strings they take some 200 bytes each
PART = 1 << 16  # bytes hashed and looked up together
WEIGHT = 0x9E3779B97F4A7C15 | 1
UNWEIGHT = pow(WEIGHT, -1, 1 << 64)
_TABLES: dict[object, WordTable] = {}
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """WEIGHT ** i and UNWEIGHT ** i, modulo 2 ** 64, for i up to PART."""
    if not _POWERS:
        made = []
        for base in (WEIGHT, UNWEIGHT):
            x = np.full(PART + 1, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def runs(starts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of words (from, to) of at most ``most`` bytes from the first's start to the last's end, or a single word."""
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + most, side="right")))
        yield at, stop
        at = stop


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], for starts and ends in order. Memory: that of PART bytes and the hashes."""
    up, down = _powers()
    values = np.empty(len(starts), np.uint64)
    for a, b in runs(starts, ends, PART):
        low, high = int(starts[a]), int(ends[b - 1])
        if high - low > PART:  # one long word
            whole = 0
            for at in range(low, high, PART):
                part = data[at : min(at + PART, high)].astype(np.uint64) + np.uint64(1)
                whole += int((part * up[: len(part)]).sum()) * pow(WEIGHT, at - low, 1 << 64)
            values[a] = whole % (1 << 64)
            continue
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        values[a:b] = (sums[e] - sums[s]) * down[s]
    return mix64(values + (ends - starts).astype(np.uint64))


class Words:
    """Words of ``data`` (eight spare bytes at its end), as arrays: hash, length, first and last eight bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None):
        self.eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        self.start, self.length = starts, ends - starts
        self.h = word_hashes(data, starts, ends) if hashes is None else hashes
        short = (np.uint64(1) << (8 * np.minimum(self.length, 7)).astype(np.uint64)) - np.uint64(1)
        self.head = self.eights[starts] & np.where(self.length < 8, short, ~np.uint64(0))
        self.tail = np.where(self.length > 8, self.eights[np.maximum(ends - 8, 0)], np.uint64(0))

    def inner(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(eights between the first and the last eight bytes of these words, one after another; how many each has)."""
        n = np.maximum((self.length[at] - 16 + 7) // 8, 0)
        done = np.cumsum(n)
        nth = np.arange(int(done[-1]) if len(done) else 0) - np.repeat(done - n, n)
        return self.eights[np.repeat(self.start[at], n) + 8 * (nth + 1)], n


class WordTable:
    def __init__(self, most: int = MOST):
        self.most = most
        self.bits = max(10, int(3 * most - 1).bit_length())
        self.entry = np.empty(1 << self.bits, np.int32)
        # Zeros take no memory until they are written, so there is room for all entries from the start.
        self.head, self.tail = np.zeros(2 * most, np.uint64), np.zeros(2 * most, np.uint64)
        self.length, self.count = np.zeros(2 * most, np.int32), np.zeros(2 * most, np.int32)
        self.first, self.inner = np.zeros(2 * most, np.int64), np.zeros(2 * most, np.int32)
        self.ids, self.eights = np.zeros(16 * most, np.uint32), np.zeros(1 << 16, np.uint64)
        self.clear()

    def clear(self) -> None:
        """Begins anew in the same arrays: new ones would come from memory in use before, and be written whole. Only
        those that long words made larger go."""
        self.entry.fill(-1)
        self.size = self.used = self.kept = 0
        if len(self.ids) > 16 * self.most:
            self.ids = np.zeros(16 * self.most, np.uint32)
        if len(self.eights) > 2 * KEPT:
            self.eights = np.zeros(1 << 16, np.uint64)

    @property
    def full(self) -> bool:
        return self.size > self.most or self.kept > KEPT

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _same(self, words: Words, at: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether these words are those of the entries, byte by byte."""
        same = (self.head[entry] == words.head[at]) & (self.length[entry] == words.length[at])
        same &= self.tail[entry] == words.tail[at]
        if len(long := np.flatnonzero(same & (words.length[at] > 16))):
            own, n = words.inner(at[long])
            firsts = np.cumsum(n) - n
            there = self.eights[np.arange(len(own)) + np.repeat(self.inner[entry[long]] - firsts, n)]
            same[long] = np.logical_and.reduceat(own == there, firsts)
        return same

    def find(self, words: Words, at: np.ndarray | None = None) -> np.ndarray:
        """The entry of each word, or -1."""
        at = np.arange(len(words.h)) if at is None else at
        out = np.full(len(at), -1, np.int64)
        live, slot = np.arange(len(at)), self._slots(words.h[at])
        while len(live):
            entry = self.entry[slot]
            hit = entry >= 0
            hit[hit] = self._same(words, at[live[hit]], entry[hit])
            out[live[hit]] = entry[hit]
            on = ~hit & (entry >= 0)
            live, slot = live[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, words: Words, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(at)
        grown = lambda x, need: x if len(x) >= need else np.concatenate([x, np.zeros(max(need, 2 * len(x)) - len(x), x.dtype)])
        for name in ("head", "tail", "length", "first", "inner", "count"):
            setattr(self, name, grown(getattr(self, name), self.size + n))
        eights, many = words.inner(at)
        self.ids = grown(self.ids, self.used + len(ids))
        self.eights = grown(self.eights, self.kept + len(eights))
        new = slice(self.size, self.size + n)
        self.head[new], self.tail[new] = words.head[at], words.tail[at]
        self.length[new], self.count[new] = words.length[at], counts
        self.first[new] = self.used + np.cumsum(counts) - counts
        self.inner[new] = self.kept + np.cumsum(many) - many
        self.ids[self.used : self.used + len(ids)] = ids
        self.eights[self.kept : self.kept + len(eights)] = eights
        wait, slot = np.arange(n), self._slots(words.h[at])
        while len(wait):
            free = self.entry[slot] < 0
            _, winners = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[winners]
            self.entry[slot[placed]] = self.size + wait[placed]
            rest = np.ones(len(wait), bool)
            rest[placed] = False
            wait, slot = wait[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.size += n
        self.used += len(ids)
        self.kept += len(eights)


def forget() -> None:
    """Gives back what tasks of other operators left in this Python worker: tables of words, and freed memory."""
    _TABLES.clear()
    _POWERS.clear()
    give_back()


def give_back() -> None:
    """Hands memory that this process has freed back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def encode_words(
    data: bytes, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], key: object, most: int = MOST
) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids of each word). ``encode`` gets words that the table of ``key``
    doesn't have yet, each once, and gives the same of them."""
    if key not in _TABLES or _TABLES[key].most != most:
        _TABLES.clear()
        _TABLES[key] = WordTable(most)
    table = _TABLES[key]
    padded = np.frombuffer(data + bytes(8), np.uint8)
    parts, counts = [], []
    for low, high in runs(starts, ends, SPAN):
        for at in range(low, high, table.most):  # so the table, of three slots for each of ``most``, never fills
            s, e = starts[at : min(at + table.most, high)], ends[at : min(at + table.most, high)]
            if table.full:
                table.clear()
            found = np.empty(len(s), np.int64)
            new: list[np.ndarray] = []
            for a, b in runs(s, e, PART):
                words = Words(padded, s[a:b], e[a:b])
                found[a:b] = table.find(words)
                new.append(words.h[found[a:b] < 0])
            holes, hashes = np.flatnonzero(found < 0), np.concatenate(new)
            while len(holes):
                _, once = np.unique(hashes, return_index=True)  # different words of one hash come in further rounds
                once = once[np.argsort((e - s)[holes[once]], kind="stable")]  # words of one length are encoded together
                for k in range(0, len(once), NEW):
                    own = once[k : k + NEW]
                    first, last = s[holes[own]], e[holes[own]]
                    ids, n = encode([data[i:j].decode() for i, j in zip(first.tolist(), last.tolist(), strict=True)])
                    table.add(Words(padded, first, last, hashes[own]), np.arange(len(own)), ids, n)
                found[holes] = table.find(Words(padded, s[holes], e[holes], hashes))
                left = found[holes] < 0
                holes, hashes = holes[left], hashes[left]
            for a, b in runs(s, e, PART):
                n = table.count[found[a:b]].astype(np.int64)
                done = np.cumsum(n)
                parts.append(table.ids[np.arange(int(done[-1])) + np.repeat(table.first[found[a:b]] - (done - n), n)])
                counts.append(n)
    return np.concatenate([*parts, np.empty(0, np.uint32)]), np.concatenate([*counts, np.empty(0, np.int64)])


def per_text(counts: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many ids each text has: ``bounds`` are the texts' first bytes and the end of the last."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(sums[np.searchsorted(starts, bounds)])
