"""SentencePiece encoding by batched numpy Viterbi, and decoding."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinoflow.llm.batches import flat, lists, pieces
from kinoflow.llm.common import small_batches
from kinoflow.llm.word_cache import encode_words, give_back, per_text

BLANK = "▁"
BASE = np.uint64(0x100000001B3)
#: Words whose pieces a worker keeps; as the last stage of a pipeline it runs beside executors that are already full.
KEPT_WORDS = 300_000
#: Characters of words split together: each takes about 60 bytes.
CELLS = 1 << 17


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: ``words`` with their ids and scores, the ids of the 256 byte pieces, and the bytes of every id."""

    words: tuple[str, ...]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    spelled: tuple[bytes, ...]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, byte_ids, spelled = [], np.full(256, model.unk_id(), np.int32), []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                spelled.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                ids.append(i)
                spelled.append(piece.replace(BLANK, " ").encode())
        words = tuple(model.id_to_piece(i) for i in ids)
        scores = np.array([model.get_score(i) for i in ids], dtype=np.float64)
        return cls(words, np.array(ids, np.int32), scores, byte_ids, tuple(spelled))


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).T.astype(np.uint64)


class Encoder:
    """Splits words into the pieces with the largest sum of scores; a character that no piece covers becomes bytes.

    Words of equal length are columns of one matrix and advance together. A substring's hash is the difference of two
    prefix hashes; it is looked up among the sorted hashes of all pieces. The pieces of the best split are compared
    character by character; where one isn't spelled so, the word is split again with every candidate compared. Of equal
    sums the longer last piece wins.
    """

    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.longest = max(map(len, vocabulary.words))
        self.powers = np.array([pow(int(BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        keys = np.empty(len(vocabulary.words), np.uint64)
        for n in {len(w) for w in vocabulary.words}:
            own = [i for i, w in enumerate(vocabulary.words) if len(w) == n]
            keys[own] = self._key(self._prefixes(_codes([vocabulary.words[i] for i in own], n))[n], n)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.sorted_scores = vocabulary.scores[self.order]
        self.sorted_ids = vocabulary.ids[self.order]
        self.sizes = np.array([len(w) for w in vocabulary.words], np.int64)[self.order]
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.spelt = np.frombuffer("".join(vocabulary.words[i] for i in self.order).encode("utf-32-le"), "<u4")
        self.place = np.zeros(int(vocabulary.ids.max()) + 1, np.int64)  # of each id among the sorted pieces
        self.place[self.sorted_ids] = np.arange(len(self.order))
        self.maybe = np.zeros(1 << 20, bool)  # whether any key begins with these 20 bits
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.unknown = float(vocabulary.scores.min()) - 10.0
        told = "\0".join(vocabulary.words).encode() + vocabulary.ids.tobytes() + vocabulary.scores.tobytes() + vocabulary.byte_ids.tobytes()
        self.key = hashlib.sha256(told).digest()
        several = {c for w in vocabulary.words if len(w) > 1 for c in w}
        self.newline_alone = "\n" not in several  # then a line's end also ends a word
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in vocabulary.spelled])]).astype(np.int64)
        self.letters = np.frombuffer(b"".join(vocabulary.spelled), np.uint8)

    def _prefixes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes) + 1, codes.shape[1]), np.uint64)
        for i, row in enumerate(codes):
            out[i + 1] = out[i] * BASE + row + np.uint64(1)
        return out

    @staticmethod
    def _key(h: np.ndarray, n: int) -> np.ndarray:
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) * np.uint64(2 * n + 1)

    def _same(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether the pieces at these places are spelled by the columns of ``codes``."""
        size = len(codes)
        same = self.sizes[at] == size
        there = np.minimum(self.firsts[at] + np.arange(size)[:, None], len(self.spelt) - 1)
        return same & (self.spelt[there] == codes).all(axis=0)

    def _spelled(self, codes: np.ndarray, steps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words (columns of ``codes``) their steps spell: ids in order, -1 for bytes, -2 for none, and their ends."""
        sizes = np.diff(ends, axis=1, prepend=0)[steps != -2]
        ids = steps[steps != -2]
        at = self.place[np.maximum(ids, 0)]
        lasts = np.cumsum(sizes)
        there = self.firsts[at] - (lasts - sizes)
        flat = np.minimum(np.arange(codes.size) + np.repeat(there, sizes), len(self.spelt) - 1)
        same = (self.spelt[flat] == codes.T.reshape(-1)) & np.repeat(self.sizes[at] == sizes, sizes)
        same |= np.repeat(ids == -1, sizes)
        return same.reshape(codes.shape[1], -1).all(axis=1)

    def _best(self, words: list[str], compare: bool = False) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of words of one length. ``compare``: each candidate by its spelling."""
        n = len(words[0])
        codes = _codes(words, n)
        hashes = self._prefixes(codes)
        best = np.full((n + 1, len(words)), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, len(words)), np.int32)
        piece = np.full((n + 1, len(words)), -1, np.int32)
        for end in range(1, n + 1):
            for size in range(min(end, self.longest), 0, -1):
                key = self._key(hashes[end] - hashes[end - size] * self.powers[size], size)
                near = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, key[near]), len(self.keys) - 1)
                known = self.keys[at] == key[near]
                near, at = near[known], at[known]
                if size == 1:  # bytes, where no piece covers the character
                    same = self._same(at, codes[end - 1 : end, near]) if compare else slice(None)
                    near, at = near[same], at[same]
                    total = best[end - 1] + self.unknown
                    total[near] = best[end - 1, near] + self.sorted_scores[at]
                    ids = np.full(len(words), -1, np.int32)
                    ids[near] = self.sorted_ids[at]
                    better = np.flatnonzero(total > best[end])
                    best[end, better], back[end, better], piece[end, better] = total[better], 1, ids[better]
                elif len(near):
                    total = best[end - size, near] + self.sorted_scores[at]
                    better = np.flatnonzero(total > best[end, near])
                    if compare:
                        better = better[self._same(at[better], codes[end - size : end, near[better]])]
                    near, at = near[better], at[better]
                    best[end, near], back[end, near], piece[end, near] = total[better], size, self.sorted_ids[at]
        at, rows = np.full(len(words), n), np.arange(len(words))
        steps, ends = [], []
        while (at > 0).any():
            live = at > 0
            steps.append(np.where(live, piece[at, rows], -2))
            ends.append(at)
            at = np.where(live, at - back[at, rows], 0)
        trail, ends = np.array(steps[::-1]).T, np.array(ends[::-1]).T
        used = trail != -2
        data, lasts = trail[used].astype("<i4").tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        out = [data[i:j] for i, j in zip([0, *lasts[:-1]], lasts, strict=True)]
        wrong = [] if compare else np.flatnonzero(~self._spelled(codes, trail, ends)).tolist()
        for i in np.flatnonzero((trail == -1).any(axis=1)).tolist():
            word, parts = words[i], []
            for k, e in zip(trail[i].tolist(), ends[i].tolist(), strict=True):
                parts += [k] if k >= 0 else [] if k == -2 else self.v.byte_ids[list(word[e - 1].encode())].tolist()
            out[i] = np.array(parts, "<i4").tobytes()
        if wrong:
            for i, ids in zip(wrong, self._best([words[i] for i in wrong], compare=True), strict=True):
                out[i] = ids
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each). A word is a run of blanks with what follows it;
        no piece crosses from one to the next, nor a line's end where that stands alone in the vocabulary."""
        sign = BLANK.encode()
        marked = [b" " + (t.replace(sign, b" ") if sign in t else t) if t else b"" for t in texts]
        data = b"".join(marked)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
        if not data:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(data, np.uint8)
        begins = raw == 32
        begins[1:] &= raw[:-1] != 32
        if self.newline_alone:
            line = raw == 10
            begins |= line
            begins[1:] |= line[:-1]
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(begins)
        ids, counts = encode_words(data, starts, np.append(starts[1:], len(raw)), self._encode_words, self.key, KEPT_WORDS)
        return ids.view(np.int32), per_text(counts, starts, bounds)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault(len(word), []).append(i)
        done = [b""] * len(words)
        for n, group in by_size.items():
            step = max(1, CELLS // n)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                for i, ids in zip(part, self._best([words[i].replace(" ", BLANK) for i in part]), strict=True):
                    done[i] = ids
        return np.frombuffer(b"".join(done), "<u4"), np.array([len(x) // 4 for x in done], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of the text that ids spell: pieces and bytes joined, the first blank taken off."""
        ids = ids.astype(np.int64)
        sizes = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return b""
        out = self.letters[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)].tobytes()
        return out.removeprefix(b" ")


def _encoder(shared):
    made: list[Encoder] = []

    def get() -> Encoder:
        if not made:
            give_back()
            made.append(Encoder(shared.value))
        return made[0]

    return get


def encode(docs: DataFrame, vocabulary: Pieces, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids of each whole text: the segmentation with the largest sum of piece scores.

    As the library does with a model of this kind, a blank is put before the text, blanks become the blank sign, and
    nothing else is normalised; characters outside the vocabulary become byte pieces, so decoding gives the text back
    (but for the blank sign itself, which decodes to a blank). Words already split are kept, a bounded number of them.

    Null or empty text: no ids. Long texts are worked on word by word; a word takes time in proportion to its length.
    All other columns stay; a column of the new name is replaced. The vocabulary is broadcast (its size is fixed).
    """
    small_batches(docs.sparkSession)
    get = _encoder(docs.sparkSession.sparkContext.broadcast(vocabulary))

    @F.arrow_udf("array<int>")
    def run(text: pa.Array) -> pa.Array:
        ids = _encode_batch(get(), text)[0]
        give_back()
        return ids

    return docs.withColumn(ids_col, run(F.col(text_col)))


def _encode_batch(encoder: Encoder, text: pa.Array, decoded: bool = False) -> tuple[pa.Array, list[bool]]:
    """(ids of each text, whether decoding them gives the text back; only if ``decoded`` asks for it)."""
    found, counts, exact = [np.empty(0, np.int32)], [np.empty(0, np.int64)], []
    data = text.cast(pa.large_binary())
    for a, b in pieces(data):
        texts = data.slice(a, b - a).to_pylist()
        ids, n = encoder.encode(texts)
        found.append(ids)
        counts.append(n)
        if decoded:
            ends = np.cumsum(n).tolist()
            exact += [encoder.decode(ids[i:j]) == (t or b"") for t, i, j in zip(texts, [0, *ends], ends, strict=False)]
    return lists(np.concatenate(found), np.concatenate(counts)), exact


def round_trip(
    docs: DataFrame, vocabulary: Pieces, text_col: str = "text", ids_col: str = "ids", exact_col: str = "exact"
) -> DataFrame:
    """Adds the ids of each whole text as :func:`encode` does, and whether decoding them, as :func:`decode` does, gives
    the text back (a null text: an empty one). One pass in one Python worker: ids aren't sent there a second time.

    Ties between splits of equal sum go to the longer last piece; repeated rows each get the same ids; a long text is
    worked on word by word, a word in pieces of bounded memory only as its length allows (time and memory grow in
    proportion to it). Empty table: no rows. All other columns stay; columns of the new names are replaced."""
    small_batches(docs.sparkSession)
    get = _encoder(docs.sparkSession.sparkContext.broadcast(vocabulary))

    @F.arrow_udf("struct<ids:array<int>,exact:boolean>")
    def run(text: pa.Array) -> pa.Array:
        ids, exact = _encode_batch(get(), text, decoded=True)
        give_back()  # idle workers of the same executor keep what they hold
        return pa.StructArray.from_arrays([ids, pa.array(exact, pa.bool_())], ["ids", "exact"])

    names = [c for c in docs.columns if c not in (ids_col, exact_col)]
    both = "_both"
    while both in docs.columns:
        both += "_"
    done = docs.withColumn(both, run(F.col(text_col)))
    return done.select(*names, F.col(both)["ids"].alias(ids_col), F.col(both)["exact"].alias(exact_col))


def decode(docs: DataFrame, vocabulary: Pieces, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text that a column of ids spells; null or no ids: empty. Bytes that are no UTF-8 become U+FFFD."""
    small_batches(docs.sparkSession)
    get = _encoder(docs.sparkSession.sparkContext.broadcast(vocabulary))

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        encoder = get()
        values, counts = flat(ids)
        ends = np.cumsum(counts)
        found = (encoder.decode(values[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True))
        return pa.array([x.decode(errors="replace") for x in found], pa.string())

    return docs.withColumn(text_col, run(F.col(ids_col)))


