"""Token ids in a content-addressed store: content-defined chunks stored once, recipes, and Merkle manifests.

A store is a folder of three Parquet tables, so any file system that Spark reads will do:

* ``chunks``: hash (SHA-256 of data), n, data. A chunk is a run of ids, ``width`` bytes each, little-endian. A rolling
  hash of the last WINDOW ids ends a chunk where its low bits are zero, so an equal passage gives equal chunks wherever
  it stands; a document's last id ends one too. Each hash is there once.
* ``recipes``: part, place, doc_id, start, n_tokens, hashes, root, in ascending doc_id order over the parts: the
  chunks of each document in order, the ids of all documents before it, and the SHA-256 over its chunks' hashes.
* ``manifest``: part, n_docs, n_tokens, root, and width: the root of a tree of SHA-256 hashes, FANOUT to a node, over
  the parts' document roots.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinoflow.llm.batches import pieces
from kinoflow.llm.common import kept, small_batches
from kinoflow.llm.word_cache import encode_words, give_back, per_text

WINDOW, MASK, LEAST, MOST = 16, 0x1FF, 64, 4096
FANOUT = 256
CHUNKS = "array<struct<hash:binary,n:int,data:binary>>"


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids asks for a cut. A place's hash covers no id more than
    WINDOW before it, and cuts are LEAST > WINDOW ids from a document's start, so documents may lie end to end."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    rolled = np.zeros(len(x), np.uint64)
    for j in range(min(WINDOW, len(x))):
        rolled[j:] += x[: len(x) - j] * np.uint64(pow(0x100000001B3, j, 1 << 64))
    rolled ^= rolled >> np.uint64(33)
    return np.flatnonzero((rolled & np.uint64(MASK)) == 0) + 1


def cut_points(ids: np.ndarray, ends: list[int] | None = None) -> list[list[int]]:
    """Where the chunks of each document end, for documents whose ids lie end to end; ``ends`` has the documents' ends.

    Every chunk but a document's last has LEAST to MOST ids.
    """
    ends = [len(ids)] if ends is None else ends
    marks = marks_of(ids)
    bounds = np.searchsorted(marks, [0, *ends])
    out, begin = [], 0
    for k, end in enumerate(ends):
        cuts, last = [], begin
        for mark in marks[bounds[k] : bounds[k + 1]].tolist():
            while mark - last > MOST:
                last += MOST
                cuts.append(last)
            if mark - last >= LEAST:
                cuts.append(mark)
                last = mark
        while end - last > MOST:
            last += MOST
            cuts.append(last)
        if last < end or not cuts:
            cuts.append(end)
        out.append(cuts)
        begin = end
    return out


#: Kinds of bytes: blanks and line ends, letters up to U+00FF, visible ASCII signs but the apostrophe, all else.
BLANKS, LETTERS, SIGNS, REST = 0, 1, 2, 3
_KIND = np.full(256, REST, np.uint8)
_KIND[33:127] = SIGNS
_KIND[ord("'")] = REST
_KIND[65:91] = _KIND[97:123] = LETTERS
_KIND[[10, 32]] = BLANKS
_AFTER_C3 = np.zeros(256, bool)  # U+00C0 to U+00FF but the signs of multiplication and division
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False
_EASY = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+").fullmatch


class WordEncoder:
    """Ids of texts by the tokenizers library. Where the tokenizer drops white space, texts are split at blanks and line
    ends and each distinct word is encoded once.

    Where its first split also keeps letters and signs apart (:func:`parts_letters`), words are cut between letters up to
    U+00FF and ASCII signs too, and words of such letters alone go through the library without normaliser and regular
    expression, many to a text: both leave such a word as it is, but for its case.
    """

    def __init__(self, definition: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.by_word, self.key = by_word, hashlib.sha256(definition.encode()).digest()
        self.plain = None
        if by_word and parts_letters(definition):
            self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
            self.lower = '"Lowercase"' in json.dumps(json.loads(definition)["normalizer"])
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            suffix = self.tokenizer.model.end_of_word_suffix  # which the last piece of each word has, and no other
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if not self.by_word:
            return self._run([t.decode() for t in texts])
        data = b"\n".join(texts)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        kinds = np.zeros(len(data) + 2, np.uint8)
        raw = np.frombuffer(data, np.uint8)
        kinds[1:-1] = _KIND[raw]
        two = np.flatnonzero(raw[:-1] == 0xC3)
        two = two[_AFTER_C3[raw[two + 1]]] + 1
        kinds[two] = kinds[two + 1] = LETTERS
        inside = kinds != BLANKS
        edge = inside[1:] != inside[:-1]
        if self.plain is not None and not any(x in data for x in self.added):
            edge |= kinds[1:] * kinds[:-1] == LETTERS * SIGNS
        starts = np.flatnonzero(edge & inside[1:])
        ends = np.flatnonzero(edge & inside[:-1])
        ids, counts = encode_words(data, starts, ends, self._words if self.plain is not None else self._run, self.key)
        return ids, per_text(counts, starts, bounds)

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [np.empty(0, np.uint32)]
        for i in range(0, len(texts), 10_000):
            for x in self.tokenizer.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False):
                out.append(np.array(x.ids, np.uint32))
        return np.concatenate(out), np.array([len(x) for x in out[1:]], np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([_EASY(w) is not None for w in words], bool)
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        parts, counts = [], []
        for i in range(0, len(easy), 2_000):
            text = " ".join([words[k] for k in easy[i : i + 2_000].tolist()])
            (x,) = self.plain.encode_batch_fast([text.lower() if self.lower else text], add_special_tokens=False)
            parts.append(np.array(x.ids, np.uint32))
            counts.append(np.diff(np.flatnonzero(self.last[parts[-1]]), prepend=-1))
        ids, n = self._run([words[k] for k in hard.tolist()])
        ids, n = np.concatenate([*parts, ids]), np.concatenate([*counts, n]).astype(np.int64)
        place = np.argsort(np.concatenate([easy, hard]))
        first, n = (np.cumsum(n) - n)[place], n[place]
        done = np.cumsum(n)
        return ids[np.arange(len(ids)) + np.repeat(first - (done - n), n)], n


def parts_letters(definition: str) -> bool:
    """Whether the first split takes runs of letters, single digits and runs of other signs, but for alternatives that
    begin with an apostrophe, what follows works on characters, and pieces tell where a word ends."""
    d = json.loads(definition)
    steps = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [d.get("pre_tokenizer") or {}]
    taken = (steps[0].get("pattern") or {}).get("Regex", "").split("|")
    return (
        [x for x in taken if not x.startswith("'")] == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
        and all(x["type"] == "ByteLevel" and not x.get("use_regex") for x in steps[1:])
        and all(x["type"] != "Replace" or x["pattern"] == {"Regex": r"\s+"} for x in (d.get("normalizer") or {}).get("normalizers", []))
        and d["model"]["type"] == "BPE"
        and bool(d["model"].get("end_of_word_suffix"))
    )


def drops_blanks(definition: str) -> bool:
    """Whether ids of a text are those of its words: blanks and line ends have none, and words don't act on another.

    True for a tokenizer whose first split keeps only matches without white space, after normalisers that work on
    characters, without a prefix blank.
    """
    d = json.loads(definition)
    steps = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [d.get("pre_tokenizer") or {}]
    first, normal = steps[0], d.get("normalizer") or {}
    plain = {"NFC", "NFD", "NFKC", "NFKD", "Replace", "Lowercase"}
    return (
        first.get("type") == "Split"
        and first.get("invert") is True
        and first.get("behavior") == "Removed"
        and r"[^\s" in (first.get("pattern") or {}).get("Regex", "")
        and {x["type"] for x in normal.get("normalizers", [normal] if normal else [])} <= plain
        and not any(x.get("add_prefix_space") for x in steps)
        and d.get("truncation") is None
    )


def _encoder(definition, by_word: bool, end: int, width: int):
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = WordEncoder(definition.value, by_word)
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            for a, b in pieces(text):
                found, sizes = encoder.encode([t or b"" for t in text.slice(a, b - a).to_pylist()])
                sizes = sizes + 1
                lasts = np.cumsum(sizes) - 1
                ids = np.empty(int(sizes.sum()), np.uint32)
                own = np.ones(len(ids), bool)
                own[lasts] = False
                ids[own], ids[lasts] = found, end
                cuts = cut_points(ids, np.cumsum(sizes).tolist())
                ends = np.array([c for cut in cuts for c in cut], np.int64)
                counts = np.array([len(c) for c in cuts], np.int64)
                whole = ids.astype(kind).tobytes()
                places = (ends * width).tolist()
                data = [whole[i:j] for i, j in zip([0, *places[:-1]], places, strict=True)]
                names = [hashlib.sha256(x).digest() for x in data]
                last = np.cumsum(counts).tolist()
                roots = [hashlib.sha256(b"".join(names[j - n : j])).digest() for n, j in zip(counts.tolist(), last, strict=True)]
                chunks = pa.StructArray.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(np.diff(ends, prepend=0).astype(np.int32)), pa.array(data, pa.binary())],
                    ["hash", "n", "data"],
                )
                offsets = pa.array(np.concatenate([[0], last]).astype(np.int32))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(a, b - a),
                        "n_tokens": pa.array(sizes),
                        "root": pa.array(roots, pa.binary()),
                        "chunks": pa.ListArray.from_arrays(offsets, chunks),
                    }
                )

    return run


def _tree(leaves: DataFrame, rounds: int) -> DataFrame:
    """(part, place, root) to one root a part, FANOUT to a node and round."""
    for _ in range(rounds):
        leaves = (
            leaves.groupBy("part", F.expr(f"place div {FANOUT}").alias("up"))
            .agg(F.array_sort(F.collect_list(F.struct("place", "root"))).alias("l"))
            .select("part", F.col("up").alias("place"), F.expr("unhex(sha2(unhex(array_join(transform(l, x -> hex(x.root)), '')), 256))").alias("root"))
        )
    return leaves.select("part", "root")


def write_store(
    docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> None:
    """Encodes every whole text, appends ``end``, and writes a store to ``path``.

    Texts are read once and never shuffled. What is shuffled are chunks by hash, to keep each once (equal ones meet
    before the shuffle too), and recipes, a few numbers and hashes a document, by ranges of doc_id. ``start`` comes
    from sums by part, one row for each of ``parts``, and a window within each part.

    Null text: as empty, one id. Null ids come first, in the order of their content; so do rows of one id among
    themselves. Repeated rows: each has a recipe, their chunks are stored once. Empty table: an empty store.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(definition).get_vocab_size(), end + 1) <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(definition)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id long, n_tokens long, root binary, chunks {CHUNKS}"
    staged = kept(rows.mapInArrow(_encoder(shared, drops_blanks(definition), end, width), schema), "encoded")

    each = staged.select(F.explode("chunks").alias("c")).select("c.hash", "c.n", "c.data")
    once = each.groupBy("hash").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    once.write.option("compression", "zstd").parquet(f"{path}/chunks")

    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = staged.select("doc_id", "n_tokens", "root", F.col("chunks.hash").alias("hashes"))
    narrow = narrow.repartitionByRange(parts, "doc_id", "root").withColumn("part", F.spark_partition_id())
    narrow = kept(narrow, "ranges")
    sums = narrow.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part").alias("of"), "docs", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("doc_id", "root")
    recipes = narrow.join(F.broadcast(sums), F.col("part") == F.col("of")).select(
        "part",
        (F.row_number().over(inside) - 1).cast("long").alias("place"),
        "doc_id",
        (F.col("before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("start"),
        "n_tokens",
        "hashes",
        "root",
    )
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark.read.parquet(f"{path}/recipes"), width).write.parquet(f"{path}/manifest")


def _manifest(recipes: DataFrame, width: int) -> DataFrame:
    sums = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    most = sums.agg(F.max("n_docs")).first()[0] or 1
    rounds = 1
    while FANOUT**rounds < most:
        rounds += 1
    tree = _tree(recipes.select("part", "place", "root"), rounds).withColumnRenamed("part", "of")
    return sums.join(tree, F.col("part") == F.col("of")).select(
        "part", "n_docs", "n_tokens", F.col("root").alias("root"), F.lit(width).alias("width")
    )


def _crc_step() -> np.ndarray:
    """(20, 4, 256): what 4 * 2**k zero bytes make of each byte of a CRC-32 register."""
    poly = 0xEDB88320
    bit = [poly] + [1 << i for i in range(31)]  # one zero bit, by register bit

    def times(m: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    matrix = bit
    for _ in range(5):  # 32 zero bits: one id of zeros
        matrix = [times(matrix, x) for x in matrix]
    tables = []
    for _ in range(20):
        tables.append([[times(matrix, b << 8 * k) for b in range(256)] for k in range(4)])
        matrix = [times(matrix, x) for x in matrix]
    return np.array(tables, np.uint32)


def crc_after(crc: np.ndarray, n: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Registers after ``n`` more 32-bit zeros each."""
    for k in range(len(tables)):
        move = (n >> k) & 1 == 1
        if move.any():
            c, t = crc[move], tables[k]
            crc = crc.copy()
            crc[move] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return crc


def _checker(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, crcs, sizes = batch.column("hash").to_pylist(), [], []
            for name, n, data in zip(names, batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if hashlib.sha256(data).digest() != name or n * width != len(data):
                    raise ValueError(f"chunk {name.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
                sizes.append(n)
            yield pa.record_batch({"hash": batch.column("hash"), "crc": pa.array(crcs, pa.int64()), "size": pa.array(sizes, pa.int32())})

    return run


def _joiner():
    tables: list[np.ndarray] = []

    @F.arrow_udf("long")
    def join(crcs: pa.Array, sizes: pa.Array) -> pa.Array:
        if not tables:
            tables.append(_crc_step())
        counts = np.asarray(pa.compute.list_value_length(crcs)).astype(np.int64)
        crc, size = (x.flatten().fill_null(0).to_numpy() for x in (crcs, sizes))  # a missing one raises later
        crc, size = crc.astype(np.uint32), size.astype(np.int64)
        first = np.cumsum(counts) - counts
        out = np.zeros(len(counts), np.uint32)
        for k in range(int(counts.max(initial=0))):
            live = np.flatnonzero(counts > k)
            at = first[live] + k
            out[live] = crc_after(out[live], size[at], tables[0]) ^ crc[at]
        return pa.array(out.astype(np.int64))

    return join


def _width(manifest: DataFrame) -> int:
    found = manifest.agg(F.max("width")).first()[0]
    return found or 4


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, and ids_crc32 of its ids as 32-bit little-endian integers.

    Every chunk is read back, held against its hash and summed up where it lies; documents' checksums come from their
    chunks' by the arithmetic of CRC-32, so ids aren't shuffled. Recipes are held against the manifest's roots and the
    documents' roots against their chunks. Damage, and a chunk that is missing, raise an error.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    recipes = spark.read.parquet(f"{path}/recipes")
    width = _width(manifest)
    verify_manifest(recipes, manifest, width)
    chunks = spark.read.parquet(f"{path}/chunks")
    facts = chunks.mapInArrow(_checker(width), "hash binary, crc long, size int").withColumnRenamed("hash", "name")
    bad = "unhex(sha2(unhex(array_join(transform(hashes, x -> hex(x)), '')), 256)) != root"
    recipes = recipes.withColumn("root", F.when(F.expr(bad), F.raise_error(F.lit("a recipe is damaged")).cast("binary")).otherwise(F.col("root")))
    used = recipes.select("part", "place", "doc_id", "start", "n_tokens", "root", F.posexplode("hashes").alias("seq", "hash"))
    parts = used.join(facts, F.col("hash") == F.col("name"), "left").groupBy("part", "place", "doc_id", "start", "n_tokens", "root").agg(
        F.array_sort(F.collect_list(F.struct("seq", "crc", "size"))).alias("l"), F.sum("size").alias("total"), F.count("size").alias("there")
    )
    whole = (F.col("total") == F.col("n_tokens")) & (F.col("there") == F.size("l"))
    parts = parts.withColumn("n_tokens", F.when(whole, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a chunk is missing")).cast("long")))
    return parts.select("doc_id", "start", "n_tokens", _joiner()(F.col("l.crc"), F.col("l.size")).alias("ids_crc32"))


def verify_manifest(recipes: DataFrame, manifest: DataFrame, width: int) -> None:
    """Raises if a part's recipes don't give the manifest's root and sums."""
    again = _manifest(recipes, width)
    names = ["part", "n_docs", "n_tokens", "root", "width"]
    wrong = again.select(names).exceptAll(manifest.select(names)).unionAll(manifest.select(names).exceptAll(again.select(names)))
    if wrong.take(1):
        raise ValueError("the manifest doesn't fit the recipes")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document, put together from recipes and chunks (a join and a shuffle of ids)."""
    width = _width(spark.read.parquet(f"{path}/manifest"))
    used = spark.read.parquet(f"{path}/recipes").select("part", "place", "doc_id", "start", F.posexplode("hashes").alias("seq", "name"))
    chunks = spark.read.parquet(f"{path}/chunks")

    @F.arrow_udf("array<int>")
    def unpack(data: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b"".join(x), f"<u{width}").astype(np.int32) for x in data.to_pylist()], pa.list_(pa.int32()))

    joined = used.join(chunks, F.col("name") == F.col("hash"))
    whole = joined.groupBy("part", "place", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("l"))
    return whole.select("doc_id", "start", unpack(F.col("l.data")).alias("ids"))
