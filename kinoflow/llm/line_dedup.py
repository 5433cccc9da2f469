"""Line deduplication: documents probe a sharded minimal perfect hash of line hashes instead of joining lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoflow.llm.batches import flat, lists
from kinoflow.llm.common import ascii_lower, kept, let, small_batches, spare
from kinoflow.llm.perfect_hash import Shard
from kinoflow.llm.word_cache import forget

BLANK = " \t\n\x0b\x0c\r"
SHARD_KEYS = 250_000
#: Arrays of more bytes than this aren't broadcast; line hashes are then sent to the shards.
BROADCAST_BYTES = 64 << 20
NO_KEEPER = -(1 << 63)


def line_hashes(text: Column, min_chars: int) -> Column:
    """For each line of a text a struct of two 64-bit hashes of its key, or null if the key is short."""

    def of(line: Column) -> Column:
        return let(
            F.btrim(line, F.lit(BLANK)),
            lambda key: F.when(
                F.char_length(key) >= min_chars,
                F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit("print"), key).alias("p")),
            ),
        )

    return F.transform(F.split(ascii_lower(text), "\n", -1), of)


def _distinct(keys: Column) -> Column:
    ordered = F.array_sort(F.filter(keys, lambda k: k.isNotNull()))
    return let(ordered, lambda s: F.filter(s, lambda k, i: (i == 0) | (k != F.get(s, i - 1))))


def build_shards(docs: DataFrame, min_chars: int, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """(shard, data) for the distinct keys that repeat; how many shards; how many bytes.

    docs: doc_id, text. Each document counts a key once; counts combine before the shuffle, so common lines cost one
    row a task. A key of one document alone needs no entry: a probe that finds none knows its count. Shards hold about
    ``shard_keys`` keys whatever the input; a key's shard is its second hash modulo their number. The key of a null
    doc_id counts; if no other holds it, it has no keeper and gets no entry either.
    """
    keys = docs.select("doc_id", F.explode_outer(_distinct(line_hashes(F.col("text"), min_chars))).alias("k"))
    repeated = (
        keys.where("k is not null")
        .groupBy("k.h", "k.p")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where("n > 1 and keeper is not null")
    )
    repeated = kept(repeated, "line-keys")
    n_shards = max(1, -(-repeated.count() // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        data = Shard.build(column("h").view(np.uint64), column("p").view(np.uint64), column("n"), column("keeper"))
        return pa.table({"shard": table.column("shard").slice(0, 1), "data": pa.array([data.to_bytes()], pa.binary())})

    shards = repeated.withColumn("shard", F.pmod("p", F.lit(n_shards)).cast("int"))
    shards = kept(shards.groupBy("shard").applyInArrow(build, "shard int, data binary"), "line-shards")
    size = shards.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    return shards, n_shards, size


def drops(shards: dict[int, Shard], n_shards: int, h: np.ndarray, p: np.ndarray, own: np.ndarray, min_docs: int) -> np.ndarray:
    """Which lines go: each key probes its own shard, where the count says whether it is common enough and the keeper
    who keeps it."""
    out = np.zeros(len(h), bool)
    of = p % n_shards
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(n_shards + 1)) if n_shards > 1 else np.array([0, len(h)])
    for k in np.flatnonzero(np.diff(ends)).tolist():
        at = order[ends[k] : ends[k + 1]]
        if k in shards:
            known, count, keeper = shards[k].probe(h[at].view(np.uint64), p[at].view(np.uint64))
            out[at] = known & (count >= min_docs) & (keeper != own[at])
    return out


def _prober(shards, n_shards: int, min_docs: int):
    """Drop flags for the lines of each row. shards: broadcast (number, bytes); short lines have null hashes."""
    loaded: dict[int, Shard] = {}

    @F.arrow_udf("array<boolean>")
    def flags(ids: pa.Array, h: pa.Array, p: pa.Array) -> pa.Array:
        if not loaded:
            forget()
            loaded.update((k, Shard.from_bytes(x)) for k, x in shards.value)
        h, counts = flat(h)
        p, _ = flat(p)
        own = np.repeat(ids.fill_null(NO_KEEPER).to_numpy(zero_copy_only=False), counts)
        return lists(drops(loaded, n_shards, h, p, own, min_docs), counts)

    return flags


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """Adds ``n_lines`` and ``n_dropped``, and takes lines that many documents share out of the text.

    A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at least ``min_chars``
    code points that at least ``min_docs`` rows hold lose all their lines but those of the largest id that holds one.
    The distinct hashes of keys that repeat are dealt to shards; each shard is a minimal perfect hash with arrays of
    fingerprint, count and keeper (20 bytes and some bits a key). Documents probe their lines' shards, and the counts
    there decide. If all shards together are under ``broadcast_bytes`` every worker gets them, and a text is neither
    shuffled nor joined; beyond that, line hashes travel to their shard (salted, so a common line fills no task) and
    come back as the keys to drop. Identity is 128 bits of hash.

    Null text: one empty line, stays null. Rows of one id: each counts, and all of the largest id keep their lines.
    Null id: counts as a row, is never the keeper; keys that only such rows hold stay. Empty table: no rows. All other
    columns stay, whatever their names; columns named n_lines or n_dropped are replaced.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    min_docs = max(2, min_docs)  # one row keeps its own lines in any case
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    shards, n_shards, size = build_shards(base, min_chars, shard_keys)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keys, drop, mark, one, of, lost = spare(docs.columns, "keys", "drop", "mark", "id", "of", "lost")
    lines = F.split(text, "\n", -1)
    if size <= broadcast_bytes:
        data = spark.sparkContext.broadcast([(r["shard"], bytes(r["data"])) for r in shards.collect()])
        flagger = _prober(data, n_shards, min_docs)
        with_keys = docs.withColumn(keys, line_hashes(text, min_chars))
        some = F.exists(keys, lambda k: k.isNotNull())
        zero = F.lit(0).cast("long")
        h = F.when(some, F.transform(keys, lambda k: F.coalesce(k["h"], zero))).otherwise(F.array().cast("array<long>"))
        p = F.when(some, F.transform(keys, lambda k: F.coalesce(k["p"], zero))).otherwise(F.array().cast("array<long>"))
        out = with_keys.withColumn(drop, flagger(F.col(id_col).cast("long"), h, p))
        dropped = lambda i: F.coalesce(F.get(drop, i), F.lit(False))
    else:
        marked = F.xxhash64(text)
        probes = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), marked.alias("mark"),
            F.explode_outer(_distinct(line_hashes(text, min_chars))).alias("k"),
        ).where("k is not null").select("doc_id", "mark", "k.h", "k.p")
        gone = _routed(probes, shards, n_shards, min_docs).toDF(one, of, lost)
        out = docs.withColumn(mark, marked).join(
            gone, F.col(id_col).cast("long").eqNullSafe(F.col(one)) & (F.col(mark) == F.col(of)), "left"
        )
        out = out.withColumn(keys, line_hashes(text, min_chars))
        out = out.withColumn(
            drop,
            F.transform(keys, lambda k: k.isNotNull() & F.coalesce(F.array_contains(lost, F.struct(k["h"].alias("h"), k["p"].alias("p"))), F.lit(False))),
        )
        dropped = lambda i: F.get(drop, i)
    n_dropped = F.size(F.filter(drop, lambda d: d))
    rest = F.array_join(F.filter(lines, lambda _, i: ~dropped(i)), "\n")
    result = {
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": n_dropped.cast("long"),
        text_col: F.when(n_dropped > 0, rest).otherwise(F.col(text_col)),
    }
    return out.select(*[result.get(c, F.col(c)).alias(c) for c in names], *[result[c].alias(c) for c in ("n_lines", "n_dropped")])


def _routed(probes: DataFrame, shards: DataFrame, n_shards: int, min_docs: int, rows: int = 1_000_000) -> DataFrame:
    """(doc_id, mark, lost): for each document the keys whose lines go, found at the shards."""
    probes = probes.withColumn("shard", F.pmod("p", F.lit(n_shards)).cast("int"))
    loads = probes.groupBy("shard").count()
    salts = loads.select(F.col("shard").alias("s"), F.ceil(F.col("count") / rows).cast("int").alias("salts"))
    left = probes.join(F.broadcast(salts), F.col("shard") == F.col("s")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "mark"), F.col("salts")).cast("int")
    )
    right = shards.join(F.broadcast(salts), F.col("shard") == F.col("s")).select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "data"
    )

    def probe(rows: pa.Table, data: pa.Table) -> pa.Table:
        drop = np.zeros(rows.num_rows, bool)
        if data.num_rows and rows.num_rows:
            shard = {0: Shard.from_bytes(data.column("data")[0].as_py())}
            own = rows.column("doc_id").combine_chunks().fill_null(NO_KEEPER).to_numpy(zero_copy_only=False)
            drop = drops(shard, 1, rows.column("h").to_numpy(), rows.column("p").to_numpy(), own, min_docs)
        return rows.select(["doc_id", "mark", "h", "p"]).filter(pa.array(drop))

    found = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(
        probe, "doc_id long, mark long, h long, p long"
    )
    return found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("h", "p")).alias("lost"))
