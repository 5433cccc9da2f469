"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = 1 << 16


def ring(n_shards: int, vnodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """(point, shard) in ring order: ``vnodes`` virtual nodes a shard; of two on a point the smaller shard stays."""
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            point = int.from_bytes(hashlib.blake2b(f"{seed}:{shard}:{v}".encode(), digest_size=2).digest(), "big")
            at[point] = min(shard, at.get(point, shard))
    for shard in range(n_shards):  # a shard that lost all its points gets the first free one
        if shard not in at.values():
            at[next(p for p in range(POINTS) if p not in at)] = shard
    return sorted(at.items())


def place(loads: dict[int, int], nodes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, slot): ranks from..to of an arc's keys go to a shard, from that slot on.

    Round by round, each arc offers what it has left to the next shard clockwise, which takes it up to its capacity;
    what a full shard can't take goes on. Capacities add up to the number of keys and differ by one at most.
    """
    each, more = divmod(sum(loads.values()), n_shards)
    free = [each + (s < more) for s in range(n_shards)]
    used, done, out = [0] * n_shards, dict.fromkeys(loads, 0), []
    clockwise = {}
    for arc in loads:
        walk = dict.fromkeys(nodes[(arc + i) % len(nodes)][1] for i in range(len(nodes)))
        clockwise[arc] = list(walk)
    for step in range(n_shards):
        for arc in sorted(loads):
            shard = clockwise[arc][step]
            if take := min(loads[arc] - done[arc], free[shard] - used[shard]):
                out.append((arc, done[arc], done[arc] + take, shard, used[shard]))
                done[arc] += take
                used[shard] += take
    return out


def shard_bounded(
    docs: DataFrame, n_shards: int = 24, vnodes: int = 128, id_col: str = "doc_id", text_col: str = "text", seed: int = 0
) -> DataFrame:
    """Puts every row into one of ``n_shards`` shards whose counts differ by one at most.

    A key's hash falls on an arc of the ring, the arc's virtual node names the shard, and keys that overflow a full
    shard continue clockwise. Returns (doc_id, size, text_crc32, shard, slot); slots have no gaps within a shard.

    Only the counts by arc come to the driver: ``n_shards * vnodes`` numbers at most, whatever the input. The rows of
    an arc are ranked by hash in a window over narrow rows (a text is read for its size and checksum and never
    shuffled); equal rows are counted before the shuffle and dealt out from that count, so a key that holds much of
    the table is one row there.

    Null text: size 8, checksum 0. Null id: the text's checksum and size decide the point. Repeated rows: each gets a
    slot of its own. Empty table: no rows. Other columns don't matter. Ties in hash: by id, size, checksum.
    """
    spark = docs.sparkSession
    nodes = ring(n_shards, vnodes, seed)
    arcs, k = [], 0
    for point in range(POINTS):
        while k < len(nodes) and nodes[k][0] < point:
            k += 1
        arcs.append((point, k % len(nodes)))
    arc_of = F.broadcast(spark.createDataFrame(arcs, "point int, arc int"))  # POINTS rows
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("size", "text_crc32")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("hash", key).withColumn("point", F.shiftrightunsigned("hash", 48).cast("int"))
    rows = rows.join(arc_of, "point")
    loads = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    parts = place(loads, nodes, n_shards) if loads else []
    lots = spark.createDataFrame(parts, "in_arc int, first long, past long, shard int, base long")  # arcs + overflows

    by = ["arc", "hash", "doc_id", "size", "text_crc32"]
    same = rows.groupBy(*by).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("arc").orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, 0)
    ranked = same.withColumn("end", F.sum("copies").over(order)).withColumn("begin", F.col("end") - F.col("copies"))
    lot = ranked.join(
        F.broadcast(lots),
        (F.col("arc") == F.col("in_arc")) & (F.col("begin") < F.col("past")) & (F.col("end") > F.col("first")),
    )
    low, high = F.greatest("begin", "first"), F.least("end", "past")
    block = 1 << 16  # copies are dealt out block by block, so no array grows with their number
    return (
        lot.withColumn("low", low)
        .withColumn("n", high - low)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))))
        .withColumn(
            "nth", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(block), F.expr(f"n - block * {block}")) - 1))
        )
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("base") + F.col("low") - F.col("first") + F.col("block") * block + F.col("nth")).alias("slot"),
        )
    )
