"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinoflow.llm.batches import lists, pieces
from kinoflow.llm.common import cut, hub_join, kept, small_batches
from kinoflow.llm.components import connected_components
from kinoflow.llm.hashing import WordHashes, mix32, mix64, word_shingles
from kinoflow.llm.word_cache import forget

BANDS, ROWS = 40, 6
#: Rows and shingles of a block in which all pairs are compared.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 400_000


def circulant_signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash coordinates of a set of 64-bit hashes.

    Two permutations of the 32-bit ring: the first scatters the shingles, the second ranks them; coordinate k uses the
    second shifted by k places.
    """
    scattered = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    scattered = mix32(scattered, np.empty_like(scattered))
    shifts = np.arange(n, dtype=np.uint32)[:, None] * np.uint32(1)
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(scattered), 2048):
        part = scattered[None, at : at + 2048] - shifts
        np.minimum(out, mix32(part, np.empty_like(part)).min(axis=1), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit keys; equal where all coordinates of the band are equal."""
    s = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key


def _texts(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    forget()
    hashes = WordHashes()
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary())
        for a, b in pieces(text):
            yield batch.slice(a, b - a), word_shingles(text.slice(a, b - a).to_pylist(), shingle, hashes)


def signer(shingle: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _texts(batches, shingle):
            full = [s for s in sets if len(s)]
            signs = np.array([circulant_signature(s, bands * rows) for s in full], dtype=np.uint32)
            keys = band_keys(signs.reshape(len(full), bands * rows), bands, rows).view(np.int64)
            prints = [mix64(s ^ np.uint64(len(s))) for s in sets]
            low = np.array([s.sum(dtype=np.uint64) for s in prints], dtype=np.uint64).view(np.int64)
            high = np.array([mix64(s).sum(dtype=np.uint64) for s in prints], dtype=np.uint64).view(np.int64)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "low": pa.array(low),
                    "high": pa.array(high),
                    "bands": lists(keys.reshape(-1), [bands if len(s) else 0 for s in sets]),
                }
            )

    return sign


def set_maker(shingle: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _texts(batches, shingle):
            values = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "shingles": lists(values, [len(s) for s in sets])})

    return make


def block_linker(percent: int):
    """Compares all rows of one block with all of another by products of 0/1 matrices; returns links that span what
    they connect, fewer than there are rows."""

    def link(table: pa.Table) -> pa.Table:
        docs = table.column("doc_id").to_numpy()
        own = table.column("own").to_numpy().astype(bool)
        kinds = table.column("kind").to_numpy()
        column = table.column("shingles").combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        values = column.flatten().to_numpy()
        sizes = np.asarray(pa.compute.list_value_length(column)).astype(np.int64)
        owner = np.repeat(np.arange(len(docs)), sizes)
        left, right = np.flatnonzero(own), np.flatnonzero(~own)
        if not len(right):
            right = left
        names, column_of = np.unique(values, return_inverse=True)
        counts = np.bincount(column_of, minlength=len(names))
        shared = counts > 1
        place = np.cumsum(shared) - 1
        keep = shared[column_of]
        at, who = place[column_of[keep]], owner[keep]
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        both = np.zeros((len(left), len(right)), dtype=np.float64)
        to_left, to_right = np.full(len(docs), -1), np.full(len(docs), -1)
        to_left[left], to_right[right] = np.arange(len(left)), np.arange(len(right))
        width = 4096
        for begin in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(at, [begin, begin + width])
            x = np.zeros((len(left), width), dtype=np.float32)
            y = np.zeros((len(right), width), dtype=np.float32)
            w, c = who[a:b], at[a:b] - begin
            l, r = to_left[w] >= 0, to_right[w] >= 0
            x[to_left[w[l]], c[l]] = 1
            y[to_right[w[r]], c[r]] = 1
            both += x @ y.T
        union = sizes[left][:, None] + sizes[right][None, :] - both
        near = (100 * both >= percent * union) & (kinds[left][:, None] != kinds[right][None, :])
        root = list(range(len(docs)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for i, j in zip(*np.nonzero(near), strict=True):
            p, q = find(left[i]), find(right[j])
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(docs[left[i]])
                b.append(docs[right[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct ``shingle``-word
    shingles; component_id is the smallest doc_id reachable over links, kept says that it is the row's own.

    1. One pass over the texts makes a fingerprint of each set and its circulant MinHash signature, cut into bands.
    2. Documents of equal sets become one representative, the smallest id, before anything is joined by band.
    3. Representatives that share a band key form a bucket. Each is compared with the bucket's smallest member only:
       as many pairs as members. Shingle sets are made again, from the texts of these documents alone, and compared
       in full.
    4. A bucket with members that its smallest member doesn't link to may hold further links. The documents of such
       buckets are gathered by overlap, dealt into blocks of bounded size, and each pair of blocks is one task that
       multiplies 0/1 matrices; documents already linked to one pivot aren't compared again with each other. So no
       link of a shared band is lost, and no row per pair is made.
    5. Components by distributed star contraction; copies take over their representative's.

    With 40 bands of 6 coordinates, a pair of similarity 0.8 shares no band with probability 5e-6 (1 - 0.8**6)**40;
    more similar ones still less. All links found are exact.

    Null or blank texts: no shingles, linked with nothing. Rows of one id count as one document, which has the
    links of all their sets; each row is returned. Null ids: kept, component_id null, linked with nothing. Empty table: no rows. Other
    columns don't matter.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signs = kept(
        base.mapInArrow(
            signer(shingle, bands, rows), "doc_id long, n_shingles long, low long, high long, bands array<long>"
        ),
        "signatures",
    )
    real = signs.where("n_shingles > 0 and doc_id is not null")
    reps = real.groupBy("low", "high").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    reps = kept(reps, "representatives")
    members = reps.select(F.explode("bands").alias("bucket"), "rep", "n")
    buckets = (
        members.groupBy("bucket")
        .agg(F.count("*").alias("m"), F.min(F.struct("rep", "n")).alias("pivot"))
        .where("m > 1")
        .select(
            F.col("bucket").alias("of"), F.col("m").alias("size"), "m",
            F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n"),
        )
    )
    within = kept(hub_join(members, buckets, "bucket", "of", "size", bands * reps.count()), "buckets")
    fits = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    spokes = within.where(F.col("rep") != F.col("pivot"))
    stars = spokes.where(fits).select("pivot", "rep").distinct()

    wanted = within.where("m > 2").select("rep").union(stars.select("rep")).union(stars.select("pivot")).distinct()
    texts = base.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi")
    sets = kept(texts.mapInArrow(set_maker(shingle), "doc_id long, shingles array<long>"), "shingles")
    one = sets.select(F.col("doc_id").alias("ida"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("idb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = cut(
        stars.join(one, F.col("rep") == F.col("ida"))
        .join(two, F.col("pivot") == F.col("idb"))
        .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
        .select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        .distinct()
        .repartition("a", "b")  # as few files as the links fill, not one for each partition of shingles
    )

    far = spokes.where("m > 2").join(linked, (F.col("pivot") == F.col("a")) & (F.col("rep") == F.col("b")), "left_anti")
    open_buckets = far.select(F.col("bucket").alias("of"), F.col("m").alias("size"), F.lit(True).alias("open")).distinct()
    rest = cut(hub_join(within, open_buckets, "bucket", "of", "size", within.count()).select("bucket", "m", "rep", "n", "pivot"))
    more = linked.limit(0) if rest.isEmpty() else _links_in_blocks(rest, linked, sets, percent)
    # Rows of one id with different sets are one document: links between the sets' representatives.
    ids = real.groupBy("doc_id").agg(F.min("low").alias("l0"), F.max("low").alias("l1"), F.min("high").alias("h0"), F.max("high").alias("h1"))
    ids = ids.where("l0 != l1 or h0 != h1").select(F.col("doc_id").alias("id"))
    links = linked.unionByName(more)
    if not ids.isEmpty():
        doubles = real.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("low").alias("l"), F.col("high").alias("h"), "doc_id")
        doubles = reps.join(doubles, (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")))
        links = links.unionByName(doubles.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    named = connected_components(links)

    by_set = (
        reps.join(named, F.col("rep") == F.col("node"), "left")
        .select(F.col("low").alias("l"), F.col("high").alias("h"), F.coalesce("component", "rep").alias("c"))
    )
    lone = signs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("c"))
    full = real.join(by_set, (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")))
    out = full.select("doc_id", "n_shingles", "c").unionByName(lone)
    return out.select(
        "doc_id", "n_shingles", F.col("c").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("c")).alias("kept")
    )


def _links_in_blocks(rest: DataFrame, linked: DataFrame, sets: DataFrame, percent: int, spread: int = 64) -> DataFrame:
    """Links between members of buckets (bucket, m, rep, n, pivot) that no pivot has shown: (a, b).

    A group may hold any share of the rows: what is known of a group, or of a part of it, reaches its rows by
    :func:`hub_join`, and the rows of a group meet its list of blocks in ``spread`` lots.
    """
    named = connected_components(rest.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    grouped = cut(rest.join(named, F.col("rep") == F.col("node")).select("bucket", "m", "rep", "n", F.col("component").alias("grp")))
    # Buckets that only hang together as a chain are worked on one by one; overlapping ones as one group.
    groups = grouped.groupBy(F.col("grp").alias("g")).agg(
        F.count("*").alias("size"), (F.count_distinct("rep") > 8 * F.max("m")).alias("chained")
    )
    flagged = hub_join(grouped, groups, "grp", "g", "size", grouped.count())
    of = F.when(F.col("chained"), F.xxhash64(F.lit("bucket"), "bucket")).otherwise(F.col("grp"))
    units = flagged.select(of.alias("grp"), "rep", "n").distinct()
    kinds = linked.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("kind"))
    units = units.join(kinds, F.col("rep") == F.col("id"), "left").select("grp", "rep", "n", F.coalesce("kind", "rep").alias("kind"))
    units = cut(units.withColumn("own", F.struct("grp", "kind")))
    total = units.count()
    alike = units.groupBy(F.col("own").alias("o")).agg(F.count("*").alias("size"))
    alike = alike.withColumn("part", F.when(F.col("size") >= BLOCK_ROWS, F.col("o.kind")).otherwise(F.lit(-1).cast("long")))
    units = hub_join(units, alike, "own", "o", "size", total).drop("own").withColumn("lot", F.struct("grp", "part"))
    weight = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    deal = units.groupBy(F.col("lot").alias("l")).agg(F.count("*").alias("size"), weight.alias("blocks"))
    units = hub_join(units, deal, "lot", "l", "size", total).select(
        "grp", "rep", "kind", "part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    )
    others = deal.select(
        F.col("l.grp").alias("g"), F.col("l.part").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    ).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    units = units.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit("lot")), F.lit(spread)).cast("int"))
    paired = units.join(others.hint("merge"), (F.col("grp") == F.col("g")) & (F.col("salt") == F.col("s"))).where("part != p or part = -1")
    here, there = F.struct(F.col("part").alias("x"), F.col("block").alias("y")), F.struct(F.col("p").alias("x"), F.col("o").alias("y"))
    paired = paired.select(
        F.xxhash64("grp", F.least(here, there), F.greatest(here, there)).alias("unit"),
        "rep",
        "kind",
        (here <= there).alias("own"),
    )
    rows = paired.join(sets, F.col("rep") == F.col("doc_id")).select("unit", "doc_id", "kind", "own", "shingles")
    return rows.groupBy("unit").applyInArrow(block_linker(percent), "a long, b long")
