"""Approximate nearest neighbours by largest inner product: a permutation index over pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinoflow.llm.common import cut

BLOCK, QUERY_BLOCK = 16384, 2048


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of a sample, each the farthest from those before it, of unit length."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    unit = np.unique(unit, axis=0)
    chosen, nearest = [0], unit @ unit[0]
    for _ in range(min(n, len(unit)) - 1):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(vectors, prefix): the numbers of each vector's nearest pivots, nearest first; equally near ones by number."""
    out = np.empty((len(vectors), prefix), np.int64)
    for i in range(0, len(vectors), 2048):
        away = -(vectors[i : i + 2048] @ pivots.T)
        near = np.sort(np.argpartition(away, prefix - 1, axis=1)[:, :prefix], axis=1)
        order = np.argsort(np.take_along_axis(away, near, 1), axis=1, kind="stable")
        out[i : i + 2048] = np.take_along_axis(near, order, 1)
    return out


class BlockIndex:
    """The inverted files of a block of vectors: each pivot's posting list holds the vectors that have it among their
    nearest ``prefix`` pivots, and the place it has there. Equal vectors share an entry."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lift: float, pivots: np.ndarray, prefix: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        by = np.argsort(inverse.reshape(-1), kind="stable")
        self.ids, counts = ids[by], np.bincount(inverse.reshape(-1), minlength=len(self.vectors))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.prefix = prefix
        own = nearest_pivots(lifted(self.vectors, lift), pivots, prefix).reshape(-1)
        by_pivot = np.argsort(own, kind="stable")
        self.entries = (by_pivot // prefix).astype(np.int32)
        self.places = (by_pivot % prefix).astype(np.int16)
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(pivots)))])

    def nearest(self, asked: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` entries that are nearest by footrule to a query whose nearest pivots are ``asked``.

        Over pivots that either side lacks (place ``prefix``), the footrule distance is a constant less twice the sum
        of prefix - max(place, place) over the pivots that both have, so only the query's own lists are read.
        """
        n = len(self.vectors)
        if most >= n:
            return np.arange(n)
        spans = [slice(self.lists[p], self.lists[p + 1]) for p in asked.tolist()]
        seen = np.concatenate([self.entries[x] for x in spans])
        gains = np.concatenate([self.prefix - np.maximum(self.places[x], i) for i, x in enumerate(spans)])
        near = np.bincount(seen, gains, minlength=n)
        return np.argpartition(-near, most - 1)[:most]

    def search(self, query_id: int, query: np.ndarray, asked: np.ndarray, most: int, k: int):
        """The ``k`` best of the ``most`` entries that are nearest by footrule, as (ids, exact scores)."""
        found = self.nearest(asked, most)
        scores = (self.vectors[found] * query).sum(axis=1)
        if len(found) > k + 1:  # the query's own entry may be one
            bound = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            keep = scores >= bound
            found, scores = found[keep], scores[keep]
        ids, out = [], []
        for entry, score in zip(found.tolist(), scores.tolist(), strict=True):
            own = self.ids[self.first[entry] : min(self.first[entry + 1], self.first[entry] + k + 1)]
            own = own[own != query_id]
            ids.append(own)
            out.append(np.full(len(own), score))
        ids, out = np.concatenate([*ids, np.empty(0, np.int64)]), np.concatenate([*out, np.empty(0)])
        best = np.lexsort((ids, -out))[:k]
        return ids[best].astype(np.int64), out[best]


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more component, so that all have length ``norm`` and nearness goes by inner product."""
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
    return np.column_stack([vectors, rest])


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    pivots: int = 1024,
    prefix: int = 96,
    sample: int = 4096,
    share: float = 0.04,
    each: int = 12,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every``, the ``k`` found with the
    largest inner product, in double precision, its own row left out; ties go to the smaller id.

    Pivots are ``pivots`` mutually far vectors of a sample of at most ``sample`` rows (chosen by a hash). Every vector
    is represented by its nearest ``prefix`` pivots in order, and posted in those pivots' lists alone: vectors are dealt
    into blocks of about 16384 rows, queries into blocks of about 2048, and a task holds one of each. Within it a query
    reads the lists of its own nearest pivots, which give the footrule distance; the nearest entries (``share`` of the
    block, and ``each`` for each of the k asked for) are reranked by exact products of the original vectors. A second
    stage merges k rows a query and block. Memory of a task doesn't depend on the input. Recall doesn't depend on the
    number of blocks: each query takes the same share of each.

    Vectors that are null, zero, hold null or non-finite components, or have another number of components than most
    have, take no part, neither do null ids. Rows of one id: each is a candidate, and the id asks once, with the smallest
    of its vectors. Fewer than k candidates: all. Empty table: no rows. Other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine & F.exists("v", lambda x: x != 0))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = cut(rows.where(F.size("v") == sizes["dim"]))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    norm = float(rows.agg(F.max(square)).first()[0]) ** 0.5
    picked = rows.orderBy(F.xxhash64("v"), "id").limit(sample).select("v").collect()
    chosen = choose_pivots(lifted(np.array([r["v"] for r in picked]), norm), pivots)
    prefix = min(prefix, len(chosen))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks, query_blocks = max(1, -(-sizes["n"] // BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int, is_query: bool) -> DataFrame:
        return df.select(
            F.pmod(F.xxhash64("id", F.lit(own)), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other),
            F.lit(is_query).alias("asks"), "id", "v",
        ).select("block", "query_block", "asks", "id", "v")

    units = dealt(rows, "block", blocks, "query_block", query_blocks, False).unionByName(
        dealt(asked, "query_block", query_blocks, "block", blocks, True)
    )
    dim = sizes["dim"]

    def run(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(), table.column("id").to_numpy()
        values = np.concatenate([c.flatten().to_numpy() for c in table.column("v").chunks]).reshape(-1, dim)
        out_q, out_id, out_score = [], [], []
        if (~asks).any():
            index = BlockIndex(ids[~asks], values[~asks], norm, chosen, prefix)
            most = int(np.ceil(share * len(index.vectors))) + each * k
            near = nearest_pivots(np.column_stack([values[asks], np.zeros(asks.sum())]), chosen, prefix)
            for q, v, r in zip(ids[asks].tolist(), values[asks], near, strict=True):
                found, scores = index.search(q, v, r, most, k)
                out_q.append(np.full(len(found), q))
                out_id.append(found)
                out_score.append(scores)
        join = lambda x, kind: np.concatenate([*x, np.empty(0, kind)]).astype(kind)
        return pa.table({"query_id": join(out_q, np.int64), "vec_id": join(out_id, np.int64), "score": join(out_score, np.float64)})

    found = units.groupBy("block", "query_block").applyInArrow(run, "query_id long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id"))), 1, k)
    merged = found.groupBy("query_id").agg(best.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.away")).alias("score")
    )
