"""Benchmark decontamination by a prefix-filtered set join over whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoflow.llm.common import ascii_lower, let

#: What stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 5
#: Windows and item ids of more bytes than this are joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The words of a lower-cased text; null and blank texts have none."""

    def inner(parts: Column) -> Column:  # what stands before the first separator and after the last can be empty
        n = F.size(parts)
        skip = (F.get(parts, F.lit(0)) == "").cast("int")
        tail = ((n > 1) & (F.get(parts, n - 1) == "")).cast("int")
        return F.slice(parts, skip + 1, n - skip - tail)

    return let(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), inner)


def gram(parts: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(parts, at + i) for i in range(size)])


def item_windows(items: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(win, size, item_ids): the distinct windows of all items, and the sorted ids that have each."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w"))
    size = F.least(F.size("w"), F.lit(length))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    cut = w.where("size(w) > 0").select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win"))
    return cut.groupBy("win").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).withColumn("size", F.size("win"))


def _window_grams(windows: DataFrame, g: int) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.col("size") - g)).alias("at")
    return windows.select("win", "size", "item_ids", at).withColumn("gram", gram(F.col("win"), F.col("at"), g))


def _positions(docs: DataFrame, g: int) -> DataFrame:
    """A row for each place of each document where a gram can start; w rides along by reference until a join drops it.

    The outer form of the generator keeps the optimizer from adding a filter that would split every text twice.
    """
    rows = docs.select("key", "doc_id", "w", F.posexplode_outer("w").alias("pos", "word"))
    return rows.where(F.col("pos") + g <= F.size("w")).select(
        "key", "doc_id", "w", "pos", gram(F.col("w"), F.col("pos"), g).alias("doc_gram")
    )


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    length: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids and contaminated.

    A window is ``length`` consecutive words of an item, or a whole item of fewer. Windows are sets of 5-word shingles
    with their places. Shingles are ordered by how often the whole corpus has them; a document can only contain a
    window if it has the window's rarest shingle, so this one token is its prefix, and only it is joined. The place
    of the shingle fixes where the window must start; starts outside the document fail the bounds, and what is left is
    compared word by word with a slice of the document. Both passes over the documents are scans with a broadcast hash
    join: texts are never shuffled, only hits are. Where the items' shingles, with the words and
    item ids of their windows, take more than ``broadcast_bytes``, the same joins run by a shuffle of (document, place, slice) instead.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words, n_hit counting the words inside any occurrence. Null texts have
    no words. Rows of one id and one text share their result, each row is returned; rows of one id with different
    texts are judged apart. Items without words, or with a null text, have no windows; items of a null id count under
    the empty string. No items: nothing is hit. Empty documents table: no rows. Other columns don't matter.
    """
    item = items.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text_col).alias("text")
    )
    windows = item_windows(item, length, "item_id", "text")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"),
        words(F.col("text")).alias("w"),
    )
    sizes = sorted(r["g"] for r in windows.select(F.least("size", F.lit(GRAM)).alias("g")).distinct().collect())
    hits = None
    for g in sizes:
        of_size = F.least(F.col("size"), F.lit(GRAM)) == g
        grams = _window_grams(windows.where(of_size), g)
        letters = F.octet_length(F.array_join("win", "")) + F.octet_length(F.array_join("item_ids", ""))
        room = letters + 24 * (F.size("win") + F.size("item_ids")) + 64
        few = (grams.agg(F.sum(room.cast("long"))).first()[0] or 0) <= broadcast_bytes
        small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
        places = _positions(base, g)
        wanted = grams.select("gram").distinct()
        if not few:  # a slice wide enough for any window takes the place of the whole array before the shuffle
            low = F.greatest(F.col("pos") - (length - g), F.lit(0))
            places = places.select(
                "key", "doc_id", "doc_gram", "pos", low.alias("low"), F.size("w").alias("n"),
                F.slice("w", low + 1, 2 * length - g).alias("w"),
            )
        else:
            places = places.withColumn("low", F.lit(0)).withColumn("n", F.size("w"))
        seen = places.join(small(wanted), F.col("doc_gram") == F.col("gram"), "left_semi").groupBy("doc_gram").count()
        seen = seen.select(F.col("doc_gram").alias("g0"), "count")
        rarest = Window.partitionBy("win").orderBy("freq", "gram", "at")
        anchors = (
            grams.join(seen, F.col("gram") == F.col("g0"), "left")
            .withColumn("freq", F.coalesce("count", F.lit(0)))
            .withColumn("nth", F.row_number().over(rarest))
            .where("nth = 1 and freq > 0")
            .select("win", "size", "item_ids", "at", "gram")
        )
        start = F.col("pos") - F.col("at")
        found = (
            places.join(small(anchors), F.col("doc_gram") == F.col("gram"))
            .where((start >= 0) & (start + F.col("size") <= F.col("n")))
            .where(F.slice("w", start - F.col("low") + 1, F.col("size")) == F.col("win"))
            .select("key", "doc_id", start.alias("start"), "size", "item_ids")
        )
        hits = found if hits is None else hits.unionByName(found)
    whole = base.select("key", "doc_id", F.size("w").cast("long").alias("n_words"))
    if hits is None:
        return whole.select(
            "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
            F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated"),
        )
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", F.col("size").alias("len")))),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(s["start"] + s["len"] - F.greatest(a["to"], s["start"]), F.lit(0))).alias("hit"),
            F.greatest(a["to"], s["start"] + s["len"]).alias("to"),
        ),
        lambda a: a["hit"].cast("long"),
    )
    by_doc = hits.groupBy(F.col("key").alias("k")).agg(
        covered.alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("ids")
    )
    out = whole.join(by_doc, F.col("key") == F.col("k"), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
