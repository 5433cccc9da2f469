"""Keyframes of given shots: buckets, gates, an adaptive floor and two ranked choices, all as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoflow.functions.columns import METRICS, composite_quality, hard_gate, in_domain
from kinoflow.options import SelectOptions
from kinoflow.timebase import SECOND

SAMPLES = 4096


def metric_columns() -> dict[str, Column]:
    return {m: F.col(m) for m in METRICS}


def bucket_count(options: SelectOptions) -> Column:
    """How many keyframes a shot (start_pts, end_pts, tb_num, tb_den) gets."""
    ns = (F.col("end_pts") - F.col("start_pts")).cast("decimal(20,0)") * F.col("tb_num") * SECOND
    unit = F.lit(options.target_interval).cast("decimal(20,0)") * F.col("tb_den")
    return F.least(F.greatest(F.ceil(ns / unit), F.lit(1)), F.lit(options.max_frames_per_shot)).cast("int")


def shot_buckets(shots: DataFrame, options: SelectOptions = SelectOptions()) -> DataFrame:
    """(stream_id, start_pts, end_pts, bucket, lo, hi) of every shot: equal parts, the first and last shortened by the
    margin unless that leaves nothing. Instants have no buckets."""
    span, n = F.col("end_pts") - F.col("start_pts"), F.col("n")
    rows = shots.where("end_pts > start_pts").withColumn("n", bucket_count(options))
    rows = rows.withColumn("bucket", F.explode(F.sequence(F.lit(0), n - 1)))
    m = float(options.margin_ratio)
    low, high = F.col("bucket") / n, (F.col("bucket") + 1) / n
    cut_low = F.when(F.col("bucket") == 0, low + m).otherwise(low)
    cut_high = F.when(F.col("bucket") == n - 1, high - m).otherwise(high)
    tick = lambda share: F.col("start_pts") + (share * span).cast("long")
    empty = (cut_low >= cut_high) | (tick(cut_low) >= tick(cut_high))
    lo = F.when(empty, tick(low)).otherwise(tick(cut_low))
    hi = F.when(empty, tick(high)).otherwise(tick(cut_high))
    return rows.withColumns({"lo": lo, "hi": hi}).drop("n")


def effective_floor(frames: DataFrame, options: SelectOptions = SelectOptions(), by=("stream_id", "start_pts")) -> DataFrame:
    """(by..., floor): the least sharpness of a strict choice in each shot, from its :func:`placed_frames`.

    It is min_sharpness, or a percentile of the shot's frames that pass the gate if that is lower and there are enough
    of them; at most 4096, evenly spaced in time, are looked at.
    """
    return with_floor(frames, options, by).select(*by, "floor").distinct()


def with_floor(frames: DataFrame, options: SelectOptions = SelectOptions(), by=("stream_id", "start_pts")) -> DataFrame:
    """Adds each shot's ``floor`` to its frames, by windows over one shuffle: frames are made once, and nothing is joined."""
    floor = F.lit(options.min_sharpness).cast("float")
    if not options.adaptive_floor:
        return frames.withColumn("floor", floor)
    whole = Window.partitionBy(*by)
    good = ~hard_gate(metric_columns(), options)
    rows = frames.withColumns({"_good": good, "_total": F.count_if(good).over(whole)})
    rows = rows.withColumn("_at", F.count_if("_good").over(whole.orderBy("pts", "seq").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    slot = F.expr(f"(_at * least(_total, {SAMPLES})) div _total")
    before = F.expr(f"((_at - 1) * least(_total, {SAMPLES})) div _total")
    rows = rows.withColumn("_seen", F.col("_good") & ((F.col("_at") == 0) | (slot != before)))
    rows = rows.withColumn("_rank", F.when(F.col("_seen"), F.row_number().over(whole.orderBy(F.desc("_seen"), "sharpness", "pts", "seq")) - 1))
    seen = F.count_if("_seen").over(whole)
    at = F.least((seen * float(options.adaptive_percentile)).cast("long"), seen - 1)
    low = F.max(F.when(F.col("_rank") == F.col("_want"), F.col("sharpness"))).over(whole)
    rows = rows.withColumn("_want", at).withColumn("_low", low)
    enough = F.col("_total") >= max(options.adaptive_min_samples, 1)
    rows = rows.withColumn("floor", F.coalesce(F.when(enough, F.least(floor, F.col("_low"))), floor))
    return rows.drop("_good", "_total", "_at", "_seen", "_rank", "_want", "_low")


def shot_of(frames: DataFrame, shots: DataFrame, bits: int | None = None) -> DataFrame:
    """Frames with the start and end of the shot [start, end) that holds them, by one window over both tables instead of
    a range join. Shots of a stream must not overlap.

    ``bits``: streams are cut into parts of 2**bits ticks, and a shot goes to each part that it reaches into, so a stream
    is many tasks; its last shot must then end where the stream does, not at the end of time.
    """
    part = (lambda c: F.shiftright(c, bits)) if bits else (lambda c: F.lit(0).cast("long"))
    start, end, at = F.col("start_pts"), F.col("end_pts"), F.col("pts")
    marks = shots.select("stream_id", start.alias("pts"), F.struct("start_pts", "end_pts").alias("shot"), *((part(start).alias("_a"), part(end - 1).alias("_b")) if bits else ()))
    if bits:
        marks = marks.where("shot.end_pts > shot.start_pts").withColumn("_part", F.explode(F.sequence("_a", "_b")))
        marks = marks.withColumn("pts", F.greatest("pts", F.shiftleft("_part", bits))).drop("_a", "_b")
    else:
        marks = marks.withColumn("_part", part(at))
    names = frames.columns
    kinds = dict(frames.dtypes)
    left = frames.withColumn("shot", F.lit(None).cast("struct<start_pts:bigint,end_pts:bigint>")).withColumns({"_part": part(at), "_o": F.lit(1)})
    right = marks.select(*[F.col(c) if c in ("stream_id", "pts") else F.lit(None).cast(kinds[c]).alias(c) for c in names], "shot", "_part", F.lit(0).alias("_o"))
    order = Window.partitionBy("stream_id", *(("_part",) if bits else ())).orderBy("pts", "_o")
    rows = left.unionByName(right).withColumn("shot", F.last("shot", True).over(order))
    rows = rows.where("_o = 1 and shot is not null and pts < shot.end_pts")
    return rows.select(*names, "shot.start_pts", "shot.end_pts")


def placed_frames(frames: DataFrame, shots: DataFrame, options: SelectOptions = SelectOptions(), bits: int | None = None) -> DataFrame:
    """Frames with their shot and bucket; those in a shot's margins are left out. Buckets tile what the margins leave, so
    a frame has one at most. ``bits``: as in :func:`shot_of`."""
    inside = shot_of(frames.select("stream_id", "seq", "pts", *METRICS), shots, bits)
    buckets = shot_buckets(shots, options).select("stream_id", "start_pts", "bucket", "lo", "hi")
    return inside.join(buckets, ["stream_id", "start_pts"]).where("pts >= lo and pts < hi")


def select_keyframes(frames: DataFrame, shots: DataFrame, options: SelectOptions = SelectOptions(), bits: int | None = None) -> DataFrame:
    """(stream_id, start_pts, end_pts, bucket, pts, seq, strict, metrics...): the chosen frame of each bucket.

    Strict: passes the gate, is sharp enough, and has the best composite quality. Where no frame is, the sharpest one
    of sensible metrics is the fallback. Ties go to the earliest. ``frames`` hold pts, seq and the metrics; ``shots``
    start_pts, end_pts, tb_num, tb_den. ``bits``: as in :func:`shot_of`.
    """
    placed = with_floor(placed_frames(frames, shots, options, bits), options)
    m = metric_columns()
    quality = composite_quality(m, options.weights)
    fine = ~F.isnan(quality) & (F.abs(quality) < F.lit(float("inf")).cast("float"))
    rows = placed.withColumns(
        {"quality": quality, "strict": ~hard_gate(m, options) & (F.col("sharpness") >= F.col("floor")) & fine, "sane": in_domain(m)}
    ).where("strict or sane")
    key = F.when(F.col("strict"), F.col("quality")).otherwise(F.col("sharpness"))
    best = Window.partitionBy("stream_id", "start_pts", "bucket").orderBy(F.desc("strict"), key.desc(), "pts", "seq")
    rows = rows.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return rows.select("stream_id", "start_pts", "end_pts", "bucket", "pts", "seq", "strict", "quality", *METRICS)


def select_remaining(frames: DataFrame, options: SelectOptions = SelectOptions(), ends: DataFrame | None = None) -> DataFrame:
    """Keyframes of streams that end without a closing cut: one shot a stream, from its first frame to its end.

    ``ends``: (stream_id, end_pts); by default a tick after the last frame. An end at or before the first frame: nothing.
    """
    first = frames.groupBy("stream_id").agg(
        F.min("pts").alias("start_pts"), (F.max("pts") + 1).alias("last_pts"),
        F.min_by("tb_num", "seq").alias("tb_num"), F.min_by("tb_den", "seq").alias("tb_den"),
    )
    if ends is None:
        shots = first.withColumnRenamed("last_pts", "end_pts")
    else:
        shots = first.drop("last_pts").join(ends.select("stream_id", "end_pts"), "stream_id")
    return select_keyframes(frames, shots.where("end_pts > start_pts"), options)


def scene_of(keyframes: DataFrame, scenes: DataFrame, bits: int | None = None) -> DataFrame:
    """Keyframes with the scene [start_pts, end_pts) that holds them. ``bits``: as in :func:`shot_of`."""
    return shot_of(keyframes, scenes, bits)
