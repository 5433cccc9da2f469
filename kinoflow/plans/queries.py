"""The engine's queries over frames and series derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from kinoflow.functions import columns as C
from kinoflow.operators import cascade, detectors, keyframes
from kinoflow.operators.features import compute_features
from kinoflow.options import AdaptiveOptions, ContentOptions, HistogramOptions, SceneOptions, SelectOptions, ThresholdOptions
from kinoflow.sources.frames import event_series, lineitem_frames, lineitem_pieces, lineitem_rows

MS = 1_000_000
GAP = 200 * MS


def by_seq() -> WindowSpec:
    return Window.partitionBy("stream_id").orderBy("seq")
KEY = ("stream_id", "seq")
HIST = HistogramOptions(bins=16, min_duration=GAP)
#: Streams are cut every 131 seconds where frames meet their shots.
PART_BITS = 17
LUMA_ONLY = (0.0, 0.0, 1.0, 0.0)
SELECT = SelectOptions(target_interval=80 * MS, min_sharpness=4000.0, adaptive_min_samples=3, black_mean=40.0, luma_variance=120.0, sat_variance=900.0)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a pixel, with r, g, b: for functions that are column expressions."""
    rows = lineitem_rows(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    x, y, k = F.col("i") % 8, F.floor(F.col("i") / 8).cast("int"), F.col("shot_key")
    luma = (k * 37) % 180 + (x * (k % 5 + 1) * 3 + y * (k % 7 + 1) * 2) % 60 + F.col("qty") % 8
    rows = rows.select(*KEY, "i", x.alias("x"), y.alias("y"), luma.cast("int").alias("r"))
    return rows.withColumns({"g": (F.col("r") * 3 + F.col("x") * 5) % 256, "b": (F.col("r") * 7 + F.col("y") * 11) % 256})


def _digest(name: str, c):
    return [F.sum(c).alias(f"sum_{name}"), F.sum(c * (F.col("i") + 1)).alias(f"digest_{name}")]


def luma_from_bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = C.luma(F.col("r"), F.col("g"), F.col("b")).cast("long")
    return pixels(spark, sf_dir).groupBy(*KEY).agg(*_digest("luma", y))


def hsv_from_bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = [F.col(c) for c in "rgb"]
    rows = pixels(spark, sf_dir).withColumns({"h": C.hue(*rgb), "s": C.saturation(*rgb), "v": F.greatest(*rgb)})
    return rows.groupBy(*KEY).agg(*[e for c in "hsv" for e in _digest(c, F.col(c).cast("long"))])


RGB, LUMA = ("rgb",), ("luma",)


def _features(spark: SparkSession, sf_dir: str, *names: str, views: tuple[str, ...] = RGB + LUMA, **options) -> DataFrame:
    return compute_features(lineitem_pieces(spark, sf_dir, views), names, **options)


def _as_double(df: DataFrame, *names: str, drop_nulls: bool = False) -> DataFrame:
    out = df.select(*KEY, *[F.col(n).cast("double").alias(n) for n in names])
    return out.dropna(subset=list(names)) if drop_nulls else out


def frame_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_double(_features(spark, sf_dir, "luma_mean", "rgb_mean"), "luma_mean", "rgb_mean")


def plane_mean_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("brightness", "luma_variance", "saturation_variance")
    return _as_double(_features(spark, sf_dir, *names), *names)


def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir, "hist_luma", bins=16, views=LUMA)
    return rows.select(*KEY, F.posexplode("hist_luma").alias("bin", "n")).where("n > 0")


def _metric(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _as_double(_features(spark, sf_dir, name), name)

    return query


clipping_ratio, colorfulness = _metric("clipping"), _metric("colorfulness")
tenengrad, noise_sigma, motion_blur = _metric("sharpness"), _metric("noise"), _metric("motion_blur")


def mean_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("d_hue", "d_sat", "d_lum")
    return _as_double(_features(spark, sf_dir, *names, views=RGB), *names, drop_nulls=True)


def hist_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir, "corr_luma", bins=16, views=LUMA).dropna(subset=["corr_luma"])
    return rows.select(*KEY, F.round("corr_luma", 9).alias("correlation"))


def hist_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = detectors.histogram_cuts(lineitem_pieces(spark, sf_dir, LUMA), HIST)
    return cuts.select("stream_id", "pts", F.round("score", 9).alias("correlation"))


def content_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detectors.content_scores(lineitem_pieces(spark, sf_dir, RGB)).dropna(subset=["score"])
    return rows.select(*KEY, F.round("score", 9).alias("score"))


def _content_cuts(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = ContentOptions(weights=LUMA_ONLY, filter_mode=mode, min_duration=GAP)
        return detectors.content_cuts(lineitem_pieces(spark, sf_dir, LUMA), options, luma_only=True).select("stream_id", "pts")

    return query


content_cuts_suppress, content_cuts_merge = _content_cuts("suppress"), _content_cuts("merge")


def fade_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = event_series(spark, sf_dir).withColumnRenamed("value", "mean")
    return detectors.fade_cuts(means, ThresholdOptions(min_duration=0)).select("stream_id", "pts")


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_series(spark, sf_dir)
    return rows.withColumn("score", F.abs(F.col("value") - F.lag("value").over(by_seq())))


def adaptive_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detectors.adaptive_ratios(_deltas(spark, sf_dir)).dropna(subset=["ratio"])
    return rows.select(*KEY, F.round("ratio", 6).alias("ratio"))


def adaptive_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.adaptive_cuts(_deltas(spark, sf_dir), AdaptiveOptions(min_duration=0)).select("stream_id", "pts")


def _with_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, *C.METRICS)


def hard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_metrics(spark, sf_dir).select(*KEY, C.hard_gate(keyframes.metric_columns(), SELECT).alias("rejected"))


def composite_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = C.composite_quality(keyframes.metric_columns())
    return _with_metrics(spark, sf_dir).select(*KEY, q.cast("double").alias("quality"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lineitem_rows(spark, sf_dir).groupBy("stream_id", "shot_key").agg(
        F.min("pts").alias("start_pts"), (F.max("pts") + 40).alias("end_pts")
    )
    return found.select("stream_id", "start_pts", "end_pts", F.lit(1).alias("tb_num"), F.lit(1000).alias("tb_den"))


def effective_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = keyframes.placed_frames(_with_metrics(spark, sf_dir), shots(spark, sf_dir), SELECT, PART_BITS)
    return keyframes.effective_floor(inside, SELECT).withColumn("floor", F.col("floor").cast("double"))


def shot_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyframes.shot_buckets(shots(spark, sf_dir), SELECT).select("stream_id", "start_pts", "bucket", "lo", "hi")


def keyframe_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyframes.select_keyframes(_with_metrics(spark, sf_dir), shots(spark, sf_dir), SELECT, PART_BITS)
    return found.select("stream_id", "start_pts", "bucket", "pts", "strict", F.col("quality").cast("double").alias("quality"))


def scene_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame, and its scene: from a histogram cut, or the stream's first frame, up to the next cut."""
    rows = lineitem_rows(spark, sf_dir).select("stream_id", "pts")
    cuts = detectors.histogram_cuts(lineitem_pieces(spark, sf_dir, LUMA), HIST).select("stream_id", F.col("pts").alias("start_pts"))
    spans = rows.groupBy("stream_id").agg(F.min("pts").alias("start_pts"), (F.max("pts") + 1).alias("last"))
    starts = cuts.withColumn("last", F.lit(None).cast("long")).unionByName(spans).groupBy("stream_id", "start_pts").agg(F.max("last").alias("last"))
    by_start = Window.partitionBy("stream_id").orderBy("start_pts")
    end = F.coalesce(F.lead("start_pts").over(by_start), F.max("last").over(Window.partitionBy("stream_id")))
    scenes = starts.select("stream_id", "start_pts", end.alias("end_pts"))
    return keyframes.scene_of(rows, scenes, PART_BITS).select("stream_id", "pts", "start_pts")


def phash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_double(_features(spark, sf_dir, "phash_distance", views=LUMA), "phash_distance", drop_nulls=True)


def edge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, "d_edges", "edge_count", views=RGB).select(*KEY, "d_edges", "edge_count")


def downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame at 4x4, as sums and a digest of its channels."""
    import numpy as np
    import pyarrow as pa

    from kinoflow.functions import kernels

    def run(batches):
        for batch in batches:
            rgb = np.stack([np.frombuffer(x, np.uint8).reshape(8, 8, 3) for x in batch.column("rgb").to_pylist()])
            small = kernels.downscale(rgb, 4).reshape(len(rgb), -1, 3).astype(np.int64)
            place = np.arange(1, 17)[None, :, None]
            yield pa.record_batch(
                {"stream_id": batch.column("stream_id"), "seq": batch.column("seq"),
                 "total": pa.array(small.sum(axis=(1, 2))), "digest": pa.array((small * place).sum(axis=(1, 2)))}
            )

    return lineitem_frames(spark, sf_dir).mapInArrow(run, "stream_id long, seq long, total long, digest long")


def cascade_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.scene_events(lineitem_pieces(spark, sf_dir), SceneOptions())
