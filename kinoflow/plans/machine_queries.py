"""Queries that hold scans, checks, detectors with their defaults, and the scene machine against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoflow.operators import cascade, detectors
from kinoflow.operators.features import compute_features
from kinoflow.operators.remaining import remaining_keyframes
from kinoflow.options import AdaptiveOptions, ContentOptions, HistogramOptions, PhashOptions, SceneOptions, ThresholdOptions
from kinoflow.plans.queries import KEY, LUMA, RGB, SELECT
from kinoflow.sources.frames import canonical_pts, checked, embedding_frames, lineitem_frames, lineitem_pieces, lineitem_rows, marked_views
from kinoflow.timebase import SECOND

MS = 1_000_000


def frame_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with one defect or none, by their number; the error of each."""
    case = F.col("seq") % 9
    put = lambda k, value, name: F.when(case == k, value).otherwise(F.col(name))
    short = F.substring("luma", 1, 10)
    none = F.lit(None).cast("binary")
    rows = lineitem_frames(spark, sf_dir).withColumns({
        "luma_stride": put(0, 7, "luma_stride"),
        "width": F.when(case == 2, 0).when(case == 5, 2000).when(case == 7, (1 << 31) - 1).otherwise(F.col("width")),
        "height": put(5, 2000, "height"),
        "tb_num": put(3, 0, "tb_num"),
        "hue": put(4, F.col("luma"), "hue"), "sat": put(4, short, "sat"), "val": put(4, F.col("luma"), "val"),
        "rgb": put(5, none, "rgb"),
        "rgb_stride": put(6, 23, "rgb_stride"),
        "luma": F.when(case == 1, F.substring("luma", 1, 60)).when(case.isin(5, 7), none).otherwise(F.col("luma")),
    })
    good, bad = checked(rows)
    return good.select(*KEY, F.lit(None).cast("string").alias("error")).unionByName(bad.select(*KEY, "error"))


def views_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three views of each frame as three tables, luma's times in another timebase; some disagree on time or size."""
    case = F.col("seq") % 7
    base = ["stream_id", "seq", "pts", "tb_num", "tb_den", "width", "height"]
    rgb = lineitem_frames(spark, sf_dir, RGB).select(*base, "rgb", "rgb_stride", "channel_order")
    luma = lineitem_frames(spark, sf_dir, LUMA).select(*base, "luma", "luma_stride").withColumns(
        {"pts": F.when(case == 0, F.col("seq") + 1).otherwise(F.col("seq")), "tb_den": F.lit(25)}
    )
    planes = [F.col("luma").alias(c) for c in ("hue", "sat", "val")]
    hsv = lineitem_frames(spark, sf_dir, LUMA).select(*base, *planes, "hsv_stride")
    hsv = hsv.withColumn("width", F.when(case == 1, 4).otherwise(F.col("width")))
    return marked_views(rgb, luma, hsv).select(*KEY, "error")


def padded_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sharpness of planes whose rows are padded."""
    rows = F.concat(*[F.concat(F.substring("luma", 8 * i + 1, 8), F.lit(b"\xff\x00\x7f")) for i in range(8)])
    frames = lineitem_frames(spark, sf_dir).withColumns({"luma": rows, "luma_stride": F.lit(11)})
    made = compute_features(frames, ("luma_mean", "sharpness"))
    return made.select(*KEY, "luma_mean", F.col("sharpness").cast("double").alias("sharpness"))


def admitted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in three timebases, some early, in that of each stream's first frame."""
    kind, back = F.col("seq") % 3, F.when(F.col("seq") % 11 == 0, 3).otherwise(0)
    at = F.col("seq") - back
    rows = lineitem_rows(spark, sf_dir).select(
        *KEY,
        F.when(kind == 0, at * 40).when(kind == 1, at).otherwise(at * 1200 + F.col("seq") % 5).alias("pts"),
        F.lit(1).alias("tb_num"),
        F.when(kind == 0, 1000).when(kind == 1, 25).otherwise(30000).alias("tb_den"),
    )
    return canonical_pts(rows).select(*KEY, "pts", "rejected")


def plane_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of consecutive hue and saturation histograms."""
    rows = compute_features(lineitem_pieces(spark, sf_dir, RGB), ("corr_hue", "corr_sat"), bins_hsv=(16, 16)).dropna(subset=["corr_hue"])
    return rows.select(*KEY, F.round("corr_hue", 9).alias("corr_hue"), F.round("corr_sat", 9).alias("corr_sat"))


def hist_cuts_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = detectors.histogram_cuts(lineitem_pieces(spark, sf_dir, LUMA), HistogramOptions())
    return cuts.select("stream_id", "pts", F.round("score", 9).alias("correlation"))


def content_cuts_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.content_cuts(lineitem_pieces(spark, sf_dir, RGB), ContentOptions()).select("stream_id", "pts")


def content_score_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detectors.content_scores(lineitem_pieces(spark, sf_dir, RGB), (1.0, 0.5, 2.0, 1.5)).dropna(subset=["score"])
    return rows.select(*KEY, F.round("score", 9).alias("score"))


def fade_cuts_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fades of frames' luma, a second apart, with a cut where a stream ends in the dark."""
    options = ThresholdOptions(threshold=100, add_final_scene=True)
    return detectors.frame_fades(lineitem_pieces(spark, sf_dir, LUMA), options).select("stream_id", "pts")


def fade_cuts_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ThresholdOptions(threshold=150, method="ceiling", fade_bias=0.5, min_duration=0)
    return detectors.frame_fades(lineitem_pieces(spark, sf_dir, RGB), options, rgb=True).select("stream_id", "pts")


def adaptive_cuts_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.frame_adaptive_cuts(lineitem_pieces(spark, sf_dir, RGB), AdaptiveOptions()).select("stream_id", "pts")


def phash_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of consecutive perceptual hashes of frames drawn from the embeddings. 8x8 frames blown up to the default
    32x32 have coefficients that are zero but for rounding; at 6x6 none are."""
    rows = compute_features(embedding_frames(spark, sf_dir), ("phash_distance",), hash_size=6, lowpass=1).dropna(subset=["phash_distance"])
    return rows.select(*KEY, "phash_distance")


def phash_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.phash_cuts(embedding_frames(spark, sf_dir), PhashOptions(size=6, lowpass=1)).select("stream_id", "pts", F.col("score").alias("distance"))


def keyframes_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remaining_keyframes(lineitem_pieces(spark, sf_dir), SELECT)
    return found.select("stream_id", "bucket", "pts", "strict", F.col("quality").cast("double").alias("quality"))


#: Lanes with different least durations, and a cap that forces splits.
CONTEST = SceneOptions(
    lanes=("threshold", "luma_histogram", "sat_histogram", "content", "adaptive"),
    threshold=ThresholdOptions(threshold=100, min_duration=400 * MS),
    luma_histogram=HistogramOptions(bins=16, min_duration=1000 * MS),
    sat_histogram=HistogramOptions(bins=16, min_duration=1200 * MS, threshold=0.9),
    content=ContentOptions(threshold=60.0, min_duration=800 * MS),
    adaptive=AdaptiveOptions(min_duration=600 * MS),
    max_scene_duration=1000 * MS,
)


def cascade_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes of five lanes in contention, with deferred reports and forced splits."""
    found = cascade.scene_events(lineitem_pieces(spark, sf_dir), CONTEST, keyframes=False)
    return found.select("stream_id", "start_pts", "end_pts", "provenance")


def cascade_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyframes of one lane's scenes: boundaries, and the choice of each second of a scene."""
    options = SceneOptions(
        lanes=("luma_histogram",), luma_histogram=HistogramOptions(bins=16), select=SELECT.replace(target_interval=SECOND), max_scene_duration=None
    )
    found = cascade.scene_events(lineitem_pieces(spark, sf_dir), options).where("event_kind = 'keyframe'")
    return found.select("stream_id", "pts", "provenance")
