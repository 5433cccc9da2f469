"""The five cut detectors: features, window columns, and a spacing rule where one is asked for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinoflow.operators.features import Pack, as_arrow, compute_features
from kinoflow.operators.fold import fold_packed, fold_streams
from kinoflow.operators.gates import CUTS, AdaptiveSpacing, Fade, FlashFilter, ScoredSpacing, Spacing
from kinoflow.options import AdaptiveOptions, ContentOptions, HistogramOptions, PhashOptions, ThresholdOptions
from kinoflow.timebase import Timebase, least_ticks


def by_seq() -> WindowSpec:
    return Window.partitionBy("stream_id").orderBy("seq")


def spaced(scored: DataFrame, options, machine=Spacing) -> DataFrame:
    """(stream_id, pts, score) of the candidates that the spacing rule lets through. Without a least duration every
    candidate fires and no state is needed; otherwise only candidates and each stream's first row reach the fold."""
    if options.min_duration == 0:
        return scored.where("candidate").select("stream_id", "pts", F.col("score").cast("double").alias("score"))
    rows = scored.where(F.col("score").isNotNull()) if machine is ScoredSpacing else scored
    names = [c for c in ("tb_num", "tb_den") if c in rows.columns]
    rows = rows.select("stream_id", "seq", "pts", *names, F.col("score").cast("double").alias("score"), "candidate")
    rows = rows.withColumn("nth", F.row_number().over(by_seq())).where("candidate or nth = 1").drop("nth")
    return fold_streams(rows, lambda: machine(options), CUTS)


def known(values) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether they are known) of a feature."""
    return values if isinstance(values, tuple) else (values, np.ones(len(values), bool))


def scored_pack(score, matter) -> Pack:
    """Packs pts, timebase, the score and whether it counts: ``score(made)`` gives (values, known), ``matter(values,
    known, columns)`` the rows that the machine must see."""

    def columns(part: dict, made: dict) -> dict:
        values, there = score(made)
        cols = {c: part[c] for c in ("pts", "tb_num", "tb_den", "width", "height")}
        return cols | {"score": as_arrow((values, there), pa.float64()), "candidate": pa.array(matter(values, there, cols))}

    return Pack(columns, lambda cols: cols["candidate"].to_numpy(zero_copy_only=False))


def hits(frames: DataFrame, feature: str, hit, options, **how) -> DataFrame:
    """Cuts at the frames whose ``feature`` is a ``hit``, through the spacing rule: only those leave the pass over frames."""
    if options.min_duration == 0:
        rows = compute_features(frames, (feature,), **how).withColumnRenamed(feature, "score")
        return spaced(rows.withColumn("candidate", F.coalesce(hit(F.col("score")), F.lit(False))), options)
    pack = scored_pack(lambda made: known(made[feature]), lambda values, there, _: hit(values) & there)
    return fold_packed(compute_features(frames, (feature,), pack=pack, **how), lambda: Spacing(options), CUTS)


def histogram_cuts(frames: DataFrame, options: HistogramOptions = HistogramOptions(), chunk: int | None = None) -> DataFrame:
    """Cuts where consecutive luma histograms correlate by 1 - threshold or less."""
    least = 1.0 - options.threshold
    return hits(frames, "corr_luma", lambda score: score <= least, options, bins=options.bins, chunk=chunk)


def phash_cuts(frames: DataFrame, options: PhashOptions = PhashOptions(), chunk: int | None = None) -> DataFrame:
    """Cuts where perceptual hashes differ in a share of bits of threshold or more."""
    how = {"hash_size": options.size, "lowpass": options.lowpass, "chunk": chunk}
    return hits(frames, "phash_distance", lambda score: score >= options.threshold, options, **how)


def fade_cuts(means: DataFrame, options: ThresholdOptions = ThresholdOptions()) -> DataFrame:
    """Cuts at fades, from (stream_id, seq, pts, mean) with optional tb_num and tb_den.

    Without a least duration the rule is a window over changes of state; otherwise it is folded. Rows without a mean
    count as no frames.
    """
    means = means.where(F.col("mean").isNotNull())
    if options.min_duration > 0:
        return fold_streams(means, lambda: Fade(options), CUTS)
    dark = F.col("mean") < options.threshold if options.method == "floor" else F.col("mean") >= options.threshold
    rows = means.withColumn("dark", dark & ~F.isnan("mean")).withColumn("was", F.lag("dark").over(by_seq()))
    rows = rows.withColumn("went", F.when(F.col("dark") & F.coalesce(~F.col("was"), F.lit(True)), F.col("pts")))
    rows = rows.withColumn("out_at", F.last("went", True).over(by_seq()))
    bias = min(max(options.fade_bias, -1.0), 1.0)
    at = F.col("out_at") + ((F.col("pts") - F.col("out_at")) * (1 + bias) / 2).cast("long")
    cuts = rows.where("was and not dark").select("stream_id", at.alias("pts"), F.col("mean").cast("double").alias("score"))
    if not options.add_final_scene:
        return cuts
    end = rows.groupBy("stream_id").agg(F.max_by(F.struct("dark", "out_at", "mean"), "seq").alias("e")).where("e.dark")
    return cuts.unionByName(end.select("stream_id", F.col("e.out_at").alias("pts"), F.col("e.mean").cast("double").alias("score")))


def frame_fades(frames: DataFrame, options: ThresholdOptions = ThresholdOptions(), rgb: bool = False) -> DataFrame:
    """Frames in pieces leave the pass over planes only where they get dark or bright."""
    name = "rgb_mean" if rgb else "luma_mean"
    if options.min_duration > 0 and "only_before" in frames.columns:

        def columns(part: dict, made: dict) -> dict:
            return {c: part[c] for c in ("pts", "tb_num", "tb_den")} | {"mean": pa.array(made[name])}

        def turns(cols: dict) -> np.ndarray:
            mean = cols["mean"].to_numpy()
            dark = mean < options.threshold if options.method == "floor" else mean >= options.threshold
            return np.concatenate([[True], dark[1:] != dark[:-1]])

        return fold_packed(compute_features(frames, (name,), pack=Pack(columns, turns)), lambda: Fade(options), CUTS)
    return fade_cuts(compute_features(frames, (name,)).withColumnRenamed(name, "mean"), options)


def content_features(weights) -> tuple[str, ...]:
    return ("d_hue", "d_sat", "d_lum") + (("d_edges",) if weights[3] != 0 else ())


def weighted(made: dict, weights) -> tuple[np.ndarray, np.ndarray]:
    """The content score of :func:`content_scores` from arrays."""
    total, there = 0.0, True
    for name, w in zip(content_features(weights), weights, strict=False):
        values, at = known(made[name])
        total, there = total + values * float(w), there & at
    return total / sum(map(abs, weights)), there


def content_scores(
    frames: DataFrame, weights=(1.0, 1.0, 1.0, 0.0), kernel: int | None = None, luma_only: bool = False,
    reset_all: bool = False, chunk: int | None = None,
) -> DataFrame:
    """Adds ``score``: the weighted mean of the plane deltas by the sum of absolute weights; null where there is no
    earlier frame of that size. The edge map is made only if its weight counts."""
    names = content_features(weights)
    rows = compute_features(frames, names, kernel=kernel, luma_only=luma_only, reset_all=reset_all, chunk=chunk)
    total = F.lit(0.0)
    for name, w in zip(names, weights, strict=False):
        total = total + F.col(name) * float(w)
    return rows.withColumn("score", total / sum(map(abs, weights)))


def content_cuts(frames: DataFrame, options: ContentOptions = ContentOptions(), luma_only: bool = False, chunk: int | None = None) -> DataFrame:
    """Cuts where the content score reaches the threshold, through the flash filter."""
    if options.min_duration == 0:
        return flash_filtered(content_scores(frames, options.weights, options.kernel_size, luma_only, chunk=chunk), options)
    pack = scored_pack(lambda made: weighted(made, options.weights), lambda *run: flash_rows(*run, options))
    how = {"kernel": options.kernel_size, "luma_only": luma_only, "chunk": chunk}
    packed = compute_features(frames, content_features(options.weights), pack=pack, **how)
    return fold_packed(packed, lambda: FlashFilter(options), CUTS)


def flash_rows(score: np.ndarray, there: np.ndarray, cols: dict, options: ContentOptions) -> np.ndarray:
    """The rows of a run that can change the flash filter: those above the threshold, the first that has a score, and, for
    ``merge``, of each stretch below the threshold the first that is far enough from the last above it."""
    above = there & (score >= options.threshold)
    keep = above | (there & ~np.concatenate([[True], there[:-1]]))
    if options.filter_mode != "merge":
        return keep
    pts, num, den = (cols[c].to_numpy() for c in ("pts", "tb_num", "tb_den"))
    if (num != num[0]).any() or (den != den[0]).any() or (pts[1:] < pts[:-1]).any():
        return np.ones(len(pts), bool)
    gap = least_ticks(options.min_duration, Timebase(int(num[0]) or 1, int(den[0]) or 1000))
    if gap is None:
        return np.ones(len(pts), bool)
    at = np.maximum.accumulate(np.where(above, np.arange(len(pts)), -1))
    apart = (at >= 0) & (pts - pts[at] >= gap)  # what lies above before the run isn't known: its first rows all count
    keep |= apart & ~np.concatenate([[False], apart[:-1]])
    early = int(np.searchsorted(pts, pts[0] + gap)) + 1
    keep[:early] |= at[:early] < 0
    return keep


def flash_filtered(scored: DataFrame, options: ContentOptions) -> DataFrame:
    if options.min_duration == 0:
        hit = (F.col("score") >= options.threshold) & ~F.isnan("score")
        return scored.where(hit).select("stream_id", "pts", F.col("score").cast("double").alias("score"))
    if "width" in scored.columns:
        changed = (F.lag("width").over(by_seq()) != F.col("width")) | (F.lag("height").over(by_seq()) != F.col("height"))
        scored = scored.withColumn("reset", F.coalesce(changed, F.lit(False)))
    return fold_streams(scored, lambda: FlashFilter(options), CUTS)


def adaptive_ratios(scored: DataFrame, options: AdaptiveOptions = AdaptiveOptions()) -> DataFrame:
    """Adds ``ratio`` to rows with a score: the score over the mean of the ``window_width`` scores on each side, at most
    255; null where a side is short."""
    w = options.window_width
    rows = scored.where(F.col("score").isNotNull())
    around = by_seq().rowsBetween(-w, w)
    mean = (F.sum("score").over(around) - F.col("score")) / (2.0 * w)
    still = F.when(F.col("score") >= options.min_content_val, 255.0).otherwise(0.0)
    ratio = F.when(F.abs(mean) < 1e-5, still).otherwise(F.least(F.col("score") / F.when(F.abs(mean) >= 1e-5, mean), F.lit(255.0)))
    return rows.withColumn("ratio", F.when(F.count("score").over(around) == 2 * w + 1, ratio))


def adaptive_cuts(scored: DataFrame, options: AdaptiveOptions = AdaptiveOptions()) -> DataFrame:
    """Cuts where a score stands out from its neighbours', from (stream_id, seq, pts, score)."""
    rows = adaptive_ratios(scored, options).where("ratio is not null")
    hit = (F.col("ratio") >= options.adaptive_threshold) & (F.col("score") >= options.min_content_val)
    rows = rows.withColumn("candidate", hit & ~F.isnan("score"))
    if options.min_duration == 0:
        return rows.where("candidate").select("stream_id", "pts", F.col("ratio").alias("score"))
    return spaced(rows.drop("score").withColumnRenamed("ratio", "score"), options, ScoredSpacing)


def frame_adaptive_cuts(frames: DataFrame, options: AdaptiveOptions = AdaptiveOptions(), chunk: int | None = None) -> DataFrame:
    """:func:`adaptive_cuts` of frames' content scores; only those leave the pass over planes."""
    weights = options.weights
    if options.min_duration == 0:
        return adaptive_cuts(content_scores(frames, weights, options.kernel_size, chunk=chunk), options)

    def columns(part: dict, made: dict) -> dict:
        return {c: part[c] for c in ("pts", "tb_num", "tb_den")} | {"score": as_arrow(weighted(made, weights), pa.float64())}

    packed = compute_features(frames, content_features(weights), kernel=options.kernel_size, chunk=chunk, pack=Pack(columns))
    return fold_packed(packed, lambda: AdaptiveSpacing(options), CUTS)
