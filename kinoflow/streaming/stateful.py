"""The same machines in Structured Streaming: keyed state, in order of ``seq``, with the end of a stream as a marker row or
as a time without rows.

A stream's machine lies in the state store between batches, so recovery from a checkpoint continues where it stopped. Rows
of one batch are sorted by ``seq``; with ``slack`` they also wait for later batches. A row whose seq isn't after the last
one taken is late: it changes nothing, and with ``rejects`` it comes out as a row that says so.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import _parse_datatype_string

from kinoflow.functions.columns import METRICS
from kinoflow.operators.cascade import EVENTS, Adaptive, SceneMachine, lane_columns
from kinoflow.operators.features import CARRIED, STACK, Admission, FeatureMaker
from kinoflow.operators.gates import CUTS, Fade, FlashFilter, Spacing
from kinoflow.options import (
    EXTRACTORS, MAX_AREA, AdaptiveOptions, ContentOptions, HistogramOptions, PhashOptions, SceneOptions, ThresholdOptions,
)
from kinoflow.sources.frames import checked

STATE = "machine binary, seq long, waiting binary"
#: What a row that was refused comes out with, beside its stream and time.
REJECTED = ", rejected string"
_WHOLE = ("pts", "tb_num", "tb_den", "width", "height", "rgb_stride", "luma_stride", "hsv_stride")


def fold_stream(
    rows: DataFrame, machine: Callable[[], object], schema: str, slack: int = 0, idle_ms: int | None = None, rejects: bool = False
) -> DataFrame:
    """``rows``: a streaming DataFrame with stream_id, seq, an optional boolean ``eos``, and what the machine reads.

    ``slack``: a row waits in the state until one that is so many ``seq`` later has come; what comes later than that is
    late. ``idle_ms``: a stream without rows for so long (processing time) has ended, as if it had got its mark.
    ``rejects`` adds the column ``rejected``: null for what the machine gives, Late for late rows, and the machine's reason
    for those that it refuses.
    """
    schema = schema + REJECTED if rejects else schema
    names = _parse_datatype_string(schema).names

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            data, last, held = state.get
            run, waiting = pickle.loads(data), pickle.loads(held)
        else:
            run, last, waiting = machine(), None, []
        out, ended, taken = [], state.hasTimedOut, []
        parts = [] if ended else list(batches)
        if parts:
            for row in pd.concat(parts).sort_values("seq", kind="stable").to_dict("records"):
                row = {k: None if v is None or (isinstance(v, float) and v != v) else v for k, v in row.items()}
                if row.get("eos"):
                    ended = True
                elif last is not None and row["seq"] <= last:
                    out.append({"pts": row.get("pts"), "rejected": "Late"})
                else:
                    waiting.append(row)
        waiting.sort(key=lambda r: r["seq"])
        ripe = len(waiting) if ended or not slack else sum(r["seq"] <= waiting[-1]["seq"] - slack for r in waiting)
        for row in waiting[:ripe]:
            if last is not None and row["seq"] <= last:
                out.append({"pts": row.get("pts"), "rejected": "Late"})
            else:
                last = row["seq"]
                taken.append(row)
        if hasattr(run, "push_all"):
            out += run.push_all(taken)
        else:
            for row in taken:
                out += run.push(row)
                if reason := getattr(run, "refused", None):
                    out.append({"pts": row.get("pts"), "rejected": reason})
        if ended:
            out += run.finish()
            state.remove()
        else:
            state.update((pickle.dumps(run), last, pickle.dumps(waiting[ripe:])))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        if not rejects:
            out = [x for x in out if not x.get("rejected")]
        frame = pd.DataFrame([{n: x.get(n) for n in names} | {"stream_id": key[0]} for x in out], columns=names)
        yield frame.astype({"stream_id": "int64"})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("stream_id").applyInPandasWithState(step, schema, STATE, "append", timeout)


class AdaptiveCuts:
    """Adaptive cuts from scores: a ring of scores, and the spacing rule from the first full window on."""

    def __init__(self, options: AdaptiveOptions):
        self.ring, self.gate, self.w = Adaptive(options), Spacing(options), options.window_width

    def push(self, row: dict) -> list[dict]:
        if row["score"] is None:
            return []
        hit = self.ring.push(row["pts"], row["score"])
        if len(self.ring.ring) < 2 * self.w + 1:
            return []
        target = self.ring.ring[self.w][0]
        return self.gate.push(row | {"pts": target, "candidate": hit is not None, "score": hit and hit[1]})

    def finish(self) -> list[dict]:
        return []


class FrameMachine:
    """Frames in, what another machine makes of their features out. The planes of the last frame are part of the state,
    so comparisons go on from batch to batch."""

    def __init__(self, options, rgb: bool = False, luma_only: bool = False):
        self.o, self.rgb, self.fresh, self.gate, self.refused = options, rgb, True, None, None
        how = {"bins": 256, "bins_hsv": (256, 256), "hash_size": 16, "lowpass": 2, "kernel": None, "staged": None,
               "extractors": EXTRACTORS, "reset_all": False, "luma_only": luma_only}
        if isinstance(options, SceneOptions):
            names, more = lane_columns(options)
            wanted, self.inner, self.gate = (*names, *METRICS), SceneMachine(options), Admission()
        elif isinstance(options, HistogramOptions):
            wanted, more, self.inner = ("corr_luma",), {"bins": options.bins}, Spacing(options)
        elif isinstance(options, PhashOptions):
            wanted, more, self.inner = ("phash_distance",), {"hash_size": options.size, "lowpass": options.lowpass}, Spacing(options)
        elif isinstance(options, ThresholdOptions):
            wanted, more, self.inner = ("rgb_mean" if rgb else "luma_mean",), {}, Fade(options)
        else:
            wanted = ("d_hue", "d_sat", "d_lum") + (("d_edges",) if options.weights[3] != 0 else ())
            more, self.inner = {"kernel": options.kernel_size}, FlashFilter(options) if isinstance(options, ContentOptions) else AdaptiveCuts(options)
        self.maker = FeatureMaker(wanted, **(how | more))
        self.size = None

    def _seen(self, f: dict) -> dict:
        """A feature row as the inner machine reads it."""
        o = self.o
        if isinstance(o, SceneOptions):
            return f
        if isinstance(o, HistogramOptions):
            return f | {"score": f["corr_luma"], "candidate": f["corr_luma"] is not None and f["corr_luma"] <= 1.0 - o.threshold}
        if isinstance(o, PhashOptions):
            return f | {"score": f["phash_distance"], "candidate": f["phash_distance"] is not None and f["phash_distance"] >= o.threshold}
        if isinstance(o, ThresholdOptions):
            return f | {"mean": f["rgb_mean" if self.rgb else "luma_mean"]}
        size, changed = (f["width"], f["height"]), self.size is not None and self.size != (f["width"], f["height"])
        self.size = size
        parts = (f["d_hue"], f["d_sat"], f["d_lum"], f.get("d_edges") or 0.0)
        score = None if f["d_lum"] is None else sum(w * d for w, d in zip(o.weights, parts, strict=True)) / sum(map(abs, o.weights))
        return f | {"score": score, "reset": changed}

    def push_all(self, rows: list[dict]) -> list[dict]:
        out, run, held = [], [], 0
        for row in rows:
            row = row | {k: int(row[k]) for k in _WHOLE if row.get(k) is not None}
            if self.gate:
                pts = self.gate.pts(row["pts"], row["tb_num"], row["tb_den"])
                if pts is None:
                    out.append({"pts": row["pts"], "rejected": "OutOfOrder"})
                    continue
                row["pts"], (row["tb_num"], row["tb_den"]) = pts, self.gate.tb
            size = sum(len(v) for v in row.values() if isinstance(v, bytes))
            if run and (held + size > STACK or self._kind(row) != self._kind(run[0])):
                out += self._work(run)
                run, held = [], 0
            run.append(row)
            held += size
        return out + (self._work(run) if run else [])

    @staticmethod
    def _kind(row: dict) -> tuple:
        return row["width"], row["height"], row.get("channel_order"), row.get("luma") is None, row.get("hue") is None

    def _work(self, run: list[dict]) -> list[dict]:
        made = self.maker.run({k: [r.get(k) for r in run] for k in run[0]}, fresh=self.fresh)
        self.fresh, out = False, []
        for i, row in enumerate(run):
            feature = {k: row.get(k) for k in CARRIED} | {k: v[i] for k, v in made.items()}
            out += self.inner.push(self._seen(feature))
        return out

    def finish(self) -> list[dict]:
        return self.inner.finish()


def stream_cuts(frames: DataFrame, options, rgb: bool = False, luma_only: bool = False, **how) -> DataFrame:
    """Cuts from a stream of frames, by the detector whose options these are (``how``: as in :func:`fold_stream`). Frames
    that fail a check are left out; ``checked(frames)[1]`` is the stream of those, with their errors."""
    good, _ = checked(frames, None)
    return fold_stream(good, lambda: FrameMachine(options, rgb, luma_only), CUTS, **how)


def stream_scenes(frames: DataFrame, options: SceneOptions = SceneOptions(), **how) -> DataFrame:
    """EVENTS from a stream of frames (``how``: as in :func:`fold_stream`)."""
    good, _ = checked(frames, MAX_AREA)
    return fold_stream(good, lambda: FrameMachine(options), EVENTS, **how)


def stream_scene_events(features: DataFrame, options: SceneOptions = SceneOptions(), **how) -> DataFrame:
    """EVENTS from a stream of lane features (:func:`kinoflow.operators.cascade.lane_features` columns)."""
    return fold_stream(features, lambda: SceneMachine(options), EVENTS, **how)


def stream_spaced(scored: DataFrame, options: HistogramOptions | PhashOptions, **how) -> DataFrame:
    """Cuts from a stream of (stream_id, seq, pts, score, candidate)."""
    return fold_stream(scored, lambda: Spacing(options), CUTS, **how)


def stream_fades(means: DataFrame, options: ThresholdOptions = ThresholdOptions(), **how) -> DataFrame:
    return fold_stream(means, lambda: Fade(options), CUTS, **how)


def stream_content_cuts(scored: DataFrame, options: ContentOptions = ContentOptions(), **how) -> DataFrame:
    return fold_stream(scored, lambda: FlashFilter(options), CUTS, **how)


def stream_adaptive_cuts(scored: DataFrame, options: AdaptiveOptions = AdaptiveOptions(), **how) -> DataFrame:
    return fold_stream(scored, lambda: AdaptiveCuts(options), CUTS, **how)
