"""Sequential rules that keep cuts apart, as small machines for :func:`kinoflow.operators.fold.fold_streams`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kinoflow.options import AdaptiveOptions, ContentOptions, HistogramOptions, PhashOptions, ThresholdOptions
from kinoflow.timebase import Timebase, lasts, ticks_of

CUTS = "stream_id long, pts long, score double"


def _base(row: dict) -> Timebase:
    return Timebase(row.get("tb_num") or 1, row.get("tb_den") or 1000)


class Spacing:
    """A candidate fires if it is at least ``min_duration`` after the last that fired; the first eligible row counts as
    one unless an initial cut is allowed."""

    def __init__(self, options: HistogramOptions | PhashOptions | AdaptiveOptions):
        self.o, self.last = options, None

    def eligible(self, row: dict) -> bool:
        return True

    def push(self, row: dict) -> list[dict]:
        if not self.eligible(row):
            return []
        tb, pts = _base(row), row["pts"]
        if self.last is None:
            self.last = pts - ticks_of(self.o.min_duration, tb) if self.o.initial_cut else pts
        if row["candidate"] and lasts(pts - self.last, tb, self.o.min_duration):
            self.last = pts
            return [{"pts": pts, "score": row["score"]}]
        return []

    def finish(self) -> list[dict]:
        return []


class ScoredSpacing(Spacing):
    """Only rows with a score are eligible."""

    def eligible(self, row: dict) -> bool:
        return row["score"] is not None


class AdaptiveSpacing:
    """Adaptive cuts of scores in order, run by run: the ratio of ``detectors.adaptive_ratios``, then the spacing rule."""

    def __init__(self, options: AdaptiveOptions):
        self.o, self.spacing, self.held = options, Spacing(options), None

    def push_batch(self, batch: pa.RecordBatch) -> list[dict]:
        o, w = self.o, self.o.window_width
        batch = batch.filter(batch.column("score").is_valid())
        cols = {c: batch.column(c).to_numpy() for c in ("pts", "tb_num", "tb_den", "score")}
        if self.held:
            cols = {c: np.concatenate([self.held[c], v]) for c, v in cols.items()}
        n = len(cols["score"]) - 2 * w
        self.held = {c: v[-2 * w :].copy() for c, v in cols.items()}
        if n <= 0:
            return []
        total = np.zeros(n)
        for k in range(2 * w + 1):
            total = total + cols["score"][k : k + n]
        score = cols["score"][w : w + n]
        with np.errstate(all="ignore"):
            mean = (total - score) / (2.0 * w)
            still = np.where(score >= o.min_content_val, 255.0, 0.0)
            ratio = np.where(np.abs(mean) < 1e-5, still, np.fmin(score / mean, 255.0))
        hit = (ratio >= o.adaptive_threshold) & (score >= o.min_content_val) & ~np.isnan(score)
        out = []
        for i in np.flatnonzero(hit).tolist() if self.spacing.last is not None else range(n):
            row = {c: cols[c][w + i].item() for c in ("pts", "tb_num", "tb_den")}
            out += self.spacing.push(row | {"score": float(ratio[i]), "candidate": bool(hit[i])})
        return out

    def finish(self) -> list[dict]:
        return []


class FlashFilter:
    """Content cuts: ``suppress`` drops what comes too soon; ``merge`` holds a burst back and reports its end."""

    def __init__(self, options: ContentOptions):
        self.o, self.last, self.armed, self.held_since = options, None, False, None

    def push(self, row: dict) -> list[dict]:
        score, pts, tb = row["score"], row["pts"], _base(row)
        if row.get("reset"):
            self.__init__(self.o)
        if score is None:
            return []
        above = score >= self.o.threshold
        if self.last is None:
            self.last = pts - ticks_of(self.o.min_duration, tb) if self.o.initial_cut else pts
        apart = lasts(pts - self.last, tb, self.o.min_duration)
        cut = None
        if self.o.filter_mode == "suppress":
            if above and apart:
                cut = self.last = pts
        else:
            if above:
                self.last = pts
            if self.held_since is not None:
                long = lasts(max(self.last - self.held_since, 0), tb, self.o.min_duration)
                if apart and not above and long:
                    cut, self.held_since = self.last, None
            elif above and apart:
                cut, self.armed = pts, True
            elif above and self.armed:
                self.held_since = pts
        return [] if cut is None else [{"pts": cut, "score": score}]

    def finish(self) -> list[dict]:
        return []


class Fade:
    """Cuts between going dark and getting bright again. ``mean`` is the frame's; the cut lies between both times."""

    def __init__(self, options: ThresholdOptions):
        self.o, self.dark, self.out_at, self.last, self.mean, self.end = options, None, None, None, None, None

    def push(self, row: dict) -> list[dict]:
        pts, tb, mean, o = row["pts"], _base(row), row["mean"], self.o
        if mean is None:  # nothing was seen: as if there were no frame
            return []
        dark = mean < o.threshold if o.method == "floor" else mean >= o.threshold
        if self.last is None:
            self.last = pts - ticks_of(o.min_duration, tb) if o.initial_cut else pts
        out, self.mean, self.end = [], mean, (pts, tb)
        if self.dark is None:
            self.dark = dark
            self.out_at = pts if dark else None
        elif dark and not self.dark:
            self.dark, self.out_at = True, pts
        elif self.dark and not dark:
            bias = min(max(o.fade_bias, -1.0), 1.0)
            at = self.out_at + int((pts - self.out_at) * (1 + bias) / 2)
            if lasts(at - self.last, tb, o.min_duration):
                self.last = at
                out = [{"pts": at, "score": mean}]
            self.dark = False
        return out

    def finish(self) -> list[dict]:
        if self.end and self.o.add_final_scene and self.dark and self.out_at is not None:
            if self.last is None or lasts(self.out_at - self.last, self.end[1], self.o.min_duration):
                return [{"pts": self.out_at, "score": self.mean}]
        return []
