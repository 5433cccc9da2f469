"""The scene machine: all lanes of a stream contend for its boundaries, and keyframes are chosen between them.

Lane reports are functions of a frame and its predecessor, so they are columns of the feature pass. What is sequential,
contention and the windows of keyframes, is a small machine over narrow rows, the same in batch and in streaming.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinoflow.functions.columns import DOMAIN, METRICS
from kinoflow.operators.features import Pack, as_arrow, compute_features
from kinoflow.operators.fold import fold_packed
from kinoflow.operators.gates import Fade
from kinoflow.options import MAX_AREA, MAX_BUFFER, MAX_PENDING, SceneOptions, SelectOptions
from kinoflow.sources.frames import canonical_pts, checked
from kinoflow.timebase import LIMIT, SECOND, Timebase, lasts, least_ticks, nanos, ticks_of

EVENTS = (
    "stream_id long, out_seq long, event_kind string, pts long, start_pts long, end_pts long, provenance string, "
    "plane string, score double, reference double, components array<double>, metrics array<float>"
)
ZERO = dict.fromkeys(METRICS, 0.0)
#: The column of edge deltas by lane; without one of its own, adaptive has content's kernel.
EDGES = {"content": "d_edges", "adaptive": "d_edges_adaptive"}
#: What a lane looks at, and the planes of those of histograms.
LANE_COLUMNS = {
    "threshold": "luma_mean", "luma_histogram": "corr_luma", "hue_histogram": "corr_hue", "sat_histogram": "corr_sat",
    "phash": "phash_distance", "content": "s_content", "adaptive": "s_adaptive",
}
PLANES = {"luma_histogram": "luma", "hue_histogram": "hue", "sat_histogram": "saturation"}
PARTS = ("d_hue", "d_sat", "d_lum", "edges")
f32 = np.float32


def quality(m: dict, o: SelectOptions) -> float:
    w = o.weights
    with np.errstate(all="ignore"):
        out = f32(w.sharpness) * f32(m["sharpness"]) / f32(w.sharpness_norm) - f32(w.noise) * f32(m["noise"]) / f32(w.noise_norm)
        out = out + f32(w.colorfulness) * f32(m["colorfulness"]) / f32(w.colorfulness_norm)
        return float(out - f32(w.clipping) * f32(m["clipping"]) - f32(w.motion_blur) * f32(m["motion_blur"]))


def sane(m: dict) -> bool:
    return all(0.0 <= m[name] <= f32(top) for name, top in DOMAIN.items())


def rejected(m: dict, o: SelectOptions) -> bool:
    """The hard gate. Comparisons with NaN are false, so the domain is asked first."""
    return (
        not sane(m)
        or m["brightness"] < f32(o.black_mean)
        or m["brightness"] > f32(o.bright_mean)
        or (m["luma_variance"] < f32(o.luma_variance) and m["saturation_variance"] < f32(o.sat_variance))
        or m["clipping"] > f32(o.max_clipping)
        or (o.motion_blur_gate and m["motion_blur"] > f32(o.max_motion_blur))
    )


def judged(m: dict[str, np.ndarray], o: SelectOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sane, not rejected, quality) of many frames."""
    w = o.weights
    with np.errstate(all="ignore"):
        fine = np.logical_and.reduce([(m[name] >= 0) & (m[name] <= f32(top)) for name, top in DOMAIN.items()])
        flat = (m["luma_variance"] < f32(o.luma_variance)) & (m["saturation_variance"] < f32(o.sat_variance))
        out = ~fine | (m["brightness"] < f32(o.black_mean)) | (m["brightness"] > f32(o.bright_mean)) | flat
        out |= m["clipping"] > f32(o.max_clipping)
        if o.motion_blur_gate:
            out |= m["motion_blur"] > f32(o.max_motion_blur)
        q = f32(w.sharpness) * m["sharpness"] / f32(w.sharpness_norm) - f32(w.noise) * m["noise"] / f32(w.noise_norm)
        q = q + f32(w.colorfulness) * m["colorfulness"] / f32(w.colorfulness_norm)
        return fine, ~out, q - f32(w.clipping) * m["clipping"] - f32(w.motion_blur) * m["motion_blur"]


class SelectError(ValueError):
    pass


class Selector:
    """Keyframes of shots as they close, from a buffer of (pts, metrics)."""

    def __init__(self, options: SelectOptions, tb: Timebase):
        self.o, self.tb, self.buffer = options, tb, deque()

    def observe(self, pts: int, metrics: dict) -> None:
        if len(self.buffer) >= MAX_BUFFER:
            raise SelectError("BufferFull")
        if self.buffer and pts < self.buffer[-1][0]:
            raise SelectError("OutOfOrder")
        self.buffer.append((pts, metrics))

    def metrics_at(self, pts: int) -> dict | None:
        return next((m for p, m in self.buffer if p == pts), None)

    def ranges(self, start: int, end: int) -> list[tuple[int, int]]:
        ns = (end - start) * self.tb.num * SECOND
        unit = self.o.target_interval * self.tb.den
        n = min(max(-(-ns // unit), 1), self.o.max_frames_per_shot)
        tick = lambda share: start + int(share * (end - start))
        out = []
        for i in range(n):
            low, high = i / n, (i + 1) / n
            a, b = low + self.o.margin_ratio * (i == 0), high - self.o.margin_ratio * (i == n - 1)
            if a >= b or tick(a) >= tick(b):
                a, b = low, high
            out.append((tick(a), tick(b)))
        return out

    def floor(self, start: int, end: int, ranges: list[tuple[int, int]]) -> float:
        if not self.o.adaptive_floor:
            return self.o.min_sharpness
        first, last = ranges[0][0], ranges[-1][1]
        good = [m["sharpness"] for p, m in self.buffer if first <= p < last and not rejected(m, self.o)]
        total = len(good)
        if total < max(self.o.adaptive_min_samples, 1):
            return self.o.min_sharpness
        want = min(total, 4096)
        picked = sorted(v for i, v in enumerate(good) if i == 0 or i * want // total != (i - 1) * want // total)
        low = picked[min(int(len(picked) * self.o.adaptive_percentile), len(picked) - 1)]
        return min(self.o.min_sharpness, low)

    def finalize_shot(self, start: int, end: int) -> list[tuple[int, dict, bool]]:
        """(pts, metrics, strict) of each bucket of [start, end); frames before it go, later ones stay."""
        while self.buffer and self.buffer[0][0] < start:
            self.buffer.popleft()
        if end <= start:
            return []
        ranges = self.ranges(start, end)
        floor = self.floor(start, end, ranges)
        strict: list = [None] * len(ranges)
        other: list = [None] * len(ranges)
        at = 0
        while self.buffer and self.buffer[0][0] < end:
            pts, m = self.buffer.popleft()
            while at < len(ranges) and pts >= ranges[at][1]:
                at += 1
            if at == len(ranges) or pts < ranges[at][0]:
                continue
            q = quality(m, self.o)
            if not rejected(m, self.o) and m["sharpness"] >= floor and np.isfinite(q):
                if strict[at] is None or q > strict[at][0]:
                    strict[at] = (q, pts, m)
            if sane(m) and (other[at] is None or m["sharpness"] > other[at][0]):
                other[at] = (m["sharpness"], pts, m)
        chosen = [(s or o, s is not None) for s, o in zip(strict, other, strict=True)]
        return [(c[1], c[2], is_strict) for c, is_strict in chosen if c]

    def finalize_remaining(self, end: int) -> list[tuple[int, dict, bool]]:
        if not self.buffer or end <= self.buffer[0][0]:
            return []
        return self.finalize_shot(self.buffer[0][0], end)


class Unseen:
    """In a selector's place where no keyframes are asked for."""

    buffer: tuple = ()

    def observe(self, pts: int, metrics: dict) -> None:
        pass

    def metrics_at(self, pts: int) -> None:
        return None

    def finalize_shot(self, start: int, end: int) -> list:
        return []


class RunSelector(Selector):
    """The same choice from a selector's buffer and a run of frames after it, as arrays; gates and qualities are worked
    out for all of them together. Frames go only as shots close, so those of the run may all be there from the start."""

    def __init__(self, before: Selector, cols: dict[str, np.ndarray]):
        self.o, self.tb, self.at = before.o, before.tb, 0
        held = list(before.buffer)
        self.pts = np.concatenate([np.array([p for p, _ in held], np.int64), cols["pts"]])
        m = {x: np.concatenate([np.array([h[x] for _, h in held], np.float32), cols[x]]) for x in METRICS}
        self.m, o = m, self.o
        self.sharp = m["sharpness"].astype(np.float64)
        self.sane, self.good, self.quality = judged(m, o)
        self.fine = self.good & np.isfinite(self.quality)

    def metrics_of(self, i: int) -> dict:
        return {x: float(self.m[x][i]) for x in METRICS}

    def metrics_at(self, pts: int) -> dict | None:
        i = max(self.at, int(self.pts.searchsorted(pts)))
        return self.metrics_of(i) if i < len(self.pts) and self.pts[i] == pts else None

    def floor(self, start: int, end: int, ranges: list[tuple[int, int]]) -> float:
        if not self.o.adaptive_floor:
            return self.o.min_sharpness
        a, b = (max(self.at, int(x)) for x in self.pts.searchsorted((ranges[0][0], ranges[-1][1])))
        sharp = self.sharp[a:b][self.good[a:b]]
        total = len(sharp)
        if total < max(self.o.adaptive_min_samples, 1):
            return self.o.min_sharpness
        if total > 4096:
            slot = np.arange(total) * 4096 // total
            sharp = sharp[np.concatenate([[True], slot[1:] != slot[:-1]])]
        sharp = np.sort(sharp)
        return min(self.o.min_sharpness, float(sharp[min(int(len(sharp) * self.o.adaptive_percentile), len(sharp) - 1)]))

    def finalize_shot(self, start: int, end: int) -> list[tuple[int, dict, bool]]:
        self.at = max(self.at, int(self.pts.searchsorted(start)))
        if end <= start:
            return []
        ranges = self.ranges(start, end)
        floor = self.floor(start, end, ranges)
        out = []
        for low, high in ranges:
            a, b = (max(self.at, int(x)) for x in self.pts.searchsorted((low, high)))
            if a >= b:
                continue
            strict = self.fine[a:b] & (self.sharp[a:b] >= floor)
            mask, key = (strict, self.quality[a:b]) if strict.any() else (self.sane[a:b], self.sharp[a:b])
            if mask.any():
                i = a + int(np.argmax(np.where(mask, key, -np.inf)))
                out.append((int(self.pts[i]), self.metrics_of(i), mask is strict))
        self.at = max(self.at, int(self.pts.searchsorted(end)))
        return out

    def rest(self) -> Selector:
        out = Selector(self.o, self.tb)
        out.buffer.extend((int(self.pts[i]), self.metrics_of(i)) for i in range(self.at, len(self.pts)))
        return out


class Adaptive:
    """Scores in a ring; the middle one stands out or not. Reports are ``window_width`` frames late."""

    def __init__(self, o):
        self.o, self.ring = o, deque(maxlen=2 * o.window_width + 1)

    def push(self, pts: int, score: float) -> tuple[int, float, float] | None:
        self.ring.append((pts, score))
        return self.judged(self.ring) if len(self.ring) == self.ring.maxlen else None

    def push_run(self, pts: np.ndarray, scores: np.ndarray) -> dict[int, tuple[int, float, float]]:
        """Reports by the number of the frame at which they come. Those near the threshold are looked at one by one."""
        held, w = list(self.ring), self.o.window_width
        pts = np.concatenate([np.array([p for p, _ in held], np.int64), pts])
        scores = np.concatenate([np.array([s for _, s in held], np.float64), scores])
        self.ring.extend(zip(pts[-2 * w - 1 :].tolist(), scores[-2 * w - 1 :].tolist(), strict=True))
        n, out = len(scores) - 2 * w, {}
        if n <= 0:
            return out
        target = scores[w : w + n]
        around = sum(scores[k : k + n] for k in range(2 * w + 1)) - target
        close = self.o.adaptive_threshold * (around / (2 * w)) <= target + 1e-6 + 1e-9 * np.abs(around)
        for k in np.flatnonzero((target >= self.o.min_content_val) & (close | ~np.isfinite(around))).tolist():
            at = k + 2 * w - len(held)
            if at >= 0:
                hit = self.judged(list(zip(pts[k : k + 2 * w + 1].tolist(), scores[k : k + 2 * w + 1].tolist(), strict=True)))
                if hit:
                    out[at] = hit
        return out

    def judged(self, ring) -> tuple[int, float, float] | None:
        at, target = ring[self.o.window_width]
        mean = (sum(s for _, s in ring) - target) / (2 * self.o.window_width)
        if abs(mean) < 1e-5:
            ratio = 255.0 if target >= self.o.min_content_val else 0.0
        else:
            ratio = min(target / mean, 255.0)
        if ratio >= self.o.adaptive_threshold and target >= self.o.min_content_val:
            return at, ratio, target
        return None


class SceneMachine:
    """Push feature rows in order; each push gives at most one event, ``finish`` all that are left."""

    def __init__(self, options: SceneOptions = SceneOptions(), keyframes: bool = True):
        self.o, self.refused, self.keyframes = options, None, keyframes
        self._reset()
        self.out_seq = 0

    def _reset(self) -> None:
        self.size = self.tb = self.shot_start = self.anchor = self.last = self.confirmed = None
        self.window_start = self.boundary = None
        self.recent: deque[int] = deque()
        self.deferred: list[tuple[int, dict]] = []
        self.pending: list[dict] = []
        self.selector: Selector | None = None
        self._clear_lanes()

    def _clear_lanes(self) -> None:
        self.fade = Fade(self.o.threshold.replace(min_duration=0)) if "threshold" in self.o.lanes else None
        self.adaptive = Adaptive(self.o.adaptive) if "adaptive" in self.o.lanes else None

    # -- lanes

    def _lane(self, name: str):
        return getattr(self.o, name)

    def _score(self, row: dict, lane: str) -> tuple[float, list[float]] | None:
        """The lane's score, and what it is made of: edges of the lane's own kernel, and only if it weighs them."""
        if row.get("d_lum") is None and row.get(f"s_{lane}") is None:
            return None
        if f"s_{lane}" in row:  # made beforehand, where it may count
            found = row[f"s_{lane}"]
            return None if found is None else (found, [row.get(x) for x in PARTS])
        weights = self._lane(lane).weights
        edges = EDGES[lane] if row.get(EDGES[lane]) is not None else EDGES["content"]
        parts = [row["d_hue"], row["d_sat"], row["d_lum"], (row.get(edges) or 0.0) if weights[3] != 0 else 0.0]
        return sum(w * d for w, d in zip(weights, parts, strict=True)) / sum(map(abs, weights)), parts

    def _reports(self, row: dict) -> list[tuple[int, dict]]:
        """What each lane reports at this frame, in order of precedence."""
        pts, out = row["pts"], []
        if self.fade:
            for cut in self.fade.push({"pts": pts, "mean": row["luma_mean"], "tb_num": self.tb.num, "tb_den": self.tb.den}):
                out.append((cut["pts"], self._why("threshold", row["luma_mean"], float(self.o.threshold.threshold))))
        for lane, plane in PLANES.items():
            value = row.get(LANE_COLUMNS[lane])
            if lane in self.o.lanes and value is not None and value <= 1.0 - self._lane(lane).threshold:
                out.append((pts, self._why(lane, value) | {"plane": plane}))
        if "phash" in self.o.lanes and row.get("phash_distance") is not None and row["phash_distance"] >= self.o.phash.threshold:
            out.append((pts, self._why("phash", row["phash_distance"])))
        if "content" in self.o.lanes:
            found = self._score(row, "content")
            if found and found[0] >= self.o.content.threshold:
                out.append((pts, self._why("content", found[0], self.o.content.threshold) | {"components": found[1]}))
        if self.adaptive:
            found = self._score(row, "adaptive")
            hit = self.adaptive.push(pts, found[0]) if found else None
            if hit:
                out.append((hit[0], self._why("adaptive", hit[1], hit[2])))
        return out

    @staticmethod
    def _why(lane: str, score: float | None = None, reference: float | None = None) -> dict:
        return {"lane": lane, "score": score, "reference": reference}

    # -- contention

    def _admissible(self, cut: int, why: dict, warm_up: bool) -> bool:
        least = self._lane(why["lane"]).min_duration if hasattr(self.o, why["lane"]) else 0
        if self.shot_start is not None and cut <= self.shot_start:
            return False
        if self.confirmed is not None and not (cut > self.confirmed and lasts(cut - self.confirmed, self.tb, least)):
            return False
        if warm_up and least is not None and not self._lane(why["lane"]).initial_cut:
            return lasts(cut - self.anchor, self.tb, least)
        return True

    def _max_span(self, cut: int) -> dict | None:
        cap = self.o.max_scene_duration
        if cap is None or self.shot_start is None or not lasts(cut - self.shot_start, self.tb, cap):
            return None
        return self._why("max_span", float(nanos(cut - self.shot_start, self.tb)), float(cap))

    def _still(self, report: tuple[int, dict]) -> tuple[int, dict] | None:
        if report[1]["lane"] != "max_span":
            return report
        why = self._max_span(report[0])
        return why and (report[0], why)

    def _winner(self, now: int, reports: list[tuple[int, dict]]) -> tuple[int, dict] | None:
        found = [r for r in reports if self._admissible(*r, warm_up=True)]
        waiting, self.deferred = self.deferred, []
        for report in filter(None, map(self._still, waiting)):
            if self._admissible(*report, warm_up=False):
                found.append(report)
        if why := self._max_span(now):
            found.append((now, why))
        if not found:
            return None
        found.sort(key=lambda r: r[0])
        self.deferred += [r for r in found[1:] if r[0] > found[0][0]]
        return found[0]

    # -- output

    def _emit(self, event: dict) -> None:
        self.pending.append(event)
        if len(self.pending) > MAX_PENDING:
            frames = [i for i, e in enumerate(self.pending) if e["event_kind"] == "keyframe"]
            plain = [i for i in frames if self.pending[i]["provenance"] != "boundary"]
            if plain or frames:
                del self.pending[(plain or frames)[0]]

    def _keyframe(self, pts: int, kind: str, m: dict) -> None:
        self._emit({"event_kind": "keyframe", "pts": pts, "provenance": kind, "metrics": [m[x] for x in METRICS]})

    def _open(self, pts: int, metrics: dict) -> None:
        self.boundary = pts
        self._keyframe(pts, "boundary", metrics)

    def _window(self, point: int) -> None:
        start, self.window_start = self.window_start, point
        if start is None or point <= start:
            return
        for pts, metrics, strict in self.selector.finalize_shot(start, point):
            if pts != self.boundary:
                self._keyframe(pts, "quality" if strict else "fallback", metrics)

    def _scene(self, cut: int, why: dict) -> None:
        if cut > self.shot_start:
            name = "histogram" if why["lane"].endswith("histogram") else why["lane"]
            self._emit(
                {"event_kind": "scene", "start_pts": self.shot_start, "end_pts": cut, "provenance": name,
                 "plane": why.get("plane"), "score": why["score"], "reference": why["reference"], "components": why.get("components")}
            )

    def _close(self, cut: int, why: dict) -> None:
        self._window(cut)
        self._scene(cut, why)
        self.shot_start = self.confirmed = self.window_start = cut
        self._open(cut, self.selector.metrics_at(cut) or ZERO)

    def _horizon(self, pts: int) -> int | None:
        lag = self.o.lag_frames
        if not lag:
            return pts
        return self.recent[0] if len(self.recent) >= lag else None

    def _numbered(self, events: list[dict]) -> list[dict]:
        for event in events:
            event["out_seq"] = self.out_seq
            self.out_seq += 1
        return events

    def push(self, row: dict) -> list[dict]:
        pts = row["pts"]
        self.refused = "TimestampAtLimit" if pts >= LIMIT else "OutOfOrder" if self.last is not None and pts < self.last else None
        if self.refused:
            return []  # not admitted; nothing changes
        size = (row["width"], row["height"])
        if self.tb is None:
            self.tb = Timebase(row.get("tb_num") or 1, row.get("tb_den") or 1000)
            self.selector = Selector(self.o.selector(), self.tb) if self.keyframes else Unseen()
        if self.size is not None and size != self.size:
            self._clear_lanes()
            self.anchor = pts
        self.size, self.last = size, pts
        if self.anchor is None:
            self.anchor = pts
        first = self.shot_start is None
        if first:
            self.shot_start = pts
            if self.window_start is None:
                self.window_start = pts
        if self.o.lag_frames:
            self.recent.append(pts)
            while len(self.recent) > self.o.lag_frames:
                self.recent.popleft()
        metrics = {m: row[m] for m in METRICS} if self.keyframes else ZERO
        try:
            self.selector.observe(pts, metrics)
        except SelectError:
            safe = self._horizon(pts)
            self._window(pts if safe is None else safe)
            try:
                self.selector.observe(pts, metrics)
            except SelectError:
                pass
        if first:
            self._open(pts, metrics)
        self._decide(pts, self._reports(row), self._horizon(pts))
        return self._numbered([self.pending.pop(0)] if self.pending else [])

    def _decide(self, pts: int, reports: list[tuple[int, dict]], safe: int | None) -> None:
        if winner := self._winner(pts, reports):
            self._close(*winner)
        elif safe is not None:
            each = max(1, ticks_of(self.o.select.target_interval, self.tb))
            if safe - self.window_start >= each:
                self._window(self.window_start + (safe - self.window_start) // each * each)

    def push_batch(self, batch: pa.RecordBatch) -> list[dict]:
        """Pushes a run of admitted frames of one size, as :func:`packed_lanes` makes it: the first of a stream or size as
        :meth:`push` does, and of the others only those at which something can happen."""
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        pts, n, out = cols["pts"].to_numpy(), batch.num_rows, []
        begin = 0 if self.tb is not None and self.size == (cols["width"][0].as_py(), cols["height"][0].as_py()) else 1
        if (self.last is not None and pts[0] < self.last) or pts[-1] >= LIMIT or (pts[1:] < pts[:-1]).any():
            raise ValueError("runs hold admitted frames only")
        if (len(self.selector.buffer) if self.selector else 0) + n >= MAX_BUFFER:
            begin = n
        for row in batch.slice(0, begin).to_pylist():
            out += self.push(row)
        if begin < n:
            out += self._push_run({c: v.slice(begin) for c, v in cols.items()}, pts[begin:])
        return out

    def _push_run(self, cols: dict[str, pa.Array], pts: np.ndarray) -> list[dict]:
        n, times, lag = len(pts), pts.tolist(), self.o.lag_frames
        if self.keyframes:
            self.selector = RunSelector(self.selector, {c: cols[c].to_numpy() for c in ("pts", *METRICS)})
        marks = [self._marks(lane, cols, pts) for lane in self.o.lanes]  # in order of precedence
        late = [*self.recent, *times]
        short = max(0, lag - 1 - len(self.recent))  # frames that don't fill the lag yet
        horizon = [None] * min(short, n) + late[len(self.recent) + short - lag + 1 :][: n - short] if lag else times
        each = max(1, ticks_of(self.o.select.target_interval, self.tb))
        cap = None if self.o.max_scene_duration is None else least_ticks(self.o.max_scene_duration, self.tb)
        out, i = [], -1
        while True:
            to = self._next_row(i, n, times, horizon, min(short, n), marks, each, cap)
            quiet = to - i - 1
            if quiet and self.pending:
                out += self._numbered(self.pending[:quiet])
                del self.pending[:quiet]
            i = to
            if i >= n:
                break
            self.last = times[i]
            self._decide(times[i], [report for _, _, _, by in marks for report in by(i)], horizon[i])
            if self.pending:
                out += self._numbered([self.pending.pop(0)])
        self.last = times[-1]
        if lag:
            self.recent = deque(late[-lag:])
        if self.keyframes:
            self.selector = self.selector.rest()
        return out

    def _next_row(self, i: int, n: int, times: list, horizon: list, short: int, marks: list, each: int, cap: int | None) -> int:
        """The next frame at which a report is admissible, the scene or the window gets too long, or a report is owed."""
        if self.deferred:
            return i + 1
        best, start, last = n, self.shot_start + 1, self.confirmed
        for rows, cuts, least, _ in marks:
            need = start if last is None else max(start, last + 1, last + least)
            k = max(bisect_right(rows, i), bisect_left(cuts, need))
            if k < len(rows) and rows[k] < best:
                best = rows[k]
        if cap is not None:
            best = min(best, max(i + 1, bisect_left(times, self.shot_start + cap)))
        return min(best, max(i + 1, bisect_left(horizon, self.window_start + each, short)))

    def _marks(self, lane: str, cols: dict[str, pa.Array], pts: np.ndarray) -> tuple[list, list, int, object]:
        """(rows at which a lane reports, the cuts, its least ticks, the reports of a row); rows and cuts in order."""
        o, column = self._lane(lane), cols[LANE_COLUMNS[lane]]
        there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        values = column.to_numpy(zero_copy_only=False)[there]
        reports: dict[int, list] = {}
        if lane == "threshold":
            num, den = self.tb.num, self.tb.den
            for i, mean in zip(there.tolist(), values.tolist(), strict=True):
                for cut in self.fade.push({"pts": int(pts[i]), "mean": mean, "tb_num": num, "tb_den": den}):
                    reports[i] = [(cut["pts"], self._why("threshold", mean, float(o.threshold)))]
        elif lane == "adaptive":
            for k, hit in self.adaptive.push_run(pts[there], values).items():
                reports[int(there[k])] = [(hit[0], self._why("adaptive", hit[1], hit[2]))]
        else:
            hit = values <= 1.0 - o.threshold if lane.endswith("histogram") else values >= o.threshold
            rows = there[hit]
            mask = np.zeros(len(pts), bool)
            mask[rows] = True

            def by(i: int) -> list:
                if not mask[i]:
                    return []
                value, at = column[i].as_py(), int(pts[i])
                if lane == "content":
                    return [(at, self._why(lane, value, o.threshold) | {"components": [cols[x][i].as_py() for x in PARTS]})]
                if lane == "phash":
                    return [(at, self._why(lane, value))]
                return [(at, self._why(lane, value) | {"plane": PLANES[lane]})]

            return rows.tolist(), pts[rows].tolist(), least_ticks(o.min_duration, self.tb), by
        found = sorted(reports)
        return found, [reports[i][0][0] for i in found], least_ticks(o.min_duration, self.tb), lambda i: reports.get(i, [])

    def finish(self) -> list[dict]:
        if self.last is not None and self.shot_start is not None:
            owed = self.deferred
            if self.fade and self.fade.o.add_final_scene:
                for cut in self.fade.finish():
                    report = (cut["pts"], self._why("threshold", cut["score"], float(self.o.threshold.threshold)))
                    o = self.o.threshold
                    if o.initial_cut or lasts(report[0] - self.anchor, self.tb, o.min_duration):
                        owed = [*owed, report]
            for report in sorted(owed, key=lambda r: r[0]):
                report = self._still(report)
                if report and self._admissible(*report, warm_up=False):
                    self._close(*report)
            end = self.last + 1
            self._window(end)
            self._scene(end, self._why("finalized"))
        out = self._numbered(self.pending)
        self._reset()
        return out


def lane_columns(options: SceneOptions) -> tuple[list[str], dict]:
    """The features that the lanes need, and how they are made."""
    names = []
    for lane, column in (("threshold", "luma_mean"), ("luma_histogram", "corr_luma"), ("hue_histogram", "corr_hue"),
                         ("sat_histogram", "corr_sat"), ("phash", "phash_distance")):
        if lane in options.lanes:
            names.append(column)
    weighed = {x: getattr(options, x) for x in ("content", "adaptive") if x in options.lanes}
    if weighed:
        names += ["d_hue", "d_sat", "d_lum"]
    kernels = {x: o.kernel_size for x, o in weighed.items() if o.weights[3] != 0}
    if kernels:
        names.append("d_edges")
        if len(set(kernels.values())) > 1:
            names.append("d_edges_adaptive")
    return names, {
        "bins": options.luma_histogram.bins, "bins_hsv": (options.hue_histogram.bins, options.sat_histogram.bins),
        "hash_size": options.phash.size, "lowpass": options.phash.lowpass,
        "kernel": next(iter(kernels.values()), None), "kernel_adaptive": kernels.get("adaptive"),
        "staged": options.selector(), "extractors": options.extractors, "reset_all": True,
    }


def lane_features(frames: DataFrame, options: SceneOptions, chunk: int | None = None, admit: bool = False) -> DataFrame:
    """The columns that the machine needs, and no others: lanes that are off cost nothing."""
    names, how = lane_columns(options)
    return compute_features(frames, (*names, *METRICS), chunk=chunk, admit=admit, **how)


def summed(parts: list) -> np.ndarray:
    """Sums of columns, rounded as Python's own ``sum`` rounds those of a row."""
    total, lost = np.zeros(len(parts[0])), np.zeros(len(parts[0]))
    for x in parts:
        more = total + x
        lost += np.where(np.abs(total) >= np.abs(x), (total - more) + x, (x - more) + total)
        total = more
    return total + np.where(np.isfinite(lost), lost, 0.0)


def packed_lanes(options: SceneOptions, keyframes: bool = True) -> Pack:
    """What :meth:`SceneMachine.push_batch` needs of a run: features stay only where their lane may report."""

    def score(made: dict, lane: str) -> tuple[np.ndarray, np.ndarray, list]:
        weights = getattr(options, lane).weights
        edges = EDGES[lane] if EDGES[lane] in made else EDGES["content"]
        there = made["d_lum"][1]
        parts = [made[x][0] for x in ("d_hue", "d_sat", "d_lum")]
        parts.append(np.where(made[edges][1], made[edges][0], 0.0) if weights[3] != 0 else np.zeros(len(there)))
        with np.errstate(all="ignore"):
            return summed([w * x for w, x in zip(weights, parts, strict=True)]) / sum(map(abs, weights)), there, parts

    def columns(part: dict, made: dict) -> dict:
        some = lambda values, live: as_arrow((values, live), pa.float64())
        cols = {c: part[c] for c in ("pts", "tb_num", "tb_den", "width", "height")}
        for lane in options.lanes:
            o, name = getattr(options, lane), LANE_COLUMNS[lane]
            if lane == "threshold":
                mean = made[name]
                dark = mean < o.threshold if o.method == "floor" else mean >= o.threshold
                turns = np.concatenate([[True], dark[1:] != dark[:-1]])
                turns[-1] = True
                if len(turns) > 1 and "only_before" in part and part["only_before"][0].as_py():
                    turns[1] = True
                cols[name] = some(mean, turns)
            elif lane == "content":
                values, there, parts = score(made, lane)
                there = there & (values >= o.threshold)
                cols[name] = some(values, there)
                cols |= {x: some(v, there) for x, v in zip(PARTS, parts, strict=True)}
            elif lane == "adaptive":
                cols[name] = some(*score(made, lane)[:2])
            else:
                values, there = made[name]
                cols[name] = some(values, there & (values <= 1.0 - o.threshold if lane.endswith("histogram") else values >= o.threshold))
        return cols | ({m: as_arrow(made[m], pa.float32()) for m in METRICS} if keyframes else {})

    return Pack(columns)


def scene_events(frames: DataFrame, options: SceneOptions = SceneOptions(), chunk: int | None = None, keyframes: bool = True) -> DataFrame:
    """The EVENTS of every stream: keyframes and scenes that tile it, in the order in which they come out.

    Frames that fail a check, and times out of order or at the limit, are left out (``rejected_frames`` has them). Whole
    streams are admitted within the pass over their planes, which are shuffled once; frames in pieces aren't shuffled.
    With ``chunk`` a stream is many tasks, so times are worked out first, on narrow rows, and joined to the frames. What
    the lanes and the choice of keyframes need goes to a task a stream, packed. Without ``keyframes`` no metrics are made,
    and only the scenes come out.
    """
    good, _ = checked(frames, MAX_AREA)
    names, how = lane_columns(options)
    if keyframes:
        names = [*names, *METRICS]
    else:
        how |= {"staged": None}
    how |= {"pack": packed_lanes(options, keyframes)}
    if chunk is None:
        packed = compute_features(good, tuple(names), admit=True, **how)
    else:
        times = canonical_pts(good.select("stream_id", "seq", "pts", "tb_num", "tb_den")).where("rejected is null").drop("rejected")
        nth = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) - 1  # chunks need a seq without gaps
        times = times.select(F.col("stream_id").alias("_s"), F.col("seq").alias("_q"), nth.cast("long").alias("_nth"), "pts", "tb_num", "tb_den")
        admitted = good.drop("pts", "tb_num", "tb_den").join(times, (F.col("stream_id") == F.col("_s")) & (F.col("seq") == F.col("_q")))
        packed = compute_features(admitted.drop("_s", "_q", "seq").withColumnRenamed("_nth", "seq"), tuple(names), chunk=chunk, **how)
    found = fold_packed(packed, lambda: SceneMachine(options, keyframes), EVENTS)
    return found if keyframes else found.where("event_kind = 'scene'")


def rejected_frames(frames: DataFrame) -> DataFrame:
    """(stream_id, seq, error) of the frames that :func:`scene_events` leaves out."""
    good, bad = checked(frames, MAX_AREA)
    late = canonical_pts(good).where("rejected is not null")
    return bad.select("stream_id", "seq", "error").unionByName(late.select("stream_id", "seq", late.rejected.alias("error")))
