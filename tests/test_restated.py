"""Plain restatements of what has no SQL: hashes at the default size, and all events of the scene machine."""

import math

import numpy as np
import pytest

from kinoflow.functions import kernels as K
from kinoflow.functions.columns import METRICS
from kinoflow.operators.cascade import SceneMachine, quality, rejected, sane
from kinoflow.operators.gates import Fade
from kinoflow.options import AdaptiveOptions, ContentOptions, HistogramOptions, OptionsError, SceneOptions, SelectOptions, ThresholdOptions

MS = 1_000_000


def hash_bits(plane, size, lowpass):
    """Cell by cell and coefficient by coefficient, in double precision."""
    h, w = plane.shape
    side = size * lowpass

    def cells(n):
        return [[max(0.0, min((c + 1) * n / side, j + 1) - max(c * n / side, j)) * side / n for j in range(n)] for c in range(side)]

    small = np.array(cells(h)) @ plane.astype(float) @ np.array(cells(w)).T
    wave = np.array([[math.cos(math.pi * (2 * i + 1) * u / (2 * side)) * math.sqrt((1 if u == 0 else 2) / side) for i in range(side)] for u in range(size)])
    low = (wave @ small @ wave.T).reshape(-1)
    ordered = sorted(low)
    n = len(ordered)
    middle = ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2
    sure = np.abs(low - middle) > 1e-3 * np.abs(low).max() * 1e-2
    return low > middle, sure


@pytest.mark.parametrize("shape", [(48, 64), (90, 31), (33, 200)])
def test_hash_equals_coefficients(shape):
    rng = np.random.default_rng(1)
    planes = rng.integers(0, 256, (6, *shape)).astype(np.uint8)
    for size, lowpass in ((16, 2), (8, 4), (5, 1)):
        words = K.phash(planes, size, lowpass)
        distance = K.hamming(words[:-1], words[1:])
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, : size * size].astype(bool)
        for i, plane in enumerate(planes):
            want, sure = hash_bits(plane, size, lowpass)
            assert sure.mean() > 0.9 and (bits[i] == want)[sure].all()
        assert distance.tolist() == (bits[:-1] != bits[1:]).sum(axis=1).tolist()


def choose(frames, o):
    """The keyframe of a window's frames: (pts, metrics, strict), or None."""
    good = sorted(m["sharpness"] for _, m in frames if not rejected(m, o))
    floor = o.min_sharpness
    if o.adaptive_floor and len(good) >= max(o.adaptive_min_samples, 1):
        floor = min(floor, good[min(int(len(good) * o.adaptive_percentile), len(good) - 1)])
    strict = [(p, m) for p, m in frames if not rejected(m, o) and m["sharpness"] >= floor]
    if strict:
        return (*max(strict, key=lambda x: (quality(x[1], o), -x[0])), True)
    loose = [(p, m) for p, m in frames if sane(m)]
    return (*max(loose, key=lambda x: (x[1]["sharpness"], -x[0])), False) if loose else None


def told(rows, o):
    """All events of a stream of equal frames a tick apart in time, milliseconds, from whole lists instead of a machine:
    (kind, pts or start, end, provenance) by time."""
    reports = {}
    fade = Fade(o.threshold.replace(min_duration=0))
    scores = [None if r["d_lum"] is None else (r["d_hue"] + r["d_sat"] + r["d_lum"]) / 3 for r in rows]
    for i, r in enumerate(rows):
        found = []
        if "threshold" in o.lanes:
            found += [(c["pts"], "threshold") for c in fade.push({"pts": r["pts"], "mean": r["luma_mean"], "tb_num": 1, "tb_den": 1000})]
        if "luma_histogram" in o.lanes and r["corr_luma"] is not None and r["corr_luma"] <= 1 - o.luma_histogram.threshold:
            found.append((r["pts"], "luma_histogram"))
        if "content" in o.lanes and scores[i] is not None and scores[i] >= o.content.threshold:
            found.append((r["pts"], "content"))
        w = o.adaptive.window_width
        if "adaptive" in o.lanes and i >= 2 * w and None not in (part := scores[i - 2 * w : i + 1]):
            mean = (sum(part) - part[w]) / (2 * w)
            ratio = (255.0 if part[w] >= o.adaptive.min_content_val else 0.0) if abs(mean) < 1e-5 else min(part[w] / mean, 255.0)
            if ratio >= o.adaptive.adaptive_threshold and part[w] >= o.adaptive.min_content_val:
                found.append((rows[i - w]["pts"], "adaptive"))
        reports[i] = found
    cap = o.max_scene_duration
    start, confirmed, waiting, shots = rows[0]["pts"], None, [], []

    def fits(cut, lane):
        if lane == "max_span":
            return cap is not None and (cut - start) * MS >= cap and cut > start and (confirmed is None or cut > confirmed)
        least = getattr(o, lane).min_duration
        return cut > start and (confirmed is None or (cut > confirmed and (cut - confirmed) * MS >= least))

    spans = []  # (start, end, lane, index of the frame at which it was closed)
    for i, r in enumerate(rows):
        live = [x for x in [*reports[i], *waiting, (r["pts"], "max_span")] if fits(*x)]
        waiting = []
        if live:
            first = min(x[0] for x in live)
            winner = next(x for x in live if x[0] == first)
            waiting = [x for x in live if x[0] > first]
            spans.append((start, first, winner[1], i))
            start = confirmed = first
    for cut, lane in sorted(waiting):
        if fits(cut, lane):
            spans.append((start, cut, lane, len(rows)))
            start = confirmed = cut
    spans.append((start, rows[-1]["pts"] + 1, "finalized", len(rows)))
    name = lambda lane: "histogram" if lane.endswith("histogram") else lane
    out = [("scene", a, b, name(lane)) for a, b, lane, _ in spans]
    select, each = o.selector(), o.select.target_interval // MS
    for a, b, _, _ in spans:
        out.append(("keyframe", a, None, "boundary"))
        for low in range(a, b, each):
            inside = [(r["pts"], {m: r[m] for m in METRICS}) for r in rows if low <= r["pts"] < min(low + each, b)]
            pick = choose(inside, select) if inside else None
            if pick and pick[0] != a:
                out.append(("keyframe", pick[0], None, "quality" if pick[2] else "fallback"))
        shots.append((a, b))
    return sorted(out, key=str)


def stream(seed, n=400):
    rng = np.random.default_rng(seed)
    rows, luma = [], 100.0
    for i in range(n):
        jump = rng.random() < 0.06
        luma = 5.0 if rng.random() < 0.04 else (luma if rng.random() < 0.8 else float(rng.integers(20, 200)))
        d = float(rng.uniform(30, 90)) if jump else float(rng.uniform(0, 6))
        first = i == 0
        rows.append({
            "pts": i * 40, "tb_num": 1, "tb_den": 1000, "width": 8, "height": 8, "luma_mean": luma,
            "corr_luma": None if first else (0.1 if rng.random() < 0.05 else 0.95), "d_hue": None if first else d,
            "d_sat": None if first else d * 0.7, "d_lum": None if first else d * 1.2,
            "brightness": float(rng.choice([5.0, 120.0], p=[0.2, 0.8])), "luma_variance": 200.0, "saturation_variance": 100.0,
            "clipping": 0.0, "sharpness": float(np.float32(rng.uniform(0, 300))), "noise": 1.0, "motion_blur": 0.0, "colorfulness": 20.0,
        })
    return rows


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("adaptive", [False, True])
def test_machine_equals_lists(seed, adaptive):
    """Scenes always; keyframes where no lane lags, so windows are whole seconds of a scene."""
    o = SceneOptions(
        lanes=("threshold", "luma_histogram", "content", *(["adaptive"] if adaptive else [])),
        threshold=ThresholdOptions(min_duration=300 * MS), luma_histogram=HistogramOptions(min_duration=700 * MS),
        content=ContentOptions(min_duration=500 * MS), adaptive=AdaptiveOptions(min_duration=400 * MS, adaptive_threshold=2.0),
        max_scene_duration=3000 * MS, select=SelectOptions(target_interval=1000 * MS, adaptive_min_samples=5),
    )
    if not adaptive:  # a fade's cut lies in the past, where windows have gone out already
        o = o.replace(lanes=("luma_histogram", "content"))
    rows = stream(seed)
    machine = SceneMachine(o)
    found = [e for r in rows for e in machine.push(r)] + machine.finish()
    got = [("scene", e["start_pts"], e["end_pts"], e["provenance"]) if e["event_kind"] == "scene" else ("keyframe", e["pts"], None, e["provenance"]) for e in found]
    want = told(rows, o)
    kinds = ("scene",) if adaptive else ("scene", "keyframe")
    assert sorted((e for e in got if e[0] in kinds), key=str) == [e for e in want if e[0] in kinds]
    assert len({e[3] for e in got}) > 4


def test_lanes_have_their_own_kernels():
    from kinoflow.operators.cascade import lane_columns

    both = SceneOptions(content=ContentOptions(kernel_size=3, weights=(0, 0, 0, 1)), adaptive=AdaptiveOptions(kernel_size=31, weights=(1, 1, 1, 1)))
    names, how = lane_columns(both)
    assert "d_edges_adaptive" in names and (how["kernel"], how["kernel_adaptive"]) == (3, 31)
    machine = SceneMachine(both)
    row = {"d_hue": 0.0, "d_sat": 0.0, "d_lum": 0.0, "d_edges": 40.0, "d_edges_adaptive": 80.0}
    assert machine._score(row, "content") == (40.0, [0.0, 0.0, 0.0, 40.0]) and machine._score(row, "adaptive")[0] == 20.0
    plain = SceneOptions(adaptive=AdaptiveOptions(weights=(1, 1, 1, 1)))
    assert SceneMachine(plain)._score(row, "content") == (0.0, [0.0] * 4)
    assert "d_edges_adaptive" not in lane_columns(plain)[0]


def test_fade_without_mean_and_stored_flags():
    fade = Fade(ThresholdOptions(min_duration=0))
    means = [200.0, None, 5.0, None, 200.0]
    assert [c["pts"] for i, m in enumerate(means) for c in fade.push({"pts": i * 100, "mean": m})] == [300]
    o = SceneOptions.from_dict({"lanes": "PHASH | content", "extractors": "SHARPNESS | noise"})
    assert o.lanes == ("phash", "content") and o.extractors == ("sharpness", "noise")
    with pytest.raises(OptionsError):
        SceneOptions.from_dict({"lanes": ""})


def test_backlog_sheds_plain_keyframes_first():
    """Over 256 events waiting, the oldest keyframe that isn't a boundary goes, then boundaries, never a scene."""
    machine = SceneMachine()
    for i in range(100):
        machine._emit({"event_kind": "keyframe", "pts": i, "provenance": "boundary"})
        machine._emit({"event_kind": "keyframe", "pts": i, "provenance": "quality"})
        machine._emit({"event_kind": "scene", "start_pts": i, "end_pts": i + 1, "provenance": "content"})
    kinds = [e["provenance"] for e in machine.pending]
    assert len(kinds) == 256 and (kinds.count("boundary"), kinds.count("quality"), kinds.count("content")) == (100, 56, 100)
    for i in range(200):
        machine._emit({"event_kind": "scene", "start_pts": i, "end_pts": i + 1, "provenance": "content"})
    kinds = [e["provenance"] for e in machine.pending]
    assert kinds.count("content") == 300 and kinds.count("boundary") == 0


def test_downscaled_features(spark):
    """With a longest side, features are those of the frames scaled down first."""
    from kinoflow.operators import features
    from kinoflow.sources import frames as S

    rng = np.random.default_rng(3)
    big = rng.integers(0, 256, (3, 40, 60, 3)).astype(np.uint8)
    small = K.downscale(big, 20)
    make = lambda stack: spark.createDataFrame(
        [(1, i, i * 40, 1, 1000, x.shape[1], x.shape[0], x.tobytes(), x.shape[1] * 3, "rgb", None, None, None, None, None, None) for i, x in enumerate(stack)],
        S.FRAMES,
    )
    wanted = ("luma_mean", "sharpness", "saturation_variance", "d_lum", "phash_distance")
    got = [tuple(r[w] for w in wanted) for r in features.compute_features(make(big), wanted, longest=20).orderBy("seq").collect()]
    want = [tuple(r[w] for w in wanted) for r in features.compute_features(make(small), wanted).orderBy("seq").collect()]
    assert got == want and got[0] != tuple(features.compute_features(make(big), wanted).orderBy("seq").first()[w] for w in wanted)
