"""Options, timebases, and the sequential rules on hand-written streams."""

import pytest

from kinoflow.functions.columns import METRICS
from kinoflow.operators.cascade import SceneMachine, Selector, quality, rejected
from kinoflow.operators.gates import Fade, FlashFilter, Spacing
from kinoflow.options import (
    AdaptiveOptions, CompositeWeights, ContentOptions, HistogramOptions, OptionsError, PhashOptions, SceneOptions,
    SelectOptions, ThresholdOptions, flags,
)
from kinoflow.timebase import LIMIT, SECOND, Timebase, compare, frames_to_ns, interpolate, lasts, rescale_ceil, ticks_of

MS = 1_000_000


@pytest.mark.parametrize(
    ("make", "kind"),
    [
        (lambda: HistogramOptions(threshold=1.5), "ThresholdOutOfRange"),
        (lambda: HistogramOptions(bins=1 << 30), "BinCountTooLarge"),
        (lambda: PhashOptions(size=1), "SizeTooSmall"),
        (lambda: PhashOptions(lowpass=0), "LowpassTooSmall"),
        (lambda: PhashOptions(size=1 << 20), "DimensionsOverflow"),
        (lambda: ContentOptions(weights=(0, 0, 0, 0)), "ZeroWeights"),
        (lambda: ContentOptions(kernel_size=4), "InvalidKernelSize"),
        (lambda: AdaptiveOptions(window_width=0), "ZeroWindowWidth"),
        (lambda: AdaptiveOptions(kernel_size=1), "InvalidKernelSize"),
        (lambda: SelectOptions(margin_ratio=0.5), "MarginRatio"),
        (lambda: SelectOptions(max_frames_per_shot=5000), "MaxFrames"),
        (lambda: SceneOptions(lanes=()), "NoCutLane"),
        (lambda: SceneOptions(adaptive=AdaptiveOptions(window_width=31)), "WindowTooWide"),
        (lambda: SceneOptions(luma_histogram=HistogramOptions(bins=70_000)), "HistogramBinsTooLarge"),
        (lambda: SceneOptions(phash=PhashOptions(size=600)), "PhashSizeTooLarge"),
        (lambda: SceneOptions(content=ContentOptions(kernel_size=301, weights=(1, 1, 1, 1))), "KernelTooLarge"),
    ],
)
def test_options_are_checked(make, kind):
    with pytest.raises(OptionsError) as error:
        make()
    assert error.value.kind == kind


def test_options_json():
    for o in (SceneOptions(lanes=("phash", "content"), max_scene_duration=None), SelectOptions(min_sharpness=7.0), ThresholdOptions(method="ceiling")):
        assert type(o).from_json(o.to_json()) == o
    stored = SelectOptions.from_dict({"margin_ratio": 3.0, "max_frames_per_shot": 0, "target_interval": 0, "max_clipping": float("nan"), "new": 1})
    assert stored.margin_ratio < 0.5 and stored.max_frames_per_shot == 1 and stored.max_clipping == 0.5
    assert SelectOptions(min_sharpness=float("inf")).min_sharpness == 100.0
    assert CompositeWeights(noise_norm=0.0, clipping=float("nan")) == CompositeWeights()
    assert flags("SHARPNESS | noise") == {"sharpness", "noise"}
    assert SceneOptions(content=ContentOptions(kernel_size=301)).content.kernel_size == 301
    assert HistogramOptions().with_min_frames(15, 30).min_duration == 500 * MS


def test_timebase():
    ms, ntsc = Timebase(1, 1000), Timebase(1001, 30000)
    assert rescale_ceil(1, ntsc, ms) == 34 and rescale_ceil(-1, ntsc, ms) == -33 and rescale_ceil(LIMIT, Timebase(1, 1), ms) is None
    assert compare(1, Timebase(1, 2), 500, ms) == 0 and compare(1, ntsc, 33, ms) == 1
    assert ticks_of(SECOND, ms) == 1000 and ticks_of(SECOND // 2, Timebase(1, 1)) == 1
    assert frames_to_ns(15, 30) == 500 * MS and frames_to_ns(1, 3) == 333333333
    assert not lasts(-1, ms, 0) and lasts(1000, ms, SECOND) and not lasts(999, ms, SECOND)
    assert interpolate(10, 21, 0.5) == 15
    with pytest.raises(ValueError, match="positive"):
        frames_to_ns(1, 0)


def run(machine, rows):
    out = [x["pts"] for r in rows for x in machine.push(r)]
    return out + [x["pts"] for x in machine.finish()]


def test_spacing():
    rows = [{"pts": p, "score": 0.0, "candidate": c} for p, c in ((0, False), (40, True), (80, True), (300, True), (290, True), (1400, True))]
    assert run(Spacing(HistogramOptions(min_duration=200 * MS)), rows) == [40, 300, 1400]
    assert run(Spacing(HistogramOptions(min_duration=200 * MS, initial_cut=False)), rows) == [300, 1400]


def test_fade():
    rows = lambda means: [{"pts": 100 * i, "mean": m} for i, m in enumerate(means)]
    o = ThresholdOptions(min_duration=0)
    assert run(Fade(o), rows([200, 5, 5, 5, 200])) == [250]
    assert run(Fade(o.replace(fade_bias=-1.0)), rows([200, 5, 5, 5, 200])) == [100]
    assert run(Fade(o.replace(fade_bias=9.0)), rows([200, 5, 5, 5, 200])) == [400]
    assert run(Fade(o), rows([5, 5, 200])) == [100]
    assert run(Fade(o.replace(add_final_scene=True)), rows([200, 5, 5])) == [100]
    assert run(Fade(o), rows([200, 5, 5])) == []
    assert run(Fade(o.replace(method="ceiling", threshold=250)), rows([10, 255, 10])) == [150]
    assert run(Fade(ThresholdOptions()), rows([200, 5, 200, 5, 200])) == [150]  # the second is within a second of the first
    assert run(Fade(ThresholdOptions(initial_cut=False)), rows([200, 5, 200])) == []


def test_flash_filter():
    o = ContentOptions(min_duration=300 * MS)
    rows = lambda above: [{"pts": 100 * i, "score": None if a is None else 99.0 * a} for i, a in enumerate(above)]
    burst = [None, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1]
    assert run(FlashFilter(o), rows(burst)) == [100, 500, 1100]  # held back, reported at its end
    assert run(FlashFilter(o.replace(filter_mode="suppress")), rows(burst)) == [100, 400, 1100]
    assert run(FlashFilter(o.replace(min_duration=0)), rows(burst)) == [100, 200, 300, 400, 500, 1100]
    assert run(FlashFilter(o.replace(initial_cut=False)), rows([None, 0, 1, 0, 0, 0, 0, 1])) == [700]


def metrics(**more):
    base = {"brightness": 128.0, "luma_variance": 200.0, "saturation_variance": 100.0, "clipping": 0.0, "sharpness": 500.0,
            "noise": 0.0, "motion_blur": 0.0, "colorfulness": 0.0}
    return base | more


def test_gate():
    o = SelectOptions()
    assert not rejected(metrics(), o)
    for bad in ({"brightness": 14.0}, {"brightness": 241.0}, {"clipping": 0.6}, {"noise": float("nan")}, {"sharpness": -1.0}, {"luma_variance": 4.0, "saturation_variance": 2.0}):
        assert rejected(metrics(**bad), o), bad
    assert not rejected(metrics(luma_variance=4.0), o) and not rejected(metrics(motion_blur=0.9), o)
    assert rejected(metrics(motion_blur=0.9), o.replace(motion_blur_gate=True))
    assert quality(metrics(sharpness=1000.0, noise=20.0, colorfulness=50.0, clipping=0.5), o) == pytest.approx(1 - 0.3 + 0.2 - 0.25)


def test_selector():
    s = Selector(SelectOptions(target_interval=SECOND, margin_ratio=0.0), Timebase(1, 1000))
    for i in range(40):
        s.observe(i * 100, metrics(sharpness=200.0 + (i % 10 == 3) * 50))
    got = s.finalize_shot(0, 3000)
    assert [(p, strict) for p, _, strict in got] == [(300, True), (1300, True), (2300, True)]
    assert s.buffer[0][0] == 3000 and s.metrics_at(3300)["sharpness"] == 250.0
    with pytest.raises(ValueError, match="OutOfOrder"):
        s.observe(10, metrics())
    assert [p for p, _, _ in s.finalize_remaining(4000)] == [3300]
    assert s.finalize_shot(4000, 4000) == [] and s.finalize_remaining(9999) == []


def test_selector_fallback_ties_and_margins():
    s = Selector(SelectOptions(target_interval=10 * SECOND, margin_ratio=0.1, adaptive_floor=False), Timebase(1, 1000))
    for pts, sharp in ((0, 900.0), (200, 50.0), (300, 60.0), (400, 60.0), (950, 900.0)):
        s.observe(pts, metrics(sharpness=sharp))
    assert [(p, strict) for p, _, strict in s.finalize_shot(0, 1000)] == [(300, False)]  # margins hide 0 and 950
    s.observe(1000, metrics(sharpness=float("nan")))
    assert s.finalize_shot(1000, 2000) == []


def test_adaptive_floor():
    s = Selector(SelectOptions(adaptive_percentile=0.25), Timebase(1, 1000))
    for i in range(20):
        s.observe(i, metrics(sharpness=10.0 + i))
    assert s.floor(0, 100, [(0, 100)]) == 15.0 and s.floor(0, 10, [(0, 10)]) == 100.0


def frame(pts, luma=100.0, cut=False, size=(8, 8), **more):
    d = 90.0 if cut else 0.0
    lanes = {"luma_mean": luma, "corr_luma": 0.0 if cut else 1.0, "corr_hue": 1.0, "corr_sat": 1.0, "phash_distance": 0.0, "d_hue": d, "d_sat": d, "d_lum": d}
    return {"pts": pts, "tb_num": 1, "tb_den": 1000, "width": size[0], "height": size[1]} | lanes | metrics() | more


def events(options, rows):
    m = SceneMachine(options)
    return [e for r in rows for e in m.push(r)] + m.finish()


def scenes(found):
    return [(e["start_pts"], e["end_pts"], e["provenance"]) for e in found if e["event_kind"] == "scene"]


BASIC = SceneOptions(lanes=("luma_histogram", "content"), max_scene_duration=None)


def test_scenes_tile_the_stream():
    rows = [frame(i * 100, cut=i in (12, 30)) for i in range(50)]
    found = events(BASIC, rows)
    assert scenes(found) == [(0, 1200, "histogram"), (1200, 3000, "histogram"), (3000, 4901, "finalized")]
    assert [e["out_seq"] for e in found] == list(range(len(found)))
    boundary = [e["pts"] for e in found if e["provenance"] == "boundary"]
    assert boundary == [0, 1200, 3000]
    start = 0
    for e in found:  # keyframes of a scene come before it, and lie in it
        if e["event_kind"] == "scene":
            start = e["end_pts"]
        else:
            assert e["pts"] >= start and len(e["metrics"]) == len(METRICS)
    assert len({e["pts"] for e in found if e["event_kind"] == "keyframe"}) == sum(e["event_kind"] == "keyframe" for e in found)


def test_spacing_and_warm_up():
    rows = [frame(i * 100, cut=i in (3, 5, 20)) for i in range(30)]
    assert [s[:2] for s in scenes(events(BASIC, rows))] == [(0, 300), (300, 2000), (2000, 2901)]
    late = SceneOptions(lanes=("luma_histogram",), luma_histogram=HistogramOptions(initial_cut=False))
    assert [s[:2] for s in scenes(events(late, rows))] == [(0, 2000), (2000, 2901)]


def test_max_span_and_late_adaptive():
    rows = [frame(i * 100) for i in range(50)]
    forced = events(BASIC.replace(max_scene_duration=2 * SECOND), rows)
    assert scenes(forced) == [(0, 2000, "max_span"), (2000, 4000, "max_span"), (4000, 4901, "finalized")]
    rows = [frame(i * 100, cut=i == 20) for i in range(40)]
    found = events(SceneOptions(lanes=("adaptive",), max_scene_duration=None), rows)
    assert scenes(found) == [(0, 2000, "adaptive"), (2000, 3901, "finalized")]


def test_fade_lane_and_end():
    o = SceneOptions(lanes=("threshold",), threshold=ThresholdOptions(add_final_scene=True), max_scene_duration=None)
    rows = [frame(i * 100, luma=5.0 if 10 <= i < 14 or i >= 40 else 100.0) for i in range(45)]
    found = events(o, rows)
    assert scenes(found) == [(0, 1200, "threshold"), (1200, 4000, "threshold"), (4000, 4401, "finalized")]


def test_resize_and_order():
    rows = [frame(i * 100, size=(8, 8) if i < 10 else (4, 4), cut=i == 10, d_lum=None if i == 10 else 0.0, corr_luma=None if i == 10 else 1.0) for i in range(20)]
    rows.insert(5, frame(0))  # late: not admitted
    rows.append(frame(LIMIT))
    assert scenes(events(BASIC, rows)) == [(0, 1901, "finalized")]


def test_equal_times_and_deferral():
    o = SceneOptions(lanes=("threshold", "luma_histogram"), threshold=ThresholdOptions(min_duration=0), luma_histogram=HistogramOptions(min_duration=0), max_scene_duration=None)
    rows = [frame(i * 100, luma=5.0 if 4 <= i < 8 else 100.0, cut=i == 8) for i in range(14)]
    assert [s[1:] for s in scenes(events(o, rows))] == [(600, "threshold"), (800, "histogram"), (1301, "finalized")]
    rows = [frame(0), frame(0), frame(100, cut=True), frame(100)]
    assert scenes(events(BASIC, rows)) == [(0, 100, "histogram"), (100, 101, "finalized")]


def test_extractors_off_lift_the_floor():
    o = SceneOptions(extractors=("noise",))
    assert o.selector().min_sharpness == -1.0 and o.selector().margin_ratio == 0.0
