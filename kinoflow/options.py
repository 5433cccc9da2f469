"""Options of the detectors, the keyframe selector and the scene machine: defaults, checks, JSON."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field

from kinoflow.timebase import SECOND, frames_to_ns


class OptionsError(ValueError):
    """``kind`` names what is wrong."""

    def __init__(self, kind: str, text: str = ""):
        super().__init__(f"{kind}: {text}" if text else kind)
        self.kind = kind


def need(ok: bool, kind: str, text: str = "") -> None:
    if not ok:
        raise OptionsError(kind, text)


class Options:
    """Shared by all: copies with changes, and JSON in which missing fields take their defaults."""

    def replace(self, **changes):
        return dataclasses.replace(self, **changes)

    def with_min_frames(self, frames: int, fps_num: int, fps_den: int = 1):
        return self.replace(min_duration=frames_to_ns(frames, fps_num, fps_den))

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str):
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_dict(cls, data: dict):
        known = {f.name: f for f in dataclasses.fields(cls)}
        made = {}
        for name, value in data.items():
            if name in known:
                kind = _NESTED.get((cls.__name__, name))
                made[name] = kind.from_dict(value) if kind and isinstance(value, dict) else value
        return cls(**cls._clamped(made))

    @classmethod
    def _clamped(cls, made: dict) -> dict:
        return made


@dataclass(frozen=True)
class HistogramOptions(Options):
    threshold: float = 0.5
    bins: int = 256
    min_duration: int = SECOND
    initial_cut: bool = True

    def __post_init__(self):
        need(0 < self.bins <= 1 << 24, "BinCountTooLarge")
        need(0.0 <= self.threshold <= 1.0, "ThresholdOutOfRange")


@dataclass(frozen=True)
class PhashOptions(Options):
    threshold: float = 0.395
    size: int = 16
    lowpass: int = 2
    min_duration: int = SECOND
    initial_cut: bool = True

    def __post_init__(self):
        need(self.size >= 2, "SizeTooSmall")
        need(self.lowpass >= 1, "LowpassTooSmall")
        need(self.size * self.lowpass < 1 << 16, "DimensionsOverflow")


@dataclass(frozen=True)
class ThresholdOptions(Options):
    threshold: int = 12
    method: str = "floor"
    fade_bias: float = 0.0
    add_final_scene: bool = False
    min_duration: int = SECOND
    initial_cut: bool = True

    def __post_init__(self):
        need(self.method in ("floor", "ceiling"), "UnknownMethod")


@dataclass(frozen=True)
class ContentOptions(Options):
    threshold: float = 27.0
    weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 0.0)  # hue, saturation, luma, edges
    filter_mode: str = "merge"
    kernel_size: int | None = None
    min_duration: int = SECOND
    initial_cut: bool = True

    def __post_init__(self):
        object.__setattr__(self, "weights", tuple(float(w) for w in self.weights))
        need(sum(map(abs, self.weights)) > 0, "ZeroWeights")
        k = self.kernel_size
        need(k is None or (k >= 3 and k % 2 == 1), "InvalidKernelSize")
        need(self.filter_mode in ("merge", "suppress"), "UnknownFilterMode")


@dataclass(frozen=True)
class AdaptiveOptions(Options):
    adaptive_threshold: float = 3.0
    window_width: int = 2
    min_content_val: float = 15.0
    weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 0.0)
    kernel_size: int | None = None
    min_duration: int = SECOND
    initial_cut: bool = True

    def __post_init__(self):
        object.__setattr__(self, "weights", tuple(float(w) for w in self.weights))
        need(self.window_width > 0, "ZeroWindowWidth")
        need(2 * self.window_width + 1 < 1 << 32, "WindowWidthOverflow")
        ContentOptions(weights=self.weights, kernel_size=self.kernel_size)


@dataclass(frozen=True)
class CompositeWeights(Options):
    """Quality: sharpness, colourfulness up; noise, clipping, motion blur down. Each norm divides its metric."""

    sharpness: float = 1.0
    sharpness_norm: float = 1000.0
    noise: float = 0.3
    noise_norm: float = 20.0
    colorfulness: float = 0.2
    colorfulness_norm: float = 50.0
    clipping: float = 0.5
    motion_blur: float = 0.0

    def __post_init__(self):
        for f in dataclasses.fields(self):
            value = float(getattr(self, f.name))
            if not math.isfinite(value) or (f.name.endswith("_norm") and value <= 0):
                object.__setattr__(self, f.name, f.default)


@dataclass(frozen=True)
class SelectOptions(Options):
    target_interval: int = 4 * SECOND
    max_frames_per_shot: int = 16
    margin_ratio: float = 0.02
    min_sharpness: float = 100.0
    black_mean: float = 15.0
    bright_mean: float = 240.0
    luma_variance: float = 5.0
    sat_variance: float = 3.0
    max_clipping: float = 0.5
    adaptive_floor: bool = True
    adaptive_percentile: float = 0.25
    adaptive_min_samples: int = 20
    motion_blur_gate: bool = False
    max_motion_blur: float = 0.75
    weights: CompositeWeights = field(default_factory=CompositeWeights)

    def __post_init__(self):
        need(self.target_interval > 0, "ZeroInterval")
        need(0 < self.max_frames_per_shot <= 4096, "MaxFrames")
        need(0.0 <= self.margin_ratio < 0.5, "MarginRatio")
        for name in ("max_clipping", "adaptive_percentile", "max_motion_blur"):
            need(0.0 <= getattr(self, name) <= 1.0, name)
        for f in dataclasses.fields(self):
            value = getattr(self, f.name)
            if isinstance(f.default, float) and not math.isfinite(value):
                object.__setattr__(self, f.name, f.default)

    @classmethod
    def _clamped(cls, made: dict) -> dict:
        """Stored options are clamped where a caller's would raise."""
        out, plain = dict(made), cls()
        if "target_interval" in out:
            out["target_interval"] = max(1, int(out["target_interval"]))
        if "max_frames_per_shot" in out:
            out["max_frames_per_shot"] = min(max(1, int(out["max_frames_per_shot"])), 4096)
        if "margin_ratio" in out:
            r = out["margin_ratio"]
            out["margin_ratio"] = min(max(r, 0.0), math.nextafter(0.5, 0)) if math.isfinite(r) else plain.margin_ratio
        for name in ("max_clipping", "adaptive_percentile", "max_motion_blur"):
            if name in out:
                v = out[name]
                out[name] = min(max(v, 0.0), 1.0) if math.isfinite(v) else getattr(plain, name)
        return out


LANES = ("threshold", "luma_histogram", "hue_histogram", "sat_histogram", "phash", "content", "adaptive")
EXTRACTORS = ("sharpness", "noise", "motion_blur", "colorfulness")
#: Fixed bounds on work: ring of the adaptive lane, bins, working size of the hash, dilation kernel, pixels, buffers.
MAX_RING, MAX_BINS, MAX_HASH_SIDE, MAX_KERNEL, MAX_AREA = 64, 65_536, 1024, 256, 1 << 20
MAX_BUFFER, MAX_PENDING = 65_536, 256


def flags(text: str) -> frozenset[str]:
    """``"A | B"`` as a set of names."""
    return frozenset(x.strip().lower() for x in text.split("|") if x.strip())


@dataclass(frozen=True)
class SceneOptions(Options):
    lanes: tuple[str, ...] = ("threshold", "luma_histogram", "sat_histogram", "phash", "content", "adaptive")
    extractors: tuple[str, ...] = EXTRACTORS
    threshold: ThresholdOptions = field(default_factory=ThresholdOptions)
    luma_histogram: HistogramOptions = field(default_factory=HistogramOptions)
    hue_histogram: HistogramOptions = field(default_factory=HistogramOptions)
    sat_histogram: HistogramOptions = field(default_factory=HistogramOptions)
    phash: PhashOptions = field(default_factory=PhashOptions)
    content: ContentOptions = field(default_factory=ContentOptions)
    adaptive: AdaptiveOptions = field(default_factory=AdaptiveOptions)
    select: SelectOptions = field(default_factory=lambda: SelectOptions(target_interval=SECOND))
    max_scene_duration: int | None = 15 * SECOND

    def __post_init__(self):
        object.__setattr__(self, "lanes", tuple(x for x in LANES if x in set(self.lanes)))
        object.__setattr__(self, "extractors", tuple(x for x in EXTRACTORS if x in set(self.extractors)))
        need(bool(self.lanes), "NoCutLane")
        if "adaptive" in self.lanes:
            need(self.lag_frames <= MAX_RING, "WindowTooWide")
        for name in ("luma_histogram", "hue_histogram", "sat_histogram"):
            need(name not in self.lanes or getattr(self, name).bins <= MAX_BINS, "HistogramBinsTooLarge")
        need("phash" not in self.lanes or self.phash.size * self.phash.lowpass <= MAX_HASH_SIDE, "PhashSizeTooLarge")
        for name in ("content", "adaptive"):
            o = getattr(self, name)
            wide = name in self.lanes and o.weights[3] != 0 and (o.kernel_size or 0) > MAX_KERNEL
            need(not wide, "KernelTooLarge")

    @classmethod
    def _clamped(cls, made: dict) -> dict:
        """Stored flags may be one string, ``"A | B"``, or a list."""
        return made | {n: tuple(flags(made[n])) for n in ("lanes", "extractors") if isinstance(made.get(n), str)}

    @property
    def lag_frames(self) -> int:
        return 2 * self.adaptive.window_width + 3 if "adaptive" in self.lanes else 0

    def selector(self) -> SelectOptions:
        """Margins would lose frames at window seams; without sharpness there is no floor on it."""
        out = self.select.replace(margin_ratio=0.0)
        return out if "sharpness" in self.extractors else out.replace(min_sharpness=-1.0)


_NESTED = {
    ("SelectOptions", "weights"): CompositeWeights,
    ("SceneOptions", "threshold"): ThresholdOptions,
    ("SceneOptions", "luma_histogram"): HistogramOptions,
    ("SceneOptions", "hue_histogram"): HistogramOptions,
    ("SceneOptions", "sat_histogram"): HistogramOptions,
    ("SceneOptions", "phash"): PhashOptions,
    ("SceneOptions", "content"): ContentOptions,
    ("SceneOptions", "adaptive"): AdaptiveOptions,
    ("SceneOptions", "select"): SelectOptions,
}
