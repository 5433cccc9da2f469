"""Scalar functions as column expressions: they stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinoflow.options import CompositeWeights, SelectOptions

#: The largest sensible value of each metric; all are at least zero.
DOMAIN = {
    "sharpness": 2.1e6, "brightness": 255.0, "luma_variance": 16384.0, "saturation_variance": 16384.0,
    "clipping": 1.0, "noise": 1000.0, "motion_blur": 1.0, "colorfulness": 500.0,
}
METRICS = ("brightness", "luma_variance", "saturation_variance", "clipping", "sharpness", "noise", "motion_blur", "colorfulness")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def saturation(r: Column, g: Column, b: Column) -> Column:
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    return F.when(v > 0, F.floor((510 * d + v) / (2 * v))).otherwise(0).cast("int")


def hue(r: Column, g: Column, b: Column) -> Column:
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    diff = F.when(v == r, g - b).when(v == g, b - r).otherwise(r - g)
    turn = F.when(v == r, F.when(diff < 0, 360).otherwise(0)).when(v == g, 120).otherwise(240)
    return F.when(d > 0, F.least(F.floor((60 * diff + turn * d + d) / (2 * d)), F.lit(179))).otherwise(0).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two arrays of 64-bit words differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's over two arrays of counts, from whole-number sums; flat histograms: 1 if both are and agree, else 0."""
    n = F.size(a)
    sa, sb = _sum(a), _sum(b)
    ab = n * _sum(F.zip_with(a, b, lambda x, y: x.cast("long") * y)) - sa * sb
    aa = n * _sum(F.transform(a, lambda x: x.cast("long") * x)) - sa * sa
    bb = n * _sum(F.transform(b, lambda x: x.cast("long") * x)) - sb * sb
    return (
        F.when((aa == 0) & (bb == 0), F.when(a == b, 1.0).otherwise(0.0))
        .when((aa == 0) | (bb == 0), 0.0)
        .otherwise(ab / (F.sqrt(aa.cast("double")) * F.sqrt(bb.cast("double"))))
    )


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Of two arrays of bytes as integers; NaN where they are empty."""
    total = _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return F.when(F.size(a) == 0, F.lit(float("nan"))).otherwise(total / F.greatest(F.size(a), F.lit(1)))


def composite_quality(m: dict[str, Column], w: CompositeWeights = CompositeWeights()) -> Column:
    """In single precision, step by step."""
    f = lambda c: c.cast("float")
    lit = lambda v: f(F.lit(v))
    part = lambda name, weight, norm: f(f(lit(weight) * m[name]) / lit(norm))
    out = f(part("sharpness", w.sharpness, w.sharpness_norm) - part("noise", w.noise, w.noise_norm))
    out = f(out + part("colorfulness", w.colorfulness, w.colorfulness_norm))
    out = f(out - f(lit(w.clipping) * m["clipping"]))
    return f(out - f(lit(w.motion_blur) * m["motion_blur"]))


def in_domain(m: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name, top in DOMAIN.items():
        c = m[name]
        out = out & c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= F.lit(top).cast("float"))
    return out


def hard_gate(m: dict[str, Column], o: SelectOptions = SelectOptions()) -> Column:
    """True: the frame is out of domain, too dark, too bright, flat, clipped or, if asked, blurred."""
    f = lambda v: F.lit(v).cast("float")
    flat = (m["luma_variance"] < f(o.luma_variance)) & (m["saturation_variance"] < f(o.sat_variance))
    out = ~in_domain(m) | (m["brightness"] < f(o.black_mean)) | (m["brightness"] > f(o.bright_mean)) | flat
    out = out | (m["clipping"] > f(o.max_clipping))
    return out | (m["motion_blur"] > f(o.max_motion_blur)) if o.motion_blur_gate else out
