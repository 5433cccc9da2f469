"""Pixel kernels on stacks of equal-sized frames: (frames, height, width) arrays of bytes, (..., 3) for packed colour."""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np

NOISE_SCALE = 0.2088987548863723  # sqrt(pi / 2) / 6


def unpack(data: bytes, width: int, height: int, stride: int, channels: int = 1) -> np.ndarray:
    """A plane without its row padding."""
    row = width * channels
    flat = np.frombuffer(data, np.uint8, count=stride * (height - 1) + row if height else 0)
    if stride != row:
        flat = np.concatenate([flat, np.zeros(stride * height - len(flat), np.uint8)])
    rows = flat.reshape(height, stride)[:, :row] if height else flat.reshape(0, row)
    return rows.reshape(height, width, channels) if channels > 1 else rows


def channels(packed: np.ndarray, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, g, b) as 32-bit integers."""
    first, g, last = (packed[..., i].astype(np.int32) for i in range(3))
    return (last, g, first) if order.lower() == "bgr" else (first, g, last)


def to_luma(packed: np.ndarray, order: str) -> np.ndarray:
    r, g, b = channels(packed, order)
    return ((77 * r + 150 * g + 29 * b) >> 8).astype(np.uint8)


@lru_cache(maxsize=1)
def hsv_quotients() -> tuple[np.ndarray, np.ndarray]:
    """All rounded quotients, in whole numbers: saturation by (value, spread); hue by (sector, whether the difference is
    negative, spread, difference modulo 256)."""
    v, d = np.arange(256)[:, None], np.arange(256)[None, :]
    sat = np.where(v > 0, (510 * d + v) // np.maximum(2 * v, 1), 0)
    spread, hues = np.arange(256)[:, None], []
    for turn in (0, 360), (120, 120), (240, 240):
        for negative, begin in enumerate(turn):
            diff = np.arange(256)[None, :] - 256 * negative
            hue = np.minimum((60 * diff + begin * spread + spread) // np.maximum(2 * spread, 1), 179)
            hues.append(np.where(spread > 0, hue, 0))
    return sat.astype(np.uint8).reshape(-1), np.stack(hues).astype(np.uint8).reshape(-1)


#: Pixels worked on together, so that what is between the steps stays in the cache.
RUN = 1 << 15


def to_hsv(packed: np.ndarray, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes with hue in 0..179; the quotients are looked up."""
    sat_of, hue_of = hsv_quotients()
    flat = packed.reshape(-1, 3)
    first, last = (2, 0) if order.lower() == "bgr" else (0, 2)
    h, s, v = (np.empty(len(flat), np.uint8) for _ in range(3))
    for at in range(0, len(flat), RUN):
        part = slice(at, at + RUN)
        r, g, b = (np.ascontiguousarray(flat[part, i]) for i in (first, 1, last))
        top = np.maximum(np.maximum(r, g), b)
        spread = top - np.minimum(np.minimum(r, g), b)
        # Products with 0 and 1 take the place of choices, which don't run on several pixels at once.
        from_r = top == r
        from_g = (top == g) > from_r
        from_b = ~(from_r | from_g)
        negative = (from_r & (g < b)) | (from_g & (b < r)) | (from_b & (r < g))
        is_r, is_g, is_b, below = (x.view(np.uint8) for x in (from_r, from_g, from_b, negative))
        diff = (g - b) * is_r + (b - r) * is_g + (r - g) * is_b
        sector = 2 * is_g + 4 * is_b + below
        wide = spread.astype(np.int32)
        np.take(sat_of, (top.astype(np.int32) << 8) + wide, out=s[part], mode="clip")
        np.take(hue_of, (sector.astype(np.int32) << 16) + (wide << 8) + diff, out=h[part], mode="clip")
        v[part] = top
    shape = packed.shape[:-1]
    return h.reshape(shape), s.reshape(shape), v.reshape(shape)


def histogram(planes: np.ndarray, bins: int) -> np.ndarray:
    n = len(planes)
    flat = planes.reshape(n, -1)
    if flat.shape[1] >= 4096:  # large frames one by one: counts of the 256 values, then of the bins that hold them
        values = np.stack([value_counts(x) for x in flat])
    else:
        values = np.bincount((flat + 256 * np.arange(n)[:, None]).reshape(-1), minlength=n * 256).reshape(n, 256)
    if bins == 256:
        return values
    if bins < 256:  # each bin holds a run of values
        return np.add.reduceat(values, -(-256 * np.arange(bins) // bins), axis=1)
    out = np.zeros((n, bins), values.dtype)
    out[:, np.arange(256) * bins // 256] = values  # no two values share a bin
    return out


def value_counts(flat: np.ndarray) -> np.ndarray:
    """How often each of the 256 values occurs; in runs, as counting widens each value to eight bytes."""
    out = np.zeros(256, np.int64)
    for at in range(0, len(flat), RUN):
        out += np.bincount(flat[at : at + RUN], minlength=256)
    return out


def byte_sums(planes: np.ndarray) -> np.ndarray:
    """The sum of each plane's bytes. 128 pairs of bytes fit into 16 bits, so four such sums run in each 64-bit word."""
    flat = np.ascontiguousarray(planes).reshape(len(planes), -1)
    n, size = flat.shape
    groups = size // 1024
    if not groups:
        return flat.sum(axis=1, dtype=np.int64)
    out = flat[:, groups * 1024 :].sum(axis=1, dtype=np.int64)
    mask = np.uint64(0x00FF00FF00FF00FF)
    for i in range(n):
        words = flat[i, : groups * 1024].view(np.uint64).reshape(128, groups)
        for at in range(0, groups, 256):
            part = words[:, at : at + 256]
            pairs = (part & mask) + ((part >> np.uint64(8)) & mask)
            out[i] += int(pairs.sum(axis=0).view(np.uint16).sum(dtype=np.int64))
    return out


def mean(planes: np.ndarray) -> np.ndarray:
    size = planes.reshape(len(planes), -1).shape[1]
    return byte_sums(planes) / size if size else np.zeros(len(planes))


def mean_variance(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance, as floats of 32 bits."""
    flat = planes.reshape(len(planes), -1).astype(np.int64)
    n = max(flat.shape[1], 1)
    m = flat.sum(axis=1) / n
    var = np.maximum((flat * flat).sum(axis=1) / n - m * m, 0)
    return m.astype(np.float32), var.astype(np.float32)


def clipping(packed: np.ndarray) -> np.ndarray:
    """The share of pixels whose brightest channel is under 5 or over 250."""
    top = np.maximum(np.maximum(packed[..., 0], packed[..., 1]), packed[..., 2]).reshape(len(packed), -1)
    n = max(top.shape[1], 1)
    return (((top < 5) | (top > 250)).sum(axis=1) / n).astype(np.float32)


def colorfulness(packed: np.ndarray, order: str) -> np.ndarray:
    """Spread and offset of the red-green and yellow-blue differences, from whole-number moments."""
    r, g, b = (c.reshape(len(packed), -1).astype(np.int64) for c in channels(packed, order))
    n = max(r.shape[1], 1)
    rg, yb = r - g, r + g - 2 * b  # yb is doubled
    m_rg, m_yb = rg.sum(axis=1) / n, yb.sum(axis=1) / n / 2
    v_rg = np.maximum((rg * rg).sum(axis=1) / n - m_rg * m_rg, 0)
    v_yb = np.maximum((yb * yb).sum(axis=1) / n / 4 - m_yb * m_yb, 0)
    return (np.sqrt(v_rg + v_yb) + 0.3 * np.sqrt(m_rg * m_rg + m_yb * m_yb)).astype(np.float32)


def _around(p: np.ndarray, y: int, x: int) -> np.ndarray:
    """The interior shifted by (y, x)."""
    h, w = p.shape[1:]
    return p[:, 1 + y : h - 1 + y, 1 + x : w - 1 + x]


def gradients(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3x3 Sobel (gx, gy) of the interior: a smoothed column or row against the next but one."""
    p = planes.astype(np.int16)
    down = p[:, :-2] + p[:, 2:]
    down += p[:, 1:-1]
    down += p[:, 1:-1]
    along = p[:, :, :-2] + p[:, :, 2:]
    along += p[:, :, 1:-1]
    along += p[:, :, 1:-1]
    return down[:, :, 2:] - down[:, :, :-2], along[:, 2:] - along[:, :-2]


def directions(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """0 level, 2 upright, 1 and 3 the diagonals by whether the signs agree."""
    ax, ay = np.abs(gx).astype(np.int32), np.abs(gy).astype(np.int32)
    one_sided = (np.sign(gx) == np.sign(gy)).view(np.uint8)
    ay *= 1000
    upright = (ay > 2414 * ax).view(np.uint8)
    return (3 - 2 * one_sided) * ((ay >= 414 * ax).view(np.uint8) - upright) + 2 * upright


def _small(planes: np.ndarray) -> bool:
    return planes.shape[1] < 3 or planes.shape[2] < 3


def sharpness_of(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Mean squared gradient from the interior's gradients."""
    x, y = gx.reshape(len(gx), -1).astype(np.int64), gy.reshape(len(gy), -1).astype(np.int64)
    return ((x * x + y * y).sum(axis=1) / max(x.shape[1], 1)).astype(np.float32)


def sharpness(planes: np.ndarray) -> np.ndarray:
    return np.zeros(len(planes), np.float32) if _small(planes) else sharpness_of(*gradients(planes))


def noise(planes: np.ndarray) -> np.ndarray:
    if _small(planes):
        return np.zeros(len(planes), np.float32)
    p = planes.astype(np.int32)
    a = lambda y, x: _around(p, y, x)
    edge = a(-1, 0) + a(1, 0) + a(0, -1) + a(0, 1)
    corner = a(-1, -1) + a(-1, 1) + a(1, -1) + a(1, 1)
    total = np.abs(4 * a(0, 0) - 2 * edge + corner).reshape(len(p), -1)
    return (total.sum(axis=1, dtype=np.int64) * NOISE_SCALE / total.shape[1]).astype(np.float32)


def motion_blur_of(magnitude: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """How far one of the four directions holds more than its quarter of all gradient."""
    m, d = magnitude.reshape(len(magnitude), -1).astype(np.int64), direction.reshape(len(direction), -1)
    sums = np.stack([np.where(d == k, m, 0).sum(axis=1) for k in range(4)], axis=1)
    total = sums.sum(axis=1)
    share = sums.max(axis=1) / np.maximum(total, 1)
    return np.where(total > 0, np.minimum(np.maximum(share - 0.25, 0) / 0.75, 1), 0).astype(np.float32)


def motion_blur(planes: np.ndarray) -> np.ndarray:
    if _small(planes):
        return np.zeros(len(planes), np.float32)
    gx, gy = gradients(planes)
    return motion_blur_of(np.abs(gx) + np.abs(gy), directions(gx, gy))


def mean_abs_diff(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Frame by frame; NaN for frames without pixels."""
    x, y = a.reshape(len(a), -1), b.reshape(len(b), -1)
    if not x.shape[1]:
        return np.full(len(a), np.nan)
    return byte_sums(np.maximum(x, y) - np.minimum(x, y)) / x.shape[1]


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson's over histogram bins; two flat ones: 1 if equal, else 0; one flat: 0."""
    a, b = a.astype(np.int64, copy=False), b.astype(np.int64, copy=False)
    n = a.shape[1]
    sa, sb = a.sum(axis=1), b.sum(axis=1)
    dot = lambda x, y: n * np.einsum("ij,ij->i", x, y)
    ab, aa, bb = dot(a, b) - sa * sb, dot(a, a) - sa * sa, dot(b, b) - sb * sb
    below = np.sqrt(aa.astype(np.float64)) * np.sqrt(bb.astype(np.float64))
    flat = np.zeros(len(a))
    both = np.flatnonzero((aa == 0) & (bb == 0))
    flat[both] = (a[both] == b[both]).all(axis=1)
    return np.where((aa > 0) & (bb > 0), ab / np.where(below > 0, below, 1), flat)


def auto_kernel(width: int, height: int) -> int:
    k = 4 + int(np.floor(np.sqrt(width * height) / 192 + 0.5))
    return max(3, k + (k % 2 == 0))


def dilate(planes: np.ndarray, kernel: int) -> np.ndarray:
    """The largest value of the k x k window around each pixel, clipped at the borders. Windows of 1, 2, 4... pixels are
    made from two of half the size, the last from two that overlap."""
    out, r = planes, kernel // 2
    if not r:
        return planes
    for axis in (1, 2):
        n = out.shape[axis]
        shape = list(out.shape)
        shape[axis] = n + 2 * r
        grown = np.zeros(shape, out.dtype)
        at = lambda start, stop: tuple(slice(start, stop) if i == axis else slice(None) for i in range(3))  # noqa: E731, B023
        grown[at(r, r + n)] = out
        width = 1
        while width < 2 * r + 1:
            step = min(width, 2 * r + 1 - width)
            grown = np.maximum(grown[at(0, grown.shape[axis] - step)], grown[at(step, None)])
            width += step
        out = grown
    return out


def _spread(state: np.ndarray) -> None:
    """Weak pixels (1) beside strong ones (2) get strong: two sweeps over each frame, there and back, in place.

    Within a sweep a pixel sees what the sweep has already done. A sweep in raster order therefore reaches all weak
    pixels that hang on a strong one by steps to the right and to the three below, the way back those of the opposite
    steps; so the strong ones grow step by step along those until nothing is added. The border holds no weak pixels.
    """
    flat, w = state.reshape(-1), state.shape[2]
    for sign in (1, -1, 1, -1):
        steps = sign * np.array([1, w - 1, w, w + 1])
        weak = np.flatnonzero(flat == 1)
        beside = np.zeros(len(weak), bool)
        for step in steps:
            beside |= flat[weak - step] == 2
        grown = weak[beside]
        while len(grown):
            flat[grown] = 2
            near = (grown[:, None] + steps).reshape(-1)
            grown = np.unique(near[flat[near] == 1])


def edge_map(v: np.ndarray) -> np.ndarray:
    """Thinned gradients of value planes, 0 or 255: strong ones, and weak ones that hang on them, by thresholds around
    each plane's median."""
    n, h, w = v.shape
    if _small(v):
        return np.zeros(v.shape, np.uint8)
    gx, gy = gradients(v)
    mag = np.zeros(v.shape, np.int16)
    mag[:, 1:-1, 1:-1] = np.abs(gx) + np.abs(gy)
    inner = mag[:, 1:-1, 1:-1]
    counts = histogram(v, 256).cumsum(axis=1)
    median = (counts <= (h * w) // 2).sum(axis=1).astype(np.float32)
    third = np.float32(1.0) / np.float32(3.0)
    low = np.maximum((np.float32(1) - third) * median, 0).astype(np.uint8).astype(np.int16)[:, None, None]
    high = np.minimum((np.float32(1) + third) * median, 255).astype(np.uint8).astype(np.int16)[:, None, None]
    way = directions(gx, gy) | ((inner < np.maximum(low, 1)).view(np.uint8) << np.uint8(2))
    keep = np.zeros(inner.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (-1, 1))):
        keep |= (way == k) & (inner >= _around(mag, dy, dx)) & (inner >= _around(mag, -dy, -dx))
    state = np.zeros(v.shape, np.uint8)
    np.add(keep, keep & (inner >= high), out=state[:, 1:-1, 1:-1], dtype=np.uint8)
    _spread(state)
    return np.where(state == 2, np.uint8(255), np.uint8(0))


def edges(v: np.ndarray, kernel: int | None = None) -> np.ndarray:
    """Dilated edge maps of value planes."""
    return dilate(edge_map(v), kernel or auto_kernel(v.shape[2], v.shape[1]))


@lru_cache(maxsize=64)
def overlap_weights(old: int, new: int) -> np.ndarray:
    """(new, old): the share of each old cell in each of ``new`` equal cells."""
    left = np.arange(new)[:, None] * (old / new)
    cells = np.arange(old)[None, :]
    share = np.minimum(left + old / new, cells + 1) - np.maximum(left, cells)
    return (np.maximum(share, 0) * (new / old)).astype(np.float32)


@lru_cache(maxsize=8)
def dct_basis(n: int) -> np.ndarray:
    k, i = np.arange(n, dtype=np.float64)[:, None], np.arange(n, dtype=np.float64)[None, :]
    out = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    out[0] = np.sqrt(1 / n)
    return out.astype(np.float32)


def phash(planes: np.ndarray, size: int = 16, lowpass: int = 2) -> np.ndarray:
    """(frames, words) of 64 bits: bit i tells whether the i-th low coefficient is over the frame's median.

    Frames with coefficients that single precision can't tell from the median are worked out in double, unless they are
    blown up: those have coefficients that are zero but for rounding, which no precision tells apart.
    """
    n, h, w = planes.shape
    side = size * lowpass
    if not h or not w:
        return np.zeros((n, -(-size * size // 64)), np.uint64)
    small = overlap_weights(h, side) @ planes.astype(np.float32) @ overlap_weights(w, side).T
    top = small.max(axis=(1, 2), keepdims=True)
    small = small * np.where(top > 0, 1 / np.where(top > 0, top, 1), 1).astype(np.float32)
    basis = dct_basis(side)
    low = (basis[:size] @ small @ basis.T[:, :size]).reshape(n, -1)
    middle = np.median(low, axis=1, keepdims=True)
    bits = low > middle
    if side <= min(h, w):
        near = np.flatnonzero((np.abs(low - middle) < 1e-5 * np.abs(low).max(axis=1, keepdims=True)).any(axis=1))
        step = max(1, RUN * 4 // (h * w))
        for at in range(0, len(near), step):
            part = near[at : at + step]
            exact = low_coefficients(planes[part], size, side)
            bits[part] = exact > np.median(exact, axis=1, keepdims=True)
    padded = np.zeros((n, -(-size * size // 64) * 64), np.uint8)
    padded[:, : size * size] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


@lru_cache(maxsize=8)
def axis_weights(old: int, size: int, side: int) -> np.ndarray:
    """(size, old) in double precision: shrinking to ``side`` cells and its first ``size`` cosines as one step."""
    ends = [i * old / side for i in range(side + 1)]
    share = [[max(0, min(ends[c + 1], j + 1) - max(ends[c], j)) * side / old for j in range(old)] for c in range(side)]
    wave = [[math.cos(math.pi * (2 * c + 1) * u / (2 * side)) for c in range(side)] for u in range(size)]
    norm = [math.sqrt((2 if u else 1) / side) for u in range(size)]
    out = np.zeros((size, old))
    for c in range(side):
        out += np.array(share[c]) * np.array(wave)[:, c, None] * np.array(norm)[:, None]
    return out


def low_coefficients(planes: np.ndarray, size: int, side: int) -> np.ndarray:
    """(frames, size * size) in double precision. Small frames are summed pixel by pixel, each product and sum rounded
    once, so that coefficients equal but for rounding come out the same whatever library multiplies matrices."""
    n, h, w = planes.shape
    down, along = axis_weights(h, size, side), axis_weights(w, size, side)
    if h * w > 4096:
        return (down @ planes.astype(np.float64) @ along.T).reshape(n, -1)
    weights = (down[:, None, :, None] * along[None, :, None, :]).reshape(size * size, h * w).tolist()
    pixels = planes.reshape(n, -1).astype(np.float64).tolist()
    return np.array([[reduce(lambda total, x: math.fma(*x, total), zip(p, row, strict=True), 0.0) for row in weights] for p in pixels])


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def downscaled_size(width: int, height: int, longest: int) -> tuple[int, int]:
    """Dimensions with that longest side, the other in proportion and rounded down; unchanged if small enough."""
    top = max(width, height)
    if top <= longest or not min(width, height):
        return width, height
    return max(1, width * longest // top), max(1, height * longest // top)


def downscale(packed: np.ndarray, longest: int = 256) -> np.ndarray:
    """Area averages."""
    h, w = packed.shape[1:3]
    nw, nh = downscaled_size(w, h, longest)
    if (nw, nh) == (w, h):
        return packed
    planes = np.moveaxis(packed.astype(np.float32), -1, 1)
    out = overlap_weights(h, nh) @ planes @ overlap_weights(w, nw).T
    return np.moveaxis(np.clip(np.floor(out + 0.5), 0, 255), 1, -1).astype(np.uint8)
