"""Pixel kernels against closed forms and plain restatements."""

import numpy as np
import pytest

from kinoflow.functions import kernels as K


def noise(seed, *shape):
    return np.random.default_rng(seed).integers(0, 256, shape).astype(np.uint8)


def test_hsv_equals_rounded_quotients():
    px = np.concatenate([noise(1, 1, 200, 200, 3).reshape(1, -1, 3), np.array([[[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8)], axis=1)
    h, s, v = K.to_hsv(px, "rgb")
    r, g, b = (px[0, :, i].astype(np.float64) for i in range(3))
    top = np.maximum(np.maximum(r, g), b)
    d = top - np.minimum(np.minimum(r, g), b)
    with np.errstate(all="ignore"):
        hue = np.where(top == r, 60 * (g - b) / d, np.where(top == g, 120 + 60 * (b - r) / d, 240 + 60 * (r - g) / d))
        hue = np.where(d > 0, np.where(hue < 0, hue + 360, hue), 0)
        sat = np.where(top > 0, 255 * d / top, 0)
    assert (v[0] == top).all()
    assert (s[0] == np.floor(sat + 0.5)).all()
    assert (h[0] == np.minimum(np.floor(hue / 2 + 0.5), 179)).all()
    assert [x.reshape(-1).tolist() for x in K.to_hsv(np.array([[[0, 0, 255]]], np.uint8)[None], "bgr")] == [[0], [255], [255]]


def test_luma_and_order():
    px = noise(2, 3, 4, 5, 3)
    assert (K.to_luma(px, "rgb") == K.to_luma(px[..., ::-1], "bgr")).all()
    assert K.to_luma(np.full((1, 1, 1, 3), 255, np.uint8), "rgb").item() == 255


def test_unpack_drops_padding():
    data = bytes(range(3 * 10))
    assert K.unpack(data, 4, 3, 10).tolist() == [[0, 1, 2, 3], [10, 11, 12, 13], [20, 21, 22, 23]]
    assert K.unpack(data[:24], 4, 3, 10).tolist() == K.unpack(data, 4, 3, 10).tolist()
    assert K.unpack(data, 2, 3, 10, 3).shape == (3, 2, 3)


def test_histogram_and_correlation():
    p = noise(3, 4, 9, 7)
    for bins in (1, 16, 100, 256):
        h = K.histogram(p, bins)
        assert h.sum(axis=1).tolist() == [63] * 4
        want = np.zeros((4, bins), int)
        for i in range(4):
            for v in p[i].reshape(-1).tolist():
                want[i, v * bins // 256] += 1
        assert (h == want).all()
    a, b = K.histogram(p, 16)[:1], K.histogram(p, 16)[1:2]
    assert K.correlation(a, b)[0] == pytest.approx(np.corrcoef(a[0], b[0])[0, 1])
    flat, other = np.full((1, 8), 3), np.full((1, 8), 4)
    assert [K.correlation(x, y)[0] for x, y in ((flat, flat), (flat, other), (a[:, :8], flat))] == [1, 0, 0]


def test_moments():
    half = np.zeros((1, 4, 4), np.uint8)
    half[:, 2:] = 100
    m, v = K.mean_variance(half)
    assert (m[0], v[0]) == (50, 2500)
    assert K.mean(np.zeros((2, 0, 4), np.uint8)).tolist() == [0, 0]
    grey = np.full((1, 5, 5, 3), 77, np.uint8)
    assert K.colorfulness(grey, "rgb")[0] == 0 and K.clipping(grey)[0] == 0
    px = noise(4, 2, 6, 6, 3)
    r, g, b = (px[0, ..., i].astype(float).reshape(-1) for i in range(3))
    rg, yb = r - g, (r + g) / 2 - b
    want = np.sqrt(rg.var() + yb.var()) + 0.3 * np.sqrt(rg.mean() ** 2 + yb.mean() ** 2)
    assert K.colorfulness(px, "rgb")[0] == pytest.approx(want, rel=1e-6)
    dark = np.zeros((1, 2, 2, 3), np.uint8)
    dark[0, 0, 0] = (0, 251, 0)
    dark[0, 0, 1] = (5, 0, 0)
    assert K.clipping(dark)[0] == 0.75


def sobel(p, y, x):
    p = p.astype(int)
    gx = sum(k * (p[y + d, x + 1] - p[y + d, x - 1]) for d, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (p[y + 1, x + d] - p[y - 1, x + d]) for d, k in ((-1, 1), (0, 2), (1, 1)))
    return gx, gy


def direction(gx, gy):
    if 1000 * abs(gy) < 414 * abs(gx):
        return 0
    if 1000 * abs(gy) > 2414 * abs(gx):
        return 2
    return 1 if np.sign(gx) == np.sign(gy) else 3


def test_gradient_metrics_against_loops():
    p = noise(5, 2, 7, 9)
    for i in range(2):
        g = [sobel(p[i], y, x) for y in range(1, 6) for x in range(1, 8)]
        assert K.sharpness(p)[i] == np.float32(sum(a * a + b * b for a, b in g) / 35)
        bins = [0] * 4
        for a, b in g:
            bins[direction(a, b)] += abs(a) + abs(b)
        assert K.motion_blur(p)[i] == np.float32(min(max(max(bins) / sum(bins) - 0.25, 0) / 0.75, 1))
        q = p[i].astype(int)
        lap = sum(
            abs(4 * q[y, x] - 2 * (q[y - 1, x] + q[y + 1, x] + q[y, x - 1] + q[y, x + 1]) + q[y - 1, x - 1] + q[y - 1, x + 1] + q[y + 1, x - 1] + q[y + 1, x + 1])
            for y in range(1, 6) for x in range(1, 8)
        )
        assert K.noise(p)[i] == np.float32(lap * K.NOISE_SCALE / 35)
    flat = np.full((1, 8, 8), 9, np.uint8)
    assert K.sharpness(flat)[0] == K.noise(flat)[0] == K.motion_blur(flat)[0] == 0
    assert K.sharpness(p[:, :2])[0] == K.noise(p[:, :, :2])[0] == K.motion_blur(p[:, :2])[0] == 0
    stripes = np.tile(np.array([0, 0, 255, 255], np.uint8), (1, 8, 2))
    assert K.motion_blur(stripes)[0] == 1


def test_mean_abs_diff():
    assert K.mean_abs_diff(np.zeros((1, 2, 2), np.uint8), np.full((1, 2, 2), 255, np.uint8))[0] == 255
    assert np.isnan(K.mean_abs_diff(np.zeros((1, 0, 2), np.uint8), np.zeros((1, 0, 2), np.uint8))[0])


def test_dilate_against_windows():
    p = noise(6, 2, 9, 11)
    for k in (3, 5, 7, 31):
        got, r = K.dilate(p, k), k // 2
        for y in range(9):
            for x in range(11):
                want = p[:, max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].max(axis=(1, 2))
                assert (got[:, y, x] == want).all()


def plain_edges(v, kernel):
    """The pipeline pixel by pixel."""
    h, w = v.shape
    mag, way = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            gx, gy = sobel(v, y, x)
            mag[y, x], way[y, x] = abs(gx) + abs(gy), direction(gx, gy)
    median = sorted(v.reshape(-1).tolist())[h * w // 2]
    third = np.float32(1) / np.float32(3)
    low, high = int(max((1 - third) * np.float32(median), 0)), int(min((1 + third) * np.float32(median), 255))
    mark = np.zeros((h, w), int)
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            dy, dx = ((0, 1), (1, 1), (1, 0), (-1, 1))[way[y, x]]
            m = mag[y, x]
            if m and m >= mag[y + dy, x + dx] and m >= mag[y - dy, x - dx]:
                mark[y, x] = 2 if m >= high else 1 if m >= low else 0
    inner = [(y, x) for y in range(1, h - 1) for x in range(1, w - 1)]
    for _ in range(2):
        for step, order in ((-1, inner), (1, inner[::-1])):
            for y, x in order:
                near = [mark[y + step, x - 1], mark[y + step, x], mark[y + step, x + 1], mark[y, x + step]]
                if mark[y, x] == 1 and 2 in near:
                    mark[y, x] = 2
    return K.dilate(np.where(mark == 2, 255, 0).astype(np.uint8)[None], kernel)[0]


def test_edges_against_pixels():
    for seed in range(6):
        v = noise(seed, 1, 14, 17) // (1 + seed) + np.add.outer(np.arange(14), np.arange(17)).astype(np.uint8)
        assert (K.edges(v, 3)[0] == plain_edges(v[0], 3)).all()
    assert not K.edges(noise(1, 1, 2, 9)).any()
    assert [K.auto_kernel(*x) for x in ((8, 8), (1920, 1080), (64, 48))] == [5, 13, 5]


def test_phash():
    b = K.dct_basis(32)
    assert np.allclose(b @ b.T, np.eye(32), atol=1e-5)
    w = K.overlap_weights(50, 32)
    assert np.allclose(w.sum(axis=1), 1, atol=1e-5)
    p = noise(7, 3, 48, 64)
    codes = K.phash(p)
    assert codes.shape == (3, 4) and (np.bitwise_count(codes).sum(axis=1) == 128).all()
    assert K.hamming(codes[:1], K.phash(p[:1]))[0] == 0
    brighter = (p[:1] // 2 + 10).astype(np.uint8)
    assert K.hamming(codes[:1], K.phash(brighter))[0] < 40 < K.hamming(codes[:1], codes[1:2])[0]
    assert K.phash(p, 2, 1).shape == (3, 1)
    assert not K.phash(np.zeros((1, 0, 4), np.uint8)).any()


def test_downscale():
    assert [K.downscaled_size(*x, 256) for x in ((1920, 1080), (100, 50), (1, 4000))] == [(256, 144), (100, 50), (1, 256)]
    p = noise(8, 1, 8, 8, 3)
    assert K.downscale(p, 8) is p
    got = K.downscale(p, 4).astype(int)
    want = (p.reshape(4, 2, 4, 2, 3).astype(int).sum(axis=(1, 3)) + 2) // 4
    assert (got[0] == want).all()
