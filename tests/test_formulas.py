"""Wide kernels, borders and matrices against plain loops over single pixels."""

import math

import numpy as np
import pytest

from tessera.functions import color, matrices
from tessera.operators import borders, kernels, tiles

EPS = 0.1 / 65025


class Plane:
    """A list of rows whose reads clamp to the border."""

    def __init__(self, rows):
        self.rows, self.h, self.w = [list(map(float, r)) for r in rows], len(rows), len(rows[0])

    def __call__(self, y, x):
        return self.rows[min(max(y, 0), self.h - 1)][min(max(x, 0), self.w - 1)]

    def map(self, f):
        return Plane([[f(y, x) for x in range(self.w)] for y in range(self.h)])


def letter(pattern, y, x):
    return pattern[x % 2 + 2 * (y % 2)]


def cubic(v0, v1, n0, n1):
    p = (n1 - n0) - (v0 - v1)
    return p / 8 + ((v0 - v1) - p) / 4 + (n0 - v0) / 2 + v1


def loop_bicubic(s, pattern):
    def at(y, x):
        c = letter(pattern, y, x)
        flat, tall = cubic(*(s(y, x + k) for k in (-3, -1, 1, 3))), cubic(*(s(y + k, x) for k in (-3, -1, 1, 3)))
        if c == "G":
            red_row = "R" in (letter(pattern, y, x + 1), letter(pattern, y, x - 1))
            return (flat, s(y, x), tall) if red_row else (tall, s(y, x), flat)
        other = cubic(*(int(cubic(*(s(min(max(y + j, 0), s.h - 1), x + k) for k in (-3, -1, 1, 3)))) for j in (-3, -1, 1, 3)))
        lines = [[(-3, 0), (-2, -1), (-1, -2), (0, -3)], [(1, -2), (0, -1), (-1, 0), (-2, 1)], [(2, -1), (1, 0), (0, 1), (-1, 2)], [(3, 0), (2, 1), (1, 2), (0, 3)]]
        green = cubic(*(int(cubic(*(s(y + dy, x + dx) for dx, dy in line))) for line in lines))
        return (s(y, x), green, other) if c == "R" else (other, green, s(y, x))

    return at


def gradients(s, pattern):
    high = [1, -3, -1, 6, -1, -3, 1]
    energy = lambda y, x, dy, dx: max(EPS, sum(sum(h * s(y + dy * (k + j), x + dx * (k + j)) for k, h in zip(range(-3, 4), high)) ** 2 for j in (-1, 0, 1)))
    xy = s.map(lambda y, x: energy(y, x, 1, 0) / (energy(y, x, 1, 0) + energy(y, x, 0, 1)))
    pq = s.map(lambda y, x: 0 if letter(pattern, y, x) == "G" else energy(y, x, 1, 1) / (energy(y, x, 1, 1) + energy(y, x, 1, -1)))
    return xy, pq


def farther(g, y, x):
    mean = (g(y - 1, x - 1) + g(y - 1, x + 1) + g(y + 1, x - 1) + g(y + 1, x + 1)) / 4
    return mean if abs(0.5 - g(y, x)) < abs(0.5 - mean) else g(y, x)


def loop_rcd_greens(s, pattern, xy):
    def low(y, x):
        y, x = min(max(y, 0), s.h - 1), min(max(x, 0), s.w - 1)
        if letter(pattern, y, x) == "G":
            return 0.0
        return s(y, x) / 4 + (s(y - 1, x) + s(y + 1, x) + s(y, x - 1) + s(y, x + 1)) / 8 + (s(y - 1, x - 1) + s(y - 1, x + 1) + s(y + 1, x - 1) + s(y + 1, x + 1)) / 16

    def green(y, x):
        if letter(pattern, y, x) == "G":
            return s(y, x)
        slope, guess = {}, {}
        for name, (dy, dx) in {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1)}.items():
            one, two, three, four = (s(y + k * dy, x + k * dx) for k in (1, 2, 3, 4))
            slope[name] = EPS + abs(one - s(y - dy, x - dx)) + abs(s(y, x) - two) + abs(one - three) + abs(two - four)
            far = low(y + 2 * dy, x + 2 * dx)
            guess[name] = one * (1 + (low(y, x) - far) / (EPS + low(y, x) + far))
        v = (slope["s"] * guess["n"] + slope["n"] * guess["s"]) / (slope["n"] + slope["s"])
        h = (slope["w"] * guess["e"] + slope["e"] * guess["w"]) / (slope["w"] + slope["e"])
        d = farther(xy, y, x)
        return d * h + (1 - d) * v

    return s.map(green)


def loop_colours(s, pattern, g, xy, pq):
    def opposite(y, x):
        def side(dy, dx):
            one = s(y + dy, x + dx)
            return EPS + abs(one - s(y - dy, x - dx)) + abs(one - s(y + 3 * dy, x + 3 * dx)) + abs(g(y, x) - g(y + 2 * dy, x + 2 * dx)), one - g(y + dy, x + dx)

        (a, av), (b, bv), (c, cv), (d, dv) = side(-1, -1), side(1, 1), side(-1, 1), side(1, -1)
        part = farther(pq, y, x)
        return g(y, x) + (1 - part) * (a * bv + b * av) / (a + b) + part * (c * dv + d * cv) / (c + d)

    known = {c: s.map(lambda y, x, c=c: 0.0 if letter(pattern, y, x) == "G" else s(y, x) if letter(pattern, y, x) == c else opposite(y, x)) for c in "RB"}

    def at_green(c, y, x):
        def side(dy, dx):
            one = c(y + dy, x + dx)
            return EPS + abs(g(y, x) - g(y + 2 * dy, x + 2 * dx)) + abs(one - c(y - dy, x - dx)) + abs(one - c(y + 3 * dy, x + 3 * dx)), one - g(y + dy, x + dx)

        (n, nv), (so, sv), (w, wv), (e, ev) = side(-1, 0), side(1, 0), side(0, -1), side(0, 1)
        part = farther(xy, y, x)
        return g(y, x) + (1 - part) * (n * sv + so * nv) / (n + so) + part * (w * ev + e * wv) / (w + e)

    return {c: known[c].map(lambda y, x, c=c: at_green(known[c], y, x) if letter(pattern, y, x) == "G" else known[c](y, x)) for c in "RB"}


HALF = [-0.25, 0.5, 0.5, 0.5, -0.25]
SMOOTH = [0.03125, 0.0703125, 0.1171875, 0.1796875, 0.203125, 0.1796875, 0.1171875, 0.0703125, 0.03125]


def loop_lmmse_greens(s, pattern, window_mean):
    est = []
    for dy, dx in ((0, 1), (1, 0)):
        d = s.map(lambda y, x: (1 if letter(pattern, y, x) == "G" else -1) * (s(y, x) - sum(t * s(y + k * dy, x + k * dx) for k, t in zip(range(-2, 3), HALF))))
        f = d.map(lambda y, x: sum(t * d(y + k * dy, x + k * dx) for k, t in zip(range(-4, 5), SMOOTH)))

        def one(y, x, d=d, f=f, dy=dy, dx=dx):
            fs, ds = ([q(y + k * dy, x + k * dx) for k in range(-4, 5)] for q in (f, d))
            mean = sum(fs) / 9 if window_mean else f(y, x)
            p, r = sum(v * v for v in fs) / 8 - sum(fs) ** 2 / 72, sum((a - b) ** 2 for a, b in zip(fs, ds)) / 9 + EPS
            return mean + p / (p + r) * (d(y, x) - mean), p - p / (p + r) * p + EPS

        est.append(one)

    def green(y, x):
        if letter(pattern, y, x) == "G":
            return s(y, x)
        (h, eh), (v, ev) = est[0](y, x), est[1](y, x)
        return s(y, x) + (ev * h + eh * v) / (eh + ev)

    return s.map(green)


def loop_lmmse(s, pattern, window_mean):
    g = loop_lmmse_greens(s, pattern, window_mean)
    out = {}
    for c, o in (("R", "B"), ("B", "R")):
        gap = s.map(lambda y, x, c=c: g(y, x) - s(y, x) if letter(pattern, y, x) == c else 0.0)
        gap2 = s.map(lambda y, x, gap=gap, o=o: (gap(y - 1, x - 1) + gap(y - 1, x + 1) + gap(y + 1, x - 1) + gap(y + 1, x + 1)) / 4 if letter(pattern, y, x) == o else gap(y, x))
        gap3 = s.map(lambda y, x, q=gap2: (q(y - 1, x) + q(y + 1, x) + q(y, x - 1) + q(y, x + 1)) / 4 if letter(pattern, y, x) == "G" else q(y, x))
        out[c] = s.map(lambda y, x, q=gap3: g(y, x) - q(y, x))
    return out["R"], g, out["B"]


@pytest.mark.parametrize("shape", [(9, 7), (20, 18)])
@pytest.mark.parametrize("pattern", ["RGGB", "GBRG"])
def test_wide_kernels(shape, pattern):
    rows = np.random.default_rng(shape[0]).integers(0, 65536, shape)
    s, cfa = Plane(rows.tolist()), kernels.place(shape, pattern)
    as_array = lambda p: np.array(p.rows)
    xy, pq = gradients(s, pattern)
    assert np.allclose(kernels.xy_gradient(rows.astype(float)), as_array(xy)) and np.allclose(kernels.pq_gradient(rows.astype(float), cfa == "G"), as_array(pq))
    want = {}
    g = loop_rcd_greens(s, pattern, xy)
    c = loop_colours(s, pattern, g, xy, pq)
    want["RCD"] = [as_array(c["R"]), as_array(g), as_array(c["B"])]
    for mode, mean in (("CODE", False), ("PAPER", True)):
        want[f"DLMMSE_{mode}"] = [as_array(p) for p in loop_lmmse(s, pattern, mean)]
        g = loop_lmmse_greens(s, pattern, mean)
        c = loop_colours(s, pattern, g, xy, pq)
        want[f"DLMMSE_RCD_{mode}"] = [as_array(c["R"]), as_array(g), as_array(c["B"])]
    cells = [[loop_bicubic(s, pattern)(y, x) for x in range(s.w)] for y in range(s.h)]
    want["BICUBIC"] = list(np.moveaxis(np.array(cells), 2, 0))
    for method, planes in want.items():
        got = kernels.KERNELS[method](rows.astype(float), cfa)
        for a, b in zip(got, planes):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-5), method


def test_similarity_by_loops():
    rng = np.random.default_rng(4)
    a, b = rng.random((12, 11)), rng.random((12, 11))
    taps = [math.exp(-(r * r) / 4.5) for r in range(-5, 6)]
    pa, pb = Plane(a.tolist()), Plane(b.tolist())
    for y, x in ((0, 0), (5, 5), (11, 3)):
        m = [0.0] * 5
        for j in range(-5, 6):
            for k in range(-5, 6):
                w, u, v = taps[j + 5] * taps[k + 5] / sum(taps) ** 2, pa(y + j, x + k), pb(y + j, x + k)
                m = [t + w * q for t, q in zip(m, (u, v, u * u, v * v, u * v))]
        ssim = (2 * m[0] * m[1] + 1e-4) * (2 * (m[4] - m[0] * m[1]) + 9e-4) / ((m[0] ** 2 + m[1] ** 2 + 1e-4) * (m[2] - m[0] ** 2 + m[3] - m[1] ** 2 + 9e-4))
        assert np.isclose(kernels.similarity(a, b)[y, x], ssim)


def step_by_step(a, n, name):
    """An extension by walking back into the row, one mirror at a time."""
    size, offset = len(a), 0.0
    if name == "zpd":
        return a[n] if 0 <= n < size else 0
    if name == "const":
        return a[min(max(n, 0), size - 1)]
    if name == "linear":
        return a[0] + n * (a[1] - a[0]) if n < 0 else a[-1] + (n - size + 1) * (a[-1] - a[-2]) if n >= size else a[n]
    while not 0 <= n < size:
        if name == "periodic":
            n += size if n < 0 else -size
        elif name == "symh":
            n = -1 - n if n < 0 else 2 * size - 1 - n
        elif name == "symw":
            n = -n if n < 0 else 2 * (size - 1) - n
        elif name == "asymw":  # a point mirror at the end sample
            offset, n, sign = (offset + 2 * a[0], -n, -1) if n < 0 else (offset + 2 * a[-1], 2 * (size - 1) - n, -1)
            return offset + sign * step_by_step(a, n, name)
        else:  # a point mirror half a step past the end, where the row goes on straight
            edge, n = (3 * a[0] - a[1], -1 - n) if n < 0 else (3 * a[-1] - a[-2], 2 * size - 1 - n)
            return edge - step_by_step(a, n, name)
    return a[n]


@pytest.mark.parametrize("name", borders.EXTENSIONS)
def test_extensions(name):
    a = np.random.default_rng(2).random(5)
    at = np.arange(-17, 23)
    assert np.allclose(borders.extended(a, at, name), [step_by_step(a.tolist(), int(n), name) for n in at])
    taps, delay = [0.5, 2.0, -1.0], 1
    got = borders.sampled(a, taps, delay, name, 1, 2, 9)
    assert np.allclose(got, [sum(t * step_by_step(a.tolist(), n - delay - k, name) for k, t in enumerate(taps)) for n in range(1, 10, 2)])


def test_border_methods():
    rows = np.random.default_rng(6).integers(0, 256, (10, 9)).astype(float)
    for pattern in ("RGGB", "GBRG"):
        cfa = kernels.place(rows.shape, pattern)
        for mean in (False, True):  # the methods differ at borders alone
            inner = [p[6:-6, 6:-6] for p in borders.least_squares(np.pad(rows, 10, mode="reflect"), kernels.place((30, 29), pattern), mean)]
            clamped = [p[6:-6, 6:-6] for p in kernels._lmmse(np.pad(rows, 10, mode="reflect"), kernels.place((30, 29), pattern), mean)]
            assert all(np.allclose(a[6:-6, 6:-6], b[6:-6, 6:-6]) for a, b in zip(inner, clamped))
        r, g, b = borders.bilinear(rows, cfa)
        known = np.where(cfa == "R", r, np.where(cfa == "B", b, g))
        assert (known == rows).all()
        gap = np.where(cfa == "G", 0, rows)
        dr, db = borders.bilinear_differences(g, gap, cfa)
        assert np.allclose(dr[cfa == "R"], (g + rows)[cfa == "R"]) and np.allclose(db[cfa == "B"], (g + rows)[cfa == "B"])
    image = np.random.default_rng(7).integers(0, 256, (5, 7, 3))
    cfa = kernels.place((2, 2), "RGGB")
    flat, apart = borders.mosaicked(image, cfa, pad=2, even=True), borders.mosaicked(image, cfa, flatten=False)
    assert flat.shape == (10, 12) and (flat[2:7, 2:9] == apart.sum(2)).all() and flat[0, 0] == image[2, 2, 0] and (apart[0, 0] == [image[0, 0, 0], 0, 0]).all()


def test_ragged_planes(spark):
    """The last row may be short: no pixels are made up, and neighbours below the short part are the last there are."""
    s = np.random.default_rng(1).integers(0, 65536, (6, 10))
    rows = [(k, y, x, int(s[y, x])) for k in (0, 1) for y in range(6) for x in range(10) if y < 5 or x < 9 - k]
    df = spark.createDataFrame(rows, "image_id int, y int, x int, s int")
    for name in ("lowpass", "averages"):
        got = tiles.stage(df, name).collect()
        assert len(got) == len(rows) and {(r.image_id, r.y, r.x) for r in got} == {r[:3] for r in rows}
    with pytest.raises(Exception, match="holes"):
        tiles.stage(df.filter("y <> 2 OR x <> 3"), "lowpass").collect()


def test_camera_matrices():
    m1 = [1.0234, -0.2969, -0.0664, -0.4478, 1.2148, 0.2661, -0.0617, 0.1434, 0.6812]
    one, t = matrices.camera_to_xyz(matrices.ColorTags(color1=m1, white_xy=(0.3457, 0.3585)))
    # White balanced camera white is white: the rows of the way back sum to 1.
    assert np.allclose(np.linalg.inv(one).sum(1), 1) and abs(t - 5000) < 30
    forward, _ = matrices.camera_to_xyz(matrices.ColorTags(color1=m1, forward1=[0.7, 0.15, 0.11, 0.3, 0.68, 0.02, 0.03, 0.06, 0.73], neutral=[0.5, 1, 0.7]))
    assert np.allclose(np.linalg.inv(forward).sum(1), 1)
    warm = matrices.ColorTags(color1=m1, color2=[v * 2 for v in m1], white_xy=(0.40, 0.39), cct1=2856, cct2=6504)
    x, y = warm.white_xy
    n = (x - 0.3320) / (0.1858 - y)
    t = 437 * n**3 + 3601 * n**2 + 6861 * n + 5517
    w = (1 / t - 1 / 6504) / (1 / 2856 - 1 / 6504)
    assert 0 < w < 1 and np.isclose(matrices._weight(t, 2856, 6504), w) and matrices._weight(2000, 2856, 6504) == 1 and matrices._weight(9000, 2856, 6504) == 0
    assert np.allclose(np.array(color.bradford((0.9642, 1.0, 0.8251))), np.eye(3)) and np.allclose(np.array(color.to_srgb()).sum(1), 1)
    four = matrices.camera_to_xyz(matrices.ColorTags(color1=[*m1, 0.4, 0.5, 0.1], analog=[1, 1, 1, 1], white_xy=(0.3457, 0.3585)))[0]
    assert four.shape == (3, 4)
    with pytest.raises(ValueError):
        matrices.camera_to_xyz(matrices.ColorTags(color1=m1))
