"""Reconstruction kernels over whole arrays (tiles with halo, or planes), in float64.

`at(a, dy, dx)` is the neighbour, clamped to the array. A tile cut with a halo of at least RADIUS gives the plane's
results in its core. Red, green and blue come back untruncated.
"""

from __future__ import annotations

import numpy as np

EPS = 0.1 / 65025
#: How far a result depends on samples.
RADIUS = {"BICUBIC": 4, "RCD": 12, "DLMMSE_CODE": 12, "DLMMSE_PAPER": 12, "DLMMSE_RCD_CODE": 16, "DLMMSE_RCD_PAPER": 16}
#: The interpolating and the smoothing taps, and the high-pass of the gradients.
_HALFWAY = (-0.25, 0.5, 0.5, 0.5, -0.25)
_SMOOTH = (0.03125, 0.0703125, 0.1171875, 0.1796875, 0.203125, 0.1796875, 0.1171875, 0.0703125, 0.03125)
_HIGH = (1, -3, -1, 6, -1, -3, 1)


def at(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    h, w = a.shape
    return a[np.clip(np.arange(h) + dy, 0, h - 1)[:, None], np.clip(np.arange(w) + dx, 0, w - 1)[None, :]]


def place(shape: tuple[int, int], pattern: str, y0: int = 0, x0: int = 0) -> np.ndarray:
    """The channel letter of each pixel of an array whose first pixel is (y0, x0)."""
    y, x = (np.arange(n) + o for n, o in zip(shape, (y0, x0)))
    return np.array(list(pattern))[(x[None, :] % 2) + 2 * (y[:, None] % 2)]


def _along(a: np.ndarray, taps, vertical: bool) -> np.ndarray:
    half = len(taps) // 2
    return sum(t * at(a, *((k, 0) if vertical else (0, k))) for k, t in zip(range(-half, half + 1), taps))


def _farther(a: np.ndarray) -> np.ndarray:
    """The centre or the mean of the diagonals, whichever is farther from 0.5."""
    mean = (at(a, -1, -1) + at(a, -1, 1) + at(a, 1, -1) + at(a, 1, 1)) / 4
    return np.where(np.abs(0.5 - a) < np.abs(0.5 - mean), mean, a)


def _energy(s: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Squared high-pass along a direction, at the pixel and its two neighbours there."""
    return np.maximum(sum(sum(t * at(s, dy * (k + j), dx * (k + j)) for k, t in zip(range(-3, 4), _HIGH)) ** 2 for j in (-1, 0, 1)), EPS)


def xy_gradient(s: np.ndarray) -> np.ndarray:
    """Share of the vertical energy."""
    v, h = _energy(s, 1, 0), _energy(s, 0, 1)
    return v / (v + h)


def pq_gradient(s: np.ndarray, green: np.ndarray) -> np.ndarray:
    """Share of the falling diagonal's energy at red and blue, 0 at green."""
    p, q = _energy(s, 1, 1), _energy(s, 1, -1)
    return np.where(green, 0, p / (p + q))


def lowpass(s: np.ndarray, green: np.ndarray) -> np.ndarray:
    rows = at(s, 0, -1) + 2 * s + at(s, 0, 1)
    return np.where(green, 0, (at(rows, -1, 0) + 2 * rows + at(rows, 1, 0)) / 16)


def _blend(slope_a, slope_b, value_a, value_b):
    """The value from the side with the lower slope weighs more."""
    return (slope_b * value_a + slope_a * value_b) / (slope_a + slope_b)


def rcd_greens(s: np.ndarray, green: np.ndarray, xy: np.ndarray) -> np.ndarray:
    low = lowpass(s, green)

    def side(dy, dx):
        one = at(s, dy, dx)
        slope = EPS + np.abs(one - at(s, -dy, -dx)) + np.abs(s - at(s, 2 * dy, 2 * dx)) + np.abs(one - at(s, 3 * dy, 3 * dx)) + np.abs(at(s, 2 * dy, 2 * dx) - at(s, 4 * dy, 4 * dx))
        far = at(low, 2 * dy, 2 * dx)
        return slope, one * (1 + (low - far) / (EPS + low + far))

    (n, n_value), (so, s_value), (w, w_value), (e, e_value) = side(-1, 0), side(1, 0), side(0, -1), side(0, 1)
    part = _farther(xy)
    return np.where(green, s, part * _blend(w, e, w_value, e_value) + (1 - part) * _blend(n, so, n_value, s_value))


def rcd_opposite(s: np.ndarray, g: np.ndarray, pq: np.ndarray) -> np.ndarray:
    """The other of red and blue, at blue and red."""
    part = _farther(pq)

    def corner(dy, dx):
        one = at(s, dy, dx)
        slope = EPS + np.abs(one - at(s, -dy, -dx)) + np.abs(one - at(s, 3 * dy, 3 * dx)) + np.abs(g - at(g, 2 * dy, 2 * dx))
        return slope, one - at(g, dy, dx)

    (nw, nw_value), (se, se_value), (ne, ne_value), (sw, sw_value) = corner(-1, -1), corner(1, 1), corner(-1, 1), corner(1, -1)
    return g + (1 - part) * _blend(nw, se, nw_value, se_value) + part * _blend(ne, sw, ne_value, sw_value)


def rcd_at_green(c: np.ndarray, g: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """A colour that is known at red and blue, at green."""
    part = _farther(xy)

    def side(dy, dx):
        one = at(c, dy, dx)
        return EPS + np.abs(g - at(g, 2 * dy, 2 * dx)) + np.abs(one - at(c, -dy, -dx)) + np.abs(one - at(c, 3 * dy, 3 * dx)), one - at(g, dy, dx)

    (n, n_value), (so, s_value), (w, w_value), (e, e_value) = side(-1, 0), side(1, 0), side(0, -1), side(0, 1)
    return g + (1 - part) * _blend(n, so, n_value, s_value) + part * _blend(w, e, w_value, e_value)


def rcd_colours(s: np.ndarray, cfa: np.ndarray, g: np.ndarray, xy: np.ndarray, pq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Red and blue from greens: first at blue and red, then at green, each step from the one before alone."""
    other, out = rcd_opposite(s, g, pq), []
    for letter, opposite in (("R", "B"), ("B", "R")):
        c = np.where(cfa == letter, s, np.where(cfa == opposite, other, 0.0))
        out.append(np.where(cfa == "G", rcd_at_green(c, g, xy), c))
    return out[0], out[1]


def four_mean(a: np.ndarray, diagonal: bool) -> np.ndarray:
    """Mean of the four neighbours on the diagonals or on the axes."""
    return sum(at(a, *k) for k in (((-1, -1), (-1, 1), (1, -1), (1, 1)) if diagonal else ((-1, 0), (1, 0), (0, -1), (0, 1)))) / 4


def moments(f: np.ndarray, d: np.ndarray, vertical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the nine places from 4 before to 4 after: the sum of f, of its squares, and of the squares of f - d."""
    step = [(k, 0) if vertical else (0, k) for k in range(-4, 5)]
    return sum(at(f, *k) for k in step), sum(at(f, *k) ** 2 for k in step), sum((at(f, *k) - at(d, *k)) ** 2 for k in step)


def lmmse_greens(s: np.ndarray, green: np.ndarray, window_mean: bool) -> np.ndarray:
    """Directional least-squares estimates of green minus colour, each weighted by the other's error."""
    found = []
    for vertical in (False, True):
        d = np.where(green, 1, -1) * (s - _along(s, _HALFWAY, vertical))
        f = _along(d, _SMOOTH, vertical)
        total, squares, apart = moments(f, d, vertical)
        power, noise = squares / 8 - total**2 / 72, apart / 9 + EPS
        mean, gain = (total / 9 if window_mean else f), power / (power + noise)
        found.append((mean + gain * (d - mean), power - gain * power + EPS))
    (h, h_error), (v, v_error) = found
    return np.where(green, s, s + (v_error * h + h_error * v) / (h_error + v_error))


def _lmmse(s, cfa, window_mean):
    green = cfa == "G"
    g = lmmse_greens(s, green, window_mean)
    out = []
    for letter in "RB":
        gap = np.where(cfa == letter, g - s, 0.0)
        gap = np.where(green | (cfa == letter), gap, four_mean(gap, True))
        out.append(g - np.where(green, four_mean(gap, False), gap))
    return out[0], g, out[1]


def _rcd(s, cfa):
    green, xy = cfa == "G", xy_gradient(s)
    g = rcd_greens(s, green, xy)
    r, b = rcd_colours(s, cfa, g, xy, pq_gradient(s, green))
    return r, g, b


def _lmmse_rcd(s, cfa, window_mean):
    green = cfa == "G"
    g = lmmse_greens(s, green, window_mean)
    r, b = rcd_colours(s, cfa, g, xy_gradient(s), pq_gradient(s, green))
    return r, g, b


def _cubic(a, b, c, d):
    """Halfway between b and c."""
    return (-a + 5 * b + 5 * c - d) / 8


def _bicubic(s, cfa):
    green = cfa == "G"
    odd = (-3, -1, 1, 3)
    flat = _cubic(*(at(s, 0, k) for k in odd))
    tall = _cubic(*(at(s, k, 0) for k in odd))
    rows = np.trunc(flat)
    opposite = _cubic(*(at(rows, k, 0) for k in odd))
    # Four lines of falling steps (dx, dy) around the pixel.
    lines = (((-3, 0), (-2, -1), (-1, -2), (0, -3)), ((1, -2), (0, -1), (-1, 0), (-2, 1)), ((2, -1), (1, 0), (0, 1), (-1, 2)), ((3, 0), (2, 1), (1, 2), (0, 3)))
    middle = _cubic(*(np.trunc(_cubic(*(at(s, dy, dx) for dx, dy in line))) for line in lines))
    # A row's other colour lies across, the column's along.
    red_row = np.where(green, at((cfa == "R").astype(int), 0, 1) | at((cfa == "R").astype(int), 0, -1), 0) == 1
    r = np.where(cfa == "R", s, np.where(green, np.where(red_row, flat, tall), opposite))
    b = np.where(cfa == "B", s, np.where(green, np.where(red_row, tall, flat), opposite))
    return r, np.where(green, s, middle), b


KERNELS = {
    "BICUBIC": _bicubic,
    "RCD": _rcd,
    "DLMMSE_CODE": lambda s, cfa: _lmmse(s, cfa, False),
    "DLMMSE_PAPER": lambda s, cfa: _lmmse(s, cfa, True),
    "DLMMSE_RCD_CODE": lambda s, cfa: _lmmse_rcd(s, cfa, False),
    "DLMMSE_RCD_PAPER": lambda s, cfa: _lmmse_rcd(s, cfa, True),
}


def demosaic(s: np.ndarray, method: str, pattern: str, y0: int = 0, x0: int = 0) -> list[np.ndarray]:
    """Red, green, blue as 0..65535."""
    return [np.clip(c, 0, 65535).astype(np.int32) for c in KERNELS[method](s.astype(np.float64), place(s.shape, pattern, y0, x0))]


def gaussian(half: int = 5, sigma: float = 1.5) -> np.ndarray:
    t = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    return t / t.sum()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Structural similarity of each pixel of two arrays in 0..1."""
    taps, c1, c2 = gaussian(), 1e-4, 9e-4
    smooth = lambda v: _along(_along(v, taps, False), taps, True)
    ma, mb = smooth(a), smooth(b)
    va, vb, ab = smooth(a * a) - ma * ma, smooth(b * b) - mb * mb, smooth(a * b) - ma * mb
    return (2 * ma * mb + c1) * (2 * ab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
