"""Filters with named border extensions, and the reconstructions of the accuracy tools that use them, over whole arrays.

An extension says what a row is past its ends; all eight give values at any distance. Array ends must be image ends or lie
a filter's reach away from what is used.
"""

from __future__ import annotations

import numpy as np

from .kernels import _HALFWAY, _SMOOTH, EPS

#: Names that mean the same.
ALIASES = {"zero": "zpd", "sp0": "const", "sp1": "linear", "per": "periodic", "sym": "symh", "hsym": "symh", "wsym": "symw", "asym": "asymh", "hasym": "asymh", "wasym": "asymw"}
EXTENSIONS = ("zpd", "const", "linear", "periodic", "symh", "symw", "asymh", "asymw")


def extended(a: np.ndarray, at: np.ndarray, name: str) -> np.ndarray:
    """Values of the last axis at any integer places."""
    name, n = ALIASES.get(name, name), a.shape[-1]
    if name not in EXTENSIONS:
        raise ValueError(f"no border extension {name}")
    inside = a[..., np.clip(at, 0, n - 1)]
    if name == "zpd":
        return np.where((at >= 0) & (at < n), inside, 0)
    if name == "const" or n == 1:
        return inside
    if name == "linear":
        low, high = a[..., :1] + at * (a[..., 1:2] - a[..., :1]), a[..., -1:] + (n - 1 - at) * (a[..., -2:-1] - a[..., -1:])
        return np.where(at < 0, low, np.where(at >= n, high, inside))
    if name == "periodic":
        return a[..., at % n]
    if name == "symh":
        m = at % (2 * n)
        return a[..., np.where(m < n, m, 2 * n - 1 - m)]
    if name == "symw":
        m = at % (2 * n - 2)
        return a[..., np.where(m < n, m, 2 * n - 2 - m)]
    # Mirrored in value too: each turn of the mirror adds a constant jump.
    half = name == "asymh"
    span = 2 * n if half else 2 * n - 2
    turns = (at + n - (not half)) // span
    m = at - turns * span
    first, second, last = a[..., :1], a[..., 1:2], a[..., -1:]
    if half:
        jump, mirrored = 3 * (last - first) - (a[..., -2:-1] - second), 3 * first - second - a[..., np.clip(-1 - m, 0, n - 1)]
    else:
        jump, mirrored = 2 * (last - first), 2 * first - a[..., np.clip(-m, 0, n - 1)]
    return np.where(m < 0, mirrored, a[..., np.clip(m, 0, n - 1)]) + turns * jump


def sampled(a: np.ndarray, taps, delay: int, border: str, start: int = 0, step: int = 1, end: int | None = None) -> np.ndarray:
    """Along the last axis: the sum of taps[k] times the value at n - delay - k, for n from start to end by step."""
    at = np.arange(start, (a.shape[-1] - 1 if end is None else end) + 1, step)
    return sum(t * extended(a, at - delay - k, border) for k, t in enumerate(taps))


def centred(a: np.ndarray, taps, border: str, vertical: bool = False) -> np.ndarray:
    out = sampled(a.T if vertical else a, taps, -(len(taps) // 2), border)
    return out.T if vertical else out


def separable(a: np.ndarray, across, down, border: str) -> np.ndarray:
    """Filtered along rows, then along columns."""
    return centred(centred(a, across, border), down, border, vertical=True)


def _available(a: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Mean of those of the neighbours that the array has."""
    h, w = a.shape
    total, n = np.zeros((h, w)), np.zeros((h, w))
    for dy, dx in steps:
        ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
        total[ys, xs] += a[ys.start + dy : ys.stop + dy, xs.start + dx : xs.stop + dx]
        n[ys, xs] += 1
    return total / np.maximum(n, 1)


_ROW, _COLUMN, _DIAGONAL = [(0, -1), (0, 1)], [(-1, 0), (1, 0)], [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def _red_rows(cfa: np.ndarray) -> np.ndarray:
    return (cfa == "R").any(1)[:, None] | np.zeros(cfa.shape, bool)


def bilinear(s: np.ndarray, cfa: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of the available neighbours: fewer at the borders."""
    row, column, cross, diagonal = (_available(s, steps) for steps in (_ROW, _COLUMN, _ROW + _COLUMN, _DIAGONAL))
    red_row, green = _red_rows(cfa), cfa == "G"
    r = np.where(cfa == "R", s, np.where(green, np.where(red_row, row, column), diagonal))
    b = np.where(cfa == "B", s, np.where(green, np.where(red_row, column, row), diagonal))
    return r, np.where(green, s, cross), b


def bilinear_differences(g: np.ndarray, d: np.ndarray, cfa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Red and blue from greens and colour differences that are known at red and blue."""
    row, column, diagonal = (_available(d, steps) for steps in (_ROW, _COLUMN, _DIAGONAL))
    red_row, green = _red_rows(cfa), cfa == "G"
    r = np.where(cfa == "R", d, np.where(green, np.where(red_row, row, column), diagonal))
    b = np.where(cfa == "B", d, np.where(green, np.where(red_row, column, row), diagonal))
    return g + r, g + b


def least_squares(s: np.ndarray, cfa: np.ndarray, window_mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directional least-squares greens with filters mirrored at the border (whole-sample) and moments over what there is of the window."""
    green, found = cfa == "G", []
    for vertical in (False, True):
        d = np.where(green, 1, -1) * (s - centred(s, _HALFWAY, "symw", vertical))
        f = centred(d, _SMOOTH, "symw", vertical)
        window = lambda v, down=vertical: centred(v, [1.0] * 9, "zpd", down)
        total, noise = window(f), window((f - d) ** 2) / 9 + EPS
        power = window(f * f) / 8 - total**2 / 72
        mean, gain = (total / 9 if window_mean else f), power / (power + noise)
        found.append((mean + gain * (d - mean), power - gain * power + EPS))
    (h, h_error), (v, v_error) = found
    g = np.where(green, s, s + (v_error * h + h_error * v) / (h_error + v_error))
    out = []
    for letter, opposite in (("R", "B"), ("B", "R")):
        gap = np.where(cfa == letter, g - s, 0.0)
        corners = separable(gap, [0.5, 0, 0.5], [0.5, 0, 0.5], "symw")
        gap = np.where(cfa == opposite, corners, gap)
        axes = (centred(gap, [0.5, 0, 0.5], "symw") + centred(gap, [0.5, 0, 0.5], "symw", True)) / 2
        out.append(g - np.where(green, axes, gap))
    return out[0], g, out[1]


def mosaicked(image: np.ndarray, cfa: np.ndarray, flatten: bool = True, pad: int = 0, even: bool = False) -> np.ndarray:
    """The mosaic of height x width x 3: flattened to one plane or with the other channels 0; with a mirrored border of `pad`, and one more row or column where a size is odd, if asked for."""
    h, w, _ = image.shape
    ys, xs = (np.arange(-pad, n + pad + (even and (n + 2 * pad) % 2)) for n in (h, w))
    full = np.stack([extended(extended(image[:, :, c].T, ys, "symw").T, xs, "symw") for c in range(3)], 2)
    letters = cfa[ys[:, None] % 2, xs[None, :] % 2]
    own = np.stack([letters == c for c in "RGB"], 2)
    return (full * own).sum(2) if flatten else full * own
