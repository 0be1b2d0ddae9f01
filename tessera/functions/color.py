"""Colour formulas over columns r, g, b in 0..1 (or named otherwise), as SQL text."""

from __future__ import annotations

#: Linear sRGB to XYZ (D50), the Bradford cone matrix, XYZ (D50) to RIMM and back before their rows are made to sum to 1, white D50.
SRGB_TO_XYZ = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
XYZ_TO_RIMM = ((1.3460, -0.2556, -0.0511), (-0.5446, 1.5082, 0.0205), (0.0, 0.0, 1.2123))
RIMM_TO_XYZ = ((0.7977, 0.1352, 0.0313), (0.2880, 0.7119, 0.0001), (0.0, 0.0, 0.8249))
D50 = (0.9642, 1.0, 0.8251)


def matrix(m, names=("r", "g", "b")) -> list[str]:
    """Three linear combinations; the terms are added in order."""
    return ["(" + " + ".join(f"CAST({k!r} AS DOUBLE) * {n}" for k, n in zip(row, names)) + ")" for row in m]


def row_normalised(m):
    """Rows that sum to 1."""
    return tuple(tuple(v / sum(row) for v in row) for row in m)


def inverse(m):
    import numpy as np

    return tuple(tuple(float(v) for v in row) for row in np.linalg.inv(np.array(m, float)))


def to_srgb():
    """XYZ (D50) to linear sRGB: white goes to white."""
    return row_normalised(inverse(SRGB_TO_XYZ))


def bradford(white_from, white_to=D50):
    """Adaptation between two whites given as X, Y, Z."""
    import numpy as np

    cone = np.array(BRADFORD)
    gain = (cone @ np.array(white_to, float)) / (cone @ np.array(white_from, float))
    return tuple(tuple(float(v) for v in row) for row in np.linalg.inv(cone) @ np.diag(gain) @ cone)


def exposure(v: str, ev: str) -> str:
    return f"({v} * pow(CAST(2 AS DOUBLE), coalesce({ev}, 0)))"


def srgb_gamma(v: str) -> str:
    c = f"least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), {v}))"
    return f"(CASE WHEN {c} < 0.0031308 THEN CAST(12.92 AS DOUBLE) * {c} ELSE CAST(1.055 AS DOUBLE) * pow({c}, CAST(1 AS DOUBLE) / 2.4) - CAST(0.055 AS DOUBLE) END)"


def cct(x: str, y: str) -> str:
    """Correlated colour temperature of a chromaticity."""
    n = f"(({x} - CAST(0.3320 AS DOUBLE)) / (CAST(0.1858 AS DOUBLE) - {y}))"
    return f"(437 * {n} * {n} * {n} + 3601 * {n} * {n} + 6861 * {n} + 5517)"


def hsv(r="r", g="g", b="b") -> tuple[str, str, str]:
    """Hue 0..360, saturation, value."""
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    d = f"({top} - {low})"
    h = f"(CASE WHEN {d} = 0 THEN CAST(0 AS DOUBLE) WHEN {top} = {r} THEN 60 * (({g} - {b}) / {d}) WHEN {top} = {g} THEN 60 * (2 + ({b} - {r}) / {d}) ELSE 60 * (4 + ({r} - {g}) / {d}) END)"
    return f"(CASE WHEN {h} < 0 THEN {h} + 360 ELSE {h} END)", f"(CASE WHEN {top} = 0 THEN CAST(0 AS DOUBLE) ELSE {d} / {top} END)", top


def rgb(h="h", s="s", v="v") -> tuple[str, str, str]:
    """Back from hue, saturation, value; a hue of 360 is 0."""
    sector = f"(CAST(floor({h} / 60) AS INT) % 6)"
    f = f"({h} / 60 - floor({h} / 60))"
    p, q, t = f"({v} * (1 - {s}))", f"({v} * (1 - {s} * {f}))", f"({v} * (1 - {s} * (1 - {f})))"
    pick = lambda *six: "(CASE " + sector + " " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(six)) + " END)"
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def natural_spline(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float, float]]:
    """Segments (from, to, a, b, c, d) of the natural cubic spline a + b t + c t^2 + d t^3, t from the segment's start."""
    import numpy as np

    x, y = (np.array(v, float) for v in zip(*knots))
    n, h = len(x), np.diff(x)
    if n < 3:
        return [(float(x[i]), float(x[i + 1]), float(y[i]), float((y[i + 1] - y[i]) / h[i]), 0.0, 0.0) for i in range(n - 1)]
    a = np.zeros((n, n))
    rhs = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 3 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    c = np.linalg.solve(a, rhs)
    return [(float(x[i]), float(x[i + 1]), float(y[i]), float((y[i + 1] - y[i]) / h[i] - h[i] * (2 * c[i] + c[i + 1]) / 3), float(c[i]), float((c[i + 1] - c[i]) / (3 * h[i]))) for i in range(n - 1)]


def tone_curve(v: str, knots: list[tuple[float, float]]) -> str:
    """The spline over the knots; values beyond them are clamped first."""
    k = lambda x: f"CAST({x!r} AS DOUBLE)"
    segments = natural_spline(knots)
    u = f"least({k(segments[-1][1])}, greatest({k(segments[0][0])}, {v}))"
    arms = [f"({k(a)} + ({u} - {k(x)}) * ({k(b)} + ({u} - {k(x)}) * ({k(c)} + ({u} - {k(x)}) * {k(d)})))" for x, _, a, b, c, d in segments]
    return "(CASE " + " ".join(f"WHEN {u} <= {k(s[1])} THEN {arm}" for s, arm in zip(segments, arms)) + " END)"


def hue_table(h: str, s: str, v: str, divisions: tuple[int, int], table: list[tuple[float, float, float]], get) -> tuple[str, str, str]:
    """Hue, saturation and value after a table of (hue shift, saturation scale, value scale), linear between two hue rows.

    `get(channel, index)` is SQL text for an entry. Hue rows wrap by their number less one, and saturation picks a
    row without interpolation, as the results to match do.
    """
    n_hue, n_sat = divisions
    at = f"({h} * {n_hue} / CAST(360 AS DOUBLE))"
    i = f"least(CAST(floor({at}) AS INT), {n_hue - 1})"
    j = f"(({i} + 1) % {max(1, n_hue - 1)})"
    k = f"least(CAST(floor({s} * {n_sat - 1}) AS INT), {max(0, n_sat - 2)})"
    part = f"({at} - {i})"
    mix = lambda c: f"({get(c, f'({i} * {n_sat} + {k})')} * (1 - {part}) + {get(c, f'({j} * {n_sat} + {k})')} * {part})"
    turned = f"({h} + {mix(0)})"
    hue = f"(CASE WHEN {turned} < 0 THEN {turned} + 360 WHEN {turned} >= 360 THEN {turned} - 360 ELSE {turned} END)"
    return hue, f"least({s} * {mix(1)}, CAST(1 AS DOUBLE))", f"least({v} * {mix(2)}, CAST(1 AS DOUBLE))"


def projected(source: str, expressions: list[str], names: str, keep: str = "image_id, y, x") -> str:
    """SELECT of the kept columns and the named expressions from a source query."""
    return f"SELECT {keep}, {', '.join(f'{e} AS {n}' for e, n in zip(expressions, names))} FROM ({source}) AS p_"


def hue_chain(source: str, divisions: tuple[int, int], table: list[tuple[float, float, float]], get) -> str:
    """X, Y, Z (columns r, g, b) through RIMM, hue, saturation and value, a table of these, and back; one projection a step."""
    rimm = projected(source, matrix(row_normalised(XYZ_TO_RIMM)), "rgb")
    turned = projected(projected(rimm, list(hsv()), "hsv"), list(hue_table("h", "s", "v", divisions, table, get)), "hsv")
    return projected(projected(turned, list(rgb()), "rgb"), matrix(row_normalised(RIMM_TO_XYZ)), "rgb")
