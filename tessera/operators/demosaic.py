"""Mosaic reconstruction in long form: rows (image_id, y, x, s) to rows (image_id, y, x, r, g, b).

Each method is one pass or two; a pass names the neighbours that it reads and gives formulas for the four places of the
pattern: red, green in a red row, green in a blue row, blue. Formulas are SQL text over s and s_<neighbour>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.dialect import SPARK, Dialect
from ..sources.planes import CFA, by_pattern
from .stencil import neighbours, neighbours_sql

FOUR, CORNERS, FAR = ["n", "s", "w", "e"], ["nw", "ne", "sw", "se"], ["n2", "s2", "w2", "e2"]


def sites(pattern: str) -> list[str]:
    """R, Gr, Gb or B at each place of the pattern."""
    p = CFA[pattern]
    return [c if c != "G" else ("Gr" if p[k ^ 1] == "R" else "Gb") for k, c in enumerate(p)]


def at_sites(pattern: str, formulas: dict[str, str]) -> str:
    return by_pattern([formulas[s] for s in sites(pattern)])


def _sum(names: list[str], column: str = "s") -> str:
    return "(" + " + ".join(f"{column}_{n}" for n in names) + ")"


def _none(d: Dialect):
    return [], {}, {"r": {"R": "s", "Gr": "0", "Gb": "0", "B": "0"}, "g": {"R": "0", "Gr": "s", "Gb": "s", "B": "0"}, "b": {"R": "0", "Gr": "0", "Gb": "0", "B": "s"}}


def _nearest(d: Dialect):
    return ["e", "s", "se"], {}, {
        "r": {"R": "s", "Gr": "s_e", "Gb": "s_s", "B": "s_se"}, "g": {"R": "s_e", "Gr": "s", "Gb": "s", "B": "s_e"}, "b": {"R": "s_se", "Gr": "s_s", "Gb": "s_e", "B": "s"},
    }


def _mean(d: Dialect):
    flat, tall = d.div("s_w + s_e", "2"), d.div("s_n + s_s", "2")
    cross, diagonal = d.div(_sum(FOUR), "4"), d.div(_sum(CORNERS), "4")
    return FOUR + CORNERS, {}, {"r": {"R": "s", "Gr": flat, "Gb": tall, "B": diagonal}, "g": {"R": cross, "Gr": "s", "Gb": "s", "B": cross}, "b": {"R": diagonal, "Gr": tall, "Gb": flat, "B": "s"}}


def _median(d: Dialect):
    names, extra, out = _mean(d)
    middle = lambda n: d.div(f"{_sum(n)} - greatest({', '.join(f's_{x}' for x in n)}) - least({', '.join(f's_{x}' for x in n)})", "2")
    for channel, site in (("g", "R"), ("g", "B")):
        out[channel][site] = middle(FOUR)
    out["b"]["R"] = out["r"]["B"] = middle(CORNERS)
    return names, extra, out


def _linear(d: Dialect):
    green = d.div(f"4 * s + 2 * {_sum(FOUR)} - {_sum(FAR)}", "8")
    flat = d.div(f"10 * s + 8 * (s_w + s_e) - 2 * (s_w2 + s_e2) - 2 * {_sum(CORNERS)} + s_n2 + s_s2", "16")
    tall = d.div(f"10 * s + 8 * (s_n + s_s) - 2 * (s_n2 + s_s2) - 2 * {_sum(CORNERS)} + s_w2 + s_e2", "16")
    other = d.div(f"12 * s + 4 * {_sum(CORNERS)} - 3 * {_sum(FAR)}", "16")
    return FOUR + CORNERS + FAR, {}, {"r": {"R": "s", "Gr": flat, "Gb": tall, "B": other}, "g": {"R": green, "Gr": "s", "Gb": "s", "B": green}, "b": {"R": other, "Gr": tall, "Gb": flat, "B": "s"}}


def _edge_directed(d: Dialect):
    across = "(abs(s_w2 - 2 * s + s_e2) + abs(s_w - s_e))"
    along = "(abs(s_n2 - 2 * s + s_s2) + abs(s_n - s_s))"
    both, flat, tall = f"(4 * s + 2 * {_sum(FOUR)} - {_sum(FAR)}) / CAST(8 AS DOUBLE)", "(2 * (s_w + s + s_e) - s_w2 - s_e2) / CAST(4 AS DOUBLE)", "(2 * (s_n + s + s_s) - s_n2 - s_s2) / CAST(4 AS DOUBLE)"
    green = d.int(f"CASE WHEN {across} = {along} THEN {both} WHEN {across} < {along} THEN {flat} ELSE {tall} END")
    first = {"R": green, "Gr": "s", "Gb": "s", "B": green}
    flat, tall, diagonal = "s + (k_w + k_e) / CAST(2 AS DOUBLE)", "s + (k_n + k_s) / CAST(2 AS DOUBLE)", "g + (k_nw + k_ne + k_sw + k_se) / CAST(4 AS DOUBLE)"
    second = {"r": {"R": "s", "Gr": flat, "Gb": tall, "B": diagonal}, "g": dict.fromkeys(("R", "Gr", "Gb", "B"), "g"), "b": {"R": diagonal, "Gr": tall, "Gb": flat, "B": "s"}}
    return FOUR + FAR, {"first": first, "then": {"k": FOUR + CORNERS}}, second


def _grouped(d: Dialect):
    slope = {a: f"(2 * abs(s - s_{a}2) + abs(s_{a} - s_{b}))" for a, b in (("n", "s"), ("e", "w"), ("w", "e"), ("s", "n"))}
    guess = {a: f"(s_{b} + s + 3 * s_{a} - s_{a}2) / CAST(4 AS DOUBLE)" for a, b in (("n", "s"), ("e", "w"), ("w", "e"), ("s", "n"))}
    least = f"least({', '.join(slope.values())})"
    green = "CASE " + " ".join(f"WHEN {slope[a]} = {least} THEN {guess[a]}" for a in "news") + " END"
    first = {"R": green, "Gr": "CAST(s AS DOUBLE)", "Gb": "CAST(s AS DOUBLE)", "B": green}

    def transit(l1: str, l2: str, l3: str, v1: str, v3: str) -> str:
        return f"(CASE WHEN ({l1} < {l2} AND {l2} < {l3}) OR ({l1} > {l2} AND {l2} > {l3}) THEN {v1} + ({v3} - {v1}) * ({l2} - {l1}) / ({l3} - {l1}) ELSE ({v1} + {v3}) / CAST(2 AS DOUBLE) + ({l2} * 2 - {l1} - {l3}) / CAST(4 AS DOUBLE) END)"

    flat, tall = transit("g_w", "g", "g_e", "s_w", "s_e"), transit("g_n", "g", "g_s", "s_n", "s_s")
    falling = "(abs(s_nw - s_se) + abs(s_nw2 - s) + abs(s - s_se2) + abs(g_nw - g) + abs(g - g_se))"
    rising = "(abs(s_ne - s_sw) + abs(s_ne2 - s) + abs(s - s_sw2) + abs(g_ne - g) + abs(g - g_sw))"
    diagonal = f"CASE WHEN {falling} < {rising} THEN {transit('g_nw', 'g', 'g_se', 's_nw', 's_se')} ELSE {transit('g_ne', 'g', 'g_sw', 's_ne', 's_sw')} END"
    second = {"r": {"R": "s", "Gr": flat, "Gb": tall, "B": diagonal}, "g": dict.fromkeys(("R", "Gr", "Gb", "B"), "g"), "b": {"R": diagonal, "Gr": tall, "Gb": flat, "B": "s"}}
    return FOUR + FAR + CORNERS + ["nw2", "ne2", "sw2", "se2"], {"first": first, "then": {"g": FOUR + CORNERS}}, second


METHODS = {"NONE": _none, "NEAREST_NEIGHBOR": _nearest, "BILINEAR_MEAN": _mean, "BILINEAR_MEDIAN": _median, "MALVAR_HE_CUTLER": _linear, "HAMILTON_ADAMS": _edge_directed, "PPG": _grouped}
#: Pixels at the border that metrics leave out, by method.
MARGIN = {
    "NONE": 0, "NEAREST_NEIGHBOR": 2, "BILINEAR_MEAN": 2, "BILINEAR_MEDIAN": 2, "BICUBIC": 4, "MALVAR_HE_CUTLER": 2, "HAMILTON_ADAMS": 4, "PPG": 4,
    "RCD": 10, "DLMMSE_CODE": 12, "DLMMSE_PAPER": 12, "DLMMSE_RCD_CODE": 14, "DLMMSE_RCD_PAPER": 14,
}


def _steps(method: str, pattern: str, d: Dialect):
    names, extra, out = METHODS[method](d)
    final = ["image_id", "y", "x", *(f"{d.sample(at_sites(pattern, out[c]))} AS {c}" for c in "rgb")]
    if not extra:
        return names, None, None, final
    g = at_sites(pattern, extra["first"])
    return names, ["*", f"{g} AS g"], extra["then"], final


def demosaic(plane: DataFrame, method: str, pattern: str = "RGGB", carry: tuple[str, ...] = ()) -> DataFrame:
    """image_id, y, x, r, g, b, and the columns to carry, which ride along."""
    names, first, then, final = _steps(method, pattern, SPARK)
    df = neighbours(plane, {"s": names})
    if first:
        df = neighbours(df.selectExpr(*first).selectExpr("*", "s - g AS k"), then)
    return df.selectExpr(*final, *carry)


def demosaic_sql(source: str, method: str, pattern: str, d: Dialect) -> str:
    names, first, then, final = _steps(method, pattern, d)
    text = neighbours_sql(source, {"s": names})
    if first:
        text = neighbours_sql(f"SELECT *, s - g AS k FROM (SELECT {', '.join(first)} FROM ({text}) AS a) AS b", then)
    return f"SELECT {', '.join(final)} FROM ({text}) AS z"
