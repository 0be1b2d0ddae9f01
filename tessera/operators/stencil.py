"""Neighbours of pixels in long form by axis windows, clamped to the border.

Neighbours off the axes are columns' neighbours of rows' neighbours, which clamps x and y each for itself. A window
pass is one shuffle by rows and one by columns; wide kernels belong in tile form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = "PARTITION BY image_id, y ORDER BY x"
COLUMNS = "PARTITION BY image_id, x ORDER BY y"
AXIS = {"w": ("lag", 1), "w2": ("lag", 2), "w3": ("lag", 3), "w4": ("lag", 4), "e": ("lead", 1), "e2": ("lead", 2), "e3": ("lead", 3), "e4": ("lead", 4)}
VERTICAL = {"n": ("lag", 1), "n2": ("lag", 2), "n3": ("lag", 3), "n4": ("lag", 4), "s": ("lead", 1), "s2": ("lead", 2), "s3": ("lead", 3), "s4": ("lead", 4)}
#: Diagonal neighbours: the row neighbour, then the column neighbour of that.
DIAGONAL = {"nw": ("w", "n"), "ne": ("e", "n"), "sw": ("w", "s"), "se": ("e", "s"), "nw2": ("w2", "n2"), "ne2": ("e2", "n2"), "sw2": ("w2", "s2"), "se2": ("e2", "s2")}


def shifted(column: str, kind: str, step: int, over: str) -> str:
    """The value `step` places on, or the last there is."""
    return "coalesce(" + ", ".join(f"{kind}({column}, {k}) OVER ({over})" for k in range(step, 0, -1)) + f", {column})"


def plan(wanted: dict[str, list[str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """For columns and the neighbours wanted of each: (expression, name) by rows, then by columns. Names are column_neighbour."""
    across, down = {}, {}
    for column, names in wanted.items():
        for name in names:
            if name in AXIS:
                across[f"{column}_{name}"] = shifted(column, *AXIS[name], ROWS)
            elif name in VERTICAL:
                down[f"{column}_{name}"] = shifted(column, *VERTICAL[name], COLUMNS)
            else:
                side, up = DIAGONAL[name]
                across[f"{column}_{side}"] = shifted(column, *AXIS[side], ROWS)
                down[f"{column}_{name}"] = shifted(f"{column}_{side}", *VERTICAL[up], COLUMNS)
    return [(v, k) for k, v in across.items()], [(v, k) for k, v in down.items()]


def neighbours(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    across, down = plan(wanted)
    for step in (across, down):
        if step:
            df = df.selectExpr("*", *(f"{e} AS {n}" for e, n in step))
    return df


def neighbours_sql(source: str, wanted: dict[str, list[str]]) -> str:
    across, down = plan(wanted)
    for step in (across, down):
        if step:
            source = f"SELECT *, {', '.join(f'{e} AS {n}' for e, n in step)} FROM ({source}) AS t"
    return source


def convolved(column: str, taps: list[float], over: str) -> str:
    """A row or column convolution of odd length, clamped at the ends; taps are given left to right."""
    half = len(taps) // 2
    terms = []
    for k, tap in zip(range(-half, half + 1), taps):
        value = column if not k else shifted(column, "lag" if k < 0 else "lead", abs(k), over)
        terms.append(f"CAST({tap!r} AS DOUBLE) * {value}")
    return "(" + " + ".join(terms) + ")"
