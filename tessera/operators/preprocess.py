"""Per-sample maps before reconstruction: levels and white balance, as one projection without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.dialect import Dialect
from ..sources.planes import by_pattern


@dataclass
class Levels:
    """Black and white levels of an image; active is (top, left, bottom, right)."""

    black: tuple[float, ...] = (0.0,)
    white: float = 65535.0
    active: tuple[int, int, int, int] = (0, 0, 1 << 30, 1 << 30)
    delta_rows: list[float] = field(default_factory=list)
    delta_columns: list[float] = field(default_factory=list)
    table: list[int] = field(default_factory=list)


def _entry(values: list, index: str, d: Dialect) -> str:
    """A literal array's entry, the last beyond its end."""
    items = ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in values)
    index = f"least({index}, {len(values) - 1})"
    return f"element_at(array({items}), CAST({index} AS INT) + 1)" if d.spark else f"list_extract([{items}], CAST({index} AS INT) + 1)"


def black_level(levels: Levels) -> str:
    base = f"CAST({float(levels.black[0])!r} AS DOUBLE)"
    if len(levels.black) == 4:
        return by_pattern([f"CAST({float(v)!r} AS DOUBLE)" for v in levels.black])
    return base


def raw_map(levels: Levels, d: Dialect, s: str = "s") -> str:
    """Linearised, black level off, scaled by what is left up to the white level there, clamped to 0..65535."""
    value = _entry(levels.table, s, d) if levels.table else s
    top, left, bottom, right = levels.active
    inside = f"y >= {top} AND y < {bottom} AND x >= {left} AND x < {right}"
    first = f"CAST({float(levels.black[0])!r} AS DOUBLE)"
    within = [black_level(levels)]
    if levels.delta_rows:
        within.append(_entry(levels.delta_rows, f"greatest(0, y - {top})", d))
    if levels.delta_columns:
        within.append(_entry(levels.delta_columns, f"greatest(0, x - {left})", d))
    black = f"(CASE WHEN {inside} THEN {' + '.join(within)} ELSE {first} END)"
    return d.sample(f"(({value} - {black}) / (CAST({float(levels.white)!r} AS DOUBLE) - {black}) * 65535)")


def white_balance(gains: dict[str, float], pattern: str, d: Dialect, s: str = "s") -> str:
    """Each sample times its channel's gain."""
    return d.sample(f"({s} * {by_pattern([f'CAST({gains[c]!r} AS DOUBLE)' for c in pattern])})")
