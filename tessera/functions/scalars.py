"""Small scalar formulas as columns or SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of Euclid's algorithm that any two 64-bit integers need at most.
_STEPS = 93


def gcd(a: str, b: str) -> str:
    """Greatest common divisor of two integers; of 0 and 0 it is 0."""
    step = "CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END"
    return f"aggregate(sequence(1, {_STEPS}), named_struct('a', abs(CAST({a} AS BIGINT)), 'b', abs(CAST({b} AS BIGINT))), (s, k) -> {step}, s -> s.a)"


def lcm(a: str, b: str) -> str:
    """Least common multiple; 0 if one is 0."""
    return f"coalesce(abs(CAST({a} AS BIGINT)) div nullif({gcd(a, b)}, 0) * abs(CAST({b} AS BIGINT)), 0)"


def rational(num: str, den: str) -> dict[str, str]:
    """Value (null over 0), truncated value, reciprocal and text of a fraction, which isn't reduced."""
    return {"value": f"try_divide(CAST({num} AS DOUBLE), {den})", "whole": f"CAST(try_divide(CAST({num} AS DOUBLE), {den}) AS BIGINT)", "reciprocal": f"try_divide(CAST({den} AS DOUBLE), {num})", "shown": f"concat({num}, '/', {den})"}


def unsigned(data: Column, at: int, size: int, little: bool) -> Column:
    """An unsigned integer of `size` bytes at a 0-based place of a binary column; null past the end."""
    piece = F.substring(data, at + 1, size)
    digits = F.hex(piece)
    if little:
        digits = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.when(F.octet_length(piece) == size, F.conv(digits, 16, 10).cast("bigint"))


def sign_extended(v: str, bits: int) -> str:
    """The signed difference that a category of so many bits and its bits stand for."""
    return f"CASE WHEN {v} < {1 << bits >> 1} THEN {v} - {(1 << bits) - 1} ELSE {v} END"


def ascii_text(chars: Column) -> Column:
    """Characters of an ASCII tag joined and trimmed of white space and control characters at the ends."""
    return F.regexp_replace(F.array_join(chars, ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def listed(values: Column) -> Column:
    """Values one after the other, each followed by a comma and a space."""
    return F.when(F.size(values) > 0, F.concat(F.array_join(values, ", "), F.lit(", "))).otherwise("")


def with_extension(name: Column, extension: str) -> Column:
    """The name up to its first dot, with another extension."""
    return F.concat(F.substring_index(name, ".", 1), F.lit(f".{extension}"))


def has_extension(name: Column, extension: str) -> Column:
    return F.lower(name).endswith(f".{extension.lower()}")


def render_key(text: Column) -> dict[str, Column]:
    """Method, strategy and step of 'method,strategy,step'; absent parts are null."""
    parts = F.split(text, ",")
    return {n: F.nullif(F.trim(F.get(parts, k)), F.lit("")) for k, n in enumerate(("method", "strategy", "step"))}


def window_side(text: Column) -> Column:
    """9 of '9x9 px'."""
    return F.regexp_extract(text, r"^(\d+)x\1 px$", 1).cast("int")


def percent(v: Column, places: int = 2) -> Column:
    """0.125 as '12.5%'."""
    return F.concat(F.regexp_replace(F.format_string(f"%.{places}f", v * 100), r"\.?0+$", "") if places else F.format_string("%.0f", F.round(v * 100)), F.lit("%"))


def from_percent(text: Column) -> Column:
    return F.regexp_replace(text, "%", "").cast("double") / 100


def tinted(mode: str, names=("r", "g", "b"), by: str = "1.1") -> list[str]:
    """One channel stands out: the others become it divided by 1.1. Mode ALL changes nothing."""
    if mode == "ALL":
        return list(names)
    own = dict(zip("RGB", names))[mode]
    return [own if n == own else f"{own} / CAST({by} AS DOUBLE)" for n in names]


def zoom(factor: str, closer: bool) -> str:
    """A step by the square root of 2, rounded to 2 places, within 0.01 to 32."""
    return f"least(32, greatest(CAST(0.01 AS DOUBLE), round({factor} {'*' if closer else '/'} sqrt(CAST(2 AS DOUBLE)), 2)))"
