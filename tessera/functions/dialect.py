"""Scalar formulas as SQL text. Spark runs them through F.expr; the same text in the other dialect is what tests hold against."""

from __future__ import annotations


class Dialect:
    """Integer division and truncation differ between engines; all else is common SQL."""

    def __init__(self, spark: bool):
        self.spark = spark

    def div(self, a: str, b: str) -> str:
        """Toward zero."""
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def int(self, v: str) -> str:
        """Truncated."""
        return f"CAST({v} AS INT)" if self.spark else f"CAST(trunc({v}) AS INT)"

    def big(self, v: str) -> str:
        return f"CAST({v} AS BIGINT)" if self.spark else f"CAST(trunc({v}) AS BIGINT)"

    def sample(self, v: str) -> str:
        """Clamped to 0..65535, truncated."""
        return self.int(f"least(65535, greatest(0, {v}))")


SPARK, OTHER = Dialect(True), Dialect(False)
