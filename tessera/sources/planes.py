"""Planes in long form (one row a pixel) from tables, and the mosaic of a colour image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import SPARK, Dialect

#: Channel at x % 2 + 2 * (y % 2).
CFA = {"RGGB": "RGGB", "GRBG": "GRBG", "GBRG": "GBRG", "BGGR": "BGGR"}


def read(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as views of the session."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def orders_plane(d: Dialect, width: int = 100) -> str:
    """image_id, y, x, s from the total prices of contiguous order keys."""
    return f"SELECT 0 AS image_id, {d.int(d.div('o_orderkey', str(width)))} AS y, {d.int(f'o_orderkey % {width}')} AS x, {d.int(d.big('o_totalprice') + ' % 65536')} AS s FROM orders"


def orders_truth(d: Dialect, width: int = 100) -> str:
    """image_id, y, x, r, g, b; blue is a ramp until it wraps."""
    y, x = d.div("o_orderkey", str(width)), f"(o_orderkey % {width})"
    return f"SELECT 0 AS image_id, {d.int(y)} AS y, {d.int(x)} AS x, {d.int(d.big('o_totalprice') + ' % 65536')} AS r, {d.int(f'(o_custkey * 37 + {x} * 300) % 65536')} AS g, {d.int(f'({y} * 211 + {x} * 97) % 65536')} AS b FROM orders"


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders")
    return spark.sql(orders_plane(SPARK))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "orders")
    return spark.sql(orders_truth(SPARK))


def by_pattern(choices: str | list[str], x: str = "x", y: str = "y") -> str:
    """SQL text that picks one of four expressions by the place in the 2 x 2 pattern."""
    return f"(CASE ({x} % 2) + 2 * ({y} % 2) " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(choices)) + " END)"


def mosaic(image: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """One sample a pixel."""
    return image.selectExpr("image_id", "y", "x", by_pattern([c.lower() for c in CFA[pattern]]) + " AS s")
