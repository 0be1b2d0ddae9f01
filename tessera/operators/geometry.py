"""Crops and quarter turns as remapped coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Orientation codes and clockwise degrees.
ORIENTATION = {1: 0, 3: 180, 6: 90, 8: 270}


def crop(df: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """The filter reaches the scan through projections; coordinates start at 0 again."""
    return df.filter(f"y >= {top} AND y < {top + height} AND x >= {left} AND x < {left + width}").withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def margin(df: DataFrame, border: int, height: int, width: int) -> DataFrame:
    return df.filter(f"x >= {border} AND x < {width - border} AND y >= {border} AND y < {height - border}")


def inner(df: DataFrame, border: int) -> DataFrame:
    """Without a border on each side of every image, whose sizes come from its own largest coordinates (one row an image)."""
    size = df.groupBy("image_id").agg(F.max("y").alias("bottom_"), F.max("x").alias("right_"))
    return df.join(size, "image_id").filter(f"x >= {border} AND x <= right_ - {border} AND y >= {border} AND y <= bottom_ - {border}").drop("bottom_", "right_")


def rotate(df: DataFrame, degrees: int) -> DataFrame:
    """Clockwise by 0, 90, 180 or 270 degrees. Sizes come from each image's own largest coordinates."""
    if degrees % 360 == 0:
        return df
    size = df.groupBy("image_id").agg(F.max("y").alias("bottom"), F.max("x").alias("right"))
    y, x = {90: ("x", "bottom - y"), 180: ("bottom - y", "right - x"), 270: ("right - x", "y")}[degrees % 360]
    rest = [c for c in df.columns if c not in ("y", "x")]
    return df.join(size, "image_id").select(F.expr(y).alias("y_"), F.expr(x).alias("x_"), *rest).withColumnsRenamed({"y_": "y", "x_": "x"}).select(*df.columns)
