"""Tile form: pixels dealt to tiles with a halo, one kernel call a tile. One shuffle by (image, tile), whatever the kernel's width."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import borders, kernels

TILE = 256


def with_halo(df: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Adds ty, tx; a pixel within `halo` of another tile goes there too. Tiles past the image's end hold halo alone and make no rows."""
    if tile % 2 or tile <= halo:
        raise ValueError("the tile must be even and larger than its halo")
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-halo), F.lit(0), F.lit(halo)), lambda k: F.floor((F.col(c) + k) / tile).cast("int")))
    return df.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x"))).filter("ty >= 0 AND tx >= 0")


def _arrays(pdf: pd.DataFrame, values: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, int, int]:
    """Columns as arrays over the tile's rectangle, where it has pixels, and its first row and column. Where a column of pixels ends early, its last value goes on, as clamping has it."""
    y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
    h, w = int(pdf["y"].max()) + 1 - y0, int(pdf["x"].max()) + 1 - x0
    place = (pdf["y"].to_numpy() - y0) * w + pdf["x"].to_numpy() - x0
    there = np.zeros(h * w, bool)
    there[place] = True
    there = there.reshape(h, w)
    last = np.maximum.accumulate(np.where(there, np.arange(h)[:, None], -1), axis=0)
    if (last < 0).any() or (np.diff(there.astype(int), axis=0) > 0).any():
        raise ValueError("a plane with holes")
    held = {}
    for c in values:
        flat = np.zeros(h * w, pdf[c].to_numpy().dtype)
        flat[place] = pdf[c].to_numpy()
        held[c] = np.take_along_axis(flat.reshape(h, w), last, 0)
    return held, there, y0, x0


def _core(pdf: pd.DataFrame, there: np.ndarray, y0: int, x0: int, tile: int) -> np.ndarray:
    """The pixels that are the tile's own."""
    top, left = int(pdf["ty"].iloc[0]) * tile, int(pdf["tx"].iloc[0]) * tile
    y, x = (np.arange(n) + o for n, o in zip(there.shape, (y0, x0)))
    return there & ((y >= top) & (y < top + tile))[:, None] & ((x >= left) & (x < left + tile))[None, :]


def per_tile(df: DataFrame, halo: int, kernel: Callable[[dict[str, np.ndarray], int, int], dict[str, np.ndarray]], schema: str, tile: int = TILE) -> DataFrame:
    """kernel(arrays by column, y0, x0) on each haloed tile; rows (image_id, y, x, ...) of the cores. The last row of an image may be short; a plane with holes raises."""
    names = StructType.fromDDL(schema).fieldNames()
    values = [c for c in df.columns if c not in ("image_id", "y", "x")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held, there, y0, x0 = _arrays(pdf, values)
        core = _core(pdf, there, y0, x0, tile)
        if not core.any():  # a halo past the image's end
            return pd.DataFrame({n: [] for n in names})
        made = kernel(held, y0, x0)
        yy, xx = np.nonzero(core)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": yy + y0, "x": xx + x0} | {k: v[core] for k, v in made.items()})

    return with_halo(df, halo, tile).groupBy("image_id", "ty", "tx").applyInPandas(run, schema)


def tile_sums(df: DataFrame, halo: int, kernel: Callable[[dict[str, np.ndarray], np.ndarray, int, int], dict[str, float]], schema: str, tile: int = TILE) -> DataFrame:
    """kernel(arrays, which pixels are the tile's own, y0, x0) on each haloed tile; one row (image_id, ...) a tile."""
    names = StructType.fromDDL(schema).fieldNames()
    values = [c for c in df.columns if c not in ("image_id", "y", "x")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held, there, y0, x0 = _arrays(pdf, values)
        core = _core(pdf, there, y0, x0, tile)
        if not core.any():
            return pd.DataFrame({n: [] for n in names})
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]]} | {k: [v] for k, v in kernel(held, core, y0, x0).items()})

    return with_halo(df, halo, tile).groupBy("image_id", "ty", "tx").applyInPandas(run, schema)


def demosaic(plane: DataFrame, method: str, pattern: str = "RGGB", tile: int = TILE) -> DataFrame:
    """The wide methods, in tile form: image_id, y, x, r, g, b."""
    kernel = lambda a, y0, x0: dict(zip("rgb", kernels.demosaic(a["s"], method, pattern, y0, x0)))
    return per_tile(plane, kernels.RADIUS[method], kernel, "image_id int, y int, x int, r int, g int, b int", tile)


#: Named intermediates: what a run can stop at.
STAGES = ("xy_gradient", "lowpass", "greens", "pq_gradient", "opposite", "colours", "moments", "averages")


def stage(plane: DataFrame, name: str, pattern: str = "RGGB", tile: int = TILE) -> DataFrame:
    """image_id, y, x and a named intermediate: v; for colours r and b; for moments the sums of the row's nine samples, of their squares, and of the squares of their differences to the centre-smoothed row; for averages those of the diagonals and of the axes."""
    names = {"colours": "r b", "moments": "total squares apart", "averages": "diagonal axial"}.get(name, "v").split()
    if name not in STAGES:
        raise ValueError(f"no stage {name}")

    def kernel(a, y0, x0):
        s = a["s"].astype(float)
        cfa = kernels.place(s.shape, pattern, y0, x0)
        green = cfa == "G"
        if name == "moments":
            made = kernels.moments(s, kernels._along(s, (0.25, 0.5, 0.25), False), False)
        elif name == "averages":
            made = kernels.four_mean(s, True), kernels.four_mean(s, False)
        elif name == "lowpass":
            made = (kernels.lowpass(s, green),)
        elif name == "pq_gradient":
            made = (kernels.pq_gradient(s, green),)
        else:
            xy = kernels.xy_gradient(s)
            g = kernels.rcd_greens(s, green, xy) if name != "xy_gradient" else None
            pq = kernels.pq_gradient(s, green) if name in ("opposite", "colours") else None
            made = {"xy_gradient": lambda: (xy,), "greens": lambda: (g,), "opposite": lambda: (np.where(green, 0, kernels.rcd_opposite(s, g, pq)),), "colours": lambda: kernels.rcd_colours(s, cfa, g, xy, pq)}[name]()
        return dict(zip(names, made))

    return per_tile(plane, 16, kernel, "image_id int, y int, x int, " + ", ".join(f"{n} double" for n in names), tile)


def bilinear_reduced(plane: DataFrame, pattern: str = "RGGB", tile: int = TILE) -> DataFrame:
    """Means of the neighbours that the image has, fewer at its borders: r, g, b as doubles."""

    def kernel(a, y0, x0):
        return dict(zip("rgb", borders.bilinear(a["s"].astype(float), kernels.place(a["s"].shape, pattern, y0, x0))))

    return per_tile(plane, 2, kernel, "image_id int, y int, x int, r double, g double, b double", tile)


def least_squares(plane: DataFrame, window_mean: bool, pattern: str = "RGGB", tile: int = TILE) -> DataFrame:
    """Directional least squares with mirrored filters and moments over what there is: r, g, b as doubles."""

    def kernel(a, y0, x0):
        return dict(zip("rgb", borders.least_squares(a["s"].astype(float), kernels.place(a["s"].shape, pattern, y0, x0), window_mean)))

    return per_tile(plane, 12, kernel, "image_id int, y int, x int, r double, g double, b double", tile)


def mssim(pair: DataFrame, margin: int, tile: int = TILE) -> DataFrame:
    """Mean structural similarity over channels and the pixels that lie margin + 5 inside: image_id, mssim (1 for equal images). Tiles send sums alone."""
    edge = margin + 5
    size = pair.groupBy("image_id").agg(F.max("y").alias("h_"), F.max("x").alias("w_"))

    def kernel(a, core, y0, x0):
        y, x = (np.arange(n)[s] + o for n, s, o in zip(core.shape, (np.s_[:, None], np.s_[None, :]), (y0, x0)))
        inner = core & (y >= edge) & (y <= a["h_"].max() - edge) & (x >= edge) & (x <= a["w_"].max() - edge)
        total = sum(kernels.similarity(a[f"a_{c}"] / 65535, a[f"b_{c}"] / 65535)[inner].sum() for c in "rgb")
        return {"total": float(total), "n": 3 * int(inner.sum())}

    sums = tile_sums(pair.join(size, "image_id"), 5, kernel, "image_id int, total double, n bigint", tile)
    return sums.groupBy("image_id").agg(F.round(F.try_divide(F.sum("total"), F.sum("n")), 9).alias("mssim"))
