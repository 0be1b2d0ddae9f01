"""Comparisons of two renderings: positional joins, then map-side combined sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["image_id", "y", "x"]


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns a_<c> and b_<c> of the pixels that both have."""
    return a.select(*KEYS, *(F.col(c).alias(f"a_{c}") for c in a.columns if c not in KEYS)).join(b.select(*KEYS, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in KEYS)), KEYS)


def difference_image(pair: DataFrame, channel: str, span: int) -> DataFrame:
    """255 / span * (a - b) + 127.5, saturated to 0..255 and truncated."""
    v = f"CAST(255 AS DOUBLE) / {span} * (a_{channel} - b_{channel}) + CAST(127.5 AS DOUBLE)"
    return pair.selectExpr(*KEYS, f"CAST(least(255, greatest(0, {v})) AS INT) AS d")


def report(pair: DataFrame, channel: str) -> DataFrame:
    """cells, differing, share of those in %, mean difference over those, largest difference, mean squared over all."""
    d = F.abs(F.col(f"a_{channel}") - F.col(f"b_{channel}")).cast("bigint")
    sums = pair.agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("differing"), F.sum(d).alias("total"), F.max(d).alias("largest"), F.sum(d * d).alias("squares"))
    return sums.selectExpr("n", "differing", "round(100 * differing / n, 6) AS percent", "round(coalesce(try_divide(total, differing), 0), 6) AS mean_difference", "largest", "round(squares / n, 6) AS mse")


def histogram_report(pair: DataFrame, channel: str, bits: int = 12) -> DataFrame:
    """For buckets of 2^bits of the reference value: cells, differing, largest difference, mean squared."""
    d = F.abs(F.col(f"a_{channel}") - F.col(f"b_{channel}")).cast("bigint")
    grouped = pair.groupBy(F.shiftright(F.col(f"b_{channel}"), bits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("differing"), F.max(d).alias("largest"), F.sum(d * d).alias("squares"))
    return grouped.selectExpr("bucket", "n", "differing", "largest", "round(squares / n, 6) AS mse")


def mse_psnr(pair: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per channel: largest difference and mean squared error; over channels PSNR on a 0..1 scale (null if identical)."""
    sums = [x for c in "rgb" for x in (F.sum(F.expr(f"CAST(a_{c} - b_{c} AS BIGINT) * (a_{c} - b_{c})")).alias(f"sq_{c}"), F.max(F.expr(f"abs(a_{c} - b_{c})")).alias(f"max_{c}"))]
    out = pair.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *sums)
    mse = "((sq_r + sq_g + sq_b) / (CAST(3 AS DOUBLE) * n) / (CAST(65535 AS DOUBLE) * 65535))"
    return out.selectExpr(*(by or []), "n", *(f"round(sq_{c} / n, 6) AS mse_{c}" for c in "rgb"), *(f"max_{c}" for c in "rgb"), f"round(CASE WHEN {mse} > 0 THEN -10 * log10({mse}) END, 6) AS psnr")


def rgb_histogram(image: DataFrame) -> DataFrame:
    """channel, bin (0..255), n: one pass, three rows a pixel that are summed where they are."""
    channels = image.selectExpr("stack(3, 'r', r, 'g', g, 'b', b) AS (channel, v)")
    return channels.groupBy("channel", F.expr("CAST(v / CAST(65535 AS DOUBLE) * 255 AS INT)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def summary(pair: DataFrame) -> DataFrame:
    """On the 0..1 scale, over channels: largest difference, mean squared error, its root and PSNR; the first three also times 255 as they are shown."""
    out = mse_psnr(pair).selectExpr("greatest(max_r, max_g, max_b) / CAST(65535 AS DOUBLE) AS top", "(mse_r + mse_g + mse_b) / 3 / (CAST(65535 AS DOUBLE) * 65535) AS mse", "psnr")
    return out.selectExpr("round(top, 9) AS largest", "round(mse, 9) AS mse", "round(sqrt(mse), 9) AS rmse", "psnr", "round(255 * top, 6) AS largest_255", "round(255 * 255 * mse, 6) AS mse_255", "round(255 * sqrt(mse), 6) AS rmse_255")


def bucket_shares(pair: DataFrame, channel: str, bits: int = 12) -> DataFrame:
    """The difference histogram with each bucket's share of all cells and its share of differing ones, in %."""
    counted = histogram_report(pair, channel, bits)  # some buckets alone
    return counted.selectExpr("bucket", "n", "round(100 * n / sum(n) OVER (), 6) AS share", "round(100 * differing / n, 6) AS percent", "largest", "mse")


def scaled_differences(pair: DataFrame, names: str = "rgb") -> DataFrame:
    """Absolute differences of all channels, and these divided by the largest of the image (0 where all are equal)."""
    gap = {f"d_{c}": F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in names}
    apart = pair.select(*KEYS, *(v.alias(k) for k, v in gap.items()))
    top = apart.groupBy("image_id").agg(F.max(F.greatest(*gap)).alias("top"))  # a row an image, summed up where the rows are
    scaled = apart.join(F.broadcast(top), "image_id")
    return scaled.select(*KEYS, *gap, *(F.round(F.coalesce(F.try_divide(F.col(k).cast("double"), F.col("top")), F.lit(0.0)), 9).alias(f"s_{k[2:]}") for k in gap))
