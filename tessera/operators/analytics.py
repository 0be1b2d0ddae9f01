"""Reports over timing and accuracy logs: rows with task, strategy, tile and duration, or alg, dataset and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_by(df: DataFrame, keys: list[str], value: str, name: str = "mean_duration") -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(value), 6).alias(name))


def least_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest group's size."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("min_n"))


def best_tile(df: DataFrame) -> DataFrame:
    """Per task and strategy: the tile size with the lowest mean duration, smaller sizes first among equals."""
    mean = df.groupBy("task", "strategy", "tile").agg(F.round(F.avg("duration"), 6).alias("mean_duration"))
    return mean.groupBy("task", "strategy").agg(F.min(F.struct("mean_duration", "tile")).alias("best")).select("task", "strategy", "best.tile", "best.mean_duration")


def speedup(df: DataFrame, base: str) -> DataFrame:
    """Mean of the base strategy over each strategy's mean, by task."""
    mean = df.groupBy("task", "strategy").agg(F.avg("duration").alias("m"))
    of_base = F.max(F.when(F.col("strategy") == base, F.col("m"))).over(Window.partitionBy("task"))
    return mean.select("task", "strategy", F.round(F.try_divide(of_base, F.col("m")), 6).alias("speedup"))


def relative_tile_speedup(df: DataFrame) -> DataFrame:
    mean = df.groupBy("task", "tile").agg(F.avg("duration").alias("m"))
    return mean.select("task", "tile", F.round(F.max("m").over(Window.partitionBy("task")) / F.col("m"), 6).alias("relative"))


def pivot(df: DataFrame, strategies: list[str]) -> DataFrame:
    """A column for each strategy; the list is given, so that no pass looks for it."""
    return df.groupBy("task").agg(*(F.round(F.avg(F.when(F.col("strategy") == s, F.col("duration"))), 6).alias(s) for s in strategies))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    q = df.groupBy(key).agg(F.expr(f"percentile({value}, array(0.25, 0.5, 0.75))").alias("q")).select(key, *(F.col("q")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))))
    near = df.join(q, key).filter(f"{value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)")
    return near.groupBy(key).agg(*(F.round(F.first(c), 6).alias(c) for c in ("q1", "median", "q3")), F.min(value).alias("low"), F.max(value).alias("high"))


def ranked(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows of the listed categories with their place in the list; others go."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column)).cast("int")
    return df.withColumn("place", place).filter("place > 0")


def latest_method(df: DataFrame, labels: dict[int, str] | None = None) -> DataFrame:
    """Each run's method: the one with the greatest id among its rows, mapped back to its label if labels are given."""
    out = df.withColumn("run_method", F.max("method_id").over(Window.partitionBy("system_id", "run")))
    return out if not labels else out.withColumn("run_label", F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), F.col("run_method")))


def accuracy_means(df: DataFrame, keys: tuple[str, ...] = ("alg", "dataset"), metrics: tuple[str, ...] = ("mse", "psnr", "mssim")) -> DataFrame:
    """Means of the accuracy log's metrics by method and data set."""
    return df.groupBy(*keys).agg(*(F.round(F.avg(m), 6).alias(m) for m in metrics))


def deviation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row beside its group's mean, smallest and largest value."""
    over = Window.partitionBy(*keys)
    return df.withColumns({"group_mean": F.round(F.avg(value).over(over), 6), "group_min": F.min(value).over(over), "group_max": F.max(value).over(over)})


def task_pairs(df: DataFrame) -> DataFrame:
    """Marks (system_id, task, ts, kind 'start' or 'end') to measured tasks: system_id, task, restarted, start, end, duration.

    A start while the task is open ends it and starts it anew (restarted); an end of what isn't open is dropped; an
    open task ends with the system's last mark, as at the end of a run. Marks of one time keep ends before starts.
    """
    w = Window.partitionBy("system_id", "task").orderBy("ts", "kind")
    run = Window.partitionBy("system_id")
    seen = df.withColumns({"before": F.lag("kind").over(w), "end": F.coalesce(F.lead("ts").over(w), F.max("ts").over(run))})
    return seen.filter("kind = 'start'").select("system_id", "task", F.coalesce(F.col("before") == "start", F.lit(False)).alias("restarted"), F.col("ts").alias("start"), "end", (F.col("end") - F.col("ts")).alias("duration"))
