"""Ways to extend the engine: operators on whole frames, on samples and on colours, in ordered chains; lookups, text operators, memos and timers."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Frames = Callable[[DataFrame], DataFrame]
#: A sample operator makes SQL text from the sample's text, with x and y in reach; a colour operator makes three from three.
OfSample = Callable[[str], str]
OfColor = Callable[[str, str, str], tuple[str, str, str] | list[str]]


class Chain:
    """Operators in the order in which they were added, applied as one lazy plan."""

    def __init__(self, *steps: Frames):
        self.steps = list(steps)

    def add(self, step: Frames) -> Chain:
        self.steps.append(step)
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(DataFrame.transform, self.steps, df)


def on_samples(*operators: OfSample, clamp: bool = True) -> Frames:
    """A projection that applies sample operators one after the other, each clamped to 0..65535 and truncated unless told not to."""

    def step(df: DataFrame) -> DataFrame:
        for f in operators:
            v = f"least(65535, greatest(0, {f('s')}))" if clamp else f("s")
            df = df.selectExpr(*(c for c in df.columns if c != "s"), f"CAST({v} AS INT) AS s" if clamp else f"{v} AS s")
        return df

    return step


def on_colors(*operators: OfColor, whole: bool = False) -> Frames:
    """Colour operators over r, g, b one after the other. With `whole` values are integers, clamped and truncated after each."""

    def step(df: DataFrame) -> DataFrame:
        for f in operators:
            made = [f"CAST(least(65535, greatest(0, {e})) AS INT)" if whole else e for e in f("r", "g", "b")]
            df = df.selectExpr(*(c for c in df.columns if c not in "rgb"), *(f"{e} AS {c}" for e, c in zip(made, "rgb")))
        return df

    return step


def looked_up(value: Column, table: dict, default=None) -> Column:
    """A small table's entry for a value, or the default."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value), F.lit(default))


def by_text(text: str, **inputs: DataFrame) -> Frames:
    """An operator that is SQL text over r, g, b and the channels <name>_r ... of other images at the same place: `SELECT` items after the keys."""

    def step(df: DataFrame) -> DataFrame:
        for name, other in inputs.items():
            df = df.join(other.select("image_id", "y", "x", *(F.col(c).alias(f"{name}_{c}") for c in other.columns if c not in ("image_id", "y", "x"))), ["image_id", "y", "x"])
        df.createOrReplaceTempView("by_text_input")
        return df.sparkSession.sql(f"SELECT image_id, y, x, {text} FROM by_text_input")

    return step


class Memo:
    """Renderings by configuration: each is made once and kept until told otherwise."""

    def __init__(self):
        self.held: dict[tuple, DataFrame] = {}

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.held:
            self.held[key] = make().persist()
        return self.held[key]

    def missing(self, keys: list[tuple]) -> list[tuple]:
        return [k for k in keys if k not in self.held]

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()


def timed(name: str, done: Callable[[str, int, float], None]) -> Frames:
    """Passes rows on; `done` hears of the operator's name, its rows and the seconds from the plan's making, once something ran it and asked."""

    def step(df: DataFrame) -> DataFrame:
        seen, began = Observation(name), time.time()
        out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        out.finished = lambda: done(name, seen.get["rows"], time.time() - began)
        return out

    return step
