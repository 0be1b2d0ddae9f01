"""Start and end marks of tasks to measured tasks, as they come; the batch form is analytics.task_pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRED = "system_id string, task string, restarted boolean, start bigint, end bigint, duration bigint"
#: The columns of the timing log and of the system log.
TIMING = "systemId string, startOfRun bigint, fileName string, imageWidth int, imageLength int, accelerationStrategy string, task string, description string, startOfTask bigint, endOfTask bigint, taskDuration bigint"
SYSTEM = (
    "systemId string, cpuVendor string, cpuName string, cpuMicroarchitecture string, cpuFrequency bigint, cpuPhysicalCores int, cpuLogicalCores int, totalRam bigint, gpuVendor string, gpuRenderer string, "
    "openGLVersion string, maxTextureSize int, maxFragmentUniformComponents int, maxViewportWidth int, maxViewportHeight int, gpuError string"
)


def _pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: when the open task started and whether that was a restart."""
    open_ = state.get if state.exists else None
    marks = pd.concat(list(frames)).sort_values(["ts", "kind"], kind="stable")
    out = []
    for ts, kind in zip(marks["ts"].tolist(), marks["kind"]):
        if open_ is not None:
            out.append((key[0], key[1], open_[1], open_[0], ts, ts - open_[0]))
        open_ = (ts, open_ is not None) if kind == "start" else None
    if open_ is None:
        state.remove()
    else:
        state.update(open_)
    yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in PAIRED.split(", ")])


def pair_tasks(marks: DataFrame) -> DataFrame:
    """A stream of marks (system_id, task, ts, kind) to one of measured tasks. A start while a task is open ends it; an end without a start is dropped; the state is one number pair an open task."""
    return marks.groupBy("system_id", "task").applyInPandasWithState(_pair, PAIRED, "start bigint, restarted boolean", "append", GroupStateTimeout.NoTimeout)


def append_log(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a CSV log with a header in each file; a batch that runs again is written once."""
    return rows.writeStream.format("csv").option("header", True).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def log_rows(rows: DataFrame, folder: str) -> None:
    """Appends a batch to a CSV log."""
    rows.write.mode("append").option("header", True).csv(folder)


def read_log(spark: SparkSession, folder: str, schema: str = TIMING) -> DataFrame:
    """A CSV log with its types. Header lines that came along with joined files go, and so do the blanks around names; the text None stays a text."""
    first = schema.split(" ")[0]
    lines = spark.read.schema(", ".join(f"{c.split(' ')[0]} string" for c in schema.split(", "))).option("header", False).option("ignoreLeadingWhiteSpace", True).csv(folder)
    kept = lines.filter(f"trim({first}) <> '{first}'")
    return kept.selectExpr(*(f"CAST({c.split(' ')[0]} AS {c.split(' ')[1]}) AS {c.split(' ')[0]}" for c in schema.split(", ")))


def new_files(spark: SparkSession, folder: str, pattern: str = "*.[dD][nN][gG]") -> DataFrame:
    """A stream of the files that come into a folder: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
