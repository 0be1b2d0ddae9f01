"""What the operators of this subpackage share: tables in the shared folder, and text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a numeric kernel handles at once; a longer document is handled alone.
SLICE_BYTES = 1 << 19
#: Rows that a function over batches sees at once.
BATCH_ROWS = 1000
#: Bytes of a row group of tables between steps, about: a reading or writing task holds one whole, beside those of all other cores.
ROW_GROUP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator run in the shared folder. They cut lineage and outlive lost executors.

    An operator drops what nothing reads any more; what its result still reads goes when the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Writes df, with options of the writer, and reads it again."""
        df.write.mode("overwrite").options(**({"parquet.block.size": str(ROW_GROUP_BYTES)} | options)).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))

    def close(self) -> None:
        """Deletes the whole folder, as far as the session still lives."""
        atexit.unregister(self.close)
        with contextlib.suppress(Exception):
            _delete(self.spark, self.base)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's references to them are collected; ask for that now. For after the largest shuffles: it takes some tenths of a second."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.2)


def hand_back(spark: SparkSession) -> None:
    """Executors collect their garbage and give free heap back to the system, beside which their Python workers live.

    One small task for each core, so that every executor gets some; without it a heap stays as large as its hungriest
    step made it.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc")).alias("done"), "id").write.format("noop").mode("overwrite").save()


def few(rows: DataFrame, most: int) -> DataFrame:
    """A written table of narrow rows, to be broadcast where it counts `most` of them or fewer."""
    return F.broadcast(rows) if rows.count() <= most else rows


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, so that helper columns can't clash with its own."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text alone, so that other columns, whatever their names, can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: What empties the caches of a Python worker, and the module that last filled them there.
_caches: list[Callable[[], None]] = []
_last: list[str] = [""]


def cached(f):
    """An unbounded cache that a worker drops when it turns to another module's functions."""
    held = lru_cache(None)(f)
    _caches.append(held.cache_clear)
    return held


def started(name: str) -> None:
    if _last[0] != name:
        _last[0] = name
        for clear in _caches:
            clear()


def trimmed() -> None:
    """Free memory of a worker goes back to the system: idle workers stay beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function from a batch to columns; lists of columns come out in the schema's types."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    name = f.__module__

    def run(batches):
        started(name)
        for batch in (whole.slice(a, BATCH_ROWS) for whole in batches for a in range(0, whole.num_rows, BATCH_ROWS)):
            out = f(batch)
            for cols in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == t.type else pa.array(c, t.type) for t, c in ((t, cols[t.name]) for t in arrow)], schema=arrow)
        trimmed()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, good: Callable[[pa.RecordBatch], object]) -> DataFrame:
    """The rows of df for which `good` says true of each batch."""
    name = good.__module__

    def run(batches):
        started(name)
        for batch in (whole.slice(a, BATCH_ROWS) for whole in batches for a in range(0, whole.num_rows, BATCH_ROWS)):
            yield batch.filter(pa.array(good(batch), pa.bool_()))
        trimmed()

    return df.mapInArrow(run, df.schema)


def sliced(texts: list, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text makes a range of its own."""
    return ranges([len(t or b"") for t in texts], most)


def ranges(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes sum up to about `most`; a larger item makes a range of its own."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def encoded(texts: list) -> list[bytes]:
    """UTF-8; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def crc_fold(id_col: Column) -> Column:
    """crc32(doc_id as text) mod 5: 0 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
