"""Packing by best-fit decreasing, with a segment tree over remaining capacities.

An overlong document is first cut into full windows, each a sequence of its own; the rests are dealt evenly over
tasks, each of which packs its share, longest first, always into the open window that it leaves least room in.
A segment tree indexed by remaining capacity finds that window. A task leaves a few windows with padding, so
padding falls as shares grow. Every token lies in exactly one piece. A task packs lengths alone (some 50 bytes a
piece); ids, where asked for, are joined to their places afterwards.

Ids are those of the tokenizers library: see vocab.Merges for where its merges are run by tiktoken's loop instead.

A null or empty text is the end id alone. Repeated rows are packed each for itself; pieces of rows with the same
doc_id can't be told apart by doc_id. An empty table has no pieces. Names of other columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, texts_of
from .vocab import library_ids, vocabulary

VOCABULARY = "word_bpe_49k.json"
WINDOW = 4096
END_ID = 2


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity of at least n that has one."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = {}

    def _mark(self, capacity: int, value: int) -> None:
        i = capacity + self.size
        self.any[i] = value
        while i > 1:
            i >>= 1
            value = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == value:
                break
            self.any[i] = value

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            held = self.open.setdefault(capacity, [])
            held.append(window)
            if len(held) == 1:
                self._mark(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest fit, taken out."""
        i = least + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # up, until a right neighbour holds one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.size
        held = self.open[capacity]
        window = held.pop()
        if not held:
            self._mark(capacity, 0)
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each length (1 to window), and how many windows there are."""
    tree, n = CapacityTree(window), 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        if found is None:
            found, n = (window, n), n + 1
        capacity, w = found
        where[i], offset[i] = w, window - capacity
        tree.put(capacity - size, w)
    return where, offset, n


def pieces_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Full windows and rests: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (packed unsigned 32-bit)."""
    path = vocabulary(model)

    def run(batch):
        encode, end = library_ids(path), np.array([end_id], "<u4").tobytes()
        rows = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []} | ({"ids": []} if with_ids else {})
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = memoryview(encode(t.as_py()) + end)
            n = len(ids) // 4
            for start in range(0, n, window):
                piece = ids[4 * start : 4 * (start + window)]
                for k, v in (("doc_id", d), ("start", start), ("length", len(piece) // 4), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", n)):
                    rows[k].append(v)
                if with_ids:
                    rows["ids"].append(bytes(piece))
        return rows

    src = texts_of(df, id_col, text_col)
    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, start and length (1 to window)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType

    schema = pieces.schema.add("sequence_id", LongType()).add("offset", LongType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        share = [b for b in batches if b.num_rows]
        if not share:
            return
        rows = pa.Table.from_batches(share)
        where, offset, _ = best_fit_decreasing(rows["length"].to_numpy(), window)
        ids = (TaskContext.get().partitionId() << 40) + where
        rows = rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))
        yield from rows.cast(arrow).to_batches(max_chunksize=10_000)

    # Within a share the order of equal lengths must not depend on which shuffle block came first.
    return pieces.repartition("doc_id", "start", "ids_crc32").sortWithinPartitions("doc_id", "start", "ids_crc32").mapInArrow(run, schema)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces with sequence_id and offset, and their ids if asked for."""
    pieces = pieces_of(df, id_col, text_col, model, window, end_id, with_ids)
    if not with_ids:
        return pack(pieces, window)
    # Written, so that each piece has a number that stays, and texts are encoded once.
    held = Scratch(df.sparkSession, "packing").keep(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces", compression="zstd")
    packed = pack(held.drop("ids"), window)
    return packed.join(held.select("piece", "ids"), "piece").select(*pieces.columns, "sequence_id", "offset")


def padding(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, tokens, padding (tokens that fill sequences up to the window, but for lengths that are a power of two), share of padding."""
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    total = sums.agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.expr("n & (n - 1)") == 0, 0).otherwise(window - F.col("n"))), F.lit(0)).alias("padding"))
    return total.withColumn("share", F.coalesce(F.try_divide(F.col("padding").cast("double"), F.col("padding") + F.col("tokens")), F.lit(0.0)))


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """One row a sequence: sequence_id, length, ids (packed, padded to the window unless the length is a power of two). Needs pieces with ids."""
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))  # a window's pieces: bounded by its size

    def run(batch):
        pad, out = np.array([pad_id], "<u4").tobytes(), []
        for n, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out.append(b"".join(x["ids"] for x in held) + (b"" if n & (n - 1) == 0 else pad * (window - n)))
        return {"sequence_id": batch.column(0), "length": batch.column(1), "ids": out}

    return map_batches(held, run, "sequence_id bigint, length bigint, ids binary")
