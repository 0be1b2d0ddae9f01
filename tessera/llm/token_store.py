"""Token-id files: canonical length-limited Huffman codes from global counts, in independent blocks.

A store is two tables in one folder: `codebook` (one row: the code length of each id) and `blocks` (one row a
block, in ascending order of doc_id within a shard, shards in ascending order). A block's payload is a file of its own:

    magic TKH1 | documents u32 | tokens u64 | checkpoint step u32 | bits u64
    doc ids i64 each, 1 byte each for null, tokens of each u64
    bits between checkpoints, u32 each
    the codes, most significant bit first

With the checkpoints a reader starts in the middle; decoding steps through all stretches at once, one table
look-up for each stretch and step. Blocks end where documents end, so a document needs no second block.

Ids are those of the tokenizers library. Where a file's merges can be rebuilt as byte ranks they are run by tiktoken's
loop over them (vocab.Merges says when, tests hold it against the library); else the library itself encodes.

Documents with a null text hold the end id alone. Null doc_ids come first. Rows with the same doc_id are kept,
in any order among themselves. An empty table makes a store without blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, few, map_batches, started, trimmed
from .vocab import library, library_ids, vocabulary

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK_TOKENS = 1 << 18
#: Shards' starts are broadcast up to this many.
SHARDS = 100_000
STEP = 128
LIMIT = 18
MAGIC = b"TKH1"
_HEAD = struct.Struct("<4sIQIQ")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most `limit` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of over {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves, n = counts[order].astype(np.int64), len(order)
    level, from_leaf = np.empty(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([leaves, level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        from_leaf.append(rank < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(from_leaf):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of given lengths, and the table that decodes them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.bits = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        room = 1 << (self.bits - self.lengths[order].astype(np.int64))
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = (np.cumsum(room) - room) >> (self.bits - self.lengths[order].astype(np.int64))
        table = np.zeros(1 << self.bits, np.uint32)
        if len(order):
            table[: room.sum()] = np.repeat(order.astype(np.uint32) << 8 | self.lengths[order], room)
        self.table = table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """The stream, the bits of each stretch, and their sum."""
        size = self.lengths[ids].astype(np.int64)
        if len(ids) and not size.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(size)
        if not len(ids):
            return b"", np.empty(0, np.uint32), 0
        starts, codes = ends - size, self.codes[ids]
        marks = np.append(starts[::STEP], ends[-1])
        word, over = starts >> 6, (starts & 63) + size - 64
        high = np.where(over > 0, codes >> np.maximum(over, 0).astype(np.uint64), codes << np.maximum(-over, 0).astype(np.uint64))
        out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        cross = np.flatnonzero(over > 0)
        out[word[cross] + 1] |= codes[cross] << (64 - over[cross]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], np.diff(marks).astype(np.uint32), int(ends[-1])

    def decode(self, data: bytes, n: int, stretches: np.ndarray) -> np.ndarray:
        out = np.empty((len(stretches), STEP), np.uint32)
        buffer = data + bytes(8)
        at = np.ndarray((len(buffer) - 3,), ">u4", buffer, strides=(1,))
        position, last = np.cumsum(stretches.astype(np.int64)) - stretches, n - STEP * (len(stretches) - 1)
        drop = np.uint32(32 - self.bits)
        for step in range(STEP):
            if step == last:
                position = position[:-1]
            if not len(position):
                break
            peek = (at[position >> 3].astype(np.uint32) << (position & 7).astype(np.uint32)) >> drop
            got = self.table[peek]
            out[: len(position), step] = got >> 8
            position = position + (got & 255)
        return out.reshape(-1)[:n]


def write_block(book: Codebook, doc_ids: list, sizes: list, ids: np.ndarray) -> bytes:
    stream, stretches, bits = book.encode(ids)
    n = len(doc_ids)
    return b"".join((_HEAD.pack(MAGIC, n, len(ids), STEP, bits), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), np.array(sizes, "<u8").tobytes(), stretches.astype("<u4").tobytes(), stream))


def read_block(book: Codebook, payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc ids, tokens of each, all ids."""
    magic, n, tokens, step, bits = _HEAD.unpack_from(payload)
    if magic != MAGIC or step != STEP:
        raise ValueError("not a token block")
    at = _HEAD.size
    docs = np.frombuffer(payload, "<i8", n, at).tolist()
    null = payload[at + 8 * n : at + 9 * n]
    sizes = np.frombuffer(payload, "<u8", n, at + 9 * n)
    marks = np.frombuffer(payload, "<u4", -(-tokens // STEP), at + 17 * n)
    body = payload[at + 17 * n + 4 * len(marks) :]
    if len(body) != (bits + 7) // 8:
        raise ValueError("a token block is cut off")
    return [None if z else d for d, z in zip(docs, null)], sizes, book.decode(body, tokens, marks) if tokens else np.empty(0, np.uint32)


def _token_blocks(df: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """Sorted documents as blocks of plain ids: shard, shard_start, doc_ids, sizes, ids."""
    kind = "<u2" if library(path).get_vocab_size() <= 1 << 16 else "<u4"
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        import pyarrow as pa

        started(__name__)
        encode, shard, before = library_ids(path), TaskContext.get().partitionId(), 0
        end, docs, blobs, size = np.array([end_id], "<u4").tobytes(), [], [], 0

        def block():
            ids = np.frombuffer(b"".join(blobs), "<u4").astype(kind).tobytes()
            return pa.RecordBatch.from_pydict({"shard": [shard], "shard_start": [before], "doc_ids": [docs], "sizes": [[len(b) // 4 for b in blobs]], "ids": [ids]}, schema=arrow)

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(d)
                blobs.append(encode(t.as_py()) + end)
                size += len(blobs[-1]) // 4
                if size >= BLOCK_TOKENS:
                    yield block()
                    before, docs, blobs, size = before + size, [], [], 0
        if docs:
            yield block()
        trimmed()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "shard int, shard_start bigint, doc_ids array<bigint>, sizes array<bigint>, ids binary"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    return src.mapInArrow(run, ddl)


def write_store(spark: SparkSession, df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", model: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Writes the tables `codebook` and `blocks` into the scratch folder."""
    path = vocabulary(model)
    size = max(library(path).get_vocab_size(), end_id + 1)
    wide = "<u2" if library(path).get_vocab_size() <= 1 << 16 else "<u4"
    ids = scratch.keep(_token_blocks(df, id_col, text_col, path, end_id), "ids", compression="zstd")

    def count(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), wide), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["id", "n"])

    # At most one row for each id of the vocabulary comes to the driver.
    counts = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(scratch.path("codebook"))
    packed = lengths.tobytes()

    def run(batch):
        book = _book(packed)
        for i in range(batch.num_rows):
            shard, start, docs, sizes, blob = (c[i].as_py() for c in batch.columns)
            raw = np.frombuffer(blob, wide).astype(np.uint32)
            yield {"shard": [shard], "shard_start": [start], "n_tokens": [len(raw)], "payload": [write_block(book, docs, sizes, raw)]}

    map_batches(ids, run, "shard int, shard_start bigint, n_tokens bigint, payload binary").write.mode("overwrite").parquet(scratch.path("blocks"))
    scratch.drop("ids")


_books: dict[bytes, Codebook] = {}


def _book(lengths: bytes) -> Codebook:
    if lengths not in _books:
        _books.clear()
        _books[lengths] = Codebook(np.frombuffer(lengths, np.uint8))
    return _books[lengths]


def read_store(spark: SparkSession, scratch: Scratch, with_ids: bool = True) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (packed unsigned 32-bit)."""
    blocks = spark.read.schema("shard int, shard_start bigint, n_tokens bigint, payload binary").parquet(scratch.path("blocks"))
    lengths = bytes(spark.read.parquet(scratch.path("codebook")).first()["lengths"])
    # One row for each shard that was written, so one for each write task: its count is checked all the same.
    before = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    placed = blocks.join(few(scratch.keep(before, "shards"), SHARDS), "shard").select((F.col("before") + F.col("shard_start")).alias("start"), "payload")

    def run(batch):
        for i in range(batch.num_rows):
            docs, sizes, ids = read_block(_book(lengths), batch.column(1)[i].as_py())
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes.astype(np.int64))
            starts = ends - sizes.astype(np.int64)
            views = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
            out = {"doc_id": docs, "start": (starts + batch.column(0)[i].as_py()).tolist(), "n_tokens": sizes.astype(np.int64).tolist(), "ids_crc32": [zlib.crc32(v) for v in views]}
            yield out | ({"ids": [bytes(v) for v in views]} if with_ids else {})

    return map_batches(placed, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
