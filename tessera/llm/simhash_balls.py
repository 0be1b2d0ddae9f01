"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2h bits just if some third value is within h bits of both. So each distinct
fingerprint goes to the buckets of all values within h bits of itself, which find the values anew; equal ones meet there,
and the fingerprints behind them are verified. Fingerprints that share a value are all linked to one another, so that a chain
through them loses no class; each bucket sends on a forest of its links alone. Classes come from the forests of tasks
with a bounded number of links each, which alternating large-star and small-star steps over tables join.

Emission is dealt in rounds by parities of the value, so that the shuffle on disk at one time is a part of the whole; a
small one needs a single round.

A null or empty text has no words: its fingerprint is 0 and links like any other. Rows are documents, repeated rows
too; null doc_ids take part, and a class of null ids alone has a null id. `keep_first` keeps one row of each class, told
apart by its doc_id and its text together: the smallest doc_id (null comes last), of equal ones the text with the
smallest hash, of rows that repeat both any one. An empty table gives an empty result. Names of other columns don't
matter.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingle_links
from .common import Scratch, encoded, few, map_batches, release_shuffles, sliced, started, texts_of, trimmed, unused
from .text_kernels import mixed

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Rounds of emission at most, and the values of a round up to which one more isn't worth it.
ROUNDS = 4
ROUND_VALUES = 32 << 20
#: Links that a task joins to a forest.
TASK_LINKS = 250_000
#: Values that meet in a bucket, about; buckets of a round at least; and fingerprints that a task emits from.
BUCKET_VALUES = 1 << 21
LEAST_BUCKETS = 64
TASK_PRINTS = 1000
#: Rows that stand for classes are broadcast up to this many (some 100 bytes each); more are joined by a shuffle.
KEPT_ROWS = 200_000
_SPREAD = np.array([sum(((b >> k) & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def fingerprints(texts: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    """64 bits a text: a bit is 1 if set in over half of the shingles' hashes."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        found = t.lower().split()
        plain = b" ".join(found)
        if len(found) <= words:
            hashes.append(digest(plain, SEED)) if found else None
            sizes.append(min(1, len(found)))
            continue
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(found) - words + 1].tolist()
        hashes += [digest(plain[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
        sizes.append(len(starts))
    h, n = np.array(hashes, np.uint64), np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # Eight counters in a word, emptied before they can overflow.
    start = (np.cumsum(n) - n)[some]
    pieces = [np.arange(s, s + k, 255) for s, k in zip(start.tolist(), n[some].tolist())]
    cuts = np.concatenate(pieces)
    counts = np.empty((len(cuts), 64), np.uint8)
    raw = h.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        counts[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(_SPREAD[raw[:, byte]], cuts).view(np.uint8).reshape(-1, 8)
    first = np.cumsum([0] + [len(p) for p in pieces[:-1]])
    total = np.add.reduceat(counts.astype(np.int64), first, axis=0)
    bits = 2 * total > n[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def masks(radius: int) -> np.ndarray:
    """All 64-bit values with at most `radius` bits set."""
    one = [1 << k for k in range(64)]
    return np.array([sum(c) for r in range(radius + 1) for c in combinations(one, r)], np.uint64)


#: Fixed random bits: the parities of a value under them say its cell (round and bucket). A value is a print with a mask of the ball laid over it, so its cell is the print's cell with the mask's laid over it, and a bucket can find its own values from the prints alone.
_PARITY = np.random.default_rng(7).integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _cell_of(values: np.ndarray, cells: int) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for k in range(cells.bit_length() - 1):
        out |= (np.bitwise_count(values & _PARITY[k]) & 1).astype(np.int64) << k
    return out


def _emit(prints: np.ndarray, ball: np.ndarray, round_: int, rounds: int, buckets: int):
    """(bucket, payload) of the cells of one round, `buckets` of them or up to the next power of two. Payload: the cell, of how many, the prints with values there."""
    cells = rounds << (buckets - 1).bit_length()
    own, used = _cell_of(prints, cells), np.zeros(cells, bool)
    used[_cell_of(ball, cells)] = True
    for cell in range(round_, cells, rounds):
        held = prints[used[own ^ cell]]
        if len(held):
            yield cell // rounds, np.array([cell, cells], "<u4").tobytes() + held.astype("<u8").tobytes()


def _values_in(prints: np.ndarray, ball: np.ndarray, cell: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of each value of the prints that lies in the cell, and whose it is."""
    own, of_ball = _cell_of(prints, cells) ^ cell, _cell_of(ball, cells)
    order, ball = np.argsort(own, kind="stable"), ball[np.argsort(of_ball, kind="stable")]
    n = np.bincount(of_ball, minlength=cells)
    first = np.cumsum(n) - n
    tags, source = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    kinds, at = np.unique(own[order], return_index=True)
    for kind, members in zip(kinds.tolist(), np.split(order, at[1:]) if len(order) else []):
        part = ball[first[kind] : first[kind] + n[kind]]
        tags.append((mixed(prints[members][:, None] ^ part[None, :]) & np.uint64(0xFFFFFFFF)).reshape(-1))
        source.append(np.repeat(members, len(part)))
    return np.concatenate(tags), np.concatenate(source)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n nodes' components."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return root


def _meet(payloads: list[bytes], ball: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket: fingerprints and the least of their component in this bucket."""
    cell, cells = np.frombuffer(payloads[0], "<u4", 2).tolist()
    # A fingerprint comes once, in one payload.
    prints = np.concatenate([np.frombuffer(p, "<u8", offset=8) for p in payloads])
    tags, source = _values_in(prints, ball, cell, cells)
    key = tags << np.uint64(32) | source.astype(np.uint64)
    key.sort()
    tag, source = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    pair = np.flatnonzero(tag[1:] == tag[:-1])
    near = np.bitwise_count(prints[source[pair]] ^ prints[source[pair + 1]]) <= radius
    a, b = source[pair[near]], source[pair[near] + 1]
    # Where two different values share 32 bits, neighbours in a run needn't be linked: tell the run's values apart.
    torn = np.unique(tag[pair[~near]])
    if len(torn):
        lo, hi = np.searchsorted(tag, torn), np.searchsorted(tag, torn, side="right")
        long = hi - lo > 2
        lo, hi = lo[long], hi[long]
        for at in range(0, len(lo), 512):
            members = np.concatenate([np.arange(x, y) for x, y in zip(lo[at : at + 512], hi[at : at + 512])])
            full, owner = [], []
            for part in range(0, len(members), 2000):
                m = members[part : part + 2000]
                v = prints[source[m]][:, None] ^ ball[None, :]
                r, c = np.nonzero(mixed(v) & np.uint64(0xFFFFFFFF) == tag[m][:, None])
                full.append(v[r, c])
                owner.append(source[m][r])
            full, owner = np.concatenate(full), np.concatenate(owner)
            order = np.lexsort((owner, full))
            full, owner = full[order], owner[order]
            same = np.flatnonzero(full[1:] == full[:-1])
            a, b = np.concatenate([a, owner[same]]), np.concatenate([b, owner[same + 1]])
    once = np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
    root = _forest((once >> np.uint64(32)).astype(np.int64), (once & np.uint64(0xFFFFFFFF)).astype(np.int64), len(prints))
    tied = np.flatnonzero(root != np.arange(len(prints)))
    return prints[tied], prints[root[tied]]


def links(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """From distinct fingerprints (column fp, bigint): links a, b whose components are those of all pairs within radius bits."""
    if radius % 2:
        raise ValueError("the radius must be even")
    ball, n = masks(radius // 2), nodes.count()
    rounds = min(ROUNDS, 1 << (max(1, -(-n * len(ball) // ROUND_VALUES)) - 1).bit_length())  # a power of two
    spark = nodes.sparkSession
    buckets = max(LEAST_BUCKETS, -(-n * len(ball) // (BUCKET_VALUES * rounds)))
    dealt = nodes.select("fp").repartition(max(1, -(-n // TASK_PRINTS)))
    paths = []
    for k in range(rounds):

        def emit(batches, k=k):
            started(__name__)
            held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
            prints = np.concatenate(held).view(np.uint64) if held else np.empty(0, np.uint64)
            for at in range(0, len(prints), TASK_PRINTS):
                found = list(_emit(prints[at : at + TASK_PRINTS], ball, k, rounds, buckets))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], names=["bucket", "payload"])
            trimmed()

        def meet(group: pa.Table) -> pa.Table:
            started(__name__)
            a, b = _meet(group["payload"].to_pylist(), ball, radius)
            trimmed()
            return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

        met = dealt.mapInArrow(emit, "bucket int, payload binary").groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")
        met.write.parquet(scratch.path(f"links{k}"))
        paths.append(scratch.path(f"links{k}"))
        release_shuffles(spark)
    return spark.read.schema("a bigint, b bigint").parquet(*paths).distinct()


def _forests(edges: DataFrame, tasks: int) -> DataFrame:
    """The links of each of so many tasks as a forest: every node but the least of its component there, with that one."""

    def run(batches):
        started(__name__)
        held = [b for b in batches if b.num_rows]
        if held:
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = _forest(at[: len(a)], at[len(a) :], len(nodes))
            tied = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_pydict({"a": nodes[tied], "b": nodes[root[tied]]})
        trimmed()

    return edges.select("a", "b").repartition(tasks).mapInArrow(run, "a bigint, b bigint")


def _star(e: DataFrame, large: bool) -> DataFrame:
    """A large-star or small-star step: neighbours of a node go to the least among them and itself."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    both = e.select(high.alias("u"), low.alias("v"))
    if large:
        both = both.unionByName(e.select(low.alias("u"), high.alias("v")))
    # Dealt anew, so that the join shuffles both its sides itself and Spark can split a hub's rows.
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    return joined.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, task_links: int = TASK_LINKS) -> DataFrame:
    """node, root (least node of the component), for the nodes of the edges a, b.

    Tasks of at most task_links links make forests of their own; one task's is the result. Else alternating large and
    small stars join the forests until nothing changes.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    run = uuid.uuid4().hex[:8]
    e = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"stars-{run}-links")
    tasks = max(1, -(-e.count() // task_links))
    e = scratch.keep(_forests(e, tasks), f"stars-{run}-0")
    scratch.drop(f"stars-{run}-links")
    k, before = 0, mark(e) if tasks > 1 else None
    while tasks > 1:
        k += 1
        e = scratch.keep(_star(_star(e, True), False), f"stars-{run}-{k}")
        now = mark(e)
        scratch.drop(f"stars-{run}-{k - 1}")
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit("near"), text)]


def prints_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, key0, key1 (of the text), fp (bigint)."""
    src = texts_of(df, id_col, text_col)
    src = src.select("doc_id", "text", *(k.alias(f"key{i}") for i, k in enumerate(text_keys(F.col("text")))))

    def run(batch):
        texts = encoded(batch.column(1).to_pylist())
        found = [np.empty(0, np.uint64), *(fingerprints(texts[a:b], words) for a, b in sliced(texts))]
        return {"doc_id": batch.column(0), "key0": batch.column(2), "key1": batch.column(3), "fp": pa.array(np.concatenate(found).view(np.int64))}

    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, key0 bigint, key1 bigint, fp bigint")


def _classes(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, words: int, radius: int, similar_sets: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two written tables: doc_id, key0, key1, fp of each row; and fp, first (the row that stands for the class) of each fingerprint."""
    if similar_sets:
        sets = scratch.keep(shingle_links.sets_of(df, id_col, text_col, words), "sets")
        prints = scratch.keep(sets.select("doc_id", "key0", "key1", "fp"), "prints")
        similar = shingle_links.set_links(sets, scratch, components)
        scratch.drop("sets")
    else:
        prints = scratch.keep(prints_of(df, id_col, text_col, words), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key0", "key1")
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min(order).alias("first")), "nodes")
    near = links(nodes, scratch, radius)
    if similar_sets:
        near = near.unionByName(similar)
    roots = components(near, scratch)
    placed = scratch.keep(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    of_root = placed.groupBy("root").agg(F.min("first").alias("first")).hint("rebalance")
    named = scratch.keep(placed.select("fp", "root").join(of_root, "root").select("fp", "first"), "named")
    scratch.drop("nodes", "placed", *(f"links{k}" for k in range(ROUNDS)))
    return prints, named


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints, named = _classes(df, Scratch(df.sparkSession, "simhash"), id_col, text_col, words, radius)
    # Both sides are tables: Spark splits a frequent fingerprint's rows in the join.
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, similar_sets: bool = False) -> DataFrame:
    """One row of df, all columns, of each class: see the module's rule.

    With similar_sets, sets of shingles with a Jaccard similarity of 0.8 or more are linked too, whatever their fingerprints.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    prints, named = _classes(df, scratch, id_col, text_col, words, radius, similar_sets)
    row = ["doc_id", "key0", "key1"]
    rows = prints.groupBy(*row).agg(F.count(F.lit(1)).alias("n"))
    first = named.select("first").distinct().select(*(F.col(f"first.{c}").alias(c) for c in row))
    same = F.expr("a.doc_id <=> b.doc_id AND a.key0 = b.key0 AND a.key1 = b.key1")
    kept = scratch.keep(first.alias("a").join(rows.alias("b"), same).select("a.*", "b.n"), "kept")
    scratch.drop("prints", "named")
    own, k0, k1, n = unused(df, "own_id", "key_0", "key_1", "times")
    keys = text_keys(F.col(text_col))
    keyed = df.withColumns({own: F.col(id_col), k0: keys[0], k1: keys[1]})
    once_each = few(kept.select(F.col("doc_id").alias("b_id"), F.col("key0").alias("b_0"), F.col("key1").alias("b_1"), F.col("n").alias("b_n")), KEPT_ROWS)
    met = keyed.select(F.struct(*df.columns).alias("row"), *(F.col(c).alias(f"a_{i}") for i, c in enumerate((own, k0, k1)))).join(once_each, F.expr("a_0 <=> b_id AND a_1 = b_0 AND a_2 = b_1"))
    if kept.filter("n > 1").isEmpty():
        return met.select("row.*")
    # Rows that repeat both doc_id and text: any one of them, summed up where they are.
    once = met.filter("b_n > 1").groupBy("b_id", "b_0", "b_1").agg(F.first("row").alias("row"))
    return met.filter("b_n = 1").select("row.*").unionByName(once.select("row.*"))
