"""Exact links between documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

SimHash balls of a few bits reach very close copies alone, so the near-duplicate stage adds these links. In any order
of all shingles, two sets of similarity 4/5 share one among the first n - ceil(4n/5) + 1 of each. So a set emits
those, equal ones meet, and pairs are verified on whole sets. The order puts frequent shingles last: their documents
are counted in a fixed number of counters (2**20, whatever the input), of which the logarithm is sent to the tasks.

A meeting place doesn't emit all its pairs. Its members are verified against one hub, and components are formed. Where
members of one place are still in different components, some of them, chosen by a hash and more in each round, are
hubs for the others; only pairs that are near enough in size, place and parities, and in different components, are
verified. Parities say of each of 1024 classes of hashes whether a set has an odd number: two sets differ by at least as
many shingles as parities, so that none of similarity 0.8 is left out. In the last round all members left apart are hubs, so no link that joins two components is lost. Equal sets are one node
throughout. Sets without words take no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Scratch, encoded, few, map_batches, ranges, release_shuffles, sliced, started, texts_of, trimmed
from .text_kernels import SPACE, joined, mixed, words

COUNTER_BITS = 20
BLOCKS = 64
#: Bits of a set's parities.
PARITIES = 1024
#: First sums of counters are taken over tasks dealt into so many groups.
GROUPS = 64
#: Ids of sets are broadcast up to this many (some 24 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Pairs are verified in so many rounds, or in one if they are no more than these.
ROUNDS = 2
ROUND_PAIRS = 50_000
#: Hashes of sets that a kernel handles at once.
SLICE_HASHES = 1 << 18
#: Members left apart get about one hub a place at first; each round has so many times the hubs of the one before.
MORE_HUBS = 16
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 65, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = ~SPACE


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles, ascending in each text, and how many each text has. Fewer words than `size`: one shingle of all; none: none."""
    data, starts = joined(texts)
    at, _, w = words(data, _WORD)
    doc = np.searchsorted(starts, at, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))[: len(texts)]
    first = np.cumsum(n) - n
    full = np.flatnonzero(np.arange(len(w)) - first[doc] + size <= n[doc])
    h = np.zeros(len(full), np.uint64)
    for k in range(size):
        h += w[full + k] * _FACTORS[k]
    short = np.flatnonzero((n > 0) & (n < size))
    whole = n[short].astype(np.uint64) * _FACTORS[64]
    for k in range(size - 1):
        inside = k < n[short]
        whole[inside] += w[first[short[inside]] + k] * _FACTORS[k]
    h, owner = mixed(np.concatenate([h, whole])), np.concatenate([doc[full], short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))


def parities(h: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """For each set whether it holds an odd number of shingles of each class of hashes, as words of 64 bits."""
    place = np.repeat(np.arange(len(n)), n) * PARITIES + (h & np.uint64(PARITIES - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=len(n) * PARITIES) & 1).astype(np.uint8).reshape(len(n), PARITIES)
    words = np.packbits(odd, axis=1, bitorder="little").view(np.int64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (PARITIES // 64), pa.int32()), pa.array(words))


def sets_of(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, key0, key1 (of the text), fp, n, d0, d1 (128 bits that name the set), parities, hashes, uid (of the row, once written)."""
    from .simhash_balls import fingerprints, text_keys

    src = texts_of(df, id_col, text_col)
    src = src.select("doc_id", "text", *(k.alias(f"key{i}") for i, k in enumerate(text_keys(F.col("text")))))

    def run(batch):
        texts = encoded(batch.column(1).to_pylist())
        for a, b in sliced(texts):
            h, n = shingle_sets(texts[a:b], size)
            ends = np.concatenate([[0], np.cumsum(n)])
            names = []
            for salt in (1, 2):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h * _FACTORS[salt] + np.uint64(salt)))])
                names.append(pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64)))
            yield {"doc_id": batch.column(0).slice(a, b - a), "key0": batch.column(2).slice(a, b - a), "key1": batch.column(3).slice(a, b - a), "fp": pa.array(fingerprints(texts[a:b], size).view(np.int64)), "n": pa.array(n, pa.int32()), "d0": names[0], "d1": names[1], "parities": parities(h, n), "hashes": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))}

    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, key0 bigint, key1 bigint, fp bigint, n int, d0 bigint, d1 bigint, parities array<bigint>, hashes array<bigint>").withColumn("uid", F.monotonically_increasing_id())


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a list column, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(column.offsets.to_numpy())


def _gathered(rows: DataFrame, size: int, kind: type, mark: Callable[[np.ndarray, pa.RecordBatch], None], join: np.ufunc) -> np.ndarray:
    """An array of fixed size that each task marks for its rows, joined over tasks: first in GROUPS groups, then over these."""
    block, ddl = size // BLOCKS, "part int, block int, held binary"

    def own(batches):
        started(__name__)
        total, some = np.zeros(size, kind), False
        for batch in (whole.slice(a, BATCH_ROWS) for whole in batches for a in range(0, whole.num_rows, BATCH_ROWS)):
            mark(total, batch)
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in total.reshape(BLOCKS, block)], pa.binary())], names=["part", "block", "held"])
        trimmed()

    def both(group: pa.Table) -> pa.Table:
        total = np.zeros(block, kind)
        for c in group["held"]:
            join(total, np.frombuffer(c.as_buffer(), kind), out=total)
        return pa.table({"part": pa.array([0], pa.int32()), "block": pa.array([group["block"][0].as_py()], pa.int32()), "held": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((BLOCKS, block), kind)
    # A row a block: a fixed bound.
    for r in rows.mapInArrow(own, ddl).groupBy("part", "block").applyInArrow(both, ddl).groupBy("block").applyInArrow(both, ddl).collect():
        join(out[r["block"]], np.frombuffer(r["held"], kind), out=out[r["block"]])
    return out.reshape(-1)


def frequency_classes(sets: DataFrame) -> np.ndarray:
    """For each counter the binary logarithm of how many shingles of sets fall on it."""

    def count(total, batch):
        h, _ = _values(batch.column(0))
        for a in range(0, len(h), SLICE_HASHES):
            np.add.at(total, (h[a : a + SLICE_HASHES] >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)

    return np.ceil(np.log2(_gathered(sets.select("hashes"), 1 << COUNTER_BITS, np.int64, count, np.add) + 1)).astype(np.uint8)


def prefixes(sets: DataFrame, classes: np.ndarray) -> DataFrame:
    """h, uid, n, pos: the first shingles of each set in the order of classes."""
    packed = classes.tobytes()

    def run(batch):
        rank = np.frombuffer(packed, np.uint8)
        for a, b in ranges(np.diff(batch.column(2).offsets.to_numpy()).tolist(), SLICE_HASHES):
            h, n = _values(batch.column(2).slice(a, b - a))
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, rank[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], owner))
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            kept = np.flatnonzero(pos < np.repeat(n - (4 * n + 4) // 5 + 1, n))
            who = owner[kept]
            uid = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
            yield {"h": pa.array(h[order[kept]].view(np.int64)), "uid": pa.array(uid[who]), "n": pa.array(n[who].astype(np.int32)), "pos": pa.array(pos[kept].astype(np.int32))}

    return map_batches(sets.select("uid", "n", "hashes"), run, "h bigint, uid bigint, n int, pos int")


def _may(a_n: str, a_pos: str, b_n: str, b_pos: str) -> str:
    """Whether sizes and places allow a similarity of 4/5."""
    return f"5 * least({a_n}, {b_n}) >= 4 * greatest({a_n}, {b_n}) AND 9 * least({a_n} - {a_pos}, {b_n} - {b_pos}) >= 4 * ({a_n} + {b_n})"


def _unlike(p: str, q: str) -> str:
    """In how many classes of hashes two sets' parities differ."""
    return f"aggregate(zip_with({p}, {q}, (v, w) -> bit_count(v ^ w)), 0, (s, v) -> s + v)"


def _allowed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs x, y (uids) whose parities allow a similarity of 4/5: no other is worth the shuffle of its whole sets."""
    side = lambda k: sets.select(F.col("uid").alias(k), F.col("n").alias(f"n_{k}"), F.col("parities").alias(f"odd_{k}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    return both.filter(f"9 * {_unlike('odd_x', 'odd_y')} <= n_x + n_y").select("x", "y")


def _counted(pairs: DataFrame, asked: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs x, y whose numbers of shingles in each class of hashes allow a similarity of 4/5. Where sets are long, parities say little and these much."""

    def run(batch):
        for a, b in ranges(np.diff(batch.column(2).offsets.to_numpy()).tolist(), SLICE_HASHES):
            part = batch.slice(a, b - a)
            h, n = _values(part.column(2))
            place = np.repeat(np.arange(len(n)), n) * PARITIES + (h & np.uint64(PARITIES - 1)).astype(np.int64)
            # Numbers that don't fit are cut, which lets the difference only seem smaller.
            held = np.minimum(np.bincount(place, minlength=len(n) * PARITIES), 127).astype(np.int8)
            yield {"uid": part.column(0), "n": part.column(1), "held": pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * PARITIES, pa.int32()), pa.array(held))}

    counts = map_batches(sets.select("uid", "n", "hashes").join(asked, "uid", "left_semi"), run, "uid bigint, n int, held array<tinyint>")
    side = lambda k: counts.select(F.col("uid").alias(k), F.col("n").alias(f"n_{k}"), F.col("held").alias(f"held_{k}"))
    apart = "aggregate(zip_with(held_x, held_y, (v, w) -> abs(v - w)), 0, (s, v) -> s + v)"
    return pairs.join(side("x"), "x").join(side("y"), "y").filter(f"9 * {apart} <= n_x + n_y").select("x", "y")


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Fingerprints a, b of the pairs x, y (uids) whose sets are similar, as a table. Only sets that are in a pair are shuffled, in rounds by x's hash."""
    found, paths = scratch.keep(pairs, f"{name}-found"), []
    asked = scratch.keep(found.select(F.explode(F.array("x", "y")).alias("uid")).distinct(), f"{name}-asked")
    pairs = scratch.keep(_counted(found, few(asked, BROADCAST_IDS), sets), f"{name}-pairs")
    scratch.drop(f"{name}-found", f"{name}-asked")
    if pairs.isEmpty():
        return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))
    rounds = ROUNDS if pairs.count() > ROUND_PAIRS else 1
    for k in range(rounds):
        part = pairs.filter(F.expr(f"pmod(xxhash64(x), {rounds}) = {k}"))
        asked = scratch.keep(part.select(F.explode(F.array("x", "y")).alias("uid")).distinct(), f"{name}-asked")
        held = sets.select("uid", "fp", "n", "hashes").join(few(asked, BROADCAST_IDS), "uid", "left_semi")
        side = lambda k: held.select(F.col("uid").alias(k), F.col("fp").alias(f"fp_{k}"), F.col("n").alias(f"n_{k}"), F.col("hashes").alias(f"set_{k}"))  # noqa: B023, E731
        both = part.join(side("y"), "y").join(side("x"), "x")
        paths.append(scratch.path(f"{name}{k}"))
        both.filter("9 * size(array_intersect(set_x, set_y)) >= 4 * (n_x + n_y)").select(F.col("fp_x").alias("a"), F.col("fp_y").alias("b")).write.parquet(paths[-1])
        scratch.drop(f"{name}-asked")
        release_shuffles(sets.sparkSession)
    scratch.drop(f"{name}-pairs")
    return sets.sparkSession.read.schema("a bigint, b bigint").parquet(*paths).distinct()


def _meetings(sets: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """A table h, uid, n, pos, m, hub (uid, n, pos): the places that two sets or more share, with their members, how many, and the smallest one."""
    ids, classes = own.select("uid"), frequency_classes(sets)
    release_shuffles(sets.sparkSession)
    if own.count() <= BROADCAST_IDS:  # sets that repeat another needn't be sent to Python at all
        rows = prefixes(sets.join(F.broadcast(ids), "uid", "left_semi"), classes)
    else:
        rows = prefixes(sets, classes).join(ids, "uid", "left_semi")
    rows = scratch.keep(rows.select("h", "uid", "n", "pos"), "prefix")
    # Written, so that the join shuffles both its sides itself and Spark can split a frequent shingle.
    places = scratch.keep(rows.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("n", "uid", "pos")).alias("hub")).filter("m > 1"), "places")
    release_shuffles(sets.sparkSession)
    met = scratch.keep(rows.join(places, "h"), "met")
    scratch.drop("prefix", "places")
    release_shuffles(sets.sparkSession)
    return met


def set_links(sets: DataFrame, scratch: Scratch, components) -> DataFrame:
    """Links a, b between fingerprints: of equal sets, and of sets of similarity 4/5.

    `sets` is the written table of sets_of; `components` makes node, root from links. The links are a written table too.
    """
    some = scratch.keep(sets.filter("n > 0").groupBy("d0", "d1", "fp").agg(F.min("uid").alias("uid")), "some")
    own = scratch.keep(some.groupBy("d0", "d1").agg(F.min(F.struct("fp", "uid")).alias("own")).select("d0", "d1", F.col("own.fp").alias("own_fp"), F.col("own.uid").alias("uid")), "own")
    equal = some.join(own.select("d0", "d1", "own_fp"), ["d0", "d1"]).filter("fp <> own_fp").select(F.col("fp").alias("a"), F.col("own_fp").alias("b")).distinct()
    met = _meetings(sets, own, scratch)
    first = met.filter("uid <> hub.uid").filter(_may("n", "pos", "hub.n", "hub.pos")).select(F.col("hub.uid").alias("x"), F.col("uid").alias("y")).distinct()
    known = scratch.keep(equal.unionByName(_verified(_allowed(first, sets), sets, scratch, "hub-links")).distinct(), "known-0")
    rest, share, k = met.filter("m > 2 AND uid <> hub.uid").select("h", "uid", "n", "pos"), 1, 0
    fps = sets.select("uid", "fp")
    while True:
        # Members of one place that are in different components by now; pairs that were hub and member are settled.
        roots = components(known, scratch)
        of_uid = fps.join(roots, F.col("fp") == F.col("node"), "left").select("uid", F.coalesce("root", "fp").alias("root"))
        placed = scratch.keep(rest.join(of_uid, "uid"), f"placed-{k}")
        apart = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi").select("h", "m")
        left = scratch.keep(placed.join(apart.hint("rebalance"), "h"), f"left-{k}")
        scratch.drop(f"placed-{k}", "met", f"left-{k - 1}", f"held-{k - 1}")
        if (most := left.agg(F.max("m")).first()[0]) is None:
            break
        # What differs in more classes than sets of similarity 4/5 may differ in shingles isn't a pair.
        left = scratch.keep(left.join(sets.select("uid", "parities"), "uid"), f"held-{k}")
        hubs = left.filter(F.expr(f"pmod(xxhash64(uid, h), greatest(1, m div {share})) = 0"))
        near = hubs.alias("p").join(left.alias("q"), "h").filter("p.root <> q.root").filter(_may("p.n", "p.pos", "q.n", "q.pos")).filter(f"9 * {_unlike('p.parities', 'q.parities')} <= p.n + q.n")
        pairs = near.select(F.least("p.uid", "q.uid").alias("x"), F.greatest("p.uid", "q.uid").alias("y")).distinct()
        k += 1
        known = scratch.keep(known.unionByName(_verified(pairs, sets, scratch, f"links-{k}-")).distinct(), f"known-{k}")
        if most // share <= 1:  # all were hubs
            break
        rest, share = left.select("h", "uid", "n", "pos"), share * MORE_HUBS
    scratch.drop("some", "own", *(f"{x}-{i}" for x in ("left", "held") for i in (k - 1, k)))
    return known
