"""Repeated substrings by a suffix array that sampled splitters deal over buckets.

Every byte covered by a string of MATCH bytes that also starts anywhere else goes. A suffix is judged by its first
MATCH bytes, so that two equal ones stand side by side in the sorted order of suffixes.

Most suffixes never reach the sort. Each start belongs to an anchor: the leftmost of the least hashes among the
ANCHOR-byte strings inside its MATCH bytes, which equal starts share. Runs of starts with one anchor are blocks.
  * A block whose anchor string is found nowhere else has no repeated start.
  * A block that is found again whole has repeated starts only. Where that happens within one slice of texts, as with a
    line that a text repeats, the slice tells all its places itself and passes on one of them with their number, so
    that rows grow with the slices a content lies in, not with its places.
  * The rest is sorted: one block of each content, start by start. The suffixes' leading tokens (the first 8 bytes,
    then a hash of those that follow up to MATCH) and places are range-partitioned by sampled splitters, each bucket
    is sorted by multikey quicksort and compared with its neighbours in order, and the first and last tokens of each
    bucket are compared with those of other buckets. Ties are broken by place, so that one frequent string can fill
    many buckets. Where tokens are equal, the bytes are compared: each found start has a partner of equal tokens,
    starts in a row with partners in a row are one comparison, and starts whose partner differs (two strings with one
    hash) are grouped by their bytes.

Strings never cross documents. A null text is empty; texts under MATCH bytes lose nothing. Rows that repeat, with
doc_id or without, are documents of their own, so their texts repeat one another. An empty table gives an empty
result. Names of other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Scratch, cached, encoded, map_batches, ranges, release_shuffles, started, trimmed, unused
from .text_kernels import mixed

MATCH = 200
ANCHOR = 75
#: Suffixes in a bucket, about.
BUCKET = 500_000
#: Starts in a block at most: they are held as bits of two words.
STARTS = 126
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Places in a slice take 23 bits, the hash above them 41.
_PLACE = np.uint64(0x7FFFFF)


@cached
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Rolling:
    """Hashes of substrings of one array of bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(1 << max(20, len(data).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def all_of(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.down[start])


def _least(key: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Running minima that make the minimum of any window: min(second[i], first[i + window - 1])."""
    padded = np.full(-(-len(key) // window) * window + window, ~np.uint64(0))
    padded[: len(key)] = key
    grid = padded.reshape(-1, window)
    return np.minimum.accumulate(grid, axis=1).reshape(-1), np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)


def blocks_of(pieces: list[bytes], match: int = MATCH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Blocks of starts: piece, first start and number of starts, place of the anchor after the first start, hash of the anchor string and of the block's bytes."""
    size = np.array([len(p) for p in pieces], np.int64)
    at = np.cumsum(size) - size
    starts_of = np.maximum(size - match + 1, 0)
    if not starts_of.sum():
        return {k: np.empty(0, t) for k, t in (("piece", np.int64), ("first", np.int64), ("count", np.int64), ("anchor", np.int64), ("h", np.uint64), ("c", np.uint64))}
    raw = b"".join(pieces)
    rolling = Rolling(np.frombuffer(raw, np.uint8))
    h = rolling.all_of(anchor)
    window = match - anchor + 1
    ahead, behind = _least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), window)
    piece = np.repeat(np.arange(len(pieces)), starts_of)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(starts_of) - starts_of, starts_of) + at[piece]
    place = (np.minimum(behind[start], ahead[start + window - 1]) & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])]))
    first, count = start[new], np.diff(np.append(new, len(start)))
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    c = np.array([digest(view[a:z]) for a, z in zip(first.tolist(), (first + count + match - 1).tolist())], np.uint64)
    return {"piece": piece[new], "first": first - at[piece[new]], "count": count, "anchor": place[new] - first, "h": h[place[new]], "c": c}


def same_blocks(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each pair of h and c, in order, and for each row how many have its pair."""
    order = np.lexsort((c, h))
    run = np.flatnonzero(np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]])])[: len(h)])
    n = np.diff(np.append(run, len(h)))
    of = np.empty(len(h), np.int64)
    of[order] = np.repeat(n, n)
    return np.sort(order[run]), of


def _pieces(texts: list[bytes], match: int, most: int = SLICE_BYTES):
    """Slices of (index of the text, offset in it, bytes); a longer text is cut into pieces that overlap by match - 1 bytes."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - match + 1), most):
            held.append((i, at, t[at : at + most + match - 1]))
            size += len(held[-1][2])
            if size >= most // 2:
                yield held
                held, size = [], 0
    if held:
        yield held


def multikey_quicksort(keys: np.ndarray, small: int = 4096) -> np.ndarray:
    """The order of the rows of keys (a column for each token): three-way partition by one token at a time, going on with the next where it is equal."""
    order = np.arange(len(keys))
    todo = [(0, len(keys), 0)]
    while todo:
        a, z, depth = todo.pop()
        part = order[a:z]
        if z - a <= small:
            order[a:z] = part[np.lexsort(keys[part, depth:].T[::-1])]
            continue
        token = keys[part, depth]
        sample = np.sort(token[:: max(1, (z - a) // 31)])
        pivot = sample[len(sample) // 2]
        under, over = token < pivot, token > pivot
        same = ~(under | over)
        order[a:z] = np.concatenate([part[under], part[same], part[over]])
        x, y = a + int(under.sum()), z - int(over.sum())
        todo += [(a, x, depth), (y, z, depth)]
        if depth + 1 < keys.shape[1]:
            todo.append((x, y, depth + 1))
    return order


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a hash of the text beside it as key, text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


_KEY = "d.doc_id <=> s.doc_id AND d.text_key = s.text_key"


def repeated_spans(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text_key, spans: for each document with any, an array of start * 1024 + length of covering byte ranges, which may overlap."""
    if match - anchor >= STARTS:
        raise ValueError(f"a block holds {STARTS} starts at most")
    docs = _keyed(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def anchors(batch):
        texts = encoded(batch.column(2).to_pylist())
        for held in _pieces(texts, match):
            found = blocks_of([p for _, _, p in held], match, anchor)
            index, offset = (np.array([x[k] for x in held], np.int64)[found["piece"]] for k in (0, 1))
            first, n = same_blocks(found["h"], found["c"])
            at, size = found["first"] + offset, found["count"] - 1
            own = pa.array(index[first])
            yield {"doc_id": batch.column(0).take(own), "text_key": batch.column(1).take(own), "h": found["h"][first].view(np.int64), "c": found["c"][first].view(np.int64), "place": (at << 8 | size)[first], "n": n[first], "held": [None] * len(first)}
            told = np.flatnonzero(n > 1)
            if len(told):
                new = np.flatnonzero(np.concatenate([[True], index[told[1:]] != index[told[:-1]]]))
                own, none = pa.array(index[told[new]]), pa.nulls(len(new), pa.int64())
                yield {"doc_id": batch.column(0).take(own), "text_key": batch.column(1).take(own), **dict.fromkeys(("h", "c", "place", "n"), none), "held": np.split((at * 1024 + size + match)[told], new[1:])}

    # Rows of one content of a slice (n: its places there), and of one text whose blocks the slice itself has found again (held: their spans).
    both = scratch.keep(map_batches(docs, anchors, f"doc_id {kind}, text_key bigint, h bigint, c bigint, place bigint, n bigint, held array<bigint>"), "blocks")
    blocks, told = both.filter("h IS NOT NULL").drop("held"), both.filter("h IS NULL").select("doc_id", "text_key", "held")
    # Anchors found twice or more, and whether with one content only.
    # Written, so that the join shuffles both its sides itself and can split a frequent string.
    twice = scratch.keep(blocks.groupBy("h").agg(F.sum("n").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("n > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "twice")
    # One content in one slice: told there.
    shared = scratch.keep(blocks.join(twice, "h").filter("mixed OR n = 1"), "shared")
    contents = scratch.keep(shared.filter("mixed").groupBy("h", "c").agg(F.sum("n").alias("n"), *(F.first(x).alias(x) for x in ("doc_id", "text_key", "place"))).withColumn("block", F.monotonically_increasing_id()), "contents")
    # Blocks of a mixed anchor are found again whole where their content is; a semi join keeps rows and never adds any.
    again = shared.filter("mixed AND n = 1").join(contents.filter("n > 1").select("h", "c"), ["h", "c"], "left_semi")
    whole = shared.filter("NOT mixed").unionByName(again.select(*shared.columns))
    covering = (F.shiftright("place", 8) * 1024 + F.col("place").bitwiseAND(F.lit(255)) + match).alias("span")
    scratch.keep(whole.select("doc_id", "text_key", F.array(covering).alias("held")).unionByName(told), "whole")
    scratch.drop("blocks", "shared", "twice")
    release_shuffles(scratch.spark)

    # The bytes of one block of each content, from its document.
    wanted = contents.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("block", "place", (F.col("n") == 1).alias("open"))).alias("wanted"))
    met = docs.alias("d").join(wanted.alias("s"), F.expr(_KEY)).select("d.text", "s.wanted")

    def cut(batch):
        out = {"block": [], "data": [], "open": []}
        size = 0
        for t, wanted in zip(batch.column(0), batch.column(1)):
            raw = encoded([t.as_py()])[0]
            for w in wanted.as_py():
                a = w["place"] >> 8
                out["block"].append(w["block"])
                out["open"].append(w["open"])
                out["data"].append(raw[a : a + (w["place"] & 255) + match])
                size += match
            if size > 16 << 20:
                yield out
                out, size = {"block": [], "data": [], "open": []}, 0
        yield out

    cuts = scratch.keep(map_batches(met, cut, "block bigint, data binary, open boolean"), "cuts")
    if cuts.count() > contents.count():  # rows that repeat doc_id and text give a block more than once
        cuts = scratch.keep(cuts.groupBy("block").agg(F.first("data").alias("data"), F.first("open").alias("open")), "cuts-once")
    starts = _repeated_starts(cuts, scratch, match)
    of_doc = F.expr("transform(runs, r -> (first + r.start) * 1024 + r.size)").alias("held")
    opened = starts.join(contents.select("block", "doc_id", "text_key", F.shiftright("place", 8).alias("first")), "block").select("doc_id", "text_key", of_doc)
    spans = scratch.spark.read.parquet(scratch.path("whole")).unionByName(opened)
    # Rows that repeat doc_id and text bring the same spans, though not always in the same arrays: each is held once.
    return spans.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_set("held"))).alias("spans"))


def leading_token(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as integers in the order of the bytes."""
    words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    return (words[at].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _repeated_starts(cuts: DataFrame, scratch: Scratch, match: int) -> DataFrame:
    """From blocks (block, data, open): block, runs (start and size of byte ranges that cover the open blocks' repeated starts)."""
    if match <= 8:
        raise ValueError("strings of over 8 bytes are compared")
    total = cuts.agg(F.sum(F.length("data") - match + 1)).first()[0] or 0

    def suffixes(batch):
        data = batch.column(1).to_pylist()
        block, open_ = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        for a, b in ranges([len(x) for x in data], SLICE_BYTES):
            raw = b"".join(data[a:b])
            size = np.array([len(x) for x in data[a:b]], np.int64)
            rolling = Rolling(np.frombuffer(raw, np.uint8))
            n = size - match + 1
            owner = np.repeat(np.arange(len(size)), n)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            at = inside + (np.cumsum(size) - size)[owner]
            place = block[a + owner] << 8 | inside
            yield {"t0": leading_token(raw, at), "t1": rolling.at(at + 8, match - 8).view(np.int64), "place": np.where(open_[a + owner], place, -1 - place)}

    rows = map_batches(cuts, suffixes, "t0 bigint, t1 bigint, place bigint").repartitionByRange(max(1, -(-total // BUCKET)), "t0", "t1", "place")
    kinds = {"place": pa.int64(), "partner": pa.int64(), "t0": pa.int64(), "t1": pa.int64(), "n": pa.int64()}

    def bucket(batches):
        started(__name__)
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        # Signed order as the splitters have it.
        keys = np.stack([t["t0"].to_numpy(), t["t1"].to_numpy()], 1)
        place = t["place"].to_numpy()
        del held, t
        order = multikey_quicksort(keys)
        keys, place = keys[order], place[order]
        run = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        n = np.diff(np.append(run, len(keys)))
        at = np.where(place < 0, -1 - place, place)
        least, most = np.minimum.reduceat(at, run), np.maximum.reduceat(at, run)
        found = np.flatnonzero(np.repeat(n > 1, n) & (place >= 0))
        of = np.repeat(np.arange(len(run)), n)[found]
        partner = np.where(at[found] == least[of], most[of], least[of])
        for a in range(0, len(found), 100_000):
            some = found[a : a + 100_000]
            yield pa.RecordBatch.from_pydict({"place": place[some], "partner": partner[a : a + 100_000]} | {k: pa.nulls(len(some), pa.int64()) for k in ("t0", "t1", "n")}, schema=pa.schema(kinds))
        ends = sorted({0, len(run) - 1})
        alone = np.where(n[ends] == 1, place[run[ends]], least[ends])
        yield pa.RecordBatch.from_pydict({"place": alone, "partner": most[ends], "t0": keys[run[ends], 0], "t1": keys[run[ends], 1], "n": n[ends]}, schema=pa.schema(kinds))
        del keys, place, order, at, found, partner
        trimmed()

    found = scratch.keep(rows.mapInArrow(bucket, "place bigint, partner bigint, t0 bigint, t1 bigint, n bigint"), "found")
    release_shuffles(scratch.spark)
    # The first and last tokens of each bucket: two rows a bucket, of which those that stood alone may have met another bucket's.
    edges = found.filter("n IS NOT NULL").withColumn("least", F.expr("CASE WHEN place < 0 THEN -1 - place ELSE place END"))
    across = edges.groupBy("t0", "t1").agg(F.sum("n").alias("all"), F.min("least").alias("lo"), F.max("partner").alias("hi")).filter("all > 1")
    met = edges.filter("n = 1 AND place >= 0").join(across, ["t0", "t1"]).selectExpr("place", "CASE WHEN place = lo THEN hi ELSE lo END AS partner")
    again = found.filter("n IS NULL").select("place", "partner").unionByName(met)
    return _compared(again, cuts, scratch, match)


def _compared(again: DataFrame, cuts: DataFrame, scratch: Scratch, match: int) -> DataFrame:
    """block, runs (start, size) of the starts that equal their partners byte for byte."""
    pairs = again.selectExpr("shiftright(place, 8) AS block", "CAST(place & 255 AS INT) AS inside", "shiftright(partner, 8) AS other", "CAST((partner & 255) - (place & 255) AS INT) AS shift")
    half = STARTS // 2
    bits = pairs.groupBy("block", "other", "shift").agg(
        F.expr(f"bit_or(CASE WHEN inside < {half} THEN shiftleft(1L, inside) ELSE 0L END)").alias("low"),
        F.expr(f"bit_or(CASE WHEN inside >= {half} THEN shiftleft(1L, inside - {half}) ELSE 0L END)").alias("high"),
    )
    listed = bits.selectExpr("block", "other", "shift", f"filter(sequence(0, {STARTS - 1}), i -> (CASE WHEN i < {half} THEN shiftright(low, i) ELSE shiftright(high, i - {half}) END) & 1 = 1) AS inside")
    listed = scratch.keep(listed.withColumns({"first": F.col("inside")[0], "row": F.expr("element_at(inside, -1) - inside[0] + 1 = size(inside)")}), "listed")
    both = listed.join(cuts.select("block", F.col("data").alias("x")), "block").join(cuts.select(F.col("block").alias("other"), F.col("data").alias("y")), "other")
    one = f"substring(x, i + 1, {match}) = substring(y, i + shift + 1, {match})"
    whole = f"row AND substring(x, first + 1, size(inside) - 1 + {match}) = substring(y, first + shift + 1, size(inside) - 1 + {match})"
    equal = scratch.keep(both.selectExpr("block", "other", "shift", "inside", f"CASE WHEN {whole} THEN inside ELSE filter(inside, i -> {one}) END AS equal"), "equal")
    scratch.drop("listed", "found")
    release_shuffles(scratch.spark)
    runs = f"CASE WHEN element_at(equal, -1) - equal[0] + 1 = size(equal) THEN array(struct(equal[0] AS start, size(equal) - 1 + {match} AS size)) ELSE transform(equal, i -> struct(i AS start, {match} AS size)) END"
    sure = equal.filter("size(equal) > 0").select("block", F.expr(runs).alias("runs"))
    torn = equal.filter("size(equal) < size(inside)")
    if torn.isEmpty():
        return sure
    # Different strings with one hash: what differs from its partner is grouped by its bytes, and partners count by whom they equal.
    apart = torn.select("block", F.explode(F.array_except("inside", "equal")).alias("i")).join(cuts.filter("open").select("block", "data"), "block").select("block", "i", F.expr(f"substring(data, i + 1, {match})").alias("s"))
    same = apart.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("s")
    grouped = apart.join(same, "s", "left_semi").selectExpr("block", f"array(struct(i AS start, {match} AS size)) AS runs")
    partners = equal.selectExpr("other AS block", f"transform(equal, i -> struct(i + shift AS start, {match} AS size)) AS runs").join(cuts.filter("open").select("block"), "block", "left_semi")
    return sure.unionByName(grouped).unionByName(partners)


def covered(spans: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs."""
    s = np.sort(np.array(spans, np.int64))
    start, end = s >> 10, np.maximum.accumulate((s >> 10) + (s & 1023))
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def removal_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = repeated_spans(df, Scratch(df.sparkSession, "suffixes"), id_col, text_col, match)
    joined = _keyed(df, id_col, text_col).alias("d").join(spans.alias("s"), F.expr(_KEY), "left").select("d.doc_id", "d.text", "s.spans")

    def run(batch):
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for t, s in zip(batch.column(1), batch.column(2)):
            raw, spans = encoded([t.as_py()])[0], s.values.to_numpy() if s.is_valid else ()
            kept, removed, n = cut_spans(raw, spans)
            for k, x in zip(out, (len(raw), removed, n, hashlib.sha256(kept).hexdigest())):
                out[k].append(x)
        return {"doc_id": batch.column(0)} | out

    return map_batches(joined, run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def cut_spans(raw: bytes, spans) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    if not len(spans):
        return raw, 0, 0
    start, end = covered(spans)
    at = np.concatenate([[0], end]).tolist()
    to = np.append(start, len(raw)).tolist()
    return b"".join(raw[a:z] for a, z in zip(at, to)), int((end - start).sum()), len(start)


def cut_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH) -> DataFrame:
    """All columns of df with the repeated bytes gone from the text; a character cut in half goes whole. A null text stays null."""
    spans = repeated_spans(df, Scratch(df.sparkSession, "suffixes"), id_col, text_col, match)
    own, key, found = unused(df, "own_id", "text_key", "spans")
    keyed = df.withColumns({own: F.col(id_col), key: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    met = keyed.select(F.struct(*df.columns).alias("row"), F.col(own).alias("a_id"), F.col(key).alias("a_key")).join(spans.selectExpr("doc_id AS b_id", "text_key AS b_key", f"spans AS `{found}`"), F.expr("a_id <=> b_id AND a_key = b_key"), "left")
    joined = met.select("row.*", found)
    names, place = df.columns, df.columns.index(text_col)

    def run(batch):
        texts = batch.column(place).to_pylist()
        for i, s in enumerate(batch.column(len(names))):
            if s.is_valid:
                texts[i] = cut_spans(encoded([texts[i]])[0], s.values.to_numpy())[0].decode("utf-8", "ignore")
        return {f: texts if k == place else batch.column(k) for k, f in enumerate(names)}

    return map_batches(joined, run, df.schema)
