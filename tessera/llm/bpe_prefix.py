"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is one token that can end its encoding: the encoding of a prefix is that
of a shorter prefix plus this token, and two tokens can stand side by side only if merging their joined bytes
gives the same two again. The table of last tokens thus holds the encodings of all prefixes: appending extends
it, and an edit recomputes it from the edit on, until as many entries in a row as the longest token has bytes
equal the old ones.

Nulls and empty texts have no tokens; rows are independent of one another, so repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import cached, map_batches, texts_of
from .vocab import MEMO_ENTRIES, Memo, byte_pieces, pattern, read_ranks, split_regex, vocabulary

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes up to which a piece's table is filled on demand, by recursion, as only its last entry is asked for.
SHORT = 64
#: Words with their ids that a worker holds: a word costs more than most pieces.
WORD_ENTRIES = 1_000_000


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: set[bytes] = set()  # tokens whose own bytes merge to themselves
        for b, i in ranks.items():
            if len(b) == 1:
                self.halves[i] = (i, i)
                self.whole.add(b)
            elif len(two := self._merge(b, i)) == 2:
                self.halves[i] = two
                self.joined[two] = i
                self.whole.add(b)
        self.pairs: dict[int, bool] = {}

    def _merge(self, data: bytes, below: int) -> tuple[int, ...]:
        """Ids after all merges of a rank under `below`, the lowest rank first and the leftmost of equals."""
        pieces = [data[i : i + 1] for i in range(len(data))]
        while len(pieces) > 1:
            rank, at = min((self.ranks.get(pieces[i] + pieces[i + 1], below), i) for i in range(len(pieces) - 1))
            if rank >= below:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return tuple(self.ranks[p] for p in pieces)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joined bytes of a and b encode as a, b: undo merges, latest first, and look for one across the seam that would have come before."""
        known = self.pairs.get(a << 20 | b)
        if known is not None:
            return known
        x, y, bound, good = a, b, 1 << 62, True
        while True:
            if self.joined.get((x, y), bound) < bound:
                good = False
                break
            left, right = self.halves[x][1], self.halves[y][0]
            undo_left = x > y if (left != x and right != y) else left != x
            if undo_left:
                bound, x = x, left  # merges left of the seam come first among equals
            elif right != y:
                bound, y = y + 1, right
            else:
                break
        if len(self.pairs) > MEMO_ENTRIES:
            self.pairs.clear()
        self.pairs[a << 20 | b] = good
        return good

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Fills last[len(last):stop]; last[i] is the last token of the encoding of data[: i + 1]."""
        get, compatible, longest, whole = self.ranks.get, self.compatible, self.longest, self.whole
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            for start in range(max(0, end - longest), end):
                token = get(piece := data[start:end])
                if token is not None and piece in whole and (not start or compatible(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("these ranks lack single bytes")

    def _last(self, data: bytes, end: int, last: list[int]) -> int:
        """One more than the last token of data[:end]; fills only the entries that this one needs."""
        get, known, whole, compatible = self.ranks.get, self.pairs.get, self.whole, self.compatible
        for start in range(end):
            token = get(piece := data[start:end])
            if token is None or piece not in whole:
                continue
            if start:
                before = (last[start - 1] or self._last(data, start, last)) - 1
                good = known(before << 20 | token)
                if not (compatible(before, token) if good is None else good):
                    continue
            last[end - 1] = token + 1
            return token + 1
        raise ValueError("these ranks lack single bytes")

    def unwind(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """One piece, without a split by pattern."""
        if data in self.whole:
            return [self.ranks[data]]
        if len(data) <= SHORT:
            last = [0] * len(data)
            self._last(data, len(data), last)
            out, at = [], len(data)
            while at:
                out.append(last[at - 1] - 1)
                at -= len(self.bytes_of[out[-1]])
            return out[::-1]
        last = []
        self.extend(data, last)
        return self.unwind(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixState:
    """A piece with its table, for appends and edits."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytes(data), []
        bpe.extend(self.data, self.last)

    @property
    def ids(self) -> list[int]:
        return self.bpe.unwind(self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces data[start:end]; returns how many entries were computed again."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same = old[:start], 0
        while len(self.last) < len(self.data) and same < self.bpe.longest:
            i = len(self.last)
            self.bpe.extend(self.data, self.last, i + 1)
            same = same + 1 if i >= start + len(new) and self.last[i] == old[i - shift] else 0
        done = len(self.last) - start
        self.last += old[len(self.last) - shift :] if len(self.last) < len(self.data) else []
        return done


class TextCodec:
    """Whole texts, each match of the split pattern by itself."""

    def __init__(self, path: str):
        self.bpe = PrefixBpe(read_ranks(path))
        self.split = split_regex(pattern())
        self.words = Memo(lambda w: np.array(self.bpe.encode(w.encode("utf-8", "surrogatepass")), "<u4").tobytes(), most=WORD_ENTRIES)
        self.first, self.later = Memo(self._piece), Memo(self._piece, " ")
        self.table = [self.bpe.bytes_of.get(i, b"") for i in range(max(self.bpe.bytes_of) + 1)]

    def _piece(self, piece: str) -> bytes:
        return b"".join(self.words.values_of(self.split.findall(piece)))

    def encode(self, text: str | None) -> bytes:
        """Packed ids, little-endian unsigned 32-bit."""
        if not text:
            return b""
        head, *rest = byte_pieces(text)
        return b"".join((self.first.values_of([head]) if head else []) + self.later.values_of(rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cached
def codec(path: str) -> TextCodec:
    return TextCodec(path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids (packed). A null text has no tokens."""
    path = vocabulary(ranks)

    def run(batch):
        ids = [codec(path).encode(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    src = texts_of(df, id_col, text_col)
    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary")


def decode_ids(df: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", ranks: str = VOCABULARY) -> DataFrame:
    """doc_id, data (bytes). Null ids decode to no bytes."""
    path = vocabulary(ranks)

    def run(batch):
        return {"doc_id": batch.column(0), "data": [codec(path).decode(x or b"") for x in batch.column(1).to_pylist()]}

    src = df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids")
    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, data binary")


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = VOCABULARY) -> DataFrame:
    """Encodes, then decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256. In one pass, so that ids need no shuffle or disk."""
    path = vocabulary(ranks)

    def run(batch):
        c, out = codec(path), {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in batch.column(1):
            ids = c.encode(t.as_py())
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
        return out

    src = texts_of(df, id_col, text_col)
    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
