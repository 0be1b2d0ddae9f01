"""Token counts by the whole-token shortcut.

Offline, once on the driver, every string of the vocabulary is encoded alone; those that give one token are proven
whole and sent to the workers (as many strings as the vocabulary has at most). A pre-token that is such a string counts
1 without any merge; merges run for the rest only. Null and empty texts count 0. Rows are independent, so repeated rows
give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .common import cached, map_batches, texts_of
from .vocab import MEMO_ENTRIES, LibraryWords, Memo, vocabulary

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
END = "</w>"


@lru_cache(4)
def proven_words(path: str) -> frozenset[str]:
    """Words that stand in the vocabulary with their end, are one pre-token, and encode to one id by themselves."""
    by = LibraryWords(path)
    words = [v[: -len(END)] for v in by.lib.get_vocab() if v.endswith(END) and v.isascii()]
    return frozenset(w for w in words if by.split(w.lower()) == [w] and by.merges.count(w) == 1)


class WordCounter:
    def __init__(self, path: str, whole: frozenset[str]):
        self.by, self.whole = LibraryWords(path), whole
        self.merged = Memo(self.by.merges.count, most=MEMO_ENTRIES // 2)
        self.pieces = Memo(self._piece)

    def _piece(self, piece: str) -> int:
        split = self.by.pre_tokens(piece)
        if split is None:
            return len(self.by.whole_piece(piece))
        if len(split) == 1:  # held as a piece already
            return 1 if split[0] in self.whole else self.by.merges.count(split[0])
        rest = [w for w in split if w not in self.whole]
        return len(split) - len(rest) + sum(self.merged.values_of(rest))

    def __call__(self, text: str | None) -> int:
        return sum(self.pieces.values_of(text.split(" "))) if text else 0


@cached
def counter(path: str, whole: frozenset[str]) -> WordCounter:
    return WordCounter(path, whole)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    path = vocabulary(model)
    whole = df.sparkSession.sparkContext.broadcast(proven_words(path))

    def run(batch):
        c, texts = counter(path, whole.value), batch.column(1).to_pylist()
        n = [c(t) for t in texts]
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    src = texts_of(df, id_col, text_col)
    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
