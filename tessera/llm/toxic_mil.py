"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in the words it holds and in how they begin; a
document's score is the noisy-or of its sentences, 1 - prod(1 - p), so that document labels alone train the sentence
model, which then locates the offending sentences.

Features are whole words and their first 3 to 7 bytes, in lower case. Only features that mark label 1 (in at least
LEAST_DOCUMENTS of its documents, LEAST_LIFT times as often as elsewhere) are fitted; a sentence without any scores 0.

A null or empty text has no sentence with a word and scores 0. Rows are scored each for itself; repeated rows get
equal scores; an empty table gives an empty result, and names of other columns don't matter. Without labels of both kinds there are no features and every score is the share of label 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, encoded, keep_rows, map_batches, sliced, texts_of
from .labelled import SAMPLE_ROWS, sample
from .text_kernels import LETTER, joined, words

THRESHOLD = 0.5
#: Sentences end at these bytes.
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True
LEAST_DOCUMENTS = 3
LEAST_LIFT = 4.0
STEPS = 200
PENALTY = 2e-5
PREFIXES = (3, 4, 5, 6, 7)


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes (a column for each prefix, one for the word; 0: none), the sentence of each word, sentences of each text, and each sentence's start and end in the joined bytes."""
    data, doc_starts = joined(texts)
    cut = _STOP[data]
    cut[doc_starts[1:] - 1] = True
    ends = np.flatnonzero(cut)
    at, _, h = words(data, LETTER, prefixes=PREFIXES)
    first = np.searchsorted(ends, doc_starts[:-1])
    return h, np.searchsorted(ends, at), np.diff(np.append(first, len(ends))), np.concatenate([[0], ends[:-1] + 1]), ends


class SentenceModel:
    """Weights by sorted feature hash, and the weight of every sentence."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, empty: float = 0.0):
        self.hashes, self.weights, self.bias, self.empty = hashes, weights, bias, empty
        self.seen = np.zeros(1 << 16, bool)  # by the low bits: most words end here
        self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def matches(self, h: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a sentence and a feature that it holds, once each."""
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        row, column = np.nonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        got = h[row, column]
        place = np.minimum(np.searchsorted(self.hashes, got), len(self.hashes) - 1)
        known = self.hashes[place] == got
        pair = np.unique(sentence[row[known]] * len(self.hashes) + place[known])
        return pair // len(self.hashes), pair % len(self.hashes)

    def sentence_scores(self, h: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        where, what = self.matches(h, sentence)
        total = np.bincount(where, self.weights[what], n) + self.bias
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        p[np.bincount(where, minlength=n) == 0] = self.empty
        return p

    def scores(self, texts: list[bytes]) -> np.ndarray:
        h, sentence, of_text, _, _ = bags(texts)
        p = self.sentence_scores(h, sentence, int(of_text.sum()))
        at = np.cumsum(of_text) - of_text
        if self.empty:
            return np.maximum.reduceat(p, at)
        return 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), at))

    def offending(self, text: str, least: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """(start, end, score) in UTF-8 bytes of the sentences that score at least so much."""
        h, sentence, of_text, start, end = bags(encoded([text]))
        p = self.sentence_scores(h, sentence, int(of_text.sum()))
        return [(int(start[i]), int(end[i]), float(p[i])) for i in np.flatnonzero(p >= least)]


def _markers(texts: list[bytes], y: np.ndarray, least: int, lift: float) -> np.ndarray:
    """Features that mark label 1, by documents that hold them."""
    found = [np.empty(0, np.uint64)]
    for t in (t for t, label in zip(texts, y) if label):
        found.append(np.unique(bags([t])[0]))
    feature, n = np.unique(np.concatenate(found), return_counts=True)
    feature, n = feature[(n >= least) & (feature != 0)], n[(n >= least) & (feature != 0)]
    other = np.zeros(len(feature), np.int64)
    for t in (t for t, label in zip(texts, y) if not label):
        held = np.unique(bags([t])[0])
        place = np.minimum(np.searchsorted(feature, held), max(0, len(feature) - 1))
        if len(feature):
            other[place[feature[place] == held]] += 1
    return feature[n / y.sum() >= lift * other / (y == 0).sum()]


def objective(theta: np.ndarray, bias: float, where: np.ndarray, what: np.ndarray, doc: np.ndarray, n: int, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean noisy-or log-likelihood of documents' labels and its gradient (features, then the bias).

    Pairs where, what say which of the n sentences holds which feature; doc is each sentence's document. A document
    without sentences here has a score of 0; scores are held off 0 and 1 by e**-30 and 1e-9.
    """
    p = 1 / (1 + np.exp(-np.clip(np.bincount(where, theta[what], n) + bias, -30, 30)))
    log_clean = np.maximum(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)), -30)
    clean = np.exp(log_clean)
    value = np.where(y == 1, np.log(np.maximum(1 - clean, 1e-9)), log_clean).mean()
    d = np.where(y[doc] == 1, (clean / np.maximum(1 - clean, 1e-9))[doc] * p, -p) / len(y)
    return float(value), np.append(np.bincount(what, d[where], len(theta)), d.sum())


def fit(texts: list[str], labels: list[int], steps: int = STEPS, penalty: float = PENALTY, least: int = LEAST_DOCUMENTS, lift: float = LEAST_LIFT) -> SentenceModel:
    """Adam with soft thresholds on the mean noisy-or log-likelihood."""
    y = np.array(labels)
    none = np.empty(0, np.uint64)
    if len(set(labels)) < 2:
        return SentenceModel(none, np.empty(0), 0.0, float(y.mean()) if len(y) else 0.5)
    raw = encoded(texts)
    start = SentenceModel(_markers(raw, y, least, lift), none, 0.0)
    size = len(start.hashes)
    if not size:
        return SentenceModel(none, np.empty(0), -10.0)
    where, what, doc_of, n = [], [], [], 0
    for i, t in enumerate(raw):
        h, sentence, of_text, _, _ = bags([t])
        s, f = start.matches(h, sentence)
        rank = np.unique(s, return_inverse=True)[1]
        where.append(rank + n)
        what.append(f)
        k = int(rank.max(initial=-1)) + 1
        doc_of += [i] * k
        n += k
    where, what, doc = np.concatenate(where), np.concatenate(what), np.array(doc_of, np.int64)
    theta, bias = np.zeros(size), -3.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, steps + 1):
        _, g = objective(theta, bias, where, what, doc, n, y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
        theta = theta + step[:-1]
        bias = min(-2.0, bias + step[-1])
        theta = np.sign(theta) * np.maximum(np.abs(theta) - penalty * 100, 0)
    used = theta != 0
    return SentenceModel(start.hashes[used], theta[used], bias)


def score(df: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    src = texts_of(df, id_col, text_col)

    def run(batch):
        return {"doc_id": batch.column(0), "score": _scores(model, batch.column(1))}

    scored = map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(df: DataFrame, model: SentenceModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns, whose text scores under the threshold."""
    place = df.columns.index(text_col)
    return keep_rows(df, lambda batch: _scores(model, batch.column(place)) < threshold)


def _scores(model: SentenceModel, column) -> np.ndarray:
    texts = encoded(column.to_pylist())
    return np.concatenate([model.scores(texts[a:b]) for a, b in sliced(texts)])


def locate(df: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """A row for each offending sentence: doc_id, start, end (bytes of the UTF-8 text), sentence, score."""
    src = texts_of(df, id_col, text_col)

    def run(batch):
        out = {k: [] for k in ("doc_id", "start", "end", "sentence", "score")}
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = encoded([t])[0]
            for a, b, p in model.offending(t or "", least):
                for k, x in zip(out, (d, a, b, raw[a:b].decode("utf-8", "replace").strip(), p)):
                    out[k].append(x)
        return out

    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, start bigint, end bigint, sentence string, score double")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE_ROWS) -> SentenceModel:
    """Fits on a bounded sample (see labelled.sample)."""
    return fit(*sample(docs, labels, label, most=most))
