"""Line quality by a linear-chain conditional random field.

Each line gets features of its own and of its two neighbours; a chain of two labels (bad, good) joins a document's
lines. Training maximises the likelihood of the document's label on all its lines, with a penalty. A document's
score is the mean of the lines' forward-backward marginals of `good`, weighted by their lengths.

An empty or null text is a single empty line and has a score too. Rows are scored each for itself, so repeated rows
get equal scores; an empty table gives an empty result, and names of other columns don't matter. Without labels of both
kinds the score is the share of label 1 (0.5 without labels) everywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, encoded, keep_rows, map_batches, sliced, texts_of
from .labelled import SAMPLE_ROWS, sample
from .text_kernels import LETTER, SPACE, joined, words

THRESHOLD = 0.3
PENALTY = 1e-3
STEPS = 250
#: Byte classes that are counted in a line: lower, upper, beyond ASCII, digit, space, sentence marks, bars, other marks.
_KINDS = 8
_KIND = np.full(256, 7, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[128:], _KIND[48:58], _KIND[SPACE], _KIND[[44, 46, 39, 45]], _KIND[124] = 0, 1, 2, 3, 4, 5, 6
#: Upper ends of the bins of each measure.
_SHARES = np.array([1e-9, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.6])
_WORD_BYTES = np.array([2.0, 3, 4, 5, 6, 7, 9, 12])
_BYTES = np.array([0.5, 10, 30, 80, 160, 320, 640, 1280])
_BINS = [_SHARES] * 9 + [_WORD_BYTES, _BYTES, _SHARES]
_OWN = len(_BINS) * 9
#: Columns of one-hot bins for a line, the line before and the line after; last a constant.
WIDTH = 3 * len(_BINS)
FEATURES = 3 * _OWN + 2


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: the indices of its features that are 1, its weight, and per text how many lines it has."""
    data, doc_starts = joined(texts)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    line = np.repeat(np.arange(len(ends)), size + 1)
    counts = np.bincount(line * _KINDS + _KIND[data], minlength=len(ends) * _KINDS).reshape(-1, _KINDS)
    counts[:, 4] -= 1  # the line feed
    at, to, h = words(data, ~SPACE)
    word_line = line[at] if len(at) else np.empty(0, np.int64)
    n_words = np.bincount(word_line, minlength=len(ends))
    again = (h[1:] == h[:-1]) & (word_line[1:] == word_line[:-1]) if len(h) else np.empty(0, bool)
    repeats = np.bincount(word_line[1:][again], minlength=len(ends)) if len(h) else np.zeros(len(ends), np.int64)
    lettered = LETTER[data[to - 1]] if len(at) else np.empty(0, bool)  # words that end in a letter
    bare = np.bincount(word_line[lettered], minlength=len(ends)) if len(at) else np.zeros(len(ends), np.int64)
    nothing, no_word = np.maximum(size, 1), np.maximum(n_words, 1)
    first_of = np.searchsorted(starts, doc_starts[:-1])
    lines_of = np.diff(np.append(first_of, len(ends)))
    measures = [*(counts[:, k] / nothing for k in range(_KINDS)), repeats / no_word, size / no_word, size, 1 - bare / no_word]
    own = np.stack([np.searchsorted(b, m, side="left") + 9 * k for k, (b, m) in enumerate(zip(_BINS, measures))], 1)
    before, after = np.full_like(own, -1), np.full_like(own, -1)
    before[1:], after[:-1] = own[:-1] + _OWN, own[1:] + 2 * _OWN
    before[first_of] = 3 * _OWN
    after[first_of + lines_of - 1] = 3 * _OWN + 1
    return np.concatenate([own, before, after], 1), nothing.astype(float), lines_of


class LineField:
    """Weights of the features for `good` against `bad`, and scores of the four transitions."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, bias: float):
        self.weights, self.steps, self.bias = weights, steps, bias

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return sum(self.weights[column] for column in features.T) + self.bias

    def marginals(self, good: np.ndarray, lines_of: np.ndarray, importance: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, the expected transitions (a document's times its importance, if given), and the log of each document's partition.

        Documents step forward together; those with fewer lines drop out.
        """
        order = np.argsort(-lines_of, kind="stable")
        first = (np.cumsum(lines_of) - lines_of)[order]
        size = lines_of[order]
        alpha, beta = np.zeros((len(good), 2)), np.zeros((len(good), 2))
        emit = np.stack([np.zeros_like(good), good], 1)
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")  # documents with over t lines
        for t, n in enumerate(live.tolist()):
            now = first[:n] + t
            if not t:
                alpha[now] = emit[now]
            else:
                into = alpha[now - 1][:, :, None] + self.steps
                alpha[now] = np.logaddexp(into[:, 0], into[:, 1]) + emit[now]
        for t in range(len(live) - 2, -1, -1):
            now = first[: live[t + 1]] + t
            out = (emit[now + 1] + beta[now + 1])[:, None, :] + self.steps
            beta[now] = np.logaddexp(out[:, :, 0], out[:, :, 1])
        total = np.logaddexp(alpha[first + size - 1, 0], alpha[first + size - 1, 1])
        of_line = np.empty(len(good))
        back = np.empty(len(size))
        back[order] = total
        of_line = np.repeat(back, lines_of)
        inner = np.ones(len(good), bool)
        inner[np.cumsum(lines_of) - lines_of] = False
        at = np.flatnonzero(inner)
        both = np.exp(alpha[at - 1][:, :, None] + self.steps + (emit[at] + beta[at])[:, None, :] - of_line[at][:, None, None])
        pair = both.sum(0) if importance is None else np.einsum("i,ijk->jk", np.repeat(importance, lines_of)[at], both)
        return np.exp(alpha[:, 1] + beta[:, 1] - of_line), pair, back

    def scores(self, texts: list[bytes]) -> np.ndarray:
        features, weight, lines_of = line_features(texts)
        p = self.marginals(self.emissions(features), lines_of)[0]
        at = np.cumsum(lines_of) - lines_of
        return np.clip(np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at), 0, 1)


def _field(theta: np.ndarray) -> LineField:
    return LineField(theta[:FEATURES], theta[FEATURES:-1].reshape(2, 2), theta[-1])


def objective(theta: np.ndarray, features: np.ndarray, lines_of: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """The penalised log-likelihood of documents' labels on all their lines, and its gradient.

    A document counts by 1 / sqrt(its lines); these importances, summed over lines, make 1.
    """
    doc = np.repeat(np.arange(len(lines_of)), lines_of)
    importance = 1 / np.sqrt(lines_of)
    importance /= importance[doc].sum()
    field = _field(theta)
    good = field.emissions(features)
    p, pair, log_z = field.marginals(good, lines_of, importance)
    inner, label = lines_of - 1, y.astype(int)
    path = np.bincount(doc, good * y[doc], len(lines_of)) + inner * field.steps[label, label]
    seen = np.diag(np.bincount(label, inner * importance, 2))
    error = (y[doc] - p) * importance[doc]
    g = np.concatenate([sum(np.bincount(column, error, FEATURES) for column in features.T), (seen - pair).reshape(-1), [error.sum()]])
    weight = penalty / len(theta) ** 0.5
    return float(importance @ (path - log_z) - weight / 2 * theta @ theta), g - weight * theta


def fit(texts: list[str], labels: list[int], steps: int = STEPS, penalty: float = PENALTY) -> LineField:
    """Adam on the objective."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return LineField(np.zeros(FEATURES), np.zeros((2, 2)), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    raw = encoded(texts)
    found = [line_features(raw[a:b]) for a, b in sliced(raw)]
    features, lines_of = np.concatenate([f.astype(np.int16) for f, _, _ in found]), np.concatenate([n for _, _, n in found])
    del raw, found
    theta = np.zeros(FEATURES + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        _, g = objective(theta, features, lines_of, y, penalty)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return _field(theta)


def score(df: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    src = texts_of(df, id_col, text_col)

    def run(batch):
        return {"doc_id": batch.column(0), "score": _scores(field, batch.column(1))}

    scored = map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(df: DataFrame, field: LineField, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns, whose text scores at least the threshold."""
    place = df.columns.index(text_col)
    return keep_rows(df, lambda batch: _scores(field, batch.column(place)) >= threshold)


def _scores(field: LineField, column) -> np.ndarray:
    texts = encoded(column.to_pylist())
    return np.concatenate([field.scores(texts[a:b]) for a, b in sliced(texts)])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_ROWS) -> LineField:
    """Fits on a bounded sample (see labelled.sample)."""
    return fit(*sample(docs, labels, label, most=most))
