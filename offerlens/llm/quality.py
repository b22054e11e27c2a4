"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing gives every word a sparse random vector; a word's own vector is the sum of those of the words around it
in the training sample, scaled to length one. A document is the mean of its words' vectors. Words outside the sample
use a random vector of one of ``BUCKETS`` hash buckets, so nothing is skipped. Besides words, the sequence holds
punctuation runs and marks for a capitalised word and for a word that repeats the one before it.

The network (one hidden layer) is fitted in numpy on a bounded sample of labelled documents; a part of it, not used for
the fit, sets the temperature that makes its probabilities honest. Whole texts are scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import columns_of, held_out, map_texts, op, table

#: Bounds of the training sample: labelled documents, and characters of one; longer ones are not used for training.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
DIM, NONZERO, WINDOW, LEAST_COUNT, BUCKETS = 64, 6, 2, 3, 4096
HIDDEN, EPOCHS, BATCH, RATE, DECAY, CALIBRATION = 32, 60, 64, 0.01, 1e-4, 0.2
SEED = 7
#: Tokens whose vectors are in memory at a time.
CHUNK = 1 << 15

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
UPPER, SAME = "<upper>", "<same>"


@dataclass(frozen=True)
class QualityModel:
    """Vocabulary, word vectors (vocabulary, then buckets) and network; ``prior`` is the score where nothing could be fitted."""

    words: tuple[str, ...]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float | None = None


class _Ids(dict):
    """Token -> twice its id, plus one if it is written in capitals; unknown words get their bucket's id."""

    def __init__(self, words: tuple[str, ...]) -> None:
        super().__init__()
        self.known = {w: i for i, w in enumerate(words)}

    def __missing__(self, token: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        low = token.lower()
        i = self.known.get(low)
        if i is None:
            i = len(self.known) + xxhash.xxh64_intdigest(low.encode("utf-8", "replace")) % BUCKETS
        self[token] = code = 2 * i + (len(token) > 1 and token.isupper())
        return code


def _sequences(texts: list[str | None], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all texts with marks, text of each)."""
    lists = [_TOKEN.findall(t) if t else [] for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
    codes = np.array([ids[t] for x in lists for t in x], dtype=np.int64)
    word, upper = codes >> 1, (codes & 1).astype(bool)
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    marks = upper.astype(np.int64) + same
    at = np.cumsum(marks) + np.arange(len(word))  # a token comes after its marks
    out = np.zeros(len(word) + int(marks.sum()), dtype=np.int64)
    out[at] = word
    out[at[upper] - 1 - same[upper]] = ids.known.get(UPPER, 0)
    out[at[same] - 1] = ids.known.get(SAME, 0)
    return out, np.repeat(row, marks + 1)


def _pooled(ids: np.ndarray, row: np.ndarray, n: int, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text; zero where there is none."""
    total = np.zeros((n, vectors.shape[1]))
    for a in range(0, len(ids), CHUNK):
        owner = row[a : a + CHUNK]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        total[owner[first]] += np.add.reduceat(vectors[ids[a : a + CHUNK]], first, axis=0, dtype=np.float64)
    return total / np.maximum(np.bincount(row, minlength=n), 1)[:, None]


def _index_vectors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of ``n`` random index vectors."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (n, NONZERO)), rng.choice([-1.0, 1.0], (n, NONZERO))


def _word_vectors(ids: np.ndarray, row: np.ndarray, n_words: int) -> np.ndarray:
    """Context vectors of the vocabulary, then the buckets' random vectors; all of length one."""
    place, sign = _index_vectors(n_words + BUCKETS)
    context = np.zeros(n_words * DIM)
    for d in range(1, WINDOW + 1):
        near = row[d:] == row[:-d]
        for word, other in ((ids[:-d][near], ids[d:][near]), (ids[d:][near], ids[:-d][near])):
            known = word < n_words
            word, other = word[known], other[known]
            for k in range(NONZERO):
                context += np.bincount(word * DIM + place[other, k], weights=sign[other, k], minlength=n_words * DIM)
    own = np.zeros((n_words + BUCKETS, DIM))
    for k in range(NONZERO):
        np.add.at(own, (np.arange(len(own)), place[:, k]), sign[:, k])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    vectors = unit(own)
    vectors[:n_words] = unit(unit(context.reshape(n_words, DIM)) + 0.5 * vectors[:n_words])  # what a word is next to what surrounds it
    return vectors.astype(np.float32)


def _forward(x: np.ndarray, w1, b1, w2, b2) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def train(texts: list[str], labels: np.ndarray) -> QualityModel:
    """Fit on these documents; reproducible for a given order."""
    none = np.zeros(0)
    if len(texts) < 10 or len(set(labels.tolist())) < 2:
        prior = float(labels.mean()) if len(labels) else 0.5
        return QualityModel((), np.zeros((BUCKETS, DIM), np.float32), none, none, none, none, none, 0.0, 1.0, prior)
    counts: dict[str, int] = {}
    for t in texts:
        for token in _TOKEN.findall(t):
            counts[token.lower()] = counts.get(token.lower(), 0) + 1
    words = (UPPER, SAME, *sorted(w for w, c in counts.items() if c >= LEAST_COUNT))
    ids, row = _sequences(texts, _Ids(words))
    vectors = _word_vectors(ids, row, len(words))
    x = _pooled(ids, row, len(texts), vectors)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(texts))
    cut = int(len(order) * (1 - CALIBRATION))
    fit, rest = order[:cut], order[cut:]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    x, y = (x - mean) / scale, labels.astype(np.float64)
    params = [rng.normal(0, 1 / np.sqrt(DIM), (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for a in range(0, len(fit), BATCH):
            b = fit[a : a + BATCH]
            hidden, z = _forward(x[b], *params)
            dz = (_sigmoid(z) - y[b]) / len(b)
            dh = np.outer(dz, params[2]) * (1 - hidden**2)
            grads = [x[b].T @ dh + DECAY * params[0], dh.sum(axis=0), hidden.T @ dz + DECAY * params[2], np.array([dz.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    z = _forward(x[rest], *params)[1]
    grid = np.exp(np.linspace(np.log(0.25), np.log(16), 121))
    loss = [np.mean(np.logaddexp(0, -(2 * y[rest] - 1) * z / t)) for t in grid]
    return QualityModel(words, vectors, mean, scale, params[0], params[1], params[2], float(params[3][0]), float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> QualityModel:
    """Learn from documents whose ``labels.quality`` is 0 or 1 and for which ``usable`` (over the labels' rows) holds.

    The sample is at most ``sample_rows`` labelled documents, chosen by a hash of their id, of at most ``sample_chars``
    characters each; this bounds what the driver gets. The labels are thinned before they meet the documents.
    """
    marks = labels.filter(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q"))
    share = min(1.0, sample_rows / max(1, marks.count()))
    order = F.xxhash64("_id")
    marks = marks.filter(F.pmod(order, F.lit(1 << 20)) < share * (1 << 20)).orderBy(order, "_id", "_q").limit(sample_rows)
    few = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).filter(F.length("_text") <= sample_chars)
    found = few.join(F.broadcast(marks), F.col("_doc") == F.col("_id")).select("_id", "_q", "_text").limit(2 * sample_rows).collect()  # sample_rows narrow rows are broadcast
    found.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["_id"])), r["_q"], r["_text"]))
    return train([r["_text"] for r in found], np.array([r["_q"] for r in found], dtype=np.int64))


def scores(texts: list[str | None], model: QualityModel, ids: _Ids) -> np.ndarray:
    if model.prior is not None:
        return np.full(len(texts), model.prior)
    tokens, row = _sequences(texts, ids)
    x = (_pooled(tokens, row, len(texts), model.vectors) - model.mean) / model.scale
    return _sigmoid(_forward(x, model.w1, model.b1, model.w2, model.b2)[1] / model.temperature)


def score(docs: DataFrame, model: QualityModel, keep: list[Column]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with score (0 to 1, higher: better) and predicted (1 from 0.5 on) of the whole ``text``.

    Null and empty texts get the score of a text without words. Row by row; repeated rows repeat.
    """
    rows = docs.select(*keep, F.col("text").alias("_text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    held: list[_Ids] = []

    def derive(texts: list) -> dict[str, pa.Array]:
        if not held:
            held.append(_Ids(shipped.value.words))
        s = scores(texts, shipped.value, held[0])
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

    return map_texts(rows, derive, columns_of(rows, "_text", "score double", "predicted int"), "_text")


@op("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    return score(docs, model, [F.col("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out")])
