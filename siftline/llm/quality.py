"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse ternary index vector that follows from its hash bucket; its word vector is
its own index vector plus those of its neighbours in the training sample (random indexing). Besides
words there are shape tokens (capitals, symbols, digits, length, a word that repeats the one before).
A document's vector is the mean over all its words, plus its length. The network has one hidden layer and
is trained with numpy; its probabilities are calibrated by a temperature on held-back
training rows.

Labels, language, source and ids are no inputs. Fitting reads at most ``SAMPLE_ROWS`` labelled rows;
scoring reads every whole text, in pieces of bounded size.

Defined cases: null and blank texts have the zero vector and the length 0, and get the network's score for
that; rows that repeat get equal scores; without usable labels of both classes the score is the
share of label 1 (0.5 without labels). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import trim
from .sample import labelled_sample
from .textnum import Words, batches, owner

SAMPLE_ROWS = 4000
BUCKETS = 1 << 15
SHAPES = 128
DIM = 32
HIDDEN = 24
THRESHOLD = 0.7
SEED = 11

_KINDS = np.zeros((4, 256), np.int32)  # capitals, digits, symbols, small letters
_KINDS[0, 65:91] = 1
_KINDS[1, 48:58] = 1
_KINDS[2, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\""]] = 1
_KINDS[3, 97:123] = 1


def word_ids(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word its bucket, and its shape: SHAPES combinations of what it is made of."""
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shape = np.zeros(len(words.start), np.int64)
    for k in range(3):
        total = np.zeros(len(words.raw) + 1, np.int32)
        np.cumsum(_KINDS[k][words.raw], out=total[1:])
        n = total[words.end] - total[words.start]
        shape = shape * 3 + np.minimum(n, 2)
    length = words.end - words.start
    same = np.zeros(len(shape), np.int64)
    same[1:] = words.hash[1:] == words.hash[:-1]
    shape = (shape * 2 + (length > 12)) * 2 + same
    return (words.hash % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + shape


def index_vectors(seed: int = SEED) -> np.ndarray:
    """Ternary index vectors of all buckets and shapes."""
    rng = np.random.default_rng(seed)
    rows = BUCKETS + SHAPES
    out = np.zeros((rows, DIM), np.float32)
    for sign in (1, -1):
        for _ in range(2):
            out[np.arange(rows), rng.integers(0, DIM, rows)] += sign
    return out


def word_vectors(texts: list[str], seed: int = SEED) -> np.ndarray:
    """Index vectors plus those of the neighbours at distance 1 and 2 in ``texts``, at unit length."""
    index = index_vectors(seed)
    context = np.zeros_like(index)
    for _, raw, offsets in batches(texts):
        words = Words(raw)
        ids, _ = word_ids(words)
        doc = np.searchsorted(offsets, words.start, side="right")
        for gap in (1, 2):
            near = doc[gap:] == doc[:-gap]
            a, b = ids[gap:][near], ids[:-gap][near]
            for column in range(DIM):
                context[:BUCKETS, column] += np.bincount(a, index[b, column], BUCKETS) + np.bincount(b, index[a, column], BUCKETS)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return unit(unit(index) + 0.5 * unit(context)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Per text: the mean of its words' vectors, the mean of its shapes' vectors, and its length."""
    out = np.zeros((len(texts), 2 * DIM + 1), np.float32)
    for first, raw, offsets in batches(texts):
        words = Words(raw)
        ids, shapes = word_ids(words)
        begin = owner(words, offsets)
        n = np.diff(begin)
        for k, tokens in enumerate((ids, shapes)):
            for lo in range(0, len(n)):
                if n[lo]:
                    total = np.zeros(DIM, np.float64)
                    for at in range(begin[lo], begin[lo + 1], 65536):
                        total += vectors[tokens[at : min(at + 65536, begin[lo + 1])]].sum(axis=0)
                    out[first + lo, k * DIM : (k + 1) * DIM] = total / n[lo]
        out[first : first + len(n), -1] = np.log1p(n)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    share: float | None  # of label 1, where there was nothing to learn

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(texts, self.vectors)).astype(np.float64) / self.temperature, -30, 30)))


def train(texts: list[str], labels: np.ndarray, seed: int = SEED, epochs: int = 60) -> Model:
    """Fit vectors, network and temperature."""
    y = np.asarray(labels, np.float32)
    if len(np.unique(y)) < 2:
        return Model(np.zeros((1, DIM), np.float32), *[np.zeros(1)] * 2, [], 1.0, float(y.mean()) if len(y) else 0.5)
    vectors = word_vectors(texts, seed)
    x = pooled(texts, vectors)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    n_in = x.shape[1]
    layers = [rng.normal(0, n_in**-0.5, (n_in, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in layers]
    z, step = (x - mean) / scale, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            hidden = np.tanh(z[part] @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            grads = [z[part].T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * layers[2], np.array([error.sum()])]
            step += 1
            for p, g, (m, v) in zip(layers, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, layers, 1.0, None)
    raw, target = model.logits(x[held]), y[held]
    loss = lambda t: np.logaddexp(0, np.where(target == 1, -1, 1) * raw / t).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, rows: int = SAMPLE_ROWS, seed: int = SEED) -> Model:
    """Train on at most ``rows`` labelled documents for which ``where`` holds."""
    sample = labelled_sample(docs, labels, "quality", rows, seed, where)
    return train(list(sample["text"]), sample["label"].to_numpy(), seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``score``: the calibrated probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = pd.Series(shared.value.scores(list(texts)))
        trim()
        return out

    return docs.withColumn("score", scored(F.col("text")))


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that is never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
