"""Toxicity: cumulative-link ordinal regression on sparse text features.

A document's features are the hashed words it contains and their hashed beginnings, as present or absent.
The model gives P(grade > k) = sigmoid(w.x - t_k) for ordered thresholds t_0 < t_1 < t_2; the
weights are shared by all thresholds. The output is the expected severity (0 to 3), the likeliest grade,
and whether grade 0 is the less likely.

Grades for fitting come from the binary labels: 0 where the label is 0; documents with label 1 get 1, 2 or 3
by thirds of how many distinct words they have that mark the class in the sample.
Fitting reads at most ``SAMPLE_ROWS`` labelled rows; scoring reads every whole text.

Defined cases: null and blank texts have no features and get the grade 0 unless the thresholds say otherwise;
rows that repeat get equal results; without labels of both classes the severity is 0 everywhere. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import trim
from .sample import labelled_sample
from .textnum import _LOWER, Words, batches, mix64

SAMPLE_ROWS = 4000
BUCKETS = 1 << 18
PREFIXES = (4, 5)
GRADES = 4
SEED = 5
#: Only features whose shares in the two classes differ by so many standard errors get a weight, and
#: only if so many sample documents have them: else the many ordinary words of a long text add up to noise.
STANDARD_ERRORS = 4.5
MIN_DOCS = 8
DECAY = 1e-4
#: Natural logarithm of the odds from which a word counts as marking the class.
MARKED = 3.0

_EDGE = b" \t\n\x0b\f\r.,;:!?'\"()[]*#&%$"
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[list(_EDGE)] = 32


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids): the distinct features of text k are ids[offsets[k]:offsets[k + 1]], sorted."""
    counts, parts = np.zeros(len(texts) + 1, np.int64), []
    for first, raw, offsets in batches(texts):
        clean = _SPACED[raw]
        words = Words(clean)
        doc = np.searchsorted(offsets, words.start, side="right") - 1
        ids = [(words.hash % np.uint64(BUCKETS)).astype(np.int64)]
        docs = [doc]
        for k in PREFIXES:
            long = words.end - words.start > k
            at = words.start[long]
            h = np.full(len(at), k, np.uint64)
            for j in range(k):
                h = mix64(h * np.uint64(257) + _LOWER[clean[at + j]])
            ids.append((h % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS)
            docs.append(doc[long])
        both = np.unique(np.concatenate(docs) * (2 * BUCKETS) + np.concatenate(ids))
        parts.append(both % (2 * BUCKETS))
        counts[first + 1 : first + len(offsets)] = np.bincount(both // (2 * BUCKETS), minlength=len(offsets) - 1)
    return np.cumsum(counts), np.concatenate(parts) if parts else np.zeros(0, np.int64)


def sums(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    weights: np.ndarray | None
    thresholds: np.ndarray

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        if self.weights is None:
            return np.zeros((len(texts), GRADES - 1))
        offsets, ids = features(texts)
        return sigmoid(sums(offsets, self.weights[ids])[:, None] - self.thresholds[None, :])


def severity_grades(offsets: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 from binary labels: thirds of the number of marking words in the labelled documents."""
    doc = np.repeat(np.arange(len(labels)), np.diff(offsets))
    hits = [np.bincount(ids[labels[doc] == k], minlength=2 * BUCKETS) for k in (0, 1)]
    share = [(hits[k] + 0.5) / ((labels == k).sum() + 1) for k in (0, 1)]
    marking = (np.log(share[1] / share[0]) > MARKED) & (hits[1] >= 5)
    marking[BUCKETS:] = False
    count = sums(offsets, marking[ids].astype(float))
    low, high = np.quantile(count[labels == 1], [1 / 3, 2 / 3])
    return np.where(labels == 1, 1 + (count > low) + (count > high), 0)


def telling(offsets: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which features get a weight. Of near copies in the sample only one counts: else any word seems to mark a class."""
    doc = np.repeat(np.arange(len(labels)), np.diff(offsets))
    order = mix64(ids.astype(np.uint64))
    signs = [tuple(np.partition(own, 2)[:3]) if len(own) > 2 else (k,) for k, own in enumerate(np.split(order, offsets[1:-1]))]
    single = np.zeros(len(labels), bool)
    single[list({s: k for k, s in enumerate(signs)}.values())] = True
    n = [max(1, (single & (labels == k)).sum()) for k in (0, 1)]
    hits = [np.bincount(ids[single[doc] & (labels[doc] == k)], minlength=2 * BUCKETS) for k in (0, 1)]
    pooled = (hits[0] + hits[1] + 1) / (n[0] + n[1] + 2)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    return (np.abs(hits[1] / n[1] - hits[0] / n[0]) > STANDARD_ERRORS * error) & (hits[0] + hits[1] >= MIN_DOCS)


def likelihoods(f: np.ndarray, grades: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(grade of each row) = upper - lower, and the slopes of both sigmoids over it."""
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    upper, lower = sigmoid(edges[grades + 1] - f), sigmoid(edges[grades] - f)
    upper, lower = np.where(grades == GRADES - 1, 1.0, upper), np.where(grades == 0, 0.0, lower)
    p = np.maximum(upper - lower, 1e-9)
    return p, upper * (1 - upper) / p, lower * (1 - lower) / p


def slopes(f: np.ndarray, grades: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the sum of -log P(grade): by the value f of each row, and by each threshold."""
    _, upper, lower = likelihoods(f, grades, thresholds)
    return upper - lower, np.array([lower[grades == k + 1].sum() - upper[grades == k].sum() for k in range(GRADES - 1)])


def train(texts: list[str], labels: np.ndarray, seed: int = SEED, epochs: int = 12) -> Model:
    """Maximum likelihood by Adagrad over shuffled documents."""
    labels = np.asarray(labels, int)
    if len(np.unique(labels)) < 2:
        return Model(None, np.zeros(GRADES - 1))
    offsets, ids = features(texts)
    grades = severity_grades(offsets, ids, labels)
    useful = telling(offsets, ids, labels)
    weights, power = np.zeros(2 * BUCKETS), np.full(2 * BUCKETS, 1e-2)
    first, gaps, t_power = 1.0, np.zeros(GRADES - 2), np.full(GRADES - 1, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 16)):
            own = np.concatenate([ids[offsets[k] : offsets[k + 1]] for k in part])
            size = offsets[part + 1] - offsets[part]
            f = sums(np.concatenate([[0], np.cumsum(size)]), weights[own])
            thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            slope, t_grad = slopes(f, grades[part], thresholds)
            grad = np.bincount(own, np.repeat(slope, size), 2 * BUCKETS)
            used = np.unique(own)
            g = grad[used] / len(part) + DECAY * weights[used]
            power[used] += g * g
            weights[used] -= np.where(useful[used], 0.1 * g / np.sqrt(power[used]), 0.0)
            t_grad /= len(part)
            chain = np.array([t_grad.sum(), *[t_grad[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 2)]])
            t_power += chain * chain
            move = 0.1 * chain / np.sqrt(t_power)
            first, gaps = first - move[0], np.clip(gaps - move[1:], -5, 5)
    return Model(weights.astype(np.float32), first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, rows: int = SAMPLE_ROWS, seed: int = SEED) -> Model:
    sample = labelled_sample(docs, labels, "toxic", rows, seed, where)
    return train(list(sample["text"]), sample["label"].to_numpy(), seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, severity, grade, p_toxic, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the input

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        above = shared.value.above(list(texts))
        trim()
        grades = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
        return pd.DataFrame({"severity": above.sum(axis=1), "grade": grades.argmax(axis=1).astype(np.int32), "p_toxic": above[:, 0]})

    return docs.select("doc_id", scored(F.col("text")).alias("s")).select("doc_id", "s.*").withColumn("toxic", F.col("p_toxic") >= 0.5)


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on a bounded sample of ``labels`` and score every document."""
    return score(docs, fit(docs, labels))
