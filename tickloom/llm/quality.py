"""Text quality by positive-unlabelled learning.

Trusted positives and unlabelled text train a logistic model on style features.  The
non-negative risk estimator is minimised: with prior ``p``, the loss of calling positives
negative is taken off the unlabelled loss ``p`` times, and never below zero.  The prior comes
from positives and unlabelled text alone: a model that tells the two apart ranks rows it was not
fitted on, and the prior is the share of unlabelled text in the top bin, against the share of
positives in it, where that ratio is surely small.  Only a bounded, hash-chosen sample is fitted
(about ``POSITIVES`` and ``UNLABELLED`` rows at any input size, however many rows an id has);
every row is scored from its whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import words as W

POSITIVES, UNLABELLED = 20_000, 40_000
FOLDS = 5
STEPS, APART_STEPS = 600, 200
#: Chance that the bounds on the shares of a bin fail.
DOUBT = 0.1
#: Marks that are rare in prose; each has a feature of its own.
MARKS = b"!|#$%&*<>{}[]()=+_/\\~^@"
PUNCTUATION = b".,;:?-'\""


def _features(batch_text: pa.Array) -> np.ndarray:
    """One row of style features per text; a text without words gets zeros."""
    rows = []
    data, offsets = W.text_bytes(batch_text)
    upper, lower, digit = (np.zeros(256, np.int64) for _ in range(3))
    upper[65:91], lower[97:123], digit[48:58] = 1, 1, 1
    marks, stops = list(MARKS), list(PUNCTUATION)
    for first, words, at in W.hashed_texts(batch_text, W.SPACED_LOWER):
        for i in range(len(at) - 1):
            body = data[offsets[first + i] : offsets[first + i + 1]]
            w = words[at[i] : at[i + 1]]
            if not len(w):
                rows.append(np.zeros(len(marks) + 12))
                continue
            count = np.bincount(body, minlength=256)
            n, chars = len(w), len(body)
            letters = max(1, (count * (upper + lower)).sum())
            shares = np.unique(w, return_counts=True)[1]
            lines = body == 10
            rows.append(
                np.concatenate(
                    [
                        np.sqrt(count[marks] / n),
                        [
                            (count * upper).sum() / letters,
                            np.sqrt((count * digit).sum() / chars),
                            np.sqrt(count[stops].sum() / n),
                            np.sqrt((w[1:] == w[:-1]).sum() / n),
                            shares.max() / n if n > 20 else 0.0,
                            1 - len(shares) / n if n > 20 else 0.0,
                            np.sqrt(((w[2:] == w[:-2]) & (w[1:-1] != w[:-2])).sum() / n) if n > 2 else 0.0,
                            np.log1p(n),
                            (chars - n) / n / 10,
                            count[128:].sum() / chars,
                            np.sqrt(lines.sum() / n),
                            1.0,
                        ],
                    ]
                )
            )
    return np.array(rows).reshape(len(batch_text), len(marks) + 12)


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.centre) / self.scale, -6, 6) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _standard(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, ...]:
    centre, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = (np.clip((x - centre) / scale, -6, 6) for x in (positive, unlabelled))
    return centre, scale, *(np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))


def _descended(theta: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Adam over the whole sample."""
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = gradient(theta)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk."""
    centre, scale, p, u = _standard(positive, unlabelled)
    start = np.zeros(p.shape[1])
    start[-1] = np.log(prior / (1 - prior))
    # A small sample is held closer to the prior.
    decay = 1e-4 + 0.2 / len(p)

    def gradient(theta: np.ndarray) -> np.ndarray:
        zp, zu = np.clip(p @ theta, -30, 30), np.clip(u @ theta, -30, 30)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_negative = u.T @ _chance(zu) / len(u) - prior * (p.T @ _chance(zp)) / len(p)
        grad = prior * (p.T @ (_chance(zp) - 1)) / len(p) + grad_negative if negative >= 0 else -grad_negative
        grad[:-1] += decay * theta[:-1]
        return grad

    theta = _descended(start, gradient, STEPS)
    return Model(centre, scale, theta[:-1], float(theta[-1]), prior)


def _apart(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A logistic model that tells positives from unlabelled text, both of equal weight."""
    centre, scale, p, u = _standard(positive, unlabelled)
    decay = 1e-3 + 0.2 / len(p)

    def gradient(theta: np.ndarray) -> np.ndarray:
        grad = p.T @ (_chance(p @ theta) - 1) / (2 * len(p)) + u.T @ _chance(u @ theta) / (2 * len(u))
        grad[:-1] += decay * theta[:-1]
        return grad

    theta = _descended(np.zeros(p.shape[1]), gradient, APART_STEPS)
    return Model(centre, scale, theta[:-1], float(theta[-1]), 0.5)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows, from these two samples alone.

    Of all top bins, the one with the least upper bound on unlabelled share by positive share
    decides: a small bin is uncertain, a large one holds negatives.  Each half of the rows is
    ranked by a model of the other half, and the two answers are averaged.  Fewer than four rows
    of a kind say nothing: 0.5.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    found = []
    for half in (0, 1):
        model = _apart(positive[1 - half :: 2], unlabelled[1 - half :: 2])
        p, u = (np.sort(model.scores(x[half::2])) for x in (positive, unlabelled))
        # Shares at or above each positive's score.
        of_p, of_u = (1 - np.searchsorted(x, p) / len(x) for x in (p, u))
        slack = np.sqrt(np.log(4 / DOUBT) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
        found.append((of_u / of_p)[np.argmin((of_u + slack) / of_p)])
    return float(np.clip(np.mean(found), 0.01, 0.99))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a row without id has no label."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _sampled(key: list[str], rows: int, bound: int, name: str) -> Column:
    """A hash-chosen share that leaves about ``bound`` of ``rows`` rows."""
    parts = 1 << 20
    return F.pmod(F.xxhash64(*key, F.lit(name)), F.lit(parts)) < int(min(1.0, bound / max(1, rows)) * parts)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = _features(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("known"), pa.array(list(values), pa.list_(pa.float64()))], names=["known", "features"]
        )


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """Fit on labelled positives outside the held-out fold and on unlabelled text.

    ``prior`` is the share of positives in the text; if it is not given, it is estimated from
    the two samples.  Labels other than 1 are used only to withdraw a 1 of the same document.
    Rows are chosen by id and text, so the rows of one id, or those without id, are sampled like
    any others; rows that repeat both count once.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
    )
    positives = known.where(_sampled(["doc_id"], known.count(), POSITIVES, "positive")).select("doc_id", F.lit(True).alias("known"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most about POSITIVES ids are broadcast.
    chosen = text.join(F.broadcast(positives), "doc_id", "left")
    total, labelled = chosen.agg(F.count("*"), F.count("known")).first()
    row = ["doc_id", "text"]
    chosen = chosen.withColumns(
        {
            "known": F.coalesce("known", F.lit(False)) & _sampled(row, labelled, POSITIVES, "row"),
            "free": ~held_out(F.col("doc_id")) & _sampled(row, total, UNLABELLED, "unlabelled"),
        }
    )
    rows = (
        chosen.where("known or free")
        .groupBy("doc_id", F.xxhash64("text").alias("same"))
        .agg(F.first("text").alias("text"), F.first(F.array("known", "free")).alias("known"))
        .select("text", "known")
        .mapInArrow(_feature_rows, "known array<boolean>, features array<double>")
        .toArrow()
    )
    both = np.array(rows["known"].to_pylist(), bool).reshape(-1, 2)
    values = np.array(rows["features"].to_pylist()).reshape(-1, len(MARKS) + 12)
    order = np.lexsort(values.T)
    both, values = both[order], values[order]
    positive, unlabelled = values[both[:, 0]], values[both[:, 1]]
    if prior is None:
        prior = estimated_prior(positive, unlabelled)
    if not len(positive) or not len(unlabelled):
        zeros = np.zeros(len(MARKS) + 12)
        return Model(zeros, zeros + 1, zeros, float(np.log(prior / (1 - prior))), prior)
    return fit(positive, unlabelled, prior)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """``row, score`` for each row of ``docs``: higher means that quality 1 is likelier.

    ``row`` is the row itself with all its columns.  Null, empty and wordless texts share one
    feature vector of zeros and so one score.  Without labels of 1 every score is the prior (0.5
    if none is given).
    Repeated rows get equal scores; labels repeated with different values count as the lower.
    """
    model = train(docs, labels, prior)
    packed = docs.select(F.struct("*").alias("row"))
    schema = f"row {packed.schema[0].dataType.simpleString()}, score double"
    return packed.select("row", F.col("row.text").cast("string").alias("text")).mapInArrow(_scored(model), schema)
