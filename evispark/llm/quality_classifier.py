"""A quality classifier learned from trusted positives and unlabelled web text.

Texts become a few dozen measures of their form (shares of kinds of characters, of repeated words, windows and
lines, lengths); no label, language, source or key is among them. The non-negative risk of positive-unlabelled
learning is minimised over a linear score of the measures and their squares:

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss; where the second part falls below zero the step goes back up, as the estimator asks.
The class prior is estimated from a first fit of positives against unlabelled rows: the lowest ratio of the
unlabelled to the positive rows' tails over all thresholds, each with an allowance for its sample. The score is
calibrated on that prior: shifted so that the prior's share of the unlabelled rows reaches ``THRESHOLD``.

Learning takes bounded samples, drawn by a hash of the key: about ``positives`` and ``unlabelled`` rows. Samples are
put in the order of that hash, so partitions and retries don't change a model.

Defined results: a null text scores as an empty one; rows with a null key are never learned from; a positive key
teaches once, with one of its rows, and rows that repeat key and text teach once; with fewer than two positive rows
every score is the prior 0.5; repeated rows score alike; columns with the names of results are replaced, others of
any name are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.arrow import encoded
from evispark.llm.columns import at, by_place, named

POSITIVES, UNLABELLED = 6_000, 12_000
THRESHOLD = 0.7
#: Ridge: DECAY positives' worth of pull towards zero, spread over the positives that there are.
STEPS, RATE, DECAY = 600, 0.05, 3.0
#: Tails of fewer rows than this share of the positives say nothing about the prior.
LEAST_TAIL = 0.1
MARKS = b"!?.,;:|#*$%&<>/\\_=+-()[]{}\"'"
MEASURES = len(MARKS) + 15


def measures(text: bytes) -> np.ndarray:
    """The measures of one text, all between 0 and about 1."""
    out = np.zeros(MEASURES)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = counts[97:123].sum() + counts[65:91].sum() + counts[0xC3]
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    w = max(1, len(words))
    k = len(MARKS)
    out[:k] = counts[list(MARKS)] / max(1, n)
    out[k] = counts[65:91].sum() / max(1, letters)
    out[k + 1] = counts[48:58].sum() / max(1, n)
    out[k + 2] = (counts[32] + counts[10]) / max(1, n)
    out[k + 3] = letters / max(1, n)
    out[k + 4] = counts[128:].sum() / max(1, n) / 2
    out[k + 5] = len(set(words)) / w
    out[k + 6] = 1 - len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2)
    out[k + 7] = sum(map(bytes.__eq__, words, words[1:])) / w
    out[k + 8] = 1 - len(set(lines)) / max(1, len(lines))
    out[k + 9] = min(1.0, sum(map(len, words)) / w / 20)
    out[k + 10] = max(map(len, words), default=0) > 40
    out[k + 11] = np.log1p(len(words)) / 12
    out[k + 12] = min(1.0, len(lines) / w * 4)
    out[k + 13] = sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?", b'"', b"\xa6")) / max(1, len(lines))
    out[k + 14] = len(words) == 0
    out[: k + 2] = np.sqrt(out[: k + 2])
    return out


@dataclass
class Model:
    """A linear score of standardised measures and their squares."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -4, 4)
        return np.column_stack([np.ones(len(x)), z, z * z / 4])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(x) @ self.weights, -40, 40)))


def descend(gradient, size: int, decay: float) -> np.ndarray:
    """Adam from zero; gradient gives the direction of steepest ascent."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Lowest ratio of tails over thresholds, with an allowance of one standard error on both sides."""
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    at = np.unique(np.quantile(positive, np.linspace(0, 1 - LEAST_TAIL, 91)))
    p = 1 - np.searchsorted(positive, at, "left") / len(positive)
    u = 1 - np.searchsorted(unlabelled, at, "left") / len(unlabelled)
    upper = u + np.sqrt(u * (1 - u) / len(unlabelled))
    lower = p - np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip((upper / np.maximum(lower, 1e-3)).min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Non-negative positive-unlabelled learning; the prior is estimated unless given."""
    if len(positive) < 2 or len(unlabelled) < 2:
        zero = np.zeros(MEASURES)
        return Model(zero, np.ones(MEASURES), np.zeros(1 + 2 * MEASURES), 0.5)
    everything = np.concatenate([positive, unlabelled])
    model = Model(everything.mean(0), everything.std(0) + 1e-3, np.zeros(0), 0.5)
    xp, xu = model.features(positive), model.features(unlabelled)
    decay = DECAY / len(xp)
    if prior is None:  # each half is scored by the fit of the other, as a fit parts its own positives too well
        halves = []
        for k in range(2):
            p, u = xp[k::2], xu[k::2]
            first = descend(lambda w: -p.T @ (1 - sigmoid(p @ w)) / len(p) / 2 + u.T @ sigmoid(u @ w) / len(u) / 2, xp.shape[1], 2 * decay)
            halves.append(estimated_prior(xp[1 - k :: 2] @ first, xu[1 - k :: 2] @ first))
        prior = float(np.mean(halves))

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = xp @ w, xu @ w
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_rest = xu.T @ sigmoid(zu) / len(xu) - prior * xp.T @ sigmoid(zp) / len(xp)
        if rest < 0:
            return -of_rest
        return of_rest - prior * xp.T @ (1 - sigmoid(zp)) / len(xp)

    model.prior = prior
    model.weights = descend(gradient, xp.shape[1], decay)
    model.weights[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - np.quantile(xu @ model.weights, 1 - prior)
    return model


def measured(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([measures(t).tolist() for t in encoded(batch)], pa.list_(pa.float64()))

    return measure(text)


def drawn(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """About most rows by a hash of the key; rows that repeat a key (and text) count once."""
    share = min(1.0, most / max(1, rows.count()))
    h = F.xxhash64(*rows.columns, F.lit(salt))
    return rows.withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["h"])


def sample(rows: DataFrame) -> np.ndarray:
    """The measures of rows (h, text) in the order of h, so that neither partitions nor retries change a model."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    found = rows.repartition(tasks, "h").select("h", measured(F.col("text")).alias("m")).toPandas().sort_values("h")
    return np.array(found["m"].tolist()).reshape(-1, MEASURES)


def learn(docs: DataFrame, positive_keys: DataFrame, text: str = "text", key: str = "doc_id", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs: the rows that may be learned from; positive_keys: the keys of trusted positives."""
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("key IS NOT NULL")
    keys = positive_keys.select(F.col(f"`{key}`").alias("key")).where("key IS NOT NULL").distinct()
    trusted = docs.join(F.broadcast(drawn(keys, positives, 5)), "key")
    trusted = trusted.groupBy("h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one row of each key
    return fit(sample(trusted), sample(drawn(docs, unlabelled, 6)))


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted (1 from ``threshold`` on) to every row."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [measures(t) for t in encoded(batch)]
            yield pa.array(model.score(np.array(rows).reshape(-1, MEASURES)), pa.float64())

    found = by_place(docs).withColumn("score", scored(at(docs, text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return found.select(*named(docs, ["score", "predicted"]))
