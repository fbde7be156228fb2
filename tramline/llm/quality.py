"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a linear model on the non-negative unbiased risk
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
of the sigmoid loss. Unlabelled texts are a draw of all texts, whatever their label, and the class prior is estimated
from how far the scores of both sets reach; labels of 0 are not used. When the bracket falls below zero a step is taken on its
negative alone, which keeps the model from fitting the unlabelled sample as negatives. The weights of the later half of
the steps are averaged. Features are shares of bytes and of word repetitions, read from the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most sampled positives and unlabelled texts; they bound what the driver holds (about 0.6 kB each).
MOST_POSITIVE = 8_000
MOST_UNLABELLED = 16_000
STEPS = 1500
N_FEATURES = 128 + 12


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of each ASCII byte, then shares of words and repetitions; zeros for an empty text."""
    out = np.zeros(N_FEATURES, np.float32)
    data = np.frombuffer((text or "").encode(), np.uint8)
    words = (text or "").split()
    if not words:
        return out
    counts = np.bincount(data, minlength=256)
    out[:128] = np.sqrt(counts[:128] / len(data))
    n = len(words)
    often = Counter(words)
    bounds = np.array([len(w) for w in words])
    lines = text.split("\n")
    out[128:] = (
        counts[128:].sum() / len(data),
        counts[65:91].sum() / max(1, counts[65:91].sum() + counts[97:123].sum()),
        sum(map(str.__eq__, words, words[1:])) / n,
        max(often.values()) / n,
        len(often) / n,
        np.log1p(len(often)) / np.log1p(n),
        np.log1p(n) / 10,
        bounds.mean() / 20,
        min(bounds.max(), 200) / 200,
        sum(map(str.isalpha, often)) / len(often),
        len(set(lines)) / len(lines),
        min(n / len(lines), 400) / 400,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((rows - self.mean) / self.scale) @ self.weight + self.bias, -60, 60)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that a mixture allows: the least ratio of upper tails over a grid of cuts."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.5, 25))
    tails = [((unlabelled >= c).mean() + 1 / len(unlabelled)) / (positive >= c).mean() for c in cuts]
    return float(np.clip(min(tails), 0.01, 0.99))


def risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk of positives, risk of negatives (the bracket, before it is cut at zero), and the gradients of both by (w, b).

    The sigmoid loss of a positive is 1 less its score, that of a negative its score.
    """
    sp, su = 1 / (1 + np.exp(-np.clip(p @ w + b, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w + b, -30, 30)))
    gp, gu = sp * (1 - sp), su * (1 - su)
    slope_p, slope_u = np.r_[p.T @ gp, gp.sum()] / len(p), np.r_[u.T @ gu, gu.sum()] / len(u)
    return prior * (1 - sp).mean(), su.mean() - prior * sp.mean(), -prior * slope_p, slope_u - prior * slope_p


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int, seed: int) -> Model:
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = ((positive - mean) / scale).astype(np.float32), ((unlabelled - mean) / scale).astype(np.float32)
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, total = np.zeros(len(w) + 1), np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    rng = np.random.default_rng(seed)
    size = 2048
    for step in range(1, steps + 1):
        a, c = p[rng.integers(0, len(p), size)], u[rng.integers(0, len(u), size)]
        _, negative, of_positives, of_negatives = risk(a, c, w, b, prior)
        grad = of_positives + of_negatives if negative >= 0 else -of_negatives
        grad[:-1] += 0.01 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if step > steps // 2:
            total += np.r_[w, b]
    total /= steps - steps // 2
    return Model(mean, scale, total[:-1], float(total[-1]), prior)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, *, steps: int = STEPS, seed: int = 11) -> Model:
    """Trains on feature rows; without a prior, a first model's scores estimate it.

    Without positives every text scores the prior (0.5 if that is unknown too).
    """
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), float(np.log((prior or 0.5) / (1 - (prior or 0.5)))), prior or 0.5)
    if prior is None:  # estimated on rows that the first model has not seen
        first = _fit(positive[::2], unlabelled[::2], 0.5, steps, seed)
        prior = estimate_prior(first.score(positive[1::2]), first.score(unlabelled[1::2])) if len(positive) > 1 and len(unlabelled) > 1 else 0.5
    return _fit(positive, unlabelled, min(0.99, max(0.01, prior)), steps, seed)


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Rows in an order of their own, so that a model does not depend on how they were gathered."""
    return rows[sorted(range(len(rows)), key=lambda n: rows[n].tobytes())]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).tolist() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("unlabelled"), pa.array(rows, pa.list_(pa.float32()))], ["positive", "unlabelled", "features"])


def _draw(tag: str):
    return F.pmod(F.xxhash64("doc_id", F.lit(tag)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def train(docs: DataFrame, labels: DataFrame, *, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, prior: float | None = None, may_learn=None) -> Model:
    """Learns from labels(doc_id, quality) and the texts of docs; may_learn is a condition on doc_id that both obey.

    Texts labelled 1 are the trusted positives, and a draw of all texts, labelled or not, are the unlabelled ones. Both
    are sampled by hashes of doc_id down to their bounds. The prior is estimated from scores unless it is given. Rows
    without doc_id are left out; repeated labels count once, contradicting ones as 0.
    """
    may_learn = F.lit(True) if may_learn is None else may_learn
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).filter(may_learn)
    trusted = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id", F.lit(True).alias("trusted"))
    ones = trusted.count()
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).filter(may_learn)
    total = rows.count()
    # the draws come before the join, so that only sampled texts are shuffled
    may = _draw("positive") < most_positive / max(1, ones)
    rows = rows.withColumn("unlabelled", _draw("unlabelled") < most_unlabelled / max(1, total)).filter(F.col("unlabelled") | may)
    rows = rows.join(trusted, "doc_id", "left").withColumn("positive", may & F.coalesce("trusted", F.lit(False))).filter("positive OR unlabelled")
    taken = rows.select("text", "positive", "unlabelled").mapInArrow(_vectors, "positive boolean, unlabelled boolean, features array<float>").toArrow()
    every = np.array(taken.column("features").combine_chunks().flatten() if taken.num_rows else [], np.float32).reshape(-1, N_FEATURES)
    positive, unlabelled = (_sorted(every[np.array(taken.column(n).to_pylist(), bool)]) for n in ("positive", "unlabelled"))
    return fit(positive, unlabelled, prior)


def _scores(model, text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(out)
            rows = np.array([features(t.as_py()) for t in batch.column(text)], np.float32).reshape(-1, N_FEATURES)
            yield batch.set_column(at, batch.schema.field(at), pa.array(model.value.score(rows), pa.float64()))

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score from 0 to 1 (higher: label 1 likelier); a column of that name is replaced.

    Null, empty and blank texts share one score, that of all features at zero.
    """
    names = [n for n in docs.columns if n != "score"]
    rows = docs.select(*[F.col(f"`{n}`") for n in names], F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scores(sent, "text", "score"), rows.schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows and columns of docs that score the threshold or more."""
    wrapped = docs.select("text", F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("whole"))
    return scored(wrapped, model).filter(F.col("score") >= threshold).select("whole.*")
