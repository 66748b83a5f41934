"""Quality classifier by positive-unlabelled learning.

A small network scores features of the whole text.  It minimises the
non-negative unbiased risk: with positives P, unlabelled texts U and the share
``prior`` of positives among all texts,

    risk = prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),

so that no negative needs a label.  With the logistic loss, the sigmoid of the
output estimates the probability of a good text.  Positives are labelled rows
outside the held-out fold, unlabelled texts any rows outside it, both bounded
samples; the prior is the share of positives among the labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrail.llm.shared import column_safe, held_out, sample_texts

#: Bounds of the samples the network is fitted on.
POSITIVES, UNLABELLED = 8_000, 16_000
HIDDEN, STEPS, RATE, DECAY = 16, 800, 0.02, 1e-4
THRESHOLD = 0.3
_MARKS = frozenset(b".,;:'\"?()-")
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_HIGH = np.arange(256) >= 128  # bytes of other scripts' letters, mostly
_SYMBOL = ~(_SPACE | _UPPER | _LOWER | _DIGIT | _HIGH | np.isin(np.arange(256), list(_MARKS)))
_MARK = np.isin(np.arange(256), list(_MARKS))
FEATURES = ["log_bytes", "upper", "digit", "symbol", "mark", "exclamation", "bar", "word_length", "distinct_words",
            "repeats", "top_word", "caps_words", "log_lines", "distinct_lines", "short_words", "byte_entropy",
            "symbol_lines"]


def features(text: str) -> list[float]:
    """Numbers that tell prose from junk; those of an empty text are 0."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    seen = counts[~_SPACE].sum()
    share = counts / seen
    used = counts[counts > 0] / len(raw)
    n, lines = len(words), text.split("\n")
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    odd = sum(len(x) for x in lines if 20 * sum(map(x.count, "!|*#$%&")) > len(x))
    return [np.log1p(len(raw)), share[_UPPER].sum(), share[_DIGIT].sum(), share[_SYMBOL].sum(), share[_MARK].sum(),
            share[33], share[124], min(seen / n, 50) / 10, len(tally) / n, sum(map(eq, words, words[1:])) / n,
            max(tally.values()) / n, sum(map(str.isupper, words)) / n, np.log1p(len(lines)), len(set(lines)) / len(lines),
            sum(1 for w in words if len(w) <= 3) / n, -float(used @ np.log2(used)), odd / len(text)]


@dataclass(frozen=True)
class Model:
    """Standardised features, one hidden layer of tanh units, one output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((np.clip((x - self.mean) / self.scale, -8, 8)) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(x: np.ndarray, start: float, slope_of, steps: int, seed: int) -> list[np.ndarray]:
    """The network's parameters after ``steps`` of Adam; ``slope_of`` gives the loss's slope at each row's output."""
    rng = np.random.default_rng(seed)
    theta = [rng.normal(0, 0.3, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.array(start)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        h = np.tanh(x @ theta[0] + theta[1])
        slope = slope_of(h @ theta[2] + theta[3])
        inner = np.outer(slope, theta[2]) * (1 - h * h)
        grads = [x.T @ inner + DECAY * theta[0], inner.sum(0), h.T @ slope + DECAY * theta[2], slope.sum()]
        rate = RATE * (1 - step / (steps + 1))
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            theta[k] = theta[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return theta


def _standard(positive: np.ndarray, unlabelled: np.ndarray):
    every = np.vstack([unlabelled, positive])
    return every.mean(0), every.std(0) + 1e-6


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = STEPS, seed: int = 5) -> Model:
    """Minimise the non-negative risk with Adam.  Where the estimated risk of
    negatives falls below 0, the step goes the other way on that part."""
    mean, scale = _standard(positive, unlabelled)
    x = np.clip((np.vstack([positive, unlabelled]) - mean) / scale, -8, 8)
    n_p, n_u = len(positive), len(unlabelled)

    def slope(z):
        up, down = _sigmoid(z) - 1, _sigmoid(z)  # slopes of the losses for a good and for a bad text
        loss_down = np.logaddexp(0, z)
        negative = loss_down[n_p:].mean() - prior * loss_down[:n_p].mean()
        out = np.concatenate([-prior * down[:n_p] / n_p, down[n_p:] / n_u])
        if negative < 0:
            return -out
        out[:n_p] += prior * up[:n_p] / n_p
        return out

    theta = _descend(x, np.log(prior / (1 - prior)), slope, steps, seed)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, *, splits: int = 5, steps: int = STEPS // 8) -> float:
    """The share of positives among the unlabelled rows, from these two samples alone.

    A network is fitted to tell positives from unlabelled rows on half of each.
    On the other half, the share of unlabelled rows above any score is at least the
    prior times the share of positives above it, so their ratio bounds the prior; the
    smallest, each with an allowance for chance, is the split's estimate (best
    bin).  All of them bound it from above, so the least of several splits counts."""
    mean, scale = _standard(positive, unlabelled)
    found = []
    for seed in range(splits):
        rng = np.random.default_rng(seed)
        halves = [np.array_split(rng.permutation(len(a)), 2) for a in (positive, unlabelled)]
        if not len(halves[0][1]) or not len(halves[1][1]):
            return 0.5
        fit_p, fit_u = positive[halves[0][0]], unlabelled[halves[1][0]]
        x = np.clip((np.vstack([fit_p, fit_u]) - mean) / scale, -8, 8)
        good = np.arange(len(x)) < len(fit_p)
        share = np.where(good, 0.5 / len(fit_p), 0.5 / len(fit_u))
        theta = _descend(x, 0.0, lambda z: share * (_sigmoid(z) - good), steps, seed)
        model = Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3]))
        p, u = (np.sort(model.logit(a[h[1]])) for a, h in ((positive, halves[0]), (unlabelled, halves[1])))
        at = np.unique(np.quantile(p, np.linspace(0, 0.99, 200)))
        above = lambda s: 1 - np.searchsorted(s, at, "left") / len(s)
        chance = lambda n: np.sqrt(np.log(40) / (2 * n))
        ratio = above(u) / above(p)
        best = int(np.argmin(ratio + (chance(len(u)) + chance(len(p))) / above(p)))
        found.append(float(ratio[best]))
    return float(np.clip(min(found), 0.01, 0.99))


def _feature_rows(rows: DataFrame) -> np.ndarray:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array(map(features, batch.column("text").to_pylist()),
                                                            pa.list_(pa.float64()))})

    found = [r.x for r in rows.select("text").mapInArrow(run, "x array<double>").collect()]
    return np.array(found, "f8").reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """A model from rows outside the held-out fold; None if they have no
    positive.  Only positive labels are used: labels of bad texts change nothing.
    NULL ids and labels are no labels, nor is an id labelled both 1 and 0; an id's
    different texts are rows of their own, equal rows are one."""
    known = labels.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("low")).where("doc_id is not null and low = 1").select("doc_id")
    p = _feature_rows(sample_texts(docs, positives, known))
    u = _feature_rows(sample_texts(docs.where(~held_out(F.col("doc_id"))), unlabelled))
    if not len(p) or not len(u):
        return None
    return fit(p, u, estimate_prior(p, u))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row (1 if the
    score reaches the threshold).  Without a model every score is 0.5.  NULL
    texts are empty; repeated rows and ids are scored one by one, a score equal to the
    threshold passes; other columns are ignored; an empty table gives none."""
    scored = _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score``."""
    def run(batches):
        for batch in batches:
            if model is None:
                values = np.full(batch.num_rows, 0.5)
            else:
                x = np.array([features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
                values = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())],
                                             names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double")


@column_safe
def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model rejects, all columns kept.  NULL texts
    are scored as empty ones, rows with NULL or repeated ids one by one; a score
    equal to the threshold stays; an empty table gives an empty one."""
    return _scored(docs, train(docs, labels)).where(F.col("score") >= threshold).drop("score")
