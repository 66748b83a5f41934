"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are words and five-letter word beginnings (lower-cased runs of
letters) that toxic documents have more often than others, the most significant
first; their value is log(1 + count).  The model shares one weight per
feature across ordered thresholds,

    P(grade <= k) = sigmoid(threshold_k - weights . x),

and a document's severity is its expected grade, from 0 to 3.  The labels say
toxic or not; a toxic training document's grade is the third of the toxic ones
that it falls into by the number of its marker words (features that toxic
documents have far more often than others).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrail.llm.shared import held_out, sample_texts, stored, texts

#: Labelled documents of each class that the model is fitted on, at most, and its features.
SAMPLE, FEATURES = 6_000, 1024
GRADES = 3
STEM = 5
#: Documents that a feature must be in, and its smoothed log odds to be a marker.
LEAST, MARKER = 2, 3.0
STEPS, RATE, DECAY = 400, 0.05, 2e-4
_WORD = re.compile(r"[^\W\d_]+")


def count_features(text: str) -> Counter:
    """Counts of a text's words and of their beginnings (``stem*``)."""
    words = Counter(_WORD.findall(text.lower()))
    stems = Counter()
    for w, n in words.items():
        if len(w) > STEM:
            stems[w[:STEM] + "*"] += n
    return words + stems


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, value: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, from ``weights . x``."""
        return 1 / (1 + np.exp(-np.clip(value[:, None] - self.thresholds, -40, 40)))

    def value(self, text: str) -> float:
        """``weights . x`` of a text."""
        index, total = self.index, 0.0
        sums: dict[int, int] = {}
        for w, n in Counter(_WORD.findall(text.lower())).items():
            for f in (w, w[:STEM] + "*") if len(w) > STEM else (w,):
                if (k := index.get(f)) is not None:
                    sums[k] = sums.get(k, 0) + n
        for k, n in sums.items():
            total += self.weights[k] * np.log1p(n)
        return float(total)


def fit(x: np.ndarray, grades: np.ndarray, index: dict[str, int], *, steps: int = STEPS) -> Model:
    """Maximum likelihood (both classes weigh the same, weights are shrunk) with
    Adam; the thresholds stay ordered because their gaps are exponentials."""
    n, k = len(x), GRADES
    share = np.where(grades > 0, 0.5 / max((grades > 0).sum(), 1), 0.5 / max((grades == 0).sum(), 1))
    theta = [np.zeros(x.shape[1]), np.array([0.5, *np.zeros(k - 1)])]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    ends = lambda p: np.cumsum([p[0], *np.exp(p[1:])])
    for step in range(1, steps + 1):
        value, edges = x @ theta[0], ends(theta[1])
        below = np.column_stack([np.zeros(n), sigmoid(edges - value[:, None]), np.ones(n)])
        slope = below * (1 - below)
        high, low = below[np.arange(n), grades + 1], below[np.arange(n), grades]
        d_high, d_low = slope[np.arange(n), grades + 1], slope[np.arange(n), grades]
        scale = share / np.maximum(high - low, 1e-12)
        g_value = scale * (d_high - d_low)
        g_edges = np.zeros(k)
        for j in range(k):  # the loss is -log(high - low)
            g_edges[j] = -(scale * d_high)[grades == j].sum() + (scale * d_low)[grades == j + 1].sum()
        tails = g_edges[::-1].cumsum()[::-1]
        grads = [x.T @ g_value + DECAY * theta[0], tails * np.array([1, *np.exp(theta[1][1:])])]
        rate = RATE * (1 - step / (steps + 1))
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-9)
    return Model(index, theta[0], ends(theta[1]))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, features: int = FEATURES) -> Model | None:
    """A model from labelled rows outside the held-out fold; None if they lack a
    class.  NULL ids and labels, and ids with both labels, are no labels."""
    known = labels.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("toxic").alias("low"), F.max("toxic").alias("toxic")).where("doc_id is not null and low = toxic")
    picked = [sample_texts(docs, sample, known.where(F.col("toxic") == c).select("doc_id", "toxic")) for c in (0, 1)]
    rows = stored(picked[0].unionByName(picked[1]), "labelled-texts")

    def tally(batches):
        for batch in batches:
            held: dict[str, list[int]] = {}
            docs_of = [0, 0]
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                docs_of[toxic] += 1
                for f in count_features(text):
                    held.setdefault(f, [0, 0])[toxic] += 1
            held[""] = docs_of  # no feature is empty: the documents themselves
            yield pa.RecordBatch.from_pydict({"feature": list(held), "clean": pa.array([v[0] for v in held.values()], pa.int64()),
                                              "toxic": pa.array([v[1] for v in held.values()], pa.int64())})

    counts = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        tally, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.where("feature = ''").first()
    if total is None or not total.clean or not total.toxic:
        return None
    rate = lambda c, n: (F.col(c) + 0.25) / (n + 0.5)
    odds = F.log(rate("toxic", total.toxic)) - F.log(rate("clean", total.clean))
    # log-likelihood ratio of the feature's documents against the classes' shares
    term = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(
        F.col(c) * (total.clean + total.toxic) / ((F.col("clean") + F.col("toxic")) * n))).otherwise(0.0)
    ratio = term("clean", total.clean) + term("toxic", total.toxic)
    best = counts.where(f"feature != '' and clean + toxic >= {LEAST}").select("feature", odds.alias("odds"), ratio.alias("g"))
    best = best.where("odds > 0").orderBy(F.desc("g"), "feature").limit(features).collect()
    index = {r.feature: n for n, r in enumerate(best)}
    marks = {r.feature for r in best if r.odds >= MARKER}

    def rows_of(batches):
        for batch in batches:
            at, value, hits = [], [], []
            for text in batch.column("text").to_pylist():
                found = count_features(text)
                own = [f for f in found if f in index]
                at.append([index[f] for f in own])
                value.append([float(found[f]) for f in own])
                hits.append(sum(found[f] for f in own if f in marks and not f.endswith("*")))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(at, pa.list_(pa.int32())),
                                              pa.array(value, pa.list_(pa.float64())), pa.array(hits, pa.int64())],
                                             names=["toxic", "at", "value", "hits"])

    got = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        rows_of, "toxic int, at array<int>, value array<double>, hits long").collect()
    x = np.zeros((len(got), len(index)), "f4")
    for n, r in enumerate(got):
        x[n, r["at"]] = np.log1p(r["value"])
    toxic, hits = np.array([r["toxic"] for r in got]), np.array([r["hits"] for r in got])
    thirds = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    return fit(x, np.where(toxic == 1, 1 + (hits > thirds[0]) + (hits > thirds[1]), 0), index)


def grade(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``severity`` (expected grade), ``grade`` (the
    highest that is as likely as not), ``toxic`` (1 if that is above 0) and
    ``p_toxic`` of each row.  A NULL or empty text has no features; without a
    model all severities are 0.  Other columns are ignored."""
    def run(batches):
        for batch in batches:
            if model is None:
                p = np.zeros((batch.num_rows, GRADES))
            else:
                p = model.at_least(np.array([model.value(t) for t in batch.column("text").to_pylist()], "f8"))
            level = (p >= 0.5).sum(axis=1).astype("i4")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(level),
                                              pa.array((level > 0).astype("i4")), pa.array(p[:, 0])],
                                             names=["doc_id", "severity", "grade", "toxic", "p_toxic"])

    found = texts(docs).mapInArrow(run, "doc_id long, severity double, grade int, toxic int, p_toxic double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "grade", "toxic", "p_toxic")
