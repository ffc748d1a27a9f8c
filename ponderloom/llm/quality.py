"""Quality: Bradley-Terry pairwise ranking of documents, with a threshold at a quantile of the scores.

A document's strength is linear in FEATURES of its whole text (shares of kinds of characters, repetition, word shape).
Each pair of a good and a bad labelled document is a preference; weights minimise the logistic loss of differences of
features over drawn pairs. The threshold is the quantile of the sample's strengths at its share of bad labels, and a
score is the logistic of the distance from it: 0.5 or more is kept. Fitted on a bounded sample (labelled.SAMPLE), then a map over the scan.

Defined results: a null text is the empty text. Where the labels have one class or none, all scores are 0.5 (kept).
Repeated rows each give a row. Null ids stay null and are not held out.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import SAMPLE, held_out, sample

FEATURES = ("upper", "digit", "exclaim", "bar", "symbol", "other_mark", "white", "line", "adjacent", "distinct", "word_length", "long_words", "lines_repeated", "log_words", "few_words")
PAIRS = 60_000
STEPS = 300
THRESHOLD = 0.5


class Measure:
    def __call__(self, text: str | None) -> list[float]:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        n = max(1, len(raw))
        c = np.bincount(raw, minlength=256)
        upper, lower, digit = c[65:91].sum(), c[97:123].sum() + c[128:].sum(), c[48:58].sum()
        symbol = c[[35, 36, 37, 38, 42, 64, 94, 95, 126]].sum()
        white = c[[9, 10, 13, 32]].sum()
        other = n - upper - lower - digit - symbol - white - c[33] - c[124]
        parts = (text or "").split()
        k = max(1, len(parts))
        same = sum(map(eq, parts, parts[1:])) / max(1, len(parts) - 1)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) if parts else np.zeros(1)
        distinct = len(set(parts)) / k
        lines = [x for x in (text or "").split("\n") if x.strip()]
        return [
            upper / max(1, upper + lower), digit / n, c[33] / k, c[124] / k, symbol / k, other / k, white / n, c[10] / k, same, distinct * np.log1p(k),
            float(np.minimum(sizes, 40).mean()), float((sizes > 20).mean()), 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(k)), float(k < 5),
        ]


def _measured(rows: DataFrame, first: str, kind: str) -> DataFrame:
    """rows of (first, text) with the text replaced by its features."""

    def run(batches):
        measure = Measure()
        for batch in batches:
            x = [measure(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])

    return rows.mapInArrow(run, f"{kind}, x array<double>")


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, steps: int = STEPS, l2: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w(good - bad))) over drawn pairs, by gradient descent with momentum."""
    rng = np.random.default_rng(seed)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w, v = np.zeros(d.shape[1]), np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
        v = 0.9 * v + (p @ d / len(d) - l2 * w)
        w = w + 0.5 * v
    return w


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        """x: features of the sample, y: 1 for good."""
        self.mean, self.scale, self.w, self.cut, self.unit = np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0, 1.0
        if len(y) and 0 < y.sum() < len(y):
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
            z = (x - self.mean) / self.scale
            self.w = bradley_terry(z[y == 1], z[y != 1])
            s = np.sort(z @ self.w)
            k = int((y != 1).sum())
            self.cut = float((s[k - 1] + s[k]) / 2)  # the quantile at the share of bad labels
            self.unit = float(s.std() + 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(4 * (((x - self.mean) / self.scale) @ self.w - self.cut) / self.unit, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> Model:
    rows = sample(docs, labels, label, modulus, remainder, id_col, text_col, bound)
    got = sorted(_measured(rows, "at", "at long, y double").collect())  # bound rows of some 15 numbers
    return Model(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got]))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs plus out_col."""

    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        measure = Measure()
        return pa.array(model.scores(np.array([measure(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))), pa.float64())

    return docs.withColumn(out_col, scored(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """id_col, held_out, score, predicted."""
    model = fit(docs, labels, label, modulus, remainder, id_col, text_col, **kw)
    rows = score(docs.select(id_col, F.col(text_col).alias("_text")), model, "_text")
    return rows.select(id_col, held_out(id_col, modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
