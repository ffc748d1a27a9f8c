"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (present or not): its words, the words' first 5 characters, pairs of neighbours, and pairs with one
word between, hashed to 2^BITS. Each coordinate has its own learning rate; L1 leaves few weights that aren't 0, so the
model is small whatever the corpus. It is trained in one task on a bounded sample (labelled.SAMPLE documents) and then
used in a map over the scan: whole texts, no shuffle.

Defined results: a null or text without words has the bias's score. Without labels (or of one class only) the model still
gives scores from what it saw; without any row, 0.5. Repeated rows each give a row. Null ids stay null and are not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, words
from .labelled import SAMPLE, held_out, sample

BITS = 20
#: L1 is above what one document's gradients can add up to over the epochs, so that a feature needs several documents to get a weight.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0
EPOCHS = 4
THRESHOLD = 0.3
STEM = 5


class Features:
    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.whole, self.stems = WordHashes(), WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        w = words(text)
        if not w:
            return np.zeros(0, np.uint32)
        h = self.whole.of(w)
        stems = self.stems.of([x[:STEM] for x in w])
        out = [mix(h), mix(stems ^ np.uint64(0x5BF03635)), mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]), mix(h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] + np.uint64(77))]
        return (np.concatenate(out) >> self.shift).astype(np.uint32)


class Ftrl:
    """Per coordinate: z (adjusted sum of gradients) and n (sum of their squares). The last coordinate is the bias, without L1."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: float) -> None:
        """at: distinct coordinates, the bias among them."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE, bits: int = BITS) -> dict[int, float]:
    """coordinate -> weight, without zeros; 2^bits is the bias's."""
    rows = sample(docs, labels, label, modulus, remainder, id_col, text_col, bound)
    packed = pa.schema([("at", pa.int64()), ("y", pa.float64()), ("x", pa.binary())])

    def hashed(batches):
        features = Features(bits)
        for batch in batches:
            x = [np.unique(features(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], schema=packed)

    def train(batches):
        rows = [(a, y, np.frombuffer(x, np.uint32)) for b in batches for a, y, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        model, bias = Ftrl(bits), np.array([1 << bits], np.int64)
        for _ in range(EPOCHS):
            for _, y, x in rows:
                model.learn(np.concatenate([x.astype(np.int64), bias]), y)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], ["at", "w"])

    got = rows.mapInArrow(hashed, "at long, y double, x binary").repartition(1).mapInArrow(train, "at long, w double").collect()
    return {r["at"]: r["w"] for r in got}  # sparse, 2^bits at most


def score(docs: DataFrame, model: dict[int, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """id_col, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("score", pa.float64())])
    at, w = np.array(list(model), np.int64), np.array(list(model.values()))

    def run(batches):
        weights = np.zeros((1 << bits) + 1)
        weights[at] = w
        features = Features(bits)
        for batch in batches:
            out = []
            for text in batch.column(1):
                x = features(text.as_py())
                x = np.unique(x[weights[x] != 0])
                out.append(1 / (1 + np.exp(-np.clip(weights[x].sum() + weights[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], schema=schema)

    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, threshold: float = THRESHOLD, id_col: str = "doc_id", **kw) -> DataFrame:
    """id_col, held_out, score, predicted."""
    rows = score(docs, fit(docs, labels, label, modulus, remainder, id_col, **kw), id_col)
    return rows.select(id_col, held_out(id_col, modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
