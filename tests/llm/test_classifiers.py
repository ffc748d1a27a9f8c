import random
import zlib

import numpy as np
import pytest

from ponderloom.llm import quality, toxicity

WORDS = [a + b for a in "ba ko ti lu me ra so ni".split() for b in "nor dak lim pet".split()]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(600):
        w = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        toxic = k % 6 == 0
        junk = k % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "scum"])
        if junk:
            w = [x.upper() + "!!" for x in w] if k % 2 else [x for x in w for _ in range(6)]
        docs.append((k, " ".join(w), "x"))
        labels.append((k, 0 if junk else 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, labels, column):
    y = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    return sum(r.predicted == y[r.doc_id] for r in held) / len(held)


@pytest.mark.parametrize(("module", "column", "modulus", "remainder"), [(toxicity, "toxic", 4, 2), (quality, "quality", 3, 1)])
def test_held_out_accuracy(corpus, module, column, modulus, remainder):
    rows = module.classify(*corpus).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in rows)
    assert accuracy(rows, corpus[1], column) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_held_out_labels_are_not_used(corpus, spark, module):
    docs, labels = corpus
    m, r = (4, 2) if module is toxicity else (3, 1)
    column = "toxic" if module is toxicity else "quality"
    flipped = labels.selectExpr("doc_id", *[f"if(crc32(cast(doc_id as string)) % {m} = {r}, 1 - {c}, {c}) as {c}" for c in ("quality", "toxic")])
    a = {x.doc_id: x.score for x in module.classify(docs, labels, column).collect()}
    b = {x.doc_id: x.score for x in module.classify(docs, flipped, column).collect()}
    assert a == b


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(odd, no_rows, corpus, spark, module):
    rows = module.classify(odd, corpus[1]).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert module.classify(no_rows, corpus[1]).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(module.classify(odd, none).collect()) == odd.count()


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    model, bias = toxicity.Ftrl(10), np.array([1 << 10])
    for k in range(2000):
        x = np.unique(rng.integers(0, 900, 20))
        y = float(k % 4 == 0)
        model.learn(np.concatenate([x, [1000] if y else [], bias]).astype(np.int64), y)
    w = model.weights(np.arange(len(model.z)))
    assert w[1000] == w[:-1].max() > 1 and (w == 0).mean() > 0.3


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(1)
    good, bad = rng.normal([1, 0], 1, (500, 2)), rng.normal([-1, 0], 1, (500, 2))
    w = quality.bradley_terry(good, bad)
    assert w[0] > 5 * abs(w[1]) and (good @ w).mean() > (bad @ w).mean()


def test_ftrl_equals_the_plain_algorithm():
    """Coordinate by coordinate, in loops, as published."""
    import math

    rng = random.Random(1)
    model = toxicity.Ftrl(bits=6)
    z, n = {}, {}
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        lam = 0.0 if i == 64 else l1
        if abs(z.get(i, 0.0)) <= lam:
            return 0.0
        return -(z[i] - math.copysign(lam, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(400):
        x = sorted(rng.sample(range(64), 5)) + [64]
        y = float(x[0] < 8)
        model.learn(np.array(x), y)
        w = {i: weight(i) for i in x}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in x:
            s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / a
            z[i] = z.get(i, 0.0) + g - s * w[i]
            n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(model.weights(np.arange(65)), [weight(i) for i in range(65)]) and np.count_nonzero(model.weights(np.arange(64))) > 0


def test_bradley_terry_minimises_the_plain_pairwise_loss():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.5, 1, (300, 3)), rng.normal(0, 1, (200, 3))
    w = quality.bradley_terry(good, bad, pairs=20_000)

    every = (good[:, None, :] - bad[None, :, :]).reshape(-1, 3)

    def loss(w):
        return float(np.log1p(np.exp(-(every @ w))).mean())

    assert loss(w) < loss(np.zeros(3)) and all(loss(w) < loss(w + d) for d in np.vstack([np.eye(3), -np.eye(3)]) * 0.3)
