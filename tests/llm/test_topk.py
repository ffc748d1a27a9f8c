import math

import numpy as np
import pytest

from ponderloom.llm import topk


def brute(rows, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in fine:
        if i % 50 == 0:
            got = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out[i] = [(r, j, -s) for r, (s, j) in enumerate(got, 1)]
    return out


def run(spark, rows, block=64):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    q = topk.quantised(df)
    got = {}
    for r in topk.top_k(q, q.where("id % 50 = 0"), 5, block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {k: sorted(v) for k, v in got.items()}


def f32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(0, 0.2, 8).astype(np.float32).tolist(), "x") for k in range(400)]
    rows += [(1000 + k, rows[7][1], "x") for k in range(30)]  # ties
    want = {k: v for k, v in brute([(i, f32(v)) for i, v, _ in rows]).items() if v}
    assert run(spark, rows) == want and run(spark, rows, 4096) == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], "x"), (50, None, "x"), (100, [float("nan"), 1.0], "x"), (150, [None, 1.0], "x"), (3, [float("inf"), 1.0], "x"), (4, [0.5, 0.5], "x"), (None, [1.0, 1.0], "x"), (200, [0.0, 0.0], "x"), (5, [1.0], "x"), (250, [1.0, 2.0, 3.0], "x"), (6, [], "x")]
    assert run(spark, rows) == {k: v for k, v in brute([(i, f32(v)) for i, v, _ in rows]).items() if v}
    assert run(spark, []) == {}


def test_stops_early():
    rng = np.random.default_rng(1)
    x = np.zeros((5000, 2), np.int64)
    x[:, 0] = rng.integers(-1000, 1000, 5000)
    lists = topk.Lists(np.arange(5000), x)
    got, seen = lists.top(-1, np.array([3, 0]), 5)
    assert seen < 200 and [s for s, _ in got] == sorted((3 * x[:, 0]).tolist(), reverse=True)[:5]


def test_large_components(spark):
    rows = [(0, [2.0**53, 1.0], "x"), (50, [1.0, 1.0], "x"), (1, [-(2.0**53), 0.5], "x"), (2, [0.0, 1.0], "x")]
    x = np.array([[-(1 << 61), 128], [0, 256], [1, 0]], np.int64)
    assert topk.Lists(np.array([1, 2, 3]), x).top(0, np.array([1, 256]), 2)[0] == [(1 << 16, 2), (1, 3)]
    with pytest.raises(Exception, match="64 bits"):
        run(spark, rows)
    small = [(0, [0.0, 1.0], "x"), (1, [2.0**53, 1.0], "x"), (2, [0.0, 0.5], "x")]
    assert run(spark, small) == {0: [(1, 1, 1 << 16), (2, 2, 1 << 15)]}
