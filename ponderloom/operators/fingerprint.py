"""Model fingerprints: 18 features of a graph, signatures as mergeable moments, identification by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .graph import fixed
from .metrics import graph_metrics
from .motifs import presence, with_counts

DIM = 18
E = F.expr


def features(graphs: DataFrame, *keep: str) -> DataFrame:
    """trace_id, keep, x: six structural metrics and twelve motif presences, standardised within the row."""
    rows = fixed(with_counts(graphs).withColumn("_p", presence("typed")))
    m = graph_metrics(rows, "_p", *keep)
    raw = fixed(m.select("trace_id", *keep, F.concat(F.array(*[F.col(c).cast("double") for c in ("n_nodes", "n_edges", "depth", "branching", "verify_density", "entropy")]), "_p").alias("v")))
    mean = E("aggregate(v, 0.0D, (a, x) -> a + x) / size(v)")
    raw = fixed(raw.withColumn("_m", mean))
    raw = fixed(raw.withColumn("_s", E("sqrt(aggregate(v, 0.0D, (a, x) -> a + (x - _m) * (x - _m)) / size(v)) + 1e-8D")))
    return raw.select("trace_id", *keep, E("transform(v, x -> (x - _m) / _s)").alias("x"))


def moments(rows: DataFrame, by: str = "model") -> DataFrame:
    """by, n, s (sums), ss (sums of the 171 products): moments that can be added to others'."""
    x = [F.get("x", i) for i in range(DIM)]
    flat = rows.select(by, *[c.alias(f"x{i}") for i, c in enumerate(x)])
    agg = [F.count("*").alias("n"), F.array(*[F.sum(f"x{i}") for i in range(DIM)]).alias("s"), F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(DIM) for j in range(i, DIM)]).alias("ss")]
    return flat.groupBy(by).agg(*agg)


def merged(a: DataFrame, b: DataFrame, by: str = "model") -> DataFrame:
    """Signatures updated by more observations: exact, in any order."""
    add = lambda c, k: F.array(*[F.sum(F.get(c, i)) for i in range(k)]).alias(c)
    return a.unionByName(b).groupBy(by).agg(F.sum("n").alias("n"), add("s", DIM), add("ss", DIM * (DIM + 1) // 2))


def signatures(m: DataFrame, by: str = "model") -> DataFrame:
    """by, n, mean, std (sample, plus 1e-8; null of one row), cov (18 x 18 in one array; 1e-4 on the diagonal of one row)."""
    at = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(DIM) for j in range(i, DIM))}
    cov = lambda i, j: (F.get("ss", at[min(i, j), max(i, j)]) - F.get("s", i) * F.get("s", j) / F.col("n")) / (F.col("n") - 1)
    one = F.col("n") < 2
    return m.select(
        by, "n", F.transform("s", lambda v: v / F.col("n")).alias("mean"), F.array(*[F.when(~one, F.sqrt(F.greatest(cov(i, i), F.lit(0.0))) + 1e-8) for i in range(DIM)]).alias("std"),
        F.array(*[F.when(one, F.lit(1e-4 if i == j else 0.0)).otherwise(cov(i, j)) for i in range(DIM) for j in range(DIM)]).alias("cov"),
    )


@F.pandas_udf(ArrayType(DoubleType()))
def inverted(cov):
    """Pseudo-inverses of signatures' covariances, with 1e-6 on the diagonal."""
    import numpy as np

    return cov.map(lambda c: np.linalg.pinv(np.array(c).reshape(DIM, DIM) + 1e-6 * np.eye(DIM)).ravel())


def identify(rows: DataFrame, sigs: DataFrame, method: str = "mahalanobis", by: str = "model") -> DataFrame:
    """trace_id, predicted, distance, confidence (inverse distances). Rows are dealt into blocks and signatures (a row for each model) go to each
    block by an equi-join: Spark broadcasts them only where they are small. Nothing comes to the driver."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = sigs.select(F.col(by).alias("_model"), "mean", (inverted("cov") if method == "mahalanobis" else F.array().cast("array<double>")).alias("inv"))
    known = fixed(known).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = rows.select("trace_id", "x", F.pmod(F.xxhash64("trace_id"), F.lit(blocks)).cast("int").alias("_k"))
    pairs = fixed(dealt.join(known, "_k").withColumn("d", E("zip_with(x, mean, (a, b) -> a - b)")))
    if method == "mahalanobis":
        q = E(f"sqrt(greatest(0.0D, aggregate(transform(d, (a, i) -> a * aggregate(transform(d, (b, j) -> b * inv[i * {DIM} + j]), 0.0D, (s, v) -> s + v)), 0.0D, (s, v) -> s + v)))")
    elif method == "cosine":
        q = E("1 - aggregate(zip_with(x, mean, (a, b) -> a * b), 0.0D, (s, v) -> s + v) / (sqrt(aggregate(x, 0.0D, (s, v) -> s + v * v)) * sqrt(aggregate(mean, 0.0D, (s, v) -> s + v * v)) + 1e-10D)")
    elif method == "euclidean":
        q = E("sqrt(aggregate(d, 0.0D, (s, v) -> s + v * v))")
    else:
        raise ValueError(f"unknown method {method!r}")
    best = pairs.select("trace_id", "_model", q.alias("dist")).groupBy("trace_id").agg(F.min(F.struct("dist", "_model")).alias("b"), F.sum(1 / F.greatest("dist", F.lit(1e-6))).alias("t"))
    return best.select("trace_id", F.col("b._model").alias("predicted"), F.col("b.dist").alias("distance"), (1 / F.greatest("b.dist", F.lit(1e-6)) / F.col("t")).alias("confidence"))
