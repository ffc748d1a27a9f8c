"""Metrics of single graphs and their summaries. Row by row until a summary groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import word_count
from ..schema import TYPES
from .graph import with_depth

E = F.expr
#: What the seven first-level features are divided by.
SCALES = {"depth": 30.0, "branching_factor": 5.0, "verification_density": 1.0, "backtrack_rate": 1.0, "topological_entropy": 3.0, "n_nodes": 100.0, "n_edges": 200.0}


def type_count(kind: str, nodes: str = "nodes") -> Column:
    return F.size(F.filter(nodes, lambda n: n["type"] == kind))


def _counted(graphs: DataFrame) -> DataFrame:
    rows = with_depth(graphs)
    for t in TYPES:
        rows = rows.withColumn(f"n_{t.lower()}", type_count(t))
    return rows.withColumn("_n", F.size("nodes")).withColumn("_m", F.size(F.array_distinct("edges")))


@F.pandas_udf(DoubleType())
def entropy_bits(shares):
    """Entropy of shares that are summed in their order, by the C library's log2: Spark's is a quotient of natural logarithms and differs in the last bit."""
    import pandas as pd

    known: dict = {}

    def one(p) -> float:
        if p not in known:
            total = 0.0
            for x in p:
                total += x * math.log2(x) if x > 0 else 0.0
            known[p] = 0.0 - total
        return known[p]

    return pd.Series([one(tuple(p)) for p in shares], dtype="float64")


def level1(graphs: DataFrame, *keep: str) -> DataFrame:
    """Depth, mean out-degree of nodes that have one, shares of Verify and Backtrack, entropy in bits, counts."""
    rows = _counted(graphs)
    p = [F.col(f"n_{t.lower()}") / F.greatest("_n", F.lit(1)) for t in TYPES]
    entropy = entropy_bits(F.array(*p))
    sources = E("size(array_distinct(transform(edges, e -> e.src)))")
    return rows.select(
        "trace_id", *keep, F.col("depth").cast("double").alias("depth"), F.when(sources > 0, F.col("_m") / sources).otherwise(F.lit(0.0)).alias("branching_factor"),
        p[3].alias("verification_density"), p[5].alias("backtrack_rate"), entropy.alias("topological_entropy"), F.col("_n").alias("n_nodes"), F.col("_m").alias("n_edges"),
        *[f"n_{t.lower()}" for t in TYPES],
    )


def normalised(rows: DataFrame) -> Column:
    """First-level features scaled to 0..1, array<double>."""
    return F.array(*[F.least(F.greatest(F.col(c) / s, F.lit(0.0)), F.lit(1.0)) for c, s in SCALES.items()])


def graph_metrics(graphs: DataFrame, *keep: str) -> DataFrame:
    """n counts as 1 at least; branching is m/n; entropy is natural with 1e-10 in the logarithm; an empty graph has no average degree."""
    rows = _counted(graphs)
    n, m = F.greatest("_n", F.lit(1)), F.col("_m")
    p = [F.col(f"n_{t.lower()}") / n for t in TYPES]
    entropy = -sum((F.when(x > 0, x * F.log(x + 1e-10)).otherwise(F.lit(0.0)) for x in p), F.lit(0.0))
    return rows.select(
        "trace_id", *keep, n.alias("n_nodes"), m.alias("n_edges"), F.col("depth").cast("double").alias("depth"), (m / n).alias("branching"), p[3].alias("verify_density"), p[5].alias("backtrack_rate"),
        entropy.alias("entropy"), F.when(F.col("_n") > 0, 2 * m / n).alias("avg_degree"), (m / F.when(n > 1, n * (n - 1) / 2).otherwise(F.lit(1.0))).alias("graph_density"), F.lit(1.0).alias("extraction_rate"),
    )


#: The 19 metrics of the correlation benchmark, in their order.
METRICS = (
    "n_nodes", "n_edges", "depth", "branching", "verify_density", "backtrack_rate", "entropy", "avg_degree", "graph_density", "extraction_rate",
    *[f"{t.lower()}_ratio" for t in TYPES], "max_out_degree", "n_leaf_nodes", "mean_text_len",
)


def metric_matrix(graphs: DataFrame, *keep: str) -> DataFrame:
    """The 19 metrics as columns. The last three count edges as listed, duplicates too."""
    ratios = [(type_count(t) / F.greatest(F.size("nodes"), F.lit(1))).alias(f"{t.lower()}_ratio") for t in TYPES]
    most = E("coalesce(array_max(transform(nodes, n -> size(filter(edges, e -> e.src = n.id)))), 0)").cast("double")
    leaves = E("size(filter(nodes, n -> not exists(edges, e -> e.src = n.id)))").cast("double")
    words = F.aggregate("nodes", F.lit(0.0), lambda a, n: a + word_count(n["text"])) / F.greatest(F.size("nodes"), F.lit(1))
    more = graphs.select("*", *ratios, most.alias("max_out_degree"), leaves.alias("n_leaf_nodes"), words.alias("mean_text_len"))
    rows = graph_metrics(more, *keep, *METRICS[10:])
    return rows.select("trace_id", *keep, *[F.col(c).cast("double").alias(c) for c in METRICS])


def unpivoted(rows: DataFrame, names: tuple[str, ...], *keep: str) -> DataFrame:
    """(keep, spec, metric, value)"""
    pairs = F.array(*[F.struct(F.lit(k).alias("spec"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for k, c in enumerate(names)])
    return rows.select(*keep, F.inline(pairs))


def summary(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    long = unpivoted(rows, names)
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def type_histogram(graphs: DataFrame, *by: str) -> DataFrame:
    return graphs.select(*by, F.explode("nodes").alias("n")).groupBy(*by, F.col("n.type").alias("type")).agg(F.count("*").alias("n"))


def plan_redundancy(graphs: DataFrame) -> Column:
    """Share of the nodes that are Branch or Backtrack without a child that does work."""
    return E("""if(size(nodes) = 0, null, size(filter(nodes, n -> n.type in ('Branch', 'Backtrack') and not exists(edges, e -> e.src = n.id and
        exists(nodes, c -> c.id = e.dst and c.type in ('Transform', 'Retrieve', 'Compare'))))) / size(nodes))""")


def by_correctness(rows: DataFrame, names: tuple[str, ...], label: str = "correct") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in names])
