"""Experiments on pruning: graphs with known redundant nodes, conditions compared end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NODE, PruneConfig
from . import prune as R
from .graph import fixed
from .metrics import plan_redundancy
from .validate import validate

CONDITIONS = {"control": None, "structural": PruneConfig(), "signal": PruneConfig(use_calibration_signal=True, use_prm_signal=True)}


def annotated_graphs(spark: SparkSession, n: int = 400) -> DataFrame:
    """Graphs with gold (ids of redundant nodes): a chain of Transforms, then perhaps Verifies (all redundant), then perhaps more Transforms
    (redundant from the fourth on)."""
    base, verify, extra = F.col("id") % 5 + 6, F.when(F.col("id") % 3 == 0, F.col("id") % 2 + 2).otherwise(0), F.when(F.col("id") % 4 == 1, F.col("id") % 3 + 4).otherwise(0)
    rows = spark.range(n).select(F.col("id").cast("string").alias("trace_id"), base.cast("int").alias("b"), verify.cast("int").alias("v"), extra.cast("int").alias("x"))
    nodes = F.expr(f"cast(transform(sequence(1, b + v + x), i -> named_struct('id', i, 'type', if(i > b and i <= b + v, 'Verify', 'Transform'), 'text', concat('step ', i), 'span', named_struct('start', 0, 'end', 0))) as array<{NODE}>)")
    edges = F.expr("cast(transform(sequence(1, b + v + x - 1), i -> named_struct('src', i, 'dst', i + 1)) as array<struct<src:int,dst:int>>)")
    gold = F.expr("filter(sequence(1, b + v + x), i -> (i > b and i <= b + v) or i > b + v + 3)")
    return fixed(rows.select("trace_id", nodes.alias("nodes"), edges.alias("edges"), gold.alias("gold"), F.lit("synthetic").alias("domain")))


def conditions(graphs: DataFrame, domain: str = "math", weight: str | None = None) -> DataFrame:
    """condition, n, and the means over graphs of compression, pass rate, integrity, regions and change of plan redundancy. Under "control" nothing is found or cut.
    All conditions follow from one pass over the graphs. weight: a column that says for how many graphs one stands."""
    rows = graphs.withColumn("domain", F.lit(domain)).withColumn("_weight", F.col(weight).cast("long") if weight else F.lit(1).cast("long")).withColumn("before", plan_redundancy(graphs))
    for name, cfg in CONDITIONS.items():
        rows = R.with_config(rows, cfg or PruneConfig()).withColumnRenamed("cfg", f"_{name}")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("condition"), F.col(f"_{name}").alias("cfg")) for name in CONDITIONS]))
    rows = fixed(rows).select("trace_id", "nodes", "edges", "_weight", "before", each.alias("_c")).select("*", "_c.*").drop("_c")
    rows = R.regions(rows).withColumn("_plain", F.col("regions"))
    none = [name for name, cfg in CONDITIONS.items() if cfg is None]
    mine = F.when(F.col("condition").isin(none), F.slice("_plain", 1, 0)).when(F.col("condition") == "signal", F.col("regions")).otherwise(F.col("_plain"))
    rows = R.apply(fixed(R.fuse(rows).withColumn("regions", mine).drop("_plain")))
    new = rows.withColumn("old", F.size("nodes")).withColumn("k", F.size("regions")).drop("nodes", "edges").withColumnsRenamed({"pruned_nodes": "nodes", "pruned_edges": "edges"})
    new = validate(new, strict=False).withColumn("after", plan_redundancy(graphs))
    out = fixed(new.select("condition", "_weight", (1 - F.size("nodes") / F.col("old")).alias("c"), F.col("is_valid").cast("double").alias("v"), "integrity", F.col("k").cast("double").alias("k"), (F.col("after") - F.col("before")).alias("d")))
    mean = lambda c: F.sum(F.col("_weight") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("_weight")))
    return out.groupBy("condition").agg(F.sum("_weight").alias("n"), mean("c").alias("compression"), mean("v").alias("pass_rate"), mean("integrity").alias("integrity"), mean("k").alias("regions"), mean("d").alias("plan_change"))
