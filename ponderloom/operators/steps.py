"""Steps: features of nodes, clusters of steps, an error classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_jaccard, word_count
from ..schema import NODE, TYPES
from .graph import fixed, node_depths
from .validate import violations

E = F.expr
FEATURES = ("in_degree", "out_degree", "depth_from_root", "position_ratio", "text_len", "text_words", "verify_no_incoming", "branch_underfork", "consecutive_transform", "has_backtrack_edge", "branching_ratio", *[f"type_{t.lower()}" for t in TYPES])


def features(graphs: DataFrame, *keep: str) -> DataFrame:
    """(trace_id, keep, node_id, 17 features) for each node; degrees count edges as listed. Inside each graph's row."""
    rows = graphs.select("trace_id", *keep, "nodes", "edges", node_depths(down=False).alias("_d"), E("map_from_entries(transform(nodes, n -> struct(n.id, n.type)))").alias("_t"))
    rows = fixed(rows)
    near = lambda kind: f"exists(edges, e -> (e.dst = n.id and _t[e.src] = '{kind}') or (e.src = n.id and _t[e.dst] = '{kind}'))"
    each = E(f"""transform(nodes, (n, i) -> named_struct('node_id', n.id, 'type', n.type, 'text', n.text,
        'in_degree', cast(size(filter(edges, e -> e.dst = n.id)) as double), 'out_degree', cast(size(filter(edges, e -> e.src = n.id)) as double),
        'depth_from_root', cast(_d[n.id] as double), 'position_ratio', i / greatest(size(nodes) - 1, 1), 'n', size(nodes),
        'consecutive_transform', if(n.type = 'Transform' and {near('Transform')}, 1.0D, 0.0D), 'has_backtrack_edge', if({near('Backtrack')}, 1.0D, 0.0D)))""")
    long = rows.select("trace_id", *keep, F.inline(each))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return long.select(
        "trace_id", *keep, "node_id", "in_degree", "out_degree", "depth_from_root", "position_ratio", F.length("text").cast("double").alias("text_len"), word_count(F.col("text")).cast("double").alias("text_words"),
        yes((F.col("type") == "Verify") & (F.col("in_degree") == 0)).alias("verify_no_incoming"), yes((F.col("type") == "Branch") & (F.col("out_degree") < 2)).alias("branch_underfork"),
        "consecutive_transform", "has_backtrack_edge", (F.col("out_degree") / F.greatest(F.col("n") - 1, F.lit(1))).alias("branching_ratio"), *[yes(F.col("type") == t).alias(f"type_{t.lower()}") for t in TYPES],
    )


def cluster_ids(graphs: DataFrame, least: float = 0.30, chain_only: bool = False, longest: int = 5, similarity=None) -> DataFrame:
    """graphs plus cluster (array<int>, from 1, for each node in order). Neighbours in id order merge if an edge joins them that is the
    only one out of the first and into the second, and they have one type or are similar; with chain_only, up to `longest` nodes whatever they are."""
    like = similarity or token_jaccard
    sim = F.transform("nodes", lambda n, i: F.when(i > 0, like(F.get(F.col("nodes"), i - 1)["text"], n["text"])).otherwise(0.0)) if not chain_only else F.transform("nodes", lambda n: F.lit(1.0))
    rows = fixed(graphs.withColumn("_sim", sim))
    joined = """i > 0 and exists(edges, e -> e.src = get(nodes, i - 1).id and e.dst = n.id) and size(filter(edges, e -> e.src = get(nodes, i - 1).id)) = 1 and size(filter(edges, e -> e.dst = n.id)) = 1"""
    same = "true" if chain_only else f"(get(nodes, i - 1).type = n.type or _sim[i] >= {least}D)"
    rows = fixed(rows.withColumn("_join", E(f"transform(nodes, (n, i) -> {joined} and {same})")))
    limit = f" and acc.k < {longest}" if chain_only else ""
    ids = E(f"""aggregate(_join, named_struct('c', 0, 'k', 0, 'out', cast(array() as array<int>)), (acc, j) -> named_struct(
        'c', if(j{limit}, acc.c, acc.c + 1), 'k', if(j{limit}, acc.k + 1, 1), 'out', array_append(acc.out, if(j{limit}, acc.c, acc.c + 1)))).out""")
    return fixed(rows.withColumn("cluster", ids).drop("_sim", "_join"))


def rebuild(rows: DataFrame) -> DataFrame:
    """rows (with cluster) with a node for each cluster: the most frequent type (the first of equals), joined texts, the hull of spans;
    edges between different clusters, once."""
    rows = fixed(rows.withColumn("_z", E("transform(nodes, (n, i) -> named_struct('c', cluster[i], 'n', n))")).withColumn("_of", E("map_from_entries(transform(nodes, (n, i) -> struct(n.id, cluster[i])))")))
    members = "transform(filter(_z, z -> z.c = c), z -> z.n)"
    best = "array_max(transform(m, (x, i) -> named_struct('k', size(filter(m, y -> y.type = x.type)), 'at', -i, 'type', x.type))).type"
    node = f"transform(array({members}), m -> named_struct('id', c, 'type', {best}, 'text', trim(array_join(filter(transform(m, x -> x.text), t -> t <> ''), ' ')), 'span', named_struct('start', array_min(transform(m, x -> x.span.start)), 'end', array_max(transform(m, x -> x.span.end)))))[0]"
    nodes = E(f"cast(if(size(nodes) = 0, array(), transform(sequence(1, greatest(array_max(cluster), 1)), c -> {node})) as array<{NODE}>)")
    edges = E("array_distinct(filter(transform(edges, e -> named_struct('src', _of[e.src], 'dst', _of[e.dst])), e -> e.src <> e.dst))")
    return fixed(rows.withColumn("_new", nodes).withColumn("_links", edges).drop("nodes", "edges", "_z", "_of", "cluster").withColumnsRenamed({"_new": "nodes", "_links": "edges"}))


def labelled(graphs: DataFrame) -> DataFrame:
    """Node features with label 1.0 where a rule violation names the node, and its failure modes."""
    rows = fixed(graphs.withColumn("_v", violations(strict=False)))
    f = features(rows, "_v")
    mine = F.filter("_v", lambda v: F.array_contains(v["node_ids"], F.col("node_id")))
    modes = F.array_join(F.array_sort(F.array_distinct(F.transform(mine, lambda v: v["failure_mode"]))), ",")
    return f.withColumn("label", (F.size(mine) > 0).cast("double")).withColumn("failure_modes", modes).withColumn("rule_violations", F.size(mine)).drop("_v")


class StepClassifier:
    """Gradient-boosted trees on the 17 features."""

    def __init__(self, iterations: int = 100, depth: int = 3, seed: int = 42):
        self.iterations, self.depth, self.seed, self.model = iterations, depth, seed, None

    def fit(self, rows: DataFrame) -> StepClassifier:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=self.iterations, maxDepth=self.depth, stepSize=0.1, seed=self.seed)
        self.model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), gbt]).fit(rows)
        return self

    def diagnose(self, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        p = self.model.transform(rows).withColumn("p_error", F.get(vector_to_array("probability"), 1))
        return p.select("trace_id", "node_id", "p_error", (F.col("p_error") >= threshold).alias("flagged"), "failure_modes", "rule_violations")

    def importance(self) -> dict[str, float]:
        return dict(zip(FEATURES, self.model.stages[-1].featureImportances.toArray().tolist(), strict=True))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> StepClassifier:
        from pyspark.ml import PipelineModel

        self.model = PipelineModel.load(path)
        return self
