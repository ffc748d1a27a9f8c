"""Command line: python -m ponderloom.cli COMMAND. Each command is a job over whole folders of traces or graphs."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpora
from .operators import agreement as A
from .operators import extractors as X
from .operators import fingerprint as FP
from .operators import graph as G
from .operators import metrics as M
from .operators import nulls as N
from .operators import prune as R
from .operators import similarity as S
from .operators import stats as B
from .operators import steps as ST
from .operators import validate as V
from .operators.pruning import annotated_graphs, conditions
from .schema import PruneConfig
from .sources import readers

EXTRACTORS = {"rbe": G.extract_rules, "rbe_rand": G.extract_by_length}


def _session() -> SparkSession:
    return SparkSession.builder.appName("ponderloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _traces(spark: SparkSession, path: str) -> DataFrame:
    if path == "samples":
        return corpora.samples(spark)
    return readers.traces(spark, path).withColumn("trace_id", F.concat(F.lit("rbe_"), F.substring(F.md5("cot_text"), 1, 12)))


def _graphs(spark: SparkSession, path: str) -> DataFrame:
    return readers.graphs(spark, path)


def extract(spark, a):
    rows = EXTRACTORS[a.extractor](_traces(spark, a.input)).withColumn("extractor", F.lit(a.extractor))
    readers.write_graphs_with_text(rows, a.output) if a.text else readers.write_graphs(rows, a.output)


def quick(spark, a):
    rows = EXTRACTORS[a.extractor](spark.createDataFrame([("quick", a.text)], "trace_id string, cot_text string"))
    V.validate(rows).select(F.inline("nodes"), "is_valid").show(truncate=60)


def visualize(spark, a):
    _graphs(spark, a.input).select(G.to_dot().alias("value")).write.text(a.output)


def validate(spark, a):
    V.long_violations(_graphs(spark, a.input), strict=a.strict).write.json(a.output)


def gcp(spark, a):
    A.gcs_summary(A.gcs(corpora.gold(spark), whole=False)).show()


def compare(spark, a):
    rows = S.tsi_rows(_graphs(spark, a.input).unionByName(_graphs(spark, a.other)))
    c = S.classes(rows, "motif", "feat")
    S.against(c, c).where("rep_a < rep_b").select("rep_a", "rep_b", S.tsi().alias("tsi")).write.parquet(a.output)


def prune(spark, a):
    cfg = PruneConfig(use_calibration_signal=a.calibration, use_prm_signal=a.prm)
    rows = R.regions(R.with_config(_graphs(spark, a.input), cfg))
    rows = R.fuse(rows) if a.calibration or a.prm else rows
    if a.apply:
        out = R.apply(rows).withColumn("trace_id", F.concat("trace_id", F.lit("_pruned"))).drop("nodes", "edges").withColumnsRenamed({"pruned_nodes": "nodes", "pruned_edges": "edges"})
        readers.write_graphs(out, a.output)
    else:
        R.long_regions(rows).write.json(a.output)


def enroll(spark, a):
    rows = FP.features(_graphs(spark, a.input).withColumn("model", F.lit(a.model)), "model")
    readers.write_signatures(FP.moments(rows), a.output)


def identify(spark, a):
    FP.identify(FP.features(_graphs(spark, a.input)), FP.signatures(readers.read_signatures(spark, a.signatures)), a.method).write.json(a.output)


def benchmark(spark, a):
    two = A.extractors(spark, _traces(spark, a.input))
    A.graph_agreement(two).show()
    A.structure_agreement(two).show()
    V.validate(two, strict=False).groupBy("extractor").agg(F.avg(F.col("is_valid").cast("double")).alias("pass_rate")).show()


def analyze(spark, a):
    M.summary(M.metric_matrix(_graphs(spark, a.input)), M.METRICS).orderBy("metric").show(30, truncate=False)


def annotate(spark, a):
    V.annotate_steps(_graphs(spark, a.input)).write.json(a.output)


def correlate(spark, a):
    rows = M.metric_matrix(_graphs(spark, a.input)).join(readers.labels(spark, a.labels), "trace_id", "left")
    rows = rows.withColumn("label", F.coalesce("correct", F.lit(True)).cast("double"))
    B.bh_fdr(B.with_p(B.spearman(M.unpivoted(rows, M.METRICS, "trace_id", "label")))).orderBy(F.abs("rho").desc_nulls_last()).show(30, truncate=False)


def cluster(spark, a):
    readers.write_graphs(ST.rebuild(ST.cluster_ids(_graphs(spark, a.input))), a.output)


def randomize(spark, a):
    readers.write_graphs(N.randomise(_graphs(spark, a.input), a.method, a.draws).withColumn("trace_id", F.concat_ws("_", "trace_id", "draw")), a.output)


def calibrate(spark, a):
    """Thresholds by coordinate descent over graphs with known redundant nodes: made ones, or those of a table (trace_id, gold)."""
    if a.graphs:
        rows = _graphs(spark, a.graphs).join(spark.read.json(a.gold).selectExpr("cast(trace_id as string) trace_id", "cast(gold as array<int>) gold"), "trace_id")
    else:
        rows = annotated_graphs(spark, a.n)
    config, f1 = R.calibrate(rows.withColumn("domain", F.lit(a.domain)).persist(), PruneConfig(), a.rounds)
    spark.createDataFrame([(json.dumps(asdict(config)), f1)], "config string, f1 double").write.json(a.output)


def end_to_end(spark, a):
    """The control, structural and signal conditions over texts: made ones with known redundancy, or those of a folder."""
    traces = X.synthetic_texts(spark, a.n).withColumnRenamed("question_id", "trace_id") if a.input == "synthetic" else _traces(spark, a.input)
    conditions(G.extract_rules(traces)).orderBy("condition").write.json(a.output)


def everything(spark, a):
    """Extraction, rules, metrics, redundancy and agreement of one folder of texts, each into its own folder."""
    at = a.output.rstrip("/") + "/"
    traces = _traces(spark, a.input)
    readers.write_graphs_with_text(EXTRACTORS["rbe"](traces), at + "graphs_with_text")
    readers.write_graphs(EXTRACTORS["rbe"](traces), at + "graphs")
    graphs = EXTRACTORS["rbe"](traces)
    V.long_violations(graphs).write.json(at + "violations")
    M.summary(M.metric_matrix(graphs), M.METRICS).write.json(at + "metrics")
    R.report(R.regions(R.with_config(graphs.withColumn("domain", F.lit("math")), PruneConfig()))).write.json(at + "redundancy")
    conditions(graphs).write.json(at + "end_to_end")
    A.decision(A.extractors(spark, traces)).write.json(at + "decision")
    A.gcs_summary(A.gcs(corpora.gold(spark))).write.json(at + "gold")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ponderloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(f, *args, **kw):
        c = sub.add_parser(f.__name__, **kw)
        c.set_defaults(run=f)
        for name in args:
            c.add_argument(name)
        return c

    for f in (extract, quick, benchmark, gcp):
        c = add(f, *{"extract": ("input", "output"), "quick": ("text",), "benchmark": ("input",), "gcp": ()}[f.__name__])
        if f in (extract, quick):
            c.add_argument("--extractor", choices=EXTRACTORS, default="rbe")
        if f is extract:
            c.add_argument("--text", action="store_true", help="keep the nodes' text")
    add(visualize, "input", "output")
    add(validate, "input", "output").add_argument("--strict", action="store_true")
    add(compare, "input", "other", "output")
    c = add(prune, "input", "output")
    for flag in ("--apply", "--calibration", "--prm"):
        c.add_argument(flag, action="store_true")
    c = add(calibrate, "output")
    c.add_argument("--graphs")
    c.add_argument("--gold", help="JSON lines of trace_id and gold (ids of redundant nodes)")
    c.add_argument("--domain", default="math")
    c.add_argument("--n", type=int, default=200)
    c.add_argument("--rounds", type=int, default=2)
    add(end_to_end, "input", "output").add_argument("--n", type=int, default=50)
    add(everything, "input", "output")
    add(enroll, "input", "model", "output")
    add(identify, "input", "signatures", "output").add_argument("--method", default="mahalanobis", choices=("mahalanobis", "cosine", "euclidean"))
    add(analyze, "input")
    add(annotate, "input", "output")
    add(correlate, "input", "labels")
    add(cluster, "input", "output")
    c = add(randomize, "input", "output")
    c.add_argument("--method", default="jp_dpr", choices=("jp_dpr", "edge_rewire"))
    c.add_argument("--draws", type=int, default=10)
    a = p.parse_args(argv)
    a.run(_session(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
