"""Composed pipelines: segment extraction, model answers, synthetic texts, the pilot, the data analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import corpora
from ..operators import agreement as A
from ..operators import extractors as X
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import nulls as N
from ..operators import prune as R
from ..operators import similarity as S
from ..operators import stats as B
from ..operators import validate as V
from ..schema import PruneConfig
from .fixtures import order_cots, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def sbe_nodes(spark, sf):
    return G.long_nodes(X.extract_segments(order_cots(spark, sf))).select("trace_id", "node_id", "type", "text")


@query
def model_extraction(spark, sf):
    """Graphs of a client's answers (a constant one here), with retries and errors kept."""
    rows = X.extract_by_model(order_cots(spark, sf))
    return rows.select("trace_id", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), "domain", "error")


@query
def synthetic_redundancy(spark, sf):
    """Synthetic texts with known redundancy: regions found by kind of redundancy put in."""
    t = X.synthetic_texts(spark, 500).withColumnRenamed("question_id", "trace_id")
    rows = R.regions(R.with_config(G.extract_rules(t).withColumn("domain", F.lit("math")), PruneConfig()))
    return rows.select(F.explode(F.split("redundancy_types", ",")).alias("kind"), "regions").groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.size("regions")).alias("mean_regions"))


def _three(spark, traces, *keep):
    named = lambda df, n: df.select("trace_id", F.lit(n).alias("extractor"), "nodes", "edges", *keep)
    return named(G.extract_rules(traces), "rbe").unionByName(named(X.extract_segments(traces), "sbe")).unionByName(named(G.extract_by_length(traces), "rbe_rand"))


@query
def pilot(spark, sf):
    """Gold score, viability, agreement of the extractors and the decision, on the sample texts."""
    from .stats_q import gcp_calibration, synthetic_validation

    passed = gcp_calibration(spark, sf).agg(F.sum(F.col("passed").cast("int")).alias("gcp_passed"))
    viable = synthetic_validation(spark, sf).agg(F.sum(F.col("viable").cast("int")).alias("viable"))
    three = _three(spark, corpora.samples(spark))
    iaa = A.graph_agreement(three).join(A.motif_agreement(three), F.lit(True)).join(A.structure_agreement(three), F.lit(True))
    one = passed.join(viable, F.lit(True)).join(iaa, F.lit(True))  # tables of one row
    go = (F.col("kappa") > 0.5) & (F.col("gcp_passed") >= 2) & (F.col("viable") >= 1)
    return one.withColumn("decision", F.when(go, "GO").when((F.col("kappa") < 0.3) | (F.col("gcp_passed") == 0), "NO-GO").otherwise("CONDITIONAL_GO"))


@query
def data_analysis(spark, sf):
    """By model: traces, mean metrics, pass rate, plan redundancy of the order graphs."""
    g = G.extract_rules(order_cots(spark, sf)).withColumn("model", F.col("trace_id") % 4)
    g = V.validate(g, strict=False).withColumn("plan", M.plan_redundancy(g))
    m = M.graph_metrics(g, "model", "is_valid", "plan")
    return m.groupBy("model").agg(F.count("*").alias("n"), F.avg("n_nodes").alias("n_nodes"), F.avg("depth").alias("depth"), F.avg("entropy").alias("entropy"), F.avg(F.col("is_valid").cast("double")).alias("pass_rate"), F.avg("plan").alias("plan_redundancy"))


@query
def stable_against_null(spark, sf):
    """The sample graphs' mean similarity against the 95th percentile of that between them and null graphs."""
    g = G.extract_rules(corpora.samples(spark))
    real = S.classes(S.tsi_rows(g), "motif", "feat").select("rep", "motif", "feat")
    null = N.randomise(g, "jp_dpr", 10)
    fake = S.tsi_rows(null.withColumn("trace_id", F.concat_ws("/", "trace_id", "draw"))).select(F.col("trace_id").alias("rep"), "motif", "feat")
    threshold = N.null_threshold(S.against(real, fake).select(S.tsi().alias("score")))
    mean = S.against(real, real).where("rep_a < rep_b").agg(F.avg(S.tsi()).alias("mean_tsi"))
    return mean.join(threshold.select("threshold"), F.lit(True)).withColumn("stable", F.col("mean_tsi") > F.col("threshold"))


@query
def doc_correlation(spark, sf):
    """Rank correlation of the documents' graph metrics (by length types) with the quality label."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("trace_id"), F.col("text").alias("cot_text"), F.col("quality").cast("double").alias("label"))
    rows = M.metric_matrix(G.extract_by_length(docs), "label")
    return B.bh_fdr(B.with_p(B.spearman(M.unpivoted(rows, M.METRICS, "trace_id", "label")))).select("metric", "rho", "n", "p", "q")
