"""Statistics in aggregations: rank correlation, false-discovery control, bootstrap, effect sizes, rank tests, power, costs."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ranked(long: DataFrame, *by: str, parts: int = 64) -> DataFrame:
    """long (by, value) plus rank: average ranks of ties. Values are counted first; the distinct ones of a group are cut at sampled quantiles
    into parts, so that a window sees a part's values only, or the parts' totals. Where the cuts lie doesn't matter to the ranks."""
    counts = long.groupBy(*by, "value").agg(F.count("*").alias("c"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx("value", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(4 * parts)).alias("_cuts"), F.sum("c").alias("_all")).where("_all > 0").drop("_all")  # reads what the ranks read, so that the counts are worked out once
    counts = counts.join(cuts.withColumnsRenamed({c: f"_{c}" for c in by}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*[f"_{c}" for c in by])
    counts = counts.withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda q: q < F.col("value"))), F.lit(0))).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*by, "_part").agg(F.sum("c").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("_own", F.coalesce(F.sum("c").over(inside), F.lit(0))).alias("l")
    ranks = ranks.join(totals.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_part")]).select("l.*", "_before")
    ranks = ranks.select(*by, "value", (F.col("_before") + F.col("_own") + (F.col("c") + 1) / 2).alias("rank"))
    return long.join(ranks, [*by, "value"])


def spearman(long: DataFrame) -> DataFrame:
    """long: spec, metric, id, value, label. rho of each metric with the label, n; null where either is constant. One job for all metrics."""
    x = ranked(long, "spec", "metric").withColumnRenamed("rank", "rx")
    y = ranked(x.drop("value").withColumnRenamed("label", "value"), "spec", "metric").withColumnRenamed("rank", "ry")
    out = y.groupBy("spec", "metric").agg(F.covar_pop("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.count("*").alias("n"))
    return out.select("spec", "metric", F.expr("c / nullif(sx * sy, 0.0D)").alias("rho"), "n")


def with_p(rows: DataFrame) -> DataFrame:
    """rows (some tens: rho, n) plus p of the t test, by the commons-math distribution on the driver. A null rho has p = 1."""
    spark = rows.sparkSession
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution

    def p(rho, n):
        if rho is None or n < 3:
            return 1.0
        if abs(rho) >= 1:
            return 0.0
        return float(2 * (1 - dist(float(n - 2)).cumulativeProbability(abs(rho) * math.sqrt((n - 2) / (1 - rho * rho)))))

    got = rows.collect()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return spark.createDataFrame([(*r, p(r["rho"], r["n"])) for r in got], f"{kinds}, p double")


def bh_fdr(rows: DataFrame) -> DataFrame:
    """rows (spec, p: a row for each metric) plus q (textbook) and q_ref: the minimum taken over the order of specs, not of p."""
    order = Window.orderBy("p", "spec")
    n = rows.count()
    r = rows.withColumn("rank", F.row_number().over(order)).withColumn("raw", F.col("p") * n / F.col("rank"))
    down = Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    ref = Window.orderBy(F.desc("spec")).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("q", F.least(F.lit(1.0), F.min("raw").over(down))).withColumn("q_ref", F.least(F.lit(1.0), F.min("raw").over(ref))).drop("raw", "rank")


def _row_ids(rows: DataFrame, key: str | None) -> DataFrame:
    """_id: by the row's key, so that draws don't depend on how rows are dealt; without a key, by the row's place."""
    return rows.withColumn("_id", F.xxhash64(key) if key else F.monotonically_increasing_id())


def poisson(rows: DataFrame, draws: int, seed: int = 42, key: str | None = None) -> DataFrame:
    """rows once for each draw b, with a weight w: Poisson weights stand for drawing with replacement. Sums are combined before the
    shuffle, and no row is copied to another task."""
    u = (F.xxhash64("_id", "b", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    cdf, p, k = [], math.exp(-1), 0
    total = p
    while total < 1 - 1e-12:
        cdf.append(total)
        k += 1
        p /= k
        total += p
    weight = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in cdf), F.lit(0))
    return _row_ids(rows, key).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("u", u).withColumn("w", weight).drop("u")


def bootstrap(values: DataFrame, draws: int = 1000, seed: int = 42, confidence: float = 0.95, key: str | None = None) -> DataFrame:
    """(low, high): percentiles of the mean of resamples."""
    means = poisson(values, draws, seed, key).groupBy("b").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("m"))
    a = (1 - confidence) / 2
    return means.agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"))


def bootstrap_rho(rows: DataFrame, draws: int = 500, seed: int = 42, key: str | None = None) -> DataFrame:
    """(low, high) of the rank correlation of x and y: Poisson weights on ranks, the sums of a weighted correlation for each draw."""
    ids = _row_ids(rows, key)
    r = ranked(ids.withColumnRenamed("x", "value").withColumn("g", F.lit(0)), "g").withColumnsRenamed({"rank": "rx", "value": "x"})
    r = ranked(r.withColumnRenamed("y", "value"), "g").withColumnRenamed("rank", "ry")
    d = poisson(r.drop("_id"), draws, seed, key) if key else poisson(r, draws, seed, "_id")
    s = d.groupBy("b").agg(*[F.sum(F.col("w") * e).alias(n) for n, e in (("s", F.lit(1)), ("sx", F.col("rx")), ("sy", F.col("ry")), ("sxx", F.col("rx") * F.col("rx")), ("syy", F.col("ry") * F.col("ry")), ("sxy", F.col("rx") * F.col("ry")))])
    rho = F.expr("(s * sxy - sx * sy) / nullif(sqrt((s * sxx - sx * sx) * (s * syy - sy * sy)), 0)")
    return s.select(rho.alias("rho")).agg(F.percentile("rho", F.lit(0.025)).alias("low"), F.percentile("rho", F.lit(0.975)).alias("high"))


def noise_band(base: float, spark: SparkSession, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(low, high) of base plus normal noise of 5 % of max(base, 0.1), clipped to 0..1."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + F.randn(seed) * 0.05 * max(base, 0.1)))
    return spark.range(draws).select(x.alias("x")).agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))


def cohens_d(rows: DataFrame, value: str, group: str) -> DataFrame:
    """d of the rows with group true against those with false; 0 with fewer than two rows in one or no spread."""
    v = lambda g: F.when(F.col(group) == g, F.col(value))
    s = rows.agg(*[f(v(g)).alias(f"{n}{int(g)}") for g in (True, False) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return s.select(F.when((F.col("n1") < 2) | (F.col("n0") < 2) | (pooled <= 1e-10), 0.0).otherwise((F.col("m1") - F.col("m0")) / pooled).alias("d"))


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson's r; null where either is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def partial_correlation(rows: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """r of x and y given z by the formula, and r_residual: by residuals whose slopes mix sample covariance and population variance."""
    s = rows.agg(correlation(x, y).alias("xy"), correlation(x, z).alias("xz"), correlation(y, z).alias("yz"), F.covar_samp(x, z).alias("cx"), F.covar_samp(y, z).alias("cy"), F.var_pop(z).alias("vz"), F.covar_pop(x, y).alias("pxy"), F.covar_pop(x, z).alias("pxz"), F.covar_pop(y, z).alias("pyz"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    bx, by = "(case when vz > 1e-10 then cx / vz else 0 end)", "(case when vz > 1e-10 then cy / vz else 0 end)"
    r = f"(pxy - {by} * pxz - {bx} * pyz + {bx} * {by} * vz) / sqrt((vx - 2 * {bx} * pxz + {bx} * {bx} * vz) * (vy - 2 * {by} * pyz + {by} * {by} * vz))"
    r = r.replace(" / sqrt(", " / nullif(sqrt(greatest(0.0D, ", 1) + "), 0.0D)"
    den = "sqrt((1 - xz * xz) * (1 - yz * yz))"
    return s.select(F.expr(f"case when {den} > 1e-10 then (xy - xz * yz) / {den} else 0 end").alias("r"), F.expr(r).alias("r_residual"))


def kruskal(rows: DataFrame, value: str, group: str) -> DataFrame:
    """(h, n, k) of the Kruskal-Wallis test with tie correction."""
    r = ranked(rows.select(F.col(group).alias("grp"), F.col(value).alias("value"), F.lit(0).alias("g")), "g")
    by = r.groupBy("grp").agg(F.sum("rank").alias("s"), F.count("*").alias("n"))
    ties = r.groupBy("value").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    s = by.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("n").cast("double").alias("n"), F.count("*").alias("k"))
    return s.join(F.broadcast(ties), F.lit(True)).select(F.expr("(12 / (n * (n + 1)) * q - 3 * (n + 1)) / nullif(1 - ties / (n * n * n - n), 0)").alias("h"), F.col("n").cast("long").alias("n"), "k")


def kruskal_p(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    r = rows.first()
    chi = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(max(r["k"] - 1, 1)))
    p = 1.0 if r["h"] is None else 1 - chi.cumulativeProbability(float(r["h"]))
    return spark.createDataFrame([(r["h"], p, p < 0.05)], "h double, p double, significant boolean")


def power_analysis(features: int = 5, gain: float = 0.05, base: float = 0.60, alpha: float = 0.05, power: float = 0.80, rate: float = 0.60) -> dict:
    z = NormalDist().inv_cdf
    effect = abs(z(base + gain) - z(base))
    each = math.ceil((z(1 - alpha / 2) + z(power)) ** 2 / (effect**2 + 1e-10) + features * 10)
    total = math.ceil(2 * each / max(rate, 0.1))
    return {"effect_size": effect, "per_group": each, "total": 2 * each, "with_extraction_rate": total, "sufficient": total <= 500}


#: Tokens a second by model size; tasks of the five phases (phase, task, gpu hours or generation (n, tokens, model), api, human).
SPEED = {"7B": 50.0, "32B": 25.0, "72B": 12.0, "8B": 45.0, "70B": 13.0, "16B-moe": 30.0, "47B-moe": 18.0}
TASKS = (
    ("0.5 Pilot", "CoT gen 7B", (5, 250, "7B"), 0.0, 0.0), ("0.5 Pilot", "CoT gen 32B", (5, 250, "32B"), 0.0, 0.0), ("0.5 Pilot", "CoT gen 72B", (5, 250, "72B"), 0.0, 0.0),
    ("0.5 Pilot", "GCP + extraction", 5.0, 0.0, 0.0), ("0.5 Pilot", "Robust-TSI + motif test", 3.0, 0.0, 0.0), ("0.5 Pilot", "LLM extraction API", 0.0, 5.0, 0.0),
    ("0 Extractor Agreement", "CoT gen 100", (100, 200, "72B"), 0.0, 0.0), ("0 Extractor Agreement", "RBE/SBE/RBE-Rand", 3.0, 0.0, 0.0), ("0 Extractor Agreement", "LLM extraction", 0.0, 25.0, 0.0),
    ("0 Extractor Agreement", "Human annotation 100x3", 0.0, 0.0, 500.0), ("0 Extractor Agreement", "IAA computation", 2.0, 0.0, 0.0),
    ("1 Topological Existence", "CoT gen 1200x7B", (1200, 200, "7B"), 0.0, 0.0), ("1 Topological Existence", "CoT gen 1200x32B", (1200, 200, "32B"), 0.0, 0.0), ("1 Topological Existence", "CoT gen 1200x72B", (1200, 200, "72B"), 0.0, 0.0),
    ("1 Topological Existence", "Extraction 3,600x", 30.0, 0.0, 0.0), ("1 Topological Existence", "JP-DPR randomization", 50.0, 0.0, 0.0), ("1 Topological Existence", "Motif analysis + TSI", 40.0, 0.0, 0.0),
    ("2 Memorization", "LoRA training", 100 * 300 * 10 / 1e6 * 0.15, 0.0, 0.0), ("2 Memorization", "Evaluation gen 500", (500, 200, "7B"), 0.0, 0.0),
    ("2 Memorization", "Morphology annotation 30x3", 0.0, 0.0, 150.0), ("2 Memorization", "Extraction + analysis", 20.0, 0.0, 0.0),
    ("3 Generalization", "OOD CoT gen 300", (300, 250, "7B"), 0.0, 0.0), ("3 Generalization", "Extraction 300", 300 * 0.01, 0.0, 0.0), ("3 Generalization", "ER-Corrected modeling", 5.0, 0.0, 0.0),
)


def cost_tasks() -> list[tuple[str, str, float]]:
    """(phase, task, cost) at 0.50 a GPU hour."""
    hours = lambda g: g[0] * g[1] / SPEED.get(g[2], 25.0) / 3600 if isinstance(g, tuple) else g
    return [(phase, task, hours(g) * 0.50 + api + human) for phase, task, g, api, human in TASKS]


def costs(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(cost_tasks(), "phase string, task string, cost double")
    return rows.rollup("phase").agg(F.sum("cost").alias("cost"))


def cross_validated_auc(rows: DataFrame, features: list[str], label: str = "label", folds: int = 5) -> float:
    """AUC of the held-out predictions of a standardised logistic regression, by stratified folds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    w = Window.partitionBy(label).orderBy(F.xxhash64("trace_id"))
    dealt = rows.withColumn("_fold", F.pmod(F.row_number().over(w), F.lit(folds))).persist()
    n = dealt.count()
    steps = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / max(n, 1), maxIter=30)]
    said = None
    for k in range(folds):
        part = Pipeline(stages=steps).fit(dealt.where(F.col("_fold") != k)).transform(dealt.where(F.col("_fold") == k)).select(label, "rawPrediction")
        said = part if said is None else said.unionByName(part)
    out = BinaryClassificationEvaluator(labelCol=label).evaluate(said)
    dealt.unpersist()
    return out


def er_corrected(rows: DataFrame, topology: list[str], label: str = "label", folds: int = 5) -> dict:
    """rows: trace_id, label, extracted, cot_length, difficulty and the topology columns (0 where nothing was extracted).

    AUC by topology, by length, by difficulty, by both, by all; and with all where rows that weren't extracted count as 0 or as 1.
    """
    base = ["cot_length", "difficulty"]
    auc = lambda df, cols: cross_validated_auc(df, cols, label, folds)
    forced = lambda v: rows.withColumn(label, F.when(F.col("extracted"), F.col(label)).otherwise(F.lit(float(v))))
    out = {"extraction_rate": rows.agg(F.avg(F.col("extracted").cast("double"))).first()[0], "topology": auc(rows, topology), "length": auc(rows, base[:1]), "difficulty": auc(rows, base[1:]), "baseline": auc(rows, base), "combined": auc(rows, topology + base)}
    out |= {"improvement": out["combined"] - out["baseline"], "pessimistic": auc(forced(0), topology + base), "optimistic": auc(forced(1), topology + base)}
    return out | {"significant": out["improvement"] > 0.05}
