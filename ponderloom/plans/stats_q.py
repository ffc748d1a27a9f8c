"""Queries on agreement, steps, fingerprints, statistics and null models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import corpora
from ..functions import text as T
from ..operators import agreement as A
from ..operators import fingerprint as FP
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import motifs as MO
from ..operators import nulls as N
from ..operators import similarity as S
from ..operators import stats as B
from ..operators import steps as ST
from ..operators import validate as V
from ..schema import MOTIF_ORDER, TYPES
from .fixtures import CODE_SQL, EVENT_TYPE, event_graphs, event_sql, order_codes, order_cots, order_graphs, sentences_sql, table
from .graphs_q import _LOST, BASE, MATRIX, MOTIF_SQL, _lossy, _rounded
from .text_q import RBE_ND

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Raters: three deterministic ones over the documents' lengths

RATERS = "rt AS (SELECT doc_id AS item, unnest([0, 1, 2]) AS rater, unnest([length(text) % 6, (length(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) % 6, (length(text) + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END) % 6])::INTEGER AS category FROM documents)"


def _raters(spark, sf):
    n, d = F.length("text"), F.col("doc_id")
    cats = F.array(n % 6, (n + F.when(d % 7 == 0, 1).otherwise(0)) % 6, (n + F.when(d % 5 == 0, 2).otherwise(0)) % 6)
    return table(spark, sf, "documents").select(d.alias("item"), F.posexplode(cats).alias("rater", "category"))


@query(f"WITH {RATERS}, e AS (SELECT item, category, count(*) AS c FROM rt GROUP BY ALL), i AS (SELECT item, (sum(c * c) - 3) / 6.0::DOUBLE AS p FROM e GROUP BY item), pe AS (SELECT sum(c * c) / (SELECT count(*) * count(*) FROM rt) AS x FROM (SELECT category, sum(c) AS c FROM e GROUP BY category)) SELECT round((avg(p) - max(x)) / (1 - max(x)), 6) AS kappa, round(avg(p), 6) AS observed, round(max(x), 6) AS expected FROM i, pe")
def fleiss_kappa(spark, sf):
    return _rounded(A.fleiss_kappa(_raters(spark, sf)), "kappa", "observed", "expected")


@query(f"WITH {RATERS}, pr AS (SELECT a.rater AS rater_a, b.rater AS rater_b, a.category AS x, b.category AS y FROM rt a JOIN rt b ON a.item = b.item AND a.rater < b.rater), t AS (SELECT rater_a, rater_b, count(*) AS n, count(*) FILTER (x = y) AS s FROM pr GROUP BY ALL), r AS (SELECT rater_a, rater_b, x AS k, count(*) AS r FROM pr GROUP BY ALL), c AS (SELECT rater_a, rater_b, y AS k, count(*) AS s FROM pr GROUP BY ALL), pe AS (SELECT r.rater_a, r.rater_b, sum(r.r * c.s) AS rs FROM r JOIN c ON r.rater_a = c.rater_a AND r.rater_b = c.rater_b AND r.k = c.k GROUP BY ALL), z AS (SELECT t.rater_a, t.rater_b, (s / n - rs / (n * n)) / (1 - rs / (n * n)) AS k FROM t JOIN pe ON t.rater_a = pe.rater_a AND t.rater_b = pe.rater_b) SELECT rater_a, rater_b, round(k, 6) AS kappa, CASE WHEN k >= 0.81 THEN 'excellent' WHEN k >= 0.61 THEN 'good' WHEN k >= 0.41 THEN 'moderate' WHEN k >= 0.21 THEN 'fair' ELSE 'poor' END AS band FROM z")
def cohens_kappa(spark, sf):
    out = A.cohens_kappa(_raters(spark, sf))
    return out.select("rater_a", "rater_b", F.round("kappa", 6).alias("kappa"), A.reliability(F.col("kappa")).alias("band"))


@query("WITH j AS (SELECT length(text) % 3 > 0 AS a, length(text) % 4 > 0 AS b FROM documents), s AS (SELECT avg(CASE WHEN a = b THEN 1 ELSE 0 END) AS rate, (sum(a::INTEGER) + sum(b::INTEGER)) / (2 * count(*)) AS p FROM j) SELECT round((rate - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 6) AS kappa, round(rate, 6) AS agreement_rate FROM s")
def binary_kappa(spark, sf):
    rows = table(spark, sf, "documents").select((F.length("text") % 3 > 0).alias("a"), (F.length("text") % 4 > 0).alias("b"))
    return _rounded(A.binary_kappa(rows, "a", "b"), "kappa", "agreement_rate")


@query("WITH d AS (SELECT doc_id AS trace_id, CASE WHEN doc_id % 11 = 0 THEN true ELSE length(text) % 3 > 0 END AS a, length(text) % 4 > 0 AS b, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS t FROM documents), r AS (SELECT trace_id, a, b, CASE WHEN a = b THEN CASE WHEN a THEN 'unanimous_pass' ELSE 'unanimous_fail' END WHEN t IS NULL THEN 'ambiguous' WHEN t THEN 'arbitrated_pass' ELSE 'arbitrated_fail' END AS resolution FROM d) SELECT trace_id, a AS judgement_1, b AS judgement_2, resolution, CASE WHEN resolution LIKE '%pass' THEN true WHEN resolution LIKE '%fail' THEN false END AS label FROM r")
def arbitration(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("trace_id"), F.length("text").alias("n"))
    first = d.where("trace_id % 11 <> 0").select("trace_id", (F.col("n") % 3 > 0).alias("j"))
    tie = d.where("trace_id % 3 <> 0").select("trace_id", (F.col("trace_id") % 2 == 0).alias("j"))
    return A.arbitrate(d, first, d.select("trace_id", (F.col("n") % 4 > 0).alias("j")), tie)


# Two extractors over order texts

LEN_ND = "ls AS (" + sentences_sql("cots", "trace_id", "cot_text") + """), ln AS (SELECT trace_id, pos::INTEGER AS id, CASE WHEN w <= 5 THEN 'Retrieve' WHEN w <= 12 THEN 'Transform' WHEN w <= 20 THEN 'Verify' ELSE 'Backtrack' END AS type FROM (SELECT *, len(string_split_regex(s, '\\s+')) AS w FROM ls))"""
TWO = f"{RBE_ND}, {LEN_ND}, ca AS (SELECT trace_id, string_agg({CODE_SQL}, '' ORDER BY id) AS x FROM nd GROUP BY trace_id), cb AS (SELECT trace_id, string_agg({CODE_SQL}, '' ORDER BY id) AS y FROM ln GROUP BY trace_id), lv AS (SELECT ca.trace_id, 1 - levenshtein(x, y) / greatest(length(x), length(y), 1) AS s FROM ca JOIN cb ON ca.trace_id = cb.trace_id)"


def _two(spark, sf):
    return A.extractors(spark, order_cots(spark, sf))


@query(f"{TWO} SELECT round((avg(s) - 1 / 6.0::DOUBLE) / (5 / 6.0::DOUBLE), 6) AS kappa, round(avg(s), 6) AS mean_similarity FROM lv")
def iaa_graph(spark, sf):
    return _rounded(A.graph_agreement(_two(spark, sf)), "kappa", "mean_similarity")


@query(f"{TWO} SELECT 'rbe' AS extractor, round(avg(s), 6) AS mean_similarity, avg(s) > 0.3 AS detected FROM lv")
def length_bias(spark, sf):
    rules, base = order_graphs(spark, sf).withColumn("extractor", F.lit("rbe")), G.extract_by_length(order_cots(spark, sf))
    return _rounded(A.sequence_bias(rules, base), "mean_similarity")


_C6 = lambda src, p: f"SELECT trace_id, count(*) AS n, {', '.join(f'count(*) FILTER (type = {chr(39)}{t}{chr(39)}) AS n_{t.lower()}' for t in TYPES)} FROM {src} GROUP BY trace_id"
_E2 = lambda src: f"(SELECT trace_id, sum(CASE WHEN id < mx THEN 1 ELSE 0 END + CASE WHEN type = 'Branch' AND id + 2 <= mx THEN 1 ELSE 0 END) AS m FROM (SELECT *, max(id) OVER (PARTITION BY trace_id) AS mx FROM {src}) GROUP BY trace_id)"


def _structure_sql() -> str:
    from .pairs_q import GED_SQL

    return f"{TWO}, xa AS (SELECT c.*, e.m FROM ({_C6('nd', 'a')}) c JOIN {_E2('nd')} e ON e.trace_id = c.trace_id), xb AS (SELECT c.*, e.m FROM ({_C6('ln', 'b')}) c JOIN {_E2('ln')} e ON e.trace_id = c.trace_id) SELECT round(avg({GED_SQL}), 6) AS mean_ged_similarity FROM xa a JOIN xb b ON a.trace_id = b.trace_id"


@query(_structure_sql())
def iaa_structure(spark, sf):
    return _rounded(A.structure_agreement(_two(spark, sf)), "mean_ged_similarity")


# The graphs of both extractors as one table of nodes and edges, with their motifs.
TWO_MOTIFS = f"WITH nd AS ({TWO} SELECT 'a' AS ex, trace_id AS trace, 'a' || trace_id AS trace_id, id, type FROM nd UNION ALL SELECT 'b', trace_id, 'b' || trace_id, id, type FROM ln), b AS (SELECT trace_id, ex, trace, max(id) AS n FROM nd GROUP BY ALL), ed AS (SELECT nd.trace_id, id AS src, id + 1 AS dst FROM nd JOIN b ON b.trace_id = nd.trace_id WHERE id < n UNION ALL SELECT nd.trace_id, id, id + 2 FROM nd JOIN b ON b.trace_id = nd.trace_id WHERE type = 'Branch' AND id + 2 <= n)" + MOTIF_SQL[len(BASE):]
_MEANS = "mv AS (SELECT ex, motif_id, avg(least(n_typed, 1)) AS v FROM mc JOIN b ON b.trace_id = mc.trace_id GROUP BY ALL)"


@query(f"{TWO_MOTIFS}, {_MEANS} SELECT round(corr(x.v, y.v), 6) AS mean_pearson_r FROM mv x JOIN mv y ON y.motif_id = x.motif_id WHERE x.ex = 'a' AND y.ex = 'b'")
def iaa_motif(spark, sf):
    return _rounded(A.motif_agreement(_two(spark, sf)), "mean_pearson_r")


_WEIGHTS = "pr AS (SELECT b.ex, b.trace, motif_id, least(n_matches, 1) AS p, sum(least(n_matches, 1)) OVER (PARTITION BY mc.trace_id) AS t FROM mc JOIN b ON b.trace_id = mc.trace_id), wt AS (SELECT ex, trace, motif_id, CASE WHEN t > 0 THEN p / t ELSE 1 / 12.0::DOUBLE END AS v FROM pr)"


@query(f"{TWO_MOTIFS}, {_WEIGHTS}, dr AS (SELECT motif_id, CASE WHEN stddev_pop(x.v) > 1e-8 AND stddev_pop(y.v) > 1e-8 THEN corr(x.v, y.v) END AS r FROM wt x JOIN wt y USING (trace, motif_id) WHERE x.ex = 'a' AND y.ex = 'b' GROUP BY motif_id) SELECT 'rbe' AS extractor_a, 'rbe_rand' AS extractor_b, round(coalesce(avg(r), 0), 6) AS r FROM dr")
def iaa_dimension(spark, sf):
    """Correlation over traces of each motif's weight, averaged over motifs."""
    return _rounded(A.dimension_agreement(_two(spark, sf)), "r")


def iaa_decision(spark, sf):
    """Agreement of the rules, the length baseline and the segment extractor at three levels, and the decision. Equal type sequences are compared once and count as often as they occur."""
    return A.decided(A.compared_codes(order_codes(spark, sf)))


@query(f"WITH {RATERS}, e AS (SELECT item, category, count(*) AS c FROM rt GROUP BY ALL), i AS (SELECT item, (sum(c * c) - 3) / 6.0::DOUBLE AS p FROM e GROUP BY item), pe AS (SELECT sum(c * c) / (SELECT count(*) * count(*) FROM rt) AS x FROM (SELECT category, sum(c) AS c FROM e GROUP BY category)) SELECT round((avg(p) - max(x)) / (1 - max(x)), 6) AS kappa, true AS within FROM i, pe")
def fleiss_interval(spark, sf):
    """Kappa of the three raters, and whether its resampled interval holds it."""
    out = A.fleiss_bootstrap(_raters(spark, sf))
    return out.select(F.round("kappa", 6).alias("kappa"), ((F.col("low") <= F.col("kappa")) & (F.col("kappa") <= F.col("high")) & (F.col("low") < F.col("high"))).alias("within"))


def gcs_lcs(spark, sf):
    """Granularity of the rule extractor's operations against the length baseline's, for each order."""
    a = order_graphs(spark, sf).select("trace_id", G.type_codes().alias("x"))
    b = G.extract_by_length(order_cots(spark, sf)).select("trace_id", G.type_codes().alias("y"))
    return a.join(b, "trace_id").select("trace_id", A.granularity("x", "y").alias("gcs"))


def alignment(spark, sf):
    a = order_graphs(spark, sf).select("trace_id", G.type_codes().alias("x"))
    b = G.extract_by_length(order_cots(spark, sf)).select("trace_id", G.type_codes().alias("y"))
    z = a.join(b, "trace_id").select("trace_id", A.align("x", "y").alias("z"))
    return z.select("trace_id", F.array_join(F.get("z", 0), "").alias("aligned_a"), F.array_join(F.get("z", 1), "").alias("aligned_b"))


def gcp_calibration(spark, sf):
    gold = corpora.gold(spark)
    rules, base = (A.gcs_summary(A.gcs(gold, f, n == "rbe_rand")).withColumn("extractor", F.lit(n)) for n, f in (("rbe", T.rule_type), ("rbe_rand", T.length_type)))
    return rules.unionByName(base)


def gcp_category(spark, sf):
    return A.gcs(corpora.gold(spark)).groupBy("category").agg(F.avg("gcs").alias("mean_gcs"), F.count("*").alias("n"))


def gcp_sentences(spark, sf):
    return A.gcs(corpora.gold(spark)).select("id", "gold", "codes", "gcs")


_SB = RBE_ND.replace("WITH ", "WITH ", 1) + ", gl AS (SELECT type AS gold, CASE WHEN (trace_id + pos) % 4 = 0 THEN 'Transform' ELSE type END AS pred FROM ty)"


@query(f"{_SB} SELECT pred, gold, count(*) AS n FROM gl GROUP BY ALL")
def rbe_confusion(spark, sf):
    return A.confusion(_judged(spark, sf))


def _judged(spark, sf):
    s = order_cots(spark, sf).select("trace_id", F.posexplode(T.split_sentences(F.col("cot_text"))).alias("pos", "s")).select("trace_id", (F.col("pos") + 1).alias("pos"), T.rule_type(F.col("s")).alias("gold"))
    return s.select("gold", F.when((F.col("trace_id") + F.col("pos")) % 4 == 0, "Transform").otherwise(F.col("gold")).alias("pred"))


@query(f"{_SB}, g AS (SELECT gold AS label, count(*) AS n_gold, count(*) FILTER (pred = gold) AS tp FROM gl GROUP BY gold), p AS (SELECT pred AS label, count(*) AS n_pred FROM gl GROUP BY pred) SELECT g.label, n_gold, tp, coalesce(n_pred, 0) AS n_pred, round(tp / n_pred, 6) AS precision, round(tp / n_gold, 6) AS recall, round(2 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold), 6) AS f1, 2 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold) < 0.5 OR n_gold < 5 AS unreliable FROM g LEFT JOIN p ON p.label = g.label")
def rbe_calibration_report(spark, sf):
    return _rounded(A.class_report(_judged(spark, sf)), "precision", "recall", "f1")


def _truth_rows(spark, extract):
    t = corpora.truth(spark)
    links = F.transform("edges", lambda e: F.concat(e["src"].cast("string"), F.lit(">"), e["dst"].cast("string")))
    got = extract(t.withColumnRenamed("edges", "_true").withColumnRenamed("codes", "_codes"))
    return got.select("trace", F.split("_codes", "").alias("true"), F.filter(F.split(G.type_codes(), ""), lambda x: x != "").alias("pred"), F.col("_true").alias("true_edges"), links.alias("pred_edges")).withColumn("true", F.filter("true", lambda x: x != ""))


def synthetic_validation(spark, sf):
    parts = [A.validation_summary(A.ground_truth(_truth_rows(spark, f))).withColumn("extractor", F.lit(n)) for n, f in (("rbe", G.extract_rules), ("rbe_rand", G.extract_by_length))]
    return parts[0].unionByName(parts[1])


def extractor_benchmark(spark, sf):
    """Gold score, pass rate, mean TSI with the other extractor's graphs of the same traces, mean plan redundancy, overall score and rank."""
    two = _two(spark, sf)
    checked = V.validate(two, strict=False).withColumn("plan", M.plan_redundancy(two))
    rates = checked.groupBy("extractor").agg(F.avg(F.col("is_valid").cast("double")).alias("pass_rate"), F.avg("plan").alias("plan_redundancy"))
    sim = A.extractor_pairs(S.tsi_rows(two, "extractor"), "motif", "feat").select("extractor_a", "extractor_b", S.tsi().alias("tsi"))
    sim = sim.select(F.explode(F.array("extractor_a", "extractor_b")).alias("extractor"), "tsi").groupBy("extractor").agg(F.avg("tsi").alias("tsi"))
    g = gcp_calibration(spark, sf).select("extractor", F.col("mean").alias("gcp"), F.col("passed").alias("gcp_passed"))
    return A.rank_extractors(rates.join(g, "extractor").join(sim, "extractor", "left"))


# Steps


@query(f"WITH RECURSIVE {_LOST}, dp(trace_id, node, d) AS (SELECT trace_id, id, 1 FROM nd UNION SELECT e.trace_id, e.dst, dp.d + 1 FROM dp JOIN ed e ON e.trace_id = dp.trace_id AND e.src = dp.node), dx AS (SELECT trace_id, node, max(d) AS d FROM dp GROUP BY ALL), di AS (SELECT trace_id, dst AS id, count(*) AS k FROM ed GROUP BY ALL), du AS (SELECT trace_id, src AS id, count(*) AS k FROM ed GROUP BY ALL), nb AS (SELECT e.trace_id, e.dst AS id, s.type AS t FROM ed e JOIN nd s ON s.trace_id = e.trace_id AND s.id = e.src UNION ALL SELECT e.trace_id, e.src, d.type FROM ed e JOIN nd d ON d.trace_id = e.trace_id AND d.id = e.dst), nx AS (SELECT trace_id, id, bool_or(t = 'Transform') AS nt, bool_or(t = 'Backtrack') AS nk FROM nb GROUP BY ALL) SELECT nd.trace_id, nd.id AS node_id, coalesce(di.k, 0)::DOUBLE AS in_degree, coalesce(du.k, 0)::DOUBLE AS out_degree, dx.d::DOUBLE AS depth_from_root, round((nd.id - 1) / greatest(n - 1, 1), 6) AS position_ratio, CASE WHEN nd.type = 'Verify' AND di.k IS NULL THEN 1.0::DOUBLE ELSE 0::DOUBLE END AS verify_no_incoming, CASE WHEN nd.type = 'Branch' AND coalesce(du.k, 0) < 2 THEN 1.0::DOUBLE ELSE 0::DOUBLE END AS branch_underfork, CASE WHEN nd.type = 'Transform' AND nx.nt THEN 1.0::DOUBLE ELSE 0::DOUBLE END AS consecutive_transform, CASE WHEN nx.nk THEN 1.0::DOUBLE ELSE 0::DOUBLE END AS has_backtrack_edge, round(coalesce(du.k, 0) / greatest(n - 1, 1), 6) AS branching_ratio FROM nd JOIN dx ON dx.trace_id = nd.trace_id AND dx.node = nd.id LEFT JOIN di ON di.trace_id = nd.trace_id AND di.id = nd.id LEFT JOIN du ON du.trace_id = nd.trace_id AND du.id = nd.id LEFT JOIN nx ON nx.trace_id = nd.trace_id AND nx.id = nd.id")
def step_features(spark, sf):
    f = _rounded(ST.features(_lossy(spark, sf)), "position_ratio", "branching_ratio")
    return f.select("trace_id", "node_id", "in_degree", "out_degree", "depth_from_root", "position_ratio", "verify_no_incoming", "branch_underfork", "consecutive_transform", "has_backtrack_edge", "branching_ratio")


_CHAINED = "ig AS (SELECT trace_id, dst AS id, count(*) AS k FROM ed GROUP BY ALL), og AS (SELECT trace_id, src AS id, count(*) AS k FROM ed GROUP BY ALL), jn AS (SELECT b.trace_id, b.id, e.src IS NOT NULL AND og.k = 1 AND ig.k = 1 AS chain, a.type = b.type AS same, a.id AS prev_id FROM nd b LEFT JOIN nd a ON a.trace_id = b.trace_id AND a.id = b.id - 1 LEFT JOIN ed e ON e.trace_id = b.trace_id AND e.src = a.id AND e.dst = b.id LEFT JOIN og ON og.trace_id = b.trace_id AND og.id = a.id LEFT JOIN ig ON ig.trace_id = b.trace_id AND ig.id = b.id)"


@query(f"WITH {event_sql('user', 'fork')}, {_CHAINED} SELECT trace_id, id AS node_id, (sum(CASE WHEN coalesce(chain AND same, false) THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY id))::INTEGER AS cluster FROM jn")
def step_clusters(spark, sf):
    rows = ST.cluster_ids(event_graphs(spark, sf, "user"))
    return rows.select("trace_id", F.inline(F.arrays_zip(F.transform("nodes", lambda n: n["id"]).alias("node_id"), "cluster")))


@query(f"WITH {event_sql('user', 'fork')}, {_CHAINED}, ch AS (SELECT trace_id, id, sum(CASE WHEN coalesce(chain, false) THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY id) AS g FROM jn), sb AS (SELECT trace_id, id, g, (row_number() OVER (PARTITION BY trace_id, g ORDER BY id) - 1) // 5 AS h FROM ch) SELECT trace_id, id AS node_id, (dense_rank() OVER (PARTITION BY trace_id ORDER BY g, h))::INTEGER AS cluster FROM sb")
def chain_segments(spark, sf):
    rows = ST.cluster_ids(event_graphs(spark, sf, "user"), chain_only=True)
    return rows.select("trace_id", F.inline(F.arrays_zip(F.transform("nodes", lambda n: n["id"]).alias("node_id"), "cluster")))


def step_rebuild(spark, sf):
    rows = ST.rebuild(ST.cluster_ids(order_graphs(spark, sf)))
    return rows.select("trace_id", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), G.type_codes().alias("codes"))


def step_classifier(spark, sf):
    rows = ST.labelled(_lossy(spark, sf))
    return ST.StepClassifier().fit(rows).diagnose(rows)


# Fingerprints: users modulo five are the models

_V18 = ["n", "m", "depth", "br", "vd", "h", *[f"t{m[1:]}" for m in MOTIF_ORDER]]
_TF = ", ".join(f"max(least(n_typed, 1)) FILTER (motif_id = '{m}')::DOUBLE AS t{m[1:]}" for m in MOTIF_ORDER)
_ENT = "(" + " + ".join(f"CASE WHEN n_{t.lower()} > 0 THEN -(n_{t.lower()} / n) * ln(n_{t.lower()} / n + 1e-10) ELSE 0::DOUBLE END" for t in TYPES) + ")"
FP_SQL = MOTIF_SQL + f", tf AS (SELECT trace_id, {_TF} FROM mc GROUP BY trace_id), f0 AS (SELECT b.trace_id, b.user_id % 5 AS model, list_value(n::DOUBLE, m::DOUBLE, depth::DOUBLE, m / n, n_verify / n, {_ENT}, {', '.join(_V18[6:])}) AS v FROM b JOIN tf ON tf.trace_id = b.trace_id), f1 AS (SELECT trace_id, model, unnest(range(1, 19)) AS i, unnest(v) AS x FROM f0), f2 AS (SELECT *, avg(x) OVER (PARTITION BY trace_id) AS mu, stddev_pop(x) OVER (PARTITION BY trace_id) AS sd FROM f1), fx AS (SELECT trace_id, model, i, (x - mu) / (sd + 1e-8) AS x FROM f2)"


def _prints(spark, sf):
    return FP.features(event_graphs(spark, sf).withColumn("model", F.col("user_id") % 5), "model")


@query(f"{FP_SQL} SELECT trace_id, i::INTEGER AS i, round(x, 6) AS x FROM fx")
def fingerprint_features(spark, sf):
    return _prints(spark, sf).select("trace_id", F.posexplode("x").alias("i", "x")).select("trace_id", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query(f"{FP_SQL} SELECT model, i::INTEGER AS i, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x) + 1e-8, 6) AS std FROM fx GROUP BY model, i")
def fingerprint_signature(spark, sf):
    s = FP.signatures(FP.moments(_prints(spark, sf)))
    return s.select("model", "n", F.posexplode(F.arrays_zip("mean", "std")).alias("i", "z")).select("model", (F.col("i") + 1).alias("i"), "n", F.round("z.mean", 6).alias("mean"), F.round("z.std", 6).alias("std"))


@query(f"{FP_SQL}, mm AS (SELECT model, i, avg(x) AS mu FROM fx GROUP BY model, i), dd AS (SELECT fx.trace_id, mm.model, sqrt(sum((x - mu) * (x - mu))) AS d FROM fx JOIN mm ON mm.i = fx.i GROUP BY fx.trace_id, mm.model) SELECT trace_id, arg_min(model, d)::BIGINT AS predicted, round(min(d), 6) AS distance, round((1 / greatest(min(d), 1e-6)) / sum(1 / greatest(d, 1e-6)), 6) AS confidence FROM dd GROUP BY trace_id")
def fingerprint_identify(spark, sf):
    rows = _prints(spark, sf)
    return _rounded(FP.identify(rows, FP.signatures(FP.moments(rows)), "euclidean").select("trace_id", "predicted", "distance", "confidence"), "distance", "confidence")


def fingerprint_mahalanobis(spark, sf):
    rows = _prints(spark, sf)
    return FP.identify(rows, FP.signatures(FP.moments(rows)))


# Statistics: the 19 metrics of event graphs against a label

LABEL_SQL = MATRIX + ", lb AS (SELECT *, (n_edges + user_id % 3)::DOUBLE AS label FROM mx)"


def _metrics(spark, sf):
    return M.metric_matrix(event_graphs(spark, sf), "user_id").withColumn("label", F.col("n_edges") + F.col("user_id") % 3)


_VARY = [c for c in M.METRICS if c not in ("extraction_rate", "mean_text_len")]
_RHO = ", lx AS (" + " UNION ALL ".join(f"SELECT {k} AS spec, '{c}' AS metric, {c} AS x, label AS y FROM lb" for k, c in enumerate(M.METRICS) if c in _VARY) + "), rx AS (SELECT spec, metric, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2 AS a, rank() OVER (PARTITION BY metric ORDER BY y) + (count(*) OVER (PARTITION BY metric, y) - 1) / 2 AS b FROM lx), rho AS (SELECT spec, metric, corr(a, b) AS rho, count(*) AS n FROM rx GROUP BY spec, metric)"


def _rho(spark, sf):
    rows = _metrics(spark, sf)
    return B.spearman(M.unpivoted(rows, M.METRICS, "trace_id", "label")).where(F.col("metric").isin(_VARY))


@query(f"{LABEL_SQL}{_RHO} SELECT metric, round(rho, 6) AS rho, n FROM rho")
def spearman_corr(spark, sf):
    return _rho(spark, sf).select("metric", F.round("rho", 6).alias("rho"), "n")


# What stands for p here is 1 - |rho|: exact in both engines.
_Q = f"{LABEL_SQL}{_RHO}, pv AS (SELECT spec, metric, round(1 - abs(rho), 6) AS p FROM rho), rk AS (SELECT *, row_number() OVER (ORDER BY p, spec) AS r, p * (SELECT count(*) FROM pv) / row_number() OVER (ORDER BY p, spec) AS raw FROM pv)"


@query(f"{_Q} SELECT metric, round(least(1::DOUBLE, min(raw) OVER (ORDER BY r DESC)), 6) AS q FROM rk")
def bh_fdr(spark, sf):
    return _fdr(spark, sf).select("metric", F.round("q", 6).alias("q"))


@query(f"{_Q} SELECT metric, round(least(1::DOUBLE, min(raw) OVER (ORDER BY spec DESC)), 6) AS q FROM rk")
def bh_fdr_ref(spark, sf):
    return _fdr(spark, sf).select("metric", F.round("q_ref", 6).alias("q"))


def _fdr(spark, sf):
    return B.bh_fdr(_rho(spark, sf).select("spec", "metric", F.round(1 - F.abs("rho"), 6).alias("p")))


def performance_correlation(spark, sf):
    """rho, p, both q values and significance of the 19 metrics, by |rho|."""
    rows = B.spearman(M.unpivoted(_metrics(spark, sf), M.METRICS, "trace_id", "label"))
    out = B.bh_fdr(B.with_p(rows))
    return out.select("metric", "rho", "p", "q", "q_ref", (F.col("q_ref") < 0.05).alias("significant")).orderBy(F.abs("rho").desc_nulls_last(), "metric")


@query("WITH d AS (SELECT length(text)::DOUBLE AS v, source AS g FROM documents), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS a FROM d), q AS (SELECT sum(s * s / k) AS q, sum(k) AS n, count(*) AS k FROM (SELECT g, sum(a) AS s, count(*) AS k FROM r GROUP BY g)), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY v)) SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 5) AS h, n::BIGINT AS n, k FROM (SELECT q, n::DOUBLE AS n, k, t FROM q, t)")
def kruskal_h(spark, sf):
    rows = table(spark, sf, "documents").select(F.length("text").cast("double").alias("v"), F.col("source").alias("g"))
    return B.kruskal(rows, "v", "g").select(F.round("h", 5).alias("h"), "n", "k")


@query("WITH d AS (SELECT length(text)::DOUBLE AS x, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS y, (doc_id % 97)::DOUBLE AS z FROM documents), c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM d) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM c")
def partial_corr(spark, sf):
    rows = table(spark, sf, "documents").select(F.length("text").cast("double").alias("x"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("y"), (F.col("doc_id") % 97).cast("double").alias("z"))
    return B.partial_correlation(rows, "x", "y", "z").select(F.round("r", 6).alias("r"))


@query("WITH d AS (SELECT length(text)::DOUBLE AS v, l.quality = 1 AS g FROM documents JOIN labels l ON l.doc_id = documents.doc_id), s AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n0, avg(v) FILTER (g) AS m1, avg(v) FILTER (NOT g) AS m0, var_samp(v) FILTER (g) AS v1, var_samp(v) FILTER (NOT g) AS v0 FROM d) SELECT round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM s")
def cohens_d(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.length("text").cast("double").alias("v"), (F.col("quality") == 1).alias("g"))
    return _rounded(B.cohens_d(rows, "v", "g"), "d")


def bootstrap_ci(spark, sf):
    return B.bootstrap(table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("value")), key="doc_id")


def bootstrap_rho_ci(spark, sf):
    return B.bootstrap_rho(_metrics(spark, sf).select("trace_id", F.col("depth").alias("x"), F.col("label").alias("y")), key="trace_id")


#: Quantiles of the normal distribution at 0.60, 0.65, 0.975 and 0.80.
@query("WITH z AS (SELECT abs(0.3853204664075677::DOUBLE - 0.2533471031357997::DOUBLE) AS e, 1.9599639845400536::DOUBLE AS a, 0.8416212335729144::DOUBLE AS b), n AS (SELECT e, ceil((a + b) * (a + b) / (e * e + 1e-10) + 50) AS k FROM z) SELECT round(e, 9) AS effect_size, k::INTEGER AS per_group, (2 * k)::INTEGER AS total, ceil(2 * k / 0.6)::INTEGER AS with_extraction_rate, ceil(2 * k / 0.6) <= 500 AS sufficient FROM n")
def power_analysis(spark, sf):
    p = B.power_analysis()
    return spark.createDataFrame([(round(p["effect_size"], 9), p["per_group"], p["total"], p["with_extraction_rate"], p["sufficient"])], "effect_size double, per_group int, total int, with_extraction_rate int, sufficient boolean")


@query("SELECT phase, round(sum(cost), 6) AS cost FROM (VALUES " + ", ".join(f"('{p}', {c!r}::DOUBLE)" for p, _, c in B.cost_tasks()) + ") t(phase, cost) GROUP BY ROLLUP (phase)")
def cost_rollup(spark, sf):
    return _rounded(B.costs(spark), "cost")


_ER_TOPOLOGY = [*(f"motif_{m.lower()}" for m in MOTIF_ORDER), "depth", "branching", "verify_density", "entropy", "graph_length", "graph_difficulty"]


def _er_rows(spark, sf):
    """Label, length, difficulty and the 18 features of a graph, which are 0 where nothing was extracted."""
    graphs = G.fixed(MO.with_counts(event_graphs(spark, sf)).withColumn("_p", MO.presence("typed")))
    rows = M.graph_metrics(graphs, "user_id", "nodes", "_p")
    rows = rows.select("trace_id", ((F.col("user_id") + F.col("n_nodes")) % 2).cast("double").alias("label"), (F.col("user_id") % 10 != 0).alias("extracted"), "depth", "branching", "verify_density", "entropy", F.col("n_nodes").cast("double").alias("cot_length"), (F.col("user_id") % 7 / 7).alias("difficulty"), "_p")
    rows = rows.withColumns({f"motif_{m.lower()}": F.get("_p", k) for k, m in enumerate(MOTIF_ORDER)} | {"graph_length": F.col("cot_length"), "graph_difficulty": F.col("difficulty")})
    return rows.select("trace_id", "label", "extracted", "cot_length", "difficulty", *[F.when(F.col("extracted"), F.col(c)).otherwise(0.0).alias(c) for c in _ER_TOPOLOGY])


def er_prediction(spark, sf):
    """Prediction of a label from motifs and metrics, corrected for traces that gave no graph."""
    rows = _er_rows(spark, sf).persist()
    r = B.er_corrected(rows, _ER_TOPOLOGY)
    rows.unpersist()
    return spark.createDataFrame([(k, float(v)) for k, v in r.items()], "measure string, value double")


# Null models


@query("WITH " + event_sql() + ", h AS (SELECT trace_id, id, type, k.draw, md5(trace_id || ':' || id || ':' || k.draw || ':42') AS h FROM nd, (SELECT unnest([0, 1]) AS draw) k), o AS (SELECT trace_id, draw, type, row_number() OVER (PARTITION BY trace_id, draw ORDER BY h, type) AS id FROM h) SELECT trace_id, draw, id::INTEGER AS node_id, type FROM o")
def type_permutation(spark, sf):
    rows = N.permute_types(event_graphs(spark, sf), 2, 42)
    return rows.select("trace_id", "draw", F.inline("nodes")).select("trace_id", "draw", F.col("id").alias("node_id"), "type")


def _null(spark, sf, method, kept):
    """What a null model keeps: nodes and edges in number, the degrees of each node (kept: of its edges out, or in as well), and that there is no cycle."""
    rows = G.with_depth(N.randomise(event_graphs(spark, sf), method, 1), general=True)
    degrees = F.array_join(F.array_sort(F.expr(f"transform(nodes, n -> concat_ws(':', cast(n.id as string), {kept}))")), ",")
    return rows.select("trace_id", "draw", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), degrees.alias("degrees"), F.col("is_dag").alias("acyclic"))


_OUT, _IN = ("cast(size(filter(edges, e -> e.src = n.id)) as string)", "cast(size(filter(edges, e -> e.dst = n.id)) as string)")
_KEPT = "WITH " + event_sql() + ", e AS (SELECT trace_id, count(*) AS m FROM ed GROUP BY trace_id), o AS (SELECT trace_id, src AS id, count(*) AS k FROM ed GROUP BY ALL), i AS (SELECT trace_id, dst AS id, count(*) AS k FROM ed GROUP BY ALL), d AS (SELECT nd.trace_id, {kept} AS s FROM nd LEFT JOIN o ON o.trace_id = nd.trace_id AND o.id = nd.id LEFT JOIN i ON i.trace_id = nd.trace_id AND i.id = nd.id) SELECT d.trace_id, 0 AS draw, count(*)::INTEGER AS n_nodes, coalesce(max(e.m), 0)::INTEGER AS n_edges, string_agg(s, ',' ORDER BY s) AS degrees, true AS acyclic FROM d LEFT JOIN e ON e.trace_id = d.trace_id GROUP BY d.trace_id"


@query(_KEPT.format(kept="nd.id || ':' || coalesce(o.k, 0)"))
def jp_dpr(spark, sf):
    return _null(spark, sf, "jp_dpr", _OUT)


@query(_KEPT.format(kept="nd.id || ':' || coalesce(o.k, 0) || ':' || coalesce(i.k, 0)"))
def edge_rewire(spark, sf):
    return _null(spark, sf, "edge_rewire", f"{_OUT}, {_IN}")


def null_threshold(spark, sf):
    """The 95th percentile of the TSI of each graph with some 50 null graphs, drawn from those of all graphs."""
    graphs = event_graphs(spark, sf)
    real = S.tsi_rows(graphs.withColumn("trace_id", F.col("trace_id").cast("string")))
    null = S.tsi_rows(N.randomise(graphs, "jp_dpr", 1))
    return N.null_threshold(N.sampled_pairs(real, null, graphs.select("trace_id").count()).select(S.tsi().alias("score")))


@query(f"WITH e AS (SELECT user_id, ts, event_id, {EVENT_TYPE} AS type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n_nodes, string_agg({CODE_SQL}, '' ORDER BY ts, event_id) AS codes FROM s GROUP BY user_id, k")
def session_traces(spark, sf):
    """Extension: gaps of 30 minutes in a user's events cut traces (session windows)."""
    from ..streaming.sessions import sessions

    return sessions(table(spark, sf, "events"))


QUERIES |= {f.__name__: f for f in (iaa_decision, gcs_lcs, alignment, gcp_calibration, gcp_category, gcp_sentences, synthetic_validation, extractor_benchmark, step_rebuild, step_classifier, fingerprint_mahalanobis, performance_correlation, bootstrap_ci, bootstrap_rho_ci, er_prediction, null_threshold)}
