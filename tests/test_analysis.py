import math
import random

import pytest
from pyspark.sql import functions as F

from ponderloom.operators import agreement as A
from ponderloom.operators import fingerprint as FP
from ponderloom.operators import motifs as MO
from ponderloom.operators import nulls as N
from ponderloom.operators import prune as R
from ponderloom.operators import similarity as S
from ponderloom.operators import stats as B
from ponderloom.operators import steps as ST
from ponderloom.schema import PruneConfig
from test_graphs import chain, make


def pruned(spark, nodes, edges, **kw):
    g = R.with_config(make(spark, ("a", nodes, edges)).withColumn("domain", F.lit(kw.pop("domain", "math"))), PruneConfig(**kw))
    return R.apply(R.regions(g)).first()


def test_long_transform_chain(spark):
    r = pruned(spark, "TTTTT", chain(5))
    assert [(x.region_type, x.node_ids, round(x.confidence, 6), x.savings) for x in r.regions] == [("redundant_transform_chain", [4, 5], 0.7, 70)]
    assert [n.id for n in r.pruned_nodes] == [1, 2, 3] and r.integrity == 1.0


def test_merge_and_reroute(spark):
    r = pruned(spark, [("T", f"t{k}") for k in range(1, 6)] + [("V", f"v{k}") for k in range(6, 11)], chain(10))
    kinds = {x.region_type: (x.node_ids, round(x.confidence, 6), x.savings, x.action) for x in r.regions}
    assert kinds == {"excessive_verification": ([6, 7, 8, 9, 10], 0.833333, 175, "merge"), "redundant_transform_chain": ([4, 5], 0.7, 70, "merge")}
    assert [n.id for n in r.pruned_nodes] == [1, 2, 3, 6] and [tuple(e) for e in r.pruned_edges] == [(1, 2), (2, 3), (3, 6)]
    assert r.pruned_nodes[-1].text == "v6 v7 v8 v9 v10"


def test_nothing_to_prune(spark):
    r = pruned(spark, "RVT", chain(3))
    assert r.regions == [] and len(r.pruned_nodes) == 3 and r.integrity == 1.0
    assert pruned(spark, "", []).regions == []


def test_branches_bloat_and_domains(spark):
    r = pruned(spark, "RBTV", chain(4))
    assert [(x.region_type, x.node_ids) for x in r.regions] == [("late_stage_verification", [4]), ("underutilized_branch", [2])]
    star = pruned(spark, "R" + "T" * 9, [(1, k) for k in range(2, 11)])
    assert "shallow_wide_bloat" in {x.region_type for x in star.regions}
    kw = {"domain_overrides": {"code": {"max_consecutive_transforms": 9, "unknown": 1}}}
    assert pruned(spark, "TTTTT", chain(5), domain="code", **kw).regions == [] and len(pruned(spark, "TTTTT", chain(5), **kw).regions) == 1


def test_savings_range(spark):
    g = R.with_config(make(spark, ("a", "TTTTT", chain(5))).withColumn("domain", F.lit("")), PruneConfig())
    assert tuple(R.report(R.regions(g)).first())[1:] == (1, 70, 42, 98)


def test_calibration_search(spark):
    from ponderloom.operators.pruning import annotated_graphs

    config, f1 = R.calibrate(annotated_graphs(spark, 40), PruneConfig(), rounds=1)
    assert 0 < f1 <= 1 and isinstance(config, PruneConfig)


def test_wl_and_edit_similarity(spark):
    g = make(spark, ("a", "RTV", chain(3)), ("b", "RTV", chain(3)), ("c", "KKK", chain(3)))
    rows = S.described(S.wl_labels(g)).select(F.col("trace_id").alias("rep"), F.lit(True).alias("is_query"), "labels", "types", "kinds", "size", "links")
    sims = {(r.rep_a, r.rep_b): r.similarity for r in S.wl_pairs(rows).collect()}
    assert sims["a", "b"] == pytest.approx(1.0) and ("a", "c") not in sims
    pairs = {(r.rep_a, r.rep_b): (r.x, r.y) for r in S.against(rows, rows).select("rep_a", "rep_b", S.edit_similarity().alias("x"), S.edit_similarity_sets().alias("y")).collect()}
    assert pairs["a", "b"] == (pytest.approx(1.0, abs=1e-4), 1.0) and pairs["a", "c"][1] == pytest.approx(2 / 3)
    assert pairs["a", "c"] == pytest.approx(pairs["c", "a"])


def test_tsi_of_itself(spark):
    g = make(spark, ("a", "RTV", chain(3)), ("b", "RTV", chain(3)), ("c", "BTT", [(1, 2), (1, 3)]))
    r = S.diversity(g).first()
    assert r.n_pairs == 3 and 1 / 3 <= r.diversity < 1
    c = S.classes(S.tsi_rows(g), "motif", "feat")
    assert c.count() == 2 and max(x.n for x in c.collect()) == 2
    self_sim = S.against(c, c).where("rep_a = rep_b").select(S.tsi().alias("t")).collect()
    assert all(x.t == pytest.approx(1.0) for x in self_sim)


def ratings(spark, table):
    return spark.createDataFrame([(i, j, c) for i, row in enumerate(table) for j, c in enumerate(row)], "item int, rater int, category int")


def fleiss(table):
    n, m = len(table), len(table[0])
    cats = {c for r in table for c in r}
    p = sum((sum(r.count(c) ** 2 for c in cats) - m) / (m * (m - 1)) for r in table) / n
    e = sum((sum(r.count(c) for r in table) / (n * m)) ** 2 for c in cats)
    return 1.0 if abs(e - 1) < 1e-9 else (p - e) / (1 - e)


def test_kappas(spark):
    rng = random.Random(1)
    table = [[rng.randrange(3) for _ in range(3)] for _ in range(20)]
    assert A.fleiss_kappa(ratings(spark, table)).first().kappa == pytest.approx(fleiss(table))
    assert A.fleiss_kappa(ratings(spark, [[1, 1]] * 4)).first().kappa == 1.0
    two = A.cohens_kappa(ratings(spark, [[0, 0], [1, 1], [0, 1], [1, 1]])).first().kappa
    assert two == pytest.approx((0.75 - 0.5) / 0.5)
    b = A.binary_kappa(spark.createDataFrame([(True, True), (True, False), (False, False)], "a boolean, b boolean"), "a", "b").first()
    assert b.agreement_rate == pytest.approx(2 / 3) and b.kappa == pytest.approx((2 / 3 - 0.5) / 0.5)


def test_fdr(spark):
    rows = spark.createDataFrame([(0, "a", 0.04), (1, "b", 0.01), (2, "c", 0.03)], "spec int, metric string, p double")
    got = {r.metric: (round(r.q, 6), round(r.q_ref, 6)) for r in B.bh_fdr(rows).collect()}
    assert got == {"a": (0.04, 0.03), "b": (0.03, 0.03), "c": (0.04, 0.045)}


def test_rank_statistics(spark):
    rows = spark.createDataFrame([(0, "m", k, float(x), float(y)) for k, (x, y) in enumerate([(1, 2), (2, 1), (3, 4), (4, 3), (4, 5)])] + [(1, "c", k, 1.0, float(k)) for k in range(5)], "spec int, metric string, id int, value double, label double")
    got = {r.metric: (r.rho, r.p) for r in B.with_p(B.spearman(rows)).collect()}
    assert got["c"] == (None, 1.0) and got["m"][0] == pytest.approx(7 / math.sqrt(95)) and 0.1 < got["m"][1] < 0.2
    groups = spark.createDataFrame([(float(v), g) for g, vs in {"a": (1, 2, 3), "b": (4, 5, 6)}.items() for v in vs], "v double, g string")
    h = B.kruskal(groups, "v", "g")
    assert h.first().h == pytest.approx(3.857142857) and B.kruskal_p(h).first().p == pytest.approx(0.0495, abs=1e-3)


def test_bootstrap_and_effects(spark):
    values = spark.createDataFrame([(float(k % 10),) for k in range(400)], "value double")
    r = B.bootstrap(values, 300).first()
    assert r.low < 4.5 < r.high and r.high - r.low < 1.2
    d = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (5.0, False)], "v double, g boolean")
    assert B.cohens_d(d, "v", "g").first().d == pytest.approx((1.5 - 4) / math.sqrt((0.5 + 2) / 2))
    assert B.cohens_d(d.where("g"), "v", "g").first().d == 0.0
    band = B.noise_band(0.5, spark, 500).first()
    assert band.low < 0.5 < band.high


def test_power_and_costs(spark):
    p = B.power_analysis()
    assert p["per_group"] > 50 and p["with_extraction_rate"] >= p["total"]
    rows = {r.phase: r.cost for r in B.costs(spark).collect()}
    assert len(rows) == 6 and rows[None] == pytest.approx(sum(v for k, v in rows.items() if k))


def test_step_features_and_clusters(spark):
    f = {r.node_id: r for r in ST.features(make(spark, ("a", "RTTK", chain(4)))).collect()}
    assert [f[k].depth_from_root for k in range(1, 5)] == [1, 2, 3, 4] and f[2].consecutive_transform == 1 and f[3].has_backtrack_edge == 1 and f[1].in_degree == 0
    assert len(ST.FEATURES) == 17
    g = make(spark, ("a", [("T", "one two"), ("T", "x"), ("V", "y z"), ("R", "other")], chain(4)))
    rows = ST.cluster_ids(g)
    assert rows.first().cluster == [1, 1, 2, 3]
    r = ST.rebuild(rows).first()
    assert [(n.id, n.type, n.text) for n in r.nodes] == [(1, "Transform", "one two x"), (2, "Verify", "y z"), (3, "Retrieve", "other")] and [tuple(e) for e in r.edges] == [(1, 2), (2, 3)]
    assert ST.cluster_ids(make(spark, ("a", "RTVCBKRTV", chain(9))), chain_only=True).first().cluster == [1] * 5 + [2] * 4


def test_fingerprints(spark):
    graphs = [(f"{m}{k}", ("RTV" if m == "x" else "BKBKB") + "T" * (k % 3), chain((3 if m == "x" else 5) + k % 3)) for m in "xy" for k in range(12)]
    rows = FP.features(make(spark, *graphs).withColumn("model", F.substring("trace_id", 1, 1)), "model")
    m = FP.moments(rows)
    sigs = FP.signatures(m)
    for method in ("euclidean", "cosine", "mahalanobis"):
        got = FP.identify(rows, sigs, method).collect()
        assert all(r.predicted == r.trace_id[0] for r in got if method != "mahalanobis") and all(0 < r.confidence <= 1 for r in got)
    half = FP.merged(FP.moments(rows.where("hash(trace_id) % 2 = 0")), FP.moments(rows.where("hash(trace_id) % 2 <> 0")))
    a, b = ({r.model: r for r in FP.signatures(x).collect()} for x in (m, half))
    assert all(a[k].mean == pytest.approx(b[k].mean) and a[k].cov == pytest.approx(b[k].cov, abs=1e-9) for k in "xy")


def test_null_models(spark):
    g = make(spark, *[(f"g{k}", "RTVCBK", [*chain(6), (1, 3)]) for k in range(6)])
    for method in ("jp_dpr", "edge_rewire"):
        a, b = (sorted((r.trace_id, r.draw, [tuple(e) for e in r.edges]) for r in N.randomise(g, method, 3).collect()) for _ in range(2))
        assert a == b and len(a) == 18
        for _, _, edges in a:
            assert len(edges) == 6
            left = set(edges)
            while left:
                free = {e for e in left if not any(f[1] == e[0] for f in left)}
                assert free, "a cycle"
                left -= free
    perm = N.permute_types(g, 2).collect()
    assert all(sorted(n.type for n in r.nodes) == sorted(n.type for n in perm[0].nodes) for r in perm) and len({tuple(n.type for n in r.nodes) for r in perm}) > 1
    assert N.ensemble(g, 1).groupBy("method").count().count() == 3


def test_disjoint_motifs(spark):
    """Against a plain greedy choice, and by hand."""
    g = make(spark, ("c", "TTTTT", chain(5)), ("d", "BTTC", [(1, 2), (1, 3), (2, 4), (3, 4)]), ("v", "TV", chain(2)), ("e", "", []))
    got = {(r.trace_id, r.motif_id): r.node_sets for r in MO.disjoint(g).collect()}
    assert got["c", "M10"] == [[1, 2], [3, 4]] and got["c", "M1"] == [[1, 2, 3]] and got["c", "M3"] == []
    assert got["d", "M3"] == [[1, 2, 3, 4]] and got["d", "M7"] == [[1, 2, 3]] and got["d", "M9"] == [[1, 2]] and got["v", "M5"] == [[1, 2]]
    assert all(s == [] for (t, _), s in got.items() if t == "e") and len(got) == 4 * 12
    with pytest.raises(ValueError, match="Unknown motif"):
        MO.disjoint(g, ("M99",))


def test_aligned_agreement(spark):
    """Mean Fleiss kappa of two aligned sequences against a plain one."""
    texts = {"x": ("RTVTVC", "RTVTTC"), "y": ("RTTV", "RTTV"), "z": ("TTTT", "TTTT"), "short": ("RT", "RT")}
    rows = [make(spark, *[(t, p[k], chain(len(p[k]))) for t, p in texts.items()]).withColumn("extractor", F.lit(e)) for k, e in enumerate(("rbe_rand", "model"))]
    got = A.aligned_agreement(rows[0].unionByName(rows[1])).first()

    def kappa(a, b):
        n = len(a)
        same, e = sum(x == y for x, y in zip(a, b, strict=True)) / n, sum((((a + b).count(c)) / (2 * n)) ** 2 for c in set(a + b))
        return 1.0 if abs(e - 1) < 1e-9 else (same - e) / (1 - e)

    want = [kappa(*p) for t, p in texts.items() if t != "short"]
    assert got.n == 3 and math.isclose(got.kappa, sum(want) / 3) and (got.extractor_a, got.extractor_b) == ("model", "rbe_rand")
    d = A.decision(rows[0].unionByName(rows[1])).first()
    assert d.graph_level == got.kappa and d.decisions[0].startswith("proceed") and "flag_length" in d.decisions and d.proceed and 0.5 < d.structure_level <= 1
    none = A.decision(rows[0].where("false").unionByName(rows[1].where("false"))).first()
    assert none.decisions == ["terminate"] and not none.proceed


def test_fleiss_interval(spark):
    rng = random.Random(3)
    rows = [(i, r, c if rng.random() < 0.7 else rng.randrange(6)) for i in range(200) for c in [rng.randrange(6)] for r in range(3)]
    df = spark.createDataFrame(rows, "item int, rater int, category int")
    got = A.fleiss_bootstrap(df, draws=200).first()
    assert math.isclose(got.kappa, A.fleiss_kappa(df).first().kappa) and got.low < got.kappa < got.high and got.high - got.low < 0.2


def test_own_signals(spark):
    g = R.regions(R.with_config(make(spark, ("a", "TTVVV", chain(5))).withColumn("domain", F.lit("math")), PruneConfig(use_calibration_signal=True, use_prm_signal=True)))
    sure, unsure = (R.fuse(g, lambda text, kind, v=v: F.lit(v), lambda text, before, v=v: F.lit(v)).first().regions[0].confidence for v in (1.0, 0.0))
    assert sure < unsure and R.scorer(("no_such_module:f", "math:no_such_name"), len) is len and R.scorer(("math:sqrt",), len) is math.sqrt


def test_ranks_in_parts(spark):
    """Average ranks, whatever the parts: ties, one hot value, nulls in the group's key, a group of one value."""
    rng = random.Random(5)
    rows = [("a", rng.choice([0.0, 1.5, rng.random()])) for _ in range(500)] + [(None, float(k % 7)) for k in range(50)] + [("c", 3.0)] * 20
    df = spark.createDataFrame(rows, "g string, value double")

    def want(g):
        values = sorted(v for k, v in rows if k == g)
        return sorted((v, values.index(v) + (values.count(v) + 1) / 2) for v in values)

    for parts in (2, 64):
        got = B.ranked(df.where("g is not null"), "g", parts=parts).collect()
        for g in ("a", "c"):
            assert sorted((r.value, r["rank"]) for r in got if r.g == g) == want(g)
    assert B.ranked(df.where("false"), "g").collect() == []


def test_correlations_of_constants(spark):
    df = spark.createDataFrame([(1.0, float(k), float(k * k)) for k in range(10)], "x double, y double, z double")
    assert S.compare_scores(df, "x", "y").first().pearson is None and S.compare_scores(df, "y", "z").first().pearson == pytest.approx(0.9627, abs=1e-4)
    assert B.partial_correlation(df, "x", "y", "z").first() is not None


def test_identify_without_driver(spark):
    """Models by blocks: equal to a plain search over all of them."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(f"t{k}", f"m{k % 3}", (rng.normal(k % 3, 1, FP.DIM)).tolist()) for k in range(90)], "trace_id string, model string, x array<double>")
    sigs = FP.signatures(FP.moments(rows))
    known = {r.model: (np.array(r.mean), np.linalg.pinv(np.array(r["cov"]).reshape(FP.DIM, FP.DIM) + 1e-6 * np.eye(FP.DIM))) for r in sigs.collect()}
    got = {r.trace_id: r for r in FP.identify(rows, sigs).collect()}
    for r in rows.collect():
        d = {m: math.sqrt(max(0.0, (np.array(r.x) - mu) @ inv @ (np.array(r.x) - mu))) for m, (mu, inv) in known.items()}
        best = min(d, key=d.get)
        assert got[r.trace_id].predicted == best and math.isclose(got[r.trace_id].distance, d[best], rel_tol=1e-6)
