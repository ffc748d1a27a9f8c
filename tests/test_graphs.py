import math

import pytest
from pyspark.sql import functions as F

from ponderloom.operators import graph as G
from ponderloom.operators import metrics as M
from ponderloom.operators import motifs as P
from ponderloom.operators import validate as V
from ponderloom.schema import CODES, MOTIF_ORDER, NODE

NAMES = {c: t for t, c in CODES.items()}


def make(spark, *graphs):
    """(trace_id, codes or [(code, text)], edges)"""
    rows = []
    for tid, nodes, edges in graphs:
        nodes = [(c, "") if isinstance(c, str) else c for c in nodes]
        rows.append((tid, [(k, NAMES[c], t, (0, 0)) for k, (c, t) in enumerate(nodes, 1)], [tuple(e) for e in edges]))
    return spark.createDataFrame(rows, f"trace_id string, nodes array<{NODE}>, edges array<struct<src:int,dst:int>>")


def chain(n):
    return [(k, k + 1) for k in range(1, n)]


def test_chain_metrics(spark):
    r = M.graph_metrics(make(spark, ("a", "RTV", chain(3)), ("e", "", []))).collect()
    a, e = sorted(r, key=lambda x: x.trace_id)
    assert (a.n_nodes, a.n_edges, a.depth) == (3, 2, 2.0) and a.branching == pytest.approx(2 / 3) and a.verify_density == pytest.approx(1 / 3)
    assert a.entropy == pytest.approx(math.log(3)) and a.avg_degree == pytest.approx(4 / 3) and a.graph_density == pytest.approx(2 / 3)
    assert (e.n_nodes, e.depth, e.entropy, e.avg_degree) == (1, 0.0, 0.0, None)


def test_level1(spark):
    r = M.level1(make(spark, ("a", "RTV", chain(3)))).first()
    assert r.branching_factor == 1.0 and r.topological_entropy == pytest.approx(math.log2(3))


@pytest.mark.parametrize(("edges", "depth", "dag"), [(chain(4), 3, True), ([(1, 2), (1, 3), (2, 4), (3, 4)], 2, True), ([(3, 1), (1, 2), (2, 4)], 3, True), ([(1, 2), (2, 1)], 0, False), ([], 0, True)])
def test_depth(spark, edges, depth, dag):
    r = G.with_depth(make(spark, ("a", "RTVC", edges)), general=True).first()
    assert (r.depth, r.is_dag) == (depth, dag)
    if all(a < b for a, b in edges):
        assert G.with_depth(make(spark, ("a", "RTVC", edges))).first().depth == depth


def counts(spark, codes, edges):
    return {r.motif_id: (r.n_matches, r.n_typed) for r in P.counts(make(spark, ("a", codes, edges))).collect()}


def test_motifs_on_tiny_graphs(spark):
    c = counts(spark, "RTV", chain(3))
    assert c["M1"] == (1, 1) and c["M5"] == (1, 1) and c["M11"] == (1, 1) and c["M2"] == (0, 0)
    assert counts(spark, "RTV", [(1, 2), (1, 3)])["M2"] == (1, 1)
    d = counts(spark, "RTCV", [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert d["M3"] == (1, 1) and d["M2"] == (1, 1) and d["M8"] == (1, 0) and d["M1"] == (2, 2)
    assert counts(spark, "BTT", [(1, 2), (1, 3)])["M7"] == (1, 1)
    assert counts(spark, "BTT", [(1, 2), (2, 3), (1, 3)])["M7"] == (0, 0), "extra edges among the nodes disqualify"
    assert counts(spark, "RTK", [(1, 2), (2, 3), (3, 1)])["M4"] == (0, 3) or counts(spark, "RTK", [(1, 2), (2, 3), (3, 1)])["M4"] == (0, 1)
    assert all(v == (0, 0) for v in counts(spark, "K", []).values()) and len(MOTIF_ORDER) == 12
    assert all(v == (0, 0) for v in counts(spark, "", []).values())


def test_vector_without_motifs_is_uniform(spark):
    r = G.fixed(P.with_counts(make(spark, ("a", "K", []))).select(P.presence().alias("p"))).select(P.vector(F.col("p")).alias("v"), P.distribution(F.col("p")).alias("d")).first()
    assert r.v == pytest.approx([1 / 12] * 12) and r.d == pytest.approx([1 / 12] * 12)


def rules(spark, nodes, edges, **kw):
    return [(v.rule, v.node_ids, v.severity) for v in V.validate(make(spark, ("a", nodes, edges)), **kw).first().violations]


def test_rules(spark):
    assert rules(spark, "TTTTT", chain(5)) == [("R2", [k, k + 1], "error") for k in range(1, 5)]
    assert rules(spark, "", []) == [("R6", [], "error")]
    assert rules(spark, "", [], least_nodes=0) == []
    assert rules(spark, "RV", []) == [("R4", [2], "error"), ("R6", [2], "warning")]
    assert rules(spark, "BT", chain(2)) == [("R5", [1], "error")] and rules(spark, "BTT", [(1, 2), (1, 3)]) == []
    assert rules(spark, [("V", "ok"), ("T", "x" * 201), ("R", "the theorem and the law")], chain(3), strict=False, allow_orphan_verify=True) == [("R1", [1], "warning"), ("R1", [2], "warning"), ("R3", [3], "warning")]


def test_validity_and_modes(spark):
    g = make(spark, ("a", "TT", chain(2)), ("b", "RT", chain(2)))
    assert {r.trace_id: r.is_valid for r in V.validate(g).collect()} == {"a": False, "b": True}
    assert [tuple(r) for r in V.failure_modes(g).collect()] == [("a", "merged_computation", 1)]
    steps = {(r.trace_id, r.node_id): (r.is_correct, r.failure_modes, r.rule_violations) for r in V.annotate_steps(g).collect()}
    assert steps["a", 1] == (False, "merged_computation", 1) and steps["b", 2] == (True, "", 0)
    rates = {r.rule_variant: r.pass_rate for r in V.robustness(g).collect()}
    assert rates == {"strict": 0.5, "standard": 1.0, "relaxed": 1.0, "ultra_relaxed": 1.0}


def test_label_split(spark):
    g = make(spark, ("a", "R", []), ("b", "R", []), ("c", "R", []))
    labels = spark.createDataFrame([("a", True), ("b", None)], "trace_id string, label boolean")
    assert {r.trace_id: r.part for r in V.split_by_label(g, labels).collect()} == {"a": "clean", "b": "ambiguous", "c": "clean"}


def test_json_round_trip_and_defaults(spark):
    g = make(spark, ("a", "RTV", chain(3)))
    back = G.from_canonical_json(g.select(G.to_canonical_json().alias("json"))).first()
    assert [n.type for n in back.nodes] == ["Retrieve", "Transform", "Verify"] and [tuple(e) for e in back.edges] == chain(3)
    raw = spark.createDataFrame([('{"nodes": [{"id": 1, "type": " verify ", "span": null}]}',), ('{"graph": {"nodes": [], "edges": []}, "trace_id": "t"}',)], "json string")
    a, b = G.from_canonical_json(raw).collect()
    assert (a.nodes[0].type, tuple(a.nodes[0].span), a.edges) == ("Verify", (0, 0), []) and (b.trace_id, b.nodes) == ("t", [])


def test_response_parsing(spark):
    rows = spark.createDataFrame([('Sure:\n{"nodes": [{"id": 1, "type": "Odd", "span": [0, 3]}], "edges": []} done',), ("no json",)], "response string")
    a, b = G.parse_response(rows).collect()
    assert [n.type for n in a.nodes] == ["Transform"] and b.nodes == []


def test_report_of_broken_graphs(spark):
    g = make(spark, ("iso", "RTV", [(1, 2)]), ("cyc", "RT", [(1, 2), (2, 1)]), ("dang", "RT", [(1, 9), (1, 2)]), ("ok", "RT", [(1, 2)]))
    got = {r.trace_id: r.errors for r in G.valid_report(g).collect()}
    assert got == {"iso": "isolated", "cyc": "cycle", "dang": "dangling_edge", "ok": ""}


def test_discovery(spark):
    g = make(spark, ("a", "RTV", chain(3)), ("b", "RT", chain(2)))
    got = {r.pattern: r.n_graphs for r in P.discover(g).collect()}
    assert got == {"Retrieve-Transform 0>1": 2, "Transform-Verify 0>1": 1, "Retrieve-Transform-Verify 0>1,1>2": 1}


def test_long_and_wide(spark):
    g = make(spark, ("a", "RTV", chain(3)))
    back = G.from_long(G.long_nodes(g), G.long_edges(g)).first()
    assert [n.type for n in back.nodes] == ["Retrieve", "Transform", "Verify"] and [tuple(e) for e in back.edges] == chain(3)


def test_dot(spark):
    assert make(spark, ("a", "RT", chain(2))).select(G.to_dot().alias("d")).first().d == 'digraph {1 [label="Retrieve"]; 2 [label="Transform"];1->2;}'
