import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ponderloom.operators import agreement as A
from ponderloom.operators import graph as G
from ponderloom.operators import metrics as M
from ponderloom.operators import motifs as MO
from ponderloom.operators import pruning as PR
from ponderloom.operators import similarity as S
from ponderloom.plans import composed_q as CQ
from ponderloom.plans import fixtures as X
from ponderloom.plans import pairs_q as PQ
from ponderloom.plans import stats_q as Q
from ponderloom.plans.fixtures import event_graphs
from ponderloom.schema import MOTIF_ORDER, NODE


def test_er_prediction_has_motifs_and_five_folds(spark, sf, monkeypatch):
    got = {}

    def er_corrected(rows, topology, label="label", folds=5):
        got.update(rows=rows.collect(), topology=topology, folds=folds)
        return {"topology": 0.5}

    monkeypatch.setattr(Q.B, "er_corrected", er_corrected)
    Q.er_prediction(spark, sf)
    assert got["folds"] == 5 and len(got["topology"]) == 18
    want = {(r.trace_id, r.motif_id): float(r.present_typed) for r in MO.counts(event_graphs(spark, sf)).collect()}
    assert any(want.values())
    for r in got["rows"]:
        assert [r[f"motif_{m.lower()}"] for m in MOTIF_ORDER] == [want[r.trace_id, m] if r.extracted else 0.0 for m in MOTIF_ORDER]
        assert r.graph_length == (r.cot_length if r.extracted else 0.0)


def test_trees_and_draws_are_the_operators_defaults(spark, sf, monkeypatch):
    got = []

    class Fitted:
        def __init__(self, iterations=100, depth=3, seed=42):
            got.append(iterations)

        def fit(self, rows):
            return self

        def diagnose(self, rows):
            return rows

    monkeypatch.setattr(Q.ST, "StepClassifier", Fitted)
    monkeypatch.setattr(Q.B, "bootstrap_rho", lambda rows, draws=500, seed=42, key=None: got.append(draws))
    Q.step_classifier(spark, sf)
    Q.bootstrap_rho_ci(spark, sf)
    assert got == [100, 500]


@pytest.mark.parametrize("name", ["unsup_tsi_pairs", "wl_similarity", "wl_kernel"])
def test_pairs_are_not_shuffled(spark, sf, name):
    plan = PQ.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_block" in plan and "hashpartitioning(rep_a" not in plan and "hashpartitioning(rep_b" not in plan


def test_shared_labels_by_brute_force(spark):
    """Counts of more than one, labels beside the types, pairs that share none, an empty class."""
    labels = {"a": ["Retrieve", "Retrieve", "x", "x", "y"], "b": ["Retrieve", "Verify", "x", "x", "x"], "c": ["Verify", "z"], "d": ["Branch", "z"], "e": []}
    got = {(r.rep_a, r.rep_b): r.similarity for r in S.wl_pairs(spark.createDataFrame([(k, True, v) for k, v in labels.items()], "rep string, is_query boolean, labels array<string>")).collect()}
    counts = {k: Counter(v) for k, v in labels.items()}
    dot = lambda x, y: sum(n * y[k] for k, n in x.items())
    want = {(i, j): dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) for i, x in counts.items() for j, y in counts.items() if dot(x, y)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_decision_counts_equal_texts(spark, sf):
    """Each text once with its number gives what all orders give, and every order counts."""
    every, texts = X.order_cots(spark, sf), X.order_texts(spark, sf)
    assert texts.agg(F.sum("weight")).first()[0] == every.count() > texts.count()
    some = every.limit(60).unionByName(every.limit(60).withColumn("trace_id", -1 - F.col("trace_id"))).localCheckpoint()
    once = some.groupBy("cot_text").agg(F.min("trace_id").alias("trace_id"), F.count("*").alias("many"))
    a, b = A.decision(A.extractors(spark, some)).first(), A.decision(CQ._three(spark, once, "many").where("extractor <> 'sbe'"), weight="many").first()
    assert all(math.isclose(a[c], b[c], abs_tol=1e-9) for c in ("graph_level", "motif_level", "structure_level")) and a.decisions == b.decisions


def test_conditions_count_equal_texts(spark, sf):
    some = X.order_cots(spark, sf).limit(40).localCheckpoint()
    twice = some.unionByName(some.withColumn("trace_id", -1 - F.col("trace_id")))
    once = some.groupBy("cot_text").agg(F.min("trace_id").alias("trace_id"), (2 * F.count("*")).alias("many"))
    a, b = ({r.condition: r for r in c.collect()} for c in (PR.conditions(G.extract_rules(twice)), PR.conditions(G.extract_rules(once), weight="many")))
    assert a.keys() == b.keys() == {"control", "structural", "signal"} and all(math.isclose(a[k][c], b[k][c], abs_tol=1e-12) for k in a for c in ("n", "compression", "pass_rate", "integrity", "regions", "plan_change"))


def test_entropy_to_the_last_bit(spark):
    """Classes are told apart by equal features, as in the SQL: the entropy must have the C library's bits."""
    codes = ["R" * a + "T" * b + "V" * c + "K" * d for a in range(4) for b in range(5) for c in range(4) for d in range(4) if a + b + c + d]
    rows = X.wired(spark.createDataFrame([(c,) for c in codes], "trace_id string").withColumn("nodes", G.coded_nodes("trace_id")))
    for r in M.level1(rows).collect():
        n, want = len(r.trace_id), 0.0
        for t in (r.n_retrieve, r.n_transform, r.n_compare, r.n_verify, r.n_branch, r.n_backtrack):
            want += -(t / n) * math.log2(t / n) if t else 0.0
        assert r.topological_entropy == want, r.trace_id


def test_labels_of_long_graphs(spark):
    """By brute force: loops, double edges, edges to no node, ids in no order; and in time that grows with the nodes, not with their square."""
    import hashlib
    import time

    rng = random.Random(5)

    def graph(name, n):
        ids = rng.sample(range(1, 3 * n), n)
        edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(2 * n)]
        return name, [(i, rng.choice(["Retrieve", "Verify", "Branch"]), "", (0, 0)) for i in ids], edges + edges[:9] + [(ids[0], ids[0]), (ids[1], 4 * n), (4 * n, ids[-1])]

    def labels(nodes, edges, rounds, directed):
        now, edges, out = {n[0]: n[1] for n in nodes}, set(edges), [n[1] for n in nodes]
        near = lambda ids: sorted(now[i] for i in ids if i in now)
        for _ in range(rounds if directed else rounds - 1):
            if directed:
                said = {x: ",".join(near(s for s, d in edges if d == x) + near(d for s, d in edges if s == x)) for x in now}
            else:
                said = {x: "|".join(near({d if s == x else s for s, d in edges if x in (s, d)})) for x in now}
            now = {x: hashlib.md5(f"{v}|{said[x]}".encode()).hexdigest() for x, v in now.items()}
            out += now.values()
        return out

    rows = [graph("a", 60), graph("b", 7), ("c", [], []), graph("d", 2)]
    frame = lambda rows: spark.createDataFrame(rows, f"trace_id string, nodes array<{NODE}>, edges array<struct<src:int,dst:int>>")
    for directed in (True, False):
        got = {r.trace_id: r.labels for r in S.wl_labels(frame(rows), 3, directed).collect()}
        assert got == {name: labels(nodes, edges, 3, directed) for name, nodes, edges in rows}
    long = frame([graph("a", 6000)])
    began = time.time()
    assert len(S.wl_labels(long).first().labels) == 4 * 6000
    assert time.time() - began < 20


@pytest.mark.parametrize("name", ["unsup_tsi_pairs", "wl_similarity", "wl_kernel"])
def test_labels_are_dealt_to_tasks(spark, sf, name):
    """Classes are few bytes: unless they are dealt out by number, one task describes them all."""
    assert "hashpartitioning(rep#" in PQ.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_products_in_parts_and_pieces(spark, monkeypatch):
    """Any number of parts, pieces down to a query's own and batches that cut a part give the same pairs."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(f"r{k}", k % 3 == 0, [rng.choice("uvwxyz") for _ in range(rng.randrange(9))] + rng.choices(["Verify", "Branch"], k=k % 3)) for k in range(90)], "rep string, is_query boolean, labels array<string>").localCheckpoint()
    want = {tuple(r) for r in S.wl_pairs(rows).collect()}
    assert len(want) > 1000
    assert {tuple(r) for r in S.wl_pairs(rows, 1).collect()} == want
    monkeypatch.setattr(S, "CELLS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {tuple(r) for r in S.wl_pairs(rows, 6).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("by", ["day", "user"])
def test_event_shuffle_has_no_texts(spark, sf, by, monkeypatch):
    """Events meet by user and day, as numbers; graphs are those of the texts, also for rows without user or time."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    odd = e.limit(50).withColumn("event_id", -1 - F.col("event_id"))
    null = lambda c: F.lit(None).cast(dict(e.dtypes)[c])
    every = e.unionByName(odd.withColumn("user_id", null("user_id"))).unionByName(odd.withColumn("ts", null("ts"))).unionByName(odd.limit(9).withColumn("ts", null("ts")).withColumn("user_id", null("user_id")).withColumn("event_type", null("event_type"))).localCheckpoint()
    monkeypatch.setattr(X, "table", lambda *_: every)
    trace = F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")) if by == "day" else F.col("user_id").cast("string")
    want = every.groupBy(trace.alias("trace_id"), "user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.expr(X.EVENT_TYPE).alias("type")))).alias("x")).select("trace_id", "user_id", "x.type").collect()
    nodes = X.event_nodes(spark, sf, by)
    got = nodes.select("trace_id", "user_id", "nodes.type", "nodes.id").collect()
    assert {(r.trace_id, r.user_id): list(r.type) for r in got} == {(r.trace_id, r.user_id): list(r.type) for r in want} and len(got) == len(want)
    assert all(r.id == list(range(1, len(r.type) + 1)) for r in got)
    dealt = nodes._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]
    assert len(dealt) == 1 and dealt[0].startswith("user_id")
