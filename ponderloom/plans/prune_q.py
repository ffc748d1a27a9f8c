"""Queries on redundancy: regions of graphs of whole users, fused scores of order texts, pruned graphs, threshold scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import prune as R
from ..operators.pruning import annotated_graphs, conditions
from ..schema import PRUNE_GRID, PruneConfig
from .fixtures import event_graphs, event_sql, order_graphs, order_texts
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


def _user(spark, sf):
    return R.with_config(event_graphs(spark, sf, "user").withColumn("domain", F.lit("math")), PruneConfig())


def _day(spark, sf):
    return R.with_config(event_graphs(spark, sf, "day").withColumn("domain", F.lit("math")), PruneConfig())


def _found(rows, *kinds):
    out = R.long_regions(R.regions(rows)).where(F.col("region_type").isin(*kinds))
    return out.select("trace_id", "region_type", "node_ids", F.round("confidence", 6).alias("confidence"), "savings", "action")


def _base(by: str) -> str:
    return f"""WITH RECURSIVE {event_sql(by)}, tn AS (SELECT trace_id, n, count(*) FILTER (type = 'Verify') AS nv, count(*) FILTER (type = 'Branch') AS nb FROM nd GROUP BY trace_id, n),
vr AS (SELECT nd.trace_id, nd.id, nd.id - row_number() OVER (PARTITION BY nd.trace_id ORDER BY nd.id) AS grp FROM nd WHERE type = 'Verify'),
vb AS (SELECT trace_id, min(id) AS first_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, list(id ORDER BY id) AS l, count(*) AS k FROM vr GROUP BY trace_id, grp),
ev AS (SELECT vb.trace_id, 'excessive_verification' AS region_type, ids AS node_ids, l, least(1::DOUBLE, (nv / n) / 0.6::DOUBLE) AS confidence, (k * 35)::INTEGER AS savings, CASE WHEN k > 1 THEN 'merge' ELSE 'review' END AS action FROM vb JOIN tn ON tn.trace_id = vb.trace_id WHERE nv / n > 0.4::DOUBLE),
lv0 AS (SELECT nd.trace_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS node_ids, list(id ORDER BY id) AS l, count(*) AS k FROM nd WHERE type = 'Verify' AND id - 1 >= floor(n * 0.7::DOUBLE) GROUP BY nd.trace_id),
lv AS (SELECT lv0.trace_id, 'late_stage_verification' AS region_type, node_ids, l, 0.75::DOUBLE AS confidence, ((k * 35) // 2)::INTEGER AS savings, 'review' AS action FROM lv0 JOIN tn ON tn.trace_id = lv0.trace_id WHERE k / nv > 0.6::DOUBLE),
ub0 AS (SELECT nd.trace_id, nd.id FROM nd WHERE type = 'Branch' AND ((SELECT count(*) FROM ed WHERE ed.trace_id = nd.trace_id AND ed.src = nd.id) < 2 OR NOT EXISTS (SELECT 1 FROM ed e JOIN ed f ON f.trace_id = e.trace_id AND f.src = e.dst WHERE e.trace_id = nd.trace_id AND e.src = nd.id))),
ub1 AS (SELECT trace_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS node_ids, list(id ORDER BY id) AS l, count(*) AS k FROM ub0 GROUP BY trace_id),
ub AS (SELECT ub1.trace_id, 'underutilized_branch' AS region_type, node_ids, l, least(1::DOUBLE, k / nb) AS confidence, (k * 35)::INTEGER AS savings, 'merge' AS action FROM ub1 JOIN tn ON tn.trace_id = ub1.trace_id WHERE 1 - k / nb < 0.5::DOUBLE),
tr0 AS (SELECT nd.trace_id, nd.id, nd.id - row_number() OVER (PARTITION BY nd.trace_id ORDER BY nd.id) AS grp FROM nd WHERE type = 'Transform'),
tr1 AS (SELECT trace_id, id, row_number() OVER (PARTITION BY trace_id, grp ORDER BY id) AS p, grp FROM tr0),
tc AS (SELECT trace_id, 'redundant_transform_chain' AS region_type, string_agg(id::VARCHAR, ',' ORDER BY id) AS node_ids, list(id ORDER BY id) AS l, 0.7::DOUBLE AS confidence, (count(*) * 35)::INTEGER AS savings, 'merge' AS action FROM tr1 WHERE p > 3 GROUP BY trace_id, grp)"""


def _plain(spark, sf):
    """Days of every third user with Transforms only, as a star from the first node; others as they are: long chains, wide and uniform graphs."""
    plain = F.col("user_id") % 3 == 0
    rows = event_graphs(spark, sf, "day").withColumn("domain", F.lit("math"))
    star = F.expr(f"cast(transform(filter(nodes, n -> n.id > 1), n -> named_struct('src', 1, 'dst', n.id)) as array<struct<src:int,dst:int>>)")
    nodes = F.when(plain, F.transform("nodes", lambda n: n.withField("type", F.lit("Transform")))).otherwise(F.col("nodes"))
    rows = G.fixed(rows.withColumn("_n", nodes).withColumn("_e", F.when(plain, star).otherwise(F.col("edges")))).drop("nodes", "edges").withColumnsRenamed({"_n": "nodes", "_e": "edges"})
    return R.with_config(rows, PruneConfig())


USER, DAY = _base("user"), _base("day")
PLAIN = DAY.replace("ed AS (", "ed0 AS (", 1).replace("nd AS (SELECT trace_id, user_id, id::INTEGER AS id, type,", "nd AS (SELECT trace_id, user_id, id::INTEGER AS id, CASE WHEN user_id % 3 = 0 THEN 'Transform' ELSE type END AS type,", 1)
PLAIN = PLAIN.replace(", tn AS (", ", ed AS (SELECT ed0.* FROM ed0 JOIN (SELECT DISTINCT trace_id FROM nd WHERE user_id % 3 <> 0) o ON o.trace_id = ed0.trace_id UNION ALL SELECT trace_id, 1, id FROM nd WHERE user_id % 3 = 0 AND id > 1), tn AS (", 1)
_COLS = "trace_id, region_type, node_ids, round(confidence, 6) AS confidence, savings, action"


@query(f"{DAY} SELECT {_COLS} FROM ev")
def prune_excess_verify(spark, sf):
    return _found(_day(spark, sf), "excessive_verification")


@query(f"{DAY} SELECT {_COLS} FROM lv")
def prune_late_verify(spark, sf):
    return _found(_day(spark, sf), "late_stage_verification")


@query(f"{DAY} SELECT {_COLS} FROM ub")
def prune_branches(spark, sf):
    return _found(_day(spark, sf), "underutilized_branch")


@query(f"{PLAIN} SELECT {_COLS} FROM tc")
def prune_chains(spark, sf):
    return _found(_plain(spark, sf), "redundant_transform_chain")


# Depths of long graphs: the longest path to a node, by a recursion over (trace, node, length) without repeats.
_DEPTH = ", dp(trace_id, node, d) AS (SELECT trace_id, id, 0 FROM nd UNION SELECT e.trace_id, e.dst, dp.d + 1 FROM dp JOIN ed e ON e.trace_id = dp.trace_id AND e.src = dp.node), dep AS (SELECT trace_id, max(d) AS depth FROM dp GROUP BY trace_id)"
_ENT = ", en AS (SELECT trace_id, sum(-(k / n) * ln(k / n + 1e-10)) AS h, max(n) AS n FROM (SELECT trace_id, type, count(*) AS k, max(n) AS n FROM nd GROUP BY trace_id, type) GROUP BY trace_id)"
_BLOAT = _DEPTH + _ENT + ", bl AS (SELECT en.trace_id, 'shallow_wide_bloat' AS region_type, '' AS node_ids, []::INTEGER[] AS l, 0.55::DOUBLE AS confidence, floor(n * 35 * 0.15::DOUBLE)::INTEGER AS savings, 'review' AS action FROM en JOIN dep ON dep.trace_id = en.trace_id WHERE depth / n < 0.25::DOUBLE AND n > 5 UNION ALL SELECT trace_id, 'low_type_diversity', '', []::INTEGER[], 0.6::DOUBLE, floor(n * 35 * 0.1::DOUBLE)::INTEGER, 'review' FROM en WHERE h < 0.5::DOUBLE AND n > 5)"


@query(f"{PLAIN}{_BLOAT} SELECT {_COLS} FROM bl")
def prune_bloat(spark, sf):
    return _found(_plain(spark, sf), "shallow_wide_bloat", "low_type_diversity")


@query(f"{DAY}{_BLOAT}, al AS (SELECT * FROM ev UNION ALL SELECT * FROM lv UNION ALL SELECT * FROM ub UNION ALL SELECT * FROM tc UNION ALL SELECT * FROM bl), g AS (SELECT trace_id, count(*) AS k, sum(CASE WHEN action IN ('merge', 'delete') THEN savings ELSE 0 END) AS s FROM al GROUP BY trace_id) SELECT tn.trace_id, coalesce(k, 0)::INTEGER AS n_regions, coalesce(s, 0)::INTEGER AS savings, floor(coalesce(s, 0) * 0.6::DOUBLE)::INTEGER AS savings_low, floor(coalesce(s, 0) * 1.4::DOUBLE)::INTEGER AS savings_high FROM tn LEFT JOIN g ON g.trace_id = tn.trace_id")
def prune_summary(spark, sf):
    return R.report(R.regions(_day(spark, sf)))


_CUT = """, sure AS (SELECT * FROM ev WHERE action = 'merge' AND confidence >= 0.5 UNION ALL SELECT * FROM ub WHERE confidence >= 0.5 UNION ALL SELECT * FROM tc),
dl AS (SELECT DISTINCT trace_id, unnest(CASE WHEN region_type = 'redundant_transform_chain' THEN l ELSE l[2:] END) AS id FROM sure),
kp AS (SELECT nd.trace_id, nd.id, nd.type, dl.id IS NULL AS keep FROM nd LEFT JOIN dl ON dl.trace_id = nd.trace_id AND dl.id = nd.id),
wk(trace_id, p, cur) AS (SELECT ed.trace_id, ed.src, ed.dst FROM ed JOIN kp ON kp.trace_id = ed.trace_id AND kp.id = ed.src AND kp.keep UNION SELECT wk.trace_id, wk.p, ed.dst FROM wk JOIN kp ON kp.trace_id = wk.trace_id AND kp.id = wk.cur AND NOT kp.keep JOIN ed ON ed.trace_id = wk.trace_id AND ed.src = wk.cur),
ne AS (SELECT wk.trace_id, wk.p AS src, wk.cur AS dst FROM wk JOIN kp ON kp.trace_id = wk.trace_id AND kp.id = wk.cur AND kp.keep),
rc(trace_id, id) AS (SELECT trace_id, id FROM kp WHERE id = 1 AND keep UNION SELECT ne.trace_id, ne.dst FROM rc JOIN ne ON ne.trace_id = rc.trace_id AND ne.src = rc.id),
hit AS (SELECT DISTINCT trace_id FROM dl)"""


@query(f"{DAY}{_CUT} SELECT trace_id, id AS node_id FROM dl")
def prune_deletions(spark, sf):
    return R.regions(_day(spark, sf)).select("trace_id", F.explode(R.deletions()).alias("node_id"))


def _pruned(spark, sf):
    return R.apply(R.regions(_day(spark, sf)))


@query(f"{DAY}{_CUT} SELECT nd.trace_id, nd.id AS node_id, nd.type FROM nd LEFT JOIN hit ON hit.trace_id = nd.trace_id LEFT JOIN rc ON rc.trace_id = nd.trace_id AND rc.id = nd.id WHERE hit.trace_id IS NULL OR rc.id IS NOT NULL")
def prune_apply_nodes(spark, sf):
    return _pruned(spark, sf).select("trace_id", F.inline("pruned_nodes")).select("trace_id", F.col("id").alias("node_id"), "type")


@query(f"{DAY}{_CUT} SELECT ed.trace_id, ed.src, ed.dst FROM ed LEFT JOIN hit ON hit.trace_id = ed.trace_id WHERE hit.trace_id IS NULL UNION ALL SELECT ne.trace_id, ne.src, ne.dst FROM ne JOIN hit ON hit.trace_id = ne.trace_id JOIN rc a ON a.trace_id = ne.trace_id AND a.id = ne.src JOIN rc b ON b.trace_id = ne.trace_id AND b.id = ne.dst")
def prune_apply_edges(spark, sf):
    return _pruned(spark, sf).select("trace_id", F.inline("pruned_edges"))


def prune_e2e(spark, sf):
    """Control, structural and signal conditions over order graphs. Equal texts are one graph, which counts as often as they occur."""
    return conditions(G.extract_rules(order_texts(spark, sf)), weight="weight")


QUERIES["prune_e2e"] = prune_e2e


# Signals

_W = lambda t: f"list_distinct(string_split_regex(lower(trim({t})), '\\s+'))"
_N = "len(string_split_regex(trim(text), '\\s+'))"
_HEDGE = "(" + " + ".join(f"CASE WHEN contains(lower(text), '{h}') THEN 1 ELSE 0 END" for h in T.HEDGES) + ")"
CAL_SQL = f"greatest(0::DOUBLE, least(1::DOUBLE, 1 - (least(0.45::DOUBLE, {_HEDGE} * 0.1::DOUBLE) + CASE WHEN {_N} < 3 THEN 0.2::DOUBLE WHEN {_N} > 60 THEN 0.1::DOUBLE ELSE 0::DOUBLE END) + CASE WHEN regexp_matches(text, '\\d') THEN 0.08::DOUBLE ELSE 0::DOUBLE END + CASE WHEN regexp_matches(text, '[=+*/^-]') THEN 0.06::DOUBLE ELSE 0::DOUBLE END + CASE WHEN type = 'Verify' AND regexp_matches(lower(text), 'correct|check|indeed|valid') THEN 0.06::DOUBLE ELSE 0::DOUBLE END))"
_NEW = f"(len(list_filter({_W('text')}, lambda w: NOT list_contains({_W('prev')}, w))) / len({_W('text')}))"
REW_SQL = f"greatest(0::DOUBLE, least(1::DOUBLE, 0.72::DOUBLE + CASE WHEN prev IS NULL THEN 0::DOUBLE WHEN {_NEW} < 0.15::DOUBLE THEN -0.22::DOUBLE WHEN {_NEW} > 0.6::DOUBLE THEN 0.08::DOUBLE ELSE 0::DOUBLE END - CASE WHEN prev IS NOT NULL AND string_split_regex(lower(trim(text)), '\\s+')[1] IN ('it', 'this', 'that', 'they') AND NOT regexp_matches(lower(prev), 'result|value|answer|sum|product') THEN 0.12::DOUBLE ELSE 0::DOUBLE END - CASE WHEN {_N} < 2 THEN 0.15::DOUBLE ELSE 0::DOUBLE END))"
_LAG = ", lg AS (SELECT trace_id, id, type, text, lag(text) OVER (PARTITION BY trace_id ORDER BY id) AS prev FROM nd)"


def _steps(spark, sf):
    z = F.transform("nodes", lambda n, i: F.struct(n["id"].alias("node_id"), n["type"].alias("type"), n["text"].alias("text"), F.when(i > 0, F.get(F.col("nodes"), i - 1)["text"]).alias("prev")))
    return order_graphs(spark, sf).select("trace_id", F.inline(z))


@query(f"{RBE_ND} SELECT trace_id, id AS node_id, round({CAL_SQL}, 6) AS score FROM nd")
def calibration_score(spark, sf):
    return _steps(spark, sf).select("trace_id", "node_id", F.round(T.calibration_score(F.col("text"), F.col("type")), 6).alias("score"))


@query(f"{RBE_ND}{_LAG} SELECT trace_id, id AS node_id, round({REW_SQL}, 6) AS score FROM lg")
def prm_score(spark, sf):
    return _steps(spark, sf).select("trace_id", "node_id", F.round(T.reward_score(F.col("text"), F.col("prev")), 6).alias("score"))


# Of order graphs, blocks of Verify nodes that are dense enough.
@query(f"""{RBE_ND}{_LAG}, sq AS (SELECT trace_id, id, {CAL_SQL} AS cal, {REW_SQL} AS rew FROM lg), tn AS (SELECT trace_id, count(*) AS n, count(*) FILTER (type = 'Verify') AS nv FROM nd GROUP BY trace_id),
vr AS (SELECT trace_id, id, id - row_number() OVER (PARTITION BY trace_id ORDER BY id) AS grp FROM nd WHERE type = 'Verify')
SELECT vr.trace_id, string_agg(vr.id::VARCHAR, ',' ORDER BY vr.id) AS node_ids, round(least(1::DOUBLE, 0.35::DOUBLE * least(1::DOUBLE, (max(nv) / max(n)) / 0.6::DOUBLE) + 0.35::DOUBLE * (1 - avg(cal)) + 0.3::DOUBLE * (1 - avg(rew))), 6) AS confidence
FROM vr JOIN tn ON tn.trace_id = vr.trace_id JOIN sq ON sq.trace_id = vr.trace_id AND sq.id = vr.id WHERE nv / n > 0.4::DOUBLE GROUP BY vr.trace_id, grp""")
def fused_confidence(spark, sf):
    g = R.with_config(order_graphs(spark, sf).withColumn("domain", F.lit("math")), PruneConfig(use_calibration_signal=True, use_prm_signal=True))
    return R.long_regions(R.fuse(R.regions(g))).where("region_type = 'excessive_verification'").select("trace_id", "node_ids", F.round("confidence", 6).alias("confidence"))


_SYN = """WITH s AS (SELECT r AS id, (r % 5 + 6)::INTEGER AS b, (CASE WHEN r % 3 = 0 THEN r % 2 + 2 ELSE 0 END)::INTEGER AS v, (CASE WHEN r % 4 = 1 THEN r % 3 + 4 ELSE 0 END)::INTEGER AS x FROM (SELECT unnest(range(0, 400)) AS r)),
nd AS (SELECT id AS trace_id, unnest(range(1, b + v + x + 1)) AS id, b, v, x FROM s), ny AS (SELECT trace_id, id, CASE WHEN id > b AND id <= b + v THEN 'Verify' ELSE 'Transform' END AS type, (id > b AND id <= b + v) OR id > b + v + 3 AS gold FROM nd),
t0 AS (SELECT trace_id, id, id - row_number() OVER (PARTITION BY trace_id ORDER BY id) AS grp FROM ny WHERE type = 'Transform'), t1 AS (SELECT trace_id, id, row_number() OVER (PARTITION BY trace_id, grp ORDER BY id) AS p FROM t0),
pr AS (SELECT DISTINCT trace_id, id FROM t1 WHERE p > {k}), j AS (SELECT coalesce(pr.id, 0) > 0 AS p, ny.gold AS g FROM ny LEFT JOIN pr ON pr.trace_id = ny.trace_id AND pr.id = ny.id),
c AS (SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM j)"""
_PRF = "tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1"


@query(_SYN.format(k=3) + f" SELECT {_PRF} FROM c")
def prune_prf(spark, sf):
    rows = R.regions(R.with_config(annotated_graphs(spark), PruneConfig())).withColumn("predicted", R.predicted())
    out = R.agreement(rows)
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(" UNION ALL ".join(f"SELECT * FROM ({_SYN.format(k=k)} SELECT {k}::DOUBLE AS value, {_PRF} FROM c)" for k in PRUNE_GRID["max_consecutive_transforms"]))
def threshold_scan(spark, sf):
    out = R.scan(annotated_graphs(spark), PruneConfig(), {"max_consecutive_transforms": PRUNE_GRID["max_consecutive_transforms"]})
    return out.select("value", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
