"""Queries on single graphs: JSON, validity, rules, metrics, motifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import metrics as M
from ..operators import motifs as P
from ..operators import validate as V
from ..schema import MOTIF_ORDER, MOTIFS, TYPES
from .fixtures import CODE_SQL, event_graphs, event_sql, order_graphs
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


EV = "WITH RECURSIVE " + event_sql()
DEPTH = """, dp(trace_id, node, d) AS (SELECT trace_id, id, 0 FROM nd UNION SELECT e.trace_id, e.dst, dp.d + 1 FROM dp JOIN ed e ON e.trace_id = dp.trace_id AND e.src = dp.node),
dep AS (SELECT trace_id, max(d) AS depth FROM dp GROUP BY trace_id)"""
_CNT = ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t.lower()}" for t in TYPES)
BASE = EV + DEPTH + f""", nc AS (SELECT trace_id, min(user_id) AS user_id, count(*) AS n, {_CNT} FROM nd GROUP BY trace_id),
ec AS (SELECT trace_id, count(*) AS m, count(DISTINCT src) AS s FROM ed GROUP BY trace_id),
b AS (SELECT nc.*, coalesce(ec.m, 0) AS m, coalesce(ec.s, 0) AS s, dep.depth FROM nc LEFT JOIN ec ON nc.trace_id = ec.trace_id JOIN dep ON dep.trace_id = nc.trace_id)"""
_H = lambda log, eps: "(" + " + ".join(f"CASE WHEN n_{t.lower()} > 0 THEN -(n_{t.lower()} / n) * {log}((n_{t.lower()} / n) + {eps}) ELSE 0::DOUBLE END" for t in TYPES) + ")"
_r = lambda c: f"round({c}, 6)"
_z = lambda c: f"CASE WHEN abs({c}) < 5e-7 THEN 0::DOUBLE ELSE round({c}, 6) END"  # noqa: E731  no negative zero


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query("WITH " + event_sql() + ", nl AS (SELECT trace_id, count(*) AS n_nodes, string_agg(type, ',' ORDER BY id) AS types FROM nd GROUP BY trace_id), el AS (SELECT trace_id, string_agg(src || '>' || dst, ',' ORDER BY src, dst) AS edges FROM ed GROUP BY trace_id) SELECT nl.trace_id, n_nodes, types, coalesce(el.edges, '') AS edges FROM nl LEFT JOIN el ON nl.trace_id = el.trace_id")
def graph_roundtrip(spark, sf):
    """Graphs written as canonical JSON and read again."""
    back = G.from_canonical_json(event_graphs(spark, sf).select(G.to_canonical_json().alias("json")))
    return back.select("trace_id", F.size("nodes").cast("long").alias("n_nodes"), F.array_join(F.transform("nodes", lambda n: n["type"]), ",").alias("types"), F.array_join(F.transform(F.array_sort("edges"), lambda e: F.concat(e["src"].cast("string"), F.lit(">"), e["dst"].cast("string"))), ",").alias("edges"))


_LOST = event_sql("day", "skip").replace("ed AS (", "ed0 AS (") + ", ed AS (SELECT * FROM ed0 WHERE (src + dst) % 4 <> 1)"
_ISO = "iso AS (SELECT nd.trace_id, nd.id FROM nd WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.trace_id = nd.trace_id AND (ed.src = nd.id OR ed.dst = nd.id)))"


def _lossy(spark, sf):
    """Graphs that miss some edges, so that nodes are isolated and orphaned."""
    return G.fixed(event_graphs(spark, sf, "day", "skip").withColumn("edges", F.filter("edges", lambda e: (e["src"] + e["dst"]) % 4 != 1)))


@query(f"WITH {_LOST}, {_ISO} SELECT trace_id, id AS node_id FROM iso")
def isolates(spark, sf):
    return _lossy(spark, sf).select("trace_id", F.explode(G.isolates()).alias("node_id"))


@query(f"WITH {_LOST}, {_ISO} SELECT t.trace_id, CASE WHEN i.trace_id IS NULL THEN 0 ELSE 1 END AS n_errors, CASE WHEN i.trace_id IS NULL THEN '' ELSE 'isolated' END AS errors FROM (SELECT DISTINCT trace_id FROM nd) t LEFT JOIN (SELECT DISTINCT trace_id FROM iso) i ON t.trace_id = i.trace_id")
def is_valid_report(spark, sf):
    return G.valid_report(_lossy(spark, sf))


# Rules


def _long(rows, v):
    return rows.select("trace_id", F.explode(v).alias("v")).select("trace_id", F.array_join("v.node_ids", ",").alias("node_ids"), "v.severity", "v.failure_mode")


_OUT = "node_ids, severity, failure_mode"
R1_SQL = "SELECT trace_id, id::VARCHAR AS node_ids, 'warning' AS severity, CASE WHEN length(text) < 8 THEN 'fragmented_step' ELSE 'overloaded_step' END AS failure_mode FROM nd WHERE (length(text) BETWEEN 1 AND 7 AND type <> 'Transform') OR (length(text) > 200 AND type IN ('Transform', 'Branch'))"
R2_SQL = "SELECT a.trace_id, a.id || ',' || b.id AS node_ids, 'error' AS severity, 'merged_computation' AS failure_mode FROM nd a JOIN nd b ON a.trace_id = b.trace_id AND b.id = a.id + 1 WHERE a.type = 'Transform' AND b.type = 'Transform' AND EXISTS (SELECT 1 FROM ed e WHERE e.trace_id = a.trace_id AND e.src = a.id AND e.dst = b.id)"
_REF = " + ".join(f"len(regexp_extract_all(text, '(?i)\\b({w})\\b'))" for w in ("theorem|lemma|definition|axiom|postulate|property|rule|formula|algorithm", "law|principle|criterion|identity|inequality"))
R3_SQL = f"SELECT trace_id, id::VARCHAR AS node_ids, 'warning' AS severity, 'overloaded_retrieve' AS failure_mode FROM nd WHERE type = 'Retrieve' AND {_REF} >= 2"
R4_SQL = "SELECT trace_id, id::VARCHAR AS node_ids, 'error' AS severity, 'dependency_violation' AS failure_mode FROM nd WHERE type = 'Verify' AND NOT EXISTS (SELECT 1 FROM ed e WHERE e.trace_id = nd.trace_id AND e.dst = nd.id)"
R5_SQL = "SELECT trace_id, id::VARCHAR AS node_ids, 'error' AS severity, 'pseudo_branch' AS failure_mode FROM nd WHERE type = 'Branch' AND (SELECT count(*) FROM ed e WHERE e.trace_id = nd.trace_id AND e.src = nd.id) < 2"
R6_SQL = "SELECT trace_id, id::VARCHAR AS node_ids, 'warning' AS severity, 'dependency_violation' AS failure_mode FROM nd WHERE id > 1 AND NOT EXISTS (SELECT 1 FROM ed e WHERE e.trace_id = nd.trace_id AND e.dst = nd.id)"
_TEXT = "txt AS (SELECT trace_id, id, type, CASE WHEN id % 2 = 0 THEN left(text, 5) ELSE text || ' ' || text || ' ' || text || ' ' || text || ' ' || text END AS text FROM nd)"


def _stretched(spark, sf):
    """RBE graphs of orders with texts cut or repeated, so that length and reference rules fire."""
    text = lambda n: F.when(n["id"] % 2 == 0, F.substring(n["text"], 1, 5)).otherwise(F.concat_ws(" ", *[n["text"]] * 5))
    return G.fixed(order_graphs(spark, sf).withColumn("nodes", F.transform("nodes", lambda n: n.withField("text", text(n)))))


@query(f"{RBE_ND}, {_TEXT} {R1_SQL.replace('FROM nd', 'FROM txt')}")
def ngs_r1(spark, sf):
    return _long(_stretched(spark, sf), V.r1())


@query(f"{EV} {R2_SQL}")
def ngs_r2(spark, sf):
    return _long(event_graphs(spark, sf), V.r2(True))


@query(f"{RBE_ND}, {_TEXT} {R3_SQL.replace('FROM nd', 'FROM txt')}")
def ngs_r3(spark, sf):
    return _long(_stretched(spark, sf), V.r3())


@query(f"WITH {_LOST} {R4_SQL}")
def ngs_r4(spark, sf):
    return _long(_lossy(spark, sf), V.r4(True))


@query(f"{EV} {R5_SQL}")
def ngs_r5(spark, sf):
    return _long(event_graphs(spark, sf), V.r5(True))


@query(f"WITH {_LOST} {R6_SQL}")
def ngs_r6(spark, sf):
    return _long(_lossy(spark, sf), V.r6())


_VIOL = "v AS (" + " UNION ALL ".join(f"SELECT trace_id, '{r}' AS rule, {_OUT} FROM ({q})" for r, q in (("R2", R2_SQL), ("R4", R4_SQL), ("R5", R5_SQL), ("R6", R6_SQL))) + ")"
_VIOL_ND = f"WITH {_LOST}, {_VIOL}"


@query(f"{_VIOL_ND} SELECT t.trace_id, coalesce(c.n, 0) AS n_violations, coalesce(c.e, 0) = 0 AS is_valid FROM (SELECT DISTINCT trace_id FROM nd) t LEFT JOIN (SELECT trace_id, count(*) AS n, count(*) FILTER (severity = 'error') AS e FROM v GROUP BY trace_id) c ON t.trace_id = c.trace_id")
def ngs_validate(spark, sf):
    return V.validate(_lossy(spark, sf)).select("trace_id", F.size("violations").cast("long").alias("n_violations"), "is_valid")


@query(f"{_VIOL_ND} SELECT trace_id, failure_mode, count(*) AS n_violations FROM v GROUP BY ALL")
def failure_modes(spark, sf):
    return V.failure_modes(_lossy(spark, sf))


@query(f"{_VIOL_ND}, x AS (SELECT trace_id, unnest(string_split(node_ids, ','))::INTEGER AS id, failure_mode FROM v), g AS (SELECT trace_id, id, count(*) AS k, string_agg(DISTINCT failure_mode, ',' ORDER BY failure_mode) AS modes FROM x GROUP BY trace_id, id) SELECT nd.trace_id, nd.id AS node_id, g.k IS NULL AS is_correct, coalesce(g.modes, '') AS failure_modes, coalesce(g.k, 0)::INTEGER AS rule_violations FROM nd LEFT JOIN g ON g.trace_id = nd.trace_id AND g.id = nd.id")
def step_annotations(spark, sf):
    return V.annotate_steps(_lossy(spark, sf))


@query(
    f"WITH {_LOST}, r2 AS (SELECT DISTINCT trace_id FROM ({R2_SQL})), r4 AS (SELECT DISTINCT trace_id FROM ({R4_SQL})), r5 AS (SELECT DISTINCT trace_id FROM ({R5_SQL})), t AS (SELECT DISTINCT trace_id FROM nd), "
    "f AS (SELECT t.trace_id, r2.trace_id IS NOT NULL AS a, r4.trace_id IS NOT NULL AS b, r5.trace_id IS NOT NULL AS c FROM t LEFT JOIN r2 ON t.trace_id = r2.trace_id LEFT JOIN r4 ON t.trace_id = r4.trace_id LEFT JOIN r5 ON t.trace_id = r5.trace_id), "
    "p AS (SELECT 'strict' AS rule_variant, count(*) FILTER (NOT (a OR b OR c)) AS n_valid, count(*) AS n_total FROM f UNION ALL SELECT 'standard', count(*), count(*) FROM f UNION ALL SELECT 'relaxed', count(*), count(*) FROM f UNION ALL SELECT 'ultra_relaxed', count(*), count(*) FROM f) "
    "SELECT rule_variant, n_valid, n_total, round(n_valid / n_total, 6) AS pass_rate, round(greatest(0::DOUBLE, 1 - (SELECT stddev_pop(n_valid / n_total) / avg(n_valid / n_total) FROM p)), 6) AS stability FROM p"
)
def ngs_robustness(spark, sf):
    return _rounded(V.robustness(_lossy(spark, sf)), "pass_rate", "stability")


# Metrics


@query(BASE + f" SELECT trace_id, depth::DOUBLE AS depth, {_r('CASE WHEN s > 0 THEN m / s ELSE 0::DOUBLE END')} AS branching_factor, {_r('n_verify / n')} AS verification_density, {_r('n_backtrack / n')} AS backtrack_rate, {_r(_H('log2', 0))} AS topological_entropy, n::INTEGER AS n_nodes, m::INTEGER AS n_edges, {', '.join(f'n_{t.lower()}::INTEGER AS n_{t.lower()}' for t in TYPES)} FROM b")
def level1_features(spark, sf):
    return _rounded(M.level1(event_graphs(spark, sf)), "branching_factor", "verification_density", "backtrack_rate", "topological_entropy")


_GM = f"depth::DOUBLE AS depth, m / n AS branching, n_verify / n AS verify_density, n_backtrack / n AS backtrack_rate, {_H('ln', '1e-10')} AS entropy, 2 * m / n AS avg_degree, m / (CASE WHEN n > 1 THEN n * (n - 1) / 2 ELSE 1::DOUBLE END) AS graph_density, 1::DOUBLE AS extraction_rate"


@query(BASE + f", g AS (SELECT trace_id, n::INTEGER AS n_nodes, m::INTEGER AS n_edges, {_GM} FROM b) SELECT trace_id, n_nodes, n_edges, depth, " + ", ".join(f"{_z(c)} AS {c}" for c in ("branching", "verify_density", "backtrack_rate", "entropy", "avg_degree", "graph_density", "extraction_rate")) + " FROM g")
def graph_metrics(spark, sf):
    return _rounded(M.graph_metrics(event_graphs(spark, sf)), "branching", "verify_density", "backtrack_rate", "entropy", "avg_degree", "graph_density", "extraction_rate")


MATRIX = BASE + f""", od AS (SELECT nd.trace_id, nd.id, count(e.src) AS o FROM nd LEFT JOIN ed e ON e.trace_id = nd.trace_id AND e.src = nd.id GROUP BY nd.trace_id, nd.id),
sh AS (SELECT trace_id, max(o)::DOUBLE AS max_out_degree, count(*) FILTER (o = 0)::DOUBLE AS n_leaf_nodes FROM od GROUP BY trace_id),
mx AS (SELECT b.trace_id, b.user_id, n::DOUBLE AS n_nodes, m::DOUBLE AS n_edges, {_GM}, {', '.join(f'n_{t.lower()} / n AS {t.lower()}_ratio' for t in TYPES)}, max_out_degree, n_leaf_nodes, 0::DOUBLE AS mean_text_len FROM b JOIN sh ON sh.trace_id = b.trace_id)"""


@query(MATRIX + " SELECT trace_id, " + ", ".join(f"{_z(c)} AS {c}" for c in M.METRICS) + " FROM mx")
def feature_matrix19(spark, sf):
    return _rounded(M.metric_matrix(event_graphs(spark, sf)), *M.METRICS)


@query(MATRIX + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, {_z(f'avg({c})')} AS mean, {_z(f'stddev_pop({c})')} AS std, {_z(f'min({c})')} AS min, {_z(f'max({c})')} AS max FROM mx" for c in M.METRICS) + ")")
def metric_summary(spark, sf):
    return _rounded(M.summary(M.metric_matrix(event_graphs(spark, sf)), M.METRICS), "mean", "std", "min", "max")


@query(RBE_ND + " SELECT type, count(*) AS n FROM nd GROUP BY type")
def type_histogram(spark, sf):
    return M.type_histogram(order_graphs(spark, sf))


@query(EV + " SELECT user_id % 5 AS model, type, count(*) AS n FROM nd GROUP BY ROLLUP (user_id % 5, type)")
def type_rollup(spark, sf):
    """Types by model with subtotals (grouping sets)."""
    long = event_graphs(spark, sf).select((F.col("user_id") % 5).alias("model"), F.explode("nodes").alias("n")).select("model", F.col("n.type").alias("type"))
    return long.rollup("model", "type").agg(F.count("*").alias("n"))


@query(EV + ", w AS (SELECT nd.trace_id, nd.n, nd.type IN ('Branch', 'Backtrack') AND NOT EXISTS (SELECT 1 FROM ed e JOIN nd c ON c.trace_id = e.trace_id AND c.id = e.dst WHERE e.trace_id = nd.trace_id AND e.src = nd.id AND c.type IN ('Transform', 'Retrieve', 'Compare')) AS waste FROM nd) SELECT trace_id, round(count(*) FILTER (waste) / count(*), 6) AS plan_redundancy FROM w GROUP BY trace_id")
def plan_redundancy(spark, sf):
    g = event_graphs(spark, sf)
    return g.select("trace_id", F.round(M.plan_redundancy(g), 6).alias("plan_redundancy"))


@query(MATRIX + ", lb AS (SELECT trace_id, user_id % 2 = 0 AS correct, n_nodes, depth, verify_density, entropy FROM mx) SELECT correct, count(*) AS n, round(avg(n_nodes), 6) AS mean_n_nodes, round(avg(depth), 6) AS mean_depth, round(avg(verify_density), 6) AS mean_verify_density, round(avg(entropy), 6) AS mean_entropy FROM lb GROUP BY correct")
def correct_vs_incorrect(spark, sf):
    names = ("n_nodes", "depth", "verify_density", "entropy")
    rows = M.metric_matrix(event_graphs(spark, sf), "user_id").withColumn("correct", F.col("user_id") % 2 == 0)
    return _rounded(M.by_correctness(rows, names), *[f"mean_{c}" for c in names])


@query(EV + DEPTH + " SELECT trace_id, depth FROM dep")
def longest_path(spark, sf):
    return G.with_depth(event_graphs(spark, sf)).select("trace_id", "depth")


@query(EV + f" SELECT trace_id, string_agg({CODE_SQL}, '' ORDER BY id) AS codes FROM nd GROUP BY trace_id")
def type_sequence(spark, sf):
    return event_graphs(spark, sf).select("trace_id", G.type_codes().alias("codes"))


# Motifs

_NO = lambda *pairs: " AND ".join(f"NOT EXISTS (SELECT 1 FROM ed z WHERE z.trace_id = a.trace_id AND z.src = {x} AND z.dst = {y})" for x, y in pairs)
_TY = "ty AS (SELECT e.trace_id, e.src, e.dst, s.type AS st, d.type AS dt FROM ed e JOIN nd s ON s.trace_id = e.trace_id AND s.id = e.src JOIN nd d ON d.trace_id = e.trace_id AND d.id = e.dst)"
_CH = f"ch AS (SELECT a.trace_id, a.st AS t1, a.dt AS t2, b.dt AS t3 FROM ty a JOIN ty b ON a.trace_id = b.trace_id AND b.src = a.dst WHERE {_NO(('a.src', 'b.dst'))})"
_FK = f"fk AS (SELECT a.trace_id, a.src AS p, a.dst AS q, b.dst AS r, a.st AS t1, a.dt AS t2, b.dt AS t3 FROM ty a JOIN ty b ON a.trace_id = b.trace_id AND b.src = a.src AND a.dst < b.dst WHERE {_NO(('a.dst', 'b.dst'))})"
_MG = f"mg AS (SELECT a.trace_id, a.st AS t1, b.st AS t2, a.dt AS t3 FROM ty a JOIN ty b ON a.trace_id = b.trace_id AND b.dst = a.dst AND a.src < b.src WHERE {_NO(('a.src', 'b.src'))})"
_DM = f"dm AS (SELECT a.trace_id FROM fk a JOIN ty x ON x.trace_id = a.trace_id AND x.src = a.q JOIN ty y ON y.trace_id = a.trace_id AND y.src = a.r AND y.dst = x.dst WHERE {_NO(('a.p', 'x.dst'))})"
_RULES = {
    "M1": ("ch", "true", "true"), "M2": ("fk", "true", "true"), "M3": ("dm", "true", "true"), "M4": ("ch", "false", "false"), "M5": ("ty", *["st = 'Transform' AND dt = 'Verify'"] * 2),
    "M6": ("ty", "st = 'Backtrack' AND dt IN ('Retrieve', 'Transform')", "st = 'Backtrack' AND dt = 'Retrieve'"), "M7": ("fk", "t1 = 'Branch'", "t1 = 'Branch' AND t2 = 'Transform' AND t3 = 'Transform'"),
    "M8": ("mg", "t3 = 'Verify'", "t3 = 'Verify' AND t1 = 'Transform' AND t2 = 'Transform'"), "M9": ("ty", *["st = 'Branch' AND dt = 'Transform'"] * 2), "M10": ("ty", *["st = 'Transform' AND dt = 'Transform'"] * 2),
    "M11": ("ty", *["st = 'Retrieve' AND dt = 'Transform'"] * 2), "M12": ("ty", *["st = 'Transform' AND dt = 'Branch'"] * 2),
}
MOTIF_SQL = BASE + f", {_TY}, {_CH}, {_FK}, {_MG}, {_DM}, mc0 AS (" + " UNION ALL ".join(f"SELECT trace_id, '{m}' AS motif_id, count(*) FILTER ({c}) AS k, count(*) FILTER ({t}) AS kt FROM {src} GROUP BY trace_id" for m, (src, c, t) in _RULES.items()) + "), mid AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in MOTIF_ORDER) + "]) AS motif_id), mc AS (SELECT b.trace_id, mid.motif_id, coalesce(mc0.k, 0)::INTEGER AS n_matches, coalesce(mc0.kt, 0)::INTEGER AS n_typed FROM b CROSS JOIN mid LEFT JOIN mc0 ON mc0.trace_id = b.trace_id AND mc0.motif_id = mid.motif_id)"


@query(MOTIF_SQL + " SELECT trace_id, motif_id, n_matches, n_typed FROM mc")
def motif_counts(spark, sf):
    return P.counts(event_graphs(spark, sf)).select("trace_id", "motif_id", "n_matches", "n_typed")


_PLACES = {  # the exact types' places in graphs without cycles, each with its nodes
    "M1": ("ty a JOIN ty b ON a.trace_id = b.trace_id AND b.src = a.dst", "[a.src, a.dst, b.dst]", _NO(("a.src", "b.dst"))),
    "M2": (_FORKED := "ty a JOIN ty b ON a.trace_id = b.trace_id AND b.src = a.src AND a.dst < b.dst", "[a.src, a.dst, b.dst]", _NO(("a.dst", "b.dst"))),
    "M7": (_FORKED, "[a.src, a.dst, b.dst]", _NO(("a.dst", "b.dst")) + " AND a.st = 'Branch' AND a.dt = 'Transform' AND b.dt = 'Transform'"),
    "M3": (f"{_FORKED} JOIN ty x ON x.trace_id = a.trace_id AND x.src = a.dst JOIN ty y ON y.trace_id = a.trace_id AND y.src = b.dst AND y.dst = x.dst", "[a.src, a.dst, b.dst, x.dst]", _NO(("a.dst", "b.dst"), ("a.src", "x.dst"))),
    "M8": ("ty a JOIN ty b ON a.trace_id = b.trace_id AND b.dst = a.dst AND a.src < b.src", "[a.src, b.src, a.dst]", _NO(("a.src", "b.src")) + " AND a.st = 'Transform' AND b.st = 'Transform' AND a.dt = 'Verify'"),
    **{m: ("ty a", "[a.src, a.dst]", f"a.st = '{t[0]}' AND a.dt = '{t[1]}'") for m, (shape, _, t) in MOTIFS.items() if shape == "edge"},
}
_TAKEN = "oc AS (" + " UNION ALL ".join(f"SELECT a.trace_id, '{m}' AS motif_id, list_sort({ids}) AS ids FROM {src} WHERE {c}" for m, (src, ids, c) in _PLACES.items()) + """),
os AS (SELECT *, row_number() OVER (PARTITION BY trace_id, motif_id ORDER BY ids) AS r FROM (SELECT DISTINCT * FROM oc)),
tk(trace_id, motif_id, r, used, said, k) AS (SELECT trace_id, motif_id, 1::BIGINT, ids, array_to_string(ids, '-'), 1 FROM os WHERE r = 1
UNION ALL SELECT tk.trace_id, tk.motif_id, os.r, CASE WHEN list_has_any(used, ids) THEN used ELSE list_concat(used, ids) END, CASE WHEN list_has_any(used, ids) THEN said ELSE said || ',' || array_to_string(ids, '-') END, k + CASE WHEN list_has_any(used, ids) THEN 0 ELSE 1 END FROM tk JOIN os ON os.trace_id = tk.trace_id AND os.motif_id = tk.motif_id AND os.r = tk.r + 1)"""


@query(f"WITH RECURSIVE {event_sql('day', 'fork')}, {_TY}, {_TAKEN} SELECT trace_id, motif_id, max(k)::INTEGER AS n_disjoint, arg_max(said, r) AS node_sets FROM tk GROUP BY trace_id, motif_id")
def motif_disjoint(spark, sf):
    """Preset matches that share no node, of graphs with any."""
    rows = P.disjoint(event_graphs(spark, sf)).where("n_disjoint > 0")
    return rows.select("trace_id", "motif_id", "n_disjoint", F.array_join(F.transform("node_sets", lambda s: F.array_join(s, "-")), ",").alias("node_sets"))


@query(MOTIF_SQL + " SELECT trace_id, motif_id, least(n_matches, 1) AS present, least(n_typed, 1) AS present_typed FROM mc")
def motif_presence(spark, sf):
    return P.counts(event_graphs(spark, sf)).select("trace_id", "motif_id", "present", "present_typed")


@query(MOTIF_SQL + " SELECT motif_id, round(avg(least(n_typed, 1)), 6) AS frequency, round(avg(least(n_matches, 1)), 6) AS frequency_counted FROM mc GROUP BY motif_id")
def motif_doc_freq(spark, sf):
    return _rounded(P.document_frequency(event_graphs(spark, sf)), "frequency", "frequency_counted")


@query(MOTIF_SQL + ", pr AS (SELECT trace_id, motif_id, least(n_matches, 1) AS p, sum(least(n_matches, 1)) OVER (PARTITION BY trace_id) AS t FROM mc) SELECT trace_id, motif_id, round(CASE WHEN t > 0 THEN p / t ELSE 1 / 12.0::DOUBLE END, 6) AS weight, round((p + 1e-8) / (t + 12e-8), 6) AS smoothed FROM pr")
def motif_vector(spark, sf):
    rows = P.with_counts(event_graphs(spark, sf)).select("trace_id", P.presence().alias("p"))
    rows = G.fixed(rows).select("trace_id", F.explode(F.arrays_zip(F.array(*[F.lit(m) for m in MOTIF_ORDER]).alias("m"), P.vector(F.col("p")).alias("v"), P.distribution(F.col("p")).alias("d"))).alias("z"))
    return rows.select("trace_id", F.col("z.m").alias("motif_id"), F.round("z.v", 6).alias("weight"), F.round("z.d", 6).alias("smoothed"))


@query(MOTIF_SQL + ", pr AS (SELECT trace_id, motif_id, least(n_matches, 1) AS p, sum(least(n_matches, 1)) OVER (PARTITION BY trace_id) AS t FROM mc), w AS (SELECT trace_id, motif_id, CASE WHEN t > 0 THEN p / t ELSE 1 / 12.0::DOUBLE END AS v FROM pr) SELECT trace_id, (list(motif_id ORDER BY v DESC, motif_id))[1] AS dominant, round(sum(CASE WHEN v > 0 THEN -v * log2(v) ELSE 0 END), 6) AS entropy FROM w GROUP BY trace_id")
def motif_distribution(spark, sf):
    rows = G.fixed(P.with_counts(event_graphs(spark, sf)).select("trace_id", P.vector(P.presence()).alias("v")))
    return rows.select("trace_id", P.dominant(F.col("v")).alias("dominant"), F.round(P.vector_entropy(F.col("v")), 6).alias("entropy"))


_SETS = "s2 AS (SELECT DISTINCT trace_id, src AS x, dst AS y, 0 AS z FROM ed), tr AS (SELECT a.trace_id, list_sort(list_distinct([a.src, a.dst, b.src, b.dst])) AS l FROM ed a JOIN ed b ON a.trace_id = b.trace_id), s3 AS (SELECT DISTINCT trace_id, l[1] AS x, l[2] AS y, l[3] AS z FROM tr WHERE len(l) = 3), st AS (SELECT * FROM s2 UNION ALL SELECT * FROM s3)"
_PAT = "ke AS (SELECT st.trace_id, st.x, st.y, st.z, string_agg((CASE e.src WHEN st.x THEN 0 WHEN st.y THEN 1 ELSE 2 END) || '>' || (CASE e.dst WHEN st.x THEN 0 WHEN st.y THEN 1 ELSE 2 END), ',' ORDER BY e.src, e.dst) AS k FROM st JOIN ed e ON e.trace_id = st.trace_id AND e.src IN (st.x, st.y, st.z) AND e.dst IN (st.x, st.y, st.z) GROUP BY st.trace_id, st.x, st.y, st.z), pt AS (SELECT DISTINCT ke.trace_id, a.type || '-' || b.type || coalesce('-' || c.type, '') || ' ' || ke.k AS pattern FROM ke JOIN nd a ON a.trace_id = ke.trace_id AND a.id = ke.x JOIN nd b ON b.trace_id = ke.trace_id AND b.id = ke.y LEFT JOIN nd c ON c.trace_id = ke.trace_id AND c.id = ke.z)"


@query(f"{EV}, {_SETS}, {_PAT} SELECT pattern, count(*) AS n_graphs, round(count(*) / (SELECT count(DISTINCT trace_id) FROM nd), 6) AS frequency FROM pt GROUP BY pattern HAVING count(*) / (SELECT count(DISTINCT trace_id) FROM nd) >= 0.01")
def motif_discovery(spark, sf):
    return _rounded(P.discover(event_graphs(spark, sf), 0.01), "frequency")


@query(f"{EV}, {_SETS}, kl AS (SELECT st.trace_id, st.x, st.y, st.z, string_agg(e.src || '>' || e.dst, ',' ORDER BY e.src, e.dst) AS label FROM st JOIN ed e ON e.trace_id = st.trace_id AND e.src IN (st.x, st.y, st.z) AND e.dst IN (st.x, st.y, st.z) GROUP BY st.trace_id, st.x, st.y, st.z) SELECT label, count(*) AS n_instances FROM kl GROUP BY label HAVING count(*) >= greatest(1, trunc((SELECT count(DISTINCT trace_id) FROM nd) * 0.05))")
def motif_discovery_literal(spark, sf):
    return P.discover_literal(event_graphs(spark, sf), 0.05)
