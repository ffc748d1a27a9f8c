"""Structural rules R1 to R6 as a list of violations inside each graph's row, validity, failure modes, robustness, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import VARIANTS
from .graph import fixed

E = F.expr
_V = "struct<rule:string,node_ids:array<int>,severity:string,failure_mode:string>"
#: Words that point at a source.
SOURCES = r"(?i)\b(theorem|lemma|definition|axiom|postulate|property|rule|formula|algorithm)\b", r"(?i)\b(law|principle|criterion|identity|inequality)\b"


def _one(rule: str, ids: str, severity: str, mode: str) -> str:
    return f"named_struct('rule', '{rule}', 'node_ids', {ids}, 'severity', '{severity}', 'failure_mode', '{mode}')"


def r1() -> Column:
    short = f"transform(filter(nodes, n -> length(n.text) between 1 and 7 and n.type <> 'Transform'), n -> {_one('R1', 'array(n.id)', 'warning', 'fragmented_step')})"
    long = f"transform(filter(nodes, n -> length(n.text) > 200 and n.type in ('Transform', 'Branch')), n -> {_one('R1', 'array(n.id)', 'warning', 'overloaded_step')})"
    return E(f"cast(concat({short}, {long}) as array<{_V}>)")


def r2(strict: bool | None = None) -> Column:
    """Neighbours in id order that are both Transform and joined by an edge, either way."""
    pairs = "filter(transform(sequence(1, greatest(size(nodes) - 1, 1)), i -> struct(nodes[i - 1] as a, get(nodes, i) as b)), p -> p.a.type = 'Transform' and p.b.type = 'Transform' and exists(edges, e -> (e.src = p.a.id and e.dst = p.b.id) or (e.src = p.b.id and e.dst = p.a.id)))"
    pairs = pairs.replace("nodes[i - 1]", "get(nodes, i - 1)")
    return E(f"cast(transform({pairs}, p -> {_one('R2', 'array(p.a.id, p.b.id)', 'warning' if strict is False else 'error', 'merged_computation')}) as array<{_V}>)")


def r3() -> Column:
    hits = " + ".join(f"regexp_count(n.text, r'{p}')" for p in SOURCES)
    return E(f"cast(transform(filter(nodes, n -> n.type = 'Retrieve' and {hits} >= 2), n -> {_one('R3', 'array(n.id)', 'warning', 'overloaded_retrieve')}) as array<{_V}>)")


def r4(strict: bool | None = None) -> Column:
    severity = "error" if strict else "warning"
    return E(f"cast(transform(filter(nodes, n -> n.type = 'Verify' and not exists(edges, e -> e.dst = n.id)), n -> {_one('R4', 'array(n.id)', severity, 'dependency_violation')}) as array<{_V}>)")


def r5(strict: bool | None = None) -> Column:
    severity = "error" if strict else "warning"
    return E(f"cast(transform(filter(nodes, n -> n.type = 'Branch' and size(filter(edges, e -> e.src = n.id)) < 2), n -> {_one('R5', 'array(n.id)', severity, 'pseudo_branch')}) as array<{_V}>)")


def r6() -> Column:
    empty = f"array({_one('R6', 'cast(array() as array<int>)', 'error', 'empty_graph')})"
    orphans = f"transform(filter(nodes, n -> n.id <> array_min(transform(nodes, m -> m.id)) and not exists(edges, e -> e.dst = n.id)), n -> {_one('R6', 'array(n.id)', 'warning', 'dependency_violation')})"
    return E(f"cast(if(size(nodes) = 0, {empty}, {orphans}) as array<{_V}>)")


def violations(strict: bool = True, allow_consecutive: bool = False, allow_orphan_verify: bool = False, require_fork: bool = True, least_nodes: int = 1) -> Column:
    parts = [r1()]
    parts += [] if allow_consecutive else [r2(strict)]
    parts += [] if allow_orphan_verify else [r4(strict)]
    parts += [r5(strict)] if require_fork else []
    parts += [r3()]
    parts += [r6()] if least_nodes > 0 else []
    return F.concat(*parts)


def validate(graphs: DataFrame, **rules) -> DataFrame:
    """graphs plus violations and is_valid (no error among them)."""
    return graphs.withColumn("violations", violations(**rules)).withColumn("is_valid", ~F.exists("violations", lambda v: v["severity"] == "error"))


def long_violations(graphs: DataFrame, **rules) -> DataFrame:
    rows = graphs.select("trace_id", F.explode(violations(**rules)).alias("v"))
    return rows.select("trace_id", "v.rule", F.array_join("v.node_ids", ",").alias("node_ids"), "v.severity", "v.failure_mode")


def failure_modes(graphs: DataFrame, **rules) -> DataFrame:
    rows = graphs.select("trace_id", F.explode(violations(**rules)).alias("v"))
    mode = F.when(F.coalesce(F.trim("v.failure_mode"), F.lit("")) == "", "other").otherwise(F.col("v.failure_mode"))
    return rows.groupBy("trace_id", mode.alias("failure_mode")).agg(F.count("*").alias("n_violations"))


def annotate_steps(graphs: DataFrame, **rules) -> DataFrame:
    """For each node: correct unless a violation names it, its failure modes (sorted) and number of violations."""
    rows = fixed(graphs.withColumn("_v", violations(**rules))).select("trace_id", "_v", F.explode("nodes").alias("n"))
    mine = F.filter("_v", lambda v: F.array_contains(v["node_ids"], F.col("n.id")))
    return rows.select("trace_id", F.col("n.id").alias("node_id"), (F.size(mine) == 0).alias("is_correct"), F.array_join(F.array_sort(F.array_distinct(F.transform(mine, lambda v: v["failure_mode"]))), ",").alias("failure_modes"), F.size(mine).alias("rule_violations"))


def robustness(graphs: DataFrame) -> DataFrame:
    """Pass rate under each variant of the rules, in one pass, with the stability over all: max(0, 1 - population std / mean)."""
    valid = [(~F.exists(violations(*v), lambda x: x["severity"] == "error")).cast("int").alias(name) for name, v in VARIANTS.items()]
    sums = graphs.select(*valid).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in VARIANTS])
    rows = sums.select("n", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.coalesce(v, F.lit(0)).alias("valid")) for v in VARIANTS])).alias("r"))
    rows = rows.select(F.col("r.variant").alias("rule_variant"), F.col("r.valid").alias("n_valid"), F.col("n").alias("n_total"), (F.col("r.valid") / F.greatest("n", F.lit(1))).alias("pass_rate"))
    stable = rows.agg(F.greatest(F.lit(0.0), 1 - F.stddev_pop("pass_rate") / F.greatest(F.avg("pass_rate"), F.lit(1e-8))).alias("stability"))
    return rows.join(F.broadcast(stable), F.lit(True))  # one row


def split_by_label(graphs: DataFrame, labels: DataFrame) -> DataFrame:
    """graphs plus part: ambiguous where the label is there and null, else clean."""
    known = labels.select("trace_id", "label", F.lit(True).alias("_there"))
    return graphs.join(known, "trace_id", "left").withColumn("part", F.when(F.col("_there") & F.col("label").isNull(), "ambiguous").otherwise("clean")).drop("_there", "label")
