"""Redundancy: regions found inside each graph's row, fused with text signals, pruned with rerouting; evaluation and threshold scans.

Thresholds are columns resolved for each row's domain, so one job serves all domains (and, in a scan, all candidates).
"""

from __future__ import annotations

from dataclasses import fields
from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import calibration_score, reward_score
from ..schema import PRUNE_GRID, PruneConfig
from .graph import fixed, node_depths
from .metrics import graph_metrics

E = F.expr
REGION = "struct<region_type:string,node_ids:array<int>,confidence:double,savings:int,action:string>"
_FIELDS = [f.name for f in fields(PruneConfig) if f.name != "domain_overrides"]


def with_config(graphs: DataFrame, config: PruneConfig, domain_col: str = "domain") -> DataFrame:
    """graphs plus cfg, a struct of the thresholds of the row's domain."""

    def value(name: str) -> Column:
        base = getattr(config, name)
        c = None
        for domain in config.domain_overrides:
            own = getattr(config.for_domain(domain), name)
            if own != base:
                c = (F.when if c is None else c.when)(F.col(domain_col) == domain, F.lit(own))
        return (F.lit(base) if c is None else c.otherwise(F.lit(base))).alias(name)

    return graphs.withColumn("cfg", F.struct(*[value(n) for n in _FIELDS]))


def _region(kind: str, ids: str, confidence: str, savings: str, action: str) -> str:
    return f"named_struct('region_type', '{kind}', 'node_ids', {ids}, 'confidence', cast({confidence} as double), 'savings', cast({savings} as int), 'action', {action})"


def regions(graphs: DataFrame) -> DataFrame:
    """graphs (with cfg) plus regions, in the detectors' order. Depths need forward edges."""
    m = graph_metrics(graphs, *[c for c in graphs.columns if c != "trace_id"]).withColumnsRenamed({"n_nodes": "_n", "depth": "_depth", "entropy": "_entropy"})
    rows = m.select(*graphs.columns, "_n", "_depth", "_entropy").withColumn("_v", E("transform(filter(nodes, n -> n.type = 'Verify'), n -> n.id)")).withColumn("_down", node_depths())
    rows = fixed(rows.withColumn("_k", F.size("nodes")))
    blocks = E("""aggregate(_v, cast(array() as array<array<int>>), (acc, x) -> if(element_at(try_element_at(acc, -1), -1) = x - 1,
        concat(slice(acc, 1, size(acc) - 1), array(array_append(element_at(acc, -1), x))), array_append(acc, array(x))))""")
    chains = E("""filter(aggregate(nodes, array(cast(array() as array<int>)), (acc, n) -> if(n.type = 'Transform',
        concat(slice(acc, 1, size(acc) - 1), array(array_append(element_at(acc, -1), n.id))),
        if(size(element_at(acc, -1)) > 0, array_append(acc, cast(array() as array<int>)), acc))), c -> size(c) > cfg.max_consecutive_transforms)""")
    late = E("transform(filter(transform(nodes, (n, i) -> struct(n.id as id, n.type as type, i as i)), x -> x.type = 'Verify' and x.i >= floor(_k * 0.7)), x -> x.id)")
    under = E("""transform(filter(nodes, n -> n.type = 'Branch' and (size(filter(edges, e -> e.src = n.id)) < 2
        or coalesce(array_max(transform(filter(edges, e -> e.src = n.id), e -> _down[e.dst])), 0) <= 1)), n -> n.id)""")
    rows = fixed(rows.withColumn("_blocks", blocks).withColumn("_chains", chains).withColumn("_late", late).withColumn("_under", under).withColumn("_b", E("size(filter(nodes, n -> n.type = 'Branch'))")))
    density = "size(_v) / _k"
    none = f"cast(array() as array<{REGION}>)"
    part = lambda test, made: f"if({test}, {made}, {none})"
    cast = lambda s: f"cast({s} as array<{REGION}>)"
    verify = cast(f"transform(_blocks, b -> {_region('excessive_verification', 'b', f'least(1.0D, {density} / 0.6D)', 'size(b) * cfg.avg_tokens_per_node', chr(39).join(['if(size(b) > 1, ', 'merge', ', ', 'review', ')']))})")
    late_r = cast(f"array({_region('late_stage_verification', '_late', '0.75', 'size(_late) * cfg.avg_tokens_per_node div 2', chr(39) + 'review' + chr(39))})")
    util = "(1 - size(_under) / _b)"
    branch = cast(f"array({_region('underutilized_branch', '_under', f'least(1.0D, 1 - {util})', 'size(_under) * cfg.avg_tokens_per_node', chr(39) + 'merge' + chr(39))})")
    excess = "slice(c, cfg.max_consecutive_transforms + 1, size(c))"
    chain = cast(f"transform(_chains, c -> {_region('redundant_transform_chain', excess, '0.70', f'size({excess}) * cfg.avg_tokens_per_node', chr(39) + 'merge' + chr(39))})")
    no_ids = "cast(array() as array<int>)"
    shallow = cast(f"array({_region('shallow_wide_bloat', no_ids, '0.55', 'floor(_n * cfg.avg_tokens_per_node * 0.15D)', chr(39) + 'review' + chr(39))})")
    low = cast(f"array({_region('low_type_diversity', no_ids, '0.60', 'floor(_n * cfg.avg_tokens_per_node * 0.10D)', chr(39) + 'review' + chr(39))})")
    found = E("concat(" + ", ".join((
        part(f"size(_v) > 0 and {density} > cfg.verify_density_high", verify), part("size(_late) > 0 and size(_late) / size(_v) > cfg.verify_late_stage_ratio", late_r),
        part(f"size(_under) > 0 and {util} < cfg.branch_utilization_min", branch), chain,
        part("_depth / _n < cfg.max_depth_to_nodes_ratio and _n > 5", shallow), part("_entropy < cfg.entropy_low_threshold and _n > 5", low),
    )) + ")")
    return fixed(rows.withColumn("regions", found).select(*graphs.columns, "regions"))


def scorer(places: tuple[str, ...], fallback):
    """The first Column function that can be imported of places ("module:name"), or fallback: a score of one's own takes the place of a heuristic."""
    for place in places:
        module, _, name = place.partition(":")
        try:
            return getattr(import_module(module), name)
        except (ImportError, AttributeError):
            continue
    return fallback


def fuse(rows: DataFrame, calibration=calibration_score, reward=reward_score) -> DataFrame:
    """Confidence of regions with nodes as the weighted mean of structure, 1 - calibration and 1 - reward (those that cfg uses).
    calibration: a Column function of a step's text and type; reward: one of its text and that of the step before. Both give 0 to 1."""
    scored = F.transform("nodes", lambda n, i: F.struct(
        n["id"].alias("id"), calibration(n["text"], n["type"]).alias("cal"), reward(n["text"], F.when(i > 0, F.get(F.col("nodes"), i - 1)["text"])).alias("rew"),
    ))
    rows = fixed(rows.withColumn("_s", scored))
    mean = lambda f: f"aggregate(filter(_s, s -> array_contains(r.node_ids, s.id)), 0.0D, (a, s) -> a + s.{f}) / size(filter(_s, s -> array_contains(r.node_ids, s.id)))"
    wc, wp = "if(cfg.use_calibration_signal, cfg.calibration_weight, 0.0D)", "if(cfg.use_prm_signal, cfg.prm_weight, 0.0D)"
    ws = f"greatest(0.0D, 1 - {wc} - {wp})"
    cal, rew = f"if(cfg.use_calibration_signal, {wc} * (1 - {mean('cal')}), 0.0D)", f"if(cfg.use_prm_signal, {wp} * (1 - {mean('rew')}), 0.0D)"
    new = f"if(size(r.node_ids) = 0, r.confidence, least(1.0D, ({ws} * r.confidence + {cal} + {rew}) / ({ws} + {wc} + {wp})))"
    return rows.withColumn("regions", E(f"cast(transform(regions, r -> named_struct('region_type', r.region_type, 'node_ids', r.node_ids, 'confidence', {new}, 'savings', r.savings, 'action', r.action)) as array<{REGION}>)")).drop("_s")


def deletions() -> Column:
    """Ids to delete: of sure regions, all of a chain's excess, and all but the first of a merged block."""
    return E("""array_distinct(flatten(transform(filter(regions, r -> r.confidence >= cfg.min_confidence_threshold and r.action in ('merge', 'delete')),
        r -> if(r.action = 'delete' or r.region_type = 'redundant_transform_chain', r.node_ids, slice(r.node_ids, 2, size(r.node_ids))))))""")


def apply(rows: DataFrame) -> DataFrame:
    """rows (with regions) plus pruned_nodes, pruned_edges, integrity. Nodes that a kept node reached through deleted ones are
    linked to it; what the root no longer reaches goes. Without deletions the graph stays as it is. Edges go forward."""
    rows = fixed(rows.withColumn("_del", deletions()))
    way = E("""aggregate(reverse(nodes), cast(map() as map<int,array<int>>), (acc, n) -> map_concat(acc, map(n.id, array_distinct(flatten(transform(
        filter(edges, e -> e.src = n.id), e -> if(array_contains(_del, e.dst), coalesce(acc[e.dst], cast(array() as array<int>)), array(e.dst))))))))""")
    absorbed = E("""flatten(transform(filter(regions, r -> r.confidence >= cfg.min_confidence_threshold and r.action = 'merge' and r.region_type <> 'redundant_transform_chain' and size(r.node_ids) > 1),
        r -> transform(slice(r.node_ids, 2, size(r.node_ids)), i -> struct(r.node_ids[0] as into, i as id))))""")
    rows = fixed(rows.withColumn("_way", way).withColumn("_abs", absorbed))
    links = E("flatten(transform(filter(nodes, n -> not array_contains(_del, n.id)), n -> transform(array_sort(_way[n.id]), t -> named_struct('src', n.id, 'dst', t))))")
    rows = fixed(rows.withColumn("_links", links))
    reach = E("""aggregate(filter(nodes, n -> not array_contains(_del, n.id)), cast(array() as array<int>), (acc, n) -> if(n.id = nodes[0].id or exists(_links, e -> e.dst = n.id and array_contains(acc, e.src)), array_append(acc, n.id), acc))""")
    rows = fixed(rows.withColumn("_reach", F.when(F.size("nodes") > 0, reach).otherwise(F.array().cast("array<int>"))))
    text = "trim(concat_ws(' ', n.text, array_join(filter(transform(filter(_abs, a -> a.into = n.id), a -> filter(nodes, m -> m.id = a.id)[0].text), t -> t <> ''), ' ')))"
    kept = E(f"transform(filter(nodes, n -> array_contains(_reach, n.id)), n -> named_struct('id', n.id, 'type', n.type, 'text', if(exists(_abs, a -> a.into = n.id), {text}, n.text), 'span', n.span))")
    edges = E("filter(_links, e -> array_contains(_reach, e.src) and array_contains(_reach, e.dst))")
    same = F.size("_del") == 0
    out = rows.withColumn("pruned_nodes", F.when(same, F.col("nodes")).otherwise(kept)).withColumn("pruned_edges", F.when(same, F.col("edges")).otherwise(edges))
    return fixed(out.withColumn("integrity", F.when(same | (F.size("_reach") > 0), 1.0).otherwise(0.0)).drop("_way", "_abs", "_links", "_reach", "_del"))


def report(rows: DataFrame) -> DataFrame:
    """trace_id, n_regions, savings of deletable and mergeable regions with the range of 40 % either way."""
    saved = F.aggregate(F.filter("regions", lambda r: r["action"].isin("merge", "delete")), F.lit(0), lambda a, r: a + r["savings"])
    out = rows.select("trace_id", F.size("regions").alias("n_regions"), saved.alias("savings"))
    return out.withColumn("savings_low", F.floor(F.col("savings") * 0.6).cast("int")).withColumn("savings_high", F.floor(F.col("savings") * 1.4).cast("int"))


def long_regions(rows: DataFrame) -> DataFrame:
    r = rows.select("trace_id", F.posexplode("regions").alias("ord", "r"))
    return r.select("trace_id", "ord", "r.region_type", F.array_join("r.node_ids", ",").alias("node_ids"), "r.confidence", "r.savings", "r.action")


def predicted(threshold: str = "cfg.min_confidence_threshold") -> Column:
    """Ids of sure regions that would be deleted or merged."""
    return E(f"array_distinct(flatten(transform(filter(regions, r -> r.action in ('merge', 'delete') and r.confidence >= {threshold}), r -> r.node_ids)))")


def agreement(rows: DataFrame, pred: str = "predicted", gold: str = "gold", *by: str) -> DataFrame:
    """Micro precision, recall and F1 of two id arrays."""
    hit = F.size(F.array_intersect(pred, gold))
    s = rows.groupBy(*by).agg(F.sum(hit).alias("tp"), F.sum(F.size(pred) - hit).alias("fp"), F.sum(F.size(gold) - hit).alias("fn"))
    s = s.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)).withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0))
    return s.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def scan(graphs: DataFrame, config: PruneConfig, grid: dict | None = None) -> DataFrame:
    """Each candidate of each parameter, the rest as in config: all in one job. graphs: with gold (array of ids)."""
    options = [(p, float(v)) for p, values in (grid or PRUNE_GRID).items() for v in values]
    rows = with_config(graphs, config).withColumn("_o", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(v).alias("v")) for p, v in options])))
    kinds = {f.name: "int" if f.type == "int" else "double" for f in fields(PruneConfig)}
    tuned = F.struct(*[(F.when(F.col("_o.p") == n, F.col("_o.v").cast(kinds[n])).otherwise(F.col(f"cfg.{n}")) if n in PRUNE_GRID else F.col(f"cfg.{n}")).alias(n) for n in _FIELDS])
    rows = fixed(rows.withColumn("cfg", tuned))
    return agreement(regions(rows).withColumn("predicted", predicted()), "predicted", "gold", F.col("_o.p").alias("parameter"), F.col("_o.v").alias("value"))


def calibrate(graphs: DataFrame, config: PruneConfig, rounds: int = 2) -> tuple[PruneConfig, float]:
    """Coordinate descent over the grid: a job for each parameter, the first of equals, until a round changes nothing."""
    from dataclasses import replace

    best = -1.0
    for _ in range(rounds):
        before = best
        for p, values in PRUNE_GRID.items():
            found = {r["value"]: r["f1"] for r in scan(graphs, config, {p: values}).collect()}
            v = max(values, key=lambda x: found.get(float(x), 0.0))
            if found.get(float(v), 0.0) > best:
                config, best = replace(config, **{p: v}), found[float(v)]
        if best == before:
            break
    return config, best
