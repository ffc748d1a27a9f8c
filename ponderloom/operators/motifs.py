"""Motifs: induced sub-graphs of two to four nodes, found inside each graph's row.

`n_matches` is the number of distinct node sets; `present` is 1 if there is any (the counts of the original are such flags).
`n_typed` uses the second variant's exact types. Edges count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MOTIF_ORDER, MOTIFS
from .graph import fixed

E = F.expr
EPSILON = 1e-8
_OWN = ("_t", "_e", "_s", "_edge", "_chain", "_fork", "_merge", "_loop", "_pairs", "_diamond")


def _prepared(graphs: DataFrame, ids: bool = False) -> DataFrame:
    """graphs plus the places of each shape: the types of the nodes in it, or (ids) the nodes' ids, in the motif's order."""
    leaf = lambda *nodes: f"array({', '.join(nodes if ids else (f'_t[{n}]' for n in nodes))})"
    rows = graphs.withColumn("_t", E("map_from_entries(transform(nodes, n -> struct(n.id, n.type)))"))
    rows = rows.withColumn("_e", E("transform(array_distinct(edges), e -> named_struct('a', e.src, 'b', e.dst))")).withColumn("_s", E("array_distinct(transform(edges, e -> concat(e.src, '>', e.dst)))"))
    has = lambda x, y: f"array_contains(_s, concat({x}, '>', {y}))"
    none = lambda *pairs: " and ".join(f"not {has(*p)}" for p in pairs)
    rows = fixed(rows)
    rows = rows.withColumn("_edge", E(f"transform(filter(_e, e -> {none(('e.b', 'e.a'))}), e -> {leaf('e.a', 'e.b')})"))
    three = lambda link, same: f"flatten(transform(_e, e -> transform(filter(_e, f -> {link} and {same}), f -> "
    chain = three("f.a = e.b", f"f.b <> e.a and {none(('e.a', 'f.b'), ('f.b', 'e.a'), ('e.b', 'e.a'), ('f.b', 'e.b'))}") + leaf("e.a", "e.b", "f.b") + ")))"
    fork = three("f.a = e.a and e.b < f.b", none(("e.b", "f.b"), ("f.b", "e.b"), ("e.b", "e.a"), ("f.b", "e.a"))) + leaf("e.a", "e.b", "f.b") + ")))"
    merge = three("f.b = e.b and e.a < f.a", none(("e.a", "f.a"), ("f.a", "e.a"), ("e.b", "e.a"), ("e.b", "f.a"))) + leaf("e.a", "f.a", "e.b") + ")))"
    loop = three("f.a = e.b and f.b <> e.a", f"{has('f.b', 'e.a')} and {none(('e.a', 'f.b'), ('e.b', 'e.a'), ('f.b', 'e.b'))}") + leaf("e.a", "e.b", "f.b") + ")))"
    pairs = three("f.a = e.a and e.b < f.b", none(("e.b", "f.b"), ("f.b", "e.b"), ("e.b", "e.a"), ("f.b", "e.a"))) + "named_struct('a', e.a, 'b', e.b, 'c', f.b))))"
    rows = rows.withColumn("_chain", E(chain)).withColumn("_fork", E(fork)).withColumn("_merge", E(merge)).withColumn("_loop", E(loop)).withColumn("_pairs", E(pairs))
    rows = fixed(rows)
    diamond = f"""flatten(transform(_pairs, p -> transform(filter(_e, d -> d.a = p.b and d.b <> p.a and {has('p.c', 'd.b')}
        and {none(('p.a', 'd.b'), ('d.b', 'p.a'), ('d.b', 'p.b'), ('d.b', 'p.c'))}), d -> {leaf('p.a', 'p.b', 'p.c', 'd.b')})))"""
    return fixed(rows.withColumn("_diamond", E(diamond)))


def _test(types: tuple[str, ...], of: str = "x[{}]") -> str:
    return " and ".join(f"{of.format(k)} in ('{t.replace('|', chr(39) + ', ' + chr(39))}')" for k, t in enumerate(types) if t) or "true"


def _count(motif: str, variant: int) -> Column:
    shape, types = MOTIFS[motif][0], MOTIFS[motif][variant]
    return F.lit(0) if types is None else E(f"size(filter(_{shape}, x -> {_test(types)}))")


def with_counts(graphs: DataFrame) -> DataFrame:
    """graphs plus counts and typed: array<int> in MOTIF_ORDER."""
    rows = _prepared(graphs)
    rows = rows.withColumn("counts", F.array(*[_count(m, 1) for m in MOTIF_ORDER])).withColumn("typed", F.array(*[_count(m, 2) for m in MOTIF_ORDER]))
    return fixed(rows).drop(*_OWN)


def disjoint(graphs: DataFrame, motifs: tuple[str, ...] = MOTIF_ORDER, variant: int = 2) -> DataFrame:
    """(trace_id, motif_id, n_disjoint, node_sets): of each motif's node sets in ascending order, those that share no node with one taken
    before (the original's places are all one set, so it finds 1 at most). variant: 1 for the counting types, 2 for the exact ones."""
    unknown = [m for m in motifs if m not in MOTIFS]
    if unknown:
        raise ValueError(f"Unknown motif: {unknown[0]}")
    rows = _prepared(graphs, ids=True)
    none = "cast(array() as array<array<int>>)"
    sets = lambda m: f"array_sort(array_distinct(transform(filter(_{MOTIFS[m][0]}, x -> {_test(MOTIFS[m][variant], '_t[x[{}]]')}), x -> array_sort(x))))"
    greedy = lambda m: f"aggregate({sets(m)}, {none}, (acc, x) -> if(exists(acc, y -> arrays_overlap(x, y)), acc, array_append(acc, x)))"
    found = [F.struct(F.lit(m).alias("motif_id"), E(none if MOTIFS[m][variant] is None else greedy(m)).alias("node_sets")) for m in motifs]
    rows = fixed(rows.withColumn("_found", F.array(*found))).select("trace_id", F.inline("_found"))
    return rows.select("trace_id", "motif_id", F.size("node_sets").alias("n_disjoint"), "node_sets")


def counts(graphs: DataFrame) -> DataFrame:
    """(trace_id, motif_id, n_matches, present, n_typed, present_typed) for each graph and motif."""
    names = F.array(*[F.lit(m) for m in MOTIF_ORDER])
    rows = with_counts(graphs).select("trace_id", F.explode(F.arrays_zip(names.alias("m"), "counts", "typed")).alias("z"))
    return rows.select("trace_id", F.col("z.m").alias("motif_id"), F.col("z.counts").alias("n_matches"), F.least("z.counts", F.lit(1)).alias("present"), F.col("z.typed").alias("n_typed"), F.least("z.typed", F.lit(1)).alias("present_typed"))


def presence(counts: str = "counts") -> Column:
    return F.transform(counts, lambda x: F.least(x, F.lit(1)).cast("double"))


def _over_sum(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, b: a + b))


def vector(v: Column) -> Column:
    """Presence divided by its sum; equal parts where nothing is present."""
    k = len(MOTIF_ORDER)
    return F.when(F.aggregate(v, F.lit(0.0), lambda a, b: a + b) > 0, _over_sum(v)).otherwise(F.array(*[F.lit(1.0 / k)] * k))


def distribution(v: Column, epsilon: float = EPSILON) -> Column:
    return _over_sum(F.transform(v, lambda x: x + epsilon))


def document_frequency(graphs: DataFrame) -> DataFrame:
    return counts(graphs).groupBy("motif_id").agg(F.avg("present_typed").alias("frequency"), F.avg("present").alias("frequency_counted"))


def dominant(v: Column) -> Column:
    """The motif with the greatest part, the first of equals."""
    return F.get(F.array(*[F.lit(m) for m in MOTIF_ORDER]), F.array_position(v, F.array_max(v)).cast("int") - 1)


def vector_entropy(v: Column) -> Column:
    return -F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))


def discover(graphs: DataFrame, least: float = 0.05) -> DataFrame:
    """Connected induced sub-graphs of two and three nodes by types (in id order) and edges: share of the graphs that hold one."""
    rows = graphs.withColumn("_t", E("map_from_entries(transform(nodes, n -> struct(n.id, n.type)))")).withColumn("_e", F.array_distinct("edges"))
    rows = fixed(rows)
    two = "transform(_e, e -> array(least(e.src, e.dst), greatest(e.src, e.dst)))"
    three = """flatten(transform(_e, e -> transform(filter(_e, f -> size(array_distinct(array(e.src, e.dst, f.src, f.dst))) = 3),
        f -> array_sort(array_distinct(array(e.src, e.dst, f.src, f.dst))))))"""
    rows = fixed(rows.withColumn("_sets", E(f"array_distinct(concat({two}, {three}))")))
    key = """array_distinct(transform(_sets, s -> concat(array_join(transform(s, x -> _t[x]), '-'), ' ',
        array_join(array_sort(transform(filter(_e, e -> array_contains(s, e.src) and array_contains(s, e.dst)), e -> concat(array_position(s, e.src) - 1, '>', array_position(s, e.dst) - 1))), ','))))"""
    n = graphs.count()
    found = rows.select(F.explode(E(key)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n_graphs"))
    return found.withColumn("frequency", F.col("n_graphs") / F.lit(float(max(n, 1)))).where(F.col("frequency") >= least)


def discover_literal(graphs: DataFrame, least: float = 0.05) -> DataFrame:
    """The weaker variant: sub-graphs by their edges' literal ids, instances counted, kept from max(1, int(n * least)) on."""
    rows = graphs.withColumn("_e", F.array_distinct("edges"))
    three = """flatten(transform(_e, e -> transform(filter(_e, f -> size(array_distinct(array(e.src, e.dst, f.src, f.dst))) = 3),
        f -> array_sort(array_distinct(array(e.src, e.dst, f.src, f.dst))))))"""
    rows = fixed(rows.withColumn("_sets", E(f"array_distinct(concat(transform(_e, e -> array_sort(array(e.src, e.dst))), {three}))")))
    key = "transform(_sets, s -> array_join(transform(array_sort(filter(_e, e -> array_contains(s, e.src) and array_contains(s, e.dst))), e -> concat(e.src, '>', e.dst)), ','))"
    n = graphs.count()
    return rows.select(F.explode(E(key)).alias("label")).groupBy("label").agg(F.count("*").alias("n_instances")).where(F.col("n_instances") >= max(1, int(n * least)))
