"""Null models: permuted types, jump-preserving and degree-preserving rewirings; thresholds against them. Each draw has its own seed."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import fixed


def permute_types(graphs: DataFrame, k: int = 1, seed: int = 42) -> DataFrame:
    """k copies of each graph (column draw) with types dealt anew: the node at a place gets the type whose MD5 of (trace, node, draw, seed) has that rank."""
    rows = graphs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    order = F.array_sort(F.transform("nodes", lambda n: F.struct(F.md5(F.concat_ws(":", F.col("trace_id").cast("string"), n["id"].cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))).alias("h"), n["type"].alias("type"))))
    rows = fixed(rows.withColumn("_o", order))
    return rows.withColumn("nodes", F.transform("nodes", lambda n, i: n.withField("type", F.get(F.col("_o"), i)["type"]))).drop("_o")


def _reaches(out: dict, a: int, b: int) -> bool:
    todo, seen = [a], set()
    while todo:
        x = todo.pop()
        if x == b:
            return True
        if x not in seen:
            seen.add(x)
            todo += out.get(x, ())
    return False


def jump_preserving(ids: list[int], edges: list[tuple[int, int]], rng: random.Random) -> list[tuple[int, int]]:
    """In a shuffled order, each edge gets a target at the same jump from its source; then near it; then at a jump drawn from all;
    then any later node; then any. Targets that would close a cycle are left out. Parallel edges stay."""
    place = {n: i for i, n in enumerate(ids)}
    jumps = [(u, v, place[v] - place[u]) for u, v in edges]
    drawn = list(Counter(j for _, _, j in jumps).items())
    order = ids[:]
    rng.shuffle(order)
    at = {n: i for i, n in enumerate(order)}
    out: dict[int, list[int]] = {}
    made = []
    for u, _, jump in jumps:
        later = order[at[u] + 1 :]
        tiers = (
            lambda later=later, u=u, jump=jump: [n for n in later if at[n] - at[u] == jump],
            lambda later=later, u=u, jump=jump: [n for n in later if abs(at[n] - at[u] - jump) <= 2],
            lambda later=later, u=u: (lambda j: [n for n in later if at[n] - at[u] == j])(rng.choices([j for j, _ in drawn], [w for _, w in drawn])[0]),
            lambda later=later: later,
            lambda u=u: [n for n in order if n != u],
        )
        targets = next((t for t in (tier() for tier in tiers) if t), [])
        safe = [n for n in targets if not _reaches(out, n, u)] or [n for n in order if n != u and not _reaches(out, n, u)]
        if safe:
            v = rng.choice(safe)
            out.setdefault(u, []).append(v)
            made.append((u, v))
    return made


def rewired(ids: list[int], edges: list[tuple[int, int]], rng: random.Random, swaps: int = 10) -> list[tuple[int, int]]:
    """Pairs of edges swap targets, if that makes neither loop nor parallel edge nor cycle."""
    now = list(dict.fromkeys(edges))
    start = now[:]
    for _ in range(min(swaps, len(start) // 2)):
        (a, b), (c, d) = rng.sample(start, 2)
        if (a, b) not in now or (c, d) not in now or a == d or c == b or (a, d) in now or (c, b) in now:
            continue
        new = [e for e in now if e not in ((a, b), (c, d))] + [(a, d), (c, b)]
        out: dict[int, list[int]] = {}
        for u, v in new:
            out.setdefault(u, []).append(v)
        if not (_reaches(out, d, a) or _reaches(out, b, c)):
            now = new
    return now


def randomise(graphs: DataFrame, method: str, k: int = 1, seed: int = 42) -> DataFrame:
    """(trace_id, draw, nodes, edges): k draws of each graph by "jp_dpr" or "edge_rewire". Sequential within a graph, so Arrow batches of graphs."""
    rows = graphs.select(F.col("trace_id").cast("string").alias("trace_id"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("draw"), F.transform("nodes", lambda n: n["id"]).alias("ids"), F.transform("nodes", lambda n: n["type"]).alias("types"), "edges")
    kernel = {"jp_dpr": jump_preserving, "edge_rewire": rewired}[method]
    edge = pa.list_(pa.struct([("src", pa.int32()), ("dst", pa.int32())]))

    def run(batches):
        for b in batches:
            out = []
            for trace, draw, ids, edges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                new = kernel(ids, [(e["src"], e["dst"]) for e in edges], random.Random(f"{seed}:{trace}:{draw}"))
                out.append([{"src": u, "dst": v} for u, v in new])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(out, edge)], ["trace_id", "draw", "ids", "types", "edges"])

    got = rows.mapInArrow(run, "trace_id string, draw int, ids array<int>, types array<string>, edges array<struct<src:int,dst:int>>")
    nodes = F.zip_with("ids", "types", lambda i, t: F.struct(i.alias("id"), t.alias("type"), F.lit("").alias("text"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")).alias("span")))
    return got.select("trace_id", "draw", nodes.alias("nodes"), "edges")


def ensemble(graphs: DataFrame, k: int = 1, seed: int = 42) -> DataFrame:
    """All three null models, with a column method."""
    perm = permute_types(graphs.withColumn("trace_id", F.col("trace_id").cast("string")), k, seed).select("trace_id", "draw", "nodes", "edges", F.lit("permutation").alias("method"))
    return perm.unionByName(randomise(graphs, "jp_dpr", k, seed).withColumn("method", F.lit("jp_dpr"))).unionByName(randomise(graphs, "edge_rewire", k, seed).withColumn("method", F.lit("edge_rewire")))


def sampled_pairs(real: DataFrame, null: DataFrame, n_null: int, samples: int = 50) -> DataFrame:
    """Each real graph with about `samples` null graphs: null graphs are dealt into blocks of that size by a hash, a real graph meets one block.
    An equi-join on the block; columns get _a and _b."""
    blocks = max(1, n_null // samples)
    at = lambda seed: F.pmod(F.xxhash64("trace_id", F.lit(seed)), F.lit(blocks)).alias("_block")
    left = real.select(*[F.col(c).alias(f"{c}_a") for c in real.columns], at(1))
    return left.join(null.select(*[F.col(c).alias(f"{c}_b") for c in null.columns], at(2)), "_block").drop("_block")


def null_threshold(pairs: DataFrame, score: str = "score", level: float = 0.95) -> DataFrame:
    """The percentile of scores of real against null graphs."""
    return pairs.agg(F.percentile(score, F.lit(level)).alias("threshold"), F.count("*").alias("n"))
