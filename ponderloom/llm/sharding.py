"""Sharding by sampled splitters: near-equal bytes, equal texts in one shard.

Records are ordered by the hash of their text. Groups (rows of equal texts) that fill more than 1/RANGES of a shard are counted exactly, by bytes;
there are shards * RANGES of them at most. They are put whole, the largest first, into the shard with the least bytes so far; a
group is split, by rows, only where it would take its shard to more than 1 + SPARE times its share. All other rows fill up what the shards have left:
size-weighted samples of the key give quantile boundaries for RANGES ranges a shard, ranges that turn out overfull are sampled
again and subdivided, exact bytes of the ranges (a few thousand rows) give each group its place in the order without a global sort,
and the place in bytes gives the shard.

Only (id, size, checksum, hashes, a row number) are shuffled, by range; texts are not. Rows of a large group are numbered in parts of about PART_ROWS
by the hash of that row number, so that wholly equal rows are spread as well. Samples: SAMPLES at most are expected on the driver, whatever the input's size.

Defined results: a null text has size 1 and checksum 0, a null id is an id like others. Rows that are wholly equal are interchangeable, but each has a slot.
Texts of any length are one record. An empty table gives an empty table. Other columns are left behind.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RANGES = 64
SAMPLES = 16_384
OVERFULL = 2.0
ROUNDS = 3
SPARE = 0.05
PART_ROWS = 100_000


def _place_of(splitters: list[int]):
    """A column function: how many splitters are at or below the key."""
    keys = np.array(splitters, np.int64)

    @F.pandas_udf("int")
    def place_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(keys, k.to_numpy(), "right").astype(np.int32))

    return place_of


def _draw(rows: DataFrame, per_byte: float, seed: int) -> list[tuple[int, float]]:
    """A sample in which a row's chance grows with its size: (key, bytes that it stands for)."""
    chance = F.least(F.lit(1.0), F.col("size") * per_byte)
    u = (F.xxhash64("k2", "k1", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    got = rows.withColumn("p", chance).where(u < F.col("p")).select("k1", (F.col("size") / F.col("p")).alias("w")).collect()
    return sorted((r.k1, r.w) for r in got)


def _quantiles(sample: list[tuple[int, float]], step: float) -> list[int]:
    """Keys at each step of bytes."""
    out, at, goal = [], 0.0, step
    for k1, w in sample:
        at += w
        if at >= goal:
            out.append(k1)
            goal = at + step
    return sorted(set(out))


def deal(groups: list[tuple[int, int, int]], shards: int, total: int) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """groups: (key, bytes, rows). For each shard its (key, first row, rows) and its bytes. Groups stay whole where that holds the law."""
    share = total / shards
    load = [(0, k) for k in range(shards)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(shards)]
    for key, size, rows in sorted(groups, key=lambda g: (-g[1], g[0])):
        each, row = size // rows, 0  # equal texts have one size
        while row < rows:
            had, k = heapq.heappop(load)
            fits = rows - row
            if had + fits * each > share * (1 + SPARE):
                fits = min(fits, max(1, round((share - had) / each)))
            out[k].append((key, row, fits))
            heapq.heappush(load, (had + fits * each, k))
            row += fits
    return out, [b for b, _ in sorted(load, key=lambda x: x[1])]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col), F.lit(7)).alias("k2"), F.monotonically_increasing_id().alias("number"),
    )
    rows = cut(rows)  # narrow rows, read a few times below; their numbers are fixed here
    total = rows.agg(F.sum("size")).first()[0] or 0
    step = max(1.0, total / (shards * RANGES))
    large = rows.groupBy("k1").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(F.col("bytes") > step).collect()  # shards * RANGES rows at most
    dealt, load = deal([(r["k1"], r["bytes"], r["n"]) for r in large], shards, total)
    groups = spark.createDataFrame([(r["k1"], 1 + r["n"] // PART_ROWS) for r in large], "k1 long, parts long")

    # Small groups: ranges of the key, and the bytes that the shards have left.
    small = rows.join(F.broadcast(groups), "k1", "left_anti")
    left = [max(0.0, total / shards - b) for b in load]
    inside = total - sum(load)
    splitters = _quantiles(_draw(small, SAMPLES / total, 0), step) if inside else []
    for k in range(1, ROUNDS + 1):
        placed = small.withColumn("range", _place_of(splitters)("k1"))
        found = {r["range"]: r for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        over = [g for g, r in found.items() if r["bytes"] > OVERFULL * step and r["n"] > 1]
        more = _quantiles(_draw(placed.where(F.col("range").isin(over)), 16 / step, k), step) if over and k < ROUNDS else []
        if not set(more) - set(splitters):
            break
        splitters = sorted({*splitters, *more})
    starts, at, n = [], 0, 0
    for g in sorted(found):
        starts.append((g, at, n))
        at, n = at + found[g]["bytes"], n + found[g]["n"]
    offsets = spark.createDataFrame(starts, "range int, range_bytes long, range_rows long")
    order, group = Window.partitionBy("range").orderBy("k1", "k2", "number"), Window.partitionBy("range", "k1")
    placed = placed.join(F.broadcast(offsets), "range").withColumn("row", F.col("range_rows") + F.row_number().over(order) - 1)
    placed = placed.withColumn("end", F.col("range_bytes") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    middle = (F.min(F.col("end") - F.col("size")).over(group) + F.max("end").over(group)) / 2
    ends = np.cumsum(left) * (inside / max(1.0, sum(left)))
    place = F.aggregate(F.array(*[F.lit(float(e)) for e in ends[:-1]]).cast("array<double>"), F.lit(0), lambda a, e: a + (F.col("middle") >= e).cast("int"))
    placed = cut(placed.withColumn("middle", middle).select("id", "size", "crc", "row", place.alias("shard")))
    first = {r["shard"]: r for r in placed.groupBy("shard").agg(F.min("row").alias("first"), F.count("*").alias("n")).collect()}  # a row for each shard
    firsts = spark.createDataFrame([(k, r["first"]) for k, r in first.items()], "shard int, first long")
    out = placed.join(F.broadcast(firsts), "shard").select("id", "size", "crc", "shard", (F.col("row") - F.col("first")).alias("slot"))

    if large:
        # Large groups: a row's number in its group is that in its part plus the rows of the parts before.
        pieces = []
        for k in range(shards):
            slot = first[k]["n"] if k in first else 0
            for key, row, n in dealt[k]:
                pieces.append((key, row, n, k, slot))
                slot += n
        pieces = spark.createDataFrame(pieces, "k1 long, piece_row long, piece_rows long, shard int, piece_slot long")  # large groups and shards add up to its rows
        held = rows.join(F.broadcast(groups), "k1").withColumn("part", F.pmod(F.xxhash64("number", F.lit(9)), F.col("parts")))
        before = held.groupBy("k1", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("k1").orderBy("part")) - F.col("n"))
        held = held.withColumn("at", F.row_number().over(Window.partitionBy("k1", "part").orderBy("k2", "number")) - 1)
        held = held.join(before.select("k1", "part", "before"), ["k1", "part"]).withColumn("at", F.col("at") + F.col("before"))
        held = held.join(F.broadcast(pieces), (held["k1"] == pieces["k1"]) & (F.col("at") >= F.col("piece_row")) & (F.col("at") < F.col("piece_row") + F.col("piece_rows")))
        out = out.unionByName(held.select("id", "size", "crc", "shard", (F.col("piece_slot") + F.col("at") - F.col("piece_row")).alias("slot")))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
