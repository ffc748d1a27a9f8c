"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists of each dimension.

Vectors are dealt into blocks of some BLOCK, queries into blocks of QUERIES; each (block, query block) is one group: each block
is repeated for every block of queries, and no pair of vectors is ever a row. In a group, each dimension's list is
sorted once. For a query, lists are read from the end that its sign favours, in doubling depths; what is seen first is scored fully
(random access). The bound is the score of a vector that has the last value read in every list; reading stops when the
bound is below the k-th best score (at equality it goes on, as a tie may have the smaller id). The blocks' top k
are then ranked together.

Defined results: null vectors and those with null or non-finite parts take no part; vectors are compared with those of their own
length only. A vector that shares its id with the query is not "the query's own" row's rival: rows with the query's id are left out. Null ids
take no part. Queries that share an id are one (that with the least vector); repeated candidates count each.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
QUERIES = 4096


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id, v array<long>: floor(scale * x). Fails where that leaves 64 bits."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    whole = lambda x: F.when(F.abs(x * scale) < F.lit(2.0**63), F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a component leaves 64 bits")).cast("long"))
    return rows.select("id", F.transform("v", whole).alias("v"))


class Lists:
    """A block's vectors with a list for each dimension, in ascending order. Products are exact: in floats while they fit 53 bits, else in integers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.by = np.ascontiguousarray(np.argsort(self.x, axis=0, kind="stable").T)
        self.most = int(np.abs(self.x).max(initial=0))
        self.real = self.x.astype(np.float64) if self.most < 1 << 53 else None

    def _in_full(self, own: int, q: list[int], k: int) -> list[tuple[int, int]]:
        """As top, in numbers of any size; fails where a score of the best leaves 64 bits."""
        scored = ((-sum(a * b for a, b in zip(v, q, strict=True)), i) for i, v in zip(self.ids.tolist(), map(np.ndarray.tolist, self.x), strict=True) if i != own)
        best = [(-s, i) for s, i in heapq.nsmallest(k, scored)]
        if any(not -(1 << 63) <= s < 1 << 63 for s, _ in best):
            raise OverflowError("a score leaves 64 bits")
        return best

    def top(self, own: int, q: np.ndarray, k: int, first_depth: int = 16, step: int = 4) -> tuple[list[tuple[int, int]], int]:
        """[(score, id)] of the k best but for the rows with id own, and how many vectors were scored."""
        n = len(self.ids)
        if self.most * max(map(abs, q.tolist()), default=0) * len(q) >= 1 << 63:
            return self._in_full(own, q.tolist(), k), n
        small = self.real is not None and self.most * int(np.abs(q).max(initial=0)) * max(1, len(q)) < 1 << 53
        x, q = (self.real, q.astype(np.float64)) if small else (self.x, q)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen, mark = self.ids == own, np.zeros(n, bool)
        best_s, best_at = np.zeros(0, x.dtype), np.zeros(0, np.int64)
        depth = 0 if len(up) + len(down) else n
        while True:
            last, depth = depth, min(n, max(first_depth, depth * step))
            if last < n:
                mark[self.by[down, last:depth]] = True
                mark[self.by[up, n - depth : n - last]] = True
                at = np.flatnonzero(mark & ~seen)
            else:
                at = np.flatnonzero(~seen)
            seen[at] = True
            s = np.concatenate([best_s, x[at] @ q])
            at = np.concatenate([best_at, at])
            if len(s) > k:
                keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                s, at = s[keep], at[keep]
            keep = np.lexsort((self.ids[at], -s))[:k]
            best_s, best_at = s[keep], at[keep]
            if depth >= n or seen.all():
                break
            if len(best_s) == k:
                bound = (x[self.by[up, n - depth], up] * q[up]).sum() + (x[self.by[down, depth - 1], down] * q[down]).sum()
                if bound < best_s[-1]:
                    break
        return [(int(s), int(self.ids[a])) for s, a in zip(best_s, best_at, strict=True)], int(seen.sum())


_TOP = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _group(k: int):
    def run(table: pa.Table) -> pa.Table:
        role = table["query"].to_numpy()
        ids = table["id"].to_numpy()
        v = table["v"].combine_chunks()
        dims = table["dims"][0].as_py()
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims).astype(np.int64)
        lists = Lists(ids[~role], x[~role])
        out = [(own, i, s) for own, q in zip(ids[role].tolist(), x[role], strict=True) for s, i in lists.top(own, q, k)[0]] if len(lists.ids) else []
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], schema=_TOP)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """rows, queries: id, v array<long>. query_id, rank from 1, vec_id, score."""
    n = rows.count()
    m = queries.select("id").distinct().count()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    deal = lambda c, parts: F.pmod(F.xxhash64(c, F.lit(13)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dims = F.size("v").alias("dims")
    left = rows.select("id", "v", dims, F.lit(False).alias("query"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("b"), every(query_blocks).alias("q"))
    right = queries.groupBy("id").agg(F.min("v").alias("v")).select("id", "v", dims, F.lit(True).alias("query"), every(blocks).alias("b"), deal("id", query_blocks).alias("q"))
    best = left.unionByName(right).groupBy("b", "q", "dims").applyInArrow(_group(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
