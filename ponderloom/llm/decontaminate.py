"""Benchmark decontamination in DataFrame functions only: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

1. A document's runs of five words are looked up among the benchmark items' runs. A run at place p of a document and o of an
   item of L words aligns the window [p - o, p - o + L). Windows without a common run can't be similar, so this
   loses nothing; items of fewer than five words use runs of their own length. Of consecutive runs that align the same window
   with the same item only the first goes on: the run before it is not the item's run before.
2. A window's fingerprint is the 64-bit SimHash of its weighted runs (weight: letters). Windows and the items that they are aligned with
   meet on any of RADIUS + 1 blocks of bits: those within RADIUS share one, by the pigeonhole principle.
3. Pairs within RADIUS are kept when the weighted Jaccard similarity of their runs is at least SIMILARITY.

All of this happens in the tasks that scan the documents: a window is cut out of its row there, and neither texts nor words
are shuffled; only what is found is, once. The items' runs are broadcast in parts of about BROADCAST_RUNS, by a count: each
part is a scan of its own, so that a broadcast stays bounded whatever the benchmark's size (but by an item's own length).
The result has a row for each (document, item) found: id, item, similarity.

Defined results: null and empty texts and items find nothing, an empty table (of either kind) gives an empty one. Texts of any length are
taken whole. Null ids are kept. Repeated documents give equal rows once; repeated items (same id and text) once. Documents that share an id
but not the text give one row for the id and item, with the higher similarity; `by_text` tells them apart. Other columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 5
SIMILARITY = 0.8
RADIUS = 20
BROADCAST_RUNS = 200_000


def word_array(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


def once(value: Column, made) -> Column:
    """made(value), with value worked out a single time: it is bound to a lambda's variable."""
    return F.get(F.transform(F.array(value), lambda v: made(v)), F.lit(0))


def bound(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """keep and made, worked out here and once: the optimiser doesn't carry what follows (or filters on it) below a generator."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def run_hashes(words: str, size: int) -> Column:
    """A hash for each run of `size` words of an array column; sizes don't share hashes."""
    places = F.sequence(F.lit(0), F.size(words) - size)
    runs = once(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(places, lambda i: F.xxhash64(F.lit(size), *[F.get(h, i + k) for k in range(size)])))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def exploded_runs(rows: DataFrame, size: int) -> DataFrame:
    """rows (with `words`) for each run: p, h and before (the hash of the run one place before, null at the first)."""
    rows = bound(rows, *rows.columns, _runs=run_hashes("words", size))
    return rows.select("*", F.posexplode("_runs").alias("p", "h")).withColumn("before", F.get("_runs", F.col("p") - 1)).drop("_runs")


def weighted_runs(words: str) -> Column:
    """Distinct runs of a short window, array<struct<h,w>>: w is the run's letters times its count."""
    size = F.least(F.lit(RUN), F.size(words))
    each = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    weighed = lambda e: lambda r: F.struct(F.xxhash64(r).alias("h"), (F.length(r) * F.size(F.filter(e, lambda x: x == r))).cast("long").alias("w"))
    return once(each, lambda e: F.transform(F.array_distinct(e), weighed(e)))


def _bits(low: int, high: int) -> Column:
    """A mask of the bits from low to high - 1, as a signed long."""
    mask = (1 << high) - (1 << low)
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")


def simhash(runs: str) -> Column:
    """Bit j is set if the runs whose hash has it outweigh those whose hash hasn't. Weights add up to less than 2^31."""

    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    low = (1 << 32) - 1
    bit = lambda is_set, at: F.when(is_set, F.call_function("shiftleft", one, at)).otherwise(none)

    def votes(j: Column) -> Column:
        """Two sums in one fold: of the weights that have bit j (low half) and bit j + 32 (high half)."""
        return F.aggregate(runs, none, lambda a, x: a + F.call_function("shiftrightunsigned", x["h"], j).bitwiseAND(F.lit(low + 2).cast("long")) * x["w"])

    def bits(total: Column) -> Column:
        def add(said: Column, j: Column) -> Column:
            set_by = lambda v: said.bitwiseOR(bit(v.bitwiseAND(F.lit(low)) * 2 > total, j)).bitwiseOR(bit(F.shiftright(v, 32) * 2 > total, j + 32))
            return once(votes(j), set_by)

        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), none, add)

    return once(F.aggregate(runs, none, lambda a, x: a + x["w"]), bits)


def block_masks(radius: int) -> list[Column]:
    ends = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [_bits(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _blocks(fingerprint: str, radius: int) -> Column:
    """The rows of the multi-index: (number of the block, its bits)."""
    masks = block_masks(radius)
    return F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.col(fingerprint).bitwiseAND(m).alias("bits")) for k, m in enumerate(masks)]))


def weighted_jaccard(x: str, y: str) -> Column:
    none = F.lit(0).cast("long")
    shared = lambda other: F.aggregate(y, none, lambda a, r: a + F.least(r["w"], F.coalesce(F.try_element_at(other, r["h"]), none)))
    total = lambda c: F.aggregate(c, none, lambda a, r: a + r["w"])
    return once(once(F.map_from_entries(x), shared), lambda both: both / (total(x) + total(y) - both))


def _runs_of(items: DataFrame, sizes: list[int]) -> DataFrame:
    """key_of, n, o, h, item_before: a row for each run of each item. Items of fewer than RUN words have one run of all of them."""
    known = None
    for k in sizes:
        part = exploded_runs(items.where(F.col("n") >= RUN if k == RUN else F.col("n") == k).select("key_of", "n", "words"), k)
        part = part.select("key_of", "n", F.col("p").alias("o"), "h", F.col("before").alias("item_before"))
        known = part if known is None else known.unionByName(part)
    return known


def _windows(rows: DataFrame, known: DataFrame, sizes: list[int]) -> DataFrame:
    """id, key, key_of, words: a window for each stretch of runs that a document and an item have in common."""
    found = None
    for k in sizes:
        part = exploded_runs(rows, k).join(F.broadcast(known), "h").where(~F.col("before").eqNullSafe(F.col("item_before")) | F.col("before").isNull())
        start = F.greatest(F.col("p") - F.col("o"), F.lit(0))
        part = bound(part, "id", "key", "key_of", words=F.slice("words", start + 1, F.col("n")))
        found = part if found is None else found.unionByName(part)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = SIMILARITY, radius: int = RADIUS, by_text: bool = False) -> DataFrame:
    """id_col, item_col, similarity (of the most similar window). by_text: also text_key (MD5 of the text), and rows for each (id, text)."""
    items = benchmark.select(F.col(item_col).alias("item"), word_array(F.col(item_text_col).cast("string")).alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("n", F.size("words")).withColumn("key_of", F.xxhash64("item", "words"))  # an item may have no id
    # At most five numbers: how many runs there are, and which sizes of runs.
    counts = {r["k"]: r["runs"] for r in items.groupBy(F.least("n", F.lit(RUN)).alias("k")).agg(F.sum(F.greatest(F.col("n") - RUN + 1, F.lit(1))).alias("runs")).collect()}
    parts = max(1, -(-sum(counts.values()) // BROADCAST_RUNS))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).where("text is not null and text <> ''")
    rows = bound(rows.select("id", (F.md5(F.col("text").cast("binary")) if by_text else F.lit("")).alias("key"), "text"), "id", "key", words=word_array(F.col("text")))
    sizes, near = sorted(counts) or [RUN], None
    for k in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("key_of", F.lit(17)), F.lit(parts)) == k)
        found = _near(_windows(rows, _runs_of(some, sizes), sizes), some, radius)
        near = found if near is None else near.unionByName(found)
    near = near.where(F.col("similarity") >= least).groupBy("id", "key", "item").agg(F.max("similarity").alias("similarity"))
    return near.select(F.col("id").alias(id_col), *([F.col("key").alias("text_key")] if by_text else []), F.col("item").alias(item_col), "similarity")


def _near(inside: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """id, key, item, similarity of the windows and items within radius, by the blocks."""
    inside = bound(inside.where(F.size("words") > 0), "id", "key", "key_of", runs=weighted_runs("words"))
    inside = bound(inside, "id", "key", "key_of", "runs", print=simhash("runs"))
    items = bound(bound(items, "key_of", "item", item_runs=weighted_runs("words")), "key_of", "item", "item_runs", item_print=simhash("item_runs"))
    index = items.select("key_of", "item_print", _blocks("item_print", radius).alias("b")).select("key_of", "item_print", "b.block", "b.bits")
    met = inside.select("*", _blocks("print", radius).alias("b")).select("id", "key", "key_of", "runs", "print", "b.block", "b.bits").join(F.broadcast(index), ["key_of", "block", "bits"])
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(m) == 0, F.lit(k)) for k, m in enumerate(block_masks(radius))])
    met = met.where((F.bit_count(differ) <= radius) & (F.col("block") == first))  # each pair once, at its first common block
    met = met.join(F.broadcast(items.select("key_of", "item", "item_runs")), "key_of")
    return bound(met, "id", "key", "item", similarity=weighted_jaccard("runs", "item_runs"))
