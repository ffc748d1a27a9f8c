"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Shingles of five words weigh tf * (1 + idf). A count-min sketch (SKETCH rows of 2^SKETCH_BITS counters, over all documents) counts the
   documents of each shingle; idf is log(N / df) on a scale where it is 0 for a shingle of all N documents and 1 for those of a share of FLOOR
   of them or less, in LEVELS steps. The sketch's error is a fixed share of N, about half of FLOOR's, at any size of the input. The 1
   keeps a family of very many copies together: its common shingles are frequent, its copies' own edits are rare.
2. Each text's weighted shingles leave BANDS * ROWS consistent samples; two texts agree on one with the probability of
   their weighted Jaccard similarity. Bands of ROWS samples are bucket keys.
3. Equal texts become one node first. Nodes of a bucket whose samples agree on a share of EST or more are likely (a similarity of 0.8 falls below
   with a chance of about 1e-4). Each bucket leaves the edges of a spanning forest of its likely pairs: fewer rows than it has nodes. Their components
   are groups; no likely pair crosses two of them.
4. A group's texts meet once. There, all likely pairs that share a band and aren't in one class yet are verified by exact weighted Jaccard
   similarity, a text against all its mates in one array operation; the links that join two classes are left: again a spanning forest.
5. Buckets and groups of more than CELL nodes (groups also by PART_CHARS) are dealt into parts. Parts are worked on by themselves first; then, with what was
   joined, every two parts meet in a cell. So no task gets a large group, and every pair meets in one cell. Work in a cell grows with the square
   of the different texts that stay in different classes, rows and memory don't.
6. Components of the links are the classes. A class goes by the least id in it.

Defined results: ids are cast to long (a text that is no number fails). A row without id is compared like others; a class of such rows alone has a
null class id. Texts without words (null, empty, only marks) are near-duplicates of equal texts only. Texts of fewer than five words have one
shingle of all their words. Texts of any length are taken whole, in pieces of SPAN characters. Repeated rows are equal texts; different texts
under one id are nodes of their own, told apart by text_key. An empty table gives an empty table. Other columns are left behind.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPAN, cut, mix, releasing, shared_path, shingle_sets
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
EST = 0.55
SKETCH, SKETCH_BITS = 2, 20
FLOOR = 2.0**-10
LEVELS = 16
CELL = 4096  # nodes of a part
PART_CHARS = 16 << 20  # characters of a part's texts
STEP = 32_768  # shingles that are sampled together
_BITS = 16  # of a draw's place in the tables

_ROW = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_MULT = np.random.default_rng(2).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tables(seed: int = 1):
    """The scheme's random numbers: r and ln c of Gamma(2,1), beta uniform. Samples pick entries by bits of a hash. For the weights
    of a single occurrence (by level), ln a of every entry is worked out beforehand."""
    rng, n = np.random.default_rng(seed), 1 << _BITS
    r, ln_c, beta = (x.astype(np.float32) for x in (rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.random(n)))
    ln_w = np.log(1 + np.arange(LEVELS) / (LEVELS - 1)).astype(np.float32)[:, None]
    t = np.floor(ln_w / r + beta)
    return r, ln_c, beta, (ln_c - r * (t - beta + 1)).ravel()


_R, _LN_C, _BETA, _LN_A = _tables()


def sketch_places(u: np.ndarray) -> list[np.ndarray]:
    """A counter of each row of the sketch for each shingle."""
    return [(mix(u * m) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) for m in _ROW[:SKETCH]]


class Weigher:
    """levels: idf in steps, a row of counters after the other."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels.reshape(SKETCH, -1)

    def many(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: distinct shingles in ascending order, how often each occurs, and its idf's level."""
        sets = shingle_sets(texts, WORDS)
        if not sets:
            return []
        least, at = None, sketch_places(np.concatenate([u for u, _ in sets]))
        for row, place in zip(self.levels, at, strict=True):
            least = row[place] if least is None else np.maximum(least, row[place])  # the least count is the greatest idf
        ends = np.cumsum([len(u) for u, _ in sets])
        return [(u, tf, x) for (u, tf), x in zip(sets, np.split(least, ends[:-1]), strict=True)]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Shingles and their weights."""
        u, tf, level = self.many([text])[0]
        return u, weights(tf, level)


def weights(tf: np.ndarray, level: np.ndarray) -> np.ndarray:
    """tf * (1 + idf) in whole numbers, LEVELS - 1 to the unit: sums are exact."""
    return tf * (LEVELS - 1 + level.astype(np.int64))


def samples(sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int = BANDS * ROWS) -> np.ndarray:
    """k consistent weighted samples of each set (shingles, occurrences, levels) that isn't empty, as 32-bit hashes of (shingle, level of
    the draw): a row for each set. The sets of a call are worked on together: an array operation covers all their shingles."""
    sizes = np.array([len(x[0]) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    own = np.repeat(np.arange(len(sets)), sizes)
    u, tf, level = (np.concatenate([x[c] for x in sets]) for c in range(3))
    ln_w = np.log(weights(tf, level) / (LEVELS - 1)).astype(np.float32)
    base, several = level.astype(np.int64) << _BITS, np.flatnonzero(tf > 1)
    w_several = ln_w[several]
    out = np.zeros((len(sets), k), np.int32)
    for j in range(k):
        z = u * _MULT[j]
        z ^= z >> np.uint64(31)
        z *= _MULT[128 + j]
        z >>= np.uint64(64 - _BITS)
        at = z.view(np.int64)
        a = _LN_A[base + at]
        if len(several):
            e = at[several]
            a[several] = _LN_C[e] - _R[e] * (np.floor(w_several / _R[e] + _BETA[e]) - _BETA[e] + 1)
        found = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
        pick = np.empty(len(sets), np.int64)
        pick[own[found[::-1]]] = found[::-1]  # of equals, the first
        e = at[pick]
        t = np.floor(ln_w[pick] / _R[e] + _BETA[e])
        h = mix(u[pick] * _MULT[200] + t.astype(np.int64).astype(np.uint64) * _MULT[201])
        out[:, j] = (h >> np.uint64(33)).astype(np.int32)
    return out


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard."""
    (u, a), (v, b) = x, y
    if not len(u) or not len(v):
        return 0.0
    at = np.minimum(np.searchsorted(v, u), len(v) - 1)
    both = v[at] == u
    least = np.minimum(a[both], b[at[both]]).sum()
    return float(least / (a.sum() + b.sum() - least))


def parts_of(texts: list[str | None], span: int = SPAN):
    """(start, end) of runs of texts of about `span` characters: what is worked on together."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= span:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def idf_levels(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The idf level of each counter of the sketch, over all rows. Counts are summed by slices on the executors; the driver gets
    SKETCH * 2^SKETCH_BITS numbers (16 MB)."""
    parts, n_all = 64, SKETCH << SKETCH_BITS
    size = n_all // parts

    def count(batches):
        n, rows, seen = np.zeros(n_all, np.int64), 0, 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in parts_of(texts):
                u = [x for x, _ in shingle_sets(texts[a:b], WORDS)]
                u = np.concatenate(u) if u else np.zeros(0, np.uint64)
                rows, seen = rows + b - a, seen + len(u)
                for k, at in enumerate(sketch_places(u)):
                    np.add.at(n, at + (k << SKETCH_BITS), 1)
        if rows:
            blobs = [zlib.compress(n[k * size : (k + 1) * size].astype("<i8").tobytes(), 1) for k in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([rows] * parts, pa.int64()), pa.array([seen] * parts, pa.int64()), pa.array(blobs, pa.binary())], ["part", "rows", "seen", "n"])

    def add(batches):
        """The slices' counts, added as they come."""
        held = {}
        for batch in batches:
            for part, r, s, blob in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                total = held.setdefault(part, [0, 0, np.zeros(size, np.int64)])
                total[0], total[1] = total[0] + r, total[1] + s
                total[2] += np.frombuffer(zlib.decompress(blob), "<i8")
        for part, (r, s, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r], pa.int64()), pa.array([s], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part", "rows", "seen", "n"])

    kind = "part int, rows long, seen long, n binary"
    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(releasing(count), kind).repartition("part").mapInArrow(add, kind).collect()
    n, rows, seen = np.zeros(n_all, np.int64), 1, 0
    for r in got:
        n[r["part"] * size : (r["part"] + 1) * size], rows, seen = np.frombuffer(zlib.decompress(r["n"]), "<i8"), r["rows"], r["seen"]
    df = np.maximum(n - seen / (1 << SKETCH_BITS), max(1.0, FLOOR * rows))  # without what other shingles leave in a counter on average
    idf = np.clip(np.log(rows / np.minimum(df, rows)) / -np.log(FLOOR), 0, 1)
    return np.round(idf * (LEVELS - 1)).astype(np.uint8)


def signatures(docs: DataFrame, levels: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id, key (MD5 of the text), sig (null without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # a byte for each counter of the sketch
    schema = pa.schema([("id", pa.int64()), ("key", pa.string()), ("sig", pa.list_(pa.int32()))])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(text.cast("binary")).alias("key"), text.alias("text"))

    def run(batches):
        weigh = Weigher(shared.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sigs = [None] * len(texts)
            for a, b in parts_of(texts):
                held, size = [], 0
                for k, x in enumerate(weigh.many(texts[a:b]), a):
                    if len(x[0]):
                        held.append((k, x))
                        size += len(x[0])
                    if held and (size >= STEP or k + 1 == b):
                        for (i, _), sig in zip(held, samples([y for _, y in held]), strict=True):
                            sigs[i] = sig
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.list_(pa.int32()))], schema=schema)

    return rows.mapInArrow(releasing(run), "id long, key string, sig array<int>")


class Sets:
    """The weighted shingles of a cell's texts, in flat arrays of places in the cell's list of shingles."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.sizes = np.array([len(u) for u, _ in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        names, at = np.unique(np.concatenate([u for u, _ in sets]), return_inverse=True)
        self.at, self.w = at.astype(np.int32), np.concatenate([w for _, w in sets])
        self.total = np.add.reduceat(self.w, self.starts)  # sets aren't empty
        self.here = np.zeros(len(names), np.int64)

    def similar(self, i: int, others: np.ndarray, least: float, step: int = 1 << 20) -> np.ndarray:
        """Which of the others have a weighted Jaccard similarity of at least `least` with i."""
        own = slice(self.starts[i], self.starts[i] + self.sizes[i])
        self.here[self.at[own]] = self.w[own]
        shared, k = np.zeros(len(others), np.int64), 0
        while k < len(others):
            end = k + max(1, int(np.searchsorted(np.cumsum(self.sizes[others[k:]]), step, "right")))
            some = others[k:end]
            sizes = self.sizes[some]
            first = np.cumsum(sizes) - sizes
            places = np.repeat(self.starts[some] - first, sizes) + np.arange(sizes.sum())
            shared[k:end] = np.add.reduceat(np.minimum(self.here[self.at[places]], self.w[places]), first)
            k = end
        self.here[self.at[own]] = 0
        return shared / (self.total[i] + self.total[others] - shared) >= least


def forest(sig: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, sets: Sets | None = None, least: float = SIMILARITY, step: int = 64):
    """(i, j) of likely pairs of left and right (places in sig), one for each two classes that they join. With sets, only pairs that share a
    band and are similar. root: the class of each place at the start, as a number; changed in place."""
    same, enough = left is right, EST * sig.shape[1]
    columns = np.ascontiguousarray(sig[right].T)
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        agree = np.zeros((len(rows), len(right)), np.uint8)
        banded = np.zeros(agree.shape, bool) if sets else None
        for b in range(0, sig.shape[1], ROWS):
            both = [sig[rows, c][:, None] == columns[c] for c in range(b, b + ROWS)]
            for x in both:
                agree += x
            if sets:
                banded |= np.logical_and.reduce(both)
        fits = agree >= enough
        if sets:
            fits &= banded
        for r in range(len(rows)):
            i = rows[r]
            at = np.flatnonzero(fits[r])
            if same:
                at = at[at > k + r]
            mates = right[at]
            mates = mates[root[mates] != root[i]]
            if len(mates) and sets:
                mates = mates[sets.similar(i, mates, least)]
            if len(mates):
                found, first = np.unique(root[mates], return_index=True)
                root[np.isin(root, found)] = root[i]
                for j in mates[first]:
                    yield i, j


def _texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The nodes with their text: their representatives' rows, found by id and key, so that equal texts don't meet in one task. Stored once."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(text.cast("binary")).alias("_key"), text.alias("text"))
    rows = rows.join(nodes, F.col("id").eqNullSafe(F.col("rep")) & (F.col("_key") == F.col("key"))).select(*[c for c in nodes.columns if c != "rep"], "text")
    path = shared_path(spark, "neardup-texts")
    rows.dropDuplicates(["key"]).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _joined(rows: DataFrame, across: bool, levels=None, least: float = SIMILARITY) -> DataFrame:
    """rows: of, parts, key, root, sig, text (with levels: texts are verified). The pairs a, b of `forest`, in each part by itself or across every two."""
    part = F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part)
    if across:
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part"))
        rows = rows.where("parts > 1").withColumn("other", F.explode(others))
    else:
        rows = rows.withColumn("other", F.col("part"))
    rows = rows.select("of", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "key", "root", "sig", *(["text"] if levels is not None else []))
    shared = rows.sparkSession.sparkContext.broadcast(levels) if levels is not None else None

    def run(batches):
        weigh, out = Weigher(shared.value) if shared else None, []

        def cell(got: dict):
            """got: key -> (part, root, sig, set)."""
            names: dict = {}
            keys, held = list(got), list(got.values())
            root = np.array([names.setdefault(h[1], len(names)) for h in held])
            part = np.array([h[0] for h in held])
            if len(names) < 2 or (across and part.min() == part.max()):
                return
            low = np.flatnonzero(part == part.min())
            high = np.flatnonzero(part != part.min()) if across else low
            for i, j in forest(np.stack([h[2] for h in held]), root, low, high, Sets([h[3] for h in held]) if shared else None, least):
                out.append((min(keys[i], keys[j]), max(keys[i], keys[j])))

        def batch():
            got = list(zip(*out, strict=True)) or [[], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(got[0], pa.string()), pa.array(got[1], pa.string())], ["a", "b"])

        held, at = {}, None
        for b in batches:
            sigs = b.column(6).flatten().to_numpy().reshape(b.num_rows, -1)
            texts = b.column(7).to_pylist() if shared else [""] * b.num_rows
            columns = [b.column(c).to_pylist() for c in range(6)]
            for start, end in parts_of(texts):
                sets = [(u, weights(tf, level)) for u, tf, level in weigh.many(texts[start:end])] if shared else [None] * (end - start)
                for k, (of, x, y, part, key, root) in enumerate(zip(*(c[start:end] for c in columns), strict=True)):
                    if (of, x, y) != at:
                        if len(held) > 1:
                            cell(held)
                        held, at = {}, (of, x, y)
                        if len(out) >= 8192:
                            yield batch()
                    held[key] = part, root, sigs[start + k], sets[k]
        if len(held) > 1:
            cell(held)
        yield batch()

    return rows.repartition("of", "x", "y").sortWithinPartitions("of", "x", "y").mapInArrow(releasing(run), "a string, b string")


def _links(rows: DataFrame, **how) -> DataFrame:
    """rows: of, parts, key, sig, text. All pairs that join classes: inside of parts, then across them."""
    rows = rows.withColumn("root", F.col("key"))
    links = cut(_joined(rows, False, **how).distinct())
    if not rows.where("parts > 1").isEmpty():
        rooted = rows.drop("root").join(components(links).toDF("key", "_root"), "key", "left").withColumn("root", F.coalesce("_root", "key"))
        links = cut(links.union(_joined(rooted, True, **how).distinct()))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """id_col, class_id (least id of the class), class_size (rows), text_key (MD5 of the row's text), class_key (that of one text with the class's id)."""
    levels = idf_levels(docs, text_col)
    sigs = cut(signatures(docs, levels, id_col, text_col))
    nodes = cut(sigs.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig")))
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * ROWS + k] for k in range(ROWS)]) for b in range(BANDS)])
    members = nodes.where("sig is not null").select("key", F.explode(bands).alias("of"))
    # Only buckets with company: counted before they are joined.
    company = members.groupBy("of").agg(F.count("*").alias("c")).where("c > 1").select("of", F.ceil(F.col("c") / CELL).cast("int").alias("parts"))
    members = cut(members.join(company, "of"))
    grouped = components(_links(members.join(nodes.select("key", "sig"), "key"))).toDF("key", "of")
    rows = _texts(docs, nodes.join(grouped, "key").select("key", "rep", "sig", "of"), id_col, text_col)
    sizes = rows.groupBy("of").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum(F.length("text")) / PART_CHARS)).cast("int").alias("parts"))
    roots = components(_links(rows.join(sizes, "of"), levels=levels, least=least))
    named = nodes.select("key", "rep", "n").join(roots.toDF("key", "root"), "key", "left").select("key", "rep", "n", F.coalesce("root", "key").alias("root"))
    first = F.min(F.struct(F.col("rep").isNull(), F.col("rep").alias("rep"), F.col("key").alias("key"))).alias("first")
    classes = named.groupBy("root").agg(first, F.sum("n").alias("class_size")).select("root", F.col("first.rep").alias("class_id"), "class_size", F.col("first.key").alias("class_key"))
    by_key = named.select("key", "root").join(classes, "root").select("key", "class_id", "class_size", "class_key")
    return sigs.select("id", "key").join(by_key, "key").select(F.col("id").alias(id_col), "class_id", "class_size", F.col("key").alias("text_key"), "class_key")
