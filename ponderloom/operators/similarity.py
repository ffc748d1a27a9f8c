"""Similarity of pairs of graphs.

Equal graphs are one class: a pair of classes stands for all pairs of their members, which are counted, not expanded.
Queries meet all classes in blocks (`against`), dealt by an equi-join on the block's number; no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..schema import TYPES
from .graph import fixed, type_codes
from .metrics import level1, normalised, type_count
from .motifs import distribution, presence, vector, with_counts
from .stats import correlation

E = F.expr
BLOCKS = 32
PARTS = 4  # of the queries, where classes come in BLOCKS / PARTS parts
CELLS = 1 << 20  # products that are added up at once, but for a query's own


def classes(rows: DataFrame, *by: str, query: Column | None = None) -> DataFrame:
    """by, rep (least trace_id), n, is_query (any member is one)."""
    return rows.groupBy(*by).agg(F.min("trace_id").alias("rep"), F.count("*").alias("n"), F.max(query if query is not None else F.lit(True)).alias("is_query"))


def against(queries: DataFrame, rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Each query with each row, in blocks of rows; columns get _a (query) and _b. A block is one task's at most: the few classes would else be
    put together by their bytes, which don't tell how many pairs they make."""
    left = queries.select(*[F.col(c).alias(f"{c}_a") for c in queries.columns], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    right = rows.select(*[F.col(c).alias(f"{c}_b") for c in rows.columns], F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("_block"))
    return left.repartition(blocks, "_block").join(right.repartition(blocks, "_block"), "_block").drop("_block")


# Measures on columns


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def norm(x) -> Column:
    return F.sqrt(dot(x, x))


def jensen_shannon(p, q) -> Column:
    """Distance (square root of the divergence in bits) of two distributions."""
    def kl(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    return F.sqrt(F.greatest((kl(p, q) + kl(q, p)) / 2, F.lit(0.0)))


def motif_similarity(p, q) -> Column:
    return 1 - F.coalesce(F.nanvl(jensen_shannon(p, q), F.lit(0.0)), F.lit(0.0))


def feature_similarity(x, y) -> Column:
    """1 - Euclidean distance / sqrt(7), of scaled first-level features."""
    d = F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    return 1 - d / F.sqrt(F.lit(7.0))


def type_vector(nodes: str = "nodes") -> Column:
    return F.array(*[type_count(t, nodes).cast("double") for t in TYPES])


def type_jsd(x, y) -> Column:
    """Square root of the natural divergence of two type counts, with 1e-10 in sums and logarithms. Sums and shares are bound once."""

    def shared(v, made) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda s, b: s + b) + 1e-10
        return once(total, lambda t: once(F.transform(v, lambda a: a / t), made))

    def kl(a, b) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * F.log((p + 1e-10) / ((p + q) / 2 + 1e-10))), F.lit(0.0), lambda s, v: s + v)

    return shared(x, lambda p: shared(y, lambda q: F.sqrt(F.greatest((kl(p, q) + kl(q, p)) / 2, F.lit(0.0)))))


def _ratio(a, b) -> Column:
    return F.least(a, b) / F.greatest(a, b, F.lit(1))


def edit_similarity_sets(s: str = "a", t: str = "b") -> Column:
    """Mean of the Jaccard similarity of type sets, the ratio of sizes and the ratio of edges."""
    x, y = F.col(f"kinds_{s}"), F.col(f"kinds_{t}")
    kinds = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return (kinds + _ratio(F.col(f"size_{s}"), F.col(f"size_{t}")) + _ratio(F.col(f"links_{s}"), F.col(f"links_{t}"))) / 3


def edit_similarity(s: str = "a", t: str = "b") -> Column:
    """Mean of 1 - type divergence, the ratio of sizes and the closeness of densities; 1 for two empty graphs, 0 for one."""
    n1, n2, m1, m2 = (F.col(f"{c}_{k}") for c in ("size", "links") for k in (s, t))
    d1, d2 = (m / F.greatest(n * (n - 1) / 2, F.lit(1.0)) for m, n in ((m1, n1), (m2, n2)))
    close = 1 - F.abs(d1 - d2) / F.greatest(d1, d2, F.lit(1e-10))
    mean = (1 - type_jsd(F.col(f"types_{s}"), F.col(f"types_{t}")) + F.least(n1, n2) / F.greatest(n1, n2, F.lit(1)) + close) / 3
    return F.when((n1 == 0) & (n2 == 0), 1.0).when((n1 == 0) | (n2 == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))


def levenshtein_similarity(x, y) -> Column:
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def described(graphs: DataFrame) -> DataFrame:
    """graphs plus types, kinds, size, links: what the edit similarities need."""
    kinds = F.array_sort(F.array_distinct(F.transform("nodes", lambda n: n["type"])))
    return graphs.withColumn("types", type_vector()).withColumn("kinds", kinds).withColumn("size", F.size("nodes")).withColumn("links", F.size(F.array_distinct("edges")))


def shaped(graphs: DataFrame) -> DataFrame:
    """graphs plus shape, a text that is equal for equal types and edges."""
    links = F.array_join(F.transform(F.array_sort(F.array_distinct("edges")), lambda e: F.concat(e["src"].cast("string"), F.lit(">"), e["dst"].cast("string"))), ",")
    return graphs.withColumn("shape", F.concat_ws("|", type_codes(), links))


# Weisfeiler-Lehman


def _beside(rows: DataFrame, out: str, ends: str) -> DataFrame:
    """rows plus out: for each node the values of ends (an array of (k, v)) whose k is the node's id. Nodes and ends are sorted together, so that a
    node's values follow it: work grows with their number, not with nodes times ends."""
    rows = fixed(rows.withColumn("_s", E(f"sort_array(concat(transform(nodes, (n, i) -> named_struct('k', n.id, 'm', 0, 'v', i)), transform({ends}, e -> named_struct('k', e.k, 'm', 1, 'v', e.v))))")))
    rows = fixed(rows.withColumn("_k", E("filter(transform(_s, (x, i) -> if(x.m = 0, i, null)), i -> i is not null)")))
    after = "coalesce(get(_k, j + 1), size(_s)) - 1"
    own = f"if({after} > k, filter(transform(sequence(k + 1, {after}), i -> get(_s, i)), x -> x.k = get(_s, k).k), cast(array() as array<struct<k:int,m:int,v:int>>))"
    found = f"transform(_k, (k, j) -> named_struct('at', get(_s, k).v, 'l', transform({own}, x -> x.v)))"
    return fixed(rows.withColumn(out, E(f"transform(sort_array({found}), x -> x.l)")).drop("_s", "_k"))


def _neighbours(rows: DataFrame, out: str, ends: str) -> DataFrame:
    """rows plus out: for each node the places (from 0) of its neighbours; ends: (k, v) of node ids, those of no node are left out."""
    rows = _beside(rows, "_to", f"transform({ends}, e -> named_struct('k', e.v, 'v', e.k))")
    rows = fixed(rows.withColumn("_to", E("flatten(transform(_to, (l, i) -> transform(l, k -> named_struct('k', k, 'v', i))))")))
    return _beside(rows, out, "_to").drop("_to")


def wl_labels(graphs: DataFrame, rounds: int = 3, directed: bool = True, near: tuple[Column, Column] | None = None) -> DataFrame:
    """graphs plus labels: array<string> of all rounds. directed: rounds + 1 label sets, in- and out-neighbours sorted apart;
    else `rounds` sets over neighbours. Labels after the first round are MD5 of what they stand for. near: each node's in- and out-neighbours
    (places from 0), where they are known without the edges; for directed labels."""
    rows = fixed(graphs.withColumn("_l", E("transform(nodes, n -> n.type)")).withColumn("_e", F.array_distinct("edges")))
    rows = rows.withColumn("labels", F.col("_l"))
    sorts = lambda near: f"sort_array(transform(get({near}, i), j -> get(_l, j)))"
    if directed and near:
        rows = fixed(rows.withColumn("_in", near[0]).withColumn("_out", near[1]))
    elif directed:
        rows = _neighbours(rows, "_in", "transform(_e, e -> named_struct('k', e.dst, 'v', e.src))")
        rows = _neighbours(rows, "_out", "transform(_e, e -> named_struct('k', e.src, 'v', e.dst))")
    if directed:
        said = f"array_join(concat({sorts('_in')}, {sorts('_out')}), ',')"
    else:
        both = "array_distinct(flatten(transform(_e, e -> array(named_struct('k', e.src, 'v', e.dst), named_struct('k', e.dst, 'v', e.src)))))"
        rows = _neighbours(rows, "_in", both)
        said = f"array_join({sorts('_in')}, '|')"
    for _ in range(rounds if directed else rounds - 1):
        rows = fixed(rows.withColumn("_l", E(f"transform(_l, (x, i) -> md5(concat(x, '|', {said})))")))
        rows = rows.withColumn("labels", E("concat(labels, _l)"))
    return fixed(rows.drop("_l", "_e", "_in", "_out"))


def label_cosine(x: str, y: str) -> Column:
    """Cosine of the label counts of two arrays of labels; 0 where one is empty."""
    times = lambda labels, a, b: f"aggregate({labels}, 0.0D, (s, l) -> s + size(filter({a}, v -> v = l)) * size(filter({b}, v -> v = l)))"
    own = lambda v: times(f"array_distinct({v})", v, v)
    return E(f"if(size({x}) = 0 or size({y}) = 0, 0.0D, {times(f'array_intersect({x}, {y})', x, y)} / sqrt({own(x)} * {own(y)}))")


def with_label_counts(rows: DataFrame) -> DataFrame:
    """rows, with labels replaced by kinds_n (counts of the first round's labels, the types), counts (map<label,count> of the others) and norm.
    Sorted labels are counted by their runs."""
    types = ", ".join(f"'{t}'" for t in TYPES)
    rows = fixed(rows.withColumn("_other", E(f"sort_array(filter(labels, v -> v not in ({types})))")).withColumn("kinds_n", E(f"transform(array({types}), t -> cast(size(filter(labels, v -> v = t)) as double))")))
    rows = fixed(rows.withColumn("_at", E("filter(transform(_other, (v, i) -> if(i = 0 or v <> get(_other, i - 1), i, null)), i -> i is not null)")))
    times = "transform(_at, (p, k) -> cast(coalesce(get(_at, k + 1), size(_other)) - p as double))"
    rows = fixed(rows.withColumn("counts", E(f"map_from_arrays(transform(_at, p -> get(_other, p)), {times})")).drop("labels", "_other", "_at"))
    return fixed(rows.withColumn("norm", E("sqrt(aggregate(concat(kinds_n, map_values(counts)), 0.0D, (s, c) -> s + c * c))")))


def shared_labels(s: str = "a", t: str = "b") -> Column:
    """Sum of the products of the label counts of a pair: 0 where it shares none. Types are multiplied place by place; of other labels a pair shares few."""
    kinds = " + ".join(f"kinds_n_{s}[{k}] * kinds_n_{t}[{k}]" for k in range(len(TYPES)))
    return E(f"aggregate(array_intersect(map_keys(counts_{s}), map_keys(counts_{t})), {kinds}, (z, l) -> z + counts_{s}[l] * counts_{t}[l])")


def wl_pairs(rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """rows: rep, is_query, labels. (rep_a, rep_b, similarity) of each query class and each class that shares a label: cosine of label counts.
    Queries in parts meet classes in parts, PARTS of them; a task holds one part of the classes as lists by label and takes queries as they come. Nothing
    is shuffled but classes, their labels as 16 bytes (MD5) each."""
    parts = min(PARTS, blocks)
    across = max(1, blocks // parts)
    c = with_label_counts(rows.select("rep", "is_query", "labels"))
    keys = "unhex(array_join(transform(map_keys(counts), l -> md5(l)), ''))"
    c = fixed(c.select("rep", "is_query", "norm", "kinds_n", E(keys).alias("keys"), E("cast(map_values(counts) as array<int>)").alias("times"), E(f"cast(pmod(xxhash64(rep), {across}) as int)").alias("_x"), E(f"cast(pmod(xxhash64(rep, 1), {parts}) as int)").alias("_y")))
    held = f"transform(sequence(0, {parts - 1}), y -> named_struct('_block', y * {across} + _x, '_asks', false))"
    asks = f"transform(sequence(0, {across - 1}), x -> named_struct('_block', _y * {across} + x, '_asks', true))"
    c = c.select(E(f"inline(if(is_query, concat({held}, {asks}), {held}))"), "rep", "norm", "kinds_n", "keys", "times")
    dealt = c.repartition(parts * across, "_block").sortWithinPartitions("_block", "_asks")
    most = CELLS

    def multiplied(batches):
        import numpy as np
        import pyarrow as pa

        def read(batch):
            """Reps, norms, counts of types; the row, label and count of each label of a row."""
            keys = [k or b"" for k in batch.column("keys").to_pylist()]
            labels = [k[i : i + 16] for k in keys for i in range(0, len(k), 16)]
            kinds = batch.column("kinds_n").flatten().to_numpy().reshape(len(keys), -1)
            row = np.repeat(np.arange(len(keys)), [len(k) // 16 for k in keys])
            return batch.column("rep"), batch.column("norm").to_numpy(), kinds, row, labels, batch.column("times").flatten().to_numpy().astype("float64")

        def lists(held):
            """The classes of a part: names, norms, kinds, and by label its number, first place, rows and counts."""
            rep, norm, kinds, row, labels, times = read(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            number: dict[bytes, int] = {}
            at = np.array([number.setdefault(x, len(number)) for x in labels], "int64")
            order = np.argsort(at, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(number)))]).astype("int64")
            return rep, norm, kinds, number, first, row[order], times[order]

        def answered(batch, part):
            rep, norm, kinds, number, first, who, many = part
            rep_a, norm_a, kinds_a, row, labels, times = read(batch)
            at = np.array([number.get(x, -1) for x in labels], "int64")
            row, at, times = row[at >= 0], at[at >= 0], times[at >= 0]
            found = first[at + 1] - first[at]
            work = np.cumsum(np.bincount(row, weights=found, minlength=len(rep_a)) + len(rep))
            cuts = [0, *(np.flatnonzero(np.diff(work // most)) + 1).tolist(), len(rep_a)]
            for lo, hi in zip(cuts, cuts[1:]):
                s, e = np.searchsorted(row, [lo, hi])
                n = found[s:e]
                each = np.repeat(np.arange(s, e), n)
                place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + first[at[each]]
                d = np.bincount((row[each] - lo) * len(rep) + who[place], weights=times[each] * many[place], minlength=(hi - lo) * len(rep))
                d = d + (kinds_a[lo:hi] @ kinds.T).ravel()
                pairs = np.flatnonzero(d)
                a, b = pairs // len(rep) + lo, pairs % len(rep)
                yield pa.RecordBatch.from_arrays([rep_a.take(pa.array(a)), rep.take(pa.array(b)), pa.array(d[pairs] / (norm_a[a] * norm[b]))], ["rep_a", "rep_b", "similarity"])

        block, held, part = None, [], None
        for batch in batches:
            dealt, asks = batch.column("_block").to_numpy(), batch.column("_asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(dealt) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(dealt)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if dealt[lo] != block:
                    block, held, part = dealt[lo], [], None
                if not asks[lo]:
                    held.append(batch.slice(lo, hi - lo))
                elif held:
                    part = part or lists(held)
                    yield from answered(batch.slice(lo, hi - lo), part)

    kind = dict(rows.dtypes)["rep"]
    return dealt.mapInArrow(multiplied, f"rep_a {kind}, rep_b {kind}, similarity double")


# Topology similarity


def tsi_rows(graphs: DataFrame, *keep: str, smooth: bool = True) -> DataFrame:
    """trace_id, motif (distribution of presence; unsmoothed for matrices), feat (scaled first-level features)."""
    rows = with_counts(graphs).select("*", presence().alias("_p"))
    rows = fixed(rows.withColumn("motif", distribution(F.col("_p")) if smooth else vector(F.col("_p"))))
    feats = level1(rows, "motif", *keep)
    return feats.select("trace_id", *keep, "motif", normalised(feats).alias("feat"))


def tsi(alpha: float = 0.75) -> Column:
    return alpha * motif_similarity(F.col("motif_a"), F.col("motif_b")) + (1 - alpha) * feature_similarity(F.col("feat_a"), F.col("feat_b"))


def diversity(graphs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Over all pairs of graphs: mean TSI, and the share of pairs above the threshold. Pairs of classes carry their members' number."""
    rows = tsi_rows(graphs, smooth=False)
    c = classes(rows, "motif", "feat").select("rep", "n", "motif", "feat")
    pairs = against(c, c).where("rep_a < rep_b").select((F.col("n_a") * F.col("n_b")).alias("w"), tsi().alias("tsi"))
    own = c.where("n > 1").select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("w"), F.lit(1.0).alias("tsi"))
    return pairs.unionByName(own).agg(
        F.sum("w").alias("n_pairs"), (F.sum(F.col("w") * F.col("tsi")) / F.sum("w")).alias("diversity"), (F.sum(F.when(F.col("tsi") > threshold, F.col("w")).otherwise(0)) / F.sum("w")).alias("stable_rate"),
    )


def unsupervised_pairs(rows: DataFrame) -> DataFrame:
    """rows: classes with rep, is_query, labels (undirected), types, kinds, size, links. 0.4 WL + 0.3 edit + 0.3 (1 - type divergence)."""
    rows = with_label_counts(rows)
    pairs = against(rows.where("is_query"), rows)
    pairs = fixed(pairs.withColumn("d", shared_labels()).drop("counts_a", "counts_b", "kinds_n_a", "kinds_n_b"))
    wl = F.when(F.col("d") > 0, F.col("d") / (F.col("norm_a") * F.col("norm_b"))).otherwise(0.0)
    mixed = 0.4 * wl + 0.3 * edit_similarity_sets() + 0.3 * (1 - type_jsd(F.col("types_a"), F.col("types_b")))
    return pairs.select("rep_a", "rep_b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)).alias("similarity"))


class RobustTSI:
    """Ridge regression of a target similarity on |motif difference| and |difference of two principal components of features|."""

    def __init__(self, alpha: float = 1.0, components: int = 2):
        self.alpha, self.components = alpha, components

    def fit(self, pairs: DataFrame, target: str) -> RobustTSI:
        """pairs: motif_a, motif_b, feat_a, feat_b, target. Moments (a small matrix) come to the driver, rows don't."""
        import numpy as np

        k = 7
        f = pairs.select(F.col("feat_a").alias("f")).unionByName(pairs.select(F.col("feat_b").alias("f")))
        x = [F.get("f", i) for i in range(k)]
        row = f.agg(F.count("*"), *[F.avg(v) for v in x], *[F.avg(x[i] * x[j]) for i in range(k) for j in range(i, k)]).first()
        mean, second = np.array(row[1 : k + 1]), np.zeros((k, k))
        for v, (i, j) in zip(row[k + 1 :], [(i, j) for i in range(k) for j in range(i, k)], strict=True):
            second[i, j] = second[j, i] = v
        cov = second - np.outer(mean, mean)
        self.scale = np.sqrt(np.maximum(np.diag(cov), 0))
        self.scale[self.scale < 1e-12] = 1.0
        _, vectors = np.linalg.eigh(cov / np.outer(self.scale, self.scale))
        self.axes = vectors[:, ::-1][:, : self.components]
        cols = self._columns()
        n = len(cols)
        y = F.col(target).cast("double")
        row = pairs.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], y.alias("y")).agg(
            F.count("*"), F.avg("y"), *[F.avg(f"x{i}") for i in range(n)], *[F.avg(F.col(f"x{i}") * F.col("y")) for i in range(n)], *[F.avg(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(n) for j in range(i, n)],
        ).first()
        m, mean_y, means, xy = row[0], row[1], np.array(row[2 : 2 + n]), np.array(row[2 + n : 2 + 2 * n])
        gram = np.zeros((n, n))
        for v, (i, j) in zip(row[2 + 2 * n :], [(i, j) for i in range(n) for j in range(i, n)], strict=True):
            gram[i, j] = gram[j, i] = v
        gram = m * (gram - np.outer(means, means))
        self.coef = np.linalg.solve(gram + self.alpha * np.eye(n), m * (xy - means * mean_y))
        self.intercept = mean_y - float(means @ self.coef)
        total = np.abs(self.coef).sum()
        self.motif_share = float(np.abs(self.coef[:12]).sum() / total) if total else 0.5
        return self

    def _columns(self) -> list[Column]:
        motif = [F.abs(F.get("motif_a", i) - F.get("motif_b", i)) for i in range(12)]
        pcs = [F.abs(sum((F.lit(float(self.axes[i, c] / self.scale[i])) * (F.get("feat_a", i) - F.get("feat_b", i)) for i in range(7)), F.lit(0.0))) for c in range(self.components)]
        return motif + pcs

    def predict(self) -> Column:
        said = sum((F.lit(float(w)) * c for w, c in zip(self.coef, self._columns(), strict=True)), F.lit(float(self.intercept)))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), said))


def compare_scores(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.agg(correlation(x, y).alias("pearson"), F.avg(F.abs(F.col(x) - F.col(y))).alias("mean_abs_diff"), F.avg((F.abs(F.col(x) - F.col(y)) < 0.1).cast("double")).alias("within_tenth"))
