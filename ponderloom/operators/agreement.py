"""Agreement of raters and extractors, arbitration, calibration against gold sentences, ground-truth validation, extractor ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.text import once, rule_type
from ..schema import CODES, MOTIF_ORDER
from .graph import branching_edges, branching_neighbours, coded_nodes, extract_by_length, extract_rules, fixed, type_codes
from .motifs import presence, vector, with_counts
from .similarity import described, edit_similarity, label_cosine, levenshtein_similarity, wl_labels
from .stats import poisson

# Raters: (item, rater, category)


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """kappa over the categories seen. Raters rate all items. 1 with fewer than two raters or categories, or with full chance agreement."""
    each = ratings.groupBy("item", "category").agg(F.count("*").alias("c"))
    item = each.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    obs = item.agg(F.avg(F.when(F.col("m") > 1, (F.col("ss") - F.col("m")) / (F.col("m") * (F.col("m") - 1)))).alias("p_bar"), F.sum("m").alias("total"), F.max("m").alias("m"))
    cats = each.groupBy("category").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("cc"), F.count("*").alias("k"))
    both = obs.join(F.broadcast(cats), F.lit(True))  # one row each
    p_e = F.col("cc") / (F.col("total") * F.col("total"))
    one = (F.col("m") < 2) | (F.col("k") <= 1) | (F.abs(p_e - 1) < 1e-9)
    return both.select(F.when(one, 1.0).otherwise((F.col("p_bar") - p_e) / (1 - p_e)).alias("kappa"), F.col("p_bar").alias("observed"), p_e.alias("expected"))


def fleiss_bootstrap(ratings: DataFrame, categories: tuple = tuple(range(6)), draws: int = 1000, seed: int = 42) -> DataFrame:
    """kappa, low, high: kappa over given categories and its 95 % interval. Items are drawn by Poisson weights from their own keys."""
    count = lambda c: F.sum(F.when(F.col("category") == F.lit(c), 1).otherwise(0))
    item = ratings.groupBy("item").agg(F.count("*").alias("m"), *[count(c).alias(f"_{k}") for k, c in enumerate(categories)])
    cols = [F.col(f"_{k}") for k in range(len(categories))]
    agreed = F.when(F.col("m") > 1, (sum((c * c for c in cols), F.lit(0)) - F.col("m")) / (F.col("m") * (F.col("m") - 1)))
    rows = fixed(item.select("item", "m", agreed.alias("p"), *[c.alias(f"_{k}") for k, c in enumerate(cols)]))

    def kappa(w):
        e = sum((F.pow(F.sum(w * c) / F.sum(w * F.col("m")), F.lit(2.0)) for c in cols), F.lit(0.0))
        return F.when(e >= 1, 1.0).otherwise((F.sum(w * F.col("p")) / F.sum(F.when(F.col("p").isNotNull(), w)) - e) / (1 - e)).alias("kappa")

    drawn = poisson(rows, draws, seed, "item").groupBy("b").agg(kappa(F.col("w")))
    ci = drawn.agg(F.percentile("kappa", F.lit(0.025)).alias("low"), F.percentile("kappa", F.lit(0.975)).alias("high"))
    return rows.agg(kappa(F.lit(1))).join(F.broadcast(ci), F.lit(True))  # one row each


def cohens_kappa(ratings: DataFrame) -> DataFrame:
    """kappa of each pair of raters, by an equi-join on the item."""
    a, b = ratings.toDF("item", "rater_a", "x"), ratings.toDF("item", "rater_b", "y")
    pairs = a.join(b, "item").where("rater_a < rater_b")
    cells = pairs.groupBy("rater_a", "rater_b", "x", "y").agg(F.count("*").alias("c"))
    total = cells.groupBy("rater_a", "rater_b").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    rows = cells.groupBy("rater_a", "rater_b", F.col("x").alias("k")).agg(F.sum("c").alias("r"))
    cols = cells.groupBy("rater_a", "rater_b", F.col("y").alias("k")).agg(F.sum("c").alias("s"))
    chance = rows.join(cols, ["rater_a", "rater_b", "k"]).groupBy("rater_a", "rater_b").agg(F.sum(F.col("r") * F.col("s")).alias("rs"))
    out = total.join(chance, ["rater_a", "rater_b"], "left").withColumn("p_e", F.coalesce("rs", F.lit(0)) / (F.col("n") * F.col("n")))
    return out.select("rater_a", "rater_b", F.when(F.col("p_e") >= 1, 1.0).otherwise((F.col("same") / F.col("n") - F.col("p_e")) / (1 - F.col("p_e"))).alias("kappa"))


def reliability(kappa: Column) -> Column:
    """Band of a kappa."""
    return F.when(kappa >= 0.81, "excellent").when(kappa >= 0.61, "good").when(kappa >= 0.41, "moderate").when(kappa >= 0.21, "fair").otherwise("poor")


def binary_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Two raters' booleans with pooled marginals."""
    s = rows.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("rate"), (F.sum(F.col(a).cast("int")) + F.sum(F.col(b).cast("int"))).alias("yes"))
    p = F.col("yes") / (2 * F.col("n"))
    p_e = p * p + (1 - p) * (1 - p)
    return s.select(F.when((F.col("n") == 0) | (F.abs(p_e - 1) < 1e-9), 1.0).otherwise((F.col("rate") - p_e) / (1 - p_e)).alias("kappa"), F.coalesce("rate", F.lit(1.0)).alias("agreement_rate"))


def arbitrate(traces: DataFrame, first: DataFrame, second: DataFrame, tiebreak: DataFrame) -> DataFrame:
    """trace_id, resolution, label. Judgements: (trace_id, judgement); a missing one counts as true, a missing tie-break leaves the case ambiguous."""
    rows = traces.select("trace_id").join(first.toDF("trace_id", "j1"), "trace_id", "left").join(second.toDF("trace_id", "j2"), "trace_id", "left").join(tiebreak.toDF("trace_id", "t"), "trace_id", "left")
    a, b = F.coalesce("j1", F.lit(True)), F.coalesce("j2", F.lit(True))
    same = F.when(a, "unanimous_pass").otherwise("unanimous_fail")
    said = F.when(a == b, same).when(F.col("t").isNull(), "ambiguous").when(F.col("t"), "arbitrated_pass").otherwise("arbitrated_fail")
    return rows.select("trace_id", a.alias("judgement_1"), b.alias("judgement_2"), said.alias("resolution"), F.when(F.endswith(said, F.lit("_pass")), True).when(F.endswith(said, F.lit("_fail")), False).alias("label"))


# Extractors: wide graphs with a column `extractor`


def extractor_pairs(graphs: DataFrame, *cols: str) -> DataFrame:
    """The graphs of one trace by two extractors (a < b), with cols of each."""
    a = graphs.select("trace_id", F.col("extractor").alias("extractor_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = graphs.select("trace_id", F.col("extractor").alias("extractor_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, "trace_id").where("extractor_a < extractor_b")


def graph_agreement(graphs: DataFrame) -> DataFrame:
    """Mean similarity of type sequences, and that over chance of one in six as kappa."""
    pairs = extractor_pairs(graphs.withColumn("codes", type_codes()), "codes")
    mean = pairs.agg(F.coalesce(F.avg(levenshtein_similarity(F.col("codes_a"), F.col("codes_b"))), F.lit(0.0)).alias("mean_similarity"))
    return mean.select(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("mean_similarity") - 1 / 6) / (5 / 6))).alias("kappa"), "mean_similarity")


def motif_agreement(graphs: DataFrame) -> DataFrame:
    """Pearson correlation of the extractors' mean motif vectors, averaged over pairs that vary."""
    rows = with_counts(graphs).select("extractor", F.posexplode(presence("typed")).alias("m", "p"))
    mean = rows.groupBy("extractor", "m").agg(F.avg("p").alias("v"))
    pairs = mean.toDF("a", "m", "x").join(mean.toDF("b", "m", "y"), "m").where("a < b").groupBy("a", "b").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return pairs.agg(F.coalesce(F.avg(F.expr("c / nullif(sx * sy, 0.0D)")), F.lit(0.0)).alias("mean_pearson_r"))


def structure_agreement(graphs: DataFrame) -> DataFrame:
    pairs = extractor_pairs(described(graphs), "types", "size", "links")
    return pairs.agg(F.coalesce(F.avg(edit_similarity()), F.lit(0.0)).alias("mean_ged_similarity"))


def _codes_kappa(z) -> Column:
    """Kappa of two aligned sequences over the positions where neither has a gap; null with fewer than three of those."""
    both = F.filter(F.arrays_zip(F.get(z, 0).alias("a"), F.get(z, 1).alias("b")), lambda x: (x["a"] != "-") & (x["b"] != "-"))

    def made(rows) -> Column:
        n = F.size(rows)
        same = F.size(F.filter(rows, lambda x: x["a"] == x["b"])) / n
        share = lambda c: (F.size(F.filter(rows, lambda x: x["a"] == c)) + F.size(F.filter(rows, lambda x: x["b"] == c))) / (2 * n)
        chance = sum((share(c) * share(c) for c in CODES.values()), F.lit(0.0))
        return F.when(n >= 3, once(chance, lambda e: F.when(F.abs(e - 1) < 1e-9, 1.0).otherwise((same - e) / (1 - e))))

    return once(both, made)


def aligned_agreement(graphs: DataFrame) -> DataFrame:
    """(extractor_a, extractor_b, kappa, n): mean kappa of the aligned type sequences of a trace, of each pair of extractors, and how many
    traces have one. Each pair is aligned by itself (the original stretches one reference over all of them)."""
    pairs = extractor_pairs(graphs.withColumn("codes", type_codes()), "codes").withColumn("z", align("codes_a", "codes_b"))
    return fixed(pairs).withColumn("kappa", _codes_kappa("z")).groupBy("extractor_a", "extractor_b").agg(F.coalesce(F.avg("kappa"), F.lit(0.0)).alias("kappa"), F.count("kappa").alias("n"))


def dimension_agreement(graphs: DataFrame) -> DataFrame:
    """(extractor_a, extractor_b, r): the correlation over traces of each motif's weight, averaged over the motifs that vary in both."""
    rows = fixed(fixed(with_counts(graphs).withColumn("_p", presence())).withColumn("w", vector(F.col("_p"))))
    each = extractor_pairs(rows, "w").select("extractor_a", "extractor_b", F.posexplode(F.arrays_zip(F.col("w_a").alias("x"), F.col("w_b").alias("y"))).alias("m", "z"))
    by = each.groupBy("extractor_a", "extractor_b", "m").agg(F.covar_pop("z.x", "z.y").alias("c"), F.stddev_pop("z.x").alias("sx"), F.stddev_pop("z.y").alias("sy"))
    varies = (F.col("sx") > 1e-8) & (F.col("sy") > 1e-8)
    return by.groupBy("extractor_a", "extractor_b").agg(F.coalesce(F.avg(F.when(varies, F.col("c") / (F.col("sx") * F.col("sy")))), F.lit(0.0)).alias("r"))


def kernel_agreement(graphs: DataFrame, rounds: int = 3) -> DataFrame:
    """(extractor_a, extractor_b, similarity): mean kernel of refined labels of a trace's two graphs, within the row."""
    pairs = fixed(extractor_pairs(wl_labels(graphs, rounds), "labels"))
    return pairs.groupBy("extractor_a", "extractor_b").agg(F.avg(label_cosine("labels_a", "labels_b")).alias("similarity"))


@F.arrow_udf(StructType([StructField("kappa", DoubleType()), StructField("s", DoubleType())]))
def _agreed(x, y, a, b):
    """kappa: that of two type sequences (letters), aligned as align does, over the positions where neither has a gap; null with fewer than three of
    those. s: cosine of the counts of two lists of labels (numbers); 0 where one is empty. All rows of a batch at once."""
    import numpy as np
    import pyarrow as pa

    def kappas(x, y):
        """x, y: letters in rows, 0 where a sequence has ended."""
        n, lx, ly = len(x), (x > 0).sum(1), (y > 0).sum(1)
        across = np.arange(y.shape[1] + 1, dtype=np.int32)
        d = np.empty((x.shape[1] + 1, n, len(across)), np.int32)
        d[0] = across
        for i in range(1, len(d)):
            step = d[i - 1] + 1
            step[:, 1:] = np.minimum(step[:, 1:], d[i - 1][:, :-1] + (x[:, i - 1, None] != y))
            d[i] = np.minimum.accumulate(step - across, axis=1) + across
        i, j, at = lx.copy(), ly.copy(), np.arange(n)
        both, same, seen = np.zeros(n), np.zeros(n), np.zeros((n, 256))
        while len(at := at[(i[at] > 0) | (j[at] > 0)]):
            p, q = i[at], j[at]
            here, inside = d[p, at, q], (p > 0) & (q > 0)
            u, v = x[at, p - 1], y[at, q - 1]
            along = inside & (here == d[p - 1, at, q - 1] + (u != v))
            up = ~along & (p > 0) & (here == d[p - 1, at, q] + 1)
            k, u, v = at[along], u[along], v[along]
            both[k] += 1
            same[k] += u == v
            seen[k, u] += 1
            seen[k, v] += 1
            i[at] -= along | up
            j[at] -= ~up
        some = np.maximum(both, 1)
        chance = sum(((seen[:, ord(c)] / (2 * some)) ** 2 for c in CODES.values()), np.zeros(n))
        sure = np.abs(chance - 1) < 1e-9
        return np.where(both >= 3, np.where(sure, 1.0, (same / some - chance) / np.where(sure, 1.0, 1 - chance)), np.nan)

    def letters(column):
        rows = np.array(column.fill_null("").to_pylist(), dtype="S")
        return rows.view(np.uint8).reshape(len(rows), rows.itemsize), np.char.str_len(rows)

    def counted(rows, labels):
        """Each row's labels, as numbers of row and label, and how often it has them."""
        return np.unique(rows * len(known) + labels, return_counts=True)

    n, kappa = len(x), np.empty(len(x))
    (x, lx), (y, ly) = letters(x), letters(y)
    order, begin = np.lexsort((ly, lx)), 0
    while begin < n:  # sequences of like lengths together, some 4 million cells at once
        rows = order[begin : begin + 4096]
        cells = np.arange(1, len(rows) + 1) * (lx[rows] + 1) * (np.maximum.accumulate(ly[rows]) + 1)
        rows = rows[: max(1, int((cells <= 1 << 22).sum()))]
        kappa[rows] = kappas(x[rows, : max(1, lx[rows].max())], y[rows, : max(1, ly[rows].max())])
        begin += len(rows)
    sizes = [np.diff(c.offsets.to_numpy()) for c in (a, b)]
    known, number = np.unique(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in (a, b)]), return_inverse=True)
    (ka, ca), (kb, cb) = (counted(np.repeat(np.arange(n), k), part) for k, part in zip(sizes, np.split(number, [sizes[0].sum()]), strict=True))
    shared, at_a, at_b = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    added = lambda keys, values: np.bincount(keys // max(1, len(known)), values, n)
    own = added(ka, ca * ca) * added(kb, cb * cb)
    s = added(shared, ca[at_a] * cb[at_b]) / np.sqrt(np.where(own > 0, own, 1))
    return pa.StructArray.from_arrays([pa.array(kappa, mask=np.isnan(kappa)), pa.array(s)], ["kappa", "s"])


def _described(graphs: DataFrame, *keep: str, near: tuple[Column, Column] | None = None) -> DataFrame:
    """keep, codes, p (a digit for each motif: 1 where it is present), labels (as 64 bits each)."""
    rows = fixed(with_counts(wl_labels(graphs, near=near)))
    return fixed(rows.select(*keep, type_codes().alias("codes"), F.array_join(F.transform("counts", lambda c: F.when(c > 0, "1").otherwise("0")), "").alias("p"), F.transform("labels", lambda x: F.xxhash64(x)).alias("labels")))


def _paired(rows: DataFrame, *cols: str) -> DataFrame:
    """rows: w, g (an array of structs with extractor and cols). A row for each pair of extractors (a < b): w, extractor_a, cols with _a, and so for b."""
    pairs = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: x["extractor"] < y["extractor"]), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return rows.select("w", F.inline(pairs)).select("w", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("extractor", *cols)])


def _compared(graphs: DataFrame, weight: str | None) -> DataFrame:
    """_summed of graphs. Each graph is described once; a trace's graphs come together in one row. weight: as many traces have this one's graphs."""
    rows = graphs.where("trace_id is not null").withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
    rows = _described(rows, "trace_id", "extractor", "_w").groupBy("trace_id").agg(F.collect_list(F.struct("extractor", "_w", "codes", "p", "labels")).alias("g"))
    return _summed(_paired(rows.withColumn("w", F.lit(None)), "_w", "codes", "p", "labels").withColumn("w", F.col("_w_a")))


def compared_codes(traces: DataFrame) -> DataFrame:
    """_summed of graphs that follow from their types (branching_edges). traces: w, g (an array of extractor and codes, a letter for each node). Equal
    sequences are one class, described once; a pair of classes of two extractors is compared once and counts as often as it occurs."""
    by = ["extractor_a", "extractor_b", "codes_a", "codes_b"]
    pairs = _paired(traces, "codes").where("codes_a is not null and codes_b is not null").groupBy(*by).agg(F.sum("w").alias("w"))
    # The condition on w is always true: with it both uses of pairs have the same shuffle, which then is done once.
    codes = fixed(pairs.where("w > 0")).select(F.explode(F.array("codes_a", "codes_b")).alias("codes")).distinct()
    codes = codes.repartition(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # short texts, but work: else they come in few tasks
    classes = fixed(fixed(codes.withColumn("nodes", coded_nodes("codes"))).withColumn("edges", branching_edges()))
    classes = _described(classes.select(F.col("codes").alias("key"), "nodes", "edges"), "key", near=branching_neighbours())
    side = lambda s: classes.select(F.col("key").alias(f"codes_{s}"), F.col("p").alias(f"p_{s}"), F.col("labels").alias(f"labels_{s}"))
    return _summed(fixed(pairs.where("w > 0")).join(side("a"), "codes_a").join(side("b"), "codes_b"))


def _summed(pairs: DataFrame) -> DataFrame:
    """A row for each pair of extractors (a < b): kappa, r and similarity as aligned_agreement, dimension_agreement and kernel_agreement have
    them (null without any). pairs: w, and of each side extractor, codes, p and labels."""
    by = ["extractor_a", "extractor_b"]
    pairs = fixed(pairs.select(*by, "p_a", "p_b", F.col("w").cast("double").alias("w"), _agreed("codes_a", "codes_b", "labels_a", "labels_b").alias("z"))).select(*by, "p_a", "p_b", "w", "z.*")
    total = lambda c: F.sum(F.col("w") * F.col(c))
    few = fixed(pairs.groupBy(*by, "p_a", "p_b").agg(F.sum("w").alias("w"), total("kappa").alias("k"), F.sum(F.when(F.col("kappa").isNotNull(), F.col("w"))).alias("wk"), total("s").alias("s")))
    digits = lambda p: F.transform(F.sequence(F.lit(1), F.lit(len(MOTIF_ORDER))), lambda m: F.substr(F.col(p), m, F.lit(1)).cast("double"))
    few = fixed(few.withColumn("p_a", digits("p_a")).withColumn("p_b", digits("p_b")))
    few = fixed(few.withColumn("v_a", vector(F.col("p_a"))).withColumn("v_b", vector(F.col("p_b"))))
    # Weights of motifs by their moments: a motif that has one value throughout is left out, as one without deviation.
    moments = []
    for m in range(len(MOTIF_ORDER)):
        x, y = F.get("v_a", m), F.get("v_b", m)
        mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
        sd = lambda c: F.when(F.min(c) < F.max(c), F.sqrt(F.greatest(mean(c * c) - mean(c) * mean(c), F.lit(0.0)))).otherwise(0.0)  # noqa: E731, B023
        moments.append(F.struct((mean(x * y) - mean(x) * mean(y)).alias("c"), sd(x).alias("sx"), sd(y).alias("sy")))
    out = fixed(few.groupBy(*by).agg((F.sum("k") / F.sum("wk")).alias("kappa"), (F.sum("s") / F.sum("w")).alias("similarity"), F.array(*moments).alias("m")))
    r = F.transform(F.filter("m", lambda m: (m["sx"] > 1e-8) & (m["sy"] > 1e-8)), lambda m: m["c"] / (m["sx"] * m["sy"]))
    out = fixed(out.withColumn("m", r))
    return out.select(*by, "kappa", "similarity", F.when(F.size("m") > 0, F.aggregate("m", F.lit(0.0), lambda a, b: a + b) / F.size("m")).alias("r"))


def decision(graphs: DataFrame, length: str = "rbe_rand", syntax: str = "sbe", rules: tuple[str, ...] = ("rbe", "human"), weight: str | None = None) -> DataFrame:
    """decided, of graphs. weight: a column that says for how many traces a trace stands."""
    return decided(_compared(graphs, weight), length, syntax, rules)


def decided(compared: DataFrame, length: str = "rbe_rand", syntax: str = "sbe", rules: tuple[str, ...] = ("rbe", "human")) -> DataFrame:
    """One row: the three levels of agreement (means over pairs), the greatest correlation of a model's motifs with the length baseline's and with
    the syntax extractor's, the decisions, and whether to go on. Models are the extractors that are neither of these nor of rules."""
    model = lambda c: ~F.col(c).isin(length, syntax, *rules)
    r = F.coalesce("r", F.lit(0.0))
    against = lambda name: F.coalesce(F.greatest(F.lit(0.0), F.max(F.when(((F.col("extractor_a") == name) & model("extractor_b")) | ((F.col("extractor_b") == name) & model("extractor_a")), r))), F.lit(0.0))
    level = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    one = compared.agg(
        level(F.coalesce("kappa", F.lit(0.0))).alias("graph_level"), level(r).alias("motif_level"), against(length).alias("length_correlation"),
        against(syntax).alias("syntax_correlation"), level("similarity").alias("structure_level"),
    )
    g, m = F.col("graph_level"), F.col("motif_level")
    first = F.when((g > 0.6) & (m > 0.6), "proceed_high").when((g >= 0.4) | (m >= 0.4), "proceed_caveat").otherwise("terminate")
    flags = [F.when(F.col("length_correlation") > 0.3, "flag_length"), F.when(F.col("syntax_correlation") > 0.7, "flag_syntax")]
    return one.withColumn("decisions", F.array_compact(F.array(first, *flags))).withColumn("proceed", first != "terminate")


def sequence_bias(graphs: DataFrame, baseline: DataFrame, threshold: float = 0.3) -> DataFrame:
    """How much each extractor's type sequences resemble a baseline's; over the threshold is a bias. (0.7 for syntax artefacts.)"""
    rows = graphs.select("trace_id", "extractor", type_codes().alias("x")).join(baseline.select("trace_id", type_codes().alias("y")), "trace_id")
    mean = rows.groupBy("extractor").agg(F.avg(levenshtein_similarity(F.col("x"), F.col("y"))).alias("mean_similarity"))
    return mean.withColumn("detected", F.col("mean_similarity") > threshold)


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def align(a, b):
    """Two type sequences (letters) aligned with gaps "-": the diagonal first, then a gap in b, then one in a."""
    import pandas as pd

    def one(x: str, y: str) -> list[list[str]]:
        d = [[i + j if not i or not j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i, p in enumerate(x, 1):
            for j, q in enumerate(y, 1):
                d[i][j] = min(d[i - 1][j - 1] + (p != q), d[i - 1][j] + 1, d[i][j - 1] + 1)
        out, i, j = [], len(x), len(y)
        while i or j:
            if i and j and d[i][j] == d[i - 1][j - 1] + (x[i - 1] != y[j - 1]):
                i, j = i - 1, j - 1
                out.append((x[i], y[j]))
            elif i and d[i][j] == d[i - 1][j] + 1:
                i -= 1
                out.append((x[i], "-"))
            else:
                j -= 1
                out.append(("-", y[j]))
        return [[p for p, _ in reversed(out)], [q for _, q in reversed(out)]]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


# Gold sentences


@F.pandas_udf(DoubleType())
def granularity(a, b):
    """Longest common subsequence over the longer length, less for a difference of lengths. Sequences as letters."""
    import math

    import pandas as pd

    def one(x: str, y: str) -> float:
        row = [0] * (len(y) + 1)
        for p in x:
            before = 0
            for j, q in enumerate(y, 1):
                row[j], before = before + 1 if p == q else max(row[j], row[j - 1]), row[j]
        return row[-1] / max(len(x), len(y), 1) * math.exp(-0.3 * abs(len(x) - len(y)))

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


#: Where a sentence of several operations is cut, tried in this order.
TRANSITIONS = (
    r",\s+(?:and\s+|or\s+)?(?=(?:calculate|comput(?:e|ing)|check(?:ing)?|verify(?:ing)?|compare|recall|derive|solve|simplify|substitut(?:e|ing)|evaluat(?:e|ing)|assume|suppose|confirm(?:ing)?|check(?:ing)?)\b)",
    r",\s*(?:then|and then|thus|therefore)\b", r";\s*(?=(?:then|otherwise|else)\b)", r"\bthen\s", r"\band then\s", r"\bnow\s",
    r"，\s*(?:(?:然后)|(?:计算)|(?:验证)|(?:检查)|(?:比较)|(?:回忆)|(?:计算)|(?:求解)|(?:推导)|(?:代入))",
    r"。\s*(?:然后|接着|再)\s", r"\.\.\.+",
    r",\s+the\s+(?=(?:derivative|result|value|integral|limit|gradient|function|expression|equation|solution|answer|sum|product|coefficient)\b)",
    r"\.\s+(?=(?:calculate|compute|check|verify|compare|recall|derive|solve|simplify|substitute|evaluate|assume|suppose|confirm|apply)\b)",
    r"\.\s+(?=(?:Then|Next|Finally|Now|First|Second|Third)\b)", r"\.\s+(?=[A-Z])", r";\s*",
)


def split_operations(sentence: str) -> list[str]:
    """Segments of a sentence: at the first transition that occurs, each side again; kept if two or more are longer than three characters."""
    cuts = [re.compile(p) for p in TRANSITIONS]
    todo, out = [sentence.strip()], []
    while todo:
        s = todo.pop()
        found = next((m for m in (c.search(s) for c in cuts) if m), None) if len(s) >= 4 else None
        if found:
            todo += [s[found.end() :].strip(), s[: found.start()].strip()]
        elif s:
            out.append(s)
    kept = [s for s in out if len(s) > 3]
    return kept if len(kept) >= 2 else [sentence]


segments = F.pandas_udf(lambda texts: texts.map(split_operations), ArrayType(StringType()))
#: The segments of a list of sentences, one after the other.
all_segments = F.pandas_udf(lambda lists: lists.map(lambda xs: [p for x in xs for p in split_operations(x)], na_action="ignore"), ArrayType(StringType()))


def operation_codes(types: str, parts: str) -> Column:
    """Letters of the operations of a sentence from the types and texts of its segments: implied operations are put in, repeated
    conditions become Transform, runs that mean one operation are merged. Folds over the segments, in order."""
    code = "element_at(map(" + ", ".join(f"'{t}', '{c}'" for t, c in CODES.items()) + "), t)"
    z = f"transform(arrays_zip({types}, {parts}), z -> named_struct('c', transform(array(z.{types}), t -> {code})[0], 's', z.{parts}, 'low', lower(ltrim(z.{parts}))))"
    first = lambda xs, test: f"coalesce(array_min(transform(filter(transform({xs}, (x, i) -> named_struct('x', x, 'i', i)), y -> {test}), y -> y.i)), -1)"
    put = lambda xs, at, c: f"if({at} < 0, {xs}, concat(slice({xs}, 1, {at}), array(named_struct('c', '{c}', 's', {xs}[{at}].s, 'low', {xs}[{at}].low)), slice({xs}, {at} + 1, size({xs}))))"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    cond = "(startswith({s}, 'if ') or startswith({s}, 'when ') or startswith({s}, 'whether '))"
    a = let("xs", z, let("k", first("xs", "y.x.c = 'V' and y.x.s rlike '\\\\b[Vv]erify\\\\s+that\\\\b'"), put("xs", "k", "T")))
    b = let("xa", a, let("k2", first("xa", "y.x.c = 'T' and contains(y.x.low, 'reconsider')"), put("xa", "k2", "R")))
    # Rule A looks at two refined neighbours, rule B at a case before.
    ra = f"aggregate(xb, cast(array() as array<struct<c:string,s:string,low:string>>), (acc, x) -> array_append(acc, named_struct('c', if(size(acc) >= 2 and x.c = 'B' and element_at(acc, -1).c <> 'B' and acc[size(acc) - 2].c = 'B' and {cond.format(s='x.low')}, 'T', x.c), 's', x.s, 'low', x.low)))"
    rb = "aggregate(xc, named_struct('seen', false, 'out', cast(array() as array<struct<c:string,s:string,low:string>>)), (acc, x) -> named_struct('seen', acc.seen or (x.c = 'B' and startswith(x.low, 'case ')), 'out', array_append(acc.out, named_struct('c', if(acc.seen and x.c = 'B' and startswith(x.low, 'case '), 'T', x.c), 's', x.s, 'low', x.low)))).out"
    keep = f"(startswith(x.low, 'otherwise') or startswith(x.low, 'else') or startswith(x.low, 'case ') or {cond.format(s='x.low')})"
    merged = f"aggregate(xd, '', (acc, x) -> if(x.c = 'T' and right(acc, 1) = 'T' and not {keep}, acc, concat(acc, x.c)))"
    all_of = let("xb", b, let("xc", ra, let("xd", rb, merged)))
    return F.regexp_replace(F.regexp_replace(F.expr(all_of), "V+", "V"), "K+", "K")


def adapted(rows: DataFrame, sentence_col: str = "sentence", classify=rule_type) -> DataFrame:
    """rows plus codes: the operations that an extractor (a Column function) finds in each sentence."""
    s = fixed(rows.withColumn("_parts", segments(F.col(sentence_col))))
    s = fixed(s.withColumn("_types", F.transform("_parts", lambda s: classify(s))))
    return fixed(s.withColumn("codes", operation_codes("_types", "_parts")).drop("_parts", "_types"))


def gcs(corpus: DataFrame, classify=rule_type, whole: bool = False) -> DataFrame:
    """corpus: id, sentence, gold (letters), category. plus codes, gcs. whole: one operation for each sentence, without the adapter."""
    if whole:
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), classify(F.col("sentence")))
        return fixed(corpus.withColumn("codes", kind)).withColumn("gcs", granularity("codes", "gold"))
    return adapted(corpus, "sentence", classify).withColumn("gcs", granularity("codes", "gold"))


def gcs_summary(scored: DataFrame, draws: int = 2000, seed: int = 42) -> DataFrame:
    from .stats import bootstrap

    s = scored.agg(F.avg("gcs").alias("mean"), F.min("gcs").alias("min"), F.stddev_pop("gcs").alias("std"), F.count("*").alias("n"))
    ci = bootstrap(scored.select(F.col("gcs").alias("value")), draws, seed)
    both = s.join(F.broadcast(ci), F.lit(True))  # one row each
    return both.withColumn("passed", (F.col("mean") >= 0.8) & (F.col("min") >= 0.6) & (F.col("low") >= 0.7))


def confusion(rows: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    return rows.groupBy(pred, gold).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """For each gold class: counts, precision, recall, F1, unreliable (F1 under 0.5 or fewer than 5 rows)."""
    c = confusion(rows, pred, gold)
    by_gold = c.groupBy(F.col(gold).alias("label")).agg(F.sum("n").alias("n_gold"), F.sum(F.when(F.col(pred) == F.col(gold), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = c.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("n_pred"))
    r = by_gold.join(by_pred, "label", "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    r = r.withColumn("precision", F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)).withColumn("recall", F.col("tp") / F.col("n_gold"))
    r = r.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    return r.withColumn("unreliable", (F.col("f1") < 0.5) | (F.col("n_gold") < 5))


# Ground truth


def ground_truth(rows: DataFrame) -> DataFrame:
    """rows: trace, true (types), pred (types), true_edges, pred_edges (text arrays). Scores of each trace."""
    hit = F.size(F.array_intersect("true_edges", "pred_edges"))
    acc = F.aggregate(F.zip_with("true", "pred", lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda a, b: a + b)
    p, r = hit / F.greatest(F.size("pred_edges"), F.lit(1)), hit / F.greatest(F.size("true_edges"), F.lit(1))
    return rows.select(
        "trace", (acc / F.greatest(F.size("true"), F.lit(1))).alias("accuracy"), (F.abs(F.size("pred") - F.size("true")) / F.greatest(F.size("true"), F.lit(1))).alias("count_error"),
        p.alias("edge_precision"), r.alias("edge_recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-8))).alias("edge_f1"),
        (F.abs(F.size("pred") - F.size("true")) + F.abs(F.size("pred_edges") - F.size("true_edges"))).alias("size_difference"), ((F.size("pred") > 0) | (F.size("true") == 0)).alias("extracted"), (F.size("true") > 0).alias("counts"),
    )


def validation_summary(scores: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("counts") & F.col("extracted"), F.col(c))), F.lit(0.0)).alias(c)
    s = scores.agg(F.count("*").alias("n_traces"), F.avg(F.col("extracted").cast("double")).alias("extraction_rate"), *[mean(c) for c in ("accuracy", "count_error", "edge_precision", "edge_recall", "edge_f1", "size_difference")])
    return s.withColumn("viable", (F.col("extraction_rate") >= 0.9) & (F.col("accuracy") >= 0.70) & (F.col("edge_f1") >= 0.50))


def rank_extractors(scores: DataFrame) -> DataFrame:
    """scores: extractor, gcp (null: none), gcp_passed, pass_rate, tsi. Weighted overall score (0.40, 0.35, 0.25; what is missing is left out), rank, pass."""
    from pyspark.sql import Window

    g = F.when(F.col("gcp_passed"), F.col("gcp")).otherwise(F.col("gcp") * 0.5)
    wg, wt = F.when(F.col("gcp").isNotNull(), 0.40).otherwise(0.0), F.when(F.coalesce("tsi", F.lit(0.0)) > 0, 0.25).otherwise(0.0)
    overall = (wg * F.coalesce(g, F.lit(0.0)) + 0.35 * F.col("pass_rate") + wt * F.coalesce("tsi", F.lit(0.0))) / (wg + 0.35 + wt)
    rows = scores.withColumn("overall", overall).withColumn("passed", (F.col("overall") >= 0.70) & (F.col("pass_rate") >= 0.60))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overall"), "extractor")))  # a row for each extractor


def extractors(spark: SparkSession, traces: DataFrame) -> DataFrame:
    """The graphs of traces by the rule extractor and by the length baseline, as one table."""
    del spark
    rules = extract_rules(traces).select("trace_id", F.lit("rbe").alias("extractor"), "nodes", "edges")
    return rules.unionByName(extract_by_length(traces).select("trace_id", F.lit("rbe_rand").alias("extractor"), "nodes", "edges"))


