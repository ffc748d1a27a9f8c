"""The decision on agreement over orders: from type sequences, with what the texts themselves give."""

import math
import random
import tempfile

from pyspark.sql import functions as F

from ponderloom.functions import text as T
from ponderloom.operators import agreement as A
from ponderloom.operators import extractors as XT
from ponderloom.operators import graph as G
from ponderloom.operators import similarity as S
from ponderloom.plans import composed_q as CQ
from ponderloom.plans import fixtures as X
from ponderloom.plans import stats_q as SQ
from ponderloom.schema import TEMPLATES

#: What extractors tell apart: conditions, cases, else, segments of a sentence, sentences of two marks, no sentence at all.
SPOKEN = (
    "If x is positive, add it.", "Compare both sums.", "If x is negative, drop it.", "Case one is even, then add two.", "Case two is odd.", "Otherwise compute the rest.", "Calculate the sum.", "Simplify the fraction.",
    "Verify the result.", "Check the total again.", "Wait, this was wrong.", "Recall the definition; calculate the area, then verify it.", "Compute it. Verify it.", "计算 结果是十二。", "",
)


def test_codes_of_sentences_are_those_of_texts(spark):
    """Sentences classified once give each text's three graphs."""
    rng = random.Random(11)
    says = [[k] for k in range(len(SPOKEN))] + [[rng.randrange(len(SPOKEN)) for _ in range(rng.randrange(9))] for _ in range(150)]
    parts = sorted(XT.sentence_parts(spark.createDataFrame(list(enumerate(SPOKEN)), "k int, sentence string")).collect())
    got = {int(r.w): {x.extractor: x.codes for x in r.g} for r in XT.extract_codes(spark.createDataFrame(list(enumerate(says)), "w long, says array<int>"), parts).collect()}
    texts = spark.createDataFrame([(i, " ".join(SPOKEN[k] for k in s)) for i, s in enumerate(says)], "trace_id long, cot_text string")
    want = {}
    for r in CQ._three(spark, texts).withColumn("codes", G.type_codes()).collect():
        want.setdefault(r.trace_id, {})[r.extractor] = r.codes
        assert [tuple(e) for e in r.edges] == [(n.id, n.id + k) for n in r.nodes for k in ((1, 2) if n.type == "Branch" else (1,)) if n.id + k <= len(r.nodes)]
    assert got == want


def test_templates_stay_apart(spark):
    """Any two templates that are joined are cut again where they were joined, and nowhere else."""
    pairs = spark.createDataFrame([(f"{a} {b}", [a, b]) for a in TEMPLATES for b in TEMPLATES], "t string, both array<string>")
    assert pairs.where(T.split_sentences(F.col("t")) != F.col("both")).count() == 0


def test_decision_of_codes_is_that_of_texts(spark, sf):
    """The query's row is that of all orders' texts, one by one; an order without a key counts for neither, a line without a part says nothing."""
    lines = X.table(spark, sf, "lineitem").where("l_orderkey < 120").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    odd = spark.createDataFrame([(None, 1, 3, 1, 1.0), (-1, 1, None, 1, 1.0), (-2, 1, None, 1, 1.0), (-2, 2, 16, 1, 1.0), (-3, 1, 5, 1, 1.0)], lines.schema)
    with tempfile.TemporaryDirectory() as d:
        lines.unionByName(odd).write.parquet(f"{d}/lineitem.parquet")
        got, want = SQ.iaa_decision(spark, d).first(), A.decision(CQ._three(spark, X.order_cots(spark, d))).first()
    assert got.decisions == want.decisions and all(math.isclose(got[c], want[c], abs_tol=1e-12) for c in ("graph_level", "motif_level", "structure_level", "length_correlation", "syntax_correlation"))


def test_decision_describes_type_sequences_not_texts(spark, sf):
    """Neither texts nor labels of traces are shuffled: a class of equal sequences is described once, and both uses of the pairs have one shuffle."""
    df = SQ.iaa_decision(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "cot_text" not in plan and TEMPLATES[0] not in plan
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_agreement_of_pairs_at_once(spark):
    """Kappa and cosine of a batch are those of the pair alone: empty sequences, all lengths, one long pair."""
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("RTCVBK") for _ in range(n))
    rows = [(i, draw(rng.randrange(12)), draw(rng.randrange(12))) for i in range(300)] + [(300, draw(400), draw(390)), (301, "", ""), (302, "TTT", "TTT"), (303, "RT", "RT")]
    df = spark.createDataFrame(rows, "i int, x string, y string").withColumn("a", F.expr("filter(split(x, ''), v -> v <> '')")).withColumn("b", F.expr("filter(split(y, ''), v -> v <> '')")).coalesce(1)
    got = df.select("i", A._agreed("x", "y", F.expr("transform(a, v -> xxhash64(v))"), F.expr("transform(b, v -> xxhash64(v))")).alias("z")).select("i", "z.*")
    want = df.withColumn("z", A.align("x", "y")).select("i", A._codes_kappa("z").alias("k"), S.label_cosine("a", "b").alias("c"))
    for r in got.join(want, "i").collect():
        assert (r.kappa is None) == (r.k is None) and (r.k is None or math.isclose(r.kappa, r.k, abs_tol=1e-12)) and math.isclose(r.s, r.c, abs_tol=1e-12), r


def test_neighbours_of_branching_graphs(spark):
    """Labels with the neighbours known are those by the edges."""
    rng = random.Random(7)
    codes = ["", "B", "BB", "BBB", "RB", *("".join(rng.choice("RTBK") for _ in range(rng.randrange(3, 12))) for _ in range(60))]
    rows = G.fixed(spark.createDataFrame([(c,) for c in codes], "trace_id string").withColumn("nodes", G.coded_nodes("trace_id"))).withColumn("edges", G.branching_edges())
    for r in S.wl_labels(S.wl_labels(rows).withColumnRenamed("labels", "by_edges"), near=G.branching_neighbours()).collect():
        assert r.labels == r.by_edges and len(r.labels) == 4 * len(r.trace_id)
