import pytest
from pyspark.sql import functions as F

from ponderloom.functions import lexicon as L
from ponderloom.functions import text as T
from ponderloom.operators import agreement as A
from ponderloom.operators import graph as G


def each(spark, values, column):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, s string")
    return [r.x for r in rows.select("k", column(F.col("s")).alias("x")).orderBy("k").collect()]


SENTENCES = {
    "According to the theorem, this is true.": "Retrieve", "Calculate the sum of 3 and 4.": "Transform", "A is larger than B.": "Compare", "Check the result.": "Verify", "If x is zero, stop.": "Branch", "Wait, that was wrong.": "Backtrack",
    "根据定理可知": "Retrieve", "计算结果": "Transform", "比较两者": "Compare", "验证结果": "Verify", "如果大": "Branch", "等等，不对": "Backtrack",
    "No need to check this.": "Transform", "This was not checked yet.": "Transform", "x = 5": "Transform", "Is it so?": "Backtrack", "Perhaps.": "Backtrack", "The sky is blue.": "Transform",
    "We verified it.": "Verify", "Substituting gives two.": "Transform", "Checking again.": "Verify",
}


def test_rule_types(spark):
    assert each(spark, SENTENCES, T.rule_type) == list(SENTENCES.values())


def test_detail(spark):
    a, b, c = each(spark, ["Check it.", "No need to check.", "The sky."], T.rule_detail)
    assert (a.type, a.confidence, a.fallback) == ("Verify", 1.0, False) and (b.type, b.confidence, b.fallback) == ("Transform", 0.3, True) and (c.confidence, c.fallback) == (0.2, True)


def test_lexicon_size_and_forms():
    assert {k: len(v) for k, v in L.KEYWORDS.items()} == {"Retrieve": 24, "Transform": 20, "Compare": 19, "Verify": 26, "Branch": 18, "Backtrack": 24}
    assert L.forms("calculate") == ["calculate", "calculates", "calculated", "calculating"] and "verified" in L.forms("verify") and L.forms("make sure") is None and L.forms("验证") is None


def test_splitting(spark):
    got = each(spark, ["One. Two! three? Four\n\nFive\r\nsix", "", "   ", "计算。验证！好", None], T.split_sentences)
    assert got == [["One.", "Two! three?", "Four", "Five", "six"], [], [], ["计算。", "验证！", "好"], None]


@pytest.mark.parametrize(("n", "kind"), [(1, "Retrieve"), (5, "Retrieve"), (6, "Transform"), (12, "Transform"), (13, "Verify"), (20, "Verify"), (21, "Backtrack")])
def test_length_types(spark, n, kind):
    assert each(spark, [" ".join(["w"] * n)], T.length_type) == [kind]


def test_parsers(spark):
    a, b = each(spark, ["step one #### 42", "no mark"], T.parse_gsm8k)
    assert (a.cot, a.answer, b.cot, b.answer) == ("step one", "42", "no mark", "")
    a, b, c = each(spark, ["We get \\text{x} this \\boxed{7} end", "So the answer is 12.", "nothing"], T.parse_math)
    assert (a.cot, a.answer) == ("We get this", "7") and (b.cot, b.answer) == ("So", "12") and (c.cot, c.answer) == ("nothing", "")
    assert each(spark, ["a #### 1", "\\boxed{1}", "x"], T.sniff) == ["gsm8k", "math", "plain"]
    assert each(spark, ["1,234 and -5.5", "none"], T.last_number) == [-5.5, None]


def test_rule_graph(spark):
    r = G.extract_rules(spark.createDataFrame([("t", "Retrieve x=3. Transform: x*2=6. Verify: 6 is even."), ("e", "")], "trace_id string, cot_text string")).orderBy(F.desc("trace_id")).collect()
    assert [(n.id, n.type, n.text) for n in r[0].nodes] == [(1, "Transform", "Retrieve x=3. Transform: x*2=6."), (2, "Verify", "Verify: 6 is even.")]
    assert [tuple(e) for e in r[0].edges] == [(1, 2)] and [tuple(n.span) for n in r[0].nodes] == [(0, 31), (32, 50)] and r[1].nodes == [] and r[1].edges == []


def test_length_spans(spark):
    r = G.extract_by_length(spark.createDataFrame([("t", "Abcd.\nEfghij.")], "trace_id string, cot_text string")).first()
    assert [tuple(n.span) for n in r.nodes] == [(0, 5), (6, 13)]


def test_branch_edges(spark):
    r = G.extract_rules(spark.createDataFrame([("t", "If a is one, go. Check it. Wait, no. Compare both.")], "trace_id string, cot_text string")).first()
    assert [tuple(e) for e in r.edges] == [(1, 2), (1, 3), (2, 3), (3, 4)]


def test_scores(spark):
    rows = spark.createDataFrame([("Maybe it is 3 + 4", "Verify", None), ("Check", "Verify", "Check"), ("it is new stuff here", "Transform", "Other words before")], "t string, k string, p string")
    got = rows.select(T.calibration_score(F.col("t"), F.col("k")).alias("c"), T.reward_score(F.col("t"), F.col("p")).alias("r")).collect()
    assert [round(x.c, 6) for x in got] == [1.0, 0.86, 1.0] and [round(x.r, 6) for x in got] == [0.72, 0.35, 0.68]


def test_jaccard(spark):
    r = spark.createDataFrame([("a b C", "c b"), ("", "x")], "a string, b string").select(T.token_jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [x.j for x in r] == [pytest.approx(2 / 3), 0.0]


def test_granularity_and_alignment(spark):
    rows = spark.createDataFrame([("RT", "RTV"), ("", ""), ("RTV", "RTV"), ("RTV", "RTTV")], "a string, b string")
    got = rows.select(A.granularity("a", "b").alias("g"), A.align("a", "b").alias("z")).collect()
    assert [round(x.g, 6) for x in got] == [0.493879, 0.0, 1.0, round(0.75 * 2.718281828**-0.3, 6)]
    assert ["".join(s) for s in got[3].z] in (["RT-V", "RTTV"], ["R-TV", "RTTV"])


def test_published_scores(spark):
    """Mean scores that the original publishes for the rule extractor and the length baseline."""
    from ponderloom import corpora

    gold = corpora.gold(spark)
    assert A.gcs(gold).agg(F.avg("gcs")).first()[0] == pytest.approx(0.9727645737343781)
    assert A.gcs(gold, T.length_type, whole=True).agg(F.avg("gcs")).first()[0] == pytest.approx(0.09915170426698265)


def test_published_validation(spark, sf):
    from ponderloom.plans.stats_q import synthetic_validation

    got = {r.extractor: (r.accuracy, r.edge_f1, r.viable) for r in synthetic_validation(spark, sf).collect()}
    assert got["rbe"] == (pytest.approx(0.7574074074074074), pytest.approx(0.7252525252525253), True)
    assert got["rbe_rand"][0] == pytest.approx(0.346, abs=1e-3) and got["rbe_rand"][1] == pytest.approx(0.722, abs=1e-3)
