import random
import re

import pytest

from ponderloom.llm import decontaminate as D

W = [f"{a}{b}" for a in "ka lo mi ne pu ra si to".split() for b in "bem dor fal gim".split()]


def similarity(a, b):
    def weights(words):
        n = min(5, len(words))
        out = {}
        for i in range(len(words) - n + 1):
            r = " ".join(words[i : i + n])
            out[r] = out.get(r, 0) + len(r)
        return out

    x, y = weights(a), weights(b)
    both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
    return both / (sum(x.values()) + sum(y.values()) - both)


def brute(docs, items):
    words = lambda t: re.findall(r"[^\W]+", (t or "").lower())
    out = {}
    for i, t in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            if v and w:
                s = max((similarity(w[k : k + len(v)], v) for k in range(max(1, len(w) - len(v) + 1))), default=0)
                if s >= D.SIMILARITY:
                    out[i, j] = round(s, 9)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    say = lambda n: [rng.choice(W) + str(rng.randrange(40)) for _ in range(n)]
    items = [(j, " ".join(say(n))) for j, n in enumerate((3, 4, 5, 12, 20, 20, 33, 60))]
    docs = []
    for k in range(60):
        body = say(rng.randint(0, 80))
        j, t = items[k % len(items)]
        piece = t.split()
        if k % 4 == 1 and len(piece) > 10:
            piece[rng.randrange(len(piece))] = "other"
        if k % 4 == 2:
            piece = piece[: len(piece) // 2]
        at = rng.randrange(len(body) + 1)
        if k % 4 != 3:
            body[at:at] = piece
        docs.append((k, ", ".join(body).upper() if k % 5 == 0 else " ".join(body)))
    got = D.contaminated(spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, similarity double"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == brute(docs, items)


def test_simhash_blocks_and_votes(spark):
    rows = spark.createDataFrame([([(5, 3), (-1, 1)],), ([(0, 1)],)], "runs array<struct<h:long,w:long>>").select(D.simhash("runs").alias("f")).collect()
    assert [r.f for r in rows] == [5, 0]
    total = spark.range(1).select(*[m.alias(f"m{k}") for k, m in enumerate(D.block_masks(D.RADIUS))]).first()
    bits = [m & (1 << 64) - 1 for m in total]
    assert sum(bits) == (1 << 64) - 1 and len(bits) == D.RADIUS + 1


def test_parts_of_the_benchmark_find_the_same(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    a = sorted(D.contaminated(docs, items).collect())
    monkeypatch.setattr(D, "BROADCAST_RUNS", 500)
    assert sorted(D.contaminated(docs, items).collect()) == a


def test_odd_rows(odd, no_rows, spark):
    items = spark.createDataFrame([(1, "The same text is here twice, for two ids."), (2, None), (3, ""), (None, "one"), (4, "no id here at all my friend"), (4, "no id here at all my friend")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(odd, items).collect()), key=str)
    assert got == sorted([(4, 1), (5, 1), (8, None), (None, 4)], key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(no_rows, items).collect() == [] and D.contaminated(odd, none).collect() == []


@pytest.mark.parametrize("name", ["contaminated"])
def test_native(spark, sf, name):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = getattr(D, name)(docs, items)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_texts_are_not_shuffled(spark, sf):
    """One exchange by key, of what is found; all else stays with the scan of the documents."""
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    D.contaminated(docs, items).collect()
    plan = D.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    documents = [x for x in plan.split("\n") if "Exchange hashpartitioning(id" in x]
    assert len(documents) == 1 and "SortMergeJoin" not in plan


def test_by_text_tells_documents_of_one_id_apart(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    docs = spark.createDataFrame([(3, "one two three four five six seven eight"), (3, "a clean text of some other words"), (None, "so one two three four five six seven eight")], "doc_id long, text string")
    keys = {r.text_key for r in D.contaminated(docs, items, by_text=True).collect()}
    clean = docs.selectExpr("md5(text) k", "text").where("text like 'a clean%'").first().k
    assert len(keys) == 2 and clean not in keys
