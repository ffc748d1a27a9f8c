import random

import numpy as np
import pytest

from ponderloom.llm import neardup
from ponderloom.llm.components import components


def text(rng, n=200):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, k):
    words = words[:]
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
    return words


def classes(rows):
    return {r.doc_id: r.class_id for r in rows}


def brute(docs, levels):
    weigh = neardup.Weigher(levels)
    sets = {i: weigh(t) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, t in docs:
        for j, u in docs:
            if i < j and (t == u or neardup.similarity(sets[i], sets[j]) >= neardup.SIMILARITY):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in docs}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    docs, k = [], 0
    for _ in range(25):
        w = text(rng, rng.randint(4, 250))
        docs.append((k, " ".join(w)))
        k += 1
        for n in (0, 1, 2, 4, 8, 12):
            docs.append((k, " ".join(edited(rng, w, n))))
            k += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert classes(neardup.near_duplicates(df).collect()) == brute(docs, neardup.idf_levels(df))


def test_large_group(spark):
    rng = random.Random(6)
    w = text(rng, 120)
    docs = [(k, " ".join(edited(rng, w, 1) if k % 2 else w)) for k in range(400)] + [(1000 + k, " ".join(text(rng))) for k in range(50)]
    got = classes(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert {got[k] for k in range(400)} == {0} and all(got[k] == k for k in range(1000, 1050))


def test_odd_rows(odd, no_rows):
    rows = neardup.near_duplicates(odd).collect()
    got = [(r.doc_id, r.class_id) for r in rows]
    assert len(rows) == odd.count() and sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 3), (None, None), (None, 1), (4, 4), (5, 4), (5, 4), (6, 6), (7, 7), (8, 8)], key=str)
    assert neardup.near_duplicates(no_rows).collect() == []


def test_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    u = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    level, tf = rng.integers(0, neardup.LEVELS, 400), rng.integers(1, 3, 400)
    x, y = (u[:350], tf[:350], level[:350]), (u[50:], tf[50:] * np.where(np.arange(350) % 10 == 0, 2, 1), level[50:])
    weighed = lambda z: (z[0], neardup.weights(*z[1:]))
    m = neardup.samples([x, y], 120)
    assert abs((m[0] == m[1]).mean() - neardup.similarity(weighed(x), weighed(y))) < 0.15
    assert (neardup.samples([x], 36)[0] == neardup.samples([y, x], 36)[1]).all()


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7)], [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_mixed_family(spark):
    """Copies edited each on its own from one original: most pairs are just below the threshold, some above."""
    rng = random.Random(8)
    w = text(rng, 200)
    docs = [(k, " ".join(edited(rng, w, rng.choice((3, 8))))) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got, want = classes(neardup.near_duplicates(df).collect()), brute(docs, neardup.idf_levels(df))
    assert len(set(want.values())) > 20 and got == want


def test_no_pair_of_a_hot_bucket_is_left_out(spark):
    """One bucket of 10,500 different texts, 40 of which are near copies of others: all pairs that agree enough are found."""
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 30, (10_500, 36)).astype(np.int32)
    want = {(f"{k:05}", f"{k + 7000:05}") for k in range(40)}
    sig[7000:7040, :27] = sig[:40, :27]
    sig[:, :3] = 1
    rows = spark.createDataFrame([(1, 3, f"{k:05}", s) for k, s in enumerate(sig.tolist())], "of long, parts int, key string, sig array<int>")
    assert {(r.a, r.b) for r in neardup._links(rows).collect()} == want


def test_parts_find_the_same(spark, monkeypatch):
    """Groups dealt into many parts: the classes are those of brute force, and links stay a forest's in number."""
    rng = random.Random(12)
    docs = []
    for f in range(3):
        w = text(rng, 150)
        docs += [(f * 40 + k, " ".join(edited(rng, w, rng.choice((1, 2, 6))))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(neardup, "CELL", 8)
    assert classes(neardup.near_duplicates(df).collect()) == brute(docs, neardup.idf_levels(df))


def test_borderline_families(spark):
    """480 texts in six families of 80, each with 1 to 5 edits of 240 words: no true pair of 0.8 or more is lost."""
    rng = random.Random(9)
    docs = []
    for f in range(6):
        w = text(rng, 240)
        docs += [(f * 80 + k, " ".join(edited(rng, w, rng.randint(1, 5)))) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    levels = neardup.idf_levels(df)
    got, sets = classes(neardup.near_duplicates(df).collect()), [neardup.Weigher(levels)(t) for _, t in docs]
    true = [(a, b) for a in range(480) for b in range(a + 1, 480) if a // 80 == b // 80 and neardup.similarity(sets[a], sets[b]) >= neardup.SIMILARITY]
    assert len(true) > 40 and sum(got[a] == got[b] for a, b in true) >= 0.98 * len(true)


def test_texts_of_one_id_and_no_id(spark):
    a, b = "one two three four five six seven", "a wholly different text of eight words here"
    rows = neardup.near_duplicates(spark.createDataFrame([(3, a), (3, b), (None, a), (None, "only words without any id at all"), (3, a)], "doc_id long, text string")).collect()
    by = {}
    for r in rows:
        by.setdefault((r.class_id, r.class_key), []).append((r.doc_id, r.text_key == r.class_key, r.class_size))
    assert sorted(map(len, by.values())) == [1, 1, 3] and all(x[1] for v in by.values() for x in v)
    assert sorted(k[0] is None for k in by) == [False, False, True]


def test_idf_levels_are_those_of_exact_counts(spark):
    rng = random.Random(4)
    common = text(rng, 30)
    docs = [(k, " ".join((common if k % 4 == 0 else []) + text(rng, 60))) for k in range(400)]
    weigh = neardup.Weigher(neardup.idf_levels(spark.createDataFrame(docs, "doc_id long, text string")))
    u, _, level = weigh.many([" ".join(common)])[0]
    want = round(np.log(4) / np.log(1024) * (neardup.LEVELS - 1))
    assert set(level.tolist()) == {want} and set(weigh.many([" ".join(text(rng, 60))])[0][2].tolist()) == {round(np.log(400) / np.log(1024) * 15)}


def test_long_texts_are_hashed_as_short_ones():
    from ponderloom.llm.common import word_hashes, words

    t = ["ß É_1 漢字! " * 50, None, "", "x" * 300 + " y", "plain words here " * 40]
    a, b = word_hashes(t), word_hashes(t, span=64)
    assert (a[0] == b[0]).all() and a[1].tolist() == b[1].tolist() == [len(words(x)) for x in t]
