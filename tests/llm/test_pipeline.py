import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from ponderloom.llm import bpe, decontaminate, neardup, quality, secrets  # noqa: E402


def test_stages_by_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    model, measure = quality.fit(docs, labels), quality.Measure()
    kept = {i: r for i, r in kept.items() if model.scores(np.array([measure(r.text)]))[0] >= 0.5}
    step = spark.createDataFrame(list(kept.values()), docs.schema)
    weigh, sets = neardup.Weigher(neardup.idf_levels(step)), {}
    sets = {i: weigh(r.text) for i, r in kept.items()}
    root = {i: i for i in kept}
    for i in sorted(kept):
        for j in sorted(kept):
            if i < j and (kept[i].text == kept[j].text or neardup.similarity(sets[i], sets[j]) >= 0.8):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    kept = {i: r for i, r in kept.items() if root[i] == i}
    found = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(list(kept.values()), docs.schema), items).collect()}
    kept = {i: r for i, r in kept.items() if i not in found}
    rank = secrets.ranks(secrets.frequent_words(spark.createDataFrame(list(kept.values()), docs.schema)))
    tokenizer = bpe._vocabulary(bpe.default_vocab())[0]
    want = {i: np.array(tokenizer.encode(secrets.redact(r.text, rank=rank), add_special_tokens=False).ids, "<u4").tobytes() for i, r in kept.items()}
    assert {r.doc_id: bytes(r.ids) for r in pipeline.run(spark, sf).collect()} == want


def test_stages_keep_columns_and_odd_rows(spark, sf):
    rows = [(1, None, "en", None, None), (2, "", "en", "s", 0), (3, "password=abcdef99 is here, and a few more words follow it.", "en", "s", 7), (3, "password=abcdef99 is here, and a few more words follow it.", "en", "s", 7), (None, "A text without an id, which stays.", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == (docs.columns if name != "bpe" else ["doc_id", "n_tokens", "ids"]), name
        assert stage(spark, docs.limit(0), sf).collect() == [], name
        out.collect()
    assert pipeline.drop_near_duplicates(spark, docs, sf).count() == 3  # 1 and 2 are empty, 3 is repeated
    red = {r.doc_id: (r.text, r.n_chars) for r in pipeline.redact_secrets(spark, docs, sf).collect()}
    assert red[3] == ("<secret> is here, and a few more words follow it.", 49) and red[1] == (None, None)


def test_rows_are_known_by_id_and_text(spark, sf):
    """Texts that share an id, rows without id, repeated tables and a very long text: no document of its own is lost, none that is contaminated stays."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("text").where("length(text) > 80").first().text
    long = " ".join(f"word{k % 997}x{k}" for k in range(25_000))
    rows = [(3, "one text of some words that stands alone here", 1), (3, "another text which shares the id but none of it", 2), (None, f"well {item} indeed", 3), (None, "a clean text without an id stays", 4), (3, f"so {item} again", 5), (9, long, 6), (None, None, 7)]
    docs = spark.createDataFrame([(i, t, "en", "s", n, "z") for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    twice = docs.union(docs)
    kept = lambda df: sorted(r.n_chars for r in df.collect())
    clean = pipeline.drop_contaminated(spark, twice, sf)
    assert kept(clean) == [1, 1, 2, 2, 4, 4, 6, 6, 7, 7] and clean.columns == docs.columns
    single = pipeline.drop_near_duplicates(spark, twice, sf)
    assert [n for n in kept(single) if n not in (3, 5)] == [1, 2, 4, 6, 7] and single.columns == docs.columns
