import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ponderloom.llm import bpe
from ponderloom.llm.common import scanned_bytes


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocab())


def check(rows, texts, tokenizer):
    got = sorted((r.doc_id, bytes(r.ids), r.decoded) for r in rows)
    want = sorted((i, np.array((e := tokenizer.encode(t or "", add_special_tokens=False)).ids, "<u4").tobytes(), tokenizer.decode(e.ids, skip_special_tokens=False)) for i, t in texts)
    assert got == want


def test_matches_library(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(bpe.encode(docs, chunk_chars=50_000, word_buckets=7).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer)


def test_odd_rows(odd, no_rows, tokenizer):
    rows = bpe.encode(odd).collect()
    assert len(rows) == odd.count() and sum(r.doc_id is None for r in rows) == 2
    check([r for r in rows if r.doc_id is not None], [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None], tokenizer)
    assert bpe.encode(no_rows).collect() == []


@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60))
@settings(max_examples=300, deadline=None)
def test_split_then_encode_is_encode(text):
    tokenizer, pieces, special = bpe._vocabulary(bpe.default_vocab())
    words = bpe._splitter(bpe.default_vocab())(text)
    ids = [i for w in words for i in ([special[w]] if w in special else tokenizer.encode(w, add_special_tokens=False).ids)]
    assert "".join(words) == text and ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert b"".join(pieces[i] for i in ids).decode("utf-8", "replace") == text


def test_decode_by_join(spark, tokenizer):
    texts = ["Hello wörld <|endoftext|>", "", "漢字 again"]
    rows = spark.createDataFrame([(k, tokenizer.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)] + [(9, None)], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(rows).collect()} == dict(enumerate(texts)) | {9: ""}


def test_equal_chunks(spark, tokenizer):
    docs = spark.createDataFrame([(k, f"text {k} here") for k in range(4)], "doc_id long, text string").coalesce(1)
    check(bpe.encode(docs.union(docs)).collect(), [(r.doc_id, r.text) for r in docs.collect()] * 2, tokenizer)


def test_numbers_follow_the_input(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert scanned_bytes(docs) > 10_000 and scanned_bytes(docs.union(docs)) == 2 * scanned_bytes(docs)
    assert scanned_bytes(odd) == 0 or scanned_bytes(odd) < 1 << 24  # rows of the driver: no sentinel of unknown size
    assert [bpe.buckets_for(x) for x in (0, 1 << 30, bpe.FULL_BYTES, 4 * bpe.FULL_BYTES, 100 << 40)] == [256, 256, 256, 512, 256 * 20]
