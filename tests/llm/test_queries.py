"""The registered queries return the columns that were agreed on, a row for each document or page."""

import pytest

from ponderloom.llm import queries

COLUMNS = {
    "op1_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf)
    assert {(c, t) for c, t in rows.dtypes} >= {tuple(c.split()) for c in COLUMNS[name].split(", ")}
    source, key = ("pages", "page_id") if name == "op5_warc" else ("documents", "doc_id")
    if name != "op8_topk":
        assert sorted(r[0] for r in rows.select(key).collect()) == sorted(r[0] for r in spark.read.parquet(f"{sf}/{source}.parquet").select(key).collect())


@pytest.mark.parametrize(("name", "modulus", "remainder", "least"), [("op6_toxicity", 4, 2, 0.3), ("op10_quality", 3, 1, 0.5)])
def test_held_out_and_predicted(spark, sf, name, modulus, remainder, least):
    import zlib

    for r in queries.QUERIES[name](spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
