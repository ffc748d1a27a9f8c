import pytest
import base64
import gzip
import hashlib
import os

from ponderloom.llm import warc

PAGES = [(3, "http://a", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (2, None, "é" * 5000), (4, "http://d\r\nX: y", None), (5, "http://e", ""), (None, "http://f", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (6, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb")]
KIND = "page_id long, url string, html string, payload string"


def test_records_and_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], KIND)
    read = warc.archive(pages, f"file://{tmp_path}/w").collect()
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in PAGES)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in read) == want
    kinds = {(r.page_id, r.payload_digest[:4]): (r.record_type, r.refers_to) for r in read}
    same = base64.b32encode(hashlib.sha1(b"<p>same</p>").digest()).decode()[:4]
    none = base64.b32encode(hashlib.sha1(b"").digest()).decode()[:4]
    assert kinds[1, same] == ("response", None) and kinds[3, same] == ("revisit", 1) and kinds[None, same] == ("revisit", 1)
    assert kinds[4, none] == ("response", None) and kinds[5, none] == ("revisit", 4)
    for r in read:  # each record alone, by its offset and length
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            fields, payload = warc.read_member(f.read(r.length))
        assert fields["warc-type"] == r.record_type and (r.record_type == "revisit" or len(payload) == r.payload_bytes)
    for name in {r.file.removeprefix("file:") for r in read}:  # and the file is a gzip file
        assert gzip.open(name).read().count(b"WARC/1.1\r\nWARC-Type") >= 1
    assert os.path.isdir(f"{tmp_path}/w/index")


def test_very_long_payload(spark, tmp_path):
    html = "".join(f"<p>{k} é</p>" for k in range(250_000))
    pages = spark.createDataFrame([(2, "u", html), (1, "v", html), (3, "w", "x")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(pages, f"file://{tmp_path}/w").collect()}
    digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert got[1] == (len(html.encode()), digest, "response", None) and got[2] == (len(html.encode()), digest, "revisit", 1) and got[3][0] == 1


def test_empty(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], KIND), f"file://{tmp_path}/w").collect() == []


def test_digest_in_sql(spark):
    from ponderloom.llm.common import base32_sha1

    for data in (b"", b"a", b"\xff" * 70):
        got = spark.createDataFrame([(bytearray(data),)], "x binary").select(base32_sha1("x").alias("d")).first().d
        assert got == base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_a_cut_stream_is_an_error():
    import gzip

    whole = gzip.compress(b"x" * 5000) + gzip.compress(b"y")
    assert b"".join(warc.inflate(whole, 64)) == b"x" * 5000 + b"y" and list(warc.inflate(b"")) == []
    for cut in (len(whole) - 1, len(whole) - 9, 15):
        with pytest.raises(ValueError):
            list(warc.inflate(whole[:cut], 64))


def test_copies_by_either_join(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.union(pages.withColumn("page_id", pages.page_id + 100_000)).union(spark.createDataFrame([(None, "u", None), (7_000_000, "u", None)], pages.schema))
    got = [sorted(map(repr, warc.records(pages, broadcast_bytes=n).drop("payload").collect())) for n in (warc.BROADCAST_BYTES, -1)]
    assert got[0] == got[1] and sum("revisit" in r for r in got[0]) >= pages.count() // 2 - 1
