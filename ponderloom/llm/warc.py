"""WARC: pages written as archives, monolithic gzip normalised into a member for each record, a sidecar offset index.

1. `records` decides response or revisit: of equal payloads (SHA-1) the smallest id is the response. Digests are
   counted before they are shuffled, and those of several pages are written to the shared folder. Where their files are small
   (BROADCAST_BYTES) they are broadcast and payloads stay where they were scanned; else they are joined back on (digest, salt).
2. `write_monolithic` writes archives of which each is one gzip stream, through Spark's text writer (which reaches any
   store). Records are separated by the blank lines that end a WARC record.
3. `normalise` inflates each stream once, as it comes, and writes every record as a gzip member of its own, again through
   Spark's text writer, with Latin-1 as the separator's encoding: the separator is an empty gzip member, which inflates to nothing.
4. `index` walks the members of an archive and leaves, for each record, file, offset, length and its header's fields; `write_index`
   stores that beside the archives. `read_member` reads one record by offset and length alone.

Defined results: null html is the empty payload. A null page id is kept (no id field); pages without id take part in
groups, and a group without any id is all responses. Repeated page ids: each row is a record; rows with the response's id are responses.
Other columns are left behind. An empty table gives an archive without records.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import base32_sha1, scanned_bytes, shared_path

SALTS = 16
#: Digests of several pages are broadcast up to this size of their files (some 200,000 digests).
BROADCAST_BYTES = 8 << 20
ARCHIVE_ROWS = 4096
#: Fixed value: a gzip member of nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + b"\0" * 8
#: Fixed value: the date of all records, for equal archives from equal pages.
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1("payload"))
    # The counts first: most payloads are single.
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    path = shared_path(spark, "warc-copies")
    first.where("n > 1 and first is not null").select("payload_digest", "first").write.parquet(path)
    first = spark.read.schema("payload_digest string, first long").parquet(path)
    if scanned_bytes(first) <= broadcast_bytes:
        rows = rows.join(F.broadcast(first), "payload_digest", "left")
    else:
        salted = first.select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _line(name: str, value) -> F.Column:
    """A header line, or nothing for a null. Line ends in values become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def record_texts(rows: DataFrame) -> DataFrame:
    """One string column: whole records, without the blank lines that end them."""
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    body = F.when(F.col("record_type") == "response", F.concat(http, F.col("payload").cast("string"))).otherwise(http)
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", F.col("url")), _line("WARC-Refers-To", urn(F.col("refers_to"))),
        _line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), _line("X-Payload-Bytes", F.col("payload_bytes")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), _line("Content-Length", F.octet_length(body)), F.lit("\r\n"),
    )
    return rows.select(F.concat(head, body).alias("record"))


def write_monolithic(rows: DataFrame, path: str) -> None:
    record_texts(rows).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", ARCHIVE_ROWS).text(path)


class Parser:
    """Cuts a stream of bytes into whole records."""

    def __init__(self):
        self.held = bytearray()

    def feed(self, data: bytes):
        self.held += data
        while True:
            start = 0
            while self.held[start : start + 2] == b"\r\n":
                start += 2
            end = self.held.find(b"\r\n\r\n", start)
            if end < 0:
                return
            fields = header(bytes(self.held[start:end]))
            stop = end + 4 + int(fields["content-length"])
            if len(self.held) < stop:
                return
            yield bytes(self.held[start:stop])
            del self.held[:stop]


def header(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(data: bytes, step: int = 1 << 20):
    """The bytes of all members, as they come."""
    left, whole = zlib.decompressobj(31), True
    for k in range(0, len(data), step):
        chunk = data[k : k + step]
        while chunk:
            yield left.decompress(chunk)
            chunk = left.unused_data
            if left.eof:
                left, whole = zlib.decompressobj(31), True
            else:
                whole = False
    if not whole:
        raise ValueError("the stream stops before its trailer")


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record + b"\r\n\r\n") + z.flush()


def normalise(spark: SparkSession, source: str, target: str) -> None:
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                parser, out, size = Parser(), [], 0
                for piece in inflate(content.as_py()):
                    for record in parser.feed(piece):
                        out.append(member(record))
                        size += len(out[-1])
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                            out, size = [], 0
                if parser.held.strip(b"\r\n"):
                    raise ValueError("the archive ends inside a record")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("content")
    members = files.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("member"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", ARCHIVE_ROWS).text(target)


_INDEX = "file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _payload(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = header(head)
    return fields, body[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the normalised archives below path. Responses' digests and sizes are those of the bytes read."""
    import base64
    import hashlib

    schema = pa.schema([("file", pa.string()), *[(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.strip().split() for x in _INDEX.split(",")[1:])]])

    def number(urn: str | None) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, out = content.as_py(), 0, []
                while at < len(data):
                    z = zlib.decompressobj(31)
                    record, window, stop = [], 0, at
                    while not z.eof:
                        window = data[stop : stop + 65_536]
                        if not window:
                            raise ValueError(f"{name} ends inside a member")
                        record.append(z.decompress(window))
                        stop += len(window) - len(z.unused_data)
                    if whole := b"".join(record):
                        f, payload = _payload(whole)
                        if f["warc-type"] == "response":
                            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if digest != f["warc-payload-digest"].removeprefix("sha1:"):
                                raise ValueError(f"{name} at {at}: the payload is not that of its digest")
                        else:
                            size, digest = int(f["x-payload-bytes"]), f["warc-payload-digest"].removeprefix("sha1:")
                        out.append((name, at, stop - at, number(f.get("warc-record-id")), f.get("warc-target-uri"), size, digest, f["warc-type"], number(f.get("warc-refers-to"))))
                    at = stop
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], s.type) for k, s in enumerate(schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, _INDEX)


def write_index(spark: SparkSession, path: str, target: str) -> DataFrame:
    index(spark, path).write.parquet(target)
    return spark.read.schema(_INDEX).parquet(target)


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header, payload) of the member that data is."""
    return _payload(zlib.decompress(data, 31))


def archive(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Writes path/monolithic, path/archives and path/index; the index as read back."""
    spark = pages.sparkSession
    write_monolithic(records(pages, **columns), f"{path}/monolithic")
    normalise(spark, f"{path}/monolithic", f"{path}/archives")
    return write_index(spark, f"{path}/archives", f"{path}/index")
