"""Token-id output: best-fit-decreasing packing of documents into rows of a fixed length.

Each task encodes the documents of its part of the scan and packs them in bundles of BUNDLE_TOKENS. Documents longer
than a row are split losslessly: whole rows first, then a tail that is packed like others. Segments, longest first, go to
the open row with the least room that holds them; a segment tree over the rooms finds it in log2(length) steps. Nothing
is shuffled, a bundle's memory is bounded, and no key can be hot.

Rows: bundle and row number, ids (little-endian, 16 bits where the vocabulary allows, else 32; padded to the length),
lengths (cumulative, from 0: cu_seqlens), positions (16 or 32 bits like ids, starting at 0 with each segment and in the padding),
and for each segment its document, its place among the document's tokens and the document's number of tokens.

Defined results: each document ends with end_id; a null or empty text is that id alone. Null ids stay null. Repeated rows are packed each.
Strings of special tokens are ordinary text. The rows depend on how the scan is dealt into tasks; their documents do not.
Other columns are left behind. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN

LENGTH = 2048
BUNDLE_TOKENS = 4 << 20


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ponderloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


class Rooms:
    """A segment tree over room sizes 0..length; a leaf counts the open rows with that room."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of the least room of at least need; the row is no longer open."""
        k = need + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k == 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        while k:
            self.count[k] -= 1
            k >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers. Ties: the earlier item first."""
    rows: list[list[int]] = []
    rooms = Rooms(length)
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        got = rooms.take(sizes[item])
        row, room = got or (len(rows), length)
        if got is None:
            rows.append([])
        rows[row].append(item)
        if room > sizes[item]:
            rooms.add(room - sizes[item], row)
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, ranks: str | None = None, end_id: int | None = None, bundle_tokens: int = BUNDLE_TOKENS) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    ranks = ranks or default_ranks()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    segment = pa.struct([("id", to_arrow_type(kind)), ("start", pa.int64()), ("tokens", pa.int64())])
    schema = pa.schema([("bundle", pa.string()), ("row", pa.int32()), ("ids", pa.binary()), ("lengths", pa.list_(pa.int32())), ("positions", pa.binary()), ("segments", pa.list_(segment))])

    def run(batches):
        from pyspark import TaskContext

        encoding, size = _encoding(ranks)
        stop = size if end_id is None else end_id
        wide = "<u2" if max(size, stop) < 65_536 and length <= 65_536 else "<u4"
        part, bundles = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        count = 0

        def bundle():
            pieces = [(k, a, min(a + length, len(t))) for k, (_, t) in enumerate(held) for a in range(0, len(t), length)]
            packed = best_fit_decreasing([b - a for _, a, b in pieces], length)
            for k in range(0, len(packed), 512):
                out = [[], [], [], [], [], []]
                for n, items in enumerate(packed[k : k + 512], k):
                    ids, places, ends, said = np.zeros(length, wide), np.zeros(length, wide), [0], []
                    at = 0
                    for i in items:
                        d, a, b = pieces[i]
                        ids[at : at + b - a] = held[d][1][a:b]
                        places[at : at + b - a] = np.arange(b - a)
                        at += b - a
                        ends.append(at)
                        said.append({"id": held[d][0], "start": a, "tokens": len(held[d][1])})
                    places[at:] = np.arange(length - at)
                    for c, v in zip(out, (f"{part}-{bundles}", n, ids.tobytes(), ends, places.tobytes(), said), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = encoding.encode_to_numpy(text) if text else np.zeros(0, np.uint32)
                held.append((key, np.append(ids, stop).astype(wide)))
                count += len(ids) + 1
                if count >= bundle_tokens:
                    yield from bundle()
                    held, count, bundles = [], 0, bundles + 1
        if held:
            yield from bundle()

    return rows.mapInArrow(run, f"bundle string, row int, ids binary, lengths array<int>, positions binary, segments array<struct<id:{kind.simpleString()},start:bigint,tokens:bigint>>")



def matrix(column: pa.Array, dtype: str = "<u2") -> np.ndarray:
    """The rows of a binary column (ids or positions) as a matrix, a row for each packed row."""
    data = [np.frombuffer(x.as_py(), dtype) for x in column]
    return np.stack(data) if data else np.zeros((0, 0), dtype)


def write(rows: DataFrame, path: str, dtype: str = "<u2") -> None:
    """Packed rows below path/rows; path/meta says how to read the binary columns. The rows' table is written as it is made, by the tasks."""
    rows.write.parquet(f"{path}/rows")
    meta = json.dumps({"dtype": dtype, "matrices": ["ids", "positions"], "cumulative_lengths": "lengths", "documents": "segments"})
    rows.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")


def read(spark, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first()["value"])
