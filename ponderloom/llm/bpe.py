"""BPE encoding and decoding through a distinct-word table.

1. A pass over the scan splits each text into the vocabulary's pre-tokens ("words") and replaces them by positions
   in the word list of its chunk (some 24 MB of texts). A chunk leaves one row with its documents as positions, and
   its word list dealt into buckets by the words' hash.
2. The word lists meet by bucket; there, each distinct word is encoded once, by the tokenizers library. A task takes one
   bucket after the other and forgets the words of the last. The number of buckets grows with the square root of the
   input's size, as distinct words grow slower than texts; that of partitions by chunk grows with the input.
3. The ids go back to their chunk and are joined to the documents by position.
4. Decoding joins ids to the vocabulary's pieces (id -> bytes, one for each id: bounded by the vocabulary), and
   a document's bytes are those of its words in order.

Texts are never shuffled as words: 165 million word rows become some thousand packed rows. No key is hot: a very
frequent word is one entry of each chunk's list.

Defined results: a null text is the empty text (no ids, decoded ""). A null id stays null. Repeated rows each give a
row. Strings of special tokens in a text become those tokens' ids, as the library does by default. Other columns of
the input, whatever their names, are left behind. An empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import json
import math
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, releasing, scanned_bytes

#: Fixed value: the public pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_CHARS = 24 << 20
#: Buckets of words: so many up to FULL_BYTES of input as scanned; beyond that they grow with the root of its size.
WORD_BUCKETS = 256
FULL_BYTES = 1 << 38
#: Bytes of input as scanned for each partition of chunks, where the session's shuffle partitions would be fewer.
PARTITION_BYTES = 64 << 20


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _vocabulary(path: str):
    """The tokenizer, bytes of each id, and the special tokens."""
    from tokenizers import Tokenizer

    said = json.load(open(path, encoding="utf-8"))
    # The byte alphabet: printable bytes stand for themselves, the rest for the code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in said["model"]["vocab"].items() if all(c in byte_of for c in piece)}
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    pieces |= {i: content.encode() for content, i in special.items()}
    return Tokenizer.from_file(path), [pieces.get(i, b"") for i in range(max(pieces) + 1)], special


@cache
def _splitter(path: str):
    special = _vocabulary(path)[2]
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    find = regex.compile(PATTERN).findall

    def split(text: str) -> list[str]:
        if cut is None or not any(s in text for s in special):
            return find(text)
        return [w for k, part in enumerate(cut.split(text)) for w in ([part] if k % 2 else find(part))]

    return split


def _pack(table: pa.Table, level: int = 6) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


_PACKED = "chunk string, bucket int, packed binary"
_PACKED_ARROW = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("packed", pa.binary())])


def _chunks(vocab: str, chunk_chars: int, buckets: int):
    def run(batches):
        split = _splitter(vocab)
        ids, rows, places, size = [], [], {}, 0
        # A chunk's place: the same in a retry, another for equal chunks.
        task, number = TaskContext.get().partitionId(), itertools.count()

        def chunk():
            out, digest = [], xxhash.xxh3_128(f"{task} {next(number)}")
            flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            # Two halves compress better than whole numbers: frequent words have small positions.
            docs = _pack(pa.table({"id": pa.concat_arrays(ids).slice(0)}))
            low = _pack(pa.table({"low": flat.astype(np.uint16), "high": (flat >> 16).astype(np.uint16)}))
            ends = _pack(pa.table({"offset": offsets}))
            names = list(places)
            for part in (docs, low, ends, "\0".join(names).encode("utf-8", "surrogatepass")):
                digest.update(part)
            key = digest.hexdigest()
            out.append((key, -1, _pack(pa.table({"part": [docs, low, ends]}))))
            of = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in names), np.int32, len(names))
            order = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[order], np.arange(buckets + 1))
            for b in range(buckets):
                at = order[starts[b] : starts[b + 1]]
                if len(at):
                    out.append((key, b, _pack(pa.table({"at": at.astype(np.uint32), "word": pa.array([names[k] for k in at], pa.string())}))))
            for k in range(0, len(out), 64):
                part = out[k : k + 64]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)

        for batch in batches:
            texts, start = batch.column(1), 0
            for k, text in enumerate(texts):
                text = text.as_py() or ""
                rows.append(np.fromiter((places.setdefault(w, len(places)) for w in split(text)), np.uint32))
                size += len(text) + 64
                if size >= chunk_chars:
                    ids.append(batch.column(0).slice(start, k + 1 - start))
                    yield from chunk()
                    ids, rows, places, size, start = [], [], {}, 0, k + 1
            if start < len(texts):
                ids.append(batch.column(0).slice(start))
        if rows:
            yield from chunk()
        ids, rows, places = [], [], {}

    return releasing(run)


def _encode_words(vocab: str):
    """Each distinct word of a bucket is encoded once; a bucket is in one task, its rows one after the other."""

    def run(batches):
        tokenizer, pieces, special = _vocabulary(vocab)
        narrow = pa.list_(pa.uint16() if len(pieces) <= 65_536 else pa.uint32())
        known: dict[str, list[int]] = {}
        last = None
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != last:
                    known, last = {}, bucket
                t = _unpack(blob.as_py())
                names = t["word"].to_pylist()
                new = [w for w in names if w not in known]
                for w, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    known[w] = [special[w]] if w in special else e.ids
                got = [known[w] for w in names]
                out.append(_pack(pa.table({"at": t["at"], "ids": pa.array(got, narrow)})))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], schema=_PACKED_ARROW)

    return releasing(run)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _binary(kind: pa.DataType, parts: list[np.ndarray], sizes: np.ndarray) -> pa.Array:
    """A binary or string array of the bytes in parts, cut into sizes, without an object for each value."""
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    large = pa.large_binary() if kind == pa.binary() else pa.large_string()
    return pa.Array.from_buffers(large, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data.view(np.uint8))]).cast(kind)


def _join_back(vocab: str, schema: pa.Schema, step: int = 1 << 18):
    """Ids and bytes of a chunk's words lie in two flat arrays; a document's are gathered by its positions, `step` words at a time."""

    def run(docs: pa.Table, lists: pa.Table) -> pa.Table:
        pieces = _vocabulary(vocab)[1]
        piece_size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece_data, piece_start = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(piece_size) - piece_size
        at, ids, sizes = [], [], []
        for blob in lists["packed"]:
            t = _unpack(blob.as_py()).combine_chunks()
            if len(t):
                said = t["ids"].chunk(0)
                at.append(t["at"].to_numpy().astype(np.int64))
                ids.append(said.flatten().to_numpy().astype(np.uint32))
                sizes.append(np.diff(said.offsets.to_numpy()))
        at, ids, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, ids, sizes))
        n = int(at.max(initial=-1)) + 1
        if len(at) != n or (n and np.bincount(at, minlength=n).max() > 1):
            raise ValueError("a chunk's word lists aren't whole")  # never a short document
        size, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        size[at], start[at] = sizes, np.cumsum(sizes) - sizes
        # The id-to-piece join: bytes of all words' ids, one after the other; a word's bytes are those of its ids.
        id_size = piece_size[ids]
        data = piece_data[_spread(piece_start[ids], id_size)]
        ends = np.concatenate([[0], np.cumsum(id_size)])
        text_start, text_size = ends[start], ends[start + size] - ends[start]
        out = []
        for blob in docs["packed"]:
            names, numbers, cuts = (_unpack(x) for x in _unpack(blob.as_py())["part"].to_pylist())
            places = numbers["low"].to_numpy().astype(np.int64) + (numbers["high"].to_numpy().astype(np.int64) << 16)
            cuts = cuts["offset"].to_numpy()
            id_parts, text_parts = [], []
            for k in range(0, len(places), step):
                p = places[k : k + step]
                id_parts.append(ids[_spread(start[p], size[p])].astype("<u4"))
                text_parts.append(data[_spread(text_start[p], text_size[p])])
            total = lambda of: np.diff(np.concatenate([[0], np.cumsum(of[places])])[cuts])
            out.append(pa.table([names["id"].combine_chunks(), _binary(pa.binary(), id_parts, 4 * total(size)), _binary(pa.string(), text_parts, total(text_size))], schema=schema))
        got = pa.concat_tables(out) if out else schema.empty_table()
        del out
        release()
        return got

    return run


def buckets_for(size: int) -> int:
    """Buckets of words for an input of size bytes."""
    return WORD_BUCKETS * max(1, math.ceil(math.sqrt(size / FULL_BYTES)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, chunk_chars: int = CHUNK_CHARS, word_buckets: int | None = None) -> DataFrame:
    """id_col, ids (little-endian unsigned 32-bit numbers), decoded (the text made from the ids)."""
    from pyspark.sql.pandas.types import to_arrow_type

    vocab = vocab or default_vocab()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("ids", pa.binary()), ("decoded", pa.string())])
    size = scanned_bytes(docs)
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PARTITION_BYTES))
    packed = rows.mapInArrow(_chunks(vocab, chunk_chars, word_buckets or buckets_for(size)), _PACKED).repartition(partitions, "chunk")
    # The two kinds of rows share one exchange: a filter that isn't deterministic stays above it, so that texts are split once.
    kind_of = F.col("bucket") + F.floor(F.rand()).cast("int")
    lists = packed.where(kind_of >= 0).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(vocab), _PACKED).repartition(partitions, "chunk")
    back = packed.where(kind_of < 0).groupBy("chunk").cogroup(lists.groupBy("chunk"))
    return back.applyInArrow(_join_back(vocab, schema), f"`{id_col}` {kind.simpleString()}, ids binary, decoded string")


def decode(rows: DataFrame, ids_col: str = "ids", vocab: str | None = None, out_col: str = "decoded") -> DataFrame:
    """rows plus out_col: ids (arrays of numbers) exploded with their places, joined to their pieces, joined again in order.

    A null or empty array gives "". Ids outside the vocabulary give nothing. The vocabulary's table bounds the broadcast.
    """
    spark = rows.sparkSession
    pieces = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(_vocabulary(vocab or default_vocab())[1])], "_id int, _piece binary")
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    said = keyed.select("_row", F.posexplode(ids_col).alias("_at", "_id")).join(F.broadcast(pieces), "_id")
    said = said.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
    text = F.aggregate("_p", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["_piece"])).cast("string")
    return keyed.join(said.select("_row", text.alias("_text")), "_row", "left").select(*[keyed[c] for c in rows.columns], F.coalesce("_text", F.lit("")).alias(out_col))
