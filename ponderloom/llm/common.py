"""What the training-data operators share: tables, the shared folder, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in local mode, where none is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ponderloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files that df scans, as Catalyst knows them. What has no known size (rows of the driver, RDDs) counts as none. For numbers
    of partitions and buckets, never for what is calculated."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Gives freed memory of this worker back to the system: workers live on between tasks, and an executor's memory holds several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(run):
    """run (a function over batches) that releases its memory at its end."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied at a fixed size so that a worker's memory stays bounded."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(word_hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """A hash for each run of n words; of fewer words, one for all of them; none for no words."""
    if not len(word_hashes):
        return word_hashes
    n = min(n, len(word_hashes))
    out = np.zeros(len(word_hashes) - n + 1, np.uint64)
    for k in range(n):
        out += mix(word_hashes[k : len(word_hashes) - n + 1 + k] * _M[k % 5])
        out *= _M[(k + 1) % 5]
    return mix(out)


SPAN = 1 << 18  # characters whose words are hashed together
_IS_WORD = None
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def _is_word() -> np.ndarray:
    """Which code points are letters, digits or underscores (as \\w has them)."""
    global _IS_WORD
    if _IS_WORD is None:
        _IS_WORD = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        _IS_WORD[ord("_")] = True
    return _IS_WORD


def _pieces(text: str, span: int):
    """text in pieces that end between words."""
    start = 0
    while len(text) - start > span:
        end = start + span
        gap = NO_WORD.search(text, end)
        end = gap.end() if gap else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


NO_WORD = re.compile(r"\W")


def word_hashes(texts: list[str | None], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the lower-case texts, one text after the other, and each text's number of words.

    A word's hash is a polynomial in hashes of its code points, taken from running sums: array operations over all characters.
    """
    pieces, of = [], []
    for k, t in enumerate(texts):
        if t:
            for x in _pieces(t.lower(), span):
                pieces.append(x)
                of.append(k)
    out, owner, k = [], [], 0
    while k < len(pieces):
        first, size = k, 0
        while k < len(pieces) and (k == first or size + len(pieces[k]) < span):
            size += len(pieces[k]) + 1
            k += 1
        some = pieces[first:k]
        codes = np.frombuffer("\n".join([*some, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _is_word()[codes]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edges[0::2], edges[1::2]
        power, inverse = _powers(len(codes))
        z = codes.astype(np.uint64) + np.uint64(1)
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xA0761D6478BD642F)
        z *= power[: len(z)]
        total = np.zeros(len(z) + 1, np.uint64)
        np.cumsum(z, out=total[1:])
        out.append(mix((total[ends] - total[starts]) * inverse[starts]))
        after = np.cumsum([len(x) + 1 for x in some])
        owner.append(np.asarray(of[first:k])[np.searchsorted(after, starts, "right")])
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    counts = np.bincount(np.concatenate(owner), minlength=len(texts)) if owner else np.zeros(len(texts), np.int64)
    return h, counts


def shingle_sets(texts: list[str | None], n: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, in ascending order, and how often each occurs."""
    h, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    every = shingle_hashes(h, n) if len(h) >= n else h[:0]
    out = []
    for end, k in zip(ends.tolist(), counts.tolist(), strict=True):
        s = np.sort(every[end - k : end - n + 1]) if k >= n else shingle_hashes(h[end - k : end], n)
        new = np.flatnonzero(np.concatenate([s[:1] == s[:1], s[1:] != s[:-1]]))
        out.append((s[new], np.diff(new, append=len(s))))
    return out


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def base32_sha1(column):
    """Upper-case base32 of the SHA-1 of a binary or string column: 8 groups of 20 bits, 4 digits each."""
    h = F.sha1(column)
    groups = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
