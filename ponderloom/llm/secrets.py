"""Secret scans: fixed patterns, plus values in credential contexts that would take many guesses.

The guess cost of a value is that of its cheapest segmentation, by dynamic programming over its characters:
dictionary words (by rank, with a factor for capitals and for look-alike digits), dates, repeats of a unit, walks on the
keyboard, character sequences, and brute-force spans (10 guesses a character). The cost of a segmentation is the sum of the log10 guesses
of its parts plus log10(k!) for its k parts. A value of MIN_LOG10 or more is a secret.

The dictionary: PASSWORDS, then the corpus's own words, most frequent first (`frequent_words`: counted in Spark over all documents, outside
of values in credential contexts, so that a copied secret doesn't become a word; the first DICTIONARY of them are broadcast).

A scan needs no more than whether a value costs MIN_LOG10: the programme goes on only from places that were reached for less, so that
values of any length are worked through whole, and most random ones end after some ten characters. In plain prose (a value after " is ", or after a
colon and without quotes) a value of letters alone, or letters and a capital in front, is taken for a word.

Defined results: a null or empty text has no spans, an empty table gives an empty table. Offsets are code points, end exclusive. Repeated rows
each give a row. Texts and values of any length are taken whole. Ties of words' counts go by the word. Null ids stay null. Other columns are left behind.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, releasing

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 9.0
#: So many of the corpus's words, at most, are broadcast as the dictionary (some 15 bytes each).
DICTIONARY = 30_000
WORD_LETTERS = (3, 24)

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal either way
#: Names that announce a credential, not inside of another word; wider than the base pattern's, as are the values.
NAMES = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|bearer|login[_-]?key"
CONTEXT = re.compile(rf"""(?:(?<![^\W\d_])|(?<=[a-z])(?=[A-Z]))(?ai:{NAMES})["']?(\x20*(?:[:=]|\x20is\x20|=>)\x20*)(?:(?ai:bearer)\x20+)?(?:"([^"\s]{{6,}})"|'([^'\s]{{6,}})'|([^\s"'<>,;]{{6,}}))""")
PLAIN = re.compile(r"[^\W\d_][a-z\u00df-\u024f'-]*(?:[-/][^\W\d_]+)*")

#: Frequent passwords and words, most frequent first.
PASSWORDS = """password qwerty letmein welcome admin login master dragon monkey shadow sunshine princess football baseball
iloveyou superman batman trustno hello freedom whatever secret summer winter spring autumn love hunter killer pepper
charlie michael jordan jennifer thomas george andrew daniel robert computer internet server database default changeme
access token user root test guest service system public private company office money cheese coffee orange banana apple
purple yellow silver golden black white green blue red happy lucky magic power star tiger lion eagle wolf horse correct
battery staple the and for you with that this from have not are was but all can one our out day get has him his how man
new now old see two way who boy did its let put say she too use""".split()
RANK = {w: k + 1 for k, w in enumerate(PASSWORDS)}
LONGEST_WORD = WORD_LETTERS[1]
LEET = str.maketrans("430157$@!", "aeoistsai")
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (y, x + 0.5 * y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
DATE = re.compile(r"(?:\d{4}([-/.]?)\d{1,2}\1\d{1,2}|\d{1,2}([-/.]?)\d{1,2}\2\d{4}|(?:19|20)\d\d|\d{1,2}([-/.])\d{1,2}\3\d{2})")


def _next_key(a: str, b: str) -> bool:
    p, q = PLACE.get(a), PLACE.get(b)
    return bool(p and q) and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def ranks(words: list[str] = ()) -> dict[str, int]:
    """The rank of each word of the dictionary: PASSWORDS first, then words."""
    return {w: k + 1 for k, w in enumerate(dict.fromkeys([*PASSWORDS, *words]))}


class Value:
    """The parts of a value that are cheaper than brute force, by their start."""

    def __init__(self, value: str, rank: dict[str, int]):
        self.value, self.rank = value, rank
        self.low = value.lower() if len(value.lower()) == len(value) else value
        self.plain, self.keys = self.low.translate(LEET), self.low.translate(SHIFTED)

    def parts(self, i: int, last: str = ""):
        """(end, log10 guesses, kind). A repeat, walk or sequence that only goes on from one before is left out: it is cheaper in one part."""
        value, n = self.value, len(self.value)
        for j in range(i + WORD_LETTERS[0], min(n, i + LONGEST_WORD) + 1):
            for form, factor in ((self.low, 1), (self.plain, 2)):
                if at := self.rank.get(form[i:j]):
                    case = value[i:j]
                    ups = sum(c.isupper() for c in case)
                    factor *= 1 if not ups else 2 if ups == len(case) or (ups == 1 and case[0].isupper()) else 2 ** min(ups, len(case) - ups) * 2
                    yield j, math.log10(at * factor + 1), "word"
        for size in (4, 6, 8, 10):
            if i + size <= n and DATE.fullmatch(value, i, i + size):
                yield i + size, math.log10(365.0 * (120 if size > 4 else 1) * (4 if size in (8, 10) and not value[i : i + size].isdigit() else 1)), "date"
        done = []
        for unit in (1, 2, 3, 4):
            if any(unit % x == 0 for x in done):
                continue  # a repeat of a shorter unit is cheaper
            if value[i : i + unit] == value[i + unit : i + 2 * unit]:
                done.append(unit)
            if last == f"repeat{unit}" and value[max(0, i - unit) : i] == value[i : i + unit]:
                done.append(unit)
                continue
            end = i + unit
            while end + unit <= n and value[end : end + unit] == value[i : i + unit]:
                end += unit
                if end - i >= 3:
                    yield end, unit + math.log10((end - i) / unit), f"repeat{unit}"
        near = lambda j: _next_key(self.keys[j - 1], self.keys[j]) and self.keys[j] != self.keys[j - 1]
        if not (last == "walk" and near(i)):
            j = i + 1
            while j < n and near(j):
                j += 1
                if j - i >= 3:
                    yield j, math.log10(len(PLACE) * 4.6 * (j - i)), "walk"
        for step in (1, -1):
            if last == f"sequence{step}" and ord(value[i]) - ord(value[i - 1]) == step:
                continue
            j = i + 1
            while j < n and ord(value[j]) - ord(value[j - 1]) == step:
                j += 1
                if j - i >= 3:
                    yield j, math.log10(26 * 2 * (j - i)), f"sequence{step}"


def _orders(k: int) -> float:
    return math.lgamma(k + 1) / math.log(10)


def guesses(value: str, rank: dict[str, int] = RANK, limit: float = math.inf) -> tuple[float, tuple[tuple[int, int, str], ...]]:
    """log10 of the guesses of the cheapest segmentation, and that segmentation; (limit, ()) where none costs less than limit."""
    n = len(value)
    if not n:
        return 0.0, ()
    said = Value(value, rank)
    # reached[j][k]: the cheapest of k parts up to j that, with log10(k!), is below limit
    reached: dict[int, dict[int, tuple]] = {0: {0: (0.0, None)}}
    ahead = [0]
    while ahead and ahead[0] < n:
        i = heapq.heappop(ahead)
        states = reached[i]
        last = min(states.values(), key=lambda s: s[0])[1]
        brute = ((j, float(j - i), "brute") for j in range(i + 1, n + 1 if limit == math.inf else min(n, i + math.ceil(limit)) + 1))
        for j, cost, kind in itertools.chain(said.parts(i, last[2] if last else ""), brute):
            for k, (before, way) in states.items():
                c = before + cost
                if c + _orders(k + 1) >= limit or (kind == "brute" and way and way[2] == "brute"):
                    continue
                if j not in reached:
                    reached[j] = {}
                    heapq.heappush(ahead, j)
                if k + 1 not in reached[j] or c < reached[j][k + 1][0]:
                    reached[j][k + 1] = (c, (i, j, kind, k))
    if n not in reached:
        return limit, ()
    best = reached[n]
    m = min(best, key=lambda k: (best[k][0] + _orders(k), k))
    cost, way, j = best[m][0] + _orders(m), [], n
    while m:
        i, j, kind, m = reached[j][m][1]
        way.append((i, j, kind.rstrip("-1234")))
        j = i
    return cost, tuple(reversed(way))


def contexts(text: str):
    """(start, end) of the values in credential contexts of six characters or more; those that are taken for words of prose are left out."""
    for m in CONTEXT.finditer(text):
        g = next(k for k in (2, 3, 4) if m[k] is not None)
        a, b = m.span(g)
        if g == 4:
            b = a + len(m[4].rstrip(".)]}!?:"))
            if m[1].strip() != "=" and PLAIN.fullmatch(text, a, b):
                continue
        if b - a >= 6:
            yield a, b


def _may_hold(low: str) -> bool:
    return any(w in low for w in ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer"))


def spans(text: str | None, min_log10: float = MIN_LOG10, rank: dict[str, int] = RANK) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then kind as listed. A guessed value inside a base span is that span's."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if _may_hold(text.lower()):
        base = list(found)
        for a, b in contexts(text):
            if not any(s <= a and b <= e for _, s, e in base) and guesses(text[a:b], rank, min_log10)[0] >= min_log10:
                found.append(("guess", a, b))
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, mark: str = "<secret>", rank: dict[str, int] = RANK) -> str | None:
    """text with each union of overlapping spans replaced by mark."""
    if not text:
        return text
    out, at, end = [], 0, 0
    for _, a, b in sorted(spans(text, rank=rank), key=lambda s: s[1:]):
        if a >= end:
            out += [text[at:a], mark] if a > end or not out else []
            at = end = b
        else:
            at = end = max(end, b)
    return "".join([*out, text[at:]])


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY, flush: int = 200_000) -> list[str]:
    """The most frequent lower-case words of letters over all documents, first the most frequent. Values in credential contexts don't count.

    A task adds its words up and hands on at most `flush` of them at a time; sums are by word, and the driver gets `most` words."""
    least, longest = WORD_LETTERS
    letters = re.compile(rf"(?<![^\W_])[^\W\d_]{{{least},{longest}}}(?![^\W_])")

    def count(batches):
        n = Counter()

        def batch():
            got = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
            n.clear()
            return got

        for rows in batches:
            for text in rows.column(0):
                text = text.as_py()
                if not text:
                    continue
                low = text.lower()
                if _may_hold(low) and len(low) == len(text):
                    at, kept = 0, []
                    for m in CONTEXT.finditer(text):
                        kept.append(low[at : m.start()])
                        at = m.end()
                    low = " ".join([*kept, low[at:]])
                n.update(letters.findall(low))
                if len(n) >= flush:
                    yield batch()
        yield batch()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(releasing(count), "word string, n long")
    counted = cut(rows.groupBy("word").agg(F.sum("n").alias("n")))
    # A histogram of the counts (some hundred rows) says which counts matter; those words go to eight tasks, which hand `most` rows each to the driver.
    level = F.floor(4 * F.log2("n")).cast("int")
    enough, least_level = 0, 0
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        least_level, enough = r["level"], enough + r["words"]
        if enough >= most:
            break
    best = counted.where(level >= least_level).repartition(8, "word").orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in best.collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = MIN_LOG10, words: list[str] | None = None) -> DataFrame:
    """id_col, spans array<struct<kind,start,end>>, redacted. A map over the scan: no shuffle, whatever the keys. words: the dictionary, else the table's own."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, text_col) if words is None else words)  # DICTIONARY words at most
    kind = rows.schema["id"].dataType
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("spans", pa.list_(span)), ("redacted", pa.string())])

    def run(batches):
        rank = ranks(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans(t, min_log10, rank) for t in texts]
            said = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), said, pa.array([redact(t, rank=rank) if f else t for t, f in zip(texts, found, strict=True)], pa.string())], schema=schema)

    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, spans array<struct<kind:string,start:int,end:int>>, redacted string")
