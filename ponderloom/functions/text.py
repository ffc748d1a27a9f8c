"""Sentences, node types of sentences, answer parsers and text scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TYPES
from .lexicon import DOUBT, EQUATION, KEYWORDS, NEGATIONS, PRIORITY, pattern, stem



def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_sentences(text: Column) -> Column:
    """Sentences, without blanks around them and without empty ones. English and Chinese marks; then lines."""
    text = F.replace(F.replace(F.replace(text, F.lit("\n\n"), F.lit("\n")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    marked = F.split(text, r"(?<=[.!?。！？])\s*(?=[A-Z\u4e00-\u9fff])")
    lines = F.flatten(F.transform(marked, lambda s: F.split(strip(s), "\n")))
    return F.filter(F.transform(lines, strip), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def length_type(sentence: Column) -> Column:
    """The baseline that only looks at length: up to 5, 12, 20 words, more."""
    return once(word_count(sentence), lambda n: F.when(n <= 5, "Retrieve").when(n <= 12, "Transform").when(n <= 20, "Verify").otherwise("Backtrack"))


def negated(sentence: Column) -> Column:
    return _negated(F.lower(sentence))


def once(value: Column, made) -> Column:
    """made(value), with value worked out a single time: it is bound to a lambda's variable."""
    return F.get(F.transform(F.array(value), lambda v: made(v)), F.lit(0))


def keyword_scores(sentence: Column) -> dict[str, Column]:
    """Weights of the keywords found, by type; each keyword once."""
    return _scores(strip(F.lower(sentence)))


def _scores(low: Column) -> dict[str, Column]:
    """A search for a keyword's stem goes before its pattern: most keywords are in few sentences."""
    found = lambda w: F.contains(low, F.lit(stem(w))) & F.rlike(low, F.lit("(?U)" + pattern(w)))
    return {kind: sum((F.when(found(w), F.lit(x)).otherwise(F.lit(0.0)) for w, x in words), F.lit(0.0)) for kind, words in KEYWORDS.items()}


def matched_keywords(sentence: Column, kind: str) -> Column:
    low = strip(F.lower(sentence))
    return F.filter(F.array(*[F.when(F.rlike(low, F.lit("(?U)" + pattern(w))), F.lit(w)) for w, _ in KEYWORDS[kind]]), lambda w: w.isNotNull())


def _best(scores: dict[str, Column]) -> Column:
    return F.array_max(F.array(*[F.struct(scores[t].alias("score"), F.lit(PRIORITY[t]).alias("priority"), F.lit(t).alias("type")) for t in TYPES]))


def _fallback(low: Column) -> Column:
    return F.when(F.rlike(low, F.lit(DOUBT)), "Backtrack").otherwise("Transform")


def _negated(low: Column) -> Column:
    return F.rlike(low, F.lit("(?U)" + "|".join(f"(?:{p})" for p in NEGATIONS)))


def rule_type(sentence: Column, threshold: float = 0.3) -> Column:
    """Node type by weighted keywords; negation means Transform; an equation adds half a point to Transform."""

    def made(low: Column) -> Column:
        scores = _scores(low)
        scores["Transform"] = scores["Transform"] + F.when(F.rlike(low, F.lit("(?U)" + EQUATION)), F.lit(0.5)).otherwise(F.lit(0.0))
        sure = once(_best(scores), lambda b: F.when(b["score"] >= threshold, b["type"]))
        return F.when(_negated(low), "Transform").otherwise(F.coalesce(sure, _fallback(low)))

    return once(strip(F.lower(sentence)), made)


def rule_detail(sentence: Column, threshold: float = 0.3) -> Column:
    """struct<type, confidence, fallback>: without the equation's half point; the best score must also hold 0.3 of all."""

    def made(low: Column) -> Column:
        scores = F.array(*[F.struct(c.alias("score"), F.lit(PRIORITY[t]).alias("priority"), F.lit(t).alias("type")) for t, c in _scores(low).items()])
        return once(scores, lambda all_of: once(F.array_max(all_of), lambda best: said(low, best, F.aggregate(all_of, F.lit(0.0), lambda a, x: a + x["score"]))))

    def said(low: Column, best: Column, total: Column) -> Column:
        share = F.when(total > 0, best["score"] / total).otherwise(F.lit(0.0))
        sure = (best["score"] >= threshold) & (share >= 0.3)
        return F.struct(
            F.when(_negated(low), "Transform").when(sure, best["type"]).otherwise(_fallback(low)).alias("type"),
            F.when(_negated(low), 0.3).when(sure, share).otherwise(F.lit(0.2)).alias("confidence"),
            (_negated(low) | ~sure).alias("fallback"),
        )

    return once(strip(F.lower(sentence)), made)


# Answer parsers


def sniff(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("####")), "gsm8k").when(F.contains(text, F.lit("\\boxed")), "math").otherwise("plain")


def parse_gsm8k(text: Column) -> Column:
    parts = F.split(text, r"\s*####\s*")
    return F.struct(strip(F.get(parts, 0)).alias("cot"), F.when(F.size(parts) >= 2, strip(F.get(parts, 1))).otherwise("").alias("answer"))


_BOXED = r"(?s)\\boxed\{(.*?)\}"
_SAID = r"(?i)(?:the\s+)?answer\s+is\s+[\":]?\s*(.+?)[.\s]*$"


def parse_math(text: Column) -> Column:
    """Up to the first \\boxed{...}, whose first closing brace ends it; else up to "the answer is ..."."""
    boxed, said = F.rlike(text, F.lit(_BOXED)), F.rlike(text, F.lit(_SAID))
    before = F.regexp_replace(text, r"(?s)\\boxed\{.*?\}.*$", "")
    cot = strip(F.regexp_replace(F.regexp_replace(before, r"\\(?:boxed|text)\{.*?\}", ""), r"\s+", " "))
    return F.struct(
        F.when(boxed, cot).when(said, strip(F.regexp_replace(text, _SAID, ""))).otherwise(strip(text)).alias("cot"),
        F.when(boxed, strip(F.regexp_extract(text, _BOXED, 1))).when(said, strip(F.regexp_extract(text, _SAID, 1))).otherwise("").alias("answer"),
    )


def parse_auto(text: Column) -> Column:
    kind = sniff(text)
    plain = F.struct(strip(text).alias("cot"), F.lit("").alias("answer"))
    return F.when(kind == "gsm8k", parse_gsm8k(text)).when(kind == "math", parse_math(text)).otherwise(plain)


def last_number(text: Column) -> Column:
    return F.try_element_at(F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+\.?\d*"), F.lit(0)), lambda x: x.try_cast("double")), F.lit(-1))


# Scores of text


def tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(strip(F.lower(text)), r"\s+")), lambda w: w != "")


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


#: Words of hedging.
HEDGES = ("maybe", "perhaps", "possibly", "probably", "likely", "i think", "i believe", "it seems", "might", "could be", "unclear", "not sure", "guess", "assume", "suppose", "roughly", "approximately", "seems like", "appears to", "tentatively")


def _clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _flag(c: Column, yes: float) -> Column:
    return F.when(c, F.lit(yes)).otherwise(F.lit(0.0))


def calibration_score(text: Column, kind: Column) -> Column:
    """Confidence of a step: less for hedges and extreme lengths, more for numbers, operators and checking words."""
    low, n = F.lower(text), word_count(text)
    hedges = sum((F.contains(low, F.lit(h)).cast("int") for h in HEDGES), F.lit(0))
    off = F.least(F.lit(0.45), hedges * 0.10) + F.when(n < 3, 0.20).when(n > 60, 0.10).otherwise(F.lit(0.0))
    signs = F.rlike(text, F.lit(r"[=+\-*/^]"))
    plus = _flag(F.rlike(text, F.lit(r"\d")), 0.08) + _flag(signs, 0.06) + _flag((kind == "Verify") & F.rlike(low, F.lit("correct|check|indeed|valid")), 0.06)
    return _clip(F.lit(1.0) - off + plus)


def reward_score(text: Column, before: Column) -> Column:
    """Progress of a step against the step before (null or empty: none)."""
    now, prev = tokens(text), tokens(before)
    some = F.coalesce(before != "", F.lit(False))
    new = F.size(F.array_except(now, prev)) / F.greatest(F.size(now), F.lit(1))
    novelty = F.when(some & (F.size(now) > 0), F.when(new < 0.15, -0.22).when(new > 0.60, 0.08).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    first = F.lower(F.get(F.split(strip(text), r"\s+"), 0))
    vague = some & first.isin("it", "this", "that", "they") & ~F.rlike(F.lower(before), F.lit("result|value|answer|sum|product"))
    return _clip(F.lit(0.72) + novelty - _flag(vague, 0.12) - _flag(word_count(text) < 2, 0.15))
