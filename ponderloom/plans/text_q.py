"""Queries on text: sentences, length types, parsers, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import DOUBT, KEYWORDS, NEGATIONS, PRIORITY, pattern
from ..operators.graph import extract_by_length, long_edges, long_nodes, to_canonical_json
from ..schema import TYPES
from .fixtures import LENGTH_SQL, ORDER_SQL, WORDS_SQL, doc_traces, order_cots, order_graphs, sentences_sql, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


DOC_S = "WITH st AS (" + sentences_sql("documents", "doc_id", "text", ", lang") + ")"


@query(DOC_S + " SELECT doc_id AS trace_id, pos::INTEGER AS pos, s AS sentence FROM st")
def sentence_split(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("trace_id"), F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select("trace_id", (F.col("pos") + 1).alias("pos"), "sentence")


@query(DOC_S + f" SELECT doc_id AS trace_id, count(*) AS n_sentences, sum({WORDS_SQL})::BIGINT AS n_words, max({WORDS_SQL})::INTEGER AS most_words FROM st GROUP BY doc_id")
def sentence_word_counts(spark, sf):
    s = table(spark, sf, "documents").select(F.col("doc_id").alias("trace_id"), F.transform(T.split_sentences(F.col("text")), T.word_count).alias("w")).where(F.size("w") > 0)
    return s.select("trace_id", F.size("w").cast("long").alias("n_sentences"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"), F.array_max("w").alias("most_words"))


def _length_graphs(spark, sf):
    return extract_by_length(doc_traces(spark, sf))


@query(DOC_S + f" SELECT doc_id AS trace_id, pos::INTEGER AS node_id, {LENGTH_SQL} AS type FROM st")
def len_nodes(spark, sf):
    return long_nodes(_length_graphs(spark, sf)).select("trace_id", "node_id", "type")


@query(DOC_S + " SELECT doc_id AS trace_id, pos::INTEGER AS node_id, (sum(length(s) + 1) OVER w - length(s) - 1)::INTEGER AS span_start, (sum(length(s) + 1) OVER w - 1)::INTEGER AS span_end FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def len_spans(spark, sf):
    return long_nodes(_length_graphs(spark, sf)).select("trace_id", "node_id", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"))


@query(DOC_S + f" SELECT lang, {LENGTH_SQL} AS type, count(*) AS n FROM st GROUP BY ALL")
def len_type_mix_by_lang(spark, sf):
    s = table(spark, sf, "documents").select("lang", F.explode(T.split_sentences(F.col("text"))).alias("s"))
    return s.groupBy("lang", T.length_type(F.col("s")).alias("type")).agg(F.count("*").alias("n"))


ANSWERS = ORDER_SQL + r""", raw AS (SELECT trace_id, CASE trace_id % 3 WHEN 0 THEN cot_text || ' #### ' || trace_id WHEN 1 THEN cot_text || ' So \boxed{' || trace_id || '} is it.' ELSE cot_text END AS raw FROM cots)"""


def _answers(spark, sf):
    c = order_cots(spark, sf)
    raw = F.when(F.col("trace_id") % 3 == 0, F.concat("cot_text", F.lit(" #### "), F.col("trace_id").cast("string"))).when(F.col("trace_id") % 3 == 1, F.concat("cot_text", F.lit(" So \\boxed{"), F.col("trace_id").cast("string"), F.lit("} is it."))).otherwise(F.col("cot_text"))
    return c.select("trace_id", raw.alias("raw"))


@query("WITH " + ANSWERS + " SELECT trace_id, trim(string_split_regex(raw, '\\s*####\\s*')[1]) AS cot, CASE WHEN contains(raw, '####') THEN trim(string_split_regex(raw, '\\s*####\\s*')[2]) ELSE '' END AS answer FROM raw")
def gsm8k_parse(spark, sf):
    return _answers(spark, sf).select("trace_id", T.parse_gsm8k(F.col("raw")).alias("p")).select("trace_id", "p.cot", "p.answer")


@query("WITH " + ANSWERS + r" SELECT trace_id, CASE WHEN contains(raw, '\boxed') THEN trim(regexp_replace(string_split(raw, '\boxed')[1], '\s+', ' ', 'g')) ELSE trim(raw) END AS cot, CASE WHEN contains(raw, '\boxed') THEN regexp_extract(raw, '\\boxed\{(.*?)\}', 1) ELSE '' END AS answer FROM raw")
def math_parse(spark, sf):
    return _answers(spark, sf).select("trace_id", T.parse_math(F.col("raw")).alias("p")).select("trace_id", "p.cot", "p.answer")


@query("WITH " + ANSWERS + r" SELECT CASE WHEN contains(raw, '####') THEN 'gsm8k' WHEN contains(raw, '\boxed') THEN 'math' ELSE 'plain' END AS parser, count(*) AS n FROM raw GROUP BY ALL")
def sniff_parser(spark, sf):
    return _answers(spark, sf).groupBy(T.sniff(F.col("raw")).alias("parser")).agg(F.count("*").alias("n"))


@query("SELECT trace_id, domain, sample_rank FROM (SELECT doc_id AS trace_id, lang AS domain, (row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id))::INTEGER AS sample_rank FROM documents) WHERE sample_rank <= 20")
def stratified_sample(spark, sf):
    from ..sources.readers import stratified

    return stratified(table(spark, sf, "documents").select(F.col("doc_id").alias("trace_id"), F.col("lang").alias("domain")), 20, seed=42)


# Rules

ORDER_S = "WITH " + ORDER_SQL + ", st AS (" + sentences_sql("cots", "trace_id", "cot_text") + ")"
_EDGES = (r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])")
_q = lambda p: "'" + p.replace("'", "''") + "'"


def _score_sql(kind: str) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches(low, {_q(pattern(w, _EDGES))}) THEN {x}::DOUBLE ELSE 0::DOUBLE END" for w, x in KEYWORDS[kind]) + ")"


# A boundary's character can be shared by two neighbours in SQL's patterns, as each is looked for alone.
_NEGATED_SQL = "(" + " OR ".join(f"regexp_matches(low, {_q(p)})" for p in NEGATIONS) + ")"
SCORED = ORDER_S + ", sc AS (SELECT trace_id, pos::INTEGER AS pos, s, lower(s) AS low FROM st), sx AS (SELECT *, " + ", ".join(f"{_score_sql(t)} AS s_{t.lower()}" for t in TYPES) + f", {_NEGATED_SQL} AS negated, regexp_matches(low, '\\w+\\s*=\\s*\\w+') AS equation, regexp_matches(low, {_q(DOUBT)}) AS doubt FROM sc)"
_TOP = "greatest(" + ", ".join(f"{{{t}}}" for t in TYPES) + ")"


def _type_sql(boost: str, sure: str) -> str:
    score = {t: f"s_{t.lower()}" + (boost if t == "Transform" else "") for t in TYPES}
    top = _TOP.format(**score)
    pick = " ".join(f"WHEN {score[t]} = {top} THEN '{t}'" for t in sorted(TYPES, key=PRIORITY.get, reverse=True))
    return f"CASE WHEN negated THEN 'Transform' WHEN {sure.format(top=top)} THEN (CASE {pick} END) WHEN doubt THEN 'Backtrack' ELSE 'Transform' END"


_BOOST = " + CASE WHEN equation THEN 0.5::DOUBLE ELSE 0::DOUBLE END"
RULE_TYPE_SQL = _type_sql(_BOOST, "{top} >= 0.3")
_ALL = "(" + " + ".join(f"s_{t.lower()}" for t in TYPES) + ")"
DETAIL_SQL = _type_sql("", f"({{top}} >= 0.3 AND {{top}} / nullif({_ALL}, 0) >= 0.3)")


def _sentences(spark, sf):
    s = order_cots(spark, sf).select("trace_id", F.posexplode(T.split_sentences(F.col("cot_text"))).alias("pos", "s"))
    return s.withColumn("pos", F.col("pos") + 1)


@query(SCORED + " SELECT trace_id, pos, " + ", ".join(f"s_{t.lower()}" for t in TYPES) + " FROM sx")
def rbe_scores(spark, sf):
    return _sentences(spark, sf).select("trace_id", "pos", *[c.alias(f"s_{t.lower()}") for t, c in T.keyword_scores(F.col("s")).items()])


@query(SCORED + f" SELECT trace_id, pos, {RULE_TYPE_SQL} AS type FROM sx")
def rbe_types(spark, sf):
    return _sentences(spark, sf).select("trace_id", "pos", T.rule_type(F.col("s")).alias("type"))


@query(SCORED + f" SELECT trace_id, pos, {DETAIL_SQL} AS type, round(CASE WHEN negated THEN 0.3::DOUBLE WHEN {_TOP.format(**{t: f's_{t.lower()}' for t in TYPES})} >= 0.3 AND {_TOP.format(**{t: f's_{t.lower()}' for t in TYPES})} / nullif({_ALL}, 0) >= 0.3 THEN {_TOP.format(**{t: f's_{t.lower()}' for t in TYPES})} / {_ALL} ELSE 0.2::DOUBLE END, 6) AS confidence FROM sx")
def rbe_types_detailed(spark, sf):
    return _sentences(spark, sf).select("trace_id", "pos", T.rule_detail(F.col("s")).alias("d")).select("trace_id", "pos", "d.type", F.round("d.confidence", 6).alias("confidence"))


@query(SCORED + " SELECT s AS sentence, negated, count(*) AS n FROM sx GROUP BY ALL")
def rbe_negated(spark, sf):
    return _sentences(spark, sf).groupBy(F.col("s").alias("sentence")).agg(F.count("*").alias("n")).select("sentence", T.negated(F.col("sentence")).alias("negated"), "n")


RBE_ND = SCORED + f""", ty AS (SELECT trace_id, pos, s, {RULE_TYPE_SQL} AS type FROM sx),
cut AS (SELECT *, CASE WHEN type = 'Transform' AND lag(type) OVER (PARTITION BY trace_id ORDER BY pos) = 'Transform' THEN 0 ELSE 1 END AS fresh FROM ty),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY pos) AS id FROM cut),
nd AS (SELECT trace_id, id::INTEGER AS id, min(type) AS type, string_agg(s, ' ' ORDER BY pos) AS text, arg_max(s, pos) AS last FROM isl GROUP BY trace_id, id),
nn AS (SELECT *, max(id) OVER (PARTITION BY trace_id) AS n FROM nd),
ed AS (SELECT trace_id, id AS src, (id + 1)::INTEGER AS dst FROM nn WHERE id + 1 <= n UNION ALL SELECT trace_id, id, (id + 2)::INTEGER FROM nn WHERE type = 'Branch' AND id + 2 <= n)"""


@query(RBE_ND + " SELECT trace_id, id AS node_id, type, text FROM nd")
def rbe_nodes(spark, sf):
    return long_nodes(order_graphs(spark, sf)).select("trace_id", "node_id", "type", "text")


@query(RBE_ND + " SELECT trace_id, src, dst FROM ed")
def rbe_edges(spark, sf):
    return long_edges(order_graphs(spark, sf)).select("trace_id", "src", "dst")


# Texts are joined by one blank. A node's end is the first place of its last sentence after its start: earlier than the text's end if the sentence comes twice.
@query(RBE_ND + " SELECT trace_id, id AS node_id, (sum(length(text) + 1) OVER w - length(text) - 1)::INTEGER AS span_start, (sum(length(text) + 1) OVER w - length(text) - 1 + instr(text, last) - 1 + length(last))::INTEGER AS span_end FROM nd WINDOW w AS (PARTITION BY trace_id ORDER BY id ROWS UNBOUNDED PRECEDING)")
def rbe_spans(spark, sf):
    return long_nodes(order_graphs(spark, sf)).select("trace_id", "node_id", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"))


@query(RBE_ND + """, sp AS (SELECT trace_id, id, type, (sum(length(text) + 1) OVER w - length(text) - 1)::INTEGER AS a, (sum(length(text) + 1) OVER w - length(text) - 1 + instr(text, last) - 1 + length(last))::INTEGER AS b FROM nd WINDOW w AS (PARTITION BY trace_id ORDER BY id ROWS UNBOUNDED PRECEDING)),
nj AS (SELECT trace_id, string_agg('{"id":' || id || ',"type":"' || type || '","span":[' || a || ',' || b || ']}', ',' ORDER BY id) AS j FROM sp GROUP BY trace_id),
ej AS (SELECT trace_id, string_agg('[' || src || ',' || dst || ']', ',' ORDER BY src, dst) AS j FROM ed GROUP BY trace_id)
SELECT nj.trace_id, md5('{"trace_id":' || nj.trace_id || ',"graph":{"nodes":[' || nj.j || '],"edges":[' || coalesce(ej.j, '') || ']}}') AS json_md5 FROM nj LEFT JOIN ej ON nj.trace_id = ej.trace_id""")
def rbe_graph_json(spark, sf):
    return order_graphs(spark, sf).select("trace_id", F.md5(to_canonical_json()).alias("json_md5"))
