"""The registered queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, neardup, packing, quality, secrets, sharding, topk, toxicity, warc
from .common import shared_path, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents"))
    named = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_sharding, op3_secrets, op4_packing, op5_warc, op6_toxicity, op7_neardup, op8_topk, op9_decontaminate, op10_quality)}

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {bits}) & 31)::INTEGER + 1, 1)" for k in range(8) for bits in (15, 10, 5, 0))
_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')"
_RUNS = "list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))"
_WEIGHED = "SELECT {key}, r, length(r) * count(*) AS v FROM (SELECT {key}, unnest({runs}) AS r FROM {src}) GROUP BY {key}, r"

#: The others can't be said in SQL (BPE, sampled splitters, offsets of matches, packing, fitted models, consistent sampling): tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(x)) AS n, {_DIGITS} AS digest FROM p), m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m""",
    "op8_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    # Windows at runs in common, as the operator has them: others have a similarity of 0. The fingerprints' radius leaves no pair of these tables out.
    "op9_decontaminate": f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text <> ''), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text <> ''),
dr AS (SELECT doc_id, unnest(range(1, len(r) + 1)) AS p, unnest(r) AS r FROM (SELECT doc_id, {_RUNS} AS r FROM dw WHERE len(w) >= 5)),
ir AS (SELECT item_id, n, unnest(range(1, len(r) + 1)) AS o, unnest(r) AS r FROM (SELECT item_id, len(w) AS n, {_RUNS} AS r FROM iw WHERE len(w) >= 5)),
hit AS (SELECT DISTINCT doc_id, item_id, greatest(p - o, 0) AS s, n FROM dr JOIN ir USING (r)),
win AS (SELECT hit.doc_id, hit.item_id, hit.s, dw.w[hit.s + 1:hit.s + hit.n] AS w FROM hit JOIN dw ON dw.doc_id = hit.doc_id),
ww AS ({_WEIGHED.format(key="doc_id, item_id, s", runs=_RUNS, src="win")}), iv AS ({_WEIGHED.format(key="item_id", runs=_RUNS, src="iw")}),
wt AS (SELECT doc_id, item_id, s, sum(v) AS t FROM ww GROUP BY doc_id, item_id, s), it AS (SELECT item_id, sum(v) AS t FROM iv GROUP BY item_id),
bo AS (SELECT ww.doc_id, ww.item_id, ww.s, sum(least(ww.v, iv.v)) AS b FROM ww JOIN iv ON iv.item_id = ww.item_id AND iv.r = ww.r GROUP BY ww.doc_id, ww.item_id, ww.s),
si AS (SELECT bo.doc_id, bo.item_id, max(b / (wt.t + it.t - b)) AS similarity FROM bo JOIN wt ON wt.doc_id = bo.doc_id AND wt.item_id = bo.item_id AND wt.s = bo.s JOIN it ON it.item_id = bo.item_id GROUP BY bo.doc_id, bo.item_id)
SELECT doc_id, item_id, round(similarity, 6) AS similarity FROM si WHERE similarity >= 0.8""",
}
