"""A training corpus from `documents`: quality, near-duplicates, benchmark passages, secrets, token ids.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`.

Defined results: a row is known by its doc_id and text together, so rows that share an id but not the text, and rows without id, are judged each
by its own text. A null text counts as empty. Of wholly equal rows (id and text) the near-duplicate stage keeps one. Texts of any length are taken
whole. An empty table gives an empty table. Tables that a stage needs besides docs (labels, benchmark) may be empty: the stage then keeps all.
Further columns are kept, whatever their names (the stages' own begin with "_ponderloom_").
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ponderloom.llm import bpe, decontaminate, neardup, quality, secrets
from ponderloom.llm.common import shared_path, table


ID, KEY = "_ponderloom_id", "_ponderloom_key"


def text_key(column="text"):
    """MD5 of a text; that of the empty text for null."""
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the threshold. The model is fitted on the labelled rows of the stage's own input."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out_col="_ponderloom_score").where(F.col("_ponderloom_score") >= quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: of those with its least id, that with the class's key; of equal rows, one. The names of the rows that stay
    (id and key) meet the documents in one join; equal rows are brought together only where a name stands for several."""
    found = neardup.near_duplicates(docs).where("text_key = class_key and doc_id <=> class_id")
    named = found.groupBy(F.col("doc_id").alias(ID), F.col("text_key").alias(KEY)).agg(F.count("*").alias("_ponderloom_n"))
    rows = docs.withColumn("_ponderloom_own", text_key())
    kept = rows.join(named, F.col("doc_id").cast("long").eqNullSafe(F.col(ID)) & (F.col("_ponderloom_own") == F.col(KEY)))
    several = kept.where("_ponderloom_n > 1").dropDuplicates([ID, KEY])
    return kept.where("_ponderloom_n = 1").unionByName(several).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no passage of the benchmark. Texts aren't shuffled where the found names can be broadcast (Spark's size check)."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), by_text=True).select(F.col("doc_id").alias(ID), F.col("text_key").alias(KEY)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(ID)) & (text_key() == F.col(KEY)), "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows. The dictionary is the stage's own input's."""
    shared = spark.sparkContext.broadcast(secrets.frequent_words(docs))  # secrets.DICTIONARY words at most

    @F.pandas_udf("string")
    def redacted(texts):
        rank = secrets.ranks(shared.value)
        return texts.map(lambda t: secrets.redact(t, rank=rank), na_action="ignore")

    text = redacted(F.col("text").cast("string"))
    return docs.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    return bpe.encode(docs).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("bpe", to_tokens)]

#: Shingle sampling, regular expressions on code points and BPE aren't SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
