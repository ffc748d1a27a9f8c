"""Sources and sinks of traces and graphs: JSON lines, trees of files, answer datasets, samples, labels, signatures, manifests."""

from __future__ import annotations

import json
import os
import platform
import subprocess
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.graph import from_canonical_json, to_canonical_json
from ..schema import TRACE


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def traces(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Traces of JSON lines; blank lines are skipped, lines that aren't JSON give a row of nulls. A path that isn't there: no rows, if missing_ok."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], TRACE)
    return spark.read.schema(TRACE).json(path)


def graphs(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Graphs of JSON lines (nested or flat), or of a folder of *.json files with one graph each."""
    if whole_files:
        rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    else:
        rows = spark.read.text(path)
    return from_canonical_json(rows.where(F.trim("value") != "").withColumnRenamed("value", "json"))


def write_traces(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def export_dataset(rows: DataFrame, path: str):
    """Parquet files in a folder that a datasets library reads as they are; where it is installed, the data set read from there, else None."""
    rows.write.parquet(path)
    try:
        from datasets import load_dataset
    except ImportError:
        return None
    return load_dataset("parquet", data_dir=path)


def write_graphs(rows: DataFrame, path: str) -> None:
    """One canonical JSON object a line (node text isn't part of it)."""
    rows.select(to_canonical_json().alias("value")).write.text(path)


def write_graphs_with_text(rows: DataFrame, path: str) -> None:
    """Nodes keep their text; spans, model and metadata are left out."""
    nodes = F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), n["type"].alias("type"), n["text"].alias("text")))
    rows.select("trace_id", nodes.alias("nodes"), F.transform("edges", lambda e: F.array(e["src"], e["dst"])).alias("edges")).write.json(path)


def math_tree(spark: SparkSession, path: str, levels: list[int] | None = None) -> DataFrame:
    """Problems below "Level N/Type/": level and subject come from the path."""
    rows = spark.read.schema("problem string, solution string").option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = rows.withColumn("level", F.regexp_extract(at, r"Level (\d+)/", 1).try_cast("int")).withColumn("subject", F.regexp_extract(at, r"Level \d+/([^/]+)/", 1))
    return rows.where(F.col("level").isin(levels)) if levels else rows


def answers(rows: DataFrame, question: str = "question", answer: str = "answer", parser: str = "auto", domain: str = "math", source: str = "", mapper=None, least_words: int = 5) -> DataFrame:
    """Trace records of question and answer columns. parser: gsm8k, math, plain or auto; mapper: DataFrame -> DataFrame instead.

    Texts of fewer than least_words words are dropped. The number of an answer is its last.
    """
    if mapper is not None:
        return mapper(rows)
    parse = {"gsm8k": T.parse_gsm8k, "math": T.parse_math, "plain": lambda c: F.struct(T.strip(c).alias("cot"), F.lit("").alias("answer")), "auto": T.parse_auto}[parser]
    optional = lambda c, kind: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
    p = rows.select(F.col(question).alias("question"), parse(F.coalesce(F.col(answer), F.lit(""))).alias("p"), optional("subject", "string"), optional("answer_correct", "boolean"), _level(rows))
    p = p.withColumn("cot_text", F.col("p.cot")).where(T.word_count(F.col("cot_text")) >= least_words)
    return p.select(
        "cot_text", F.lit(source).alias("model"), F.md5(F.coalesce("question", F.lit(""))).alias("question_id"), F.lit(domain).alias("domain"), F.col("p.answer").alias("answer"),
        F.coalesce("answer_correct", F.lit(True)).alias("answer_correct"), T.word_count(F.col("cot_text")).alias("cot_length_tokens"), "question", F.lit(source).alias("dataset_source"), "level", "subject", T.last_number(F.col("p.answer")).alias("answer_num"),
    )


def _level(rows: DataFrame) -> Column:
    return (F.regexp_extract(F.col("level").cast("string"), r"(\d+)", 1).try_cast("int") if "level" in rows.columns else F.lit(None).cast("int")).alias("level")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed: those with the least MD5 of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def stratified(rows: DataFrame, n: int, by: str = "domain", key: str = "trace_id", seed: int = 42) -> DataFrame:
    """n rows of each stratum, as `sampled` draws them, with sample_rank. The window keeps n rows a group before it shuffles."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key)
    return rows.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """trace_id, correct of JSON lines with question_id or trace_id; without a label true; the last of an id counts."""
    rows = spark.read.schema("question_id string, trace_id string, correct boolean").json(path).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.select(F.coalesce("question_id", "trace_id").alias("trace_id"), F.coalesce("correct", F.lit(True)).alias("correct"), "_at")
    return rows.groupBy("trace_id").agg(F.max_by("correct", "_at").alias("correct"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Texts with the ids of their redundant nodes."""
    rows = spark.read.schema("question_id string, cot_text string, answer string, redundant array<int>").json(path)
    return rows.withColumn("redundant", F.array_distinct(F.coalesce("redundant", F.array().cast("array<int>"))))


def write_signatures(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("model").parquet(path)


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_dir(base: str, command: str, now: datetime | None = None) -> str:
    path = os.path.join(base, f"{(now or datetime.now(UTC)).strftime('%Y%m%d_%H%M%S')}_{command}")
    os.makedirs(path, exist_ok=True)
    return path


def write_manifest(path: str, command: str, args: dict, spark: SparkSession | None = None) -> dict:
    try:
        commit = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip()
    except OSError:
        commit = ""
    said = {"command": command, "started_at": datetime.now(UTC).isoformat(), "git_commit": commit or "unknown", "python_version": platform.python_version(), "spark_version": spark.version if spark else "", "args": {k: str(v) for k, v in args.items()}}
    with open(os.path.join(path, "manifest.json"), "w", encoding="utf-8") as out:
        json.dump(said, out, indent=2)
    return said


def humaneval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("task_id string, prompt string, canonical_solution string, test string, entry_point string").json(path)


def write_motif_catalog(spark: SparkSession, path: str) -> None:
    from ..schema import MOTIFS

    rows = [(m, shape, list(counted or ()), list(typed)) for m, (shape, counted, typed) in MOTIFS.items()]
    spark.createDataFrame(rows, "motif_id string, shape string, counted array<string>, typed array<string>").coalesce(1).write.json(path)


def read_motif_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("motif_id string, shape string, counted array<string>, typed array<string>").json(path)


def mixed(parts: list[DataFrame], each: int) -> DataFrame:
    """The first `each` rows of each source, as one table."""
    out = None
    for p in parts:
        part = p.limit(each)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stream_answers(spark: SparkSession, path: str, **kw) -> DataFrame:
    """A stream of trace records from a folder of JSON lines that grows."""
    return answers(spark.readStream.schema("question string, answer string, subject string, level string, answer_correct boolean").json(path), **kw)
