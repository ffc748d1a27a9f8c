"""Bounded samples of labelled rows, for the classifiers, with what is held out of training left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A classifier is fitted on so many labelled documents at most: those with the least hash of their id.
SAMPLE = 16_000


def held_out(id_col, modulus: int, remainder: int):
    """crc32 of the id as text; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """(at, y, text) of the sample: at orders it. Labels of an id that differ count as their greatest; null labels don't count.

    The chosen ids (bound rows at most) are broadcast to the scan of the documents; only their texts move.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("y")).where("_id is not null and y is not null")
    rows = rows.where(~held_out("_id", modulus, remainder)).groupBy("_id").agg(F.max("y").alias("y"))
    chosen = rows.withColumn("at", F.xxhash64("_id", F.lit(11))).orderBy("at", "_id").limit(bound)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("at", "y", "text")
