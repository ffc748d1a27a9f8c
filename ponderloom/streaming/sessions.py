"""Traces from streams of events: sessions of a user, with late events up to a watermark. Works on batches and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n_nodes, types): a trace for each run of events with gaps below `gap`. On a stream, state is dropped after `late`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    kind = F.expr("case event_type when 'view' then 'R' when 'purchase' then 'V' when 'signup' then 'B' when 'error' then 'K' else case when value >= 50 then 'C' else 'T' end end")
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_nodes"), F.array_sort(F.collect_list(F.struct("ts", "event_id", kind.alias("c")))).alias("e"))
    return out.select("user_id", F.col("w.start").alias("start"), "n_nodes", F.array_join(F.transform("e", lambda x: x["c"]), "").alias("codes"))


def windowed_types(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
