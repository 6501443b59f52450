"""Continuous ingest of trace files, live call sessions on one strong key, and a feed of their anomalies.

Links over several keys can merge calls long after they ended, so they stay with the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calltrace.operators.anomalies import session_anomalies
from calltrace.sources.traces import trace_lines


def trace_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files as ``(path, file_name, content)``; a file is one row, so no record straddles a batch."""
    reader = spark.readStream.option("wholetext", "true").option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    out = reader.schema("value string").format("text").load(folder)
    return out.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """Parse each batch of new files and write its events under its batch number, so that a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        parse(trace_lines(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return trace_stream(spark, folder).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_sessions(events: DataFrame, key: str = "call_id", gap: str = "45 seconds", late: str = "2 minutes") -> DataFrame:
    """Sessions of a stream of events: those of one key no further apart than ``gap``; events later than ``late`` are not merged."""
    x = events.where(F.col(key).isNotNull()).withWatermark("ts", late)
    out = x.groupBy(F.session_window("ts", gap).alias("w"), F.col(key)).agg(
        F.count("*").alias("event_count"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.min("calling_number").alias("calling_number"), F.min("called_number").alias("called_number"), F.array_sort(F.collect_set("protocol")).alias("protocols"),
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "message_type", "protocol"))).alias("events"),
    )
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_count", "start_time", "end_time", "calling_number", "called_number", "protocols", "events")


def session_feed(sessions: DataFrame, events: DataFrame | None = None, key: str = "call_id") -> DataFrame:
    """Anomalies of closed sessions (a batch of :func:`live_sessions`), by the session rules."""
    x = sessions.select(F.concat_ws("@", key, "window_start").alias("session_id"), F.explode("events").alias("e")).select("session_id", "e.*")
    null = F.lit(None).cast("string")
    x = x.withColumns({"source": F.lit("stream"), "seq_in_source": F.lit(0).cast("long"), "cause_code": null, "transaction_id": null, "metadata": F.create_map().cast("map<string,string>")})
    return session_anomalies(x, order=("ts", "event_id"))


def anomaly_feed(sessions: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    def sink(batch: DataFrame, number: int) -> None:
        session_feed(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return sessions.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
