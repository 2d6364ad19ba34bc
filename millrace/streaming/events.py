"""The same operators on streams: windows over events, and deduplication without an end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import hash_exact
from ..operators import dedup


def _timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """A stream's watermark, on a time without zone too."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if rows.isStreaming else rows


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by tumbling window and type; late rows are taken up to `late`."""
    timed = _timed(events, "ts", late)
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: events no farther apart than `gap`."""
    timed = _timed(events, "ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_texts(rows: DataFrame, text: str, time: str, within: str = "1 day") -> DataFrame:
    """The first row of each text within a time; on a stream the state is bounded by the watermark."""
    keyed = rows.withColumn("__key", hash_exact(F.col(text)))
    if rows.isStreaming:
        return _timed(keyed, time, within).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
    return keyed.dropDuplicates(["__key"]).drop("__key")


def gate_batches(rows: DataFrame, text: str, order: str, state_path: str, out_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Exact keep-first deduplication of a stream against all that it kept before, batch by batch, with Parquet state.

    A batch that is repeated after a failure writes the same folders again, so that nothing is kept twice.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        from ..plans import storage

        spark = df.sparkSession
        known = None
        if storage.path_exists(spark, state_path):
            known = spark.read.parquet(state_path).where(F.col("batch") != batch_id).select("key")
        kept = storage.stash(dedup.keep_first(df, hash_exact(F.col(text)), order, known), "batch")
        kept.select(F.col("__key").alias("key")).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
        kept.drop("__key").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
