"""Incremental ingest with Structured Streaming.

Landed pages arrive as JSON Lines files. ``readStream`` (explicit schema)
feeds the same adapters as the batch path; each micro-batch is applied in
``foreachBatch``:

1. W7 keep-last inside the batch, ordered by (fetch time, page, position);
2. M1 upsert (``Store.apply_batch``): new keys are appended, only partitions
   holding re-sent keys are rewritten;
3. M2 rollup of the touched slices recomputed from the stored records;
4. M3 checkpoint advance per (campaign, source), from the pages themselves:
   a page without records counts as a run, too.

A page that cannot be ingested (a line cut off, an unknown source, a body or a
value that cannot be stored; ``operators/pages.py``) goes to the store's
``quarantine`` table and never stops the stream.

Replaying a page changes nothing but ``updated_at`` (R3). Late rows are
accepted however late (no watermark, R4): its own slice is recomputed, whatever
the day. The
micro-batch is a deterministic function of its input files, so a lost
executor or a restarted query re-runs it with the same result; the query's
own checkpoint lives in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from campaign_metrics.functions.time import floor_to
from campaign_metrics.operators.pages import advance_by_pages, good_records, judge_pages, page_states, quarantined_pages
from campaign_metrics.operators.upsert import RECORD_COLUMNS
from campaign_metrics.sources.feeds import stream_feed_pages
from campaign_metrics.sources.store import Store


def page_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of landed pages (explicit schema, no inference)."""
    return stream_feed_pages(spark, landing, max_files_per_trigger)


def ingest_batch(store: Store, sources: DataFrame, now: Column | None = None) -> Callable[[DataFrame, int], None]:
    """The foreachBatch body: judge, upsert, rebuild, quarantine, advance checkpoints.

    As in the reference, a page with a value that cannot be stored is not
    ingested at all and its (campaign, source) pair is marked ``error``; the
    other pages of the batch go through and advance the pair's cursor.
    """
    def run(pages: DataFrame, batch_id: int) -> None:
        judged = judge_pages(pages, sources).persist()
        try:
            recs = good_records(judged).select(*RECORD_COLUMNS)
            if not recs.isEmpty():
                store.apply_batch(recs)  # keeps the last of each key
            store.quarantine(quarantined_pages(judged), batch_id)
            when = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
            store.write("checkpoints", advance_by_pages(store.read("checkpoints"), page_states(judged), when))
        finally:
            judged.unpersist()
    return run


def start_ingest(spark: SparkSession, landing: str, store: Store, sources: DataFrame, checkpoint_location: str,
                 now: Column | None = None, trigger: str = "availableNow",
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest stream. ``trigger='availableNow'`` drains what has
    landed and stops (scheduled runs); ``'1 minute'`` polls like the reference."""
    writer = page_stream(spark, landing, max_files_per_trigger).writeStream.foreachBatch(
        ingest_batch(store, sources, now)).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if trigger == "availableNow" else writer.trigger(processingTime=trigger)
    return writer.start()


def windowed_activity(records: DataFrame, unit: str = "hour", time_col: str = "timestamp_utc") -> DataFrame:
    """R2: tumbling minute/hour windows per campaign and center (stream or batch).
    The window start equals ``date_trunc(unit, time)``."""
    length = {"hour": "1 hour", "minute": "1 minute"}[unit]
    w = F.window(F.col(time_col).cast("timestamp"), length)
    return (records.groupBy("event_id", w.alias("w"), "center")
            .agg(F.sum("work_unit").alias("weighted"), F.sum(F.col("raw_count").cast("long")).alias("raw"))
            .select("event_id", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "center", "weighted", "raw"))


def start_windowed(spark: SparkSession, landing: str, sources: DataFrame, out_path: str, checkpoint_location: str,
                   unit: str = "hour") -> StreamingQuery:
    """R2 as a stream: complete-mode window totals rewritten to ``out_path``
    every micro-batch (no watermark: late rows still update their window)."""
    recs = good_records(judge_pages(page_stream(spark, landing), sources, payload=False))

    def write(batch: DataFrame, _id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    return (windowed_activity(recs, unit).writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start())


def start_window_changes(spark: SparkSession, landing: str, sources: DataFrame, out_path: str, checkpoint_location: str,
                         unit: str = "hour", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """R2 over deduplicated records: a record that lands again is counted once, and only windows that changed are written.

    The state store keeps the keys seen (32 bytes each) and the window totals; with many records choose the RocksDB
    provider (``spark.sql.streaming.stateStore.providerClass``). The first version of a record counts: corrections are
    the rollup's task (M2). Every micro-batch writes its changed windows as one partition, which a repeated run replaces;
    ``read_windows`` merges them by window.
    """
    recs = good_records(judge_pages(page_stream(spark, landing, max_files_per_trigger), sources, payload=False))
    first = recs.withColumn("_key", F.unhex("dedupe_key")).dropDuplicates(["_key"])

    def write(changed: DataFrame, batch_id: int) -> None:
        (changed.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path))

    return (windowed_activity(first, unit).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start())


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The newest total of every window that ``start_window_changes`` has written."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("event_id", "bucket", "center").agg(F.max_by(F.struct("weighted", "raw"), "batch").alias("_w"))
    return last.select("event_id", "bucket", "center", "_w.weighted", "_w.raw")


def compact_windows(spark: SparkSession, path: str, out_path: str) -> None:
    """Rewrite the written windows as one partition per window, under the newest batch number, into another folder."""
    newest = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    if newest is not None:
        (read_windows(spark, path).withColumn("batch", F.lit(newest).cast("long"))
         .write.mode("overwrite").partitionBy("batch").parquet(out_path))


__all__ = ["page_stream", "ingest_batch", "start_ingest", "windowed_activity", "start_windowed", "start_window_changes",
           "read_windows", "compact_windows", "floor_to"]
