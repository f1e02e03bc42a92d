"""Incremental ingest with Structured Streaming.

* ingest_events: file stream -> records + fingerprint -> foreachBatch(anti-join against the
  stored table, first copy per key, append). Duplicates are found in the stored table, of which a
  micro-batch reads only its keys' prefixes; with `suppress`, bounded state drops those that arrive
  soon after the first. Neither goes by the row's own time, so a row is loaded however late it
  comes. Exactly once per file via the checkpoint; a replayed micro-batch rewrites only its own
  batch partition (see operators.load.append_by_prefix), and a second run over the same files (even
  with a new checkpoint) adds nothing. With totals_path, each micro-batch also writes the sums of the rows
  it inserted by month and type: stored_totals() over them always equals the stored table.
* daily_totals: windowed (1 day, tumbling) sums with a watermark, update mode, each
  micro-batch's changed rows appended under its run and epoch; readers take a run's latest
  per key, so a new checkpoint neither overwrites nor outranks another run's epochs.
  Rows older than the watermark do not change streaming sums (they are still loaded by
  ingest_events, so batch results stay complete).

Event timestamps arrive as TIMESTAMP_NTZ; watermarks need TIMESTAMP, so they are cast
(session time zone UTC).
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import MONEY
from ledgerlake.operators.load import add_fingerprint, append_by_prefix
from ledgerlake.session import shared_dir

EVENT_KEYS = ["event_id", "user_id", "event_type", "amount"]


def event_stream(spark: SparkSession, source_dir: str, file_glob: str = "events*.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{source_dir.rstrip('/')}/{file_glob}").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def event_records(events: DataFrame) -> DataFrame:
    return add_fingerprint(events.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.col("value").cast(MONEY).alias("amount"),
    ), EVENT_KEYS)


def _tag(path: str) -> str:
    return hashlib.sha1(path.encode()).hexdigest()[:12]


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def first_arrivals(records: DataFrame, within: str, key: str = "hashcode") -> DataFrame:
    """Drops repeats of a key that arrive within `within` of its first arrival. The watermark is on the
    time of arrival and not on the row's own time, so a row is never late, however old it is; the
    state holds the keys of the last `within` only. It spares the stored table most look-ups, the
    anti-join behind it decides. (Arrival is the cluster's clock: it must not go back by more than
    `within` between two runs of one checkpoint.)"""
    arrived = records.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", within)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("arrived_at")


def ingest_events(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str,
                  file_glob: str = "events*.parquet", max_files_per_trigger: int | None = None,
                  totals_path: str | None = None, suppress: str | None = None) -> list[dict]:
    """Run the ingest stream over everything available now, then stop. With `suppress` (an interval),
    repeats that arrive within it are dropped by keyed state in RocksDB ahead of the stored table.
    Returns the progress of each micro-batch."""
    recs = event_records(event_stream(spark, source_dir, file_glob, max_files_per_trigger))
    if suppress:
        recs = first_arrivals(recs, suppress)
    tag = _tag(checkpoint)

    def write(batch: DataFrame, epoch: int) -> None:
        # the event key has no timestamp, so a duplicate may be stored in any month: looked up by prefix
        new = append_by_prefix(batch.withColumn("ingest_seq", F.col("event_id")), table_path, f"{tag}-{epoch}", month_col="ts")
        if totals_path:
            (new.groupBy("batch_id", "month", "event_type").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(totals_path))

    before = spark.conf.get(PROVIDER, None)
    if suppress:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (recs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if suppress:
            spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return [json.loads(p.json) if not isinstance(p, dict) else p for p in q.recentProgress]


def daily_totals(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str,
                 watermark: str = "1 day", file_glob: str = "events*.parquet") -> None:
    recs = event_records(event_stream(spark, source_dir, file_glob)).withWatermark("ts", watermark)
    tag = _tag(checkpoint)
    sums = recs.groupBy(F.window("ts", "1 day"), "event_type").agg(F.sum("amount").alias("total"))

    def write(batch: DataFrame, epoch: int) -> None:
        (batch.select(F.col("window.start").alias("window_start"), "event_type", "total",
                      F.lit(tag).alias("run"), F.lit(epoch).cast("bigint").alias("epoch"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run", "epoch").parquet(table_path))

    q = (sums.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_totals(spark: SparkSession, table_path: str, checkpoint: str) -> DataFrame:
    """The latest sums of the run that `checkpoint` belongs to."""
    schema = "window_start timestamp, event_type string, total decimal(28,2), run string, epoch bigint"
    t = spark.read.schema(schema).parquet(table_path).filter(F.col("run") == _tag(checkpoint))
    return t.groupBy("window_start", "event_type").agg(F.max_by("total", "epoch").alias("total"))


def stored_totals(spark: SparkSession, totals_path: str) -> DataFrame:
    """month, event_type, total, n over all micro-batches of all runs into one table."""
    schema = "month string, event_type string, total decimal(28,2), n bigint, batch_id string"
    t = spark.read.schema(schema).parquet(totals_path)
    return t.groupBy("month", "event_type").agg(F.sum("total").cast("decimal(28,2)").alias("total"), F.sum("n").alias("n"))


def run_dir(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"ledgerlake/{name}/{uuid.uuid4().hex}")
