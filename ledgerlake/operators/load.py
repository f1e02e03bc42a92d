"""Fingerprint, in-batch first copy, anti-join against the stored table, idempotent append.

Skew: 'first copy per key' is row_number() = 1, which Spark limits to one row per key and task
before the shuffle (WindowGroupLimit), so a key with millions of copies sends one row per task.
The anti-join comes first, so rows that are stored already are never sorted. Both key on the
fingerprint, whose values are uniformly spread.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.text import fingerprint
from ledgerlake.session import path_exists

# Chosen key list, where no file gives one (load_hash_keys).
HASH_KEYS = ["amount", "paid_to", "reference_no", "txn_date", "txn_type"]


def add_fingerprint(df: DataFrame, keys: list[str] = HASH_KEYS, out_col: str = "hashcode") -> DataFrame:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"hash key columns missing: {missing}")
    return df.withColumn(out_col, fingerprint(keys))


def load_hash_keys(spark: SparkSession, path: str) -> list[str]:
    """The fingerprint's fields from an INI file: section HASH, keys = field, field, ..."""
    import configparser

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    config = configparser.ConfigParser()
    config.read_string(text)
    keys = [k.strip() for k in config.get("HASH", "keys").split(",") if k.strip()]
    if not keys:
        raise ValueError(f"no hash keys in {path}")
    return keys


def _numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds __n: 1 for the first copy of its key; equal (key, order) rows are told apart by their other columns."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order, *rest)))


def first_copy(df: DataFrame, key: str = "hashcode", order: str = "ingest_seq") -> DataFrame:
    """One row per key: the one with the smallest `order` (then the row's own values)."""
    return _numbered(df, key, order).filter(F.col("__n") == 1).drop("__n")


def new_rows(batch: DataFrame, stored_keys: DataFrame, key: str = "hashcode", order: str = "ingest_seq") -> DataFrame:
    """Rows whose key isn't stored yet (left anti join), the first copy of each key."""
    return first_copy(batch.join(stored_keys.select(key), key, "left_anti"), key, order)


def load_status(batch: DataFrame, stored_keys: DataFrame, key: str = "hashcode",
                order: str = "ingest_seq", valid: str | None = None) -> DataFrame:
    """Per batch row: inserted | duplicate | quarantined (when `valid` column is false or null).
    Only valid rows compete for being the first copy."""
    stored = stored_keys.select(key).distinct().withColumn("__stored", F.lit(True))
    ok = F.lit(True) if valid is None else F.coalesce(F.col(valid), F.lit(False))
    rest = [c for c in batch.columns if c not in (key, order)]
    w = Window.partitionBy(key, "__ok").orderBy(order, *rest)
    tagged = batch.withColumn("__ok", ok).withColumn("__n", F.row_number().over(w)).join(stored, key, "left")
    status = (F.when(~F.col("__ok"), "quarantined")
              .when(F.col("__stored") | (F.col("__n") > 1), "duplicate").otherwise("inserted"))
    return tagged.withColumn("status", status).drop("__stored", "__ok", "__n")


def load_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def count_load(batch: DataFrame, stored_keys: DataFrame, key: str = "hashcode", valid: str | None = None) -> DataFrame:
    """load_counts(load_status(...)) in one shuffle: rows and stored keys meet in one aggregate by key."""
    ok = F.lit(True) if valid is None else F.coalesce(F.col(valid), F.lit(False))
    rows = batch.select(key, ok.alias("ok"), F.lit(False).alias("stored"))
    rows = rows.unionByName(stored_keys.select(key, F.lit(True).alias("ok"), F.lit(True).alias("stored")))
    per_key = rows.groupBy(key).agg(
        F.count_if(~F.col("stored") & F.col("ok")).alias("good"), F.count_if(~F.col("ok")).alias("quarantined"),
        F.bool_or("stored").alias("stored"))
    first = F.when(~F.col("stored") & (F.col("good") > 0), 1).otherwise(0)
    totals = per_key.agg(F.sum(first).alias("inserted"), F.sum(F.col("good") - first).alias("duplicate"),
                         F.sum("quarantined").alias("quarantined"))
    out = totals.unpivot([], ["inserted", "duplicate", "quarantined"], "status", "n")
    return out.filter("n > 0").withColumn("n", F.col("n").cast("bigint"))


RECORD_COLUMNS = ["source", "source_id", "amount", "paid_to", "txn_type", "reference_no", "txn_date"]


def union_sources(*frames: DataFrame) -> DataFrame:
    """Mail and statement records in one frame; columns one source lacks become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_transactions(spark, table_path: str) -> DataFrame:
    """Stored table, older files included: files written before txn_type existed read it as null."""
    t = spark.read.option("mergeSchema", "true").parquet(table_path)
    if "txn_type" not in t.columns:
        t = t.withColumn("txn_type", F.lit(None).cast("string"))
    return t


def stored_batches(spark: SparkSession, table_path: str, columns: T.StructType,
                   parts: tuple[str, ...] = ("batch_id", "month")) -> DataFrame | None:
    """The table written by append_batch or append_by_prefix, or None before the first batch. The schema
    is given and not inferred: batch ids, months and prefixes stay text whatever they look like."""
    if not path_exists(spark, table_path):
        return None
    fields = [f for f in columns.fields if f.name not in parts] + [T.StructField(c, T.StringType()) for c in parts]
    return spark.read.schema(T.StructType(fields)).parquet(table_path)


#: Hex digits of the fingerprint that name a partition of append_by_prefix: 16 ** PREFIX folders.
PREFIX = 1


def append_by_prefix(batch: DataFrame, table_path: str, batch_id: str, key: str = "hashcode", order: str = "ingest_seq",
                     month_col: str = "txn_date", prefix: int = PREFIX) -> DataFrame:
    """append_batch for keys that no date bounds: the table is laid out by the first `prefix` hex digits
    of the fingerprint, then by batch, with the month as a column, and its files have a Bloom filter
    on the key. Only the prefixes that occur in the batch are read from the stored table (partition
    pruning; their list is bounded by 16 ** prefix); for a batch of less rows than that, most of the
    table is left alone. A retried batch replaces its own partitions. Returns the rows written."""
    spark = batch.sparkSession
    parts = ("prefix", "batch_id")
    batch = batch.withColumn("prefix", F.substring(key, 1, prefix)).withColumn(
        "month", F.date_format(F.col(month_col), "yyyy-MM")).persist(StorageLevel.MEMORY_AND_DISK)
    stored = stored_batches(spark, table_path, batch.schema, parts)
    fresh = batch
    if stored is not None:
        prefixes = [r[0] for r in batch.select("prefix").distinct().collect()]
        fresh = fresh.join(stored_keys(stored, key, prefixes, batch_id), key, "left_anti")
    fresh = first_copy(fresh, key, order).withColumn("batch_id", F.lit(batch_id))
    (fresh.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy(*parts).parquet(table_path))
    out = stored_batches(spark, table_path, batch.schema, parts).filter(F.col("batch_id") == F.lit(batch_id))
    batch.unpersist()
    return out


def stored_keys(stored: DataFrame, key: str, prefixes: list[str], batch_id: str) -> DataFrame:
    """Keys of all other batches under the given prefixes."""
    return stored.filter(F.col("prefix").isin(prefixes) & (F.col("batch_id") != F.lit(batch_id))).select(key)


def append_batch(batch: DataFrame, table_path: str, batch_id: str, key: str = "hashcode",
                 order: str = "ingest_seq", month_col: str = "txn_date",
                 date_in_key: bool = True) -> DataFrame:
    """Insert the batch's new rows into the parquet table at table_path.

    Layout: partitioned by batch_id and month. A retried batch overwrites only its own
    batch_id partition and ignores its own earlier output in the anti-join, so a retry
    after a lost executor or a failed commit gives the same table as one clean run.
    When the date is part of the fingerprint (date_in_key), a duplicate can only sit in the
    same month (no month for rows without a date), so only the batch's months are read from the
    stored table (partition pruning on `month`); the month list is bounded by the calendar.
    Returns the rows written.
    """
    spark = batch.sparkSession
    stored = stored_batches(spark, table_path, batch.schema)
    if stored is not None and date_in_key:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # read for its months and for its rows
    fresh = batch
    if stored is not None:
        stored = stored.filter(F.col("batch_id") != F.lit(batch_id))
        if date_in_key:
            months = [r[0] for r in batch.select(F.date_format(F.col(month_col), "yyyy-MM")).distinct().collect()]
            stored = stored.filter(F.col("month").isin([m for m in months if m is not None])
                                   | (F.col("month").isNull() if None in months else F.lit(False)))
        fresh = fresh.join(stored.select(key), key, "left_anti")
    fresh = first_copy(fresh, key, order).withColumn("batch_id", F.lit(batch_id)).withColumn(
        "month", F.date_format(F.col(month_col), "yyyy-MM"))
    (fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id", "month").parquet(table_path))
    batch.unpersist()
    return stored_batches(spark, table_path, batch.schema).filter(F.col("batch_id") == F.lit(batch_id))
