"""The dashboard's stored cube: sums of transactions by day, category, type and payee, kept batch by batch.

Each batch adds its own cells (a repeated batch replaces them), so nothing stored is read to add
one. Readers take a merged copy that is written at most every MAX_AGE seconds: within that time the
dashboard's figures come from it alone, whatever has been appended since. The cells have the
transactions' columns with `amount` as their sum, so every sum over transactions (shares, trends,
running totals, cash flow, top payees) reads them as it reads the transactions; counts and means go
by n and n_amount. Quartiles and the hierarchy's weighted colour need the amounts themselves.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import TOTAL
from ledgerlake.operators import analytics as A
from ledgerlake.session import path_exists

CELL = ["txn_date", "category", "txn_type", "paid_to"]
SCHEMA = "txn_date date, category string, txn_type string, paid_to string, amount decimal(38,2), n bigint, n_amount bigint, low decimal(38,2), high decimal(38,2)"
MAX_AGE = 300.0  # fixed value: seconds a dashboard may lag behind


def add_batch(tx: DataFrame, path: str, batch_id: str) -> None:
    """The cells of one batch of transactions."""
    a = F.col("amount")
    cells = tx.groupBy(*CELL).agg(F.sum(a).cast(TOTAL).alias("amount"), F.count("*").alias("n"), F.count(a).alias("n_amount"),
                                  F.min(a).cast(TOTAL).alias("low"), F.max(a).cast(TOTAL).alias("high"))
    (cells.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(f"{path}/cells"))


def merged(spark: SparkSession, path: str) -> DataFrame:
    """One row per cell over all batches; no rows before the first."""
    if not path_exists(spark, f"{path}/cells"):
        return spark.createDataFrame([], SCHEMA)
    t = spark.read.schema(SCHEMA + ", batch_id string").parquet(f"{path}/cells")
    return t.groupBy(*CELL).agg(F.sum("amount").cast(TOTAL).alias("amount"), F.sum("n").alias("n"), F.sum("n_amount").alias("n_amount"),
                                F.min("low").alias("low"), F.max("high").alias("high"))


def dashboard_cells(spark: SparkSession, path: str, max_age: float = MAX_AGE, clock: Callable[[], float] = time.time) -> DataFrame:
    """The newest merged copy if it is younger than max_age seconds, else a new one. A copy counts once
    its write is complete; the one before it stays for those who still read it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/merged")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    now = int(clock() * 1000)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = sorted(int(n) for n in names if n.isdigit() and path_exists(spark, f"{path}/merged/{n}/_SUCCESS"))
    if not done or now - done[-1] >= max_age * 1000:
        merged(spark, path).write.mode("overwrite").parquet(f"{path}/merged/{now}")
        for old in done[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/merged/{old}"), True)
        done.append(now)
    return spark.read.schema(SCHEMA).parquet(f"{path}/merged/{done[-1]}")


def kpis(cells: DataFrame) -> DataFrame:
    """analytics.kpis from cells."""
    amt, n = F.col("amount"), F.col("n")
    return A.headline(cells.groupBy("category").agg(
        F.sum(F.when(A.is_debit(), amt)).alias("spent"), F.sum(F.when(A.is_credit(), amt)).alias("received"), F.sum(n).alias("n"),
        F.sum(amt).alias("s"), F.sum("n_amount").alias("n_amount"), F.coalesce(F.sum(F.when(A.is_debit(), n)), F.lit(0)).alias("n_debit")))
