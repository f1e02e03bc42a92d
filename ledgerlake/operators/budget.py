"""Budgets against actuals.

budgets(budget_group, target decimal(18,2), net_credit boolean)
budget_map(budget_group, category)   -- a category may sit in several groups

Plan: transactions are reduced to one row per category first (partial aggregation),
so the joins with the two parameter tables only ever see category-sized inputs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import MONEY, TOTAL

BUDGET_SCHEMA = "budget_group string, target decimal(18,2), net_credit boolean"
MAP_SCHEMA = "budget_group string, category string"


def budget_tables(spark: SparkSession, targets: dict[str, float], mapping: dict[str, list[str]],
                  gross_groups: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Parameter tables from plain dicts. Groups in `gross_groups` do not net credits."""
    from decimal import Decimal

    b = spark.createDataFrame(
        [(g, Decimal(str(t)).quantize(Decimal("0.01")), g not in gross_groups) for g, t in targets.items()],
        BUDGET_SCHEMA,
    )
    m = spark.createDataFrame([(g, c) for g, cats in mapping.items() for c in cats], MAP_SCHEMA)
    return b, m


def budget_vs_actual(tx: DataFrame, budgets: DataFrame, budget_map: DataFrame,
                     date_from: dt.date | None = None, date_to: dt.date | None = None) -> DataFrame:
    """Per group: target, actual (debits minus credits unless net_credit is false),
    variance = target - actual, variance % of target (0 when target is 0), status.
    Groups without categories or without rows are kept with actual 0."""
    d = F.col("txn_date")
    p = F.lit(True)
    if date_from is not None:
        p = p & (d >= F.lit(date_from))
    if date_to is not None:
        p = p & (d <= F.lit(date_to))
    amt = F.col("amount")
    per_cat = (
        tx.filter(p & F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum(F.when(F.col("txn_type") == "Debit", amt)).alias("debit"),
             F.sum(F.when(F.col("txn_type") == "Credit", amt)).alias("credit"))
    )
    per_group = (
        budget_map.join(per_cat, "category", "inner")
        .groupBy("budget_group")
        .agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    )
    debit = F.coalesce(F.col("debit"), F.lit(0))
    credit = F.when(F.col("net_credit"), F.coalesce(F.col("credit"), F.lit(0))).otherwise(F.lit(0))
    out = budgets.join(per_group, "budget_group", "left").withColumn("actual", (debit - credit).cast(TOTAL))
    variance = (F.col("target") - F.col("actual")).cast(TOTAL)
    return out.select(
        "budget_group",
        F.col("target").cast(MONEY).alias("target"),
        "actual",
        variance.alias("variance"),
        F.when(F.col("target") > 0, F.round(variance.cast("double") / F.col("target").cast("double") * 100, 4))
        .otherwise(F.lit(0.0)).alias("variance_pct"),
        F.when(variance < 0, "Over Budget").otherwise("Under Budget").alias("status"),
    )


def budget_totals(bva: DataFrame) -> DataFrame:
    """Overall: total target, total actual, overspend = actual - target, status."""
    t = bva.agg(F.sum("target").cast(TOTAL).alias("total_target"), F.sum("actual").cast(TOTAL).alias("total_actual"))
    over = (F.col("total_actual") - F.col("total_target")).cast(TOTAL)
    return t.select("total_target", "total_actual", over.alias("overspend"),
                    F.when(over > 0, "Over").otherwise("Under").alias("overall_status"))
