"""Dashboard data: filters, key figures, trends, distributions, hierarchies.

Every function is DataFrame -> DataFrame over a transaction table with columns
txn_date (date), amount (decimal), category, txn_type, paid_to.

Scale notes: each aggregate is a hash aggregate with map-side partial aggregation, so a
category or payee holding a third of all rows is collapsed before the shuffle. Windows
without a partition key (running totals, shares) run only on already-aggregated rows whose
count is bounded by the calendar (days, months) or the category vocabulary, never on raw rows.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import TOTAL

DEBIT = "Debit"
CREDIT = "Credit"


def _total(c: Column) -> Column:
    """Sum as decimal(38,2); an empty sum is 0 (dashboard convention)."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(TOTAL)


def is_debit() -> Column:
    return F.col("txn_type") == DEBIT


def is_credit() -> Column:
    return F.col("txn_type") == CREDIT


# ---------------------------------------------------------------- derived columns
def week_label(d: Column) -> Column:
    """'yyyy-MM-dd/yyyy-MM-dd', Monday to Sunday of the date's week."""
    monday = F.date_trunc("week", d).cast("date")
    return F.concat(
        F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd")
    )


def enrich(df: DataFrame) -> DataFrame:
    """Adds month ('yyyy-MM'), day_of_week ('Monday') and week."""
    d = F.col("txn_date")
    return df.withColumns(
        {"month": F.date_format(d, "yyyy-MM"), "day_of_week": F.date_format(d, "EEEE"), "week": week_label(d)}
    )


def dashboard_frame(tx: DataFrame) -> DataFrame:
    """The five dashboard columns plus derived ones, kept in memory for the many aggregates
    computed from it (MEMORY_AND_DISK: spills instead of failing on a large table)."""
    from pyspark import StorageLevel

    return enrich(tx.select("txn_date", "amount", "category", "txn_type", "paid_to")).persist(
        StorageLevel.MEMORY_AND_DISK)


# ---------------------------------------------------------------- filters
def exact(x) -> Column:
    """A bound as the decimal its text says, unrounded."""
    return F.lit(Decimal(str(x)))


@dataclass(frozen=True)
class FilterSpec:
    """Dashboard selection. None = no predicate; an empty list selects nothing."""

    categories: Sequence[str] | None = None
    types: Sequence[str] | None = None
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    amount_min: float | None = None
    amount_max: float | None = None

    def predicate(self) -> Column:
        p = F.lit(True)
        if self.categories is not None:
            p = p & (F.col("category").isin(list(self.categories)) if self.categories else F.lit(False))
        if self.types is not None:
            p = p & (F.col("txn_type").isin(list(self.types)) if self.types else F.lit(False))
        if self.date_from is not None:
            p = p & (F.col("txn_date") >= F.lit(self.date_from))
        if self.date_to is not None:
            p = p & (F.col("txn_date") <= F.lit(self.date_to))
        if self.amount_min is not None:
            p = p & (F.col("amount") >= exact(self.amount_min))
        if self.amount_max is not None:
            p = p & (F.col("amount") <= exact(self.amount_max))
        return p


def dashboard_filter(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.filter(spec.predicate())


def filter_options(df: DataFrame) -> DataFrame:
    """Widget bounds in one pass: sorted distinct categories and types ('|'-joined), date and
    amount range. The sets are bounded by the category/type vocabularies (partial per task)."""
    return df.agg(
        F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"),
        F.array_join(F.array_sort(F.collect_set("txn_type")), "|").alias("txn_types"),
        F.min("txn_date").alias("min_date"), F.max("txn_date").alias("max_date"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
    )


# ---------------------------------------------------------------- key figures
def per_category(df: DataFrame) -> DataFrame:
    """One row per category with the partial sums every headline figure is built from."""
    amt = F.col("amount")
    return df.groupBy("category").agg(
        F.sum(F.when(is_debit(), amt)).alias("spent"),
        F.sum(F.when(is_credit(), amt)).alias("received"),
        F.count(F.lit(1)).alias("n"),
        F.sum(amt).alias("s"),
        F.count(amt).alias("n_amount"),
        F.count(F.when(is_debit(), F.lit(1))).alias("n_debit"),
    )


def kpis(df: DataFrame) -> DataFrame:
    """Spent, received, net, count, mean amount and top debit category ('N/A' if none)."""
    return headline(per_category(df))


def headline(g: DataFrame) -> DataFrame:
    """The key figures from per_category's rows."""
    spent = _total(F.col("spent"))
    received = _total(F.col("received"))
    top_key = F.when((F.col("n_debit") > 0) & F.col("category").isNotNull(),
                     F.struct((-F.coalesce(F.col("spent"), F.lit(0))).alias("neg"), F.col("category").alias("c")))
    return g.agg(
        spent.alias("total_spent"),
        received.alias("total_received"),
        (received - spent).cast(TOTAL).alias("net_balance"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("txn_count"),
        F.coalesce(F.round(F.sum("s").cast("double") / F.sum("n_amount"), 2), F.lit(0.0)).alias("avg_transaction"),
        F.coalesce(F.min_by("category", top_key), F.lit("N/A")).alias("top_category"),
    )


def category_share(df: DataFrame) -> DataFrame:
    """Debit sum per category and its share of all debits."""
    g = df.filter(is_debit() & F.col("category").isNotNull()).groupBy("category").agg(_total(F.col("amount")).alias("amount"))
    total = F.sum(F.col("amount").cast("double")).over(Window.partitionBy())
    return g.withColumn("share", F.round(F.col("amount").cast("double") / total, 6))


def month_type_sum(df: DataFrame) -> DataFrame:
    return (
        enrich(df)
        .filter(F.col("month").isNotNull() & F.col("txn_type").isNotNull())
        .groupBy("month", "txn_type")
        .agg(_total(F.col("amount")).alias("amount"))
    )


def daily_spend(df: DataFrame) -> DataFrame:
    return (
        df.filter(is_debit() & F.col("txn_date").isNotNull())
        .groupBy("txn_date")
        .agg(_total(F.col("amount")).alias("amount"))
    )


def cumulative_spend(df: DataFrame) -> DataFrame:
    """Running total over the daily sums (one row per day, so the global window is small)."""
    w = Window.orderBy("txn_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily_spend(df).withColumn("cumulative", F.sum("amount").over(w).cast(TOTAL))


def weekday_spend(df: DataFrame) -> DataFrame:
    """Debit sum per weekday; day_index 0 = Monday (sort key)."""
    d = F.col("txn_date")
    return (
        df.filter(is_debit() & d.isNotNull())
        .groupBy(F.date_format(d, "EEEE").alias("day_of_week"), F.weekday(d).alias("day_index"))
        .agg(_total(F.col("amount")).alias("amount"))
    )


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
BUCKETS = 64  # per doubling of the amount


def amount_bucket(amount: Column) -> Column:
    """A whole number that does not fall as the amount rises: BUCKETS per doubling, at most 64 * BUCKETS on each side."""
    a = amount.cast("double")
    return (F.signum(a) * F.floor(F.log2(F.abs(a) + 1) * BUCKETS)).cast("bigint")


def exact_quartiles(base: DataFrame) -> DataFrame:
    """category, n and the quartiles (linear interpolation) of base(category, amount), by narrowing.

    One pass counts amounts by log-scale bucket: a table bounded by the categories. The ranks that
    the quartiles need lie in at most six buckets of a category; a second pass counts the distinct
    amounts of those buckets alone, where the ranks are found."""
    counts = base.groupBy("category", amount_bucket(F.col("amount")).alias("bucket")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy("category").orderBy("bucket")  # bounded by the number of buckets
    counts = counts.select("category", "bucket", (F.sum("c").over(upto) - F.col("c")).alias("before"), F.sum("c").over(upto).alias("until"),
                           F.sum("c").over(Window.partitionBy("category")).alias("n"))
    place = {k: (F.col("n") - 1) * F.lit(p) for k, p in QUARTILES.items()}
    ranks = [r.cast("bigint") for x in place.values() for r in (F.floor(x), F.ceil(x))]
    inside = F.lit(False)
    for r in ranks:
        inside = inside | ((F.col("before") <= r) & (r < F.col("until")))
    wanted = counts.filter(inside).select("category", "bucket", "before", "n")
    some = base.withColumn("bucket", amount_bucket(F.col("amount"))).join(wanted, ["category", "bucket"])
    some = some.groupBy("category", "bucket", "amount").agg(F.count("*").alias("c"), F.first("before").alias("before"), F.first("n").alias("n"))
    within = Window.partitionBy("category", "bucket").orderBy("amount")
    some = some.withColumn("until", F.col("before") + F.sum("c").over(within)).withColumn("from", F.col("until") - F.col("c"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("from") <= rank) & (rank < F.col("until")), F.col("amount").cast("double")))

    found = some.groupBy("category").agg(F.first("n").alias("n"), *[
        f(x).alias(f"{k}_{side}") for k, x in place.items() for side, f in (("lo", lambda x: value_at(F.floor(x))), ("hi", lambda x: value_at(F.ceil(x))))])
    part = lambda k: place[k] - F.floor(place[k])
    return found.select("category", "n", *[
        (F.col(f"{k}_lo") + part(k) * (F.col(f"{k}_hi") - F.col(f"{k}_lo"))).alias(k) for k in QUARTILES])


def box_stats(df: DataFrame, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Per-category quartiles (linear interpolation), 1.5-IQR whiskers and outlier count of debits.

    Never gathers a category's rows: quartiles come from counts (exact_quartiles, or
    percentile_approx), whiskers from one more aggregate that knows the fences."""
    base = df.filter(is_debit() & F.col("category").isNotNull() & F.col("amount").isNotNull()).select("category", "amount")
    if approx:
        q = base.groupBy("category").agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx(F.col("amount").cast("double"), list(QUARTILES.values()), accuracy).alias("qs"),
        ).select("category", "n", *[F.col("qs")[i].alias(k) for i, k in enumerate(QUARTILES)])
    else:
        q = exact_quartiles(base)
    iqr = F.col("q3") - F.col("q1")
    fences = q.withColumns({"low": F.col("q1") - 1.5 * iqr, "high": F.col("q3") + 1.5 * iqr})
    a = F.col("amount").cast("double")
    whole = base.join(fences, "category").groupBy("category").agg(
        *[F.first(c).alias(c) for c in ("n", *QUARTILES)],
        F.min(F.when(a >= F.col("low"), a)).alias("lower_whisker"),
        F.max(F.when(a <= F.col("high"), a)).alias("upper_whisker"),
        F.count_if((a < F.col("low")) | (a > F.col("high"))).alias("n_outliers"),
        F.min(a).alias("min_amount"),
        F.max(a).alias("max_amount"),
    )
    r = lambda c: F.round(F.col(c), 4).alias(c)
    return whole.select(
        "category", F.col("n").cast("bigint").alias("n"), r("q1"), r("median"), r("q3"),
        r("lower_whisker"), r("upper_whisker"), "n_outliers", r("min_amount"), r("max_amount"),
    )


def payee_label() -> Column:
    """Payee shown in the hierarchy: SIP rows as 'SIP Investment', missing as 'Unknown'."""
    return F.when(F.upper(F.col("category")) == "SIP", F.lit("SIP Investment")).otherwise(
        F.coalesce(F.nullif(F.col("paid_to"), F.lit("")), F.lit("Unknown"))
    )


def payee_hierarchy(df: DataFrame) -> DataFrame:
    """Two-level debit sums category -> payee (ROLLUP without the grand total).

    color is the amount-weighted mean amount, the value a sunburst shows for a node.
    """
    a = F.col("amount")
    return (
        df.filter(is_debit() & F.col("category").isNotNull())
        .withColumn("paid_to", payee_label())
        .rollup("category", "paid_to")
        .agg(
            F.grouping_id().alias("gid"),
            _total(a).alias("amount"),
            F.sum(a * a).alias("sq"),
        )
        .filter(F.col("gid") < 3)
        .select(
            "category", "paid_to",
            F.when(F.col("gid") == 0, "payee").otherwise("category").alias("level"),
            "amount",
            F.round(F.col("sq").cast("double") / F.col("amount").cast("double"), 4).alias("color"),
        )
    )


def cash_flow(df: DataFrame) -> DataFrame:
    """Per month: credit, debit, net = credit - debit, and the running waterfall levels."""
    amt = F.col("amount")
    m = (
        enrich(df).filter(F.col("month").isNotNull())
        .groupBy("month")
        .agg(_total(F.when(is_credit(), amt)).alias("credit"), _total(F.when(is_debit(), amt)).alias("debit"))
        .withColumn("net", (F.col("credit") - F.col("debit")).cast(TOTAL))
    )
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.withColumn("end_level", F.sum("net").over(w).cast(TOTAL)).withColumn(
        "start_level", (F.col("end_level") - F.col("net")).cast(TOTAL)
    )


def txn_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_txn"),
        F.min("txn_date").alias("first_date"),
        F.max("txn_date").alias("last_date"),
        F.countDistinct("category").alias("n_categories"),
    )


def txn_detail(df: DataFrame) -> DataFrame:
    """Display table, newest first, then by txn_id where there is one (a distributed range sort
    whose key is unique, so a day with many rows is split)."""
    tie = [F.col("txn_id")] if "txn_id" in df.columns else []
    return df.orderBy(F.col("txn_date").desc(), *tie).select(
        F.date_format("txn_date", "yyyy-MM-dd").alias("txn_date"), "category", "txn_type", "amount", "paid_to"
    )


def top_payees(df: DataFrame, k: int = 10) -> DataFrame:
    """k payees with the largest debit sums; ties by name. The limit is the report."""
    return (
        df.filter(is_debit() & F.col("paid_to").isNotNull())
        .groupBy("paid_to")
        .agg(_total(F.col("amount")).alias("amount"))
        .orderBy(F.col("amount").desc(), F.col("paid_to").asc())
        .limit(k)
    )
