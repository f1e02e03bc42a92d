"""Registered queries: for each key a Spark job over the driver tables and, where the
semantics are SQL-expressible, the same result written as DuckDB SQL (the oracle).

Parameters (filter spec, budgets, intents...) are module constants shared by both sides.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.operators import analytics as A
from ledgerlake.operators import budget as B
from ledgerlake.plans.views import transactions, with_e
from ledgerlake.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query (and its oracle SQL). The registered callable first applies the
    result-relevant session settings (UTC time zone), whatever session it is given."""

    def deco(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- parameters
FILTER = A.FilterSpec(
    categories=["AUTOMOBILE", "BUILDING", "FURNITURE"],
    types=["Debit", "Credit"],
    date_from=dt.date(1996, 1, 1),
    date_to=dt.date(1998, 12, 31),
    amount_min=10000.0,
    amount_max=300000.0,
)

BUDGET_TARGETS = {"Home": 40_000_000, "Build": 20_000_000, "Auto": 15_000_000, "Plant": 30_000_000,
                  "Spare": 0, "Cars": 5_000_000}
BUDGET_MAP = {"Home": ["HOUSEHOLD", "FURNITURE"], "Build": ["BUILDING"], "Auto": ["AUTOMOBILE"],
              "Plant": ["MACHINERY", "BUILDING"], "Spare": [], "Cars": ["AUTOMOBILE"]}
BUDGET_GROSS = ("Cars",)
BUDGET_FROM, BUDGET_TO = dt.date(1997, 1, 1), dt.date(1997, 12, 31)


def _budget_values_sql() -> tuple[str, str]:
    b = ", ".join(
        f"({sql_str(g)}, CAST({t} AS DECIMAL(18,2)), {'false' if g in BUDGET_GROSS else 'true'})"
        for g, t in BUDGET_TARGETS.items()
    )
    m = ", ".join(f"({sql_str(g)}, {sql_str(c)})" for g, cats in BUDGET_MAP.items() for c in cats)
    return b, m


# ---------------------------------------------------------------- dashboard queries
@register("enriched", with_e("""
SELECT txn_id, txn_date, amount, category, txn_type, paid_to,
       strftime(txn_date, '%Y-%m') AS month, dayname(txn_date) AS day_of_week,
       strftime(date_trunc('week', txn_date), '%Y-%m-%d') || '/' ||
       strftime(date_trunc('week', txn_date) + INTERVAL 6 DAY, '%Y-%m-%d') AS week
FROM e"""))
def q_enriched(spark, sf):
    return A.enrich(transactions(spark, sf)).select(
        "txn_id", "txn_date", "amount", "category", "txn_type", "paid_to", "month", "day_of_week", "week")


@register("filter_options", with_e("""
SELECT (SELECT string_agg(category, '|' ORDER BY category) FROM (SELECT DISTINCT category FROM e WHERE category IS NOT NULL)) AS categories,
       (SELECT string_agg(txn_type, '|' ORDER BY txn_type) FROM (SELECT DISTINCT txn_type FROM e WHERE txn_type IS NOT NULL)) AS txn_types,
       min(txn_date) AS min_date, max(txn_date) AS max_date, min(amount) AS min_amount, max(amount) AS max_amount
FROM e"""))
def q_filter_options(spark, sf):
    return A.filter_options(transactions(spark, sf))


def _filter_sql() -> str:
    f = FILTER
    cats = ", ".join(sql_str(c) for c in f.categories)
    types = ", ".join(sql_str(t) for t in f.types)
    return (f"category IN ({cats}) AND txn_type IN ({types}) "
            f"AND txn_date BETWEEN DATE '{f.date_from}' AND DATE '{f.date_to}' "
            f"AND amount BETWEEN {f.amount_min} AND {f.amount_max}")


@register("dashboard_filter", with_e(f"SELECT * FROM e WHERE {_filter_sql()}"))
def q_dashboard_filter(spark, sf):
    return A.dashboard_filter(transactions(spark, sf), FILTER)


@register("kpis", with_e("""
, g AS (SELECT category,
              sum(CASE WHEN txn_type = 'Debit' THEN amount END) AS spent,
              sum(CASE WHEN txn_type = 'Credit' THEN amount END) AS received,
              count(*) AS n, sum(amount) AS s, count(amount) AS n_amount,
              count(CASE WHEN txn_type = 'Debit' THEN 1 END) AS n_debit
       FROM e GROUP BY category)
SELECT CAST(coalesce(sum(spent), 0) AS DECIMAL(38,2)) AS total_spent,
       CAST(coalesce(sum(received), 0) AS DECIMAL(38,2)) AS total_received,
       CAST(coalesce(sum(received), 0) - coalesce(sum(spent), 0) AS DECIMAL(38,2)) AS net_balance,
       CAST(coalesce(sum(n), 0) AS BIGINT) AS txn_count,
       coalesce(round(CAST(sum(s) AS DOUBLE) / sum(n_amount), 2), 0.0) AS avg_transaction,
       coalesce((SELECT category FROM g WHERE n_debit > 0 AND category IS NOT NULL
                 ORDER BY spent DESC, category ASC LIMIT 1), 'N/A') AS top_category
FROM g"""))
def q_kpis(spark, sf):
    return A.kpis(transactions(spark, sf))


@register("category_share", with_e("""
, g AS (SELECT category, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM e
       WHERE txn_type = 'Debit' AND category IS NOT NULL GROUP BY category)
SELECT category, amount, round(CAST(amount AS DOUBLE) / sum(CAST(amount AS DOUBLE)) OVER (), 6) AS share FROM g"""))
def q_category_share(spark, sf):
    return A.category_share(transactions(spark, sf))


@register("month_type_sum", with_e("""
SELECT strftime(txn_date, '%Y-%m') AS month, txn_type, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS amount
FROM e WHERE txn_date IS NOT NULL AND txn_type IS NOT NULL GROUP BY 1, 2"""))
def q_month_type_sum(spark, sf):
    return A.month_type_sum(transactions(spark, sf))


_DAILY = """
, d AS (SELECT txn_date, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS amount FROM e
       WHERE txn_type = 'Debit' AND txn_date IS NOT NULL GROUP BY txn_date)"""


@register("daily_spend", with_e(_DAILY + "\nSELECT txn_date, amount FROM d"))
def q_daily_spend(spark, sf):
    return A.daily_spend(transactions(spark, sf))


@register("cumulative_spend", with_e(_DAILY + """
SELECT txn_date, amount,
       CAST(sum(amount) OVER (ORDER BY txn_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS cumulative
FROM d"""))
def q_cumulative_spend(spark, sf):
    return A.cumulative_spend(transactions(spark, sf))


@register("weekday_spend", with_e("""
SELECT dayname(txn_date) AS day_of_week, CAST(isodow(txn_date) - 1 AS INTEGER) AS day_index,
       CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS amount
FROM e WHERE txn_type = 'Debit' AND txn_date IS NOT NULL GROUP BY 1, 2"""))
def q_weekday_spend(spark, sf):
    return A.weekday_spend(transactions(spark, sf))


@register("box_stats", with_e("""
, d AS (SELECT category, CAST(amount AS DOUBLE) AS a FROM e
       WHERE txn_type = 'Debit' AND category IS NOT NULL AND amount IS NOT NULL),
q AS (SELECT category, count(*) AS n, quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.5) AS median,
             quantile_cont(a, 0.75) AS q3, min(a) AS min_amount, max(a) AS max_amount FROM d GROUP BY category),
w AS (SELECT d.category,
             min(CASE WHEN a >= q1 - 1.5 * (q3 - q1) THEN a END) AS lower_whisker,
             max(CASE WHEN a <= q3 + 1.5 * (q3 - q1) THEN a END) AS upper_whisker,
             count(CASE WHEN a < q1 - 1.5 * (q3 - q1) OR a > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
      FROM d JOIN q USING (category) GROUP BY d.category)
SELECT category, CAST(n AS BIGINT) AS n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(lower_whisker, 4) AS lower_whisker, round(upper_whisker, 4) AS upper_whisker,
       CAST(n_outliers AS BIGINT) AS n_outliers, round(min_amount, 4) AS min_amount, round(max_amount, 4) AS max_amount
FROM q JOIN w USING (category)"""))
def q_box_stats(spark, sf):
    return A.box_stats(transactions(spark, sf))


@register("payee_hierarchy", with_e("""
, d AS (SELECT category, CASE WHEN upper(category) = 'SIP' THEN 'SIP Investment'
                              ELSE coalesce(nullif(paid_to, ''), 'Unknown') END AS paid_to, amount
       FROM e WHERE txn_type = 'Debit' AND category IS NOT NULL),
r AS (SELECT category, paid_to, GROUPING(category, paid_to) AS gid,
             CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS amount, sum(amount * amount) AS sq
      FROM d GROUP BY ROLLUP (category, paid_to))
SELECT category, paid_to, CASE WHEN gid = 0 THEN 'payee' ELSE 'category' END AS level, amount,
       round(CAST(sq AS DOUBLE) / CAST(amount AS DOUBLE), 4) AS color
FROM r WHERE gid < 3"""))
def q_payee_hierarchy(spark, sf):
    return A.payee_hierarchy(transactions(spark, sf))


@register("cash_flow", with_e("""
, m AS (SELECT strftime(txn_date, '%Y-%m') AS month,
              CAST(coalesce(sum(CASE WHEN txn_type = 'Credit' THEN amount END), 0) AS DECIMAL(38,2)) AS credit,
              CAST(coalesce(sum(CASE WHEN txn_type = 'Debit' THEN amount END), 0) AS DECIMAL(38,2)) AS debit
       FROM e WHERE txn_date IS NOT NULL GROUP BY 1),
n AS (SELECT month, credit, debit, CAST(credit - debit AS DECIMAL(38,2)) AS net FROM m)
SELECT month, credit, debit, net,
       CAST(sum(net) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS end_level,
       CAST(sum(net) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - net AS DECIMAL(38,2)) AS start_level
FROM n"""))
def q_cash_flow(spark, sf):
    return A.cash_flow(transactions(spark, sf))


@register("txn_summary", with_e("""
SELECT count(*) AS n_txn, min(txn_date) AS first_date, max(txn_date) AS last_date,
       count(DISTINCT category) AS n_categories FROM e"""))
def q_txn_summary(spark, sf):
    return A.txn_summary(transactions(spark, sf))


@register("txn_detail", with_e("""
SELECT strftime(txn_date, '%Y-%m-%d') AS txn_date, category, txn_type, amount, paid_to
FROM e ORDER BY txn_date DESC"""))
def q_txn_detail(spark, sf):
    return A.txn_detail(transactions(spark, sf))


@register("top_payees", with_e("""
SELECT paid_to, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS amount FROM e
WHERE txn_type = 'Debit' AND paid_to IS NOT NULL GROUP BY paid_to ORDER BY amount DESC, paid_to ASC LIMIT 10"""))
def q_top_payees(spark, sf):
    return A.top_payees(transactions(spark, sf), 10)


# ---------------------------------------------------------------- budgets
def _budget_sql(final: str) -> str:
    b, m = _budget_values_sql()
    return with_e(f"""
, b(budget_group, target, net_credit) AS (VALUES {b}),
m(budget_group, category) AS (VALUES {m}),
pc AS (SELECT category, sum(CASE WHEN txn_type = 'Debit' THEN amount END) AS debit,
              sum(CASE WHEN txn_type = 'Credit' THEN amount END) AS credit
       FROM e WHERE txn_date BETWEEN DATE '{BUDGET_FROM}' AND DATE '{BUDGET_TO}' AND category IS NOT NULL
       GROUP BY category),
pg AS (SELECT m.budget_group, sum(debit) AS debit, sum(credit) AS credit FROM m JOIN pc USING (category) GROUP BY 1),
x AS (SELECT b.budget_group, CAST(b.target AS DECIMAL(18,2)) AS target,
             CAST(coalesce(pg.debit, 0) - CASE WHEN b.net_credit THEN coalesce(pg.credit, 0) ELSE 0 END AS DECIMAL(38,2)) AS actual
      FROM b LEFT JOIN pg USING (budget_group)),
bva AS (SELECT budget_group, target, actual, CAST(target - actual AS DECIMAL(38,2)) AS variance,
               CASE WHEN target > 0 THEN round(CAST(target - actual AS DOUBLE) / CAST(target AS DOUBLE) * 100, 4) ELSE 0.0 END AS variance_pct,
               CASE WHEN target - actual < 0 THEN 'Over Budget' ELSE 'Under Budget' END AS status
        FROM x)
{final}""")


def _bva(spark: SparkSession, sf: str) -> DataFrame:
    budgets, bmap = B.budget_tables(spark, BUDGET_TARGETS, BUDGET_MAP, BUDGET_GROSS)
    return B.budget_vs_actual(transactions(spark, sf), budgets, bmap, BUDGET_FROM, BUDGET_TO)


@register("budget_vs_actual", _budget_sql("SELECT * FROM bva"))
def q_budget_vs_actual(spark, sf):
    return _bva(spark, sf)


@register("budget_totals", _budget_sql("""
SELECT CAST(sum(target) AS DECIMAL(38,2)) AS total_target, CAST(sum(actual) AS DECIMAL(38,2)) AS total_actual,
       CAST(sum(actual) - sum(target) AS DECIMAL(38,2)) AS overspend,
       CASE WHEN sum(actual) - sum(target) > 0 THEN 'Over' ELSE 'Under' END AS overall_status
FROM bva"""))
def q_budget_totals(spark, sf):
    return B.budget_totals(_bva(spark, sf))

