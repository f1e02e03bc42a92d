"""Shared derived tables over the driver's parquet tables.

`transactions` (view E) maps orders x customer onto the transaction record:
order key -> txn id, total price -> amount, customer name -> payee, order date -> txn date,
market segment -> category, order status F/O/other -> Debit/Credit/Unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import MONEY
from ledgerlake.session import spread, table

TXN_COLUMNS = ["txn_id", "amount", "paid_to", "txn_date", "category", "txn_type"]


def status_to_type(c) -> F.Column:
    return F.when(c == "F", "Debit").when(c == "O", "Credit").otherwise("Unknown")


def transactions(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """View E; `extra` names further orders/customer columns to carry along; `dealt` spreads a small
    orders table over all cores, ahead of work on texts."""
    orders = table(spark, sf_dir, "orders")
    if dealt:
        orders = spread(orders)
    customer = table(spark, sf_dir, "customer")
    # Equi-join on the customer key; the planner broadcasts customer only while its
    # measured size is under spark.sql.autoBroadcastJoinThreshold, else sort-merges.
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "inner").select(
        orders.o_orderkey.alias("txn_id"),
        orders.o_totalprice.cast(MONEY).alias("amount"),
        customer.c_name.alias("paid_to"),
        orders.o_orderdate.cast("date").alias("txn_date"),
        customer.c_mktsegment.alias("category"),
        status_to_type(orders.o_orderstatus).alias("txn_type"),
        *[F.col(c) for c in extra],
    )


# The same view for the DuckDB oracle.
TRANSACTIONS_SQL = """
SELECT o.o_orderkey AS txn_id,
       CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount,
       c.c_name AS paid_to,
       CAST(o.o_orderdate AS DATE) AS txn_date,
       c.c_mktsegment AS category,
       CASE o.o_orderstatus WHEN 'F' THEN 'Debit' WHEN 'O' THEN 'Credit' ELSE 'Unknown' END AS txn_type
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""


def with_e(sql: str) -> str:
    """Prefix an oracle query with the E view as CTE `e`."""
    return f"WITH e AS ({TRANSACTIONS_SQL})\n{sql}"
