"""Registered statement queries. Statement lines are rendered from `events`: one statement
per user, one page per day, with headers, continuation lines, capitals-only and
'Registered' lines, blank lines, a footer and a line after the footer on every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import MONEY
from ledgerlake.operators import statement as S
from ledgerlake.plans.registry import register
from ledgerlake.plans.views import transactions, with_e
from ledgerlake.session import table

EPOCH = "2024-01-01"


def _event_rows(events: DataFrame) -> DataFrame:
    d = F.col("ts").cast("date")
    page = Window.partitionBy("user_id", "page_no")
    return (events.withColumn("page_no", F.datediff(d, F.lit(EPOCH).cast("date")))
            .withColumn("r", F.row_number().over(page.orderBy("ts", "event_id")))
            .withColumn("cnt", F.count(F.lit(1)).over(page))
            .withColumn("amt", F.col("value").cast(MONEY))
            .withColumn("bal", (F.col("value").cast(MONEY) * 100).cast(MONEY)))


def statement_lines(events: DataFrame) -> DataFrame:
    x = _event_rows(events)
    day = F.date_format("ts", "dd/MM/yy")
    head = F.concat(F.lit("UPI-"), F.upper("event_type"), F.lit(" STORE-h"), F.col("user_id").cast("string"),
                    F.lit("@okbank"))
    date_line = F.concat_ws(" ", day, head, F.lpad(F.col("event_id").cast("string"), 16, "0"), day,
                            F.format_number("amt", 2), F.format_number("bal", 2))
    r, cnt = F.col("r"), F.col("cnt")

    def ln(no, text, cond=None):
        s = F.struct(no.cast("bigint").alias("line_no"), text.alias("line"))
        return s if cond is None else F.when(cond, s)

    et = F.col("event_type")
    lines = F.array(
        ln(F.lit(0), F.concat(F.lit("Statement of account, page "), F.col("page_no").cast("string")), r == 1),
        ln(r * 10, date_line),
        ln(r * 10 + 1, F.concat(F.lit("note "), F.col("event_id").cast("string"))),
        ln(r * 10 + 2, F.lit("REFERENCE ONLY *"), et == "view"),
        ln(r * 10 + 3, F.lit("Registered office: 1 Main St"), et == "click"),
        ln(r * 10 + 4, F.lit("   ")),
        ln((cnt + 1) * 10, F.concat(F.lit("Closingbalance "), F.format_number("bal", 2)), r == cnt),
        ln((cnt + 1) * 10 + 1, F.lit("01/01/24 JUNK 0000000000000000 01/01/24 1.00 1.00"), r == cnt),
    )
    return x.select(F.col("user_id").alias("doc_id"), "page_no", F.explode(F.filter(lines, lambda s: s.isNotNull())).alias("s")) \
        .select("doc_id", "page_no", "s.line_no", "s.line")


@register("stmt_assemble", f"""
SELECT user_id AS doc_id, CAST(date_diff('day', DATE '{EPOCH}', CAST(ts AS DATE)) AS INTEGER) AS page_no,
       CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS txn_no,
       CAST(ts AS DATE) AS txn_date,
       'UPI-' || upper(event_type) || ' STORE-h' || CAST(user_id AS VARCHAR) || '@okbank note ' || CAST(event_id AS VARCHAR) AS narration,
       lpad(CAST(event_id AS VARCHAR), 16, '0') AS chq_no,
       CAST(value AS DECIMAL(18,2)) AS amount,
       CAST(CAST(value AS DECIMAL(18,2)) * 100 AS DECIMAL(18,2)) AS balance
FROM events""")
def q_stmt_assemble(spark, sf):
    raw = S.typed(S.assemble(statement_lines(table(spark, sf, "events"))))
    return raw.select("doc_id", "page_no", "txn_no", "txn_date", "narration", "chq_no",
                      F.col("amount_printed").alias("amount"), "balance")


@register("balance_delta", """
WITH x AS (SELECT event_id, user_id, CAST(value AS DECIMAL(18,2)) AS v,
                  lag(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
           FROM events)
SELECT event_id, user_id,
       CASE WHEN rn = 1 THEN CASE WHEN v IS NOT NULL AND v <> 0 THEN 'Debit' END
            WHEN v - p < 0 THEN 'Debit' WHEN v - p > 0 THEN 'Credit' END AS txn_type,
       CAST(CASE WHEN rn = 1 THEN CASE WHEN v <> 0 THEN v END WHEN v - p <> 0 THEN abs(v - p) END AS DECIMAL(18,2)) AS amount
FROM x""")
def q_balance_delta(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.datediff(F.col("ts").cast("date"), F.lit(EPOCH).cast("date")).alias("day"),
        F.col("value").cast(MONEY).alias("balance"))
    out = S.balance_delta(ev.withColumn("amount_printed", F.col("balance")), ["user_id"], "day", ["ts", "event_id"])
    return out.select("event_id", "user_id", "txn_type", "amount")


def _narration(priority, payee, txn_id):
    return (F.when(priority == "1-URGENT", F.concat(F.lit("UPI-"), payee, F.lit("-h"), txn_id.cast("string"),
                                                     F.lit("@okbank-x")))
            .when(priority == "2-HIGH", F.concat(F.lit("UPI-"), payee, F.lit("-A"),
                                                 F.lpad(txn_id.cast("string"), 11, "0"), F.lit(" TXN")))
            .when(priority == "3-MEDIUM", F.concat(F.lit("UPI-"), payee, F.lit("@okbank")))
            .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("NEFT CR-"), payee))
            .otherwise(F.concat(F.lit("  IMPS "), payee, F.lit("  "))))


@register("narration_payee", with_e("""
, x AS (SELECT e.txn_id, e.paid_to, o.o_orderpriority AS pr FROM e JOIN orders o ON o.o_orderkey = e.txn_id)
SELECT txn_id,
       CASE pr WHEN '1-URGENT' THEN 'UPI-' || paid_to || '-h' || CAST(txn_id AS VARCHAR) || '@okbank-x'
               WHEN '2-HIGH' THEN 'UPI-' || paid_to || '-A' || lpad(CAST(txn_id AS VARCHAR), 11, '0') || ' TXN'
               WHEN '3-MEDIUM' THEN 'UPI-' || paid_to || '@okbank'
               WHEN '4-NOT SPECIFIED' THEN 'NEFT CR-' || paid_to
               ELSE '  IMPS ' || paid_to || '  ' END AS narration,
       CASE pr WHEN '4-NOT SPECIFIED' THEN 'NEFT CR-' || paid_to
               WHEN '5-LOW' THEN 'IMPS ' || paid_to ELSE paid_to END AS paid_to
FROM x"""))
def q_narration_payee(spark, sf):
    tx = transactions(spark, sf, extra=("o_orderpriority",), dealt=True)
    n = _narration(F.col("o_orderpriority"), F.col("paid_to"), F.col("txn_id"))
    return tx.select("txn_id", n.alias("narration")).withColumn("paid_to", S.clean_narration(F.col("narration")))


@register("statement_records", f"""
WITH x AS (
  SELECT user_id, event_id, event_type, ts,
         CAST(value AS DECIMAL(18,2)) AS amt,
         CAST(CAST(value AS DECIMAL(18,2)) * 100 AS DECIMAL(18,2)) AS bal,
         CAST(date_diff('day', DATE '{EPOCH}', CAST(ts AS DATE)) AS INTEGER) AS page_no,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS txn_no,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
y AS (SELECT *, lag(bal) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM x)
SELECT 'statement' AS source,
       CAST(user_id AS VARCHAR) || ':' || CAST(page_no AS VARCHAR) || ':' || CAST(txn_no AS VARCHAR) AS source_id,
       CAST(CASE WHEN rn = 1 THEN CASE WHEN amt <> 0 THEN amt END WHEN bal - p <> 0 THEN abs(bal - p) END AS DECIMAL(18,2)) AS amount,
       upper(event_type) || ' STORE' AS paid_to,
       CASE WHEN rn = 1 THEN CASE WHEN amt IS NOT NULL AND amt <> 0 THEN 'Debit' END
            WHEN bal - p < 0 THEN 'Debit' WHEN bal - p > 0 THEN 'Credit' END AS txn_type,
       lpad(CAST(event_id AS VARCHAR), 16, '0') AS reference_no,
       CAST(ts AS DATE) AS txn_date
FROM y""")
def q_statement_records(spark, sf):
    """Rendered statements -> assembled, typed, balance-derived type/amount, payee (S4..P13)."""
    return S.extract_statements(statement_lines(table(spark, sf, "events")))
