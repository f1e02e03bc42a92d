"""Registered source/sink queries: undated mail list, day slice, parameterised SQL, source
union, schema-evolution read, rules file round trip, index append with the embedder,
currency labels and the statement ingest job.

Queries that write (rules file, stored table, index) write under a fresh folder of the
cluster's shared checkpoint dir, then read back, so they run the sink and the source.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import ask as Q
from ledgerlake.operators import categorise as C
from ledgerlake.operators import load as L
from ledgerlake.operators import search as SE
from ledgerlake.plans.registry import ORACLE, register, sql_str
from ledgerlake.plans.registry_ingest import (
    _LANDED_SQL, _RULE_SQL, _alerts, _parsed_cols, _records, landed_mails,
)
from ledgerlake.plans.registry_more import INTENTS, _VEC_SQL
from ledgerlake.plans.registry_statement import statement_lines
from ledgerlake.plans.sample_rules import PART_RULES
from ledgerlake.plans.views import TXN_COLUMNS, transactions, with_e
from ledgerlake.operators import parse_mail as PM
from ledgerlake.operators import statement as S
from ledgerlake.session import table
from ledgerlake.sources import mail as M
from ledgerlake.sources.rules import load_rules, read_rules, save_rules
from ledgerlake.streaming.ingest import run_dir

# ---------------------------------------------------------------- S3 / O5: undated mail list
@register("mail_latest", f"""
WITH m AS ({_LANDED_SQL})
SELECT * FROM m WHERE contains(lower(sender), '{M.BANK_SENDER}') AND regexp_matches(body, '{M.ALERT_WORDS_RE}')
ORDER BY received_at DESC, mail_id LIMIT {M.LIST_CAP_OLD}""")
def q_mail_latest(spark, sf):
    """Newest alert mails without a date window, at most the list cap (the cap is the feature)."""
    return M.latest_alert_mails(landed_mails(table(spark, sf, "events")))


# ---------------------------------------------------------------- S11 / R1: one day's rows
AS_OF = dt.date(1996, 3, 15)


@register("day_slice", with_e(f"SELECT * FROM e WHERE txn_date = DATE '{AS_OF}'"))
def q_day_slice(spark, sf):
    return SE.records_for_index(transactions(spark, sf), AS_OF).select(*TXN_COLUMNS)


# ---------------------------------------------------------------- S13 / R8: parameterised SQL
SQL_INTENT = INTENTS[0]


def _sql_intent_oracle() -> str:
    f = SQL_INTENT["filters"]
    return with_e(f"""
SELECT sum(amount) AS result FROM e
WHERE category = {sql_str(f['category'])} AND txn_type = {sql_str(f['txn_type'])}
  AND month(txn_date) = {Q.MONTHS.index(f['month']) + 1} AND year(txn_date) = {f['year']}""")


@register("sql_intent", _sql_intent_oracle())
def q_sql_intent(spark, sf):
    """The intent as SQL text with named parameters, run over the transactions view."""
    text, args = Q.intent_sql(SQL_INTENT)
    return Q.run_sql(spark, transactions(spark, sf), text, args)


# ---------------------------------------------------------------- U1: mail + statement records
_UNION_COLS = "source, source_id, amount, paid_to, txn_type, reference_no, txn_date"


def _union_oracle() -> str:
    return f"""
SELECT 'mail' AS source, CAST(NULL AS VARCHAR) AS source_id, amount, paid_to, txn_type, reference_no, txn_date
FROM ({ORACLE['mail_parse']}) mp
UNION ALL
SELECT {_UNION_COLS} FROM ({ORACLE['statement_records']}) sr"""


@register("source_union", _union_oracle())
def q_source_union(spark, sf):
    mail = _parsed_cols(PM.parse_alert(_alerts(spark, sf))).withColumn("source", F.lit("mail"))
    stmt = S.extract_statements(statement_lines(table(spark, sf, "events")))
    return L.union_sources(mail, stmt).select(*_UNION_COLS.split(", "))


# ---------------------------------------------------------------- S9: old files without txn_type
TYPE_ADDED = dt.date(1996, 1, 1)  # files written before this date have no txn_type column


@register("schema_evolution", with_e(f"""
SELECT txn_id, amount, paid_to, txn_date, category,
       CASE WHEN txn_date < DATE '{TYPE_ADDED}' THEN NULL ELSE txn_type END AS txn_type
FROM e"""))
def q_schema_evolution(spark, sf):
    """Rows stored in the old layout (no txn_type) and the new one, read as one table."""
    path = run_dir(spark, "schema_evolution") + "/table"
    tx = transactions(spark, sf)
    old = F.col("txn_date") < F.lit(TYPE_ADDED)
    tx.filter(old).drop("txn_type").write.parquet(path)
    tx.filter(~old).write.mode("append").parquet(path)
    return L.read_transactions(spark, path).select(*TXN_COLUMNS)


# ---------------------------------------------------------------- S6 / S7: rules file round trip
@register("rules_file_category", _RULE_SQL)
def q_rules_file_category(spark, sf):
    """Rules written as a JSON file, loaded (file order = priority), saved as a table version,
    read back, and applied to every part name."""
    base = run_dir(spark, "rules_file")
    doc = spark.createDataFrame([(json.dumps(PART_RULES),)], "value string")
    doc.coalesce(1).write.text(f"{base}/rules_json")
    save_rules(load_rules(spark, f"{base}/rules_json"), f"{base}/rules_table", "b1")
    stored = read_rules(spark, f"{base}/rules_table").filter(F.col("batch_id") == "b1")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return C.rule_category(part, stored, "p_name")


# ---------------------------------------------------------------- J3 / U3 / R3 / R4 / S14: index append
INDEXED_BEFORE = dt.date(1997, 1, 1)


@register("index_new", _VEC_SQL + f"""
SELECT id, document, CAST(256 AS INTEGER) AS n_dims, CAST(1.0 AS DOUBLE) AS norm FROM d
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.txn_date < DATE '{INDEXED_BEFORE}' AND f.hashcode = d.id)""")
def q_index_new(spark, sf):
    """Index the older rows, then embed only the records whose id is not in the index yet
    (left anti join); the default embedder normalises, so every vector has unit length."""
    path = run_dir(spark, "index") + "/vec_docs"
    rec = L.add_fingerprint(_records(spark, sf))
    SE.append_index(SE.index_new(rec.filter(F.col("txn_date") < F.lit(INDEXED_BEFORE)), None), path, "b1")
    new = SE.index_new(rec, spark.read.parquet(path))
    sq = F.aggregate(F.col("embedding"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return new.select("id", "document", F.size("embedding").alias("n_dims"), F.round(F.sqrt(sq), 4).alias("norm"))


# ---------------------------------------------------------------- X20: currency labels
@register("kpi_labels", f"""
SELECT '₹' || format('{{:,}}', CAST(round(total_spent, 0) AS BIGINT)) AS spent_label,
       '₹' || format('{{:,}}', CAST(round(total_received, 0) AS BIGINT)) AS received_label,
       '₹' || format('{{:,}}', CAST(round(net_balance, 0) AS BIGINT)) AS net_label
FROM ({ORACLE['kpis']}) k""")
def q_kpi_labels(spark, sf):
    from ledgerlake.functions.text import money_label
    from ledgerlake.operators import analytics as A

    k = A.kpis(transactions(spark, sf))
    return k.select(money_label("total_spent").alias("spent_label"), money_label("total_received").alias("received_label"),
                    money_label("net_balance").alias("net_label"))


# ---------------------------------------------------------------- S17: statement ingest job
def _statement_ingest_oracle() -> str:
    from ledgerlake.plans.registry_ingest import _rules_values_sql, sql_strip
    from ledgerlake.plans.registry_more import _fp_sql

    return f"""
WITH rules(category, keyword, priority) AS (VALUES {_rules_values_sql()}),
sr AS ({ORACLE['statement_records']}),
c AS (SELECT *, CASE WHEN paid_to IS NULL OR {sql_strip('paid_to')} = '' THEN 'SIP'
                     ELSE (SELECT arg_min(category, priority) FROM rules
                           WHERE contains(lower({sql_strip('paid_to')}), lower(keyword))) END AS category
      FROM sr)
SELECT {_fp_sql(L.HASH_KEYS)} AS hashcode, source, source_id, amount, paid_to, txn_type, reference_no, txn_date, category
FROM c"""


@register("statement_ingest", _statement_ingest_oracle())
def q_statement_ingest(spark, sf):
    """Statement lines -> good pages -> records -> rules -> fingerprint -> first copy per key."""
    from ledgerlake.plans.jobs import ingest_statement_lines
    from ledgerlake.sources.rules import rules_frame

    recs, _ = ingest_statement_lines(statement_lines(table(spark, sf, "events")), rules_frame(spark, PART_RULES))
    return recs.drop("ingest_seq")


@register("statement_load", _statement_ingest_oracle())
def q_statement_load(spark, sf):
    """The same chain from statement text (one text per statement) into the stored table, read back;
    a second load of the same statements adds nothing."""
    from ledgerlake.plans.jobs import load_statements
    from ledgerlake.sources.rules import rules_frame
    from ledgerlake.sources.statement import text_to_lines

    lines = statement_lines(table(spark, sf, "events"))
    pages = lines.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("page"))
    pages = pages.persist(StorageLevel.MEMORY_AND_DISK)  # read for its gaps and its texts, by both loads
    gaps = pages.groupBy("doc_id").agg(F.max("page_no").alias("last")).select("doc_id", F.explode(F.sequence(F.lit(0), "last")).alias("page_no"))
    texts = gaps.join(pages, ["doc_id", "page_no"], "left").groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("page", F.lit("")).alias("page")))), lambda x: x.page), "\f").alias("text"))
    base = run_dir(spark, "statement_load")
    rules = rules_frame(spark, PART_RULES)
    for batch in ("20240101", "20240102-retry"):
        load_statements(text_to_lines(texts), rules, base, batch)
    cols = ["hashcode", "source", "source_id", "amount", "paid_to", "txn_type", "reference_no", "txn_date", "category"]
    return spark.read.parquet(f"{base}/transactions").select(*cols)


# ---------------------------------------------------------------- S18 / T1 / A16: the mail run into the stored table
def _landed_payloads(spark, sf):
    """Orders as landed alert mails: HTML in a MIME tree; every 50th payload is no JSON, every 51st
    body is cut-off base64, every 53rd alert has a bad date, every 59th a bad amount."""
    from ledgerlake.plans.registry_ingest import _b64url

    a = _alerts(spark, sf)
    i = F.col("mail_id")
    text = F.when(i % 53 == 0, F.regexp_replace("text", r" on \d\d-\d\d-", " on 31-02-")).when(
        i % 59 == 0, F.regexp_replace("text", r"Rs\. ?[\d,.]+", "Rs. 1.2.3")).otherwise(F.col("text"))
    html = F.concat(F.lit("<html><body><p>INR &#8377; debit transaction</p><p>"), F.replace(text, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    data = F.when(i % 51 == 0, F.lit("A")).otherwise(_b64url(html))
    tree = F.concat(F.lit('{"mimeType":"multipart/mixed","parts":[{"mimeType":"text/plain","body":{}},{"mimeType":"text/html","body":{"data":"'), data, F.lit('"}}]}'))
    return a.select("mail_id", F.lit("alerts@mybank.example").alias("sender"), "received_at",
                    F.when(i % 50 == 0, F.lit('{"mimeType":')).otherwise(tree).alias("payload"))


_MAIL_ROWS = with_e("""
, r AS (SELECT txn_id, CAST(txn_id AS VARCHAR) AS reference_no, amount, paid_to, txn_type, txn_date FROM e
        WHERE txn_id % 50 <> 0 AND txn_id % 51 <> 0),
g AS (SELECT * FROM r WHERE txn_id % 53 <> 0 AND txn_id % 59 <> 0)""")


@register("mail_ingest", _MAIL_ROWS + "\nSELECT reference_no, amount, paid_to, txn_type, txn_date FROM g")
def q_mail_ingest(spark, sf):
    """The mail run in two overlapping batches; the stored table read back."""
    from ledgerlake.plans.jobs import run_mail_batch
    from ledgerlake.sources.rules import rules_frame

    base = run_dir(spark, "mail_ingest")
    mails, rules = _landed_payloads(spark, sf), rules_frame(spark, PART_RULES)
    for k, batch in enumerate(("20240101", "20240102-retry")):
        run_mail_batch(mails.filter(F.col("mail_id") % 4 >= k), rules, base, batch)
    return spark.read.parquet(f"{base}/transactions").select("reference_no", "amount", "paid_to", "txn_type", "txn_date")


@register("mail_ingest_counts", _MAIL_ROWS + """
, b AS (SELECT unnest(['20240101', '20240102']) AS batch_id, unnest([0, 1]) AS k)
SELECT batch_id, 'inserted' AS status, (SELECT count(*) FROM g WHERE txn_id % 4 >= k AND k = 0) AS n FROM b
UNION ALL SELECT batch_id, 'duplicate', (SELECT count(*) FROM g WHERE txn_id % 4 >= k AND k > 0) FROM b
UNION ALL SELECT batch_id, 'quarantined', (SELECT count(*) FROM r WHERE (txn_id % 53 = 0 OR txn_id % 59 = 0) AND txn_id % 4 >= k) FROM b""")
def q_mail_ingest_counts(spark, sf):
    """What each batch of the mail run inserted, skipped and set aside."""
    from ledgerlake.plans.jobs import run_mail_batch
    from ledgerlake.sources.rules import rules_frame

    base = run_dir(spark, "mail_counts")
    mails, rules = _landed_payloads(spark, sf), rules_frame(spark, PART_RULES)
    outs = [run_mail_batch(mails.filter(F.col("mail_id") % 4 >= k), rules, base, batch) for k, batch in enumerate(("20240101", "20240102"))]
    return outs[0].unionByName(outs[1]).select("batch_id", "status", "n")


# ---------------------------------------------------------------- S5: statement rows set aside one by one
def _spoilt_lines(spark, sf) -> DataFrame:
    """Statement lines of which every 41st row has a bad date, every 43rd a bad balance, every 47th a bad amount."""
    line = F.col("line")
    i = F.when(line.rlike(r"^\d\d/\d\d/\d\d "), F.regexp_extract(line, r" (\d{16}) ", 1).try_cast("long"))
    spoilt = F.when(i % 41 == 0, F.concat(F.lit("99"), F.substring(line, 3, 1 << 30))).otherwise(line)
    spoilt = F.when(i % 43 == 0, F.regexp_replace(spoilt, " [^ ]+$", " 1.2.3")).otherwise(spoilt)
    spoilt = F.when(i % 47 == 0, F.regexp_replace(spoilt, " [^ ]+( [^ ]+)$", " -$1")).otherwise(spoilt)
    return statement_lines(table(spark, sf, "events")).withColumn("line", spoilt)


@register("statement_quarantine", """
WITH x AS (SELECT event_id, row_number() OVER w AS rn, lag(event_id) OVER w AS before FROM events
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT unnest(['20240101', '20240102']) AS batch_id)
SELECT batch_id, CASE WHEN event_id % 41 = 0 THEN 'date' WHEN event_id % 43 = 0 THEN 'balance'
                      WHEN rn = 1 AND event_id % 47 = 0 THEN 'amount' WHEN rn > 1 AND before % 43 = 0 THEN 'previous' ELSE 'good' END AS status,
       count(*) AS n FROM x CROSS JOIN b GROUP BY ALL""")
def q_statement_quarantine(spark, sf):
    """Rows of two statement batches by what became of them; the second batch is loaded twice."""
    from ledgerlake.plans.jobs import load_statements, statement_counts
    from ledgerlake.sources.rules import rules_frame

    base = run_dir(spark, "statement_quarantine")
    lines, rules = _spoilt_lines(spark, sf), rules_frame(spark, PART_RULES)
    for batch in ("20240101", "20240102", "20240102"):
        load_statements(lines, rules, base, batch)
    return statement_counts(spark, base)


# ---------------------------------------------------------------- S7, C3: rules learned and kept by the mail run
def _landed(alerts: DataFrame) -> DataFrame:
    """Alert texts as landed mail: HTML in a MIME tree."""
    from ledgerlake.plans.registry_ingest import _b64url

    html = F.concat(F.lit("<html><body><p>INR &#8377; debit transaction</p><p>"), F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    tree = F.concat(F.lit('{"mimeType":"multipart/mixed","parts":[{"mimeType":"text/html","body":{"data":"'), _b64url(html), F.lit('"}}]}'))
    return alerts.select("mail_id", F.lit("alerts@mybank.example").alias("sender"), "received_at", tree.alias("payload"))


def _mail_learns_oracle() -> str:
    from ledgerlake.plans.registry_ingest import _LEARNED_PRIORITY, _learned_sql

    return _learned_sql() + f""",
m AS (SELECT category, keyword, priority FROM rules
      UNION ALL SELECT category, keyword, {_LEARNED_PRIORITY} FROM learned l WHERE keyword NOT IN (SELECT keyword FROM rules)),
o AS (SELECT p_partkey, lower(p_name) AS x FROM part),
f AS (SELECT p_partkey, x, (SELECT arg_min(category, priority) FROM rules WHERE contains(x, lower(keyword))) AS first,
             (SELECT arg_min(category, (priority, keyword)) FROM m WHERE contains(x, lower(keyword))) AS later FROM o)
SELECT CAST(p_partkey AS VARCHAR) AS reference_no, x AS paid_to,
       CASE WHEN p_partkey % 2 = 0 THEN coalesce(first, (SELECT category FROM learned WHERE keyword = x)) ELSE later END AS category
FROM f"""


@register("mail_learns", _mail_learns_oracle())
def q_mail_learns(spark, sf):
    """Two mail batches of one alert per part, the second run twice: what the first one's classifier
    labels is a rule of the second, and the rules table has a version per batch."""
    from ledgerlake.operators.categorise import PayeeClassifier
    from ledgerlake.operators.parse_mail import render_alert
    from ledgerlake.plans.jobs import run_mail_batch
    from ledgerlake.sources.rules import rules_frame

    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("txn_id"), F.col("p_retailprice").cast("decimal(18,2)").alias("amount"), F.lower("p_name").alias("paid_to"),
        F.lit(dt.date(2024, 1, 1)).alias("txn_date"), F.lit("Debit").alias("txn_type"))
    base = run_dir(spark, "mail_learns")
    mails = _landed(render_alert(part))
    for batch, odd in (("20240101", 0), ("20240102", 1), ("20240102", 1)):
        run_mail_batch(mails.filter(F.col("mail_id") % 2 == odd), rules_frame(spark, PART_RULES), base, batch, learner=PayeeClassifier)
    return spark.read.parquet(f"{base}/transactions").select("reference_no", "paid_to", "category")
