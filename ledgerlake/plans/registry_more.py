"""Registered search, question and monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import ask as Q
from ledgerlake.operators import load as L
from ledgerlake.operators import monitor as MO
from ledgerlake.operators import search as SE
from ledgerlake.plans.registry import register, sql_str
from ledgerlake.plans.registry_ingest import _REC_SQL, _records, sql_strip
from ledgerlake.plans.views import TRANSACTIONS_SQL
from ledgerlake.session import table


def _fp_sql(exprs: list[str]) -> str:
    parts = " || ".join(f"coalesce({sql_strip(f'lower(CAST({c} AS VARCHAR))')}, 'none') || '|'" for c in exprs)
    return f"left(sha256({parts}), 32)"

# ---------------------------------------------------------------- documents and search
_VEC_SQL = _REC_SQL.replace(
    "f AS (SELECT txn_id, ", "f AS (SELECT txn_id, amount, paid_to, category, txn_type, "
) + """,
v AS (SELECT hashcode AS id, coalesce(strftime(txn_date, '%Y-%m-%d'), 'Unknown') AS txn_date,
             coalesce(category, 'Unknown') AS category, coalesce(txn_type, 'Unknown') AS txn_type,
             CAST(trunc(amount) AS BIGINT) AS amount, coalesce(paid_to, 'Unknown') AS paid_to,
             coalesce(strftime(txn_date, '%B'), 'Unknown') AS txn_month, CAST(year(txn_date) AS INTEGER) AS txn_year
      FROM f),
d AS (SELECT *, 'On ' || txn_date || ' you made a ' || txn_type || ' transaction of ₹' ||
                coalesce(CAST(amount AS VARCHAR), 'Unknown') || ' for ' || category || '  to ' || paid_to || '.' AS document
      FROM v)"""


def _vec_docs(spark, sf) -> DataFrame:
    return SE.sentences(SE.clean_metadata(L.add_fingerprint(_records(spark, sf))))


@register("vec_documents", _VEC_SQL + "\nSELECT * FROM d")
def q_vec_documents(spark, sf):
    return _vec_docs(spark, sf).select("id", "txn_date", "category", "txn_type", "amount", "paid_to",
                                       "txn_month", "txn_year", "document")


META_FILTER = {"$and": [{"category": "BUILDING"}, {"amount": {"$gte": 250000}},
                        {"txn_month": "March"}, {"txn_type": "Debit"}]}


@register("meta_filter", _VEC_SQL + """
SELECT id, document FROM d
WHERE category = 'BUILDING' AND amount >= 250000 AND txn_month = 'March' AND txn_type = 'Debit'""")
def q_meta_filter(spark, sf):
    return _vec_docs(spark, sf).filter(SE.compile_filter(META_FILTER)).select("id", "document")


@register("null_audit", """
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE d.doc_id IS NULL) AS null_doc_id, count(*) FILTER (WHERE text IS NULL) AS null_text,
       count(*) FILTER (WHERE lang IS NULL) AS null_lang, count(*) FILTER (WHERE source IS NULL) AS null_source,
       count(*) FILTER (WHERE quality IS NULL) AS null_quality, count(*) FILTER (WHERE toxic IS NULL) AS null_toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_null_audit(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return SE.null_counts(docs.join(labels, "doc_id", "left"),
                          ["doc_id", "text", "lang", "source", "quality", "toxic"])


QUERY_VEC_ID = 0
SEARCH_FILTER = {"label": 3}
_DIST_SQL = """
, q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = {qid}),
r AS (SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1),
              lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(qv[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(qv[i] AS DOUBLE)))) AS distance
      FROM embeddings, q WHERE label = {label})"""


def _ranked(spark, sf) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    q = SE.query_vector(emb, QUERY_VEC_ID, "vec_id")
    return SE.search(emb, q, SEARCH_FILTER, id_col="vec_id")


@register("vector_search", "WITH x AS (SELECT 1)" + _DIST_SQL.format(qid=QUERY_VEC_ID, label=SEARCH_FILTER["label"])
          + "\nSELECT vec_id, round(distance, 6) AS distance FROM r")
def q_vector_search(spark, sf):
    return _ranked(spark, sf).select("vec_id", F.round("distance", 6).alias("distance"))


@register("context_text", "WITH x AS (SELECT 1)" + _DIST_SQL.format(qid=QUERY_VEC_ID, label=SEARCH_FILTER["label"]) + """
, p AS (SELECT vec_id, text || '.' AS piece, distance FROM r JOIN documents ON doc_id = vec_id)
SELECT vec_id, row_number() OVER (ORDER BY distance DESC, vec_id DESC) AS position, piece,
       CAST(coalesce(sum(length(piece)) OVER (ORDER BY distance DESC, vec_id DESC
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
FROM p""")
def q_context_text(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    ranked = _ranked(spark, sf).select("vec_id", "distance").join(docs, "vec_id")
    return SE.context_text(ranked, "text", id_col="vec_id")


# ---------------------------------------------------------------- questions
INTENTS = [
    {"intent_id": 1, "metric": "sum", "filters": {"category": "BUILDING", "txn_type": "Debit", "month": "March", "year": 1996}},
    {"intent_id": 2, "metric": "max", "filters": {"category": "AUTOMOBILE", "txn_type": "Debit", "year": 1997}},
    {"intent_id": 3, "metric": "avg", "filters": {"txn_type": "Credit", "paid_to": "00001"}},
    {"intent_id": 4, "metric": "count", "filters": {"txn_type": "Debit", "month": "December"}},
    {"intent_id": 5, "metric": "min", "filters": {"category": "NOPE", "txn_type": "Debit"}},
    {"intent_id": 6, "metric": "count", "filters": {"category": "NOPE"}},
]


def _intent_oracle() -> str:
    parts = []
    for it in INTENTS:
        f = it["filters"]
        w = ["TRUE"]
        if f.get("category"):
            w.append(f"category = {sql_str(f['category'])}")
        if f.get("txn_type"):
            w.append(f"txn_type = {sql_str(f['txn_type'])}")
        if f.get("paid_to"):
            w.append(f"paid_to ILIKE {sql_str('%' + f['paid_to'] + '%')}")
        if f.get("month"):
            w.append(f"month(txn_date) = {Q.MONTHS.index(f['month']) + 1}")
        if f.get("year"):
            w.append(f"year(txn_date) = {f['year']}")
        agg = {"sum": "sum(amount)", "max": "max(amount)", "min": "min(amount)", "count": "count(amount)",
               "avg": "round(CAST(sum(amount) AS DOUBLE) / count(amount), 2)"}[it["metric"]]
        parts.append(f"SELECT CAST({it['intent_id']} AS INTEGER) AS intent_id, '{it['metric']}' AS metric, "
                     f"CAST({agg} AS DECIMAL(38,2)) AS result FROM e WHERE {' AND '.join(w)}")
    from ledgerlake.plans.views import with_e

    return with_e("\nUNION ALL\n".join(parts))


@register("intent_answers", _intent_oracle())
def q_intent_answers(spark, sf):
    from ledgerlake.plans.views import transactions

    return Q.answer_intents(transactions(spark, sf), Q.intents_frame(spark, INTENTS))


@register("intent_many", """
WITH e AS (""" + TRANSACTIONS_SQL + """),
i AS (SELECT c_custkey AS intent_id, c_mktsegment AS category, c_name AS payee, 1992 + c_custkey % 7 AS y,
             c_custkey % 3 AS k FROM customer),
by_category AS (SELECT category, year(txn_date) AS y, sum(amount) AS s FROM e GROUP BY ALL),
by_payee AS (SELECT paid_to AS payee, sum(amount) AS s FROM e GROUP BY ALL),
by_year AS (SELECT paid_to AS payee, year(txn_date) AS y, sum(amount) AS s FROM e GROUP BY ALL),
r AS (SELECT intent_id, s FROM i LEFT JOIN by_category USING (category, y) WHERE k = 0
      UNION ALL SELECT intent_id, s FROM i LEFT JOIN by_payee USING (payee) WHERE k = 1
      UNION ALL SELECT intent_id, s FROM i LEFT JOIN by_year USING (payee, y) WHERE k = 2)
SELECT CAST(intent_id AS INTEGER) AS intent_id, 'sum' AS metric, CAST(s AS DECIMAL(38,2)) AS result FROM r""")
def q_intent_many(spark, sf):
    """An intent per customer: by category and year, by payee, or by payee and year."""
    from ledgerlake.plans.views import transactions

    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 3
    intents = c.select(
        F.col("c_custkey").cast("int").alias("intent_id"), F.lit("sum").alias("metric"), F.lit("amount").alias("field"),
        F.when(k == 0, F.col("c_mktsegment")).alias("category"), F.lit("").alias("txn_type"), F.lit(None).cast("string").alias("month"),
        F.when(k != 1, (1992 + F.col("c_custkey") % 7).cast("int")).alias("year"), F.when(k != 0, F.col("c_name")).alias("paid_to"))
    return Q.answer_intents(transactions(spark, sf), intents)


def _month_sql(x: str) -> str:
    m = f"nullif(regexp_extract({x}, '{Q.MONTH_RE}', 2), '')"
    return f"upper(left({m}, 1)) || substr({m}, 2)"


def _route_sql() -> str:
    t = "lower(text)"
    metric = "'sum'"
    for name, words in reversed(Q.METRIC_WORDS):
        metric = f"CASE WHEN regexp_matches({t}, '{Q.word_re(words)}') THEN '{name}' ELSE {metric} END"
    return f"""
SELECT conv_id, turn,
       CASE WHEN regexp_matches({t}, '{Q.word_re(Q.ANALYTICAL_WORDS)}') THEN 'analytical'
            WHEN regexp_matches({t}, '{Q.word_re(Q.SEMANTIC_WORDS)}') THEN 'semantic' ELSE 'none' END AS route,
       {metric} AS metric,
       {_month_sql(t)} AS month,
       CAST(nullif(regexp_extract({t}, '{Q.YEAR_RE}', 2), '') AS INTEGER) AS year
FROM conversations WHERE role = 'user'"""


@register("question_route", _route_sql())
def q_question_route(spark, sf):
    conv = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return Q.extract_intent(conv).select("conv_id", "turn", "route", "metric", "month", "year")


# ---------------------------------------------------------------- monitoring
def run_log_lines(events: DataFrame) -> DataFrame:
    """Events rendered as two cron logs (by user): one run per day (RUN_START, mail count, one line per
    event, a closing line) and a second, empty run on days that had errors."""
    day = F.col("ts").cast("date")
    et = F.col("event_type")
    h = F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 32)
    ev_line = (F.when(et.isin("purchase", "click", "view"), F.concat(F.lit("Inserted: "), h))
               .when(et == "signup", F.concat(F.lit("Duplicate skipped: "), h))
               .otherwise(F.concat(F.lit("RuntimeError: insert failed for event "), F.col("event_id").cast("string"))))
    log = F.concat(F.lit("cron"), F.pmod("user_id", F.lit(2)).cast("string"), F.lit(".log"))
    ev = events.select(log.alias("file"), (F.unix_micros(F.col("ts").cast("timestamp")) * 16 + 8).alias("line_no"), ev_line.alias("line"))
    days = events.groupBy(log.alias("file"), day.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(et == "error").alias("err"))
    b0 = F.unix_micros(F.col("d").cast("timestamp")) * 16
    b1 = F.unix_micros(F.date_add("d", 1).cast("timestamp")) * 16
    ds, dslash = F.date_format("d", "yyyy-MM-dd"), F.date_format("d", "yyyy/MM/dd")
    n = F.col("n").cast("string")

    def ln(no, text, cond=None):
        s = F.struct(no.alias("line_no"), text.alias("line"))
        return s if cond is None else F.when(cond, s)

    lines = F.array(
        ln(b0, F.concat(F.lit("===== RUN_START "), ds, F.lit(" 06:00:01 ====="))),
        ln(b0 + 1, F.concat(F.lit("Total emails found for "), dslash, F.lit(": "), n)),
        ln(b1 - 7, F.concat(F.lit("Run finished: "), n, F.lit(" events"))),
        ln(b1 - 6, F.concat(F.lit("===== RUN_START "), ds, F.lit(" 18:00:00 =====")), F.col("err")),
        ln(b1 - 5, F.concat(F.lit("Total emails found for "), dslash, F.lit(": 0")), F.col("err")),
        ln(b1 - 4, F.lit("Run finished: 0 events"), F.col("err")),
    )
    per_day = days.select("file", F.explode(F.filter(lines, lambda s: s.isNotNull())).alias("s")).select("file", "s.*")
    return ev.unionByName(per_day).select("file", "line_no", "line")


# Rendered log lines are numbered by microsecond x 16: one level-1 block = one hour.
LOG_BLOCK = 16 * 3_600_000_000

_SUMMARY_SQL = """
, s AS (SELECT 'cron' || CAST(user_id % 2 AS VARCHAR) || '.log' AS file, CAST(ts AS DATE) AS run_date, CAST(count(*) AS INTEGER) AS emails_found,
              count(*) FILTER (WHERE event_type IN ('purchase', 'click', 'view')) AS inserted,
              count(*) FILTER (WHERE event_type = 'signup') AS duplicates,
              bool_or(event_type = 'error') AS error_found,
              CASE WHEN bool_or(event_type = 'error') THEN 'Run finished: ' || CAST(count(*) AS VARCHAR) || ' events'
                   ELSE '' END AS error
       FROM events GROUP BY 1, 2)"""


@register("run_summary", "WITH x AS (SELECT 1)" + _SUMMARY_SQL + "\nSELECT * FROM s")
def q_run_summary(spark, sf):
    return MO.daily_summary(run_log_lines(table(spark, sf, "events")), block_size=LOG_BLOCK)


@register("run_log_files", "WITH x AS (SELECT 1)" + _SUMMARY_SQL + "\nSELECT * FROM s")
def q_run_log_files(spark, sf):
    """The same summaries from log files on disk, each read by as many tasks as it has splits."""
    from ledgerlake.streaming.ingest import run_dir

    path = run_dir(spark, "run_log")
    lines = run_log_lines(table(spark, sf, "events")).select("file", "line_no", "line")
    (lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "line")
     .write.partitionBy("file").text(path))
    log = MO.read_run_log(spark, path).withColumn("file", F.regexp_extract("file", "/file=([^/]+)/", 1))
    return MO.daily_summary(log, block_size=LOG_BLOCK)


@register("summary_message", "WITH x AS (SELECT 1)" + _SUMMARY_SQL + f"""
SELECT file, run_date,
       CASE WHEN error_found THEN '❌ ERROR' ELSE '✅ SUCCESS' END || ' | {MO.SUBJECT_PREFIX} | ' || strftime(run_date, '%Y-%m-%d') AS subject,
       '📌 Summary for ' || strftime(run_date, '%Y-%m-%d') || chr(10) || chr(10) || 'Emails found: ' || CAST(emails_found AS VARCHAR)
       || chr(10) || 'Inserted: ' || CAST(inserted AS VARCHAR) || chr(10) || 'Duplicate skipped: ' || CAST(duplicates AS VARCHAR)
       || chr(10) || 'Error_found: ' || CASE WHEN error_found THEN 'True' ELSE 'False' END
       || CASE WHEN error_found THEN chr(10) || chr(10) || 'Error:' || chr(10) || error ELSE '' END || chr(10) AS body
FROM s""")
def q_summary_message(spark, sf):
    return MO.summary_message(MO.daily_summary(run_log_lines(table(spark, sf, "events")), block_size=LOG_BLOCK))


@register("recent_messages", """
SELECT conv_id, turn, role, text, recency FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS recency FROM conversations)
WHERE recency <= 6""")
def q_recent_messages(spark, sf):
    return MO.recent_messages(table(spark, sf, "conversations"), 6)


# ---------------------------------------------------------------- streaming
@register("stream_ingest", f"""
SELECT event_id, user_id, ts, event_type, CAST(value AS DECIMAL(18,2)) AS amount,
       {_fp_sql(["event_id", "user_id", "event_type", "CAST(value AS DECIMAL(18,2))"])} AS hashcode
FROM events""")
def q_stream_ingest(spark, sf):
    """File stream run twice over the same files (second run with a fresh checkpoint):
    every event is stored once."""
    from ledgerlake.streaming import ingest as ST

    base = ST.run_dir(spark, "stream_ingest")
    for i in range(2):
        ST.ingest_events(spark, sf, f"{base}/table", f"{base}/ckpt{i}", file_glob="events.parquet")
    t = spark.read.parquet(f"{base}/table")
    return t.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "amount",
                    "hashcode")


def _late_files(spark, sf, base: str) -> None:
    """events in four files, out of time order, with a fifth of the rows in two files. Every core scans
    for a file, and its row groups are small, so that every core reads it."""
    ev = table(spark, sf, "events")
    for i in (2, 0, 3, 1):
        again = (F.pmod("event_id", F.lit(5)) == 0) & (F.pmod(F.col("event_id") + 4, F.lit(16)) == i)
        ev.filter((F.pmod(F.xxhash64("event_id"), F.lit(4)) == i) | again).repartition(1).write.mode("append").option(
            "parquet.block.size", 4 << 20).parquet(f"{base}/landed")


def _late_run(spark, sf) -> str:
    from ledgerlake.streaming import ingest as ST

    base = ST.run_dir(spark, "stream_late")
    _late_files(spark, sf, base)
    for i in range(2):  # a second checkpoint over the same files adds nothing
        ST.ingest_events(spark, f"{base}/landed", f"{base}/table", f"{base}/ckpt{i}", file_glob="*.parquet",
                         max_files_per_trigger=1 if i == 0 else None, totals_path=f"{base}/totals")
    return base


@register("stream_ingest_late", """
SELECT DISTINCT event_id, user_id, ts, event_type, CAST(value AS DECIMAL(18,2)) AS amount FROM events""")
def q_stream_ingest_late(spark, sf):
    """Several micro-batches out of time order with repeats: no row lost, none doubled."""
    t = spark.read.parquet(f"{_late_run(spark, sf)}/table")
    return t.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "amount")


@register("stream_suppressed", """
SELECT DISTINCT event_id, user_id, ts, event_type, CAST(value AS DECIMAL(18,2)) AS amount FROM events""")
def q_stream_suppressed(spark, sf):
    """The same files with repeats dropped by keyed state first: late rows still come once."""
    from ledgerlake.streaming import ingest as ST

    base = ST.run_dir(spark, "stream_suppressed")
    _late_files(spark, sf, base)
    ST.ingest_events(spark, f"{base}/landed", f"{base}/table", f"{base}/ckpt", "*.parquet", 1, suppress="1 hour")
    t = spark.read.parquet(f"{base}/table")
    return t.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "amount")


@register("stream_month_type", """
SELECT strftime(ts, '%Y-%m') AS month, event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total,
       count(*) AS n FROM events GROUP BY 1, 2""")
def q_stream_month_type(spark, sf):
    """Month and type sums kept current by the same stream, late rows included."""
    from ledgerlake.streaming import ingest as ST

    return ST.stored_totals(spark, f"{_late_run(spark, sf)}/totals")


@register("stream_daily_totals", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM events GROUP BY 1, 2""")
def q_stream_daily_totals(spark, sf):
    from ledgerlake.streaming import ingest as ST

    base = ST.run_dir(spark, "stream_daily_totals")
    ST.daily_totals(spark, sf, f"{base}/table", f"{base}/ckpt", file_glob="events.parquet")
    t = ST.latest_totals(spark, f"{base}/table", f"{base}/ckpt")
    return t.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "total")


# ---------------------------------------------------------------- flagship
def _flagship_sql() -> str:
    from ledgerlake.plans import jobs as J
    from ledgerlake.plans.registry_ingest import _rules_values_sql

    b = ", ".join(f"({sql_str(g)}, CAST({t} AS DECIMAL(18,2)), {'false' if g in J.FLAG_GROSS else 'true'})"
                  for g, t in J.FLAG_TARGETS.items())
    m = ", ".join(f"({sql_str(g)}, {sql_str(c)})" for g, cats in J.FLAG_MAP.items() for c in cats)
    return f"""
WITH rules(category, keyword, priority) AS (VALUES {_rules_values_sql()}),
r AS (SELECT CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) AS reference_no,
             CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, p_name AS paid_to, CAST(l_shipdate AS DATE) AS txn_date,
             CASE l_returnflag WHEN 'N' THEN 'Debit' WHEN 'R' THEN 'Credit' ELSE 'Unknown' END AS txn_type
      FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT *, CASE WHEN paid_to IS NULL OR {sql_strip('paid_to')} = '' THEN 'SIP'
                     ELSE (SELECT arg_min(category, priority) FROM rules
                           WHERE contains(lower({sql_strip('paid_to')}), lower(keyword))) END AS category,
             {_fp_sql(["amount", "paid_to", "reference_no", "txn_date", "txn_type"])} AS hashcode FROM r),
u AS (SELECT DISTINCT ON (hashcode) * FROM c),
b(budget_group, target, net_credit) AS (VALUES {b}),
m(budget_group, category) AS (VALUES {m}),
pc AS (SELECT category, sum(CASE WHEN txn_type = 'Debit' THEN amount END) AS debit,
              sum(CASE WHEN txn_type = 'Credit' THEN amount END) AS credit
       FROM u WHERE category IS NOT NULL GROUP BY category),
pg AS (SELECT m.budget_group, sum(debit) AS debit, sum(credit) AS credit FROM m JOIN pc USING (category) GROUP BY 1),
x AS (SELECT b.budget_group, CAST(b.target AS DECIMAL(18,2)) AS target,
             CAST(coalesce(pg.debit, 0) - CASE WHEN b.net_credit THEN coalesce(pg.credit, 0) ELSE 0 END AS DECIMAL(38,2)) AS actual
      FROM b LEFT JOIN pg USING (budget_group))
SELECT budget_group, target, actual, CAST(target - actual AS DECIMAL(38,2)) AS variance,
       CASE WHEN target > 0 THEN round(CAST(target - actual AS DOUBLE) / CAST(target AS DOUBLE) * 100, 4) ELSE 0.0 END AS variance_pct,
       CASE WHEN target - actual < 0 THEN 'Over Budget' ELSE 'Under Budget' END AS status
FROM x"""


@register("flagship_budget", _flagship_sql())
def q_flagship_budget(spark, sf):
    from ledgerlake.plans.jobs import flagship

    return flagship(spark, sf)
