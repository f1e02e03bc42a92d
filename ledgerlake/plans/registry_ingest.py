"""Registered ingest queries: mail selection and parsing, MIME, HTML text, rules,
fingerprint, first copy, anti-join load. Feeds are rendered from the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import EDGE_SPACE, HTML_ENTITIES, fingerprint, html_text_lines
from ledgerlake.operators import categorise as C
from ledgerlake.operators import load as L
from ledgerlake.operators import parse_mail as PM
from ledgerlake.plans.registry import register, sql_str
from ledgerlake.plans.views import TRANSACTIONS_SQL, transactions, with_e
from ledgerlake.session import spread, table
from ledgerlake.sources import mail as M
from ledgerlake.sources.rules import CATEGORY_STRIDE, LEARNED_SLOT, read_rules, rules_frame, save_rules

# ---------------------------------------------------------------- shared SQL pieces
def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE_SPACE}', '', 'g')"


def sql_fingerprint(cols: list[str]) -> str:
    parts = " || ".join(f"coalesce({sql_strip(f'lower(CAST({c} AS VARCHAR))')}, 'none') || '|'" for c in cols)
    return f"left(sha256({parts}), 32)"


# ---------------------------------------------------------------- mail
MAIL_DAY = dt.date(2024, 1, 15)
NO_REF_PRIORITY = "5-LOW"  # alerts of these orders are rendered without the reference sentence


def _alerts(spark, sf, with_ref=None):
    tx = transactions(spark, sf, extra=("o_orderpriority",), dealt=True)
    cond = None if with_ref is None else (F.col("o_orderpriority") != F.lit(with_ref))
    return PM.render_alert(tx, cond)


def _parsed_cols(df: DataFrame) -> DataFrame:
    return df.select("reference_no", "amount", "paid_to", "txn_type", "txn_date")


@register("mail_parse", with_e("""
SELECT CAST(txn_id AS VARCHAR) AS reference_no, amount, paid_to, txn_type, txn_date FROM e"""))
def q_mail_parse(spark, sf):
    return _parsed_cols(PM.parse_alert(_alerts(spark, sf)))


@register("mail_ref_filter", f"""
WITH e AS ({TRANSACTIONS_SQL.replace("AS txn_type", "AS txn_type, o.o_orderpriority")})
SELECT CAST(txn_id AS VARCHAR) AS reference_no, amount, paid_to, txn_type, txn_date FROM e
WHERE o_orderpriority <> {sql_str(NO_REF_PRIORITY)}""")
def q_mail_ref_filter(spark, sf):
    return _parsed_cols(PM.with_reference(PM.parse_alert(_alerts(spark, sf, NO_REF_PRIORITY))))


def landed_mails(events: DataFrame) -> DataFrame:
    """Events as landed mails: sender by event type, body text with or without alert words."""
    v = F.col("value").cast("decimal(18,2)").cast("string")
    et = F.col("event_type")
    body = (F.when(et == "purchase", F.concat(F.lit("Rs."), v, F.lit(" spent on card")))
            .when(et == "click", F.concat(F.lit("INR "), v, F.lit(" transaction noted")))
            .when(et == "view", F.concat(F.lit("Monthly newsletter "), v))
            .when(et == "signup", F.concat(F.lit("Welcome offer worth Rs."), v))
            .otherwise(F.concat(F.lit("Alert: debit of "), v, F.lit(" failed"))))
    sender = F.when(et == "signup", F.lit("promo@shop.example")).otherwise(F.lit("alerts@mybank.example"))
    return events.select(F.col("event_id").alias("mail_id"), sender.alias("sender"),
                         F.col("ts").alias("received_at"), body.alias("body"))


_LANDED_SQL = """
SELECT event_id AS mail_id,
       CASE WHEN event_type = 'signup' THEN 'promo@shop.example' ELSE 'alerts@mybank.example' END AS sender,
       ts AS received_at,
       CASE event_type WHEN 'purchase' THEN 'Rs.' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' spent on card'
                       WHEN 'click' THEN 'INR ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' transaction noted'
                       WHEN 'view' THEN 'Monthly newsletter ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
                       WHEN 'signup' THEN 'Welcome offer worth Rs.' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
                       ELSE 'Alert: debit of ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' failed' END AS body
FROM events"""


@register("mail_day_filter", f"""
WITH m AS ({_LANDED_SQL})
SELECT * FROM m WHERE contains(lower(sender), '{M.BANK_SENDER}') AND regexp_matches(body, '{M.ALERT_WORDS_RE}')
  AND received_at >= TIMESTAMP '{MAIL_DAY} 00:00:00' AND received_at < TIMESTAMP '{MAIL_DAY + dt.timedelta(days=1)} 00:00:00'""")
def q_mail_day_filter(spark, sf):
    return M.alert_mails(landed_mails(table(spark, sf, "events")), MAIL_DAY)


@register("mail_today", f"""
WITH m AS ({_LANDED_SQL})
SELECT mail_id, sender, body FROM m WHERE contains(lower(sender), '{M.BANK_SENDER}') AND regexp_matches(body, '{M.ALERT_WORDS_RE}')
  AND received_at >= TIMESTAMP '{MAIL_DAY} 00:00:00' AND received_at < TIMESTAMP '{MAIL_DAY + dt.timedelta(days=1)} 00:00:00'""")
def q_mail_today(spark, sf):
    """Today's alerts, of mails moved so that the tables' mail day is today."""
    today = dt.datetime.now(dt.timezone.utc).date()
    mails = landed_mails(table(spark, sf, "events"))
    moved = F.col("received_at") + F.expr(f"INTERVAL '{(today - MAIL_DAY).days}' DAY")
    return M.todays_alert_mails(mails.withColumn("received_at", moved)).select("mail_id", "sender", "body")


# ---------------------------------------------------------------- MIME and HTML
def _b64url(c):
    # base64() may wrap long output in CRLF-separated lines; a mail payload keeps one line.
    b = F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[\r\n]", "")
    return F.rtrim(F.replace(F.replace(b, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_")), F.lit("="))


def mime_payloads(pages: DataFrame) -> DataFrame:
    """Pages wrapped as mail MIME trees of six shapes (root body, alternative, nested,
    container fallback, HTML without data before a real one, seven levels deep)."""
    h = _b64url(F.col("html"))
    t = _b64url(F.col("url"))
    leaf = lambda mime, d: F.concat(F.lit('{"mimeType":"' + mime + '","body":{"data":"'), d, F.lit('"}}'))

    def multi(mime, *parts):
        out = [F.lit('{"mimeType":"' + mime + '","parts":[')]
        for i, p in enumerate(parts):
            if i:
                out.append(F.lit(","))
            out.append(p)
        out.append(F.lit("]}"))
        return F.concat(*out)

    deep = leaf("text/html", h)
    for _ in range(7):
        deep = multi("multipart/mixed", leaf("text/plain", t), deep)
    shapes = [
        leaf("text/html", h),
        multi("multipart/alternative", leaf("text/plain", t), leaf("text/html", h)),
        multi("multipart/mixed",
              multi("multipart/alternative", leaf("text/plain", t), leaf("text/html", h)),
              F.lit('{"mimeType":"application/pdf","body":{"attachmentId":"a1"}}')),
        multi("multipart/mixed", leaf("text/plain", t),
              F.concat(F.lit('{"mimeType":"multipart/related","body":{"data":"'), h,
                       F.lit('"},"parts":[{"mimeType":"image/png","body":{"data":""}}]}'))),
        multi("multipart/mixed", leaf("text/html", F.lit("")), leaf("text/plain", t), leaf("text/html", h)),
        deep,
    ]
    k = F.pmod(F.xxhash64("url"), F.lit(len(shapes)))
    payload = shapes[-1]
    for i in range(len(shapes) - 2, -1, -1):
        payload = F.when(k == i, shapes[i]).otherwise(payload)
    return pages.select(F.col("page_id").alias("mail_id"), payload.alias("payload"))


@register("mime_body", "SELECT page_id, html AS body FROM pages")
def q_mime_body(spark, sf):
    return M.mime_body(mime_payloads(spread(table(spark, sf, "pages")))).select(
        F.col("mail_id").alias("page_id"), "body")


def _html_lines_sql(x: str) -> str:
    h = x
    for pat in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"<![^>]*>"):
        h = f"regexp_replace({h}, '{pat}', '', 'g')"
    h = f"regexp_replace({h}, '<[^>]+>', chr(10), 'g')"
    for ent, ch in HTML_ENTITIES:
        h = f"replace({h}, {sql_str(ent)}, {sql_str(ch)})"
    return (f"array_to_string(list_filter(list_transform(string_split({h}, chr(10)), lambda x: {sql_strip('x')}), "
            f"lambda x: x <> ''), chr(10))")


@register("html_lines", f"SELECT page_id, {_html_lines_sql('html')} AS text FROM pages")
def q_html_lines(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", html_text_lines(F.col("html")).alias("text"))


# ---------------------------------------------------------------- rules
from ledgerlake.plans.sample_rules import PART_RULES  # noqa: E402


def _rules_values_sql() -> str:
    return ", ".join(
        f"({sql_str(cat)}, {sql_str(kw)}, {ci * CATEGORY_STRIDE + ki})"
        for ci, (cat, kws) in enumerate(PART_RULES.items()) for ki, kw in enumerate(kws)
    )


_RULE_SQL = f"""
WITH rules(category, keyword, priority) AS (VALUES {_rules_values_sql()})
SELECT p_partkey, p_name,
       CASE WHEN p_name IS NULL OR {sql_strip('p_name')} = '' THEN 'SIP'
            ELSE (SELECT arg_min(category, priority) FROM rules
                  WHERE contains(lower({sql_strip('p_name')}), lower(keyword))) END AS category
FROM part"""


@register("rule_category", _RULE_SQL)
def q_rule_category(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return C.rule_category(part, rules_frame(spark, PART_RULES), "p_name")


@register("rule_category_join", _RULE_SQL)
def q_rule_category_join(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return C.rule_category(part, rules_frame(spark, PART_RULES), "p_name", strategy="join")


def _learned_sql() -> str:
    """Naive Bayes over character trigrams as plain aggregates, for unmatched part names."""
    tri = lambda x: f"unnest([substr('  ' || lower({x}) || '  ', i, 3) for i in range(1, length({x}) + 3)])"
    return f"""
WITH rules(category, keyword, priority) AS (VALUES {_rules_values_sql()}),
u AS (SELECT DISTINCT lower({sql_strip('p_name')}) AS x FROM part
      WHERE {sql_strip('p_name')} <> '' AND NOT EXISTS (SELECT 1 FROM rules WHERE contains(lower({sql_strip('p_name')}), lower(keyword)))),
tr AS (SELECT category, {tri('keyword')} AS t FROM rules),
per AS (SELECT category, t, count(*) AS n FROM tr GROUP BY ALL),
v AS (SELECT count(DISTINCT t) AS v FROM per),
lab AS (SELECT category, count(*) AS words, any_value(g) AS grams, min(priority) AS p
        FROM rules JOIN (SELECT category, sum(n) AS g FROM per GROUP BY 1) USING (category) GROUP BY 1),
g AS (SELECT x, t, count(*) AS k FROM (SELECT x, {tri('x')} AS t FROM u) WHERE t IN (SELECT t FROM per) GROUP BY ALL),
gain AS (SELECT x, category, sum(k * (ln(n + 1) - ln(1))) AS gain FROM g JOIN per USING (t) GROUP BY ALL),
sc AS (SELECT x, category, round(ln(words / (SELECT count(*) FROM rules)) + coalesce(gain, 0)
              + a * (ln(1) - ln(grams + (SELECT v FROM v))), {C.PayeeClassifier.SCALE}) AS s
       FROM (SELECT x, sum(k) AS a FROM g GROUP BY x) CROSS JOIN lab LEFT JOIN gain USING (x, category)),
best AS (SELECT x, category FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, category) AS rn FROM sc) WHERE rn = 1),
learned AS (SELECT coalesce(best.category, '{C.NO_EVIDENCE}') AS category, u.x AS keyword FROM u LEFT JOIN best USING (x))"""


_LEARNED_PRIORITY = f"""coalesce((SELECT CAST(p // {CATEGORY_STRIDE} * {CATEGORY_STRIDE} + {LEARNED_SLOT} AS BIGINT) FROM lab WHERE lab.category = l.category),
         (SELECT CAST(max(priority) // {CATEGORY_STRIDE} * {CATEGORY_STRIDE} + {CATEGORY_STRIDE} + {LEARNED_SLOT} AS BIGINT) FROM rules))"""


def _learned(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    rules = rules_frame(spark, PART_RULES)
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    ruled = C.rule_category(part, rules, "p_name")
    clf = C.PayeeClassifier().fit(rules)
    return part, rules, C.learned_rules(ruled.filter(F.col("category").isNull()), rules, clf, "p_name", "b1")


@register("learn_rules", _learned_sql() + f"""
SELECT category, keyword, {_LEARNED_PRIORITY} AS priority, 'learned' AS source, 'b1' AS batch_id FROM learned l
WHERE keyword NOT IN (SELECT keyword FROM rules)""")
def q_learn_rules(spark, sf):
    """Unmatched part names -> classifier labels -> learned rules merged after the file rules."""
    _, rules, learned = _learned(spark, sf)
    return C.merge_rules(rules, learned).filter(F.col("source") == "learned")


@register("learn_two_batches", _learned_sql() + f""",
m AS (SELECT category, keyword, priority FROM rules
      UNION ALL SELECT category, keyword, {_LEARNED_PRIORITY} FROM learned l WHERE keyword NOT IN (SELECT keyword FROM rules))
SELECT p_partkey, p_name,
       CASE WHEN p_name IS NULL OR {sql_strip('p_name')} = '' THEN 'SIP'
            ELSE (SELECT arg_min(category, (priority, keyword)) FROM m WHERE contains(lower({sql_strip('p_name')}), lower(keyword))) END AS category
FROM part""")
def q_learn_two_batches(spark, sf):
    """The first batch's learned rules are saved with the file's, read back and label the second batch."""
    from ledgerlake.streaming.ingest import run_dir

    part, rules, learned = _learned(spark, sf)
    path = run_dir(spark, "learned") + "/rules"
    save_rules(C.merge_rules(rules, learned), path, "b1")
    return C.rule_category(part, read_rules(spark, path), "p_name")


# ---------------------------------------------------------------- fingerprint and load
def _records(spark, sf) -> DataFrame:
    """Parsed-transaction records from E (reference = txn id)."""
    return transactions(spark, sf).withColumn("reference_no", F.col("txn_id").cast("string"))


_REC_SQL = f"""
WITH e AS ({TRANSACTIONS_SQL}),
r AS (SELECT *, CAST(txn_id AS VARCHAR) AS reference_no FROM e),
f AS (SELECT txn_id, {sql_fingerprint(L.HASH_KEYS)} AS hashcode, txn_date FROM r)"""


@register("fingerprint", _REC_SQL + "\nSELECT txn_id, hashcode FROM f")
def q_fingerprint(spark, sf):
    return L.add_fingerprint(_records(spark, sf)).select("txn_id", "hashcode")


KEY_FIELDS = ["txn_date", "amount"]


@register("fingerprint_keys", _REC_SQL.rsplit("f AS (", 1)[0] + f"""f AS (SELECT txn_id, {sql_fingerprint(KEY_FIELDS)} AS hashcode FROM r)
SELECT txn_id, hashcode FROM f""")
def q_fingerprint_keys(spark, sf):
    """The fingerprint over the fields that a configuration file names."""
    from ledgerlake.streaming.ingest import run_dir

    path = run_dir(spark, "hash_keys")
    spark.createDataFrame([("[HASH]\nkeys = " + " , ".join(KEY_FIELDS) + "\n",)], "value string").coalesce(1).write.text(path)
    return L.add_fingerprint(_records(spark, sf), L.load_hash_keys(spark, path)).select("txn_id", "hashcode")


@register("dedup_first", """
SELECT doc_id, hashcode FROM (
  SELECT doc_id, sha256(text) AS hashcode, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn
  FROM documents) WHERE rn = 1""")
def q_dedup_first(spark, sf):
    docs = spread(table(spark, sf, "documents")).select("doc_id", F.sha2(F.col("text"), 256).alias("hashcode"))
    return L.first_copy(docs, "hashcode", "doc_id").select("doc_id", "hashcode")


STORED_BEFORE = dt.date(1998, 1, 1)   # rows before this date are "already stored"
RESENT_FROM = dt.date(1999, 1, 1)     # rows from this date arrive twice in the batch
RESENT_OFFSET = 10 ** 12


def _load_batch(spark, sf):
    rec = L.add_fingerprint(_records(spark, sf)).withColumn("ingest_seq", F.col("txn_id"))
    resent = rec.filter(F.col("txn_date") >= F.lit(RESENT_FROM)).withColumn(
        "ingest_seq", F.col("txn_id") + F.lit(RESENT_OFFSET))
    batch = rec.unionByName(resent)
    stored = rec.filter(F.col("txn_date") < F.lit(STORED_BEFORE)).select("hashcode")
    return batch, stored


@register("append_new", _REC_SQL + f"""
SELECT txn_id, hashcode FROM f
WHERE NOT EXISTS (SELECT 1 FROM f s WHERE s.txn_date < DATE '{STORED_BEFORE}' AND s.hashcode = f.hashcode)""")
def q_append_new(spark, sf):
    batch, stored = _load_batch(spark, sf)
    return L.new_rows(batch, stored).select("txn_id", "hashcode")


@register("load_counts", _REC_SQL + f"""
, b AS (SELECT hashcode, txn_id AS seq, txn_date FROM f
        UNION ALL SELECT hashcode, txn_id + {RESENT_OFFSET}, txn_date FROM f WHERE txn_date >= DATE '{RESENT_FROM}'),
s AS (SELECT DISTINCT hashcode FROM f WHERE txn_date < DATE '{STORED_BEFORE}'),
t AS (SELECT CASE WHEN hashcode IN (SELECT hashcode FROM s)
                    OR row_number() OVER (PARTITION BY hashcode ORDER BY seq) > 1 THEN 'duplicate'
                  ELSE 'inserted' END AS status FROM b)
SELECT status, count(*) AS n FROM t GROUP BY status""")
def q_load_counts(spark, sf):
    batch, stored = _load_batch(spark, sf)
    return L.count_load(batch, stored)
