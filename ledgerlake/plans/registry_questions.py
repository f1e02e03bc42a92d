"""Registered question queries (full intents by entity linking, routed answers) and the stored dashboard cube."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import analytics as A
from ledgerlake.operators import ask as Q
from ledgerlake.operators import chat as CH
from ledgerlake.operators import cube as CU
from ledgerlake.operators import entities as EN
from ledgerlake.operators import search as SE
from ledgerlake.plans.registry import ORACLE, register, sql_str
from ledgerlake.plans.registry_more import _route_sql, _vec_docs, _VEC_SQL
from ledgerlake.plans.views import TRANSACTIONS_SQL, transactions
from ledgerlake.session import table

# Wordings of the questions asked about a customer; {} stand for segment, name, month, year.
WORDINGS = [
    "How much did I spend on {0} in {2} {3}?",
    "What is my biggest expense to {1} in {3}?",
    "Average received from {1}, {0} or {2}?",
    "Why did I pay {1} so much in {2}?",
    "Show transactions for {0}",
    "How many refunds from {1} since {3} {2}?",
    "Hello there",
]


def questions(spark, sf) -> DataFrame:
    """User turns of the conversations, each followed by a question about a customer of the tables:
    conv_id, turn, text."""
    conv = table(spark, sf, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    month = F.get(F.array(*[F.lit(m) for m in Q.MONTHS]), (F.col("conv_id") % 12).cast("int"))
    year = (1992 + F.col("turn") % 7).cast("string")
    marks = {"{0}": F.col("c_mktsegment"), "{1}": F.col("c_name"), "{2}": month, "{3}": year}
    ask = F.lit(None).cast("string")
    for k, wording in enumerate(WORDINGS):
        said = F.lit(wording)
        for mark, value in marks.items():
            said = F.replace(said, F.lit(mark), value)
        ask = F.when((F.col("conv_id") + F.col("turn")) % len(WORDINGS) == k, said).otherwise(ask)
    joined = conv.join(cust, F.col("conv_id") * 8 + F.col("turn") == F.col("c_custkey"))
    return joined.select("conv_id", "turn", F.concat_ws(" ", "text", ask).alias("text"))


def _questions_sql() -> str:
    ask = "NULL"
    month = "list_extract([" + ", ".join(sql_str(m) for m in Q.MONTHS) + "], CAST(conv_id % 12 AS INTEGER) + 1)"
    marks = {"{0}": "c_mktsegment", "{1}": "c_name", "{2}": month, "{3}": "CAST(1992 + turn % 7 AS VARCHAR)"}
    for k, wording in enumerate(WORDINGS):
        said = sql_str(wording)
        for mark, value in marks.items():
            said = f"replace({said}, '{mark}', {value})"
        ask = f"CASE WHEN (conv_id + turn) % {len(WORDINGS)} = {k} THEN {said} ELSE {ask} END"
    return f"""SELECT conv_id, turn, concat_ws(' ', text, {ask}) AS text
  FROM conversations JOIN customer ON conv_id * 8 + turn = c_custkey WHERE role = 'user'"""


def _entries_sql() -> str:
    given = [("month", m, m) for m in Q.MONTHS] + [("txn_type", t, w) for t, ws in EN.TYPE_WORDS.items() for w in ws]
    return f"""SELECT kind, phrase, n, min(value) AS value, list_position([{', '.join(sql_str(k) for k in EN.KINDS)}], kind) AS rank FROM (
    SELECT kind, value, array_to_string(w, ' ') AS phrase, len(w) AS n FROM (
      SELECT kind, value, regexp_extract_all(lower(spelt), '{EN.WORD}') AS w FROM (
        SELECT DISTINCT 'category' AS kind, category AS value, category AS spelt FROM e
        UNION ALL SELECT DISTINCT 'txn_type', txn_type, txn_type FROM e
        UNION ALL SELECT DISTINCT 'paid_to', paid_to, paid_to FROM e
        UNION ALL VALUES {', '.join(f"({sql_str(a)}, {sql_str(b)}, {sql_str(c)})" for a, b, c in given)}))) WHERE n > 0
  GROUP BY kind, phrase, n"""


#: e, q (questions), link (conv_id, turn and KINDS): places taken from the left, the longest first.
LINK_SQL = f"""WITH RECURSIVE e AS ({TRANSACTIONS_SQL}),
q AS ({_questions_sql()}),
ent AS ({_entries_sql()}),
w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{EN.WORD}') AS w FROM q),
i AS (SELECT *, unnest(range(1, len(w) + 1)) AS start FROM w),
m AS (
  SELECT conv_id, turn, start, ent.n, rank, kind, value
  FROM (SELECT *, unnest((SELECT list(DISTINCT n) FROM ent)) AS k FROM i) AS r
  JOIN ent ON ent.n = r.k AND ent.phrase = array_to_string(r.w[start:start + k - 1], ' ') AND start + k - 1 <= len(r.w)
  UNION ALL SELECT conv_id, turn, start, 1, 5, 'year', w[start] FROM i WHERE regexp_matches(w[start], '{EN.YEAR_WORD}')),
g AS (
  (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY start, n DESC, rank, value) AS o FROM m QUALIFY o = 1)
  UNION ALL
  (SELECT m.*, row_number() OVER (PARTITION BY m.conv_id, m.turn ORDER BY m.start, m.n DESC, m.rank, m.value) AS o
   FROM g JOIN m ON g.conv_id = m.conv_id AND g.turn = m.turn AND m.start >= g.start + g.n QUALIFY o = 1)),
link AS (
  SELECT conv_id, turn, {', '.join(f"arg_min(value, start) FILTER (kind = '{k}') AS {k}" for k in EN.KINDS)} FROM g GROUP BY conv_id, turn)"""


def _routed_sql() -> str:
    """conv_id, turn, route, metric of q."""
    return f"SELECT conv_id, turn, route, metric FROM ({_route_sql().replace('FROM conversations WHERE role = ' + sql_str('user'), 'FROM q')})"


@register("question_intent", LINK_SQL + f""",
r AS ({_routed_sql()})
SELECT r.conv_id, r.turn, route, metric, category, txn_type, paid_to, month, CAST(year AS INTEGER) AS year
FROM r LEFT JOIN link ON r.conv_id = link.conv_id AND r.turn = link.turn""")
def q_question_intent(spark, sf):
    asked = questions(spark, sf)
    return EN.full_intent(asked, EN.dictionary(transactions(spark, sf)), ["conv_id", "turn"]).drop("text")


def _terms_sql(table_: str, keys: str, text: str) -> str:
    """keys, p (place), c (share of the unit vector) of the words of a text."""
    words = f"regexp_extract_all(lower({text}), '{SE.WORD}')"
    place = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 256"
    return f"""SELECT {keys}, p, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS c FROM (
    SELECT {keys}, {place} AS p, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {keys}, unnest({words}) AS w FROM {table_}) GROUP BY ALL)"""


def _chat_oracle() -> str:
    match = " AND ".join(f"(s.{f} IS NULL OR s.{f} = d.{c})" for f, c in CH.FILTERS.items())
    months = ", ".join(sql_str(m) for m in Q.MONTHS)
    docs = _VEC_SQL.strip().removeprefix("WITH ").replace("e AS (", "e0 AS (", 1).replace("FROM e)", "FROM e0)")
    return LINK_SQL + f""",
rt AS ({_routed_sql()}),
{docs},
s AS (SELECT rt.conv_id, rt.turn, route, metric, category, coalesce(txn_type, CASE WHEN category IS NOT NULL THEN 'Debit' END) AS txn_type,
             paid_to, month, CAST(year AS INTEGER) AS year, q.text
      FROM rt JOIN q ON rt.conv_id = q.conv_id AND rt.turn = q.turn LEFT JOIN link ON rt.conv_id = link.conv_id AND rt.turn = link.turn),
fig AS (
  SELECT s.conv_id, s.turn, CAST(CAST(CASE any_value(metric)
           WHEN 'sum' THEN sum(amount) WHEN 'max' THEN max(amount) WHEN 'min' THEN min(amount) WHEN 'count' THEN count(amount)
           ELSE round(CAST(sum(amount) AS DOUBLE) / count(amount), 2) END AS DECIMAL(38,2)) AS VARCHAR) AS answer
  FROM s LEFT JOIN e ON (s.category IS NULL OR s.category = e.category) AND (s.txn_type IS NULL OR s.txn_type = e.txn_type)
    AND (s.paid_to IS NULL OR e.paid_to ILIKE '%' || s.paid_to || '%') AND (s.year IS NULL OR s.year = year(e.txn_date))
    AND (s.month IS NULL OR list_position([{months}], s.month) = month(e.txn_date))
  WHERE route = 'analytical' GROUP BY s.conv_id, s.turn),
pairs AS (SELECT s.conv_id, s.turn, d.id, d.document FROM s JOIN d ON {match} WHERE route = 'semantic'),
qt AS ({_terms_sql("(SELECT conv_id, turn, text FROM s WHERE route = 'semantic')", 'conv_id, turn', 'text')}),
dt AS ({_terms_sql('(SELECT DISTINCT id, document FROM pairs)', 'id', 'document')}),
dist AS (
  SELECT p.conv_id, p.turn, p.id, p.document, round(greatest(2 - 2 * coalesce(sum(qt.c * dt.c), 0), 0), {CH.PLACES}) AS distance
  FROM pairs p JOIN dt ON p.id = dt.id LEFT JOIN qt ON p.conv_id = qt.conv_id AND p.turn = qt.turn AND dt.p = qt.p GROUP BY ALL),
near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY distance, id) <= {CH.CONTEXT}),
ctx AS (SELECT conv_id, turn, string_agg(document || '.', '' ORDER BY distance DESC, id DESC) AS answer FROM near GROUP BY ALL)
SELECT s.conv_id, s.turn, route, CASE route WHEN 'analytical' THEN coalesce(fig.answer, '{CH.NO_ANSWER}')
       WHEN 'semantic' THEN coalesce(ctx.answer, '') ELSE '{CH.NO_ANSWER}' END AS answer
FROM s LEFT JOIN fig ON s.conv_id = fig.conv_id AND s.turn = fig.turn LEFT JOIN ctx ON s.conv_id = ctx.conv_id AND s.turn = ctx.turn"""


@register("chat_answers", _chat_oracle())
def q_chat_answers(spark, sf):
    """Every question answered by its route, searches over an index of all transactions."""
    from ledgerlake.streaming.ingest import run_dir

    path = run_dir(spark, "chat") + "/index"
    SE.append_index(SE.embed_digest(_vec_docs(spark, sf)), path, "b1")
    index = spark.read.parquet(path)
    return CH.answers(questions(spark, sf), transactions(spark, sf), index, ["conv_id", "turn"])


# ---------------------------------------------------------------- S12: the stored cube
def _cube(spark, sf) -> DataFrame:
    """The cube after two batches, the second added twice."""
    from ledgerlake.streaming.ingest import run_dir

    path, tx = run_dir(spark, "cube"), transactions(spark, sf)
    for batch, odd in (("b1", 0), ("b2", 1), ("b2", 1)):
        CU.add_batch(tx.filter(F.col("txn_id") % 2 == odd), path, batch)
    return CU.dashboard_cells(spark, path)


@register("cube_kpis", ORACLE["kpis"])
def q_cube_kpis(spark, sf):
    return CU.kpis(_cube(spark, sf))


@register("cube_month_type", ORACLE["month_type_sum"])
def q_cube_month_type(spark, sf):
    return A.month_type_sum(_cube(spark, sf))
