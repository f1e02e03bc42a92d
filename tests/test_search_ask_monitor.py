import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import ask as Q
from ledgerlake.operators import monitor as MO
from ledgerlake.operators import search as SE

META = "id string, category string, paid_to string, txn_type string, txn_month string, txn_year int, amount int"
ROWS = [
    ("a", "Petrol", "John", "Debit", "January", 2026, 500),
    ("b", "Petrol", "Shell", "Debit", "March", 2025, 12000),
    ("c", "Food", "John", "Credit", "January", 2026, 50),
    ("d", "Petrol", "Shell", "Debit", "March", 2025, 9000),
]


def test_filter_language_prompt_examples(spark):
    df = spark.createDataFrame(ROWS, META)
    ex1 = {"$and": [{"paid_to": "John"}, {"txn_month": "January"}, {"txn_year": 2026}, {"txn_type": "Debit"}]}
    ex2 = {"$and": [{"category": "Petrol"}, {"amount": {"$gt": 10000}}, {"txn_month": "March"},
                    {"txn_year": 2025}, {"txn_type": "Debit"}]}
    assert [r.id for r in df.filter(SE.compile_filter(ex1)).collect()] == ["a"]
    assert [r.id for r in df.filter(SE.compile_filter(ex2)).collect()] == ["b"]
    rng = {"amount": {"$gte": 500, "$lte": 9000}}
    assert sorted(r.id for r in df.filter(SE.compile_filter(rng)).collect()) == ["a", "d"]
    assert sorted(r.id for r in df.filter(SE.compile_filter({"category": "Food"})).collect()) == ["c"]
    with pytest.raises(ValueError):
        SE.compile_filter({"amount": {"$near": 3}})
    with pytest.raises(ValueError):
        SE.compile_filter({"$xor": []})
    with pytest.raises(ValueError):
        SE.compile_filter({"amount": {}})


def test_search_ranking_and_context(spark):
    vecs = [("x", [0.0, 0.0], "near"), ("y", [3.0, 4.0], "far"), ("z", [1.0, 0.0], "mid"), ("w", [1.0, 0.0], "tie")]
    df = spark.createDataFrame([(i, v, d, 1) for i, v, d in vecs], "id string, embedding array<float>, document string, g int")
    ranked = SE.search(df, [0.0, 0.0], {"g": 1})
    assert [(r.id, r.distance) for r in ranked.collect()] == [("x", 0.0), ("w", 1.0), ("z", 1.0), ("y", 25.0)]
    assert [r.id for r in SE.search(df, [0.0, 0.0], None, k=2).collect()] == ["x", "w"]
    pieces = SE.context_text(ranked).orderBy("position").collect()
    assert [p.position for p in pieces] == [1, 2, 3, 4]
    assert "".join(p.piece for p in pieces) == "far.mid.tie.near."
    assert [p.char_start for p in pieces] == [0, 4, 8, 12]
    two = ranked.withColumn("q", F.lit(1)).unionByName(ranked.filter(F.col("id") != "y").withColumn("q", F.lit(2)))
    per_q = SE.context_text(two, key=["q"]).orderBy("q", "position").collect()
    assert "".join(p.piece for p in per_q if p.q == 2) == "mid.tie.near."
    assert [(p.position, p.char_start) for p in per_q if p.q == 2] == [(1, 0), (2, 4), (3, 8)]


def test_embedding_index_skips_known_ids(spark):
    recs = spark.createDataFrame(
        [("h1", dt.date(2026, 1, 5), "Food", "Debit", Decimal("12.90"), "Cafe"),
         ("h2", None, None, "Credit", Decimal("3.00"), None)],
        "hashcode string, txn_date date, category string, txn_type string, amount decimal(18,2), paid_to string")
    idx = SE.index_new(recs, None)
    docs = {r.id: r for r in idx.collect()}
    assert docs["h1"].document == "On 2026-01-05 you made a Debit transaction of ₹12 for Food  to Cafe."
    assert docs["h2"].txn_month == "Unknown" and docs["h2"].txn_year is None
    assert len(docs["h1"].embedding) == 256
    assert SE.index_new(recs, idx.filter(F.col("id") == "h1")).count() == 1


def test_intents_against_brute_force(spark):
    rows = [(dt.date(2026, 1, 3), Decimal("10.00"), "Petrol", "Debit", "Raut Petroleum"),
            (dt.date(2026, 1, 9), Decimal("30.00"), "Petrol", "Debit", "Shell"),
            (dt.date(2026, 2, 1), Decimal("99.00"), "Petrol", "Debit", "Raut Petroleum"),
            (dt.date(2025, 1, 1), Decimal("5.00"), "Food", "Credit", "x")]
    tx = spark.createDataFrame(rows, "txn_date date, amount decimal(18,2), category string, txn_type string, paid_to string")
    intents = [
        {"intent_id": 1, "metric": "max", "filters": {"category": "Petrol", "txn_type": "Debit", "month": "January", "year": 2026}},
        {"intent_id": 2, "metric": "sum", "filters": {"paid_to": "raut"}},
        {"intent_id": 3, "metric": "avg", "filters": {"txn_type": "Debit"}},
        {"intent_id": 4, "metric": "count", "filters": {"category": "None"}},
        {"intent_id": 5, "metric": "min", "filters": {"category": "None"}},
    ]
    got = {r.intent_id: r.result for r in Q.answer_intents(tx, Q.intents_frame(spark, intents)).collect()}
    assert got == {1: Decimal("30.00"), 2: Decimal("109.00"), 3: Decimal("46.33"), 4: Decimal("0.00"), 5: None}
    sql, args = Q.intent_sql(intents[0])
    assert ":category" in sql and args["date_to"] == dt.date(2026, 2, 1) and "Petrol" not in sql
    with pytest.raises(ValueError):
        Q.intent_sql({"metric": "sum", "field": "amount) FROM x --", "filters": {}})
    assert Q.run_sql(spark, tx, sql, args).first().result == Decimal("30.00")


def test_routing(spark):
    qs = [(1, "How much did I spend on petrol in January 2026?"), (2, "Why did I pay John so much?"),
          (3, "hello there"), (4, "What was my biggest expense in march?")]
    got = {r.question_id: (r.route, r.metric, r.month, r.year)
           for r in Q.extract_intent(spark.createDataFrame(qs, "question_id int, text string")).collect()}
    assert got[1] == ("analytical", "sum", "January", 2026)
    assert got[2][0] == "semantic" and got[3][0] == "none"
    assert got[4] == ("analytical", "max", "March", None)


LOG = [
    "===== RUN_START 2026-01-19 06:00:01 =====",
    "Total emails found for 2026/01/19: 3",
    "Inserted: aa", "Inserted: bb", "Duplicate skipped: cc",
    "===== RUN_START 2026-01-19 18:00:00 =====",   # second run of the same date: ignored
    "Inserted: dd",
    "===== RUN_START 2026-01-20 06:00:01 =====",
    "Total emails found for 2026/01/20: lots",
    "Traceback (most recent call last)",
    "RuntimeError: boom",
    "===== RUN_START 2026-01-21 06:00:01 =====",
    "Total emails found for 2026/01/21: 1",
    "some Error here",
    "last line",
]


def test_run_summaries(spark, tmpdir_path):
    import os

    p = os.path.join(tmpdir_path, "cron.log")
    with open(p, "w") as f:
        f.write("\n".join(LOG) + "\n")
    log = MO.read_run_log(spark, p)
    got = {r.run_date: r for r in MO.daily_summary(log).collect()}
    a = got[dt.date(2026, 1, 19)]
    assert (a.emails_found, a.inserted, a.duplicates, a.error_found, a.error) == (3, 2, 1, False, "")
    b = got[dt.date(2026, 1, 20)]
    assert (b.emails_found, b.error_found, b.error) == (0, True, "RuntimeError: boom")
    c = got[dt.date(2026, 1, 21)]
    assert (c.emails_found, c.error_found, c.error) == (1, True, "last line")
    assert MO.daily_summary(log, dt.date(2026, 1, 22)).count() == 0
    msg = MO.summary_message(MO.daily_summary(log, dt.date(2026, 1, 20))).first()
    assert msg.subject == "❌ ERROR | Daily Expense Pipeline Summary | 2026-01-20"
    assert msg.body.endswith("Error_found: True\n\nError:\nRuntimeError: boom\n")


def test_recent_messages(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "bot", f"m{t}") for t in range(20)] + [(2, 0, "user", "only")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.recency): r.turn for r in MO.recent_messages(conv, 6).collect()}
    assert [got[(1, i)] for i in range(1, 7)] == [19, 18, 17, 16, 15, 14]
    assert got[(2, 1)] == 0 and len(got) == 7


def test_runs_are_kept_apart_by_file_and_bad_dates_pass(spark, tmpdir_path):
    import os

    for name, n in (("a.log", 2), ("b.log", 3)):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write("===== RUN_START 2026-01-19 06:00:01 =====\n" + "Inserted: x\n" * n + "===== RUN_START 2026-13-45 1 =====\nInserted: y\n")
    got = MO.daily_summary(MO.read_run_log(spark, tmpdir_path)).collect()
    assert sorted((r.file[-5:], r.run_date, r.inserted) for r in got) == [
        ("a.log", dt.date(2026, 1, 19), 2), ("b.log", dt.date(2026, 1, 19), 3)]


def test_search_ranks_unusable_vectors_last(spark):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert [r.id for r in SE.search(df, [1.0, 0.0], metric="cosine").collect()] == ["a", "e", "b", "c", "d"]
    assert [r.id for r in SE.search(df, [1.0, 0.0]).collect()] == ["a", "c", "e", "b", "d"]


def test_words_of_any_script_and_large_amounts(spark):
    docs = SE.embed_hashed(spark.createDataFrame([("नमस्ते दुनिया",)], "document string"))
    assert any(docs.first().embedding)
    recs = spark.createDataFrame([("h", None, None, None, Decimal("9999999999.50"), None)],
                                 "hashcode string, txn_date date, category string, txn_type string, amount decimal(18,2), paid_to string")
    assert SE.clean_metadata(recs).first().amount == 9999999999


def test_log_lines_are_numbered_over_splits(spark, tmpdir_path):
    """Files cut into many splits, with lines of all lengths, blank ones, CRLF ends and none at the end."""
    import random

    rnd = random.Random(5)
    texts = {f"{n}.log": [rnd.choice(["", "x" * rnd.randrange(300), "é漢", "a\rb"]) for _ in range(400)] for n in range(3)}
    for k, (name, lines) in enumerate(texts.items()):
        with open(os.path.join(tmpdir_path, name), "w", newline="") as f:
            f.write(("\r\n" if k else "\n").join(lines) + ("" if k == 2 else "\n"))
    open(os.path.join(tmpdir_path, "empty.log"), "w").close()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
        log = MO.read_run_log(spark, tmpdir_path)
        assert spark.read.text(tmpdir_path).rdd.getNumPartitions() > 20
        got: dict = {}
        for r in log.collect():
            got.setdefault(os.path.basename(r.file), {})[r.line_no] = r.line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    if texts["2.log"][-1] == "":
        texts["2.log"].pop()  # nothing after the last line end
    assert got == {name: dict(enumerate(lines)) for name, lines in texts.items()}
