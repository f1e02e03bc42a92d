import datetime as dt
import os
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlake.functions.text import money_label
from ledgerlake.operators import analytics as A
from ledgerlake.operators import load as L
from ledgerlake.operators import search as SE
from ledgerlake.plans import jobs as J
from ledgerlake.sources.rules import rules_frame
from ledgerlake.sources.statement import text_to_lines


def test_old_rows_without_type_read_as_null(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "expenses")
    old = spark.createDataFrame([("h1", Decimal("5.00"))], "hashcode string, amount decimal(18,2)")
    new = spark.createDataFrame([("h2", Decimal("6.00"), "Debit")], "hashcode string, amount decimal(18,2), txn_type string")
    old.write.parquet(os.path.join(p, "batch_id=old"))
    new.write.parquet(os.path.join(p, "batch_id=new"))
    got = {r.hashcode: r.txn_type for r in L.read_transactions(spark, p).collect()}
    assert got == {"h1": None, "h2": "Debit"}


def test_union_of_sources(spark):
    mail = spark.createDataFrame([("mail", "m1", Decimal("1.00"))], "source string, source_id string, amount decimal(18,2)")
    stmt = spark.createDataFrame([("statement", "s1", "x")], "source string, source_id string, paid_to string")
    rows = {r.source_id: (r.amount, r.paid_to) for r in L.union_sources(mail, stmt).collect()}
    assert rows == {"m1": (Decimal("1.00"), None), "s1": (None, "x")}


def test_statement_ingest_job(spark):
    text = "\n".join(["01/02/26 UPI-PIZZA PLACE-h1@ok 1234567890123456 01/02/26 100.00 900.00",
                      "02/02/26 UPI-PIZZA PLACE-h1@ok 1234567890123456 02/02/26 100.00 800.00"])
    bad = "\f".join(["01/03/26 OK 1.00 2.00", "broken � page"])
    docs = spark.createDataFrame([("d1", text), ("d2", bad)], "doc_id string, text string")
    recs, quarantined = J.ingest_statement_lines(text_to_lines(docs), rules_frame(spark, {"Food": ["pizza"]}))
    got = [(r.paid_to, r.category, r.txn_type, r.amount) for r in recs.collect()]
    assert ("PIZZA PLACE", "Food", "Debit", Decimal("100.00")) in got and len(got) == 3
    assert {r.doc_id for r in quarantined.collect()} == {"d2"}


def test_small_helpers(spark):
    df = spark.createDataFrame([(Decimal("1234.50"), dt.date(2026, 1, 2)), (Decimal("7.00"), dt.date(2026, 1, 3))],
                               "amount decimal(18,2), txn_date date")
    assert [r[0] for r in df.select(money_label("amount")).collect()] == ["₹1,235", "₹7"]
    assert SE.records_for_index(df, dt.date(2026, 1, 3)).count() == 1
    frame = A.dashboard_frame(df.withColumns({"category": F.lit("c"), "txn_type": F.lit("Debit"), "paid_to": F.lit("p")}))
    assert frame.is_cached and set(frame.columns) >= {"month", "day_of_week", "week"}
    frame.unpersist()


def test_ingest_landed_mail(spark):
    import base64
    import json

    def b64(s):
        return base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")

    html = ("<html><body><p>Rs.1,234.50 has been debited from account to VPA shop@okbank PIZZA CORNER on 09-02-26."
            "</p><p>Your UPI transaction reference number is 123456.</p></body></html>")
    tree = {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": b64("x")}},
                                                           {"mimeType": "text/html", "body": {"data": b64(html)}}]}
    rows = [(1, "alerts@mybank.example", dt.datetime(2026, 2, 9, 8), json.dumps(tree)),
            (2, "alerts@mybank.example", dt.datetime(2026, 2, 9, 9), json.dumps(tree)),        # same alert again
            (3, "news@shop.example", dt.datetime(2026, 2, 9, 9), json.dumps(tree)),            # not the bank
            (4, "alerts@mybank.example", dt.datetime(2026, 2, 10, 9), json.dumps(tree))]       # other day
    raw = spark.createDataFrame(rows, "mail_id long, sender string, received_at timestamp, payload string")
    recs, bad = J.ingest_mail(raw, rules_frame(spark, {"Food": ["pizza"]}), dt.date(2026, 2, 9))
    got = recs.collect()
    assert len(got) == 1 and bad.count() == 0
    r = got[0]
    assert (r.amount, r.paid_to, r.txn_type, r.reference_no, r.txn_date, r.category) == (
        Decimal("1234.50"), "PIZZA CORNER", "Debit", "123456", dt.date(2026, 2, 9), "Food")
    assert r.ingest_seq == 1


def _mails(spark, payees, first_id=1):
    import base64
    import json

    rows = []
    for k, p in enumerate(payees):
        html = (f"<html><body><p>Rs.{k + 1}.00 has been debited from account to VPA shop@okbank {p} on 09-02-26.</p>"
                f"<p>Your UPI transaction reference number is {first_id + k}.</p></body></html>")
        tree = {"mimeType": "text/html", "body": {"data": base64.urlsafe_b64encode(html.encode()).decode().rstrip("=")}}
        rows.append((first_id + k, "alerts@mybank.example", dt.datetime(2026, 2, 9, 8), json.dumps(tree)))
    return spark.createDataFrame(rows, "mail_id long, sender string, received_at timestamp, payload string")


def test_a_batch_learns_for_the_next_and_a_retry_leaves_one_version(spark, tmpdir_path):
    from ledgerlake.operators.categorise import PayeeClassifier
    from ledgerlake.sources.rules import _commits, current_rules, rules_before

    base = os.path.join(tmpdir_path, "run")
    rules = rules_frame(spark, {"Food": ["pizza hut"], "Petrol": ["fuel station"]})

    class Spy(PayeeClassifier):
        asked = []

        def predict(self, df, col, out_col="predicted"):
            Spy.asked.append(sorted(r[0] for r in df.select(col).collect()))
            return super().predict(df, col, out_col)

    run = lambda mails, batch: J.run_mail_batch(mails, rules, base, batch, learner=Spy)
    run(_mails(spark, ["PIZZA HUT", "pizza huts", "pizzeria", "fuels"]), "b1")
    assert Spy.asked[-1] == ["fuels", "pizzeria"]
    run(_mails(spark, ["PIZZERIA", "fuels", "stations"], 10), "b2")
    assert Spy.asked[-1] == ["stations"]  # the others are matched by what the first batch learned
    before = sorted(map(tuple, current_rules(spark, base + "/rules").collect()), key=str)
    stored = spark.read.parquet(base + "/transactions").count()
    for batch in ("b2", "b1"):
        run(_mails(spark, ["PIZZERIA", "fuels", "stations"], 10) if batch == "b2" else _mails(spark, ["PIZZA HUT", "pizza huts", "pizzeria", "fuels"]), batch)
    assert Spy.asked[-2:] == [["stations"], ["fuels", "pizzeria"]]  # a retry starts from the rules its first run had
    assert [b for _, b in _commits(spark, base + "/rules")] == ["b1", "b2"]
    assert sorted(map(tuple, current_rules(spark, base + "/rules").collect()), key=str) == before
    assert spark.read.parquet(base + "/transactions").count() == stored == 7
    got = {r.paid_to: r.category for r in spark.read.parquet(base + "/transactions").collect()}
    assert got["PIZZERIA"] == got["pizzeria"] == "Food" and got["fuels"] == got["stations"] == "Petrol"
    assert rules_before(spark, base + "/rules", "b1") is None and rules_before(spark, base + "/none", "x") is None


def test_statement_rows_are_set_aside_one_by_one(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "run")
    ref = "1234567890123456"
    text = "\n".join([
        f"01/02/26 UPI-A-h@ok {ref} 01/02/26 - 900.00",            # first row without a printed amount
        f"99/02/26 UPI-B-h@ok {ref} 02/02/26 100.00 800.00",       # no date; its balance still counts
        f"03/02/26 UPI-C-h@ok {ref} 03/02/26 100.00 700.00",
        f"04/02/26 UPI-D-h@ok {ref} 04/02/26 100.00 1.2.3",        # no balance
        f"05/02/26 UPI-E-h@ok {ref} 05/02/26 100.00 500.00",       # so this amount is unknown
        f"06/02/26 UPI-F-h@ok {ref} 06/02/26 x 650.00"])
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rules = rules_frame(spark, {"Food": ["c"]})
    for _ in range(2):
        J.load_statements(text_to_lines(docs), rules, base, "b1")
    counts = {(r.batch_id, r.status): r.n for r in J.statement_counts(spark, base).collect()}
    assert counts == {("b1", "amount"): 1, ("b1", "date"): 1, ("b1", "balance"): 1, ("b1", "previous"): 1, ("b1", "good"): 2}
    got = sorted((r.paid_to, r.amount, r.txn_type) for r in spark.read.parquet(base + "/transactions").collect())
    assert got == [("C", Decimal("100.00"), "Debit"), ("F", Decimal("150.00"), "Credit")]
    aside = spark.read.parquet(base + "/rows").filter("status = 'balance'").first()
    assert aside.narration.startswith("UPI-D") and aside.balance_text is None
