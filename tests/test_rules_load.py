import json
import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.operators import categorise as C
from ledgerlake.operators import load as L
from ledgerlake.sources.rules import load_rules, rules_frame

RULES = {"Food": ["pizza"], "Petrol": ["hp"], "Person": ["hpquibble"], "Grocery": ["ol"]}


PAYEES = ["hpquibble", "PIZZA HP", None, "   ", "zzz", " Old Town ", "hp"]


def _run(spark, payees, strategy):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payees)], "id int, paid_to string")
    return {r["id"]: r["category"] for r in C.rule_category(df, rules_frame(spark, RULES), strategy=strategy).collect()}


#: hp is a Petrol word and stands before hpquibble; pizza stands before hp; "old" holds "ol".
EXPECTED = ["Petrol", "Food", "SIP", "SIP", None, "Grocery", "Petrol"]


def test_first_rule_wins_both_plans(spark):
    for strategy in ("auto", "inline", "join"):
        assert _run(spark, PAYEES, strategy) == dict(enumerate(EXPECTED)), strategy


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="hpizaol AP", min_size=0, max_size=8), min_size=1, max_size=12))
def test_both_plans_agree(spark, payees):
    assert _run(spark, payees, "join") == _run(spark, payees, "inline")


def test_thousands_of_rules(spark):
    rules = rules_frame(spark, {f"c{i}": [f"<{i}>", f"[{i}]"] for i in range(3000)})
    df = spark.createDataFrame([(i, f"a <{i}> [{i + 7}]") for i in range(0, 2990, 13)], "id int, paid_to string")
    assert all(r.category == f"c{r.id}" for r in C.rule_category(df, rules).collect())


def test_default_labels_without_a_file(spark, tmpdir_path):
    from ledgerlake.sources.rules import DEFAULT_CATEGORIES, rule_labels

    path = os.path.join(tmpdir_path, "rules.json")
    assert [r.label for r in rule_labels(spark, path).orderBy("position").collect()] == DEFAULT_CATEGORIES
    with open(path, "w") as f:
        json.dump({"Zeta": [], "Alpha": ["c"]}, f)
    assert [r.label for r in rule_labels(spark, path).orderBy("position").collect()] == ["Zeta", "Alpha"]


def test_new_label_comes_last_and_no_evidence_is_others(spark):
    rules = rules_frame(spark, {"Food": ["pizza"], "Petrol": ["fuel"]})
    clf = C.PayeeClassifier().fit(rules)
    df = spark.createDataFrame([("qqq",), ("pizzeria",), (None,)], "paid_to string")
    learned = {r.keyword: r for r in C.learned_rules(df, rules, clf).collect()}
    assert learned["qqq"].category == "Others" and learned["pizzeria"].category == "Food"
    assert learned["qqq"].priority > 2_000_000 > learned["pizzeria"].priority
    none = C.PayeeClassifier().fit(rules.limit(0))
    assert [r.predicted for r in none.predict(df.filter("paid_to = 'qqq'"), "paid_to").collect()] == ["Others"]


def test_load_rules_keeps_file_order(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "rules.json")
    with open(path, "w") as f:
        json.dump({"Zeta": ["b", "a"], "Alpha": ["c"]}, f)
    got = [(r.category, r.keyword) for r in load_rules(spark, path).orderBy("priority").collect()]
    assert got == [("Zeta", "b"), ("Zeta", "a"), ("Alpha", "c")]
    assert load_rules(spark, os.path.join(tmpdir_path, "missing.json")).count() == 0


def test_learning_takes_effect_next_batch(spark):
    rules = rules_frame(spark, {"Food": ["pizza", "burger"], "Petrol": ["fuel", "petrol pump"]})
    clf = C.PayeeClassifier().fit(rules)
    df = spark.createDataFrame([(1, "pizza hut"), (2, "Burger Barn"), (3, "fuel station"), (4, "Pizzeria Roma")],
                               "id int, paid_to string")
    out, learned = C.categorise(df, rules, clf, batch_id="b1")
    cats = {r.id: r.category for r in out.collect()}
    assert cats[1] == "Food" and cats[3] == "Petrol"
    assert cats[4] is not None  # classifier label
    lr = learned.collect()
    assert {r.keyword for r in lr} == {"pizzeria roma"} and all(r.source == "learned" for r in lr)
    merged = C.merge_rules(rules, learned)
    again = {r.id: r.category for r in C.rule_category(df, merged).collect()}
    assert again[4] == cats[4]


def test_first_copy_and_counts(spark):
    rows = [("h1", 3, "c"), ("h1", 1, "a"), ("h2", 5, "x"), ("h3", 2, "y"), ("h2", 4, "w")]
    batch = spark.createDataFrame(rows, "hashcode string, ingest_seq int, v string")
    fc = {r.hashcode: (r.ingest_seq, r.v) for r in L.first_copy(batch).collect()}
    assert fc == {"h1": (1, "a"), "h2": (4, "w"), "h3": (2, "y")}
    stored = spark.createDataFrame([("h3",)], "hashcode string")
    assert sorted(r.hashcode for r in L.new_rows(batch, stored).collect()) == ["h1", "h2"]
    counts = {r.status: r.n for r in L.load_counts(L.load_status(batch, stored)).collect()}
    assert counts == {"inserted": 2, "duplicate": 3}


def test_append_twice_equals_once(spark, tmpdir_path):
    import datetime as dt

    rows = [(f"h{i}", i, dt.date(2024, 1 + i % 3, 1)) for i in range(10)]
    batch = spark.createDataFrame(rows, "hashcode string, ingest_seq int, txn_date date")
    path = os.path.join(tmpdir_path, "tx")
    L.append_batch(batch, path, "b1")
    L.append_batch(batch, path, "b1")  # retry of the same batch
    L.append_batch(batch, path, "b2")  # the same rows again in a new batch
    t = spark.read.parquet(path)
    assert t.count() == 10 and t.select("hashcode").distinct().count() == 10
    assert {r.batch_id for r in t.select("batch_id").distinct().collect()} == {"b1"}


def test_batches_with_number_like_names_and_null_dates(spark, tmpdir_path):
    import datetime as dt

    rows = [("h1", 1, None), ("h2", 2, dt.date(2024, 1, 1))]
    batch = spark.createDataFrame(rows, "hashcode string, ingest_seq int, txn_date date")
    path = os.path.join(tmpdir_path, "tx")
    for name in ("20240101", "20240102-retry", "20240103"):
        L.append_batch(batch, path, name)
    got = L.stored_batches(spark, path, batch.schema).collect()
    assert sorted((r.hashcode, r.batch_id) for r in got) == [("h1", "20240101"), ("h2", "20240101")]


def test_equal_key_and_order_count_once(spark):
    rows = [("h1", 1, True), ("h1", 1, True), ("h2", 1, False), ("h2", 2, True), ("h3", 1, None)]
    batch = spark.createDataFrame(rows, "hashcode string, ingest_seq int, ok boolean")
    stored = spark.createDataFrame([("h9",)], "hashcode string")
    want = {"inserted": 2, "duplicate": 1, "quarantined": 2}
    assert {r.status: r.n for r in L.load_counts(L.load_status(batch, stored, valid="ok")).collect()} == want
    assert {r.status: r.n for r in L.count_load(batch, stored, valid="ok").collect()} == want
    assert L.first_copy(batch).count() == 3


def test_blank_payees_are_spread_and_the_input_is_scanned_once(spark):
    """The join's blank payees don't share a key; a short list of rules is one pass."""
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, concat('pizza ', id), ' ') as paid_to")
    out = C.rule_category(df, rules_frame(spark, RULES), strategy="join")
    assert {(r.category, r.n) for r in out.groupBy("category").agg(F.count("*").alias("n")).collect()} == {("Food", 1000), ("SIP", 2000)}
    assert out.columns == ["id", "paid_to", "category"]
    plan = C.rule_category(df, rules_frame(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Range") == 1
