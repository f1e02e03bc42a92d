import datetime as dt
from decimal import Decimal

import numpy as np

from ledgerlake.operators import analytics as A
from ledgerlake.operators import budget as B

SCHEMA = "txn_date date, amount decimal(18,2), category string, txn_type string, paid_to string"
D = dt.date
ROWS = [
    (D(2026, 2, 9), Decimal("100.00"), "Food", "Debit", "A"),
    (D(2026, 2, 10), Decimal("50.00"), "Food", "Credit", "B"),
    (D(2026, 2, 10), Decimal("300.00"), "Rent", "Debit", "L"),
    (D(2026, 3, 1), Decimal("20.00"), "Salon", "Debit", ""),
    (D(2026, 3, 2), Decimal("5.00"), None, "Unknown", None),
    (D(2026, 3, 2), Decimal("7.00"), "SIP", "Debit", None),
]


def tx(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_empty_selection_gives_no_rows(spark):
    assert A.dashboard_filter(tx(spark), A.FilterSpec(categories=[])).count() == 0
    assert A.dashboard_filter(tx(spark), A.FilterSpec(types=[])).count() == 0
    assert A.dashboard_filter(tx(spark), A.FilterSpec()).count() == len(ROWS)


def test_kpis(spark):
    k = A.kpis(tx(spark)).first()
    assert k.total_spent == Decimal("427.00") and k.total_received == Decimal("50.00")
    assert k.net_balance == Decimal("-377.00") and k.txn_count == 6
    assert k.avg_transaction == round(482 / 6, 2) and k.top_category == "Rent"
    empty = A.kpis(A.dashboard_filter(tx(spark), A.FilterSpec(types=[]))).first()
    assert empty.top_category == "N/A" and empty.total_spent == 0 and empty.txn_count == 0


def test_weekday_and_cumulative(spark):
    w = {r.day_of_week: (r.day_index, r.amount) for r in A.weekday_spend(tx(spark)).collect()}
    assert w["Monday"] == (0, Decimal("107.00")) and w["Tuesday"] == (1, Decimal("300.00"))
    c = [(r.txn_date, r.cumulative) for r in A.cumulative_spend(tx(spark)).orderBy("txn_date").collect()]
    assert c[-1][1] == Decimal("427.00")


def test_hierarchy_labels(spark):
    h = {(r.category, r.paid_to): r.amount for r in A.payee_hierarchy(tx(spark)).collect()}
    assert h[("Salon", "Unknown")] == Decimal("20.00")
    assert h[("SIP", "SIP Investment")] == Decimal("7.00")
    assert h[("Food", None)] == Decimal("100.00")


def test_box_stats_exact_and_approx(spark):
    import numpy as np

    rows = [(D(2026, 1, 1), Decimal(v), "X", "Debit", "p") for v in ["1", "2", "3", "4", "100"]]
    df = spark.createDataFrame(rows, SCHEMA)
    b = A.box_stats(df).first()
    a = np.array([1, 2, 3, 4, 100.0])
    assert (b.q1, b.median, b.q3) == tuple(float(np.percentile(a, p)) for p in (25, 50, 75))
    assert b.upper_whisker == 4.0 and b.n_outliers == 1
    assert A.box_stats(df, approx=True).first().median == 3.0


def test_budgets(spark):
    budgets, bmap = B.budget_tables(spark, {"Eat": 200, "Home": 100, "None": 0, "Gross": 10},
                                    {"Eat": ["Food"], "Home": ["Rent", "Food"], "None": [], "Gross": ["Food"]},
                                    gross_groups=("Gross",))
    got = {r.budget_group: r for r in B.budget_vs_actual(tx(spark), budgets, bmap).collect()}
    assert got["Eat"].actual == Decimal("50.00") and got["Eat"].status == "Under Budget"
    assert got["Home"].actual == Decimal("350.00") and got["Home"].status == "Over Budget"  # Food counted again
    assert got["None"].actual == 0 and got["None"].variance_pct == 0.0
    assert got["Gross"].actual == Decimal("100.00")  # credits not netted
    t = B.budget_totals(B.budget_vs_actual(tx(spark), budgets, bmap)).first()
    assert t.total_actual == Decimal("500.00") and t.overspend == Decimal("190.00") and t.overall_status == "Over"


def test_box_stats_random_against_numpy(spark):
    import random

    import numpy as np

    rnd = random.Random(5)
    vals = {c: [round(rnd.lognormvariate(5, 2), 2) for _ in range(rnd.randint(1, 300))] for c in "abc"}
    vals["c"] += [-3.5, 0.0, -3.5]
    rows = [(D(2026, 1, 1), Decimal(str(v)), c, "Debit", "p") for c, vs in vals.items() for v in vs]
    got = {r.category: r for r in A.box_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c, vs in vals.items():
        a = np.array(vs)
        q1, med, q3 = (round(float(np.percentile(a, p)), 4) for p in (25, 50, 75))
        r = got[c]
        assert (r.n, r.q1, r.median, r.q3) == (len(vs), q1, med, q3), c
        iqr = np.percentile(a, 75) - np.percentile(a, 25)
        inside = a[(a >= np.percentile(a, 25) - 1.5 * iqr) & (a <= np.percentile(a, 75) + 1.5 * iqr)]
        assert r.lower_whisker == round(float(inside.min()), 4) and r.upper_whisker == round(float(inside.max()), 4)
        assert r.n_outliers == len(vs) - len(inside)


def test_box_stats_signs_ties_and_hot_values(spark):
    """Negative, zero, tiny and equal amounts, one value holding most rows, one row; no persisted table."""
    import random

    rnd = random.Random(4)
    sets = {"neg": [rnd.randrange(-10**6, 10**6) / 100 for _ in range(301)], "hot": [5.0] * 400 + [rnd.randrange(1, 10**7) / 100 for _ in range(99)],
            "one": [-3.25], "two": [0.0, 10.0], "same": [7.77] * 10, "wide": [10.0 ** (k % 13) for k in range(57)]}
    rows = [(c, v) for c, vs in sets.items() for v in vs]
    df = spark.createDataFrame(rows, "category string, v double").selectExpr(
        "category", "cast(v as decimal(18,2)) amount", "'Debit' txn_type", "'p' paid_to", "date'2024-01-01' txn_date")
    got = {r.category: r for r in A.box_stats(df).collect()}
    for c, vs in sets.items():
        q1, q2, q3 = np.percentile(vs, [25, 50, 75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        want = [len(vs), q1, q2, q3, min(v for v in vs if v >= low), max(v for v in vs if v <= high), sum(v < low or v > high for v in vs), min(vs), max(vs)]
        r = got[c]
        have = [r.n, r.q1, r.median, r.q3, r.lower_whisker, r.upper_whisker, r.n_outliers, r.min_amount, r.max_amount]
        assert all(abs(x - round(y, 4)) < 2e-4 for x, y in zip(have, want)), (c, have, want)
    assert "InMemoryTableScan" not in A.box_stats(df)._jdf.queryExecution().executedPlan().toString()
