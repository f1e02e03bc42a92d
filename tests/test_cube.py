import os

from pyspark.sql import functions as F

from ledgerlake.operators import analytics as A
from ledgerlake.operators import cube as CU


def rows(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "i int").selectExpr(
        "if(i % 11 = 0, null, cast(i * 1.25 as decimal(18,2))) amount", "if(i % 7 = 0, null, concat('c', i % 3)) category",
        "element_at(array('Debit', 'Credit', 'Unknown'), i % 3 + 1) txn_type", "if(i % 13 = 0, null, concat('p', i % 5)) paid_to",
        "if(i % 17 = 0, null, date_add(date'2024-01-01', i % 40)) txn_date")


def same(a, b):
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_figures_of_the_cube_equal_a_full_scan(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "cube")
    assert CU.dashboard_cells(spark, path, clock=lambda: 0).count() == 0
    CU.add_batch(rows(spark, range(0, 300)), path, "b1")
    CU.add_batch(rows(spark, range(300, 420)), path, "b2")
    CU.add_batch(rows(spark, range(300, 500)), path, "b2")  # a repeated batch replaces its cells
    tx, cells = rows(spark, range(500)), CU.dashboard_cells(spark, path)
    assert cells.count() == tx.select(CU.CELL).distinct().count()
    same(CU.kpis(cells), A.kpis(tx))
    for f in (A.category_share, A.month_type_sum, A.daily_spend, A.cumulative_spend, A.weekday_spend, A.cash_flow, A.top_payees):
        same(f(cells.select("txn_date", "amount", "category", "txn_type", "paid_to")), f(tx))
    one = cells.agg(F.min("low"), F.max("high"), F.sum("n")).first()
    assert tuple(one) == (*tx.agg(F.min("amount"), F.max("amount")).first(), 500)


def test_the_merged_copy_is_kept_for_a_while(spark, tmpdir_path):
    path, now = os.path.join(tmpdir_path, "cube"), [1000.0]
    read = lambda: CU.dashboard_cells(spark, path, clock=lambda: now[0]).agg(F.sum("n")).first()[0]
    CU.add_batch(rows(spark, range(10)), path, "b1")
    assert read() == 10
    CU.add_batch(rows(spark, range(10, 25)), path, "b2")
    now[0] += 299
    assert read() == 10
    now[0] += 1
    assert read() == 25
    for k in range(3):
        now[0] += 301
        assert read() == 25
    assert len(os.listdir(path + "/merged")) == 2  # the current copy and the one before
