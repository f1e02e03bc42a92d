import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlake.operators import statement as S
from ledgerlake.plans.ordered import prev_in_order, running_count
from ledgerlake.sources.statement import text_to_lines

PAGE_TEXT = "\n".join([
    "HEADER TEXT",
    "01/02/26 UPI-SHOP ONE-h1@ok 1234567890123456 01/02/26 100.00 900.00",
    "CONT1ok x",
    "ALL CAPS",
    "02/02/26 SAL 6543210987654321 02/02/26 50.00 1,950.00",
    "Closingbalance",
    "03/02/26 NOPE 1234567890123456 03/02/26 1.00 1.00",
]) + "\f" + "\n".join([
    "orphan cont",
    "04/02/26 UPI-ABC-h2@ok 1111111111111111 04/02/26 5.00 1,945.00",
])


def test_statement_page(spark):
    docs = spark.createDataFrame([("d1", PAGE_TEXT)], "doc_id string, text string")
    lines = text_to_lines(docs)
    raw = S.assemble(lines).orderBy("page_no", "txn_no").collect()
    assert [r.narration for r in raw] == ["UPI-SHOP ONE-h1@ok CONT1ok x", "SAL", "UPI-ABC-h2@ok"]
    assert [r.balance_text for r in raw] == ["900.00", "1,950.00", "1,945.00"]
    assert [r.chq_no for r in raw] == ["1234567890123456", "6543210987654321", "1111111111111111"]
    recs = S.extract_statements(lines).orderBy("source_id").collect()
    assert [(r.txn_type, r.amount, r.paid_to) for r in recs] == [
        ("Debit", Decimal("100.00"), "SHOP ONE"), ("Credit", Decimal("1050.00"), "SAL"),
        ("Debit", Decimal("5.00"), "ABC")]


def test_short_date_line_has_empty_narration(spark):
    docs = spark.createDataFrame([("d", "05/02/26 12.00 100.00\n06/02/26 A B 1.00 99.00")], "doc_id string, text string")
    raw = S.assemble(text_to_lines(docs)).orderBy("txn_no").collect()
    assert raw[0].narration == "" and raw[0].balance_text == "100.00" and raw[0].amount_text == "12.00"
    assert raw[1].narration == ""  # four tokens or fewer: all of them are fields


def test_zero_balance_is_a_value(spark):
    rows = [("d", 0, 1, Decimal("10.00"), Decimal("10.00")), ("d", 0, 2, Decimal("0.00"), Decimal("0.00")),
            ("d", 0, 3, Decimal("5.00"), Decimal("5.00")), ("d", 0, 4, Decimal("5.00"), None)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, txn_no int, amount_printed decimal(18,2), balance decimal(18,2)")
    got = [(r.txn_type, r.amount) for r in S.balance_delta(df).orderBy("txn_no").collect()]
    assert got == [("Debit", Decimal("10.00")), ("Debit", Decimal("10.00")), ("Credit", Decimal("5.00")), (None, None)]


NARRATIONS = [("UPI-A-B-h@ok-x", "A-B"), ("UPI-h@ok", "h"), ("UPI--h@ok", "-h"),
              ("UPI-SHOP-ABCDEF123456 tail", "SHOP"), ("SALARY FEB", "SALARY FEB"), (None, None), ("", None),
              ("  NEFT X  ", "NEFT X")]


def test_clean_narration(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NARRATIONS)], "i int, n string")
    got = {r.i: r.p for r in df.select("i", S.clean_narration(F.col("n")).alias("p")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(NARRATIONS)}


def test_prev_in_order_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), rnd.randint(0, 4), i, rnd.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, blk int, seq int, v int")
    got = {r.seq: (r.prev, r.is_first) for r in prev_in_order(df, ["k"], "blk", ["seq"], "v").collect()}
    for k in "ab":
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for j, r in enumerate(ordered):
            assert got[r[2]] == ((ordered[j - 1][3] if j else None), j == 0)


def test_running_count_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [("f", i, rnd.random() < 0.1) for i in range(500)]
    df = spark.createDataFrame(rows, "file string, line_no long, flag boolean")
    got = {r.line_no: r.segment for r in running_count(df, ["file"], "line_no", "flag", block_size=16).collect()}
    acc = 0
    for _, i, f in rows:
        acc += int(f)
        assert got[i] == acc


def test_running_sum_matches_brute_force(spark):
    from ledgerlake.plans.ordered import running_sum

    rnd = random.Random(11)
    rows = [(rnd.choice("xy"), i // 7, i, rnd.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, blk int, seq int, v int")
    got = {r.seq: (r.acc, r.tot) for r in running_sum(df, ["k"], "blk", ["seq"], "v", "acc", "tot").collect()}
    for k in "xy":
        acc, tot = 0, sum(r[3] for r in rows if r[0] == k)
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]):
            acc += r[3]
            assert got[r[2]] == (acc, tot)


def test_ordered_helpers_multi_level(spark):
    from ledgerlake.plans.ordered import running_sum

    rnd = random.Random(21)
    rows = [(rnd.choice("pq"), i // 3, i, rnd.randint(-3, 9)) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, blk int, seq int, v int")
    for levels in (1, 2, 3, 4):
        prev = {r.seq: (r.prev, r.is_first)
                for r in prev_in_order(df, ["k"], "blk", ["seq"], "v", levels=levels, fanout=2, max_blocks=2).collect()}
        run = {r.seq: (r.acc, r.tot) for r in running_sum(df, ["k"], "blk", ["seq"], "v", "acc", "tot", levels=levels,
                                                         fanout=2, max_blocks=2).collect()}
        for k in "pq":
            ordered = sorted((r for r in rows if r[0] == k), key=lambda r: r[2])
            acc, tot = 0, sum(r[3] for r in ordered)
            for j, r in enumerate(ordered):
                acc += r[3]
                assert prev[r[2]] == ((ordered[j - 1][3] if j else None), j == 0), levels
                assert run[r[2]] == (acc, tot), levels


def test_bad_pages_are_told_in_one_pass(spark):
    from ledgerlake.sources.statement import flag_pages, good_and_bad_pages

    rows = [(1, 0, 0, "a"), (1, 0, 1, "b �"), (1, 1, 0, "c"), (2, 0, 0, None), (None, 0, 0, "�"), (3, None, 0, "�"), (2, 0, 1, "d")]
    lines = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, line string")
    for given in (lines, flag_pages(lines)):
        good, bad = good_and_bad_pages(given)
        assert sorted(map(str, map(tuple, bad.collect()))) == sorted(map(str, rows[:2]))  # lines without a document or page are no page
        assert sorted(map(str, map(tuple, good.collect()))) == sorted(map(str, rows[2:]))
        assert "Join" not in good._jdf.queryExecution().executedPlan().toString()
