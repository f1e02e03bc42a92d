import base64
import datetime as dt
import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlake.functions import text as T


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_strip_matches_python(spark):
    vals = ["  a b  ", "\t\n y \r\x0b", "\xa0nbsp\xa0", "　wide ", "", "   ", None, "x"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r[0] for r in df.select(T.strip("x")).collect()]
    assert got == [None if v is None else v.strip() for v in vals]


def test_money(spark):
    assert one(spark, T.money("x"), "1,234.50") == Decimal("1234.50")
    assert one(spark, T.money("x"), " 250 ") == Decimal("250.00")
    assert one(spark, T.money("x"), "1.2.3") is None
    assert one(spark, T.money("x"), "") is None
    assert one(spark, T.money("x"), None) is None


def test_day_month_year(spark):
    assert one(spark, T.day_month_year("x"), "09-02-26") == dt.date(2026, 2, 9)
    assert one(spark, T.day_month_year("x"), "9-2-2026") == dt.date(2026, 2, 9)
    assert one(spark, T.day_month_year("x"), "31-02-26") is None
    assert one(spark, T.day_month_year("x"), "nope") is None
    assert one(spark, T.slash_date("x"), "01/02/26") == dt.date(2026, 2, 1)


def test_urlsafe_base64(spark):
    raw = "héllo <b>wörld</b>?>".encode()
    enc = base64.urlsafe_b64encode(raw).decode().rstrip("=")  # unpadded
    assert one(spark, T.urlsafe_b64_text("x"), enc) == raw.decode()
    bad = base64.urlsafe_b64encode(b"ok \xff\xfe end").decode()
    assert one(spark, T.urlsafe_b64_text("x"), bad) == "ok �� end"


def test_html_text_lines(spark):
    html = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:1}</style>"
            "<script>var a='</p>';</script></head><body><!-- c -->"
            "<p> one&nbsp;</p>\n\n<div>two &lt;x&gt; &quot;q&quot; &#39;s&#39;</div><br/>  </body></html>")
    assert one(spark, T.html_text_lines(F.col("x")), html) == "T & t\none\ntwo <x> \"q\" 's'"


def py_fingerprint(rec, keys):
    s = "".join(("none" if rec.get(k) is None else str(rec[k]).lower().strip()) + "|" for k in keys)
    return hashlib.sha256(s.encode()).hexdigest()[:32]


def test_fingerprint(spark):
    rows = [("A ", "x"), ("a", " X "), (None, "x")]
    df = spark.createDataFrame(rows, "k1 string, k2 string")
    got = [r[0] for r in df.select(T.fingerprint(["k1", "k2"])).collect()]
    assert got[0] == got[1]  # case and outer blanks do not matter
    assert got[2] == py_fingerprint({"k1": None, "k2": "x"}, ["k1", "k2"])
    assert got[0] == py_fingerprint({"k1": "a", "k2": "x"}, ["k1", "k2"])
    single = df.select(T.fingerprint(["k2"])).first()[0]
    assert single == py_fingerprint({"k2": "x"}, ["k2"])


def test_fingerprint_missing_column(spark):
    import pytest

    from ledgerlake.operators.load import add_fingerprint

    with pytest.raises(ValueError):
        add_fingerprint(spark.createDataFrame([(1,)], "a int"), ["a", "b"])


def test_numeric_references(spark):
    from ledgerlake.functions.text import html_text_lines

    rows = [("<p>&#8377;5 &#x20B9; &#65;&#x1F600; &#0; &#xD800; &#9999999; &#x; &amp;#65;</p>",), ("plain",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(html_text_lines("h")).collect()]
    assert got == ["₹5 ₹ A😀 &#0; &#xD800; &#9999999; &#x; &#65;", "plain", None]
