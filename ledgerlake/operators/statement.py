"""Bank statement text -> transactions.

statement_lines(doc_id, page_no, line_no, line)
  -> assemble()   statement_txn_raw(doc_id, page_no, txn_no, date_text, narration, chq_no, amount_text, balance_text)
  -> typed()      + txn_date, amount_printed, balance (decimals)
  -> balance_delta()  txn_type, amount from the change of the running balance
  -> payee()      paid_to from the narration

All page-local work is partitioned by (doc_id, page_no): pages are small, so no task ever
holds a whole document. Only balance_delta crosses pages, through plans.ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import money, slash_date, strip
from ledgerlake.plans.ordered import prev_in_order

# A line containing any of these ends the page.
FOOTER_MARKS = ["HDFCBANKLIMITED", "Closingbalance", "*Closing"]
# Continuation lines containing any of these are skipped.
SKIP_MARKS = ["HDFCBANK", "Closing", "Contents", "State", "Registered"]
DATE_LINE_RE = r"^(\d{2}/\d{2}/\d{2})\s+(.+)$"
NUMBER_RE = r"^[\d,]+\.?\d*$"
SHORT_DATE_RE = r"^\d{2}/\d{2}/\d{2}$"
REF16_RE = r"^\d{16}$"
CAPS_RE = r"^[A-Z\s\*]+$"
# Merchant in a UPI narration ends before a run of 10+ capitals/digits.
UPI_TAIL_RE = r"-[A-Z0-9]{10,}.*$"


def _contains_any(c: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | c.contains(m)
    return out


def assemble(lines: DataFrame, footer_marks: list[str] = FOOTER_MARKS,
             skip_marks: list[str] = SKIP_MARKS) -> DataFrame:
    """One row per transaction: a date line opens it, later lines of the same page append.

    Lines after the page's first footer line, and lines before the page's first date line,
    are not part of any transaction.
    """
    page = ["doc_id", "page_no"]
    x = lines.withColumn("l", strip(F.col("line"))).filter(F.col("l") != "")
    x = x.withColumn("__cut", F.min(F.when(_contains_any(F.col("l"), footer_marks), F.col("line_no")))
                     .over(Window.partitionBy(*page)))
    x = x.filter(F.col("__cut").isNull() | (F.col("line_no") < F.col("__cut")))
    is_date = F.col("l").rlike(DATE_LINE_RE)
    x = x.withColumn("__d", is_date).withColumn(
        "txn_no",
        F.sum(F.col("__d").cast("int")).over(
            Window.partitionBy(*page).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    ).filter(F.col("txn_no") > 0)
    keep_cont = ~F.col("__d") & ~_contains_any(F.col("l"), skip_marks) & ~F.col("l").rlike(CAPS_RE)
    x = x.filter(F.col("__d") | keep_cont)
    g = x.groupBy(*page, "txn_no").agg(
        F.max(F.when(F.col("__d"), F.col("l"))).alias("__head"),
        F.array_sort(F.collect_list(F.when(~F.col("__d"), F.struct("line_no", "l")))).alias("__cont"),
    )
    head = F.col("__head")
    rest = F.regexp_extract(head, DATE_LINE_RE, 2)
    parts = F.split(rest, r"\s+")
    n = F.size(parts)

    def tok(k: int, pattern: str) -> Column:
        t = F.try_element_at(parts, F.lit(-k))
        return F.when(t.rlike(pattern), t)

    narr_head = F.when(n > 4, F.array_join(F.slice(parts, 1, n - 4), " ")).otherwise(F.lit(""))
    pieces = F.concat(F.array(narr_head), F.transform(F.col("__cont"), lambda s: s["l"]))
    return g.select(
        *page, "txn_no",
        F.regexp_extract(head, DATE_LINE_RE, 1).alias("date_text"),
        F.array_join(F.filter(pieces, lambda p: p != ""), " ").alias("narration"),
        tok(4, REF16_RE).alias("chq_no"),
        tok(2, NUMBER_RE).alias("amount_text"),
        tok(1, NUMBER_RE).alias("balance_text"),
        tok(3, SHORT_DATE_RE).alias("value_date_text"),
    )


def typed(raw: DataFrame) -> DataFrame:
    return raw.withColumns({
        "txn_date": slash_date(F.col("date_text")),
        "amount_printed": money(F.col("amount_text")),
        "balance": money(F.col("balance_text")),
    })


def balance_delta(df: DataFrame, doc: list[str] | None = None, block: str = "page_no",
                  order: list[str] | None = None, balance: str = "balance",
                  printed: str = "amount_printed", reason: bool = False) -> DataFrame:
    """txn_type/amount from the running balance: the first row of a document is a Debit of its
    printed amount; later rows compare with the previous row's balance (down = Debit,
    up = Credit, equal or a balance missing = null). A balance of 0 is a value. With `reason`, a
    column says which of the values that a row needs is missing: balance, amount (the printed one
    of a first row) or previous (the balance before it); null if none is."""
    doc = doc or ["doc_id"]
    order = order or ["txn_no"]
    x = prev_in_order(df, doc, block, order, balance, "__prev", "__first")
    delta = F.col(balance) - F.col("__prev")
    first = F.col("__first")
    t = (F.when(first, F.when(F.col(printed).isNotNull() & (F.col(printed) != 0), F.lit("Debit")))
         .when(delta < 0, F.lit("Debit")).when(delta > 0, F.lit("Credit")))
    amt = (F.when(first, F.when(F.col(printed) != 0, F.col(printed)))
           .when(delta != 0, F.abs(delta)))
    out = x.withColumn("txn_type", t).withColumn("amount", amt.cast("decimal(18,2)"))
    if reason:
        out = out.withColumn("reason", F.when(F.col(balance).isNull(), "balance").when(first & F.col(printed).isNull(), "amount")
                             .when(~first & F.col("__prev").isNull(), "previous"))
    return out.drop("__prev", "__first")


def clean_narration(n: Column) -> Column:
    """Payee from a narration: for 'UPI-<name>-<handle>@<bank>' the name; without '@' the text
    before a long capitals/digits reference; a non-UPI narration as it is (stripped)."""
    i = F.instr(n, "UPI-")
    after = F.substring(n, i + 4, 1 << 30)
    at = F.instr(after, "@")
    before_at = F.substring_index(after, "@", 1)
    rdash = F.instr(F.reverse(before_at), "-")
    last_dash = F.when(rdash > 0, F.length(before_at) - rdash).otherwise(F.lit(-1))  # 0-based, -1 = none
    by_at = F.when(at > 0, strip(F.when(last_dash > 0, F.substring(before_at, 1, last_dash)).otherwise(before_at)))
    by_tail = strip(F.regexp_replace(after, UPI_TAIL_RE, ""))
    whole = strip(n)
    return (F.when(n.isNull() | (n == ""), F.lit(None).cast("string"))
            .when(i == 0, whole)
            .otherwise(F.coalesce(F.nullif(by_at, F.lit("")), F.nullif(by_tail, F.lit("")), whole)))


def to_records(txns: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The shared 5-field record (+ provenance): amount, paid_to, txn_type, reference_no, txn_date."""
    return txns.select(
        F.lit("statement").alias("source"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("page_no").cast("string"),
                    F.col("txn_no").cast("string")).alias("source_id"),
        "amount", clean_narration(F.col("narration")).alias("paid_to"), "txn_type",
        F.col("chq_no").alias("reference_no"), "txn_date", *extra,
    )


def extract_statements(lines: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """lines -> typed transactions with type, amount and payee, and the raw columns named in extra."""
    return to_records(balance_delta(typed(assemble(lines))), extra)


RAW_TEXTS = ("date_text", "amount_text", "balance_text", "narration")


def routed_records(lines: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """extract_statements' rows with their raw texts and a status: 'good', or what could not be read
    (date, balance, amount, previous). A row set aside for its date still gives its balance to the
    row after it; after an unreadable balance the next amount is unknown ('previous')."""
    x = balance_delta(typed(assemble(lines)), reason=True)
    status = F.coalesce(F.when(F.col("txn_date").isNull(), "date"), F.col("reason"), F.lit("good"))
    return to_records(x.withColumn("status", status), ("status", *RAW_TEXTS, *extra))
