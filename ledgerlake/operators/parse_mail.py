"""Alert mail text -> typed transaction fields (regex extraction, all native expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import day_month_year, money, regex_group, strip, with_fields_once

# Field patterns of the bank alert text.
AMOUNT_RE = r"Rs\.?\s?([\d.,]+)"
PAYEE_RE = r"@[a-zA-Z]+\s+(.+?)\s+on"
REFERENCE_RE = r"(?i)reference number is\s+(\d+)"
DATE_RE = r"\bon\s+(\d{1,2}-\d{1,2}-\d{2,4})"
# Type words, matched as substrings of the lower-cased text; debit words first.
DEBIT_WORDS = ["debited", "upi/dr", "spent", "withdrawn", "purchase"]
CREDIT_WORDS = ["credited", "upi/cr", "received", "refund"]


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def txn_type(text: Column) -> Column:
    t = F.lower(text)
    return F.when(_any_of(t, DEBIT_WORDS), "Debit").when(_any_of(t, CREDIT_WORDS), "Credit").otherwise("Unknown")


def parse_alert(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds amount_text, amount decimal(18,2), paid_to, txn_type, reference_no, date_text, txn_date."""
    t = F.col(text_col)
    texts = with_fields_once(df, {
        "amount_text": regex_group(t, AMOUNT_RE),
        "paid_to": strip(regex_group(t, PAYEE_RE)),
        "txn_type": txn_type(t),
        "reference_no": regex_group(t, REFERENCE_RE),
        "date_text": regex_group(t, DATE_RE),
    })
    # read from the found texts: written into one step, each use would search the mail again
    return with_fields_once(texts, {"amount": money(F.col("amount_text")), "txn_date": day_month_year(F.col("date_text"))})


def with_reference(parsed: DataFrame) -> DataFrame:
    """Only mails that carry a reference number are transactions."""
    return parsed.filter(F.col("reference_no").isNotNull())


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine rows with a reason) — nothing is dropped silently."""
    reason = (F.when(F.col("amount").isNull(), F.lit("amount"))
              .when(F.col("txn_date").isNull(), F.lit("date")))
    tagged = parsed.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


# ---------------------------------------------------------------- rendering (test feeds)
def render_alert(tx: DataFrame, with_ref: Column | None = None) -> DataFrame:
    """Transaction rows -> alert text in the bank's wording (mail_id, received_at, text).

    Debit/Credit/Unknown use debited/credited/no type word. `with_ref` (default: always)
    decides whether the reference sentence is present.
    """
    amt = F.format_number(F.col("amount"), 2)
    day = F.date_format(F.col("txn_date"), "dd-MM-yyyy")
    payee = F.col("paid_to")
    ref = F.col("txn_id").cast("string")
    body = (
        F.when(F.col("txn_type") == "Debit",
               F.concat(F.lit("Rs."), amt, F.lit(" has been debited from account **1234 to VPA shop@okbank "),
                        payee, F.lit(" on "), day, F.lit(".")))
        .when(F.col("txn_type") == "Credit",
              F.concat(F.lit("Rs."), amt, F.lit(" has been credited to account **1234 by VPA pay@okbank "),
                       payee, F.lit(" on "), day, F.lit(".")))
        .otherwise(F.concat(F.lit("Rs. "), amt, F.lit(" moved via VPA any@okbank "), payee, F.lit(" on "), day,
                            F.lit(".")))
    )
    ref_line = F.concat(F.lit("\nYour UPI transaction reference number is "), ref, F.lit("."))
    if with_ref is not None:
        ref_line = F.when(with_ref, ref_line).otherwise(F.lit("\nThank you for banking with us."))
    return tx.select(
        F.col("txn_id").alias("mail_id"),
        F.col("txn_date").cast("timestamp").alias("received_at"),
        F.concat(body, ref_line).alias("text"),
    )
