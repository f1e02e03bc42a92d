"""End-to-end jobs composed from the operators.

ingest_alert_mails: landed mail -> body -> text -> fields -> reference filter -> valid /
quarantine -> categories -> fingerprint -> first copy per fingerprint.
flagship: that chain over alerts rendered from lineitem x part, then budget vs actual.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.text import MONEY
from ledgerlake.operators import budget as B
from ledgerlake.operators import categorise as C
from ledgerlake.operators import load as L
from ledgerlake.operators import parse_mail as PM
from ledgerlake.plans.sample_rules import PART_RULES
from ledgerlake.session import spread, table
from ledgerlake.sources.rules import commit_rules, rules_before, rules_frame

# Invented budgets over the invented part rules (see plans.sample_rules).
FLAG_TARGETS = {"Eating": 5_000_000, "Fuel": 5_000_000, "Home": 5_000_000, "Fun": 2_000_000, "Empty": 0}
FLAG_MAP = {"Eating": ["Food", "Grocery"], "Fuel": ["Petrol"], "Home": ["Rent", "Clothing", "Hospital"],
            "Fun": ["Sports", "Salon", "Person"], "Empty": []}
FLAG_GROSS = ("Eating",)


def line_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x part as card transactions: returned lines are credits, accepted ones unknown."""
    li = spread(table(spark, sf_dir, "lineitem"))
    part = table(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey, "inner").select(
        (li.l_orderkey * 100 + li.l_linenumber).alias("txn_id"),
        li.l_extendedprice.cast(MONEY).alias("amount"),
        part.p_name.alias("paid_to"),
        li.l_shipdate.cast("date").alias("txn_date"),
        F.when(li.l_returnflag == "N", "Debit").when(li.l_returnflag == "R", "Credit").otherwise("Unknown")
        .alias("txn_type"),
    )


def ingest_alert_texts(alerts: DataFrame, rules: DataFrame, classifier=None) -> tuple[DataFrame, DataFrame]:
    """Alert texts (mail_id, received_at, text) -> (unique categorised records, quarantine)."""
    parsed = PM.with_reference(PM.parse_alert(alerts))
    good, bad = PM.split_valid(parsed)
    cat, _learned = C.categorise(good, rules, classifier)
    rec = L.add_fingerprint(cat.withColumn("ingest_seq", F.col("mail_id")))
    cols = ["hashcode", "ingest_seq", "amount", "paid_to", "txn_type", "reference_no", "txn_date", "category"]
    return L.first_copy(rec.select(*cols), "hashcode", "ingest_seq"), bad


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = PM.render_alert(line_purchases(spark, sf_dir))
    records, _ = ingest_alert_texts(alerts, rules_frame(spark, PART_RULES))
    budgets, bmap = B.budget_tables(spark, FLAG_TARGETS, FLAG_MAP, FLAG_GROSS)
    return B.budget_vs_actual(records, budgets, bmap)


def categorise_and_learn(records: DataFrame, rules: DataFrame, base: str, batch_id: str, learner) -> tuple[DataFrame, DataFrame | None]:
    """(categorised records, the rules to commit after the batch is stored, None without a learner).

    A batch starts from the version of base/rules that was current before it (`rules` before the
    first), payees that no rule matches are labelled by learner().fit(rules), and their labels are
    rules of the next version."""
    if learner is None:
        return C.categorise(records, rules)[0], None
    known = rules_before(records.sparkSession, f"{base}/rules", batch_id)
    rules = rules if known is None else known
    out, learned = C.categorise(records, rules, learner().fit(rules), batch_id=batch_id)
    return out, C.merge_rules(rules, learned)


def ingest_statement_lines(lines: DataFrame, rules: DataFrame, classifier=None) -> tuple[DataFrame, DataFrame]:
    """Statement lines -> (unique categorised records, quarantined pages).

    Pages whose text did not decode go to quarantine; the rest is assembled, typed, given
    type/amount from the balance and a payee, categorised and fingerprinted. Of equal records the
    first in (document, page, transaction) order is kept.
    """
    from ledgerlake.operators import statement as S
    from ledgerlake.sources.statement import good_and_bad_pages

    good, bad = good_and_bad_pages(lines)
    recs = S.extract_statements(good, ("doc_id", "page_no", "txn_no"))
    return _statement_records(C.categorise(recs, rules, classifier)[0]), bad


def _statement_records(cat: DataFrame) -> DataFrame:
    fp = L.add_fingerprint(cat.withColumn("ingest_seq", F.struct("doc_id", "page_no", "txn_no")))
    cols = ["hashcode", "ingest_seq", "source", "source_id", "amount", "paid_to", "txn_type", "reference_no",
            "txn_date", "category"]
    return L.first_copy(fp.select(*cols), "hashcode", "ingest_seq")


def run_mail_batch(mails_raw: DataFrame, rules: DataFrame, base: str, batch_id: str, day=None, learner=None) -> DataFrame:
    """One mail run, end to end: landed mail -> body -> text -> fields -> categories -> fingerprint,
    new rows appended to base/transactions, alerts without a readable amount or date written to
    base/quarantine with the reason, and base/counts per batch. With a learner (a classifier class,
    as C.PayeeClassifier), the rules are kept in versions under base/rules and `rules` is where they
    begin. A repeated run of a batch replaces what it wrote. Returns the batch's counts (batch_id,
    status, n)."""
    from ledgerlake.sources import mail as M

    spark = mails_raw.sparkSession
    picked = M.mime_body(M.bank_mails_on(mails_raw, day))
    texts = M.mail_text(picked).filter(M.has_alert_words(F.col("text")))
    parsed = PM.with_reference(PM.parse_alert(texts.select("mail_id", "received_at", "text")))

    def own(df: DataFrame, part: str) -> DataFrame:
        """df as this batch's part of the table base/part, read back."""
        (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(f"{base}/{part}"))
        t = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_id", T.StringType())])).parquet(f"{base}/{part}")
        return t.filter(F.col("batch_id") == batch_id)

    good, bad = PM.split_valid(own(parsed, "parsed").drop("batch_id"))  # mails are read and parsed once
    quarantined = own(bad.select("mail_id", "received_at", "text", "reason"), "quarantine")
    cat, learned = categorise_and_learn(good, rules, base, batch_id, learner)
    rec = L.add_fingerprint(cat.withColumn("ingest_seq", F.col("mail_id"))).select(
        "hashcode", "ingest_seq", "amount", "paid_to", "txn_type", "reference_no", "txn_date", "category")
    new = L.append_batch(rec, f"{base}/transactions", batch_id)
    if learned is not None:
        commit_rules(learned, f"{base}/rules", batch_id)
    counts = (new.agg(F.count("*").alias("inserted")).join(good.agg(F.count("*").alias("read")))
              .join(quarantined.agg(F.count("*").alias("quarantined")))
              .select("inserted", (F.col("read") - F.col("inserted")).alias("duplicate"), "quarantined")
              .unpivot([], ["inserted", "duplicate", "quarantined"], "status", "n"))
    return own(counts, "counts")


def load_statements(lines: DataFrame, rules: DataFrame, base: str, batch_id: str, learner=None) -> DataFrame:
    """Statement lines -> base/transactions. What can't be loaded is set aside: pages that did not
    decode in base/quarantine_pages, and every assembled row in base/rows under its status, 'good' or
    what could not be read (see statement.routed_records); good rows go on from there. With a
    learner, the rules are kept under base/rules as in run_mail_batch. Returns the rows written."""
    from ledgerlake.operators import statement as S
    from ledgerlake.sources.statement import flag_pages, good_and_bad_pages

    def keep(df: DataFrame, part: str, *by: str) -> DataFrame:
        (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", *by).parquet(f"{base}/{part}"))
        schema = T.StructType([*[f for f in df.schema if f.name not in by], T.StructField("batch_id", T.StringType()),
                               *[f for f in df.schema if f.name in by]])
        return df.sparkSession.read.schema(schema).parquet(f"{base}/{part}").filter(F.col("batch_id") == batch_id)

    flagged = flag_pages(lines).persist(StorageLevel.MEMORY_AND_DISK)  # texts are read and cut into lines once
    pages, bad = good_and_bad_pages(flagged)
    keep(bad, "quarantine_pages")
    rows = keep(S.routed_records(pages, ("doc_id", "page_no", "txn_no")), "rows", "status")  # routed and written in one pass
    flagged.unpersist()
    good = rows.filter("status = 'good'").drop("batch_id", "status", *S.RAW_TEXTS)
    cat, learned = categorise_and_learn(good, rules, base, batch_id, learner)
    records = _statement_records(cat).drop("ingest_seq").withColumn("ingest_seq", F.col("source_id"))
    new = L.append_batch(records, f"{base}/transactions", batch_id)
    if learned is not None:
        commit_rules(learned, f"{base}/rules", batch_id)
    return new


def statement_counts(spark: SparkSession, base: str) -> DataFrame:
    """batch_id, status, n: the rows of every batch by what became of them."""
    t = spark.read.schema("batch_id string, status string").parquet(f"{base}/rows")
    return t.groupBy("batch_id", "status").agg(F.count("*").alias("n"))


def ingest_mail(mails_raw: DataFrame, rules: DataFrame, day=None, classifier=None) -> tuple[DataFrame, DataFrame]:
    """Landed mail (mail_id, sender, received_at, payload JSON) of one day (or all) ->
    (unique categorised records, quarantine). Sender and day filter at the scan; the body is
    picked from the MIME tree, turned into text lines, checked for alert words, parsed."""
    from ledgerlake.sources import mail as M

    picked = M.mime_body(M.bank_mails_on(mails_raw, day))
    texts = M.mail_text(picked).filter(M.has_alert_words(F.col("text")))
    return ingest_alert_texts(texts.select("mail_id", "received_at", "text"), rules, classifier)
