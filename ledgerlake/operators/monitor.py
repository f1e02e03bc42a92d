"""Run-log summaries and chat recency.

run_log(file string, line_no bigint, line string): line_no orders lines within a file.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import strip
from ledgerlake.plans.ordered import running_count

# Markers of the run log.
RUN_MARK = "RUN_START"
START_RE = r"=+ RUN_START (\d{4}-\d{2}-\d{2}) .* =+"
FOUND_MARK = "Total emails found for"
INSERTED_MARK = "Inserted:"
DUPLICATE_MARK = "Duplicate skipped:"
TRACEBACK_MARK = "Traceback (most recent call last)"
ERROR_MARKS = ["RuntimeError:", "Error"]
SUBJECT_PREFIX = "Daily Expense Pipeline Summary"

SUMMARY_SCHEMA = ("file string, run_date date, emails_found int, inserted bigint, duplicates bigint, "
                  "error_found boolean, error string")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files line by line, numbered from 0 in file order; a large file is read by many tasks.

    A scan cuts files into splits at byte offsets and reads each split in order within one task, so a
    line's place in its split is its row id less the split's first. The splits' counts (one row a
    split) give the lines before each. A final newline adds no line, an empty file has none."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"),
        F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", "\r$", "").alias("line"))
    earlier = Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "__at").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    splits = splits.select("file", "__at", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__add"))
    return raw.join(splits, ["file", "__at"]).select("file", (F.col("__id") + F.col("__add")).alias("line_no"), "line")


def run_blocks(log: DataFrame, block_size: int = 1 << 16) -> DataFrame:
    """Lines of the first run of each date in each file: after its start line, up to the next line
    containing RUN_START. Adds run_date. `block_size` is the line-number span of one
    level-1 block (dense numbering: 64k lines)."""
    x = running_count(log.withColumn("__s", F.col("line").contains(RUN_MARK)), ["file"], "line_no", "__s", "segment",
                      block_size)
    starts = (x.filter(F.col("line").rlike(START_RE))
              .select("file", "segment", F.try_to_date(F.regexp_extract("line", START_RE, 1)).alias("run_date")))
    # Per log file; a start line whose date is none opens a segment but no run.
    first = starts.filter(F.col("run_date").isNotNull()).groupBy("file", "run_date").agg(F.min("segment").alias("segment"))
    return x.filter(~F.col("__s")).join(first, ["file", "segment"], "inner").drop("__s")


def summarise(blocks: DataFrame) -> DataFrame:
    """Per file and run date: mails found (last count line, 0 if not a number), inserted and
    duplicate lines, error flag and the block's last line as the error text."""
    line = F.col("line")
    order = F.col("line_no")
    err = line.contains(TRACEBACK_MARK)
    for m in ERROR_MARKS:
        err = err | line.contains(m)
    found_line = F.max_by(F.when(line.contains(FOUND_MARK), line), F.when(line.contains(FOUND_MARK), order))
    g = blocks.groupBy("file", "run_date").agg(
        found_line.alias("__found"),
        F.count_if(line.contains(INSERTED_MARK)).alias("inserted"),
        F.count_if(line.contains(DUPLICATE_MARK)).alias("duplicates"),
        F.bool_or(err).alias("error_found"),
        F.max_by(line, order).alias("__last"),
    )
    found = F.coalesce(strip(F.substring_index(F.col("__found"), ":", -1)).try_cast("int"), F.lit(0))
    return g.select(
        "file", "run_date", found.alias("emails_found"), "inserted", "duplicates", "error_found",
        F.when(F.col("error_found"), F.col("__last")).otherwise(F.lit("")).alias("error"),
    )


def daily_summary(log: DataFrame, day: dt.date | None = None, block_size: int = 1 << 16) -> DataFrame:
    """Summary rows (one per file and date, or only `day`); no row when the date has no run."""
    s = summarise(run_blocks(log, block_size))
    return s.filter(F.col("run_date") == F.lit(day)) if day is not None else s


def summary_message(summary: DataFrame) -> DataFrame:
    """Subject and body text of the daily summary mail (the wording below is fixed)."""
    d = F.date_format("run_date", "yyyy-MM-dd")
    err = F.col("error_found")
    subject = F.concat(F.when(err, F.lit("❌ ERROR")).otherwise(F.lit("✅ SUCCESS")),
                       F.lit(f" | {SUBJECT_PREFIX} | "), d)
    flag = F.when(err, F.lit("True")).otherwise(F.lit("False"))
    body = F.concat(
        F.lit("📌 Summary for "), d, F.lit("\n\nEmails found: "), F.col("emails_found").cast("string"),
        F.lit("\nInserted: "), F.col("inserted").cast("string"),
        F.lit("\nDuplicate skipped: "), F.col("duplicates").cast("string"),
        F.lit("\nError_found: "), flag,
        F.when(err, F.concat(F.lit("\n\nError:\n"), F.col("error"))).otherwise(F.lit("")),
        F.lit("\n"),
    )
    return summary.select("file", "run_date", subject.alias("subject"), body.alias("body"))


def recent_messages(conv: DataFrame, n: int = 6) -> DataFrame:
    """Last n messages per conversation, newest first (recency 1 = newest). Spark keeps at most n
    rows per conversation and task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return conv.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)
