"""Statement text files -> statement_lines(doc_id, page_no, line_no, line).

One file per statement, pages separated by form feed. Each file is read whole (one row,
must stay < 2 GB); files are spread over tasks, so many statements read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_to_lines(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    pages = docs.select(F.col(doc_col).alias("doc_id"),
                        F.posexplode(F.split(F.col(text_col), "\f")).alias("page_no", "page"))
    return pages.select("doc_id", "page_no",
                        F.posexplode(F.split(F.col("page"), "\r?\n")).alias("line_no", "line"))


def read_statement_text(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return text_to_lines(raw)


def flag_pages(lines: DataFrame) -> DataFrame:
    """Adds __bad to every line: some line of its page could not be decoded (contains U+FFFD). Lines
    without a document or page are no page."""
    page = ["doc_id", "page_no"]
    broken = F.coalesce(F.max(F.col("line").contains("\ufffd")).over(Window.partitionBy(*page)), F.lit(False))
    return lines.withColumn("__bad", broken & F.col("doc_id").isNotNull() & F.col("page_no").isNotNull())


def good_and_bad_pages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A page whose text could not be decoded (contains U+FFFD) goes to quarantine, the rest
    is kept -- instead of silently skipping it. Lines may have their flag_pages already."""
    flagged = lines if "__bad" in lines.columns else flag_pages(lines)
    return flagged.filter(~F.col("__bad")).drop("__bad"), flagged.filter("__bad").drop("__bad")
