"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, near_dedup, packing, pii, quality
from ledgerlake.llm.store import BATCH, join_counted, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Limits of a batch of texts, which Spark holds in every task, and its Python worker too.
LIMITS = {**BATCH, "spark.sql.parquet.columnarReaderBatchSize": "1000"}


def bounded(spark: SparkSession) -> None:
    for k, v in LIMITS.items():
        spark.conf.set(k, v)


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier keeps."""
    bounded(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("_keep").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest doc_id.
    Rows that repeat a doc_id and its text are one document and leave one row; different texts under one
    doc_id are told apart by nothing else and share its fate; rows without a doc_id stay."""
    bounded(spark)
    found = near_dedup.near_duplicates(docs, shingle=5, threshold=0.8)
    out = stored(found.filter("not kept").select("doc_id").distinct(), "dropped")
    kept = join_counted(docs, out, ["doc_id"], "left_anti")
    twice = stored(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if twice.isEmpty():
        return kept
    once = join_counted(kept, twice, ["doc_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return join_counted(kept, twice, ["doc_id"], "left_anti").unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are keyed by a hash of doc_id and text, so those without a
    doc_id, and different texts under one, are judged one by one."""
    bounded(spark)
    row = F.xxhash64("doc_id", "text")
    found = decontaminate.leaks(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    out = stored(found.select(F.col("doc_id").alias("_row")).distinct(), "leaking")
    return join_counted(docs.withColumn("_row", row), out, ["_row"], "left_anti").select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets, and n_chars (where there is one) counted again."""
    bounded(spark)
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document left, packed into sequences."""
    bounded(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", select_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", redact_pii),
    ("packing", pack),
]

#: The stages train a model and tokenize, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
