"""Category rules: ordered (category -> keywords) tables.

rules(category string, keyword string, priority bigint, source string, batch_id string)
priority = category position * 1e6 + keyword position, i.e. file order: the first
category in the file, then its first keyword, wins. Ties never happen; ordering key is
(priority, keyword) everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import path_exists

RULES_SCHEMA = "category string, keyword string, priority bigint, source string, batch_id string"
CATEGORY_STRIDE = 1_000_000
LEARNED_SLOT = CATEGORY_STRIDE - 1  # learned keywords sort after a category's file keywords

# Categories used when no rules file exists.
DEFAULT_CATEGORIES = ["Food", "Petrol", "Grocery", "Person", "Rent", "Others"]


def rules_frame(spark: SparkSession, mapping: dict[str, list[str]], source: str = "file",
                batch_id: str | None = None) -> DataFrame:
    rows = [
        (cat, kw, ci * CATEGORY_STRIDE + ki, source, batch_id)
        for ci, (cat, kws) in enumerate(mapping.items())
        for ki, kw in enumerate(kws)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """JSON object {category: [keyword, ...]} in file order -> rules table.

    A missing file gives the default categories, which carry no keywords (no rows).
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], RULES_SCHEMA)
    doc = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), "map<string,array<string>>")
    cats = doc.select(F.posexplode(F.map_entries(m)).alias("ci", "e"))
    kws = cats.select("ci", F.col("e.key").alias("category"), F.posexplode(F.col("e.value")).alias("ki", "keyword"))
    return kws.select(
        "category", "keyword",
        (F.col("ci").cast("bigint") * CATEGORY_STRIDE + F.col("ki")).alias("priority"),
        F.lit("file").alias("source"), F.lit(None).cast("string").alias("batch_id"),
    )


def rule_labels(spark: SparkSession, path: str) -> DataFrame:
    """label, position of every category in the file's order, those without keywords included; the
    default categories if there is no file."""
    if not path_exists(spark, path):
        return spark.createDataFrame(list(zip(DEFAULT_CATEGORIES, range(len(DEFAULT_CATEGORIES)), strict=True)), "label string, position int")
    m = F.from_json(F.col("value"), "map<string,array<string>>")
    cats = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(m)).alias("position", "e"))
    return cats.select(F.col("e.key").alias("label"), "position")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """All versions save_rules() wrote; batch ids are text."""
    return spark.read.schema(RULES_SCHEMA).parquet(path)


def save_rules(rules: DataFrame, path: str, batch_id: str) -> None:
    """Append one version of the rules table (a directory per batch; re-running a batch replaces it)."""
    (rules.withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


# ---------------------------------------------------------------- versions kept by the landing jobs
def _commits(spark: SparkSession, base: str):
    """(number, batch_id) of every committed version, ascending: one small file each."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n[:1].isdigit())


def rules_before(spark: SparkSession, base: str, batch_id: str) -> DataFrame | None:
    """The rules that `batch_id` starts from: the latest version that was committed before its own.
    A retried batch so reads what its first run read. None before the first version."""
    done = _commits(spark, base)
    own = next((n for n, b in done if b == batch_id), None)
    earlier = [n for n, _ in done if own is None or n < own]
    return spark.read.schema(RULES_SCHEMA).parquet(f"{base}/version={earlier[-1]}") if earlier else None


def current_rules(spark: SparkSession, base: str) -> DataFrame | None:
    """The latest committed version."""
    done = _commits(spark, base)
    return spark.read.schema(RULES_SCHEMA).parquet(f"{base}/version={done[-1][0]}") if done else None


def commit_rules(rules: DataFrame, base: str, batch_id: str) -> int:
    """Writes the next version and then names it in one file, which makes it current. Readers see the
    old version or the new one, never a part; a batch that has a version already keeps it. Batches
    of one table are run one after the other: of two that name one number, the second fails."""
    spark = rules.sparkSession
    done = _commits(spark, base)
    own = next((n for n, b in done if b == batch_id), None)
    if own is not None:
        return own
    number = done[-1][0] + 1 if done else 1
    rules.select("category", "keyword", "priority", "source", "batch_id").write.mode("overwrite").parquet(f"{base}/version={number}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_commits/{number}-{batch_id}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if any(n == number for n, _ in _commits(spark, base)):
        raise RuntimeError(f"version {number} of {base} was committed by another batch")
    fs.create(path, False).close()
    return number
