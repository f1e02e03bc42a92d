"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "ledgerlake") -> SparkSession:
    """Session for tests and local runs. On a cluster, the submitter's settings win."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Settings that change results; applied to any session we are handed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Deep MIME trees are walked by a recursive query; neither their depth nor their number may end it.
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def shared_dir(spark: SparkSession, sub: str) -> str:
    """A folder under the cluster's shared checkpoint dir (spark.checkpoint.dir).

    Only a local session that names none gets (and registers) a folder of its own.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        try:
            base = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            base = None
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="ledgerlake-ckpt-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    base = base.rstrip("/")
    return f"{base}/{sub}" if sub else base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, for row-wise text work (regexes, decoding, hashing).

    A scan is cut by bytes, so a table of less than one scan partition per core leaves cores idle
    however much work a row is; dealing it costs a shuffle of at most that many bytes. A larger
    table has a partition for every core already and is returned as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    full = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < cores * full else df
