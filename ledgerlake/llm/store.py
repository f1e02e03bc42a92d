"""Working tables in the cluster's shared folder, and joins whose small side's size is checked first."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its stored files hold at most so many bytes;
#: beyond it the join shuffles both sides and adaptive execution may split hot keys.
BROADCAST_BYTES = 16 << 20


def shared(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: later plans start from files
    that outlive any executor, and nothing before them runs again."""
    spark = df.sparkSession
    path = shared(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives memory that this worker process no longer uses back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Drop what this worker process keeps from one task to the next, such as encoders.
KEPT: list[Callable[[], None]] = []


def let_go() -> None:
    for drop in KEPT:
        drop()


def lean(work: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None, keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that trims its worker when a task ends, after forget(): workers outlive their
    stage, and what an idle one holds is missing in the next. Unless work keeps it, what tasks of other
    work left in the worker is dropped first."""

    def run(batches: Iterator) -> Iterator:
        if not keeps:
            let_go()
        try:
            yield from work(batches)
        finally:
            if forget:
                forget()
            trim()

    return run


#: Limits of an Arrow batch of texts: Spark and its Python worker hold one at once, in every task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run within has batches of BATCH at most; the session's own limits hold again after it."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bytes_of(table: DataFrame) -> int:
    """Size of a stored table's files, as the planner knows it."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_counted(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """big joined with a stored table: by broadcast if its files are within BROADCAST_BYTES, else by a shuffle."""
    return big.join(F.broadcast(small) if bytes_of(small) <= BROADCAST_BYTES else small, on, how)


def pinned(df: DataFrame, keep: list[str], **cols: Column) -> DataFrame:
    """keep plus cols, each computed once: a generator of one row stands between them and what
    uses them, so the optimizer doesn't copy a costly expression into every use."""
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias("_one")
    return df.select(*keep, one).select(*keep, *[F.col(f"_one.{k}").alias(k) for k in cols])
