"""Token ids as ORC files in ascending doc_id order, and back.

Texts are range-partitioned by (doc_id, text hash) and sorted before they are encoded, so each
file holds one run of doc_ids and is written once. ORC keeps the ids with integer run-length
encoding, an index entry every INDEX_STRIDE rows and a Bloom filter on doc_id: readers work by
stripe, and a search for a doc_id skips files, stripes and row groups by their metadata. Each
row has its own offset in its file; offsets over all files are sums over one row per file.

Nulls and edge cases: null text is empty and gives the end id alone; null doc_ids come first;
repeated doc_ids stand in the order of their text hash; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import WIDTH, slices, vocabulary
from ledgerlake.llm.piece_ids import byte_encoder
from ledgerlake.llm.store import lean, shared, small_batches

END = 2
PIECES = 500_000  # distinct pieces a worker keeps
STRIPE, INDEX_STRIDE = 16 << 20, 1000
FILE_SCHEMA = "part int, doc_id long, part_start long, n_tokens long, ids array<int>"


def with_end(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray, end: int) -> pa.Array:
    """The texts' ids as lists, each with the end id."""
    sizes = stops - starts
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(ends[-1], end, np.int32)
    at = np.repeat(ends[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    out[at] = ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """docs(doc_id, text) as ORC files of FILE_SCHEMA under path."""
    where = vocabulary(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, encoded = TaskContext.get().partitionId(), 0, byte_encoder(where, PIECES)
        for b in slices(batches, "text"):
            ids, starts, stops = encoded(b.column("text"))
            sizes = stops - starts + 1
            first = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part, np.int32)), b.column("doc_id"), pa.array(first), pa.array(sizes),
                 with_end(ids, starts, stops, end)],
                ["part", "doc_id", "part_start", "n_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    with small_batches(docs.sparkSession):
        (ordered.mapInArrow(lean(encode, keeps=True), FILE_SCHEMA).write.format("orc")
         .option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id")
         .option("orc.create.index", "true").option("orc.row.index.stride", str(INDEX_STRIDE))
         .option("orc.stripe.size", str(STRIPE)).save(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the filter reaches the files' statistics and Bloom filters."""
    return read(spark, path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def offsets(files: DataFrame) -> DataFrame:
    """part, before: the ids in all earlier files; from the row metadata, one row per file."""
    total = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return total.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def checksums(files: DataFrame) -> DataFrame:
    """part, doc_id, part_start, n_tokens and the crc32 of the ids, read back from the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            values, ends = memoryview(ids.values.buffers()[1]), ids.offsets.to_pylist()
            shift = ids.values.offset
            sums = [zlib.crc32(values[(shift + a) * WIDTH : (shift + z) * WIDTH]) for a, z in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("part", "doc_id", "part_start")]
                + [pa.array([z - a for a, z in zip(ends, ends[1:], strict=False)], pa.int64()), pa.array(sums, pa.int64())],
                ["part", "doc_id", "part_start", "n_tokens", "ids_crc32"],
            )

    some = files.select("part", "doc_id", "part_start", "ids")
    return some.mapInArrow(crc, "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from ORC files written for it."""
    spark = docs.sparkSession
    path = shared(spark, "tokens")
    write(docs, path, tokenizer)
    files = read(spark, path)
    return checksums(files).join(offsets(files), "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
