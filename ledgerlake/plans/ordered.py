"""Order-dependent steps (previous value, running sums) without one task per key.

A window partitioned only by document/file puts a whole document in one task; one hot
document (a third of all rows) would then be one task. These helpers work in levels:
1. within small blocks (a page, a day, a fixed run of line numbers) with an ordinary window;
2. across blocks on a per-block summary (one row per block), joined back on (key, block).
Before the across-block window, the largest number of blocks of one key is counted on the
summary. Above `max_blocks`, the summary is handled the same way with super-blocks of
`fanout` blocks (recursively, up to `levels` levels), so no window partition ever holds
more than `max_blocks` rows of one key. Every join is on (key, block), which is spread out
even when one key is hot.

Each level reads its input twice (window and summary). Column pruning makes the two
branches' plans differ, so Spark would not reuse the exchange and would compute the input
twice; it is persisted (MEMORY_AND_DISK, evictable and spillable) so it is computed once.
The summary's shuffle comes after partial aggregation (one row per block per task).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 4
FANOUT = 1024
MAX_BLOCKS = 1 << 20


def _needs_level(summary: DataFrame, part: list[str], levels: int, max_blocks: int) -> bool:
    """True when another level is allowed and some key has more than max_blocks blocks."""
    if levels <= 1:
        return False
    g = summary.groupBy(*part).count() if part else summary.groupBy().count()
    biggest = g.agg(F.max("count")).first()[0]
    return biggest is not None and biggest > max_blocks


def prev_in_order(df: DataFrame, part: list[str], block: str, order: list[str], value: str,
                  out: str = "prev", first_flag: str = "is_first", levels: int = LEVELS,
                  fanout: int = FANOUT, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Adds `out` = `value` of the previous row in (block, *order) order within `part`,
    and `first_flag` = true on the first row of the partition. `block` is an integer
    column that does not decrease along the order."""
    n = levels
    in_prev, bfirst, last, plast, hasprev = (f"__ip{n}", f"__bf{n}", f"__last{n}", f"__pl{n}", f"__hp{n}")
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    w_in = Window.partitionBy(*part, block).orderBy(*order)
    x = df.withColumns({in_prev: F.lag(value).over(w_in), bfirst: F.lag(F.lit(1)).over(w_in).isNull()})
    summary = df.groupBy(*part, block).agg(F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias(last))
    if _needs_level(summary, part, levels, max_blocks):
        sb = f"__sb{n}"
        s = prev_in_order(summary.withColumn(sb, F.floor(F.col(block) / F.lit(fanout))), part, sb, [block], last,
                          plast, f"__f{n}", levels - 1, fanout, max_blocks)
        summary = s.select(*part, block, plast, (~F.col(f"__f{n}")).alias(hasprev))
    else:
        w_blk = Window.partitionBy(*part).orderBy(block)
        summary = summary.select(*part, block, F.lag(last).over(w_blk).alias(plast),
                                 F.lag(F.lit(1)).over(w_blk).isNotNull().alias(hasprev))
    return (
        x.join(summary, [*part, block], "left")
        .withColumn(out, F.when(F.col(bfirst), F.col(plast)).otherwise(F.col(in_prev)))
        .withColumn(first_flag, F.col(bfirst) & ~F.col(hasprev))
        .drop(in_prev, bfirst, plast, hasprev)
    )


def running_sum(df: DataFrame, part: list[str], block: str, order: list[str], value: str,
                out: str = "running", total_out: str | None = None, levels: int = LEVELS,
                fanout: int = FANOUT, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Adds `out` = sum of `value` over the rows at or before this one in (block, *order) order
    within `part` (`block` is an integer column that does not decrease along `order`), and
    optionally `total_out` = the sum over the whole `part`."""
    n = levels
    inb, t, before, cum, tot = f"__in{n}", f"__t{n}", f"__bef{n}", f"__cum{n}", f"__tot{n}"
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    w_in = Window.partitionBy(*part, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = df.withColumn(inb, F.sum(value).over(w_in))
    totals = df.groupBy(*part, block).agg(F.sum(value).alias(t))
    if _needs_level(totals, part, levels, max_blocks):
        sb = f"__sb{n}"
        r = running_sum(totals.withColumn(sb, F.floor(F.col(block) / F.lit(fanout))), part, sb, [block], t, cum,
                        tot if total_out else None, levels - 1, fanout, max_blocks)
        keep = [*part, block, (F.col(cum) - F.col(t)).alias(before)] + ([F.col(tot)] if total_out else [])
        totals = r.select(*keep)
    else:
        w_blk = Window.partitionBy(*part).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        keep = [*part, block, F.coalesce(F.sum(t).over(w_blk), F.lit(0)).alias(before)]
        if total_out:
            keep.append(F.sum(t).over(Window.partitionBy(*part)).alias(tot))
        totals = totals.select(*keep)
    res = x.join(totals, [*part, block], "left").withColumn(out, F.col(before) + F.col(inb))
    if total_out:
        res = res.withColumnRenamed(tot, total_out)
    return res.drop(inb, before)


def running_count(df: DataFrame, part: list[str], order: str, flag: str, out: str = "segment",
                  block_size: int = 1 << 16, levels: int = LEVELS, fanout: int = FANOUT,
                  max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Adds `out` = number of rows with `flag` true at or before this row (by the integer
    column `order`) within `part` -- i.e. a segment number that starts at every flagged row."""
    x = df.withColumn("__blk", F.floor(F.col(order) / F.lit(block_size))).withColumn("__f", F.col(flag).cast("int"))
    return (running_sum(x, part, "__blk", [order], "__f", out, None, levels, fanout, max_blocks)
            .withColumn(out, F.col(out).cast("bigint")).drop("__blk", "__f"))


def global_positions(df: DataFrame, order: list, weight=None, pos_out: str = "position",
                     offset_out: str | None = None, partitions: int | None = None) -> DataFrame:
    """Adds `pos_out` = 1-based place of each row in the total order `order` (Columns with
    direction; they must break every tie) and, with `weight`, `offset_out` = the sum of
    `weight` over all rows before it.

    A distributed range sort: rows are range-partitioned on the order (sampled bounds; the
    order is unique, so a hot value cannot make a hot task), numbered inside each range, and
    each range learns its start from one count per range -- a table of at most `partitions`
    rows, so its broadcast is bounded by the partition count, not by the data.
    """
    w = F.lit(0).cast("bigint") if weight is None else weight
    # Without a fixed count the range exchange uses the shuffle partitions and AQE may merge
    # neighbouring ranges, which keeps partition ids in order.
    x0 = df.withColumn("__w", w)
    s = (x0.repartitionByRange(partitions, *order) if partitions else x0.repartitionByRange(*order))
    s = (s
         .withColumn("__pid", F.spark_partition_id())
         .persist(StorageLevel.MEMORY_AND_DISK))
    w_rng = Window.partitionBy("__pid").orderBy(*order)
    x = s.withColumns({
        "__rn": F.row_number().over(w_rng),
        "__cw": F.sum("__w").over(w_rng.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.sum("__w").alias("__ws"))
              .select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
                      F.coalesce(F.sum("__ws").over(before), F.lit(0)).alias("__ws0")))
    res = x.join(F.broadcast(starts), "__pid").withColumn(pos_out, F.col("__n0") + F.col("__rn"))
    if offset_out:
        res = res.withColumn(offset_out, F.col("__ws0") + F.col("__cw") - F.col("__w"))
    return res.drop("__w", "__pid", "__rn", "__cw", "__n0", "__ws0")
