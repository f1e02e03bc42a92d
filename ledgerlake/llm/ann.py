"""Nearest neighbours by collision counting over single projections.

Rows are dealt into blocks by a hash of their id. A block's index is, for each of LINES random
lines, its rows sorted by their projection. A query opens a window around its own projection on
every line and widens all windows together (virtual rehashing: the radius grows by GROW); a row
collides on a line when it stands in the window. Rows that collide on at least SHARE of the lines
are verified by their exact cosine. A block stops widening once it has verified MOST of its rows
or LEAST, whichever is more, so a query's work per row stays constant as the table grows. Queries
meet the blocks in blocks of their own; each pair of blocks returns k rows a query and a window
keeps the k best over all.

Nulls and edge cases: a vector that is null, zero, or holds a null or non-finite component takes
no part, neither does a null id; vectors of different lengths never meet; equal vectors collide
equally, so ties are whole and go to smaller ids; of several vectors under an id the smallest,
component by component, counts; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINES, SHARE = 64, 0.65
FIRST, GROW = 0.6, 1.2  # radius: a unit vector's projections have a standard deviation of 1
APART = 1024.0
LEAST, MOST = 100, 0.15
ROWS, QUERIES = 4096, 1024  # aimed at, per block
SEED = 20


def lines(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, LINES)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def sorted_lines(unit_rows: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks): each line's projections in ascending order, as one ascending array in which line
    j is moved by j * APART, and every row's place in each line's order."""
    places = (unit_rows @ axes).T.astype(np.float64) + APART * np.arange(LINES)[:, None]
    order = np.argsort(places, axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(order.shape[1])[None, :], 1)
    return np.take_along_axis(places, order, 1).ravel(), ranks.astype(np.uint32)


def collide(index: tuple[np.ndarray, np.ndarray], n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block of n rows to verify for a query whose projections are at."""
    places, ranks = index
    need, enough = int(np.ceil(SHARE * LINES)), max(k, LEAST, int(np.ceil(MOST * n)))
    if n <= enough:
        return np.arange(n)
    line = np.arange(LINES)
    at = at + APART * line
    radius = FIRST
    while True:
        # The window of each line is a run of its sorted array; a row collides if its place is in the run.
        low = np.searchsorted(places, at - radius)
        size = (np.searchsorted(places, at + radius) - low).astype(np.uint32)
        inside = ranks - (low - line * n).astype(np.uint32)[:, None] < size[:, None]
        found = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8) >= need)
        if len(found) >= enough:
            return found
        radius *= GROW


def search_block(rows: tuple[np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[int, int, float]]:
    """(query id, id, cosine): the k nearest found in a block for each query, ties to smaller ids."""
    ids, x = rows
    x = x.astype(np.float64)
    lengths = np.sqrt((x * x).sum(-1))
    axes = lines(x.shape[1])
    index = sorted_lines(unit(x).astype(np.float32), axes)
    out = []
    for q, v in zip(*queries, strict=True):
        v = v.astype(np.float64)
        at = (unit(v[None]).astype(np.float32) @ axes)[0].astype(np.float64)
        near = collide(index, len(ids), at, k + 1)
        near = near[ids[near] != q]
        score = (x[near] * v).sum(-1) / (lengths[near] * np.sqrt((v * v).sum(-1)))
        best = np.lexsort((ids[near], -score))[:k]
        out += [(int(q), int(ids[near[i]]), float(score[i])) for i in best]
    return out


def usable(df: DataFrame, name: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(name).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & sound)
    return rows.withColumn("dim", F.size("v"))


def nearest(df: DataFrame, queries: DataFrame, k: int, name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of df found for each row of queries but itself."""
    x, q = usable(df, name, vector), usable(queries, name, vector)
    sizes = {r.side: r.n for r in x.select(F.lit("x").alias("side")).unionAll(q.select(F.lit("q").alias("side"))).groupBy("side").agg(F.count("*").alias("n")).collect()}
    nx, nq = (max(1, -(-sizes.get(s, 0) // n)) for s, n in (("x", ROWS), ("q", QUERIES)))
    # A block of rows goes to each block of queries and the other way round.
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(n)).cast("int")
    rows = x.withColumn("i", deal(nx)).withColumn("j", each(nq)).withColumn("q", F.lit(False))
    asked = q.withColumn("j", deal(nq)).withColumn("i", each(nx)).withColumn("q", F.lit(True))

    def search(key: tuple, g: pa.Table) -> pa.Table:
        ids, asks = g.column("id").to_numpy(), g.column("q").to_numpy().astype(bool)
        v = g.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)

        def side(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            one, w = ids[on], v[on]
            found, at = np.unique(one, return_index=True)
            if len(found) < len(one):  # several vectors under one id
                order = np.lexsort((*w.T[::-1], one))
                at = order[np.searchsorted(one[order], found)]
            return found, w[at]

        found = search_block(side(~asks), side(asks), k) if asks.any() and not asks.all() else []
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    both = rows.unionByName(asked).select("dim", "i", "j", "q", "id", "v")
    found = both.groupBy("dim", "i", "j").applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
