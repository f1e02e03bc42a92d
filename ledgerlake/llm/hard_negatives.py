"""Hard negatives by segment summaries: bounds on inner products from stored means and deviations.

Each integer vector is stored with a summary per level: it is cut into 4, then 16 segments, and of
each segment its mean and its deviation from it are kept (both times the root of the segment's
length). Over a segment, the product of two vectors' means plus or minus the product of their
deviations bounds their inner product, so sums over segments bound the score of a pair. A pair is
dropped at the first level whose bounds show that it can't enter its anchor's list any more; the
next level has finer segments; what is left is scored exactly, in integers.

Rows and anchors meet in units: a block of at most about ANCHORS anchors and one of at most
GROUPS groups of rows, spread by hash of vec_id, so labels and copies don't matter. A unit streams its rows
by ascending vec_id and holds only its anchors and their lists, whose worst entry is the bar for
the next rows. Units give one bounded list per anchor, which Spark merges. Positives come first,
then negatives, whose scores must lie in the band of each positive.

Nulls and edge cases: rows without vec_id or label, with a null vector or a null or non-finite
component take no part; of several rows under one vec_id the one with the smallest (label, vector)
does; vectors of different lengths never meet; scores are exact within 64 bits; ties go to the
smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.store import stored

LEVELS = (4, 16)  # segments of a vector
SCALE = 256
ANCHORS, ROWS, GROUPS = 32_768, 8_192, 256
CELLS = 4_000_000  # pairs bounded at once
DENSE = 0.2  # share of pairs left beyond which whole blocks are multiplied
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
NONE = np.iinfo(np.int64).min
FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: finite vectors with every component x as floor(scale * x)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Means, then deviations, of each row's segments, times the root of the segment's length."""
    cuts = [c for c in np.array_split(np.arange(x.shape[1]), segments) if len(c)]
    if not cuts:
        return np.zeros((len(x), 0))
    means = np.stack([x[:, c].sum(1) / np.sqrt(len(c)) for c in cuts], 1)
    spread = np.stack([np.sqrt(((x[:, c] - x[:, c].mean(1, keepdims=True)) ** 2).sum(1)) for c in cuts], 1)
    return np.concatenate([means, spread], 1)


def matrix(lists: pa.Array, rows: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def summarised(rows: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """rows with dim, the length of v, and s, the summaries of all levels one after the other."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = matrix(part.column("v"), part.num_rows).astype(np.float64)
                s = np.concatenate([summary(x, k) for k in levels], 1)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * s.shape[1])
                s = pa.ListArray.from_arrays(ends, pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, s], [*part.schema.names, "s"])

    with_dim = rows.select("vec_id", "label", F.size("v").alias("dim"), "v")
    return with_dim.mapInArrow(add, "vec_id long, label long, dim int, v array<long>, s array<double>")


class Block:
    """Vectors of one length: ids, labels, vectors, and their summaries by level."""

    def __init__(self, batch: pa.RecordBatch, levels: tuple[int, ...]):
        self.ids, self.labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        self.v = matrix(batch.column("v"), len(self.ids))
        self.x = self.v.astype(np.float64)
        s, self.levels, at = matrix(batch.column("s"), len(self.ids)), [], 0
        for k in levels:
            width = 2 * min(k, self.v.shape[1])
            self.levels.append(s[:, at : at + width])
            at += width
        self.largest = float(np.abs(self.x).max(initial=0))

    def cut(self, a: int, z: int) -> Block:
        part = object.__new__(Block)
        part.ids, part.labels, part.v, part.x = self.ids[a:z], self.labels[a:z], self.v[a:z], self.x[a:z]
        part.levels, part.largest = [s[a:z] for s in self.levels], self.largest
        return part


class Lists:
    """The best `k` (score, id) of each of n lists; best is a larger score, then a smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(which):
            return
        k, lists = self.score.shape[1], np.unique(which)
        which = np.concatenate([np.repeat(lists, k), which])
        score, ids = np.concatenate([self.score[lists].ravel(), score]), np.concatenate([self.id[lists].ravel(), ids])
        order = np.lexsort((ids, ~score, which))
        which = which[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        first = place < k
        self.score[which[first], place[first]], self.id[which[first], place[first]] = score[order][first], ids[order][first]


def scores(a: Block, r: Block, ai: np.ndarray | slice, ri: np.ndarray | None = None) -> np.ndarray:
    """Exact inner products: of the pairs (ai, ri), or of all pairs of anchors ai with all rows."""
    exact = a.largest * r.largest * max(1, a.v.shape[1]) < 1 << 53
    left, right = (a.x, r.x) if exact else (a.v, r.v)
    out = left[ai] @ right.T if ri is None else np.einsum("ij,ij->i", left[ai], right[ri])
    return out.astype(np.int64)


def survivors(a: Block, r: Block, which: np.ndarray, least: np.ndarray, most: np.ndarray | None,
              meet: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of the anchors `which` with the rows of r whose score is at
    least `least` of the anchor and (where given) at most `most`, to float precision; meet says
    which pairs may be."""
    slack = 1e-9 * (1 + a.largest * r.largest * max(1, a.v.shape[1]))
    low, high = least[which] - slack, None if most is None else most[which] + slack
    s, t = a.levels[0][which], r.levels[0]
    half = s.shape[1] // 2
    mean, spread = s[:, :half] @ t[:, :half].T, s[:, half:] @ t[:, half:].T
    alive = mean + spread >= low[:, None]
    if high is not None:
        alive &= mean - spread <= high[:, None]
    if meet is not None:
        alive &= meet(a.labels[which][:, None], r.labels[None, :])
    i, j = np.nonzero(alive)
    if len(i) > DENSE * alive.size:
        score = scores(a, r, which)[i, j]
    else:
        for s, t in zip(a.levels[1:], r.levels[1:], strict=True):
            half = s.shape[1] // 2
            p, q = s[which[i]], t[j]
            mean, spread = np.einsum("ij,ij->i", p[:, :half], q[:, :half]), np.einsum("ij,ij->i", p[:, half:], q[:, half:])
            keep = mean + spread >= low[i]
            if high is not None:
                keep &= mean - spread <= high[i]
            i, j = i[keep], j[keep]
        score = scores(a, r, which[i], j)
    keep = (score >= low[i]) & (a.ids[which[i]] != r.ids[j])
    if high is not None:
        keep &= score <= high[i]
    return which[i[keep]], j[keep], score[keep]


class Positives:
    """Per anchor, its best rows of the same label."""

    def __init__(self, anchors: Block, bands: list, k: int):
        self.a, self.lists = anchors, Lists(len(anchors.ids), k)
        self.by_label = {x: np.flatnonzero(anchors.labels == x) for x in np.unique(anchors.labels)}

    def add(self, rows: Block) -> None:
        for label in np.unique(rows.labels):
            which, mine = self.by_label.get(label), np.flatnonzero(rows.labels == label)
            if which is None:
                continue
            step = max(1, CELLS // len(which))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                r = rows.cut(some[0], some[-1] + 1) if some[-1] - some[0] + 1 == len(some) else self.take(rows, some)
                worst = self.lists.score[:, -1]  # later rows have larger ids: a tie loses
                least = np.where(worst == NONE, -np.inf, worst + 1.0)
                i, j, score = survivors(self.a, r, which, least, None, None)
                self.lists.add(i, score, r.ids[j])

    @staticmethod
    def take(rows: Block, some: np.ndarray) -> Block:
        part = rows.cut(0, 0)
        part.ids, part.labels, part.v, part.x = rows.ids[some], rows.labels[some], rows.v[some], rows.x[some]
        part.levels = [s[some] for s in rows.levels]
        return part

    def result(self) -> list[np.ndarray]:
        i, p = np.nonzero(self.lists.score != NONE)
        nothing = np.zeros(len(i), np.int64)
        return [self.a.ids[i], nothing, nothing, self.lists.id[i, p], self.lists.score[i, p]]


class Negatives:
    """Per anchor and positive, the best rows of another label whose score lies in the positive's band."""

    def __init__(self, anchors: Block, bands: list, k: int):
        pairs = [(i, *p) for i, held in enumerate(bands) for p in zip(held[::2], held[1::2], strict=True) if p[1] >= 0]
        self.a, self.lists = anchors, Lists(len(pairs), k)
        self.owner, self.positive, self.score = (np.array([p[c] for p in pairs], np.int64) for c in range(3))
        self.low = -(-LOW * self.score // 100)
        self.high = HIGH * self.score // 100
        width = max((len(held) // 2 for held in bands), default=0)
        self.bands = np.full((len(anchors.ids), max(1, width)), -1)  # band numbers of each anchor
        self.bands[self.owner, np.arange(len(pairs)) - np.searchsorted(self.owner, self.owner)] = np.arange(len(pairs))
        self.which = np.unique(self.owner)

    def add(self, rows: Block) -> None:
        if not len(self.which):
            return
        step = max(1, CELLS // len(self.which))
        for at in range(0, len(rows.ids), step):
            r = rows.cut(at, at + step)
            worst = self.lists.score[:, -1]
            need = np.maximum(self.low, np.where(worst == NONE, self.low, worst + 1))
            least, most = np.full(len(self.a.ids), np.inf), np.full(len(self.a.ids), -np.inf)
            np.minimum.at(least, self.owner, need.astype(np.float64))
            np.maximum.at(most, self.owner, self.high.astype(np.float64))
            i, j, score = survivors(self.a, r, self.which, least, most, lambda x, y: x != y)
            for b in self.bands.T:
                k = b[i]
                ok = k >= 0
                ok &= (score >= np.where(ok, need[k], 0)) & (score <= np.where(ok, self.high[k], 0))
                self.lists.add(k[ok], score[ok], r.ids[j[ok]])

    def result(self) -> list[np.ndarray]:
        b, p = np.nonzero(self.lists.score != NONE)
        return [self.a.ids[self.owner[b]], self.positive[b], self.score[b], self.lists.id[b, p], self.lists.score[b, p]]


def meet(rows: DataFrame, anchors: DataFrame, search: type, k: int, blocks: int, groups: int,
         levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """FOUND rows: every unit's lists of `search`. anchors have bands (positive_id, score, ...) besides."""
    names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, state = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in state.result()], names)

        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("dim", "block", "part", "kind")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if tuple(key[a, :3]) != unit:
                    yield from done()
                    unit, held, state = tuple(key[a, :3]), [], None
                part = b.slice(a, z - a)
                if key[a, 3] == 0:
                    held.append(part)
                elif held or state is not None:
                    if state is None:
                        every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        state, held = search(Block(every, levels), every.column("bands").to_pylist(), k), []
                    state.add(Block(part, levels))
        yield from done()

    def spread(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cols = ["dim", "block", "part", "kind", "vec_id", "label", "v", "s", "bands"]
    one = anchors.withColumn("block", spread(blocks, 1)).withColumn("part", every(groups)).withColumn("kind", F.lit(0))
    two = (rows.withColumn("part", spread(groups, 2)).withColumn("block", every(blocks)).withColumn("kind", F.lit(1))
           .withColumn("bands", F.lit(None).cast("array<long>")))
    units = one.select(*cols).unionByName(two.select(*cols)).repartition(2 * blocks * groups, "dim", "block", "part")
    return units.sortWithinPartitions("dim", "block", "part", "kind", "vec_id").mapInArrow(run, FOUND)


def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k of each list over all units, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(labelled: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         anchors: int = ANCHORS, rows: int = ROWS) -> DataFrame:
    """Hard negatives of the rows of labelled(vec_id, label, v) for which `anchor` holds:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    table = stored(summarised(labelled), "segments")
    asked = table.filter(anchor)
    n, m = table.count(), asked.count()
    blocks, groups = max(1, -(-m // anchors)), min(GROUPS, max(1, -(-n // rows)))
    near = meet(table, asked.withColumn("bands", F.array().cast("array<long>")), Positives, positives, blocks, groups)
    best = first(near, ["anchor_id"], positives).groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.flatten(F.collect_list(F.array(F.col("vec_id"), F.col("score")))).alias("bands"))  # at most `positives`
    asked = stored(asked.join(best, "vec_id"), "anchors")
    found = meet(table, asked, Negatives, negatives, blocks, groups)
    return first(found, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle(every: int = 50) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % {every} = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
