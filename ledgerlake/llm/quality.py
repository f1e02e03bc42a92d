"""Quality selection by ordinal cumulative-link regression over hashed text.

Labels give graded ratings: 0 toxic, 1 poor, 2 good. P(grade <= k) is the logistic of threshold k
minus the document's score, with one weight vector for all grades and thresholds in ascending
order. A document's features are the hashed words it holds (letters only, lower case), their first
letters and, in a part of their own, the shares of its words by shape (case and signs) and of words that repeat the
one before. Training takes at most SAMPLE labelled documents, those with the smallest hash of
their id, and minimises the penalised likelihood by L-BFGS; Spark tasks compute the gradient over
the sample's stored features. Every document is then scored: expected grade, probability of the
top grade (tail), and keep.

Nulls and edge cases: null or empty text has no features; labels with a null doc_id, quality or
without a document don't count; a doc_id with several labels takes its lowest grade; a null doc_id
is scored too; repeated rows are scored alike; without labelled documents of two grades nothing
can be learned, so all are kept and scores are null; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import SLICE, slices
from ledgerlake.llm.store import lean, stored
from ledgerlake.llm.words import owners, tokens, word_hashes

SAMPLE = 12_000
WORD_BITS, SHAPES = 17, 256
SIZE = (1 << WORD_BITS) + SHAPES + 1
GRADES = 3
RIDGE = 1.0
SHAPE_SCALE = 4.0
STEMS = (4, 5)
ROUNDS = 30
KEEP = 0.5
LETTERS = re.compile(r"[\W\d_]+")


def grade(quality: str = "quality", toxic: str = "toxic"):
    return F.when(F.coalesce(F.col(toxic), F.lit(0)) > 0, 0).when(F.col(quality) > 0, 2).otherwise(1)


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one letter each; other signs as they are, runs as one."""
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:24]]
    return "".join(c for i, c in enumerate(kinds) if not i or c != kinds[i - 1])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, value, ends): each text's features, columns ascending."""
    codes, ends, words = tokens(texts)
    n = len(ends) - 1
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(0), np.zeros(n + 1, np.int64)
    bare = [LETTERS.sub("", w).lower() for w in words]
    # Each word's own column and those of its first letters, as stems carry over to unseen words.
    cut = [bare, *([w[:k] if len(w) > k else "" for w in bare] for k in STEMS)]
    column = np.stack([(word_hashes(ws, k) >> np.uint64(64 - WORD_BITS)).astype(np.int64) for k, ws in enumerate(cut)])
    column[np.array([[not w for w in ws] for ws in cut])] = -1
    form = (1 << WORD_BITS) + (word_hashes([shape(w) for w in words], 1) % np.uint64(SHAPES)).astype(np.int64)
    owner, total = owners(ends), np.maximum(np.diff(ends), 1)
    pairs = np.unique(owner * len(words) + codes)  # each word once a text
    of, columns = pairs // len(words), column[:, pairs % len(words)]
    held = np.unique((of * SIZE + columns)[columns >= 0])
    shaped, counts = np.unique(owner * SIZE + form[codes], return_counts=True)
    same = np.flatnonzero((codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]))
    again = np.bincount(owner[same], minlength=n)
    rep = np.flatnonzero(again)
    key = np.concatenate([held, shaped, rep * SIZE + SIZE - 1])
    value = np.concatenate([np.ones(len(held)), SHAPE_SCALE * counts / total[shaped // SIZE], SHAPE_SCALE * again[rep] / total[rep]])
    order = np.argsort(key)
    key, value = key[order], value[order]
    return (key % SIZE).astype(np.int32), value, np.searchsorted(key // SIZE, np.arange(n + 1))


def probabilities(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade > k) for each score and threshold."""
    return 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray


def loss(score: np.ndarray, y: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood, its derivative by score, and by threshold (summed)."""
    above = np.concatenate([np.ones((len(y), 1)), probabilities(score, cuts), np.zeros((len(y), 1))], 1)
    at = np.arange(len(y))
    hi, lo = above[at, y], above[at, y + 1]
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi), lo * (1 - lo)  # derivative of P(grade > k) by score
    by_cut = np.zeros(len(cuts) + 2)
    np.add.at(by_cut, y, dhi / p)
    np.add.at(by_cut, y + 1, -dlo / p)
    return float(-np.log(p).sum()), -(dhi - dlo) / p, by_cut[1:-1]


def unpack(z: np.ndarray) -> Model:
    """Parameters: weights, the first threshold, logs of the steps to the next ones."""
    return Model(z[:SIZE], z[SIZE] + np.concatenate([[0], np.cumsum(np.exp(z[SIZE + 1 :]))]))


def gradient_over(sample: DataFrame) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    def evaluate(z: np.ndarray) -> tuple[float, np.ndarray]:
        model = unpack(z)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, g = 0.0, np.zeros(SIZE + GRADES - 1)
            for b in batches:
                cols, vals = b.column("cols"), b.column("vals")
                c, v, ends = cols.values.to_numpy(), vals.values.to_numpy(), cols.offsets.to_numpy()
                c, v = c[ends[0] : ends[-1]], v[ends[0] : ends[-1]]
                owner = owners(ends)
                score = np.bincount(owner, v * model.weights[c], b.num_rows)
                one, by_score, by_cut = loss(score, b.column("grade").to_numpy(), model.cuts)
                value += one
                g[:SIZE] += np.bincount(c, v * by_score[owner], SIZE)
                g[SIZE:] += by_cut
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([g.tobytes()])], ["value", "gradient"])

        rows = sample.mapInArrow(part, "value double, gradient binary").collect()  # one row a task of a bounded sample
        value = sum(r.value for r in rows) + RIDGE / 2 * float(model.weights @ model.weights)
        g = sum(np.frombuffer(r.gradient) for r in rows)
        steps = np.diff(model.cuts)
        by_cut = g[SIZE:]
        tail = np.cumsum(by_cut[::-1])[::-1]
        return value, np.concatenate([g[:SIZE] + RIDGE * model.weights, [tail[0]], tail[1:] * steps])

    return evaluate


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], z: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with step halving."""
    value, g = evaluate(z)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y in reversed(past):
            alphas.append((s @ d) / (s @ y))
            d = d - alphas[-1] * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(1.0, float(np.sqrt(g @ g)))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0
        while True:
            nxt, ng = evaluate(z + step * d)
            if nxt <= value + 1e-4 * step * float(g @ d) or step < 1e-3:
                break
            step /= 2
        if nxt >= value:
            break
        s, y = step * d, ng - g
        done = value - nxt < 1e-4 * abs(value)
        z, value, g = z + s, nxt, ng
        if s @ y > 1e-10:
            past = [*past, (s, y)][-memory:]
        if done:
            break
    return z


def graded(labels: DataFrame) -> DataFrame:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    return rows.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade()).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of at most `sample` labelled documents, or None if they show fewer than two grades.
    Labels without a document take no place of the sample."""
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = graded(labels).join(here, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = stored(chosen, "label-sample")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            c, v, ends = features(b.column("text"))
            ends = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("grade"), pa.ListArray.from_arrays(ends, pa.array(c)), pa.ListArray.from_arrays(ends, pa.array(v))],
                ["grade", "cols", "vals"],
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = ids.join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two integers
    train = stored(rows.select("grade", "text").mapInArrow(lean(build), "grade int, cols array<int>, vals array<double>"), "features")
    counts = {r.grade: r.n for r in train.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    upto = np.cumsum([counts.get(k, 0) for k in range(GRADES - 1)])
    share = np.clip(upto / total, 0.01, 0.99)
    cuts = np.log(share / (1 - share))
    z = np.concatenate([np.zeros(SIZE), [cuts[0]], np.log(np.maximum(np.diff(cuts), 0.05))])
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    return unpack(minimise(gradient_over(train.coalesce(max(1, tasks))), z, ROUNDS))


def score(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """docs with expected_grade, tail and keep appended; docs holds text."""
    out = [*docs.schema.fields]
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("*", none.alias("_expected"), none.alias("_tail"), F.lit(True).alias("_keep"))
    from pyspark.sql import types as T

    schema = T.StructType([*out, T.StructField("_expected", T.DoubleType()), T.StructField("_tail", T.DoubleType()),
                           T.StructField("_keep", T.BooleanType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            c, v, ends = features(b.column("text"))
            value = np.bincount(owners(ends), v * model.weights[c], b.num_rows)
            above = probabilities(value, model.cuts)
            cols = [pa.array(above.sum(1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= keep)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "_expected", "_tail", "_keep"])

    return docs.mapInArrow(lean(rate), schema)


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, tail, keep of each row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rated = score(rows, fit(rows, labels), keep)
    return rated.select("doc_id", F.col("_expected").alias("expected_grade"), F.col("_tail").alias("tail"), F.col("_keep").alias("keep"))
