"""Repeated passages by seed and extend: winnowed anchors, matches grown both ways, maximal repeats cut.

Anchors are word K-grams picked by winnowing over SPAN of them, so any WINDOW equal consecutive
words hold the same anchor wherever they stand. Anchors are joined on their hash; only those that
occur twice go on. Around each shared anchor a document's windows grow to both sides: every
window of WINDOW words whose winnowed anchor it is. Windows that start earlier (smaller doc_id,
or earlier in the same document) make the later ones repeats; neighbouring repeats merge into
maximal ones, whose words are removed. Documents whose whole text is an earlier document's are
repeats at once. Within a run of texts equal windows are settled on the spot, so a passage that a
third of all documents share sends one row per run of texts and not one per document.

Nulls and edge cases: null or empty text has no words and keeps the empty string; fewer than
WINDOW words are kept; a null doc_id counts as smaller than any other; repeated rows of a doc_id
are the same document, each returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import slices
from ledgerlake.llm.store import join_counted, stored
from ledgerlake.llm.words import grams, owners, tokens, word_hashes

WINDOW, K = 20, 8
SPAN = WINDOW - K + 1
NO_ID = -(1 << 63)


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, ends, starts, anchors, gram): word hashes, text bounds, each whole window's start,
    the start of its winnowed anchor, and the hash of the K-gram at every word."""
    codes, ends, words = tokens(texts)
    values = word_hashes(words)[codes] if words else np.zeros(0, np.uint64)
    n = len(values)
    gram = np.concatenate([grams(values, K), np.zeros(min(n, K - 1), np.uint64)])
    starts = np.arange(max(0, n - WINDOW + 1))
    starts = starts[starts + WINDOW <= ends[owners(ends)[starts] + 1]] if n else starts
    # Smallest hash first, the rightmost of equal ones: 40 bits of hash, then 24 of place from the right.
    place = np.uint64((1 << 24) - 1)
    rank = (gram & ~place) | (place - (np.arange(n, dtype=np.uint64) & place))
    least, width = rank, 1
    while width < SPAN:  # least[i] is the minimum of rank[i:i + width]
        step = min(width, SPAN - width)
        least = np.minimum(least, np.concatenate([least[step:], np.full(min(step, len(least)), ~np.uint64(0))]))
        width += step
    anchors = starts + ((place - (least[starts] & place)).astype(np.int64) - starts) % (1 << 24)
    return values, ends, starts, anchors, gram


def anchor_rows(docs: DataFrame) -> DataFrame:
    """hash, key, pos of every winnowed anchor of docs(key, text)."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            _, ends, _, anchors, gram = windows(b.column("text"))
            at = np.unique(anchors)
            text = np.searchsorted(ends, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[at].view(np.int64)), b.column("key").take(pa.array(text)), pa.array((at - ends[text]).astype(np.int32))],
                ["hash", "key", "pos"],
            )

    return docs.select("key", "text").mapInArrow(pick, "hash long, key long, pos int")


def window_rows(docs: DataFrame) -> DataFrame:
    """Windows around the shared anchors in docs(key, text, anchors): h1, h2, key, start, n.

    n is 0 for a window that others must settle. Windows settled within a run of texts come as
    intervals of n windows from start, with the key spread as hash."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, ends, starts, anchors, _ = windows(b.column("text"))
            keys, shared = b.column("key").to_numpy(), b.column("anchors")
            flat, bounds = shared.values.to_numpy(), shared.offsets.to_numpy()
            known = np.zeros(len(values) + 1, bool)
            for i in range(b.num_rows):
                if shared[i].is_valid:
                    known[ends[i] + flat[bounds[i] : bounds[i + 1]]] = True
            starts = starts[known[anchors]]
            text = np.searchsorted(ends, starts, side="right") - 1
            h1, h2 = grams(values, WINDOW)[starts], grams(values * np.uint64(3) + np.uint64(7), WINDOW)[starts]
            key, start = keys[text], starts - ends[text]
            order = np.lexsort((start, key, h2, h1))
            a, z = order[:-1], order[1:]
            again = np.zeros(len(order), bool)
            # Equal to an earlier window of the run; repeated rows of a document are no repeat of each other.
            equal = (h1[a] == h1[z]) & (h2[a] == h2[z])
            group = np.concatenate([[0], np.cumsum(~equal)]) if len(order) else np.zeros(0, int)
            lead = order[np.searchsorted(group, group)]
            again[order] = (key[order] != key[lead]) | (start[order] != start[lead])
            yield rows(h1[~again], h2[~again], key[~again], start[~again], np.zeros((~again).sum(), np.int64))
            # starts ascends within a text, so settled windows form intervals as they stand.
            s, k, t = start[again], key[again], text[again]
            if len(s):
                first = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 1) | (np.diff(t) != 0)]))
                size = np.diff(np.append(first, len(s)))
                spread = k[first].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s[first].astype(np.uint64)
                yield rows(spread, spread, k[first], s[first], size)

    def rows(h1, h2, key, start, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
            ["h1", "h2", "key", "start", "n"],
        )

    return docs.mapInArrow(grow, "h1 long, h2 long, key long, start int, n int")


def merged(found: DataFrame) -> DataFrame:
    """key and the word bounds (from, to, from, to, ...) of its maximal repeats, from key, starts, counts."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, n in zip(b.column("starts"), b.column("counts"), strict=True):
                s, n = np.array(s.values.to_numpy()), np.maximum(n.values.to_numpy(), 1)
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate((s + n)[order]) + WINDOW - 1
                fresh = np.concatenate([[True], s[1:] > e[:-1]])
                first = np.flatnonzero(fresh)
                out.append(np.stack([s[first], e[np.append(first[1:], len(s)) - 1]], 1).reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.int32()))], ["key", "bounds"])

    return found.mapInArrow(merge, "key long, bounds array<int>")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, bounds): keys of whole copies of earlier texts, and the repeats of all others."""
    # A map side that folds few rows together still sends one row for a text that many share.
    digests = docs.select("key", F.md5("text").alias("d"))
    first = digests.groupBy("d").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    copies = stored(digests.join(first, "d").filter("key > first").select("key").distinct(), "copies")
    own = join_counted(docs, copies, ["key"], "left_anti")
    anchors = stored(anchor_rows(own), "anchors")
    shared = anchors.groupBy("hash").count().filter("count > 1").select("hash")
    places = anchors.join(shared, "hash").groupBy("key").agg(F.collect_set("pos").alias("anchors"))
    places = stored(places, "shared-anchors")
    around = join_counted(own, places, ["key"], "inner")
    seen = window_rows(around.select("key", "text", "anchors"))
    first = F.min("key").over(Window.partitionBy("h1", "h2"))
    again = seen.withColumn("first", first).filter("n > 0 or key > first")
    found = again.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    return copies, stored(merged(found), "repeats")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of each row of docs(doc_id, text)."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce("text", F.lit("")).alias("text"))
    copies, bounds = repeats(keyed.select("key", "text"))
    marked = join_counted(join_counted(keyed, copies.withColumn("copy", F.lit(True)), ["key"], "left"), bounds, ["key"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2_000_000):
            codes, ends, words = tokens(b.column("text"))
            total, gone, texts = [], [], []
            for i, (copy, spans) in enumerate(zip(b.column("copy").to_pylist(), b.column("bounds").to_pylist(), strict=True)):
                mine = codes[ends[i] : ends[i + 1]]
                keep = np.ones(len(mine), bool)
                if copy and len(mine) >= WINDOW:
                    keep[:] = False
                for a, z in zip((spans or [])[::2], (spans or [])[1::2], strict=True):
                    keep[a:z] = False
                total.append(len(mine))
                gone.append(len(mine) - int(keep.sum()))
                texts.append(" ".join([words[c] for c in mine[keep].tolist()]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return marked.select("doc_id", "text", "copy", "bounds").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    """dedup()'s rows with the kept words as a hash."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def oracle() -> str:
    """The contract as DuckDB SQL over documents."""
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) AS win
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS rn FROM g),
c AS (SELECT doc_id, list(i) AS bad FROM f WHERE rn > 1 GROUP BY doc_id),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w),
b AS (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM f WHERE rn > 1),
k AS (SELECT p.doc_id, count(*) AS kept, string_agg(ws[j], ' ' ORDER BY j) AS txt
      FROM p ANTI JOIN (SELECT DISTINCT doc_id, j FROM b) b ON p.doc_id = b.doc_id AND p.j = b.j GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""
