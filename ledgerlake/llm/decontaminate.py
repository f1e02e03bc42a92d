"""Benchmark leaks by latent semantic retrieval.

Texts are cut into blocks of STRIDE words; a passage is a block and the next one. One pass over
all texts counts in how many blocks each term (hashed word) stands and folds the blocks' term
counts into SKETCH rows by random signs, the range finder of a randomised SVD of the blocks' rows:
each task folds its own, Spark adds them up. With the IDF weights, these rows and the benchmark
items' TF-IDF rows (BENCH to one in energy, whatever their numbers, so the items' own terms keep
their place beside a corpus of any size) are factored into RANK directions. Items are cut into equal
pieces of at most PASSAGE words. A second pass projects every passage. It is a candidate for an item
when it holds enough of the latent vector of one of its pieces (projection and cosine): where
PARAPHRASE of an item stands, PARAPHRASE of one of its pieces does. The words around a candidate that
a copy may reach are searched, whatever the item's length. It counts as a leak when, in a stretch
WIDER times the item's length, the longest common subsequence of words covers VERBATIM of the item, or
PARAPHRASE of it with the answer (the item's last sentence) also in order. Items shorter than SHORT
words must stand whole, word after word.

Nulls and edge cases: null or empty texts hold no leak; null or empty items match nothing;
repeated rows each count alone and give their pairs once; null ids stay; an empty benchmark or
corpus gives no pairs; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import SLICE, slices
from ledgerlake.llm.store import lean
from ledgerlake.llm.words import MIX, mixed

PASSAGE, STRIDE = 64, 32
BITS, RANK, SKETCH = 13, 96, 64
BENCH = 20.0
VERBATIM, PARAPHRASE, ANSWER = 0.7, 0.55, 0.7
# PARAPHRASE times the worst share of a piece that one passage holds (0.75, as a piece as long as a
# passage may stand half a stride beside the nearest one) is 0.41 of its words, and less of its
# energy where the rare words are those replaced. The cosine is lower, as a passage also holds words
# that are not the piece's. What this lets through in vain is sorted out by its terms.
HOLDS, COSINE = 0.3, 0.15
SHORT = 8
WIDER = 1.75
ITEMS = 4096  # pieces of items searched in one pass, about; more go in further passes
SEED = 3
BARE = re.compile(r"[^\w]+")
SIGNS, WORD = re.compile(r"[^\w\n]+"), re.compile(r"[^\x20\x09-\x0D]+")
#: ASCII characters on the way to bare words: A-Z become a-z, white space a space; what \w doesn't match is dropped.
PLAIN = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
DROPPED = bytes(c for c in range(128) if not (chr(c).isalnum() or c in b"_ \t\n\v\f\r"))
SIGMA = "Σ".encode()  # the one letter whose lower case depends on the signs around it
CHUNK = 1 << 17  # bytes hashed at a time, so that their numbers stay in cache
BASE, RING = int(MIX), 1 << 64
LETTER = np.random.default_rng(SEED).integers(0, RING, 256, np.uint64)
POWER, INVERSE = (np.cumprod(np.append(np.uint64(1), np.full(CHUNK - 1, b, np.uint64))) for b in (BASE, pow(BASE, -1, RING)))


def spelled(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, stops) of a text's words, its runs of bytes above 32; its last byte is no word's.
    A hash sums a number per byte times BASE to the byte's place in its word: differences of one running sum."""
    data, at, parts = np.frombuffer(text, np.uint8), 0, []
    while at < len(text):
        to = min(at + CHUNK, len(text))
        if to < len(text):
            to = max(text.rfind(b" ", at, to), text.rfind(b"\n", at, to)) + 1
        if to:
            part = data[at:to]
            gap = np.append(True, part <= 32)
            edges = np.flatnonzero(gap[1:] != gap[:-1])
            total = np.append(np.uint64(0), np.cumsum(LETTER[part] * POWER[: len(part)]))[edges]
            parts.append(((total[1::2] - total[::2]) * INVERSE[edges[::2]], edges[::2] + at, edges[1::2] + at))
        else:  # a word longer than a chunk
            to = min(i for i in (text.find(b" ", at), text.find(b"\n", at)) if i >= 0)
            sums = (int((LETTER[data[i : min(i + CHUNK, to)]] * POWER[: min(CHUNK, to - i)]).sum()) * pow(BASE, i - at, RING) for i in range(at, to, CHUNK))
            parts.append((np.array([sum(sums) % RING], np.uint64), np.array([at]), np.array([to])))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends) of each text's words [^\\x20\\x09-\\x0D]+: lower case, without punctuation; words of
    signs alone are left out. Only distinct words that are not ASCII become Python strings."""
    rows = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    rows = [WORD.sub(lambda w: w[0].lower(), t.decode()).encode() if SIGMA in t else t for t in rows]
    text = b"".join([t.translate(PLAIN, DROPPED) + b"\n" for t in rows])
    hashes, starts, stops = spelled(text)
    data = np.frombuffer(text, np.uint8)
    ends = np.append(0, np.searchsorted(starts, np.flatnonzero(data == 10)))
    if text.isascii() or not len(starts):
        return hashes, ends
    foreign = np.flatnonzero(np.maximum.reduceat(data, starts) > 127)
    _, first, which = np.unique(hashes[foreign], return_index=True, return_inverse=True)
    words = [text[a:z] for a, z in zip(starts[foreign[first]].tolist(), stops[foreign[first]].tolist(), strict=True)]
    plain = SIGNS.sub("", (b"\n".join(words) + b"\n").decode().lower()).encode()
    found, at, _ = spelled(plain)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(plain, np.uint8) == 10), at)
    value, there = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
    value[line], there[line] = found, True
    hashes[foreign] = value[which]
    keep = np.ones(len(hashes), bool)
    keep[foreign] = there[which]
    if keep.all():
        return hashes, ends
    return hashes[keep], np.append(0, np.cumsum(keep))[ends]


def terms(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def halves(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, text, last): blocks of STRIDE words; a passage is a block and the next of its text."""
    n = np.diff(ends)
    blocks = -(-n // STRIDE)
    text = np.repeat(np.arange(len(n)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return ends[text] + nth * STRIDE, text, nth == blocks[text] - 1


def latent(term: np.ndarray, ends: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, text, starts): each passage's TF-IDF row times basis (which holds the weights)."""
    starts, text, last = halves(ends)
    if not len(starts):
        return np.zeros((0, basis.shape[1]), np.float32), text, starts
    bounds = np.append(starts, len(term)).tolist()
    block = np.empty((len(starts), basis.shape[1]), np.float32)
    for i in range(len(starts)):  # a block's rows at a time stay in cache
        basis.take(term[bounds[i] : bounds[i + 1]], axis=0).sum(0, out=block[i])
    out = block.copy()
    out[:-1][~last[:-1]] += block[1:][~last[:-1]]
    return out, text, starts


def statistics(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(blocks that hold each term, the blocks' counts folded into SKETCH rows, blocks) over all of
    docs(text): one row a term comes back, at most 2^BITS."""
    size = 1 << BITS

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        random = np.random.default_rng([SEED, TaskContext.get().partitionId()])
        out, total = np.zeros((size, SKETCH + 1)), 0
        for b in slices(batches, "text"):  # the signs drawn go by these slices
            hashes, ends = coded(b.column("text"))
            starts, _, _ = halves(ends)
            if not len(starts):
                continue
            block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
            term = terms(hashes)
            key = block << BITS | term
            held = np.sort(key if len(starts) >> (31 - BITS) else key.astype(np.int32))
            fresh = np.append(True, held[1:] != held[:-1])
            out[:, 0] += np.bincount(held[fresh] & (size - 1), minlength=size)
            row, sign = random.integers(1, SKETCH + 1, len(starts)), random.choice((-1.0, 1.0), len(starts))
            out += np.bincount(term * (SKETCH + 1) + row[block], sign[block], size * (SKETCH + 1)).reshape(out.shape)
            total += len(starts)
        at = np.flatnonzero(out[:, 0])
        flat = pa.array(np.append(out[at].reshape(-1), [total]).astype(np.float64))
        bounds = np.append(np.arange(len(at) + 1) * (SKETCH + 1), len(at) * (SKETCH + 1) + 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.ListArray.from_arrays(pa.array(bounds), flat)], ["term", "row"])

    parts = docs.select("text").mapInArrow(lean(fold), "term long, row array<double>")
    rows = parts.groupBy("term").agg(Summarizer.sum(array_to_vector("row")).alias("row")).collect()
    out, total = np.zeros((size, SKETCH + 1)), 0
    for r in rows:
        if r.term < 0:
            total = int(r.row[0])
        else:
            out[r.term] = r.row.toArray()
    return out[:, 0], out[:, 1:].T, total


class Items:
    """Benchmark items as word hashes, with their last sentence as the answer, and their pieces."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.answers = [], [], []
        self.pieces, self.owner = [], []
        for i, text in rows:
            hashes, _ = coded(pa.array([text]))
            if len(hashes):
                sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if BARE.sub("", s)]
                tail, _ = coded(pa.array([sentences[-1]]))
                self.ids.append(i)
                self.words.append(hashes)
                self.answers.append(tail)
                parts = np.array_split(hashes, -(-len(hashes) // PASSAGE))
                self.pieces += parts
                self.owner += [len(self.ids) - 1] * len(parts)

    def vectors(self, basis: np.ndarray) -> np.ndarray:
        return np.array([basis[terms(w)].sum(0) for w in self.pieces], np.float32).reshape(len(self.pieces), basis.shape[1])


def common(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a sequence of n words, given as bit masks, and words."""
    row = full = (1 << n) - 1
    for w in words:
        if m := masks.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return n - row.bit_count()


def stands(item: list[int], words: list[int]) -> bool:
    return any(words[i : i + len(item)] == item for i in range(len(words) - len(item) + 1))


def reach(n: int) -> int:
    """Words of the stretch in which an item of n words must stand, so that common words far apart don't add up to it."""
    return int(WIDER * n) + 4


def held(item: dict[int, int], n: int, answer: dict[int, int], m: int, words: list[int]) -> float:
    """The largest share of an item of n words, its answer of m, that stands in order in a stretch of words and makes it a leak, or 0."""
    best, step = 0.0, max(1, n // 4)
    for i in range(0, max(1, len(words) - reach(n) + step), step):
        stretch = words[i : i + reach(n)]
        share = common(item, n, stretch) / n
        if share > best and (share >= VERBATIM or share >= PARAPHRASE and common(answer, m, stretch) >= ANSWER * m):
            best = share
    return best


def masks_of(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for j, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << j
    return out


def basis_for(corpus: tuple[np.ndarray, np.ndarray, int], items: Items) -> np.ndarray:
    """(terms, RANK): IDF weights times the leading right singular vectors of corpus and items."""
    df, folded, total = corpus
    weight = np.log((total + 1) / (df + 1)) + 0.1
    random, rows = np.random.default_rng(SEED), np.zeros((0, 1 << BITS))
    for at in range(0, len(items.pieces), 8 * RANK):
        part = np.array([np.bincount(terms(w), minlength=1 << BITS) for w in items.pieces[at : at + 8 * RANK]]) * weight
        part /= np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9)
        if len(items.pieces) > 8 * RANK:  # the items' own range finder
            part = random.choice((-1.0, 1.0), (8 * RANK, len(part))) @ part
        rows = rows + part if len(rows) else part
    energy = lambda x: max(float((x * x).sum()), 1e-9)
    folded = folded * weight
    stacked = np.concatenate([folded / energy(folded) ** 0.5, rows * (BENCH / energy(rows)) ** 0.5])
    # The stack is short: its right singular vectors come from the small matrix of its rows' products.
    values, left = np.linalg.eigh(stacked @ stacked.T)
    top = np.argsort(-values)[: min(RANK, int((values > 1e-9 * values.max()).sum()))]
    right = (left[:, top] / np.sqrt(values[top])).T @ stacked
    return np.ascontiguousarray(right.T * weight[:, None], np.float32)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, share of each document and the benchmark items it holds."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").dropDuplicates()
    # Of no rows, and without Python: rows sent from the driver would take workers of their own beside the others.
    none = {"doc_id": "long", "item_id": "long", "share": "double"}
    out = spark.range(0).select([F.lit(None).cast(t).alias(c) for c, t in none.items()])
    words = F.size(F.split("text", r"\s+"))
    pieces = bench.agg(F.sum(F.ceil(words / PASSAGE))).first()[0] or 0
    blocks = -(-pieces // ITEMS)
    corpus = statistics(docs) if blocks else None
    for k in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) if blocks > 1 else bench
        items = Items([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()])  # about ITEMS pieces
        if items.ids:
            out = out.unionByName(search(docs, items, basis_for(corpus, items)))
    return out.distinct()


def search(docs: DataFrame, items: Items, basis: np.ndarray) -> DataFrame:
    vectors = items.vectors(basis)
    size = np.sqrt((vectors * vectors).sum(1))
    owner = np.array(items.owner)
    most = np.array([len(w) for w in items.pieces])
    # The terms of each piece; the places after its end hold a term that no text has.
    inside = np.full((len(most), PASSAGE), 1 << BITS, np.int32)
    for k, w in enumerate(items.pieces):
        inside[k, : len(w)] = terms(w)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [masks_of(w) for w in items.words]
        times = [{w: m.bit_count() for w, m in x.items()} for x in masks]
        answers = [masks_of(w) for w in items.answers]
        step = max(64, min(8192, 8192 * ITEMS // len(most)))
        for b in slices(batches, "text", SLICE):
            hashes, ends = coded(b.column("text"))
            term = terms(hashes)
            y, text, starts = latent(term, ends, basis)
            places: dict[tuple[int, int], list[int]] = {}
            for at in range(0, len(y), step):
                part = y[at : at + step]
                dots = part @ vectors.T
                lengths = np.sqrt((part * part).sum(1))[:, None]
                hit = (dots >= HOLDS * size * size) & (dots >= COSINE * lengths * size)
                passage, piece = np.nonzero(hit)
                for p, k in zip(*standing(passage + at, piece, term, ends, text, starts, inside, most), strict=True):
                    places.setdefault((int(text[p]), int(owner[k])), []).append(int(starts[p]))
            best: dict[tuple[int, int], float] = {}
            for (t, k), at in places.items():
                n, far = len(items.words[k]), reach(len(items.words[k]))
                for a, z in joined(sorted(set(at)), far, int(ends[t]), int(ends[t + 1])):
                    words = hashes[a:z].tolist()
                    there = set(words)
                    # No more of the item can stand in order than stands at all.
                    if sum(c for w, c in times[k].items() if w in there) < PARAPHRASE * n:
                        continue
                    if n < SHORT and not stands(items.words[k].tolist(), words):
                        continue
                    if common(masks[k], n, words) < PARAPHRASE * n:
                        continue
                    share = held(masks[k], n, answers[k], len(items.answers[k]), words)
                    if share > best.get((t, k), 0):
                        best[t, k] = share
            docs_ = b.column("doc_id").to_pylist()
            found = [(docs_[t], items.ids[k], s) for (t, k), s in best.items()]
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["doc_id", "item_id", "share"])

    return docs.mapInArrow(lean(find), "doc_id long, item_id long, share double")


def standing(passage, piece, term, ends, text, starts, inside, most) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of passage and piece that can hold PARAPHRASE of the piece: so many of its terms
    stand in the passage and the words around it that a copy of a piece may reach."""
    far, keep = reach(PASSAGE), np.zeros(len(passage), bool)
    own, row = np.unique(passage, return_inverse=True)
    for i in range(0, len(own), 512):
        here = own[i : i + 512]
        a = np.maximum(ends[text[here]], starts[here] - far)
        z = np.minimum(ends[text[here] + 1], starts[here] + PASSAGE + far)
        n = z - a
        at = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        there = np.zeros((len(here), (1 << BITS) + 1), bool)
        there[np.repeat(np.arange(len(here)), n), term[at]] = True
        first, last = np.searchsorted(passage, here[0]), np.searchsorted(passage, here[-1], side="right")
        for x in range(first, last, 65536):  # passage ascends
            q = slice(x, min(last, x + 65536))
            keep[q] = there[row[q, None] - i, inside[piece[q]]].sum(1) >= PARAPHRASE * most[piece[q]]
    return passage[keep], piece[keep]


def joined(at: list[int], far: int, first: int, last: int) -> list[tuple[int, int]]:
    """The stretches from first to last that reach far around passages at ascending places, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s in at:
        a, z = max(first, s - far), min(last, s + PASSAGE + far)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out
