"""Best-fit packing of token sequences by exact-complement hashing.

Encoding gives each piece its length and its rank among the equal lengths of its partition. The
plan needs only the histogram of lengths (at most `size` numbers): single lengths, sums of pairs
and sums of triples are looked up for combinations that fill the gap beside the longest length
left exactly, each used as often as its lengths are available; what remains goes best-fit into
open gaps. The plan is a list of patterns with multiplicities. A piece finds its pattern, its
sequence and its offset from its rank among all pieces of its length.

Nulls and edge cases: null or empty text is one piece of the end id; repeated rows are packed
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import SLICE, WIDTH, slices, vocabulary
from ledgerlake.llm.piece_ids import byte_encoder
from ledgerlake.llm.store import join_counted, lean, stored

SIZE, END = 2048, 0
PIECES = "part int, nth long, doc_id long, piece int, start long, length int, ids_crc32 long"


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `size` but the first, which takes the rest."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """A row of PIECES for each piece; nth counts a length's pieces within a partition."""
    where, tail = vocabulary(tokenizer), end.to_bytes(WIDTH, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encoded = TaskContext.get().partitionId(), Counter(), byte_encoder(where)
        names = ["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for b in slices(batches, "text", SLICE):
            rows = []
            ids, starts, stops = encoded(b.column("text"))
            ids = ids.astype("<u4")
            for doc, first, last in zip(b.column("doc_id").to_pylist(), starts.tolist(), stops.tolist(), strict=True):
                raw = ids[first:last].tobytes() + tail
                for k, (s, n) in enumerate(cuts(len(raw) // WIDTH, size)):
                    rows.append((part, seen[n], doc, k, s, n, zlib.crc32(raw[s * WIDTH : (s + n) * WIDTH])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(encode, keeps=True), PIECES)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) patterns that use up counts, a histogram of lengths from 1 to size."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    out: list[tuple[tuple[int, ...], int]] = []

    def times(lengths: tuple[int, ...]) -> int:
        return min(left[n] // c for n, c in Counter(lengths).items())

    def use(lengths: tuple[int, ...], t: int) -> None:
        for n in lengths:
            left[n] -= t
        out.append((lengths, t))

    def pairs(gap: int, most: int) -> Iterator[tuple[int, int]]:
        """Pairs of available lengths with sum gap, the larger first and at most `most`."""
        for a in range(min(gap - 1, most), (gap + 1) // 2 - 1, -1):
            if left[a] and left[gap - a]:
                yield a, gap - a

    tail: list[tuple[int, int]] = []
    for n in range(size, 0, -1):
        gap = size - n
        if left[n] and not gap:
            use((n,), left[n])
        if left[n] and gap and (t := times((n, gap))):
            use((n, gap), t)
        if left[n]:
            for a, b in list(pairs(gap, n)):
                if t := times((n, a, b)):
                    use((n, a, b), t)
                if not left[n]:
                    break
        if left[n]:
            for a in range(min(gap - 2, n), (gap + 2) // 3 - 1, -1):
                if left[a]:
                    for b, c in list(pairs(gap - a, a)):
                        if t := times((n, a, b, c)):
                            use((n, a, b, c), t)
                if not left[n]:
                    break
        if left[n]:
            tail.append((n, left[n]))
            left[n] = 0
    # Best fit of the residual lengths, longest first, over groups of equal open sequences.
    by_gap: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def open_with(lengths: tuple[int, ...], t: int) -> None:
        group = by_gap[size - sum(lengths)]
        group[lengths] = group.get(lengths, 0) + t

    for n, c in tail:
        while c:
            gap = next((g for g in range(n, size) if by_gap.get(g)), None)
            if gap is None:
                each = 1  # a new sequence takes one; its gap may take more of the same length
                open_with((n,), t := -(-c // max(1, size // n)))
                c -= t * each
            else:
                lengths, t = by_gap[gap].popitem()
                if t > c:
                    by_gap[gap][lengths] = t - c
                    t = c
                open_with((*lengths, n), t)
                c -= t
    return out + [(lengths, t) for group in by_gap.values() for lengths, t in group.items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """Per length: the rank each use begins at, the first sequence of that use, the offset in it."""
    uses: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    upto: Counter = Counter()
    first = 0
    for lengths, t in patterns:
        offset = 0
        for n in lengths:
            begin, seq, at = uses[n]
            begin.append(upto[n])
            seq.append(first)
            at.append(offset)
            upto[n] += t
            offset += n
        first += t
    return dict(uses)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    cut = stored(pieces(docs, tokenizer, size, end), "pieces")
    here = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    uses = places(plan(counts, size))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(here.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "piece-ranks")
    ranked = join_counted(cut, before, ["part", "length"], "inner").select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tables = {n: [np.array(x, dtype="int64") for x in u] for n, u in uses.items()}
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, at = np.zeros(len(length), dtype="int64"), np.zeros(len(length), dtype="int64")
            for n in np.unique(length):
                begin, first, offset = tables[int(n)]
                mine = length == n
                k = np.searchsorted(begin, rank[mine], side="right") - 1
                seq[mine], at[mine] = first[k] + rank[mine] - begin[k], offset[k]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(seq), pa.array(at)], [*keep, "sequence_id", "offset"]
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.withColumn("length", F.col("length").cast("long")).mapInArrow(place, schema)
