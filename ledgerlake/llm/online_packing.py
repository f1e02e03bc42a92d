"""Bounded-space online packing of token sequences into windows.

Each task reads its documents once and keeps at most `open_windows` windows open. A document's
ids (whole windows are cut off a longer one first) go to the fullest window that has room for all
of them; a new window is opened while there are fewer than the bound. When none fits, the fullest
window is topped up with the head of what is to be placed and emitted, and the rest is placed
the same way. So every window that a task emits is full, and only the open windows at its end are
not: at most `open_windows` a task. Their pieces, with their ids, are the documents of the next
round, in which FAN tasks' leftovers meet in one; rounds go on until one task is left, and that
one fills windows in turn and ends with windows of falling powers of two, which need no padding.

A task holds its open windows and a slice of its input; a group of a later round holds the
leftovers of FAN tasks (FAN * open_windows * size ids at most). Nothing passes through the driver
but the number of tasks.

Nulls and edge cases: null or empty text is the end id alone; a null doc_id stays null; repeated
rows are packed each; ties in room go to the window opened first; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import slices, vocabulary
from ledgerlake.llm.piece_ids import word_encoder
from ledgerlake.llm.store import stored

SIZE, END, OPEN, FAN = 4096, 2, 16, 128
VOCABULARY = "word_bpe_49k.json"
ROUNDS = 1 << 24  # tasks of a round, for sequence ids
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
TYPES = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, ids binary"
Item = tuple[int | None, int, int, np.ndarray]  # doc_id, start, doc_tokens, ids


class Windows:
    """The open windows of a task, and the rows of what it has emitted."""

    def __init__(self, part: int, first: int, size: int, most: int):
        self.part, self.next, self.size, self.most = part, first, size, most
        self.open: list[list] = []  # [room, items]
        self.out: list[tuple] = []

    def row(self, item: Item, sequence: int | None, offset: int | None) -> tuple:
        doc, start, total, ids = item
        raw = ids.astype("<u4").tobytes()
        return doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, self.part, raw if sequence is None else None

    def emit(self, items: list[Item]) -> None:
        at = 0
        for item in items:
            self.out.append(self.row(item, self.next, at))
            at += len(item[3])
        self.next += 1

    def place(self, item: Item) -> None:
        doc, start, total, ids = item
        while len(ids) >= self.size:
            self.emit([(doc, start, total, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            n = len(ids)
            fit = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.most:
                self.open.append(fit := [self.size, []])
            fullest = fit or min(self.open, key=lambda w: w[0])
            take = min(n, fullest[0])
            fullest[1].append((doc, start, total, ids[:take].copy()))  # a view would hold the whole slice
            fullest[0] -= take
            start, ids = start + take, ids[take:]
            if not fullest[0]:
                self.open = [w for w in self.open if w is not fullest]
                self.emit(fullest[1])

    def leave(self) -> None:
        """The open windows' pieces as rows without a sequence."""
        for _, items in self.open:
            self.out += [self.row(i, None, None) for i in items]
        self.open = []

    def close(self) -> None:
        """The open windows' pieces in full windows, then in windows of falling powers of two."""
        items = [i for _, held in sorted(self.open, key=lambda w: w[0]) for i in held]
        left, self.open = sum(len(i[3]) for i in items), []
        while left:
            room = min(self.size, 1 << (left.bit_length() - 1))
            left -= room
            held = []
            while room:
                doc, start, total, ids = items.pop(0)
                held.append((doc, start, total, ids[:room]))
                if len(ids) > room:
                    items.insert(0, (doc, start + room, total, ids[room:]))
                room -= len(held[-1][3])
            self.emit(held)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[] for _ in COLUMNS]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], COLUMNS)


def first_round(docs: DataFrame, path: str, size: int, end: int, most: int) -> DataFrame:
    """Rows of SCHEMA: placed pieces, and those of the windows left open, with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        windows, encoded = Windows(part, part << 32, size, most), word_encoder(path)
        for b in slices(batches, "text"):
            ids, ends = encoded(b.column("text"))
            for doc, a, z in zip(b.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                windows.place((doc, 0, z - a + 1, np.append(ids[a:z], np.int32(end))))
            yield windows.batch()
        windows.leave()
        yield windows.batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def next_round(left: DataFrame, level: int, fan: int, size: int, most: int, last: bool) -> DataFrame:
    """The leftovers of `fan` tasks each packed by one; the last one closes its windows."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        windows = Windows(part, (level * ROUNDS + part) << 32, size, most)
        group = group.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        for r in group.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist():
            windows.place((r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<i4")))
        windows.close() if last else windows.leave()
        return pa.Table.from_batches([windows.batch()])

    grouped = left.withColumn("part", F.floor(F.col("part") / fan).cast("int"))
    return grouped.groupBy("part").applyInArrow(run, SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, open_windows: int = OPEN,
         fan: int = FAN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of docs(doc_id, text)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(VOCABULARY)
    rows = stored(first_round(docs, vocabulary(tokenizer), size, end, open_windows), "windows")
    placed = rows.filter("sequence_id is not null")
    level = 0
    while True:
        left, level = rows.filter("sequence_id is null"), level + 1
        tasks = left.agg(F.max("part")).first()[0]
        if tasks is None:
            break
        rows = stored(next_round(left, level, fan, size, open_windows, tasks < fan), "leftovers")
        placed = placed.unionByName(rows.filter("sequence_id is not null"))
    return placed.select(*COLUMNS[:7])
