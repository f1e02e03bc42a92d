"""Token ids of many texts at once: texts are cut where the vocabulary's splitter always cuts, each
distinct piece is encoded once, and the ids of the texts are gathered from one array of ids by
numpy, with no Python object per word."""

from __future__ import annotations

import itertools
import os
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlake.llm.store import KEPT, trim

MEMO = 340_000  # distinct pieces a worker keeps; beyond them the half used least is forgotten


class Pieces:
    """Ids of distinct pieces, kept in one array. encode(pieces) gives the pieces in an order of its
    own, their ids one after the other, and the number of ids of each."""

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], most: int = MEMO):
        self.encode, self.most = encode, most
        self.row: dict[str, int] = {}  # pieces in the order of their rows
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count, self.uses = (np.zeros(1 << 14, np.int32) for _ in range(3))

    def _add(self, new: list[str]) -> None:
        order, ids, sizes = self.encode(new)
        first, total = len(self.row), len(ids)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(order) > len(self.start):
            self.start, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.uses))
        self.pool[self.used : self.used + total] = ids
        self.start[first : first + len(order)] = self.used + np.cumsum(sizes) - sizes
        self.count[first : first + len(order)] = sizes
        self.uses[first : first + len(order)] = 0
        self.used += total
        self.row.update(zip(order, range(first, first + len(order)), strict=True))

    def _forget(self) -> None:
        """Keeps the half used most; what a use counts for is halved."""
        n = len(self.row)
        kept = np.zeros(n, bool)
        kept[np.argsort(-self.uses[:n], kind="stable")[: self.most // 2]] = True
        rows = np.flatnonzero(kept)
        ids, ends = self._ids(rows)
        self.pool[: len(ids)], self.used = ids, len(ids)
        self.start[: len(rows)], self.count[: len(rows)] = ends[:-1], self.count[rows]
        self.uses[: len(rows)] = self.uses[rows] // 2
        self.row = {p: k for k, p in enumerate(itertools.compress(self.row, kept.tolist()))}

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The row of each distinct piece; they hold until the next call."""
        found = self._find(pieces)
        new = np.flatnonzero(found < 0)
        if len(new) and self.row and len(self.row) + len(new) > self.most:
            self._forget()
            found = self._find(pieces)
            new = np.flatnonzero(found < 0)
        if len(new):
            some = [pieces[k] for k in new.tolist()]
            self._add(some)
            found[new] = self._find(some)
        return found

    def _find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))

    def _ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[rows]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.start[rows] - ends[:-1], counts) + np.arange(ends[-1])
        return self.pool[at], ends

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of pieces, and where each piece's ids end (with a leading 0)."""
        self.uses[: len(self.row)] += np.bincount(rows, minlength=len(self.row))
        return self._ids(rows)

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """gather of pieces with repeats."""
        flat = pieces.dictionary_encode()
        rows = self.rows(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
        return self.gather(rows[flat.indices.to_numpy()])


#: Classes of bytes. UNSURE are white space beyond ASCII's, what some take for it, and special tokens.
OTHER, SPACE, BLANK, WORD, MARK, QUOTE, UNSURE = range(7)
KINDS = np.zeros(256, np.uint8)
KINDS[9:14], KINDS[28:32], KINDS[32], KINDS[33:127], KINDS[39] = BLANK, UNSURE, SPACE, MARK, QUOTE
KINDS[[*(string.ascii_letters + string.digits).encode()]] = WORD
WIDE = [c.encode() for c in "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000"]
WIDE_KEYS = [int.from_bytes(c.ljust(3, b"\0"), "big") for c in WIDE]
WIDE_LEADS = np.zeros(256, bool)
WIDE_LEADS[[c[0] for c in WIDE]] = True

BEFORE, EARLIER = 1, 2  # cut before the second byte of a pair; before the first


def _rules(*rules: tuple[list[int], list[int], int]) -> np.ndarray:
    table = np.zeros((8, 8), np.uint8)
    for first, second, cut in rules:
        table[np.ix_(first, second)] |= cut
    return table.ravel()


#: A run of letters or digits ends at a mark, and a run of marks at a letter or digit; a quote may begin 's or 'll.
PARTED = [([WORD], [MARK, QUOTE], BEFORE), ([MARK], [WORD], BEFORE)]
TEXT, WHITE = [OTHER, WORD, MARK, QUOTE], [SPACE, BLANK]


def kinds(data: np.ndarray, special: list[bytes]) -> np.ndarray:
    """The class of each byte of UTF-8."""
    out = KINDS[data]
    lead = np.flatnonzero(WIDE_LEADS[data])
    if len(lead):
        one, two, three = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) for k in range(3))
        short = one < 0xE0
        hit = np.isin(one << 16 | two << 8 | np.where(short, 0, three), WIDE_KEYS)
        out[lead[hit]] = out[lead[hit] + 1] = UNSURE
        out[lead[hit & ~short] + 2] = UNSURE
    raw = data.tobytes()
    for token in special:
        at = raw.find(token)
        while at >= 0:
            out[at : at + len(token)] = UNSURE
            at = raw.find(token, at + 1)
    return out


def split(texts: pa.Array, rules: np.ndarray, special: list[bytes], fold: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(pieces, first): the texts cut by the rules, piece by piece; text i's are pieces[first[i]:first[i + 1]].
    Null is empty. fold maps bytes, unless a special token would come about by it."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    if fold is not None:
        folded, raw = fold[data], data.tobytes()
        if all(folded.tobytes().count(token) == raw.count(token) for token in special):
            data = folded
    kind = kinds(data, special)
    act = rules[kind[:-1] << 3 | kind[1:]]
    start = offsets[:-1][np.diff(offsets) > 0]
    act[start[1:] - 1] = 0
    cut = np.zeros(size, bool)
    cut[1:] = act & BEFORE
    cut[:-1] |= act & EARLIER > 0
    cut[start] = True
    at = np.flatnonzero(cut)
    ends = np.append(at, size).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data)), np.searchsorted(at, offsets)


#: Latin letters that stay letters in lower case, and how the vocabulary's splitter cuts a
#: lower-cased word of ASCII and such letters.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9\t-\r ]+")
KNOWN = re.compile(f"[\x00-\x7fA-Z\u00c0-\u00d6\u00d8-\u00de{LETTERS}]+")
WORD_END = "</w>"
LINE = 2000  # pieces encoded as one text

#: ASCII in lower case, its white space as spaces.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32
WORDS = _rules(([*TEXT, UNSURE], WHITE, BEFORE), *PARTED)


class Encoder:
    """A tokenizer of the tokenizers library, and the ids of the pieces it has encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces(self._encode)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes


class WordEncoder(Encoder):
    """A tokenizer that drops white space, never joins text across it, ignores case and marks the
    end of each part.

    Pieces are a word's parts, with the white space before them. New ones of ASCII and Latin letters
    are encoded many to a text: the splitter's parts of a piece are counted, and each part gives one
    id with an end mark, so the ids fall into pieces by the marks. Others, those with a special
    token's string, and lines whose marks don't add up are encoded piece by piece."""

    def __init__(self, path: str):
        super().__init__(path)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for t, i in words.items() if t.endswith(WORD_END)]] = True
        self.held = re.compile("|".join(re.escape(t.decode()) for t in self.special) or "(?!)")

    def _encode(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        plain = [w for w in words if KNOWN.fullmatch(w) and not w.isspace() and not self.held.search(w)]
        known = set(plain)
        order, out, alone = [], [], [w for w in words if w not in known]
        for k in range(0, len(plain), LINE):
            line = plain[k : k + LINE]
            ids, _ = self._ids([" ".join(line)])
            parts = np.cumsum([1 if w.strip().isalpha() else len(PARTS.findall(w.lower())) for w in line])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == parts[-1]:
                order += line
                out.append((ids, np.diff(last[parts - 1], prepend=-1)))
            else:
                alone += line
        order += alone
        out.append(self._ids(alone))
        return order, np.concatenate([a for a, _ in out]), np.concatenate([n for _, n in out])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): text i's ids are ids[ends[i]:ends[i + 1]]; null is empty."""
        pieces, first = split(texts, WORDS, self.special, FOLD)
        ids, upto = self.pieces(pieces)
        return ids, upto[first]


#: White space is cut off before it, and its last character before text is on its own, or goes with
#: the text if it is a space.
BYTES = _rules((TEXT, WHITE, BEFORE), (WHITE, TEXT, EARLIER), ([BLANK], TEXT, BEFORE), *PARTED)
PLAIN = re.compile(r" ?[^\s\u180e]+")


class ByteEncoder(Encoder):
    """A byte-level tokenizer whose splitter cuts by the rules of BYTES, whatever stands around.

    New pieces without white space but the leading space are encoded many to a text, as lines: a
    line end is a token of its own between them. Others, and lines that don't add up, go one by one."""

    def __init__(self, path: str):
        super().__init__(path)
        line = self._ids(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else None

    def _encode(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        plain = [p for p in pieces if PLAIN.fullmatch(p)] if self.line is not None else []
        known = set(plain) if len(plain) < len(pieces) else None
        order, out, alone = [], [], [p for p in pieces if p not in known] if known is not None else []
        for i in range(0, len(plain), LINE):
            some = plain[i : i + LINE]
            ids, _ = self._ids(["\n".join(some)])
            cut = np.flatnonzero(ids == self.line)
            if len(cut) == len(some) - 1:
                order += some
                out.append((np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1))
            else:
                alone += some
        order += alone
        out.append(self._ids(alone))
        return order, np.concatenate([a for a, _ in out]), np.concatenate([n for _, n in out])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, stops): text i's ids are ids[starts[i]:stops[i]]; null is empty."""
        pieces, first = split(texts, BYTES, self.special)
        ids, upto = self.pieces(pieces)
        ends = upto[first]
        return ids, ends[:-1], ends[1:]


_ENCODERS: dict[tuple, WordEncoder | ByteEncoder] = {}


def forget() -> None:
    """Drops this worker's encoders and gives their memory back."""
    if _ENCODERS:
        _ENCODERS.clear()
        trim()


KEPT.append(forget)


def _kept(kind: type, path: str, most: int) -> WordEncoder | ByteEncoder:
    """One per worker process and vocabulary; it keeps `most` pieces from now on."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    _ENCODERS[kind, path].pieces.most = most
    return _ENCODERS[kind, path]


def word_encoder(path: str, most: int = MEMO) -> WordEncoder:
    return _kept(WordEncoder, path, most)


def byte_encoder(path: str, most: int = MEMO) -> ByteEncoder:
    return _kept(ByteEncoder, path, most)
