"""White-space words of Arrow text columns as numpy codes: no Python object per word, only per distinct word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, ends, words): text i's words [^\\x20\\x09-\\x0D]+ are words[c] for c in
    codes[ends[i]:ends[i + 1]]. Null is empty; lower turns A-Z to a-z and nothing else."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    codes, words = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    ends -= ends[0]
    if "" in words:  # white space at either end of a text
        keep = codes != words.index("")
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return codes, ends, words


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str], seed: int = 0) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values; the run at i is values[i:i + n], order counts."""
    m = max(0, len(values) - n + 1)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * MIX + values[j : j + m]
        return mixed(out)


def owners(ends: np.ndarray) -> np.ndarray:
    """The text each word belongs to."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))
