"""Plain single-process versions of the contracts, for small tables."""

import hashlib
import re
import zlib

import numpy as np


def license_row(text):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def luhn(d):
    n = [int(c) for c in reversed(d)]
    return sum(n[::2]) % 10 == (-sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10


def pii_base(text):
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m[0])] for k, p, ok in kinds}
    joined = ",".join(s for k in spans for s in spans[k])
    return [len(spans[k]) for k in spans], hashlib.sha256(joined.encode()).hexdigest(), spans


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def near_groups(docs, n, threshold=80):
    """{doc_id: (set size, component)} of (doc_id, text) pairs."""
    sets = {}
    for d, t in docs:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 >= threshold * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= threshold * (len(x) + len(y) - common):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def cut_repeats(docs, window=20):
    """{doc_id: (words, removed, sha256 of kept)}; rows of one doc_id must be equal."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    seen, out = set(), {}
    for d in sorted(words, key=lambda x: (x is not None, x)):
        w, gone = words[d], set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def nearest(rows, k, every=50):
    """{query id: [(id, cosine)]} by brute force over (id, vector)."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.asarray(v, np.float64)
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids]) if len(ids) else np.zeros((0, 1))
    size = np.sqrt((x * x).sum(-1))
    out = {}
    for q in ids[ids % every == 0]:
        s = (x * good[q]).sum(-1) / (size * np.sqrt((good[q] ** 2).sum()))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def in_order(item, words):
    """Longest common subsequence of two word lists, by the textbook table."""
    row = [0] * (len(words) + 1)
    for a in item:
        prev = 0
        for j, b in enumerate(words, 1):
            prev, row[j] = row[j], prev + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]
