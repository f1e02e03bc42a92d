import collections
import hashlib
import random
import zlib

import numpy as np

from ledgerlake.llm import prefix_trie as P


def brute(rows):
    """The contract over (conv_id, turn, role, text); equal turns in order of role, then of the turn's digest."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in turns.items()}
    seqs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seqs[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda k, m: hashlib.sha256(",".join(str(c) for c in m if seqs[c] == k).encode()).hexdigest()
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(k, m))
                   for k, m in members.items()), key=str)


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, depth int")
    return sorted(map(tuple, P.trie(df.repartition(parts), **kw).collect()), key=str)


def table(seed, convs, texts, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        twin = rng.choice([None, None, 0, 1])
        turns = random.Random(twin if twin is not None else 100 + c)
        rows += [(c, t, turns.choice(["user", "bot"]), turns.choice(texts)) for t in range(turns.randint(0, longest))]
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 3)
    monkeypatch.setattr(P, "RUN", 2)
    monkeypatch.setattr(P, "HOT", 5)
    for seed, longest in ((1, 4), (2, 12)):
        rows = table(seed, 60, ["a", "b", "ünï", ""], longest)
        assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "a", "tie"), (1, 0, "a", "tie"), (1, 0, "b", None),
            (-7, 3, "u", "negative"), (-5, 1, "u", "base of -7"), (-5, -2, "u", "early"), (12, 5, "u", "no base"),
            (2**62, 0, "u", "large"), (5, 0, "x" * 3000, "y" * 100000), (6, 1, "x", "same"), (6, 1, "x", "same"), (10, 0, "u", ":1"), (11, 0, "u:", "1")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "u", "t")]) == []


def test_a_hot_conversation_and_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 32)
    rows = [(7, t, "user", f"turn {t % 3}") for t in range(240)] + [(c, t, "user", f"turn {t % 3}") for c in range(40, 90) for t in range(4)]
    assert run(spark, rows, 5) == brute(rows)


def test_collisions_are_found_and_drawn_again(spark):
    """With the base 1 the order of turns doesn't matter to a fingerprint: nodes that aren't sound show, other bases are drawn."""
    rows = [(c, t, "user", x) for c, text in ((0, "abc"), (5, "acb"), (10, "abc"), (15, "bca")) for t, x in enumerate(text * 4)]
    seeds = []

    def draw(seed):
        seeds.append(seed)
        return [1] * P.LANES if seed == 0 else P.bases(seed)

    assert run(spark, rows, draw=draw) == brute(rows)
    assert 1 in seeds


def test_powers(spark):
    assert P.powers(7, 40).tolist() == [pow(7, k, P.PRIME) for k in range(40)]
    es = [0, 1, 5, -1, -12345678901, 2**40, P.PRIME - 1, P.PRIME]
    got = spark.createDataFrame([(e,) for e in es], "e long").select(P.power(123457, P.F.col("e")).alias("p")).collect()
    assert [r.p for r in got] == [pow(123457, e % (P.PRIME - 1), P.PRIME) for e in es]
    assert np.all(np.array(P.bases(3)) > 1)
