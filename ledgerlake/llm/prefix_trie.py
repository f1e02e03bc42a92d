"""The trie of rebuilt conversations, from fingerprints that compose.

A turn's element is its digest; the fingerprint of a run of turns is (length, sum of element times
base to the place) modulo a prime, in LANES bases, and runs compose: (n, x)(m, y) is
(n + m, x + base^n y). One range sort of the turns gives every turn the fingerprint of all turns
before it; partitions are composed from one row each. A rebuilt conversation is its base's head
and its own suffix, both runs of stored turns, so the fingerprint of each of its prefixes is a
linear expression of stored ones and no text is rebuilt or moved.

Equal (depth, fingerprint) is a node. Every member refers to a stored turn and to its parent's
fingerprint: a node holds if the full digests of its members' turns agree and their parents do,
which by induction makes its prefixes equal; if one fails, the whole is run with other bases.
A value summed over a subtree is put on the smallest member's path (a node's smallest member is
the smallest member of every deeper node of its own), summed from the end of each conversation,
and added up per node: a fixed number of passes, however deep the trie is.

Hot conversations, nodes and parents: turns of one conversation are spread by the range sort and
joined by runs of CHUNK places; nodes are aggregates with partial sums; parents with more than a
HOT-th of all nodes as children, at most HOT of them, are broadcast; the ids that end at a node
are joined to texts of RUN ids by a range sort before one task hashes them in a stream.

Nulls and edge cases: rows without a conv_id take no part; null turns come first, equal turns in
order of role and digest; null role or text is empty; repeated rows are turns of their own; a
conversation without turns in the table isn't one; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.store import stored

PRIME = (1 << 31) - 1
LANES, WORDS, DIGITS = 4, 4, 15  # lanes of a fingerprint, words of a digest, hex digits of a word
HEADS = 9  # heads are shorter
FAMILY = 5
CHUNK, RUN, HOT = 4096, 1000, 10_000
KEY = ["depth", "f1", "f2"]


def bases(seed: int) -> list[int]:
    draw = random.Random(seed)
    return [draw.randrange(1 << 20, PRIME - 1) for _ in range(LANES)]


def power(base: int, exponent: Column) -> Column:
    """base ** exponent modulo PRIME, for any integer exponent."""
    table = F.array(*[F.lit(pow(base, 1 << k, PRIME)) for k in range(31)])
    e = F.pmod(exponent, F.lit(PRIME - 1))
    step = lambda acc, k: F.when(F.expr("1L").bitwiseAND(F.call_function("shiftright", e, k)) == 1,
                                 acc * F.get(table, k) % PRIME).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.lit(1).cast("long"), step)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo PRIME."""
    out = np.ones(max(1, n), np.int64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * pow(base, done, PRIME) % PRIME
        done += more
    return out[:n]


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, bytes and digest words of every turn, in order of (conv_id, turn) over range partitions."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.octet_length(text).cast("long").alias("bytes"), digest.alias("digest"),
        F.monotonically_increasing_id().alias("row"))
    words = [F.conv(F.substring("digest", 1 + DIGITS * k, DIGITS), 16, 10).cast("long").alias(f"t{k}") for k in range(WORDS)]
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "row"]  # row parts equal turns of a hot conversation
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "bytes", *words)


def scanned(turns: DataFrame, base: list[int]) -> DataFrame:
    """turns with part, nth (place in it), run (turns of the conversation before it in the part),
    opening (of the part's first conversation), and the part's fingerprint up to and with (g) and
    without (x) the turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, conv, held, opening = TaskContext.get().partitionId(), 0, None, 0, None
        sums = [0] * LANES
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids = b.column("conv_id").to_numpy()
            opening = ids[0] if opening is None else opening
            new = np.flatnonzero(np.concatenate([[ids[0] != conv], ids[1:] != ids[:-1]]))
            start = np.full(n, -held)  # where the row's conversation begins, from this batch's first row
            if len(new):
                start[new[0] :] = np.repeat(new, np.diff([*new, n]))
            place = np.arange(n) - start
            conv, held = ids[-1], int(place[-1]) + 1
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(place), pa.array(ids == opening)]
            for k in range(LANES):
                terms = b.column(f"t{k}").to_numpy() % PRIME * powers(base[k], n) % PRIME
                upto = (np.cumsum(terms) % PRIME * pow(base[k], at, PRIME) + sums[k]) % PRIME
                before = np.concatenate([[sums[k]], upto[:-1]])
                sums[k] = int(upto[-1])
                columns += [pa.array(upto.astype(np.int32)), pa.array(before.astype(np.int32))]
            at += n
            names = ["part", "nth", "run", "opening", *[f"{c}{k}" for k in range(LANES) for c in "gx"]]
            yield pa.RecordBatch.from_arrays([*columns, *b.columns], [*names, *b.schema.names])

    lanes = ", ".join(f"g{k} int, x{k} int" for k in range(LANES))
    words = ", ".join(f"t{k} long" for k in range(WORDS))
    return turns.mapInArrow(run, f"part int, nth long, run long, opening boolean, {lanes}, conv_id long, bytes long, {words}")


def placed(parts: DataFrame, base: list[int]) -> DataFrame:
    """Turns with at (place in the table), i (place in the conversation), g and x over all parts."""
    ends = parts.groupBy("part").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("low"), F.max("conv_id").alias("high"), F.max_by("run", "nth").alias("run"),
        *[F.max_by(f"g{k}", "nth").alias(f"g{k}") for k in range(LANES)]).orderBy("part").collect()  # one row a partition
    rows, before, conv, held, sums = [], 0, None, 0, [0] * LANES
    for e in ends:
        carried = held if e.low == conv else 0
        rows.append((e.part, before, carried, *sums, *[pow(b, before, PRIME) for b in base]))
        sums = [(s + pow(b, before, PRIME) * e[f"g{k}"]) % PRIME for k, (s, b) in enumerate(zip(sums, base, strict=True))]
        held = e.run + 1 + (carried if e.low == e.high else 0)
        before, conv = before + e.n, e.high
    lanes = ", ".join([f"s{k} long" for k in range(LANES)] + [f"b{k} long" for k in range(LANES)])
    starts = parts.sparkSession.createDataFrame(rows, f"part int, before long, carried long, {lanes}")
    joined = parts.join(F.broadcast(starts), "part")
    whole = [((F.col(f"s{k}") + F.col(f"b{k}") * F.col(f"{c}{k}")) % PRIME).alias(f"{c}{k}") for k in range(LANES) for c in "gx"]
    i = F.col("run") + F.when(F.col("opening"), F.col("carried")).otherwise(0)
    return joined.select("conv_id", (F.col("before") + F.col("nth")).alias("at"), i.alias("i"), "bytes", *[f"t{k}" for k in range(WORDS)], *whole)


def packed(lanes: list[Column], names: tuple[str, str]) -> list[Column]:
    """Four lanes as two longs."""
    return [(F.shiftleft(lanes[j].cast("long"), 31) + lanes[j + 1]).alias(n) for j, n in zip((0, 2), names, strict=True)]


def rebuilt(turns: DataFrame, base: list[int]) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: conv_id, KEY, p1 and p2 (its parent's
    fingerprint), the bytes and digest words of its last turn, and whether it is all of it."""
    col = F.col
    lane = range(LANES)
    length = F.crc32(col("conv_id").cast("string").cast("binary")) % HEADS
    turns = turns.withColumn("h", length)
    kept = F.struct("i", "bytes", *[f"t{k}" for k in range(WORDS)], *[f"{c}{k}" for k in lane for c in "gx"])
    convs = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.min("h").alias("h"), F.min(col("at") - col("i")).alias("first"),
        *[F.max(F.when(col("i") == 0, col(f"x{k}"))).alias(f"x{k}") for k in lane],
        *[F.max(F.when(col("i") == col("h"), col(f"x{k}"))).alias(f"y{k}") for k in lane],
        F.array_sort(F.collect_list(F.when((col("conv_id") % FAMILY == 0) & (col("i") < HEADS - 1), kept))).alias("head"))
    convs = stored(convs, "trie-conversations")
    family = convs.filter(col("conv_id") % FAMILY == 0).select(
        col("conv_id").alias("base"), col("n").alias("base_n"), col("first").alias("base_first"), "head", *[col(f"x{k}").alias(f"z{k}") for k in lane])
    info = convs.drop("head").withColumn("base", col("conv_id") - col("conv_id") % FAMILY).join(family, "base", "left")
    info = info.withColumn("hb", F.least(col("h"), F.coalesce("base_n", F.lit(0))).cast("int"))
    own = F.greatest(col("n") - col("h"), F.lit(0))
    # a head's fingerprint: its turns' share of the table's, moved to place 0
    info = info.withColumns({f"m{k}": power(base[k], -col("base_first")) for k in lane})
    at_hb = lambda k: F.when(col("hb") > 0, F.pmod(F.get(col("head"), col("hb") - 1)[f"g{k}"] - col(f"z{k}"), F.lit(PRIME)) * col(f"m{k}") % PRIME).otherwise(0)
    info = info.withColumns({f"e{k}": at_hb(k) for k in lane})
    info = stored(info.withColumn("own", own), "trie-heads")

    words = [f"t{k}" for k in range(WORDS)]
    out = ["conv_id", "depth", "f1", "f2", "p1", "p2", "bytes", *words, "last"]
    top = [F.lit(0).cast("long").alias(c) for c in ("f1", "f2", "p1", "p2", "bytes", *words)]
    roots = info.select("conv_id", F.lit(0).cast("long").alias("depth"), *top, (col("hb") + col("own") == 0).alias("last"))
    heads = info.filter("hb > 0").withColumn("t", F.explode(F.slice("head", F.lit(1), col("hb"))))
    moved = lambda c, k: F.pmod(col(f"t.{c}{k}") - col(f"z{k}"), F.lit(PRIME)) * col(f"m{k}") % PRIME
    heads = heads.select(
        "conv_id", (col("t.i") + 1).alias("depth"), *packed([moved("g", k) for k in lane], ("f1", "f2")),
        *packed([moved("x", k) for k in lane], ("p1", "p2")), "t.bytes", *[f"t.{w}" for w in words],
        ((col("t.i") + 1 == col("hb")) & (col("own") == 0)).alias("last"))
    # own turns: (head's fingerprint - moved start) + moved, by runs of CHUNK places of a conversation
    shift = info.filter("own > 0").select("conv_id", "n", "hb", *[f"e{k}" for k in lane], *[f"y{k}" for k in lane], *[
        power(base[k], col("hb") - col("first") - col("h")).alias(f"m{k}") for k in lane])
    shift = shift.select("conv_id", "n", "hb", *[f"m{k}" for k in lane], *[
        F.pmod(col(f"e{k}") - col(f"y{k}") * col(f"m{k}") % PRIME, F.lit(PRIME)).alias(f"e{k}") for k in lane],
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((col("n") - 1) / CHUNK))).alias("chunk"))
    mine = turns.filter("i >= h").withColumn("chunk", F.floor(col("i") / CHUNK)).join(shift, ["conv_id", "chunk"])
    value = lambda c, k: (col(f"e{k}") + col(f"m{k}") * col(f"{c}{k}")) % PRIME
    mine = mine.select(
        "conv_id", (col("hb") + col("i") - col("h") + 1).alias("depth"), *packed([value("g", k) for k in lane], ("f1", "f2")),
        *packed([value("x", k) for k in lane], ("p1", "p2")), "bytes", *words, (col("i") == col("n") - 1).alias("last"))
    return roots.select(out).unionByName(heads.select(out)).unionByName(mine.select(out))


def nodes(rows: DataFrame) -> DataFrame:
    """KEY, first (smallest member), n_convs, bytes, p1, p2, and sound: members agree on their last
    turn's digest and on the parent."""
    same = ["p1", "p2", "bytes", *[f"t{k}" for k in range(WORDS)]]
    found = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("first"),
                                   *[f(c).alias(f"{n}_{c}") for c in same for f, n in ((F.min, "lo"), (F.max, "hi"))])
    sound = F.lit(True)
    for c in same:
        sound = sound & (F.col(f"lo_{c}") == F.col(f"hi_{c}"))
    return found.select(*KEY, "first", "n_convs", *[F.col(f"lo_{c}").alias(c) for c in ("p1", "p2", "bytes")], sound.alias("sound"))


def above(rows: DataFrame) -> DataFrame:
    """The parent's KEY in place of a node's."""
    return rows.filter("depth > 0").withColumns({"depth": F.col("depth") - 1, "f1": F.col("p1"), "f2": F.col("p2")})


def subtree_sums(rows: DataFrame, trie: DataFrame) -> DataFrame:
    """KEY, n_leaves, saved_tokens of the nodes with several members; the others are 1 and 0."""
    mark = trie.select(F.col("first").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("w"),
                       (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = rows.select("conv_id", *KEY).join(mark, ["conv_id", "depth"], "left")
    path = stored(path.withColumn("chunk", F.floor(F.col("depth") / CHUNK)), "trie-paths")
    chunks = path.groupBy("conv_id", "chunk").agg(F.sum("w").alias("w"), F.max("leaf").alias("leaf"))
    later = Window.partitionBy("conv_id").orderBy(F.col("chunk").desc())
    chunks = chunks.select("conv_id", "chunk", F.coalesce(F.sum("w").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("after"),
                           F.max("leaf").over(Window.partitionBy("conv_id")).alias("ends"))
    below = Window.partitionBy("conv_id", "chunk").orderBy(F.col("depth").desc())
    here = path.withColumn("here", F.coalesce(F.sum("w").over(below), F.lit(0))).filter("n_convs is null or n_convs > 1")
    here = here.join(chunks, ["conv_id", "chunk"])
    return here.groupBy(*KEY).agg(F.sum(F.coalesce("ends", F.lit(0))).alias("n_leaves"), F.sum(F.col("here") + F.col("after")).alias("saved_tokens"))


def end_digests(rows: DataFrame) -> DataFrame:
    """KEY, ends_sha256 of the nodes at which conversations end: the ids, ascending and comma-joined,
    first as texts of at most RUN ids of a node, then hashed node by node in a stream."""
    key = "depth long, f1 long, f2 long"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ids = np.stack([b.column(c).to_numpy() for c in KEY], 1), b.column("conv_id").to_pylist()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(ids)]
            some = [(z, min(z + RUN, e)) for s, e in zip(cuts, cuts[1:], strict=False) for z in range(s, e, RUN)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(at[[a for a, _ in some], k]) for k in range(3)], pa.array([ids[a] for a, _ in some], pa.int64()),
                 pa.array([",".join(map(str, ids[a:z])) for a, z in some], pa.string())], [*KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in node], pa.array([state.hexdigest()])], [*KEY, "ends_sha256"])

        for b in batches:
            out = []
            for *now, text in zip(*[b.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
                if now == node:
                    state.update(b"," + text.encode())
                else:
                    out += [row()] if node else []
                    node, state = now, hashlib.sha256(text.encode())
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else []
        if node:
            yield row()

    ends = rows.filter("last").select(*KEY, "conv_id")
    texts = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(runs, f"{key}, first long, ids string")
    whole = texts.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return whole.mapInArrow(digest, f"{key}, ends_sha256 string")


def with_parents(trie: DataFrame) -> DataFrame:
    """trie with parent_conv_id. Parents of more than a HOT-th of all nodes are broadcast, at most HOT rows."""
    bar = max(1, trie.count() // HOT)
    parents = trie.filter("n_children > 0").select(*[F.col(c).alias(f"p{c}") for c in KEY], F.col("first").alias("parent_conv_id"), "n_children")
    child = trie.withColumns({"pdepth": F.col("depth") - 1, "pf1": F.col("p1"), "pf2": F.col("p2")})
    on = [f"p{c}" for c in KEY]
    hot = stored(parents.filter(F.col("n_children") > bar).drop("n_children"), "trie-hot-parents")
    cold = parents.filter(F.col("n_children") <= bar).drop("n_children")
    many = child.join(F.broadcast(hot), on)
    few = child.filter("depth > 0").join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    top = child.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return many.unionByName(few).unionByName(top).drop(*on)


def trie(conversations: DataFrame, seed: int = 0, draw: Callable[[int], list[int]] = bases) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    turns = stored(sorted_turns(conversations).transform(scanned, draw(seed)), "trie-turns")
    rows = stored(rebuilt(placed(turns, draw(seed)), draw(seed)), "trie-prefixes")
    found = stored(nodes(rows), "trie-nodes")
    if not found.filter("not sound").isEmpty():
        return trie(conversations, seed + 1, draw)
    children = above(found).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    found = found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    found = stored(found.drop("sound"), "trie")
    whole = with_parents(found).join(subtree_sums(rows, found), KEY, "left").join(end_digests(rows), KEY, "left")
    return whole.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def oracle() -> str:
    """DuckDB SQL; crc32 of a decimal conv_id byte by byte, bit by bit. Ties of a turn in order of role and text."""
    crc = """xor(list_reduce(list_transform(range(1, strlen(s) + 1), lambda k: ord(s[k])::BIGINT),
             lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)),
             4294967295::BIGINT), 4294967295)"""
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, conv_id::VARCHAR AS s, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, {crc} % {HEADS} AS h FROM l),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS seq
  FROM h AS c LEFT JOIN h AS b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
p AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM r),
n AS (
  SELECT depth, seq[1:depth] AS key, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth) AS ends
  FROM p GROUP BY depth, key),
k AS (SELECT depth - 1 AS depth, key[1:depth - 1] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN n.depth > 0 THEN (n_convs - 1) * strlen(n.key[n.depth].t) ELSE 0 END AS w
  FROM n LEFT JOIN k ON n.depth = k.depth AND n.key = k.key),
u AS (SELECT unnest(range(0, depth + 1)) AS depth, key AS path, w, n_children = 0 AS leaf FROM v),
s AS (SELECT depth, path[1:depth] AS key, sum(w) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM u GROUP BY ALL)
SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON v.depth = s.depth AND v.key = s.key
LEFT JOIN n AS o ON v.depth > 0 AND o.depth = v.depth - 1 AND o.key = v.key[1:v.depth - 1]"""
