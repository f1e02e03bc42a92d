"""Near-duplicate documents by HyperMinHash registers, banding and exact confirmation.

A document is its set of distinct word shingles (52-bit hashes). Each of REPEATS hash draws deals
the set over BUCKETS buckets and keeps per bucket the smallest hash as a 16-bit register: leading
zeros and MANTISSA bits. Four registers make a band, a 64-bit key. Exact copies of a set meet by
digest first and only their smallest doc_id goes on. In a band's bucket every member is paired
with two leaders; after components are known, buckets that still hold several components compare
the members outside their largest component with all members, in blocks of BLOCK, so no link that
the bands show is lost and no bucket is gathered whole. The collision-corrected Jaccard estimate
drops pairs far below the threshold; every link is confirmed on full sets.

Nulls and edge cases: null or empty text is an empty set, linked with nothing; fewer words than a
shingle make one shingle; a null doc_id is linked with nothing and kept; repeated rows of one
doc_id are one node and each returned; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import SLICE, slices
from ledgerlake.llm.components import components
from ledgerlake.llm.store import join_counted, lean, stored
from ledgerlake.llm.words import grams, mixed, owners, tokens, word_hashes

REPEATS, BUCKETS, MANTISSA = 16, 8, 10
BANDS = REPEATS * BUCKETS // 4
REGISTERS = REPEATS * BUCKETS
CHANCE = 0.17 / (1 << MANTISSA)  # expected share of registers that agree by chance
SLACK = 4.5  # standard errors of the estimate that a pair may fall short by
SMALL = 64  # sets below this size are confirmed without an estimate
BLOCK = 512
HASH_BITS = 52


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): each text's distinct shingle hashes, ascending."""
    codes, ends, words = tokens(texts, lower=True)
    values = word_hashes(words)[codes] if words else np.zeros(0, np.uint64)
    count = np.diff(ends)
    padded = np.concatenate([values, np.zeros(n, np.uint64)])
    all_runs = grams(padded, n)[: len(values)]
    owner = owners(ends)
    whole = np.arange(len(values)) + n <= ends[owner + 1]
    hashes, owner = all_runs[whole], owner[whole]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):  # the whole sequence is one shingle
        short = [grams(values[ends[i] : ends[i + 1]], int(count[i]))[0] + np.uint64(count[i]) for i in few]
        hashes, owner = np.concatenate([hashes, np.array(short, np.uint64)]), np.concatenate([owner, few])
    hashes = hashes >> np.uint64(64 - HASH_BITS)
    texts_n = len(ends) - 1
    if texts_n <= 1 << (64 - HASH_BITS):
        key = np.unique((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | hashes)
        hashes, owner = key & np.uint64((1 << HASH_BITS) - 1), (key >> np.uint64(HASH_BITS)).astype(np.int64)
    else:
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, bool)
        hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(texts_n + 1))


def registers(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) of uint16; 0 is an empty bucket."""
    n = len(ends) - 1
    owner = owners(ends) * BUCKETS
    out = np.zeros((n, REPEATS, BUCKETS), np.uint16)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for r in range(REPEATS):
        with np.errstate(over="ignore"):
            z = mixed(hashes * np.uint64(2 * (r * 0x5851F42D4C957F2D % (1 << 63)) + 1) + np.uint64(r * 7919 + 1))
        least = np.full(n * BUCKETS, none)
        np.minimum.at(least, owner + (z >> np.uint64(61)).astype(np.int64), z & np.uint64((1 << 61) - 1))
        part, power = np.frexp(least.astype(np.float64))
        mantissa = ((part - 0.5) * (2 << MANTISSA)).astype(np.int64)
        value = np.where(least == none, 0, ((61 - np.minimum(power, 61)) << MANTISSA) + np.clip(mantissa, 0, (1 << MANTISSA) - 1) + 1)
        out[:, r, :] = value.reshape(n, BUCKETS)
    return out.reshape(n, REGISTERS)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest, bands (the registers, four to a long) of each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, "text", SLICE):
            hashes, ends = shingle_sets(b.column("text"), n)
            bands = registers(hashes, ends).view(np.int64)
            digests = [xxhash.xxh3_128_digest(hashes[a:z].tobytes()) for a, z in zip(ends, ends[1:], strict=False)]
            flat = pa.array(bands.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(ends)), pa.array(digests, pa.binary()), lists],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(sketch), "doc_id long, n_shingles long, digest binary, bands array<long>")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            hashes, ends = shingle_sets(b.column("text"), n)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "items"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(build), "doc_id long, items array<long>")


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates and the number of registers behind each, over the last axis."""
    used = ((a | b) != 0).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    return (same / np.maximum(used, 1) - CHANCE) / (1 - CHANCE), used


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    """Whether sets of sizes na, nb with registers a, b may reach similarity t."""
    j, used = estimate(a, b)
    close = j >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1))
    return (np.minimum(na, nb) >= t * np.maximum(na, nb)) & (close | (np.minimum(na, nb) < SMALL))


def matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, BANDS).view(np.uint16)


def confirmed(docs: DataFrame, pairs: DataFrame, n: int, t: float) -> DataFrame:
    """Those of pairs(a, b) whose full sets have Jaccard similarity t or more."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    sets = stored(sets_of(join_counted(docs.select("doc_id", "text"), ids, ["doc_id"], "left_semi"), n), "pair-sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = round(t * 100)
        for b in batches:
            x, y = b.column("x"), b.column("y")
            xv, xe, yv, ye = x.values.to_numpy(), x.offsets.to_numpy(), y.values.to_numpy(), y.offsets.to_numpy()
            ok = []
            for i in range(b.num_rows):
                p, q = xv[xe[i] : xe[i + 1]], yv[ye[i] : ye[i + 1]]
                common = len(p) + len(q) - len(np.union1d(p, q))
                ok.append(common > 0 and 100 * common >= need * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    both = pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y")
    return stored(both.mapInArrow(lean(share), "a long, b long").distinct(), "links")


def star_pairs(crowd: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    """Members paired with their buckets' two leaders, where the registers allow a link."""
    pairs = crowd.select(F.explode(F.array("first", "other")).alias("lead"), "rep").filter("lead <> rep")
    pairs = pairs.select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct()
    one = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("bands").alias("ra"))
    two = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("bands").alias("rb"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = likely(matrix(x.column("ra")), matrix(x.column("rb")), x.column("na").to_numpy(), x.column("nb").to_numpy(), t)
            yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(ok)), x.column("b").filter(pa.array(ok))], ["a", "b"])

    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "ra", "rb")
    return stored(joined.mapInArrow(lean(near), "a long, b long").distinct(), "star-pairs")


def overlaps(one: np.ndarray, items: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of `one` (ascending) each of the sets items[ends[i]:ends[i + 1]] (none empty) holds."""
    at = np.minimum(np.searchsorted(one, items), len(one) - 1)
    return np.add.reduceat((one[at] == items).astype(np.int64), ends[:-1]) if len(ends) > 1 else np.zeros(0, np.int64)


def cross_pairs(docs: DataFrame, crowd: DataFrame, reps: DataFrame, roots: DataFrame, shingle: int, t: float) -> DataFrame:
    """Pairs across components in buckets that hold several: members outside a bucket's largest
    component against all its members, block by block, each pair in its first common band only.
    A pair leaves its block when the estimate and the sets, cut to 32-bit hashes, both allow a
    link, so a family of almost-copies doesn't spread all its pairs."""
    placed = crowd.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "band", "key", "rep", F.coalesce("root", "rep").alias("root"))
    sizes = placed.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
    mixed_up = sizes.groupBy("band", "key").agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds"), F.max("n").alias("top"), F.max_by("root", F.struct("n", "root")).alias("main"),
    ).filter("kinds > 1")
    mixed_up = stored(mixed_up.select("band", "key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
                                      F.ceil((F.col("n") - F.col("top")) / BLOCK).cast("int").alias("few")), "mixed-buckets")
    rows = join_counted(placed, mixed_up, ["band", "key"], "inner")
    every = rows.withColumn("j", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("few") - 1))).withColumn("side", F.lit(0))
    some = rows.filter("root <> main").withColumn("i", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("few")).cast("int")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    cols = ["band", "key", "i", "j", "side", "rep", "root"]
    ids = stored(rows.select(F.col("rep").alias("doc_id")).distinct(), "mixed-ids")
    short = F.transform("items", lambda x: F.shiftright(x, HASH_BITS - 32).cast("long") - (1 << 31))
    sets = sets_of(join_counted(docs, ids, ["doc_id"], "left_semi"), shingle).select(
        F.col("doc_id").alias("rep"), short.cast("array<int>").alias("items")).dropDuplicates(["rep"])
    sides = every.select(cols).unionByName(some.select(cols)).join(reps.join(sets, "rep"), "rep")

    def compare(key: tuple, g: pa.Table) -> pa.Table:
        g = g.combine_chunks()
        band, side = key[0].as_py(), g.column("side").to_numpy()
        rep, root, n = (g.column(c).to_numpy() for c in ("rep", "root", "n_shingles"))
        reg = matrix(g.column("bands").combine_chunks())
        bands = reg.view(np.int64)
        lists = g.column("items").combine_chunks()
        items, ends = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        size = np.diff(ends)
        a_out, b_out = [], []
        all_rows = np.flatnonzero(side == 0)
        for k in np.flatnonzero(side == 1):
            at = all_rows[root[all_rows] != root[k]]
            if not len(at):
                continue
            shared = (bands[at] == bands[k]) & (bands[k] != 0)
            at = at[shared.argmax(-1) == band]
            at = at[likely(reg[at], reg[k], n[at], np.full(len(at), n[k]), t)]
            if not len(at):
                continue
            mine = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in at])
            common = overlaps(items[ends[k] : ends[k + 1]], items[mine], np.concatenate([[0], np.cumsum(size[at])]))
            # Cutting hashes can only join elements, by a few in a set: two more or less decide nothing.
            at = at[common + 2 >= t * (size[at] + size[k] - common - 2)]
            a_out.append(np.minimum(rep[at], rep[k]))
            b_out.append(np.maximum(rep[at], rep[k]))
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": join(a_out), "b": join(b_out)})

    out = sides.groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long")
    return stored(out.distinct(), "cross-pairs")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = stored(sketches(docs, shingle), "sketches")
    full = drawn.filter("n_shingles > 0 and doc_id is not null")
    copies = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = stored(full.select("doc_id", "digest").join(copies, "digest").select("doc_id", "rep").distinct(), "members")
    reps = full.join(members.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("rep"), "n_shingles", "bands").dropDuplicates(["rep"])
    reps = stored(reps, "representatives")
    rows = reps.select("rep", F.posexplode("bands").alias("band", "key")).filter("key <> 0")
    order = F.xxhash64("rep", "band")
    leaders = rows.groupBy("band", "key").agg(
        F.min("rep").alias("first"), F.min(order).alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    crowd = rows.join(leaders, ["band", "key"])
    # The second leader is the member whose hash is lowest; rows of a bucket learn its id by a second join.
    others = crowd.filter(order == F.col("low")).groupBy("band", "key").agg(F.min("rep").alias("other"))
    crowd = stored(crowd.drop("low").join(others, ["band", "key"]), "crowded-buckets")
    links = confirmed(docs, star_pairs(crowd, reps, threshold), shingle, threshold)
    roots = stored(components(links), "first-roots")
    more = cross_pairs(docs, crowd, reps, roots, shingle, threshold)
    if not more.isEmpty():
        links = links.unionByName(confirmed(docs, more, shingle, threshold))
        roots = stored(components(links), "roots")
    of_member = members.filter("doc_id is not null").join(roots, members.rep == roots.node, "left").select(
        "doc_id", F.coalesce("root", "rep").alias("component_id"))
    out = drawn.select("doc_id", "n_shingles").join(of_member, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def oracle(threshold: int = 80) -> str:
    """Two-word shingles as DuckDB SQL over documents: every pair that shares a shingle is counted."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'),
             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)),
             lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {threshold} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON w.doc_id = c.doc_id LEFT JOIN n ON w.doc_id = n.doc_id"""
