"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame operations only, row by row, without a shuffle. A pattern's matches and the gaps
between them (split by the same pattern) give every position in one pass; prefix sums in blocks
of 64 keep a document with many matches linear. Patterns avoid repeated groups, whose matching
recurses on long runs: a first replacement turns a dot between label characters (or a single
separator between digits) into a noncharacter, after which one character class covers the run.

Base kinds (email, ip, card, phone) are kept whenever their validator passes. The method's own
kinds (iban by mod-97, ssn, secret) need a score of ACCEPT, which context words can raise.

Nulls and edge cases: null text is empty and has no spans; null or repeated doc_id rows are
each scanned alone; other columns stay outside scan()'s result and pass through redact().
Noncharacters U+FDD0 to U+FDD2 count as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.store import pinned

DOT, SPACE, DASH = "\ufdd0", "\ufdd1", "\ufdd2"
BLOCK, NEAR, ACCEPT, BOOST = 64, 40, 0.6, 0.3


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def ip_parts(x: Column) -> Column:
    """Every part at most 255, leading zeros aside."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).try_cast("int") <= 255))


def luhn(x: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(digits(x))
    value = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)), F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, value(i)).otherwise(doubled(value(i))),
    )
    return F.when(F.length(d).between(16, 19), total % 10 == 0).otherwise(False)


def phone_length(x: Column) -> Column:
    return F.length(digits(x)).between(8, 15)


def mod97(x: Column) -> Column:
    """IBAN check: first four characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(moved)), F.lit(0),
        lambda a, i: F.when(
            F.substring(moved, i, F.lit(1)).rlike("[0-9]"), a * 10 + F.ascii(F.substring(moved, i, F.lit(1))) - 48
        ).otherwise(a * 100 + F.ascii(F.substring(moved, i, F.lit(1))) - 55) % 97,
    )
    return F.when(F.length(plain).between(15, 34), rest == 1).otherwise(False)


def always(x: Column) -> Column:
    return F.lit(True)


def dotted(t: Column) -> Column:
    return F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)


def spaced(t: Column) -> Column:
    one = F.regexp_replace(t, "(?<=[0-9]) (?=[0-9])", SPACE)
    return F.regexp_replace(one, "(?<=[0-9])-(?=[0-9])", DASH)


#: Countries by the length of their IBAN.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """A run of its country's length, whatever capitals or digits follow after a space, or else the longest run."""
    known = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{known})|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # over prepared text
    may: Callable[[Column], Column]  # cheap test that a text can hold a match
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True
    prepare: Callable[[Column], Column] = lambda t: t


KINDS = (
    Kind("email", rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++",
         lambda t: F.contains(t, F.lit("@")), always, 0.9, "mail|contact|write", prepare=dotted),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"),
         ip_parts, 0.6, r"\bip\b|host|server|address"),
    Kind("card", f"[0-9][0-9{SPACE}{DASH}]++", lambda t: t.rlike("[0-9](?:[ -]?[0-9]){15}"),
         luhn, 0.7, "card|visa|credit|pay", prepare=spaced),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")),
         phone_length, 0.6, "phone|call|tel|fax"),
    Kind("iban", iban_pattern(),
         lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), mod97, 0.65, "iban|bank|account", base=False),
    Kind("ssn", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
         always, 0.35, "ssn|social security|tax", base=False),
    Kind("secret", "(?<![0-9A-Za-z])[0-9a-f]{40}(?![0-9A-Za-z])", lambda t: t.rlike("[0-9a-f]{40}"),
         always, 0.35, "token|secret|key|passw", base=False),
)


def plain(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), DOT + SPACE + DASH, "\ufffd" * 3)


def matches(df: DataFrame, keep: list[str], text: str, kinds: tuple[Kind, ...]) -> DataFrame:
    """For each kind k: gaps_k, the texts between the matches, and hits_k of {hit, score, ok}."""
    src = {k.name: F.when(k.may(F.col(text)), k.prepare(F.col(text))).otherwise("") for k in kinds}
    df = pinned(df, keep, **src)
    raw = {}
    for k in kinds:
        raw[f"gaps_{k.name}"] = F.split(k.name, k.pattern, -1)
        raw[f"raw_{k.name}"] = F.regexp_extract_all(k.name, F.lit(k.pattern), 0)
    df = pinned(df, keep, **raw)
    back = lambda x: F.translate(x, DOT + SPACE + DASH, ". -")

    def judged(k: Kind) -> Column:
        gaps = F.col(f"gaps_{k.name}")

        def one(h: Column, i: Column) -> Column:
            near = F.lower(F.concat(F.right(F.get(gaps, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR))))
            score = F.least(F.lit(1.0), F.lit(k.score) + F.when(near.rlike(k.context), BOOST).otherwise(0.0))
            valid = F.coalesce(k.valid(back(h)), F.lit(False))
            return F.struct(h.alias("hit"), score.alias("score"), (valid if k.base else valid & (score >= ACCEPT)).alias("ok"))

        return F.transform(F.col(f"raw_{k.name}"), one)

    gaps = [f"gaps_{k.name}" for k in kinds]
    return pinned(df, keep + gaps, **{f"hits_{k.name}": judged(k) for k in kinds})


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_<base kind>, base_sha256, spans and the best score of each row of docs(doc_id, text)."""
    rows = docs.select("doc_id", plain(F.col("text")).alias("t"))
    df = matches(rows, ["doc_id"], "t", KINDS)
    names = [k.name for k in KINDS]
    hits = [f"hits_{n}" for n in names]
    add = lambda a, x: a + x

    def steps(n: str) -> Column:
        return F.transform(f"hits_{n}", lambda h, i: F.length(F.get(f"gaps_{n}", i)) + F.length(h.hit))

    def per_block(n: str, value: Callable[[Column], Column]) -> Column:
        last = F.greatest(F.size(f"step_{n}") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda b: F.aggregate(value(b), F.lit(0), add))

    step = {f"step_{n}": steps(n) for n in names}
    step |= {f"gap_{n}": F.transform(f"gaps_{n}", lambda g: F.length(g)) for n in names}
    df = pinned(df, ["doc_id", *hits], **step)
    keep = ["doc_id", *hits, *step]
    sums = {f"sum_{n}": per_block(n, lambda b, n=n: F.slice(f"step_{n}", b * BLOCK + 1, F.lit(BLOCK))) for n in names}
    df = pinned(df, keep, **sums)
    df = pinned(df, keep, **{f"upto_{n}": per_block(n, lambda b, n=n: F.slice(f"sum_{n}", F.lit(1), b)) for n in names})

    def spans(n: str) -> Column:
        def one(h: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            start = F.get(f"upto_{n}", b) + F.aggregate(F.slice(f"step_{n}", b * BLOCK + 1, i % BLOCK), F.lit(0), add) + F.get(f"gap_{n}", i)
            text = F.concat_ws(":", F.lit(n), start.cast("string"), (start + F.length(h.hit)).cast("string"))
            return F.struct(h.ok.alias("ok"), h.score.alias("score"), text.alias("span"))

        return F.filter(F.transform(f"hits_{n}", one), lambda s: s.ok)

    df = pinned(df, ["doc_id"], **{n: spans(n) for n in names})
    base = [k.name for k in KINDS if k.base]
    listed = lambda some: F.array_join(F.concat(*[F.transform(n, lambda s: s.span) for n in some]), ",")
    best = F.array_max(F.concat(*[F.transform(n, lambda s: s.score) for n in names]))
    return df.select(
        "doc_id", *[F.size(n).cast("long").alias(f"n_{n}") for n in base],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(names).alias("spans"), best.alias("best_score"),
    )


def replaced(k: Kind) -> Callable[[Column, Column], Column]:
    """The gap before a hit, then [KIND] or the hit itself if it isn't accepted."""
    return lambda h, i: F.concat(F.get(f"gaps_{k.name}", i), F.when(h.ok, f"[{k.name.upper()}]").otherwise(h.hit))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every accepted span replaced by [KIND], kind after kind; null texts stay null.
    Columns and their order stay."""
    cols = docs.columns
    named = {c: F.col(f"_r.{c}") for c in cols}
    df = docs.select(F.struct(*[F.col(c) for c in cols]).alias("_r"), plain(F.col(text)).alias("_t"))
    for k in KINDS:
        mine = f"gaps_{k.name}", f"hits_{k.name}"
        df = matches(df, ["_r", "_t"], "_t", (k,))
        cut = F.transform(mine[1], replaced(k))
        whole = F.concat(F.array_join(cut, ""), F.element_at(mine[0], -1))
        whole = F.translate(whole, DOT + SPACE + DASH, ". -")
        df = pinned(df, ["_r"], _t=F.when(F.exists(mine[1], lambda h: h.ok), whole).otherwise(F.col("_t")))
    named[text] = F.when(F.col(f"_r.{text}").isNotNull(), F.col("_t"))
    return df.select(*[v.alias(c) for c, v in named.items()])
