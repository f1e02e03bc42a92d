"""Column expressions for text, money and dates (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOTAL = "decimal(38,2)"

# White space as Python's str.strip() sees it (incl. the no-break space &nbsp; decodes to),
# spelled out so Java regex and RE2 (the DuckDB oracle) agree on it.
WS_CLASS = r"[\t\n\x0B\f\r \x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EDGE_SPACE = rf"^{WS_CLASS}+|{WS_CLASS}+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as characters, for btrim (no regex: cheap enough for every row).
WS_CHARS = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column | str) -> Column:
    """White space removed at both ends, as Python's str.strip (Spark's trim only removes blanks)."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def blank_to_null(c: Column | str) -> Column:
    s = strip(c)
    return F.when(s == "", F.lit(None)).otherwise(s)


def money(c: Column | str) -> Column:
    """Amount text -> decimal(18,2); commas dropped; null when not a number."""
    cleaned = strip(F.regexp_replace(col(c).cast("string"), ",", ""))
    return cleaned.try_cast(MONEY)


def with_fields_once(df, fields: dict[str, Column]):
    """Add expensive derived columns so that each is evaluated once per row.

    A later filter on such a column would otherwise be pushed below the projection with the
    expression copied into it (a second regex/date parse per row). Columns produced by a
    one-element generator are not pushed through, so the work stays single.
    """
    packed = F.inline(F.array(F.struct(*[e.alias(n) for n, e in fields.items()])))
    return df.select("*", packed)


def money_label(c: Column | str, symbol: str = "₹") -> Column:
    """Whole-unit amount with thousands separators, e.g. ₹1,235 (half-up rounding)."""
    return F.concat(F.lit(symbol), F.format_number(F.round(col(c), 0), 0))


def regex_group(c: Column | str, pattern: str, idx: int = 1) -> Column:
    """First match, group idx; null (not '') when nothing matches."""
    found = F.array(F.regexp_extract(col(c), pattern, idx))  # searched once, where nullif() may search twice
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def day_month_year(c: Column | str) -> Column:
    """'9-2-26' or '09-02-2026' -> date. A two-digit year is 20yy."""
    s = col(c)
    return F.when(
        s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(s, "d-M-yyyy")
    ).when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{2}$"), F.try_to_date(s, "d-M-yy"))


def slash_date(c: Column | str) -> Column:
    """Statement date 'DD/MM/YY' -> date."""
    return F.try_to_date(col(c), "dd/MM/yy")


def urlsafe_b64_text(c: Column | str) -> Column:
    """URL-safe base64 (padding optional) -> UTF-8 text; bad bytes become U+FFFD."""
    plain = F.replace(F.replace(col(c), F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))  # translate() makes a string per character
    raw = F.try_to_binary(plain, F.lit("base64"))  # null if it is cut off or no base64
    return F.make_valid_utf8(raw.cast("string"))


def numeric_references(h: Column) -> Column:
    """&#8377; and &#x20B9; as their characters; numbers that are no character stay as they are."""
    ref = "&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"

    def char(m: Column) -> Column:
        code = F.regexp_extract(m, ref, 1)
        n = F.when(code.rlike("^[xX]"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("int")
        known = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        utf = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(known, utf).otherwise(m)

    gaps, refs = F.split(h, ref, -1), F.regexp_extract_all(h, F.lit(ref), 0)
    both = F.zip_with(gaps, refs, lambda g, m: F.concat(g, F.coalesce(char(m), F.lit(""))))
    return F.when(F.contains(h, F.lit("&#")), F.array_join(both, "")).otherwise(h)


def html_text_lines(c: Column | str) -> Column:
    """HTML -> its text, one stripped non-empty line per text run, joined by newline.

    Script, style, comments and declarations are removed; every tag ends a line;
    numeric character references and the six common entities are decoded, &amp; last.
    """
    def blocks(x: Column) -> Column:
        without = F.regexp_replace(F.regexp_replace(x, r"(?is)<script\b.*?</script>", ""), r"(?is)<style\b.*?</style>", "")
        return F.when(x.rlike(r"(?i)<s(cript|tyle)\b"), without).otherwise(x)

    def declarations(x: Column) -> Column:
        without = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", ""), r"<![^>]*>", "")
        return F.when(F.contains(x, F.lit("<!")), without).otherwise(x)

    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731 - bound once, used several times
    h = once(once(col(c), blocks), declarations)
    h = once(F.regexp_replace(h, r"<[^>]+>", "\n"), numeric_references)
    for ent, ch in HTML_ENTITIES:
        h = F.replace(h, F.lit(ent), F.lit(ch))
    lines = F.transform(F.split(h, "\n"), lambda x: strip(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# Entities decoded in html_text_lines, in this order (&amp; last).
HTML_ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]


def fingerprint(cols: list[str], width: int = 32) -> Column:
    """SHA-256 over 'v1|v2|...|' of lower-cased stripped text, first `width` hex chars.

    A null value hashes as the text 'none'.
    """
    if not cols:
        raise ValueError("fingerprint needs at least one key column")
    parts: list[Column] = []
    for k in cols:
        parts.append(F.coalesce(strip(F.lower(F.col(k).cast("string"))), F.lit("none")))
        parts.append(F.lit("|"))
    return F.substring(F.sha2(F.concat(*parts), 256), 1, width)
