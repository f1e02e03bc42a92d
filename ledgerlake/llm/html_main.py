"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are its elements, named by their path, and its text blocks within their path. Pages
of a host with the same text blocks are copies and count as one. Over a host's distinct pages, Spark sums for every token a signature of its occurrence vector (which page
holds it how often); tokens with one vector form a class. Classes of two or more tokens that
enough pages hold are the host's template, nested by path. The innermost template element around
a block is its slot. Slots inside article or main elements are extracted whole; on hosts whose
template has none, all slots outside menus, headers, footers, sidebars, notices, adverts, forms
and comments, less the blocks that are template tokens themselves on TEXT_PAGES distinct pages or
more. A page most of whose text would go that way is a copy with few changes and keeps it all. A page
that shows none of its host's slots is judged by its own elements. No page's html is shuffled, only
its tokens: the templates are joined to the pages, by broadcast if they are small.

Nulls and edge cases: null or empty html gives an empty text; a null url is a host of its own;
repeated rows give their text each; hosts with one distinct page have no template; unclosed tags, stray closing
tags and cut-off pages are read as far as they go; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import slices
from ledgerlake.llm.store import join_counted, stored

SUPPORT, LEAST_PAGES, TEXT_PAGES = 0.5, 2, 4
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z][^<>]*(?:>|\Z)|[^<]+|<""",
    re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROP = set("nav header footer aside form button select option datalist dialog menu head noscript template svg canvas object audio video map label fieldset".split())
MAIN = {"article", "main"}
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Block elements that a closing tag of a smaller element doesn't reach across.
WALL = BLOCK - set("p li dt dd h1 h2 h3 h4 h5 h6 br hr option tr td th caption summary legend".split())
#: Start tags that close an open element of the same kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|"
    r"consent|gdpr|notices?|popup|modal|newsletter|subscri\w+|share|sharing|social|comments?|commentlist|replies|reply|disqus|related|recommend\w*|"
    r"widgets?|toolbar|pagination|pager|login|signup|search)(?:$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", re.I)
#: Names that say what is beside or around an element, not what it is.
MODIFIER = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no)-\S+")
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


def hash64(*parts: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


class Element:
    __slots__ = ("name", "path", "token", "dropped", "main", "at", "named", "closed", "above")

    def __init__(self, name: str, path: str, dropped: bool, main: bool, at: int, named: bool, closed: bool, above: Element | None):
        """named and closed: what drops it itself, a name that a wrapper may bear too (a hint, a form) or
        anything else; at: where its tag begins."""
        self.name, self.path, self.dropped, self.main = name, path, dropped, main
        self.at, self.named, self.closed, self.above = at, named, closed, above
        self.token = hash64(path)


def opened(name: str, rest: str, above: Element | None, at_place: int = 0, wrappers: frozenset[int] = frozenset()) -> Element:
    """The element a start tag opens; class names in its path stand without digits. `wrappers` are the
    places of elements that their name doesn't drop."""
    closed, main, mark = name in DROP and name != "form", name in MAIN, ""
    named = name == "form"
    if rest and "=" in rest or "hidden" in rest:
        at = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
        names = f"{at.get('class', '')} {at.get('id', '')}".strip()
        role = at.get("role", "").lower()
        main = main or role in ("main", "article") or "articlebody" in at.get("itemprop", "").lower()
        if names and name == "article":
            closed = closed or bool(COMMENTS.search(names))
        elif names and name not in ("html", "body", "main"):
            named = named or bool(HINTS.search(MODIFIER.sub(" ", names)))
        closed = closed or role in ROLES or "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "")
        mark = re.sub(r"\d+", "0", names)
    path = f"{above.path}/{name}.{mark}" if above else f"{name}.{mark}"
    dropped = closed or named and at_place not in wrappers
    return Element(name, path, dropped or bool(above and above.dropped), main or bool(above and above.main), at_place, named, closed, above)


def blocks(page: str) -> tuple[list[tuple[str, list[Element]]], list[Element]]:
    """(blocks, elements): each text block with the structural elements around it, and all structural elements.

    A name that drops an element (a hint among its classes, a form) doesn't drop a wrapper of the page:
    one around an article or main of a page that shows none elsewhere, or around all its text."""
    wrappers: frozenset[int] = frozenset()
    while True:
        found, elements = parsed(page, wrappers)
        inside = [e for e in elements if e.named and not e.closed and e.at not in wrappers]
        if not inside or any(e.main and not e.dropped for e in elements):
            return found, elements
        hold: set[int] = set()
        for e in elements:
            if e.main and not (e.above and e.above.main):
                chain, up = set(), e.above
                while up is not None and not up.closed:
                    chain |= {up.at} if up.named else set()
                    up = up.above
                hold |= chain if up is None and not e.closed else set()
        if not hold - wrappers and not found:
            hold = {e.at for e in inside if e.above is None or not e.above.dropped}
        if not hold - wrappers:
            return found, elements
        wrappers |= hold


def parsed(page: str, wrappers: frozenset[int]) -> tuple[list[tuple[str, list[Element]]], list[Element]]:
    """blocks, with given wrappers."""
    stack: list[Element] = []
    out: list[tuple[str, list[Element]]] = []
    elements: list[Element] = []
    text: list[str] = []
    inside: list[Element] = []

    def flush() -> None:
        nonlocal inside
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append((whole, inside))
            text.clear()

    for m in TOKEN.finditer(page):
        name = m["name"]
        if name is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                if stack and stack[-1].dropped:
                    continue
                if not text:
                    inside = list(stack)
                text.append(t)
            elif m["raw"] is None and t[1].isalpha():
                flush()  # a start tag that the page's end or a stray sign cuts off
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    if any(e.dropped != stack[-1].dropped for e in stack[i - 1 : i]) or name in BLOCK:
                        flush()
                    del stack[i:]
                    break
                if stack[i].name in WALL and name not in WALL:
                    break
        elif name not in VOID:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in SELF_CLOSING.get(name, ()):
                    del stack[i:]
                    break
                if stack[i].name in WALL:
                    break
            e = opened(name, m["rest"], stack[-1] if stack else None, m.start(), wrappers)
            if name in WALL or e.dropped or e.main and not (stack and stack[-1].main):
                if e.dropped and not (stack and stack[-1].dropped):
                    flush()
                elements.append(e)
                if not m["rest"].endswith("/"):
                    stack.append(e)
            elif name in SELF_CLOSING or name[0] == "h" and name in BLOCK:
                small = Element.__new__(Element)  # closes with its kind, but is no template element
                above = stack[-1] if stack else None
                small.name, small.path = name, above.path if above else ""
                small.token, small.dropped, small.main = (above.token, above.dropped, above.main) if above else (0, False, False)
                small.at, small.named, small.closed, small.above = m.start(), False, False, above
                stack.append(small)
    flush()
    return out, elements


def host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


FOUND = "host string, token long, element boolean, main boolean, dropped boolean, low long, high long, pages long"


def distinct_pages(pages: DataFrame) -> DataFrame:
    """host, tokens, kinds (bits: element, main, dropped), counts and key of one page of each text of a
    host, that of the smallest key. Token 0 stands on each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            kept: dict[tuple[str, int], tuple[int, Counter]] = {}
            for where, page, key in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("page").to_pylist(), strict=True):
                texts, elements = blocks(page or "")
                digest = hash64(*[t for t, _ in texts])
                if (where, digest) in kept and kept[where, digest][0] <= key:
                    continue
                seen = Counter((e.token, 1 | e.main << 1 | e.dropped << 2) for e in elements)
                seen.update((hash64(around[-1].path if around else "", t), 0) for t, around in texts)
                seen[0, 1] = 1
                kept[where, digest] = key, seen
            cols = [[h for h, _ in kept], [d for _, d in kept], [k for k, _ in kept.values()],
                    *[[[t[i] for t in seen] for _, seen in kept.values()] for i in (0, 1)], [list(seen.values()) for _, seen in kept.values()]]
            types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["host", "digest", "key", "tokens", "kinds", "counts"])

    rows = pages.mapInArrow(read, "host string, digest long, key long, tokens array<long>, kinds array<tinyint>, counts array<int>")
    page = F.min(F.struct("key", "tokens", "kinds", "counts")).alias("page")
    return rows.groupBy("host", "digest").agg(page).select("host", "page.*")


def occurrences(pages: DataFrame) -> DataFrame:
    """FOUND rows: per token its summed signature and pages, folded over each run of distinct pages. Token 0 counts a host's pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, list[int]] = {}
            for where, key, tokens, kinds, counts in zip(*[b.column(c).to_pylist() for c in ("host", "key", "tokens", "kinds", "counts")], strict=True):
                signs = {n: hash64(str(key), str(n)) for n in set(counts)}
                for token, kind, n in zip(tokens, kinds, counts, strict=True):
                    s = sums.setdefault((where, token, bool(kind & 1), bool(kind & 2), bool(kind & 4)), [0, 0, 0])
                    s[0] += signs[n] & 0x7FFFFFFF
                    s[1] += signs[n] >> 32 & 0x7FFFFFFF
                    s[2] += 1
            cols = list(zip(*[(*k, *v) for k, v in sums.items()], strict=True)) or [[]] * 8
            types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["host", "token", "element", "main", "dropped", "low", "high", "pages"])

    rows = distinct_pages(pages).mapInArrow(count, FOUND)
    return rows.groupBy("host", "token", "element", "main", "dropped").agg(*[F.sum(c).alias(c) for c in ("low", "high", "pages")])


def templates(pages: DataFrame) -> DataFrame:
    """host, elements, slots, texts: the template's elements, those extracted, and its text tokens.

    A template token stands on at least SUPPORT of a host's distinct pages, so a host's arrays are at most
    1 / SUPPORT times an average page's tokens."""
    found = stored(occurrences(pages), "tokens")
    sizes = stored(found.filter("token = 0").select("host", F.col("pages").alias("all")), "hosts")
    common = join_counted(found.filter("token <> 0"), sizes, ["host"], "inner").filter(
        (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= SUPPORT * F.col("all")))
    common = stored(common, "common-tokens")
    classes = common.groupBy("host", "low", "high", "pages").agg(F.count("*").alias("size")).filter("size > 1")
    valid = common.join(classes, ["host", "low", "high", "pages"], "left_semi")
    kept = lambda on: F.collect_set(F.when(on, F.col("token")))
    element, free, often = F.col("element"), ~F.col("dropped"), F.col("pages") >= TEXT_PAGES
    per_host = valid.groupBy("host").agg(
        kept(element).alias("elements"), kept(element & free & F.col("main")).alias("mains"),
        kept(element & free).alias("open"), kept(~element & often).alias("texts"))
    slots = F.when(F.size("mains") > 0, F.col("mains")).otherwise(F.col("open"))
    return stored(per_host.select("host", "elements", slots.alias("slots"), "texts"), "templates")


def text_of(page: str, elements: set[int], slots: set[int], constant: set[int]) -> str:
    """The page's blocks in its host's slots, or by its own elements if it shows none of them."""
    found, own = blocks(page)
    chosen, shown = [], False
    for t, around in found:
        slot = next((e for e in reversed(around) if e.token in elements), None)
        if slot is not None and slot.token in slots:
            shown = True
            chosen.append((t, slot.main or hash64(around[-1].path, t) not in constant))
    if shown or not found:
        return "\n".join(own_text(chosen))
    if any(e.main and not e.dropped for e in own):
        return "\n".join(t for t, around in found if around and around[-1].main)
    return "\n".join(own_text([(t, hash64(around[-1].path if around else "", t) not in constant) for t, around in found]))


def own_text(found: list[tuple[str, bool]]) -> list[str]:
    """The blocks that are the page's own; all of them if most, in number and length, are the template's."""
    own = [t for t, mine in found if mine]
    if 2 * len(own) < len(found) and 2 * sum(map(len, own)) < sum(len(t) for t, _ in found):
        return [t for t, _ in found]
    return own


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host().alias("host"))
    keyed = rows.select("host", "html", F.xxhash64("page_id", "url", "html").alias("page"))
    marked = join_counted(rows, templates(keyed), ["host"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, tuple[set[int], ...]] = {}
        for b in slices(batches, "html"):
            texts = []
            names = b.column("host").to_pylist()
            for i, page in enumerate(b.column("html").to_pylist()):
                if names[i] not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[names[i]] = tuple(set(b.column(c)[i].as_py() or ()) for c in ("elements", "slots", "texts"))
                texts.append(text_of(page, *sets[names[i]]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    cols = ["page_id", "url", "host", "html", "elements", "slots", "texts"]
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string"
    return marked.select(cols).mapInArrow(read, schema).withColumn("n_chars", F.length("text").cast("long"))
