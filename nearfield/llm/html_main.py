"""Main text of web pages by page differencing, with the markup's own zones as a guard.

A page is cut into text lines (the text of a block element). Lines in script, style, menus, headers
outside an article, footers, sidebars, forms, and elements whose class, id or role is a whole name of
notices, adverts or comments (fewer names count inside an article) are template by their markup; lines
in an article or main element are text by theirs. For lines that the
markup leaves open, pages are differenced: pages are put in order of host and URL path, each is paired
with the neighbour whose path shares the longer prefix, both pages' open lines are aligned by longest
common subsequence, and shared lines are deleted.

Differencing alone doesn't give right results: copies of an article under neighbouring paths delete
each other, and menus, adverts and footers that vary from page to page survive. So it decides the open
lines alone, and those of every page, whether or not it also has an article or main element.

Pages are dealt by range of (host, path), so that a host of any size spreads over tasks; each range also
gets the page just before it and the page just after it, so that pairs don't depend on the ranges. The
ends of the ranges come from a bounded sample of keys and bear on nothing but the spread.

An element is hidden by an attribute hidden, by aria-hidden="true" or by display:none in its style, and by no other word in its
tag; body and html never are. A tag with an unbalanced quote ends at its first ">".

Defined cases: null or empty html gives ''; a null or odd URL has an empty host and is paired among
such; truncated markup ends with its last complete text; repeated rows are pages of their own (two
equal pages delete each other's open lines); an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import bounded_batches, parallelism

#: HTML's element names by role.
DROPPED = frozenset("script style noscript template iframe object svg canvas video audio head title nav footer aside form button select option textarea input label dialog menu".split())
BLOCKS = frozenset("p div section article main header footer nav aside ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption pre blockquote figure figcaption form fieldset address details summary hr body html head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class, id and role names of template parts; a name may end in one of the SUFFIXES.
PARTS = r"(?:ads?|advert\w*|banner|promos?|promotion|sponsor\w*|cookies?|consent|popup|modal|menu|nav|navbar|navigation|breadcrumbs?|sidebar|widget|footer|comments?|reply|replies|disqus|share|sharing|social|newsletter|subscribe|signup|login|pagination|toolbar|contentinfo|complementary)"
#: More of them outside an article, where such a name doesn't stand for a part of the text.
OUTER = r"(?:side|notices?|alert|masthead|related|search|skip)"
SUFFIXES = r"(?:[-_](?:area|banner|bar|block|body|box|buttons?|container|content|form|inner|item|links?|list|notice|outer|panel|section|slot|unit|wrap|wrapper|\d+))*"
NAMED = re.compile(rf"(?:^|\s){PARTS}{SUFFIXES}(?:\s|$)", re.I)
NAMED_OUTSIDE = re.compile(rf"(?:^|\s)(?:{PARTS}|{OUTER}){SUFFIXES}(?:\s|$)", re.I)
TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<!--|<[!?]")
PLAIN = re.compile(r"[^>\"']*")
VALUE_FOLLOWS = re.compile(r"=\s*$")
AFTER_VALUE = re.compile(r"[\s/>]|$")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
SPACE = re.compile(r"\s+")
#: End tags that HTML lets authors leave out: an opening tag closes these.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TEXT, OPEN, TEMPLATE = "text", "open", "template"


def attributes(inside: str) -> dict[str, str]:
    """Names (lower case) and values of a tag's attributes; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(inside):
        found.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
    return found


def hidden(said: dict[str, str]) -> bool:
    """Whether an element's own attributes hide it."""
    return "hidden" in said and said["hidden"].lower() != "until-found" or said.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(said.get("style", "")))


class Quotes:
    """Ends of tags of a page, in one pass over its quotes."""

    def __init__(self, page: str):
        self.page, self.next = page, {'"': -1, "'": -1}

    def _close(self, quote: str, at: int) -> int:
        """Place of the next ``quote`` from ``at`` on, or the page's length; asked for ascending places."""
        if self.next[quote] < at:
            found = self.page.find(quote, at)
            self.next[quote] = found if found >= 0 else len(self.page)
        return self.next[quote]

    def end(self, at: int) -> int:
        """Place of the ">" that ends the tag whose name ends at ``at``, or the page's length.

        A value in quotes may hold ">", if a quote closes it where a value can end; otherwise the tag ends at the first ">".
        """
        start = at
        while True:
            at = PLAIN.match(self.page, at).end()
            if at == len(self.page) or self.page[at] == ">":
                return at
            quote = self.page[at]
            if VALUE_FOLLOWS.search(self.page, max(start, at - 8), at):
                close = self._close(quote, at + 1)
                if close == len(self.page) or not AFTER_VALUE.match(self.page, close + 1):
                    found = self.page.find(">", at)
                    return found if found >= 0 else len(self.page)
                at = close
            at += 1


def page_lines(page: str | None) -> list[tuple[str, str]]:
    """[(zone, line)] of a page in order, template lines left out; zone is TEXT or OPEN."""
    lines: list[tuple[str, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()  # names on the stack
    zone, page, at = OPEN, page or "", 0
    quotes = Quotes(page)

    def flush() -> None:
        if buffer:
            line = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if line and zone != TEMPLATE:
                lines.append((zone, line))
            buffer.clear()

    def pop() -> str:
        name, before = stack.pop()
        opened[name] -= 1
        return before

    while True:
        m = TOKEN.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        if not m[2]:
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, m.end())
            at = end + len(mark) if end >= 0 else len(page)
            continue
        name, end = m[2].lower(), quotes.end(m.end())
        if end == len(page):  # the page ends within a tag
            break
        inside, at = page[m.end() : end], end + 1
        if name == "br":
            buffer.append(" ")
            continue
        if m[1]:
            if name in BLOCKS:
                flush()
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                before = stack[-1][1]
                if before != zone:
                    flush()
                pop()
                zone = before
            continue
        if name in RAW and not inside.endswith("/"):
            if name in BLOCKS:
                flush()
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in BLOCKS:
            flush()
        if name in VOID or inside.endswith("/"):
            continue
        for closed in CLOSES.get(name, ()):
            if stack and stack[-1][0] == closed:
                zone = pop()
        stack.append((name, zone))
        opened[name] += 1
        inner = zone
        if zone != TEMPLATE:
            said = attributes(inside) if inside else {}
            names = " ".join(said[x] for x in ("class", "id", "role") if said.get(x))
            whole = name in ("body", "html")  # never hidden as such: scripts show such pages
            if name in DROPPED or name == "header" and zone != TEXT or names and name not in MAIN and not whole and (NAMED if zone == TEXT else NAMED_OUTSIDE).search(names) or said and not whole and hidden(said):
                inner = TEMPLATE
            elif name in MAIN or "main" == names.lower():
                inner = TEXT
        if inner != zone:
            flush()
            zone = inner
    flush()
    return lines


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    shared = {*range(start), *range(len(a) - end, len(a))}
    p, q = a[start : len(a) - end], b[start : len(b) - end]
    both = set(p) & set(q)
    at, q = [k for k, x in enumerate(p) if x in both], [x for x in q if x in both]
    # row by row of the table as bits: bit j is unset where the length grows from j to j + 1
    where: dict[str, int] = {}
    for j, x in enumerate(q):
        where[x] = where.get(x, 0) | 1 << j
    ones = row = (1 << len(q)) - 1
    table = []
    for k in at:
        met = row & where[p[k]]
        row = (row + met | row - met) & ones
        table.append(row)
    i, j = len(at) - 1, len(q) - 1
    while i >= 0 and j >= 0:
        if table[i] >> j & 1:
            j -= 1
        elif i and not table[i - 1] >> j & 1:
            i -= 1
        else:
            shared.add(start + at[i])
            i, j = i - 1, j - 1
    return shared


def main_text(lines: list[tuple[str, str]], mate: list[tuple[str, str]] | None) -> str:
    """The page's text: the lines of its own zone where markup names one, and the open lines that the mate doesn't share."""
    open_at = [k for k, (zone, _) in enumerate(lines) if zone == OPEN]
    gone: set[int] = set()
    if mate is not None:
        shared = common_lines([lines[k][1] for k in open_at], [x for zone, x in mate if zone == OPEN])
        gone = {open_at[k] for k in shared}
    return "\n\n".join(x for k, (_, x) in enumerate(lines) if k not in gone)


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


KEYS = ["host", "path", "url", "page_id", "mark"]
SAMPLE_A_RANGE = 64


def in_ranges(parts: DataFrame, ranges: int) -> DataFrame:
    """``parts`` with range (int) and own (boolean): each row in its range, and in the neighbouring ranges' edges."""
    key = F.struct(*KEYS)
    every = max(1, parts.count() // (SAMPLE_A_RANGE * ranges))
    sample = parts.select(*KEYS).where(F.pmod(F.xxhash64(*KEYS), F.lit(every)) == 0).distinct().orderBy(*KEYS).collect()
    ends = sample[:: max(1, len(sample) // ranges)][1:]
    # one row of two keys a range at most, beside every page; the range is found by halving
    kind = StructType([parts.schema[c] for c in KEYS])
    bounds = parts.sparkSession.createDataFrame([(0, ends)], StructType([StructField("_one", IntegerType()), StructField("_ends", ArrayType(kind))]))
    steps = F.array(*[F.lit(1 << k) for k in range(len(ends).bit_length() - 1, -1, -1)]) if ends else F.array().cast("array<int>")
    further = lambda at, step: F.when((at + step <= len(ends)) & (F.get("_ends", at + step - 1) <= key), at + step).otherwise(at)
    beside = parts.withColumn("_one", F.lit(0)).join(F.broadcast(bounds), "_one")
    ranged = beside.select(*parts.columns, F.aggregate(steps, F.lit(0), further).alias("range"))
    # the first and last key of each range, handed to the ranges after and before it: two rows a range
    edges = ranged.groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    order = Window.orderBy("range")
    edges = edges.select("range", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    handed = edges.select(F.col("range").alias("to"), F.explode(F.array("before", "after")).alias("k")).where("k is not null").select("to", *[F.col(f"k.{c}").alias(f"_{c}") for c in KEYS])
    same = F.lit(True)
    for c in KEYS:
        same = same & parts[c].eqNullSafe(F.col(f"_{c}"))
    context = parts.join(F.broadcast(handed), same).select("to", *parts.columns).dropDuplicates(["to", *KEYS])
    return ranged.withColumn("own", F.lit(True)).unionByName(context.withColumnRenamed("to", "range").withColumn("own", F.lit(False)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host"),
        F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
        F.xxhash64("html").alias("mark"),  # rows may share all else
    )
    bounded_batches(pages.sparkSession)
    n = 2 * parallelism(pages.sparkSession)
    ranged = in_ranges(parts, n).repartitionByRange(n, "range").sortWithinPartitions("range", *KEYS, "own", "html")

    def difference(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    yield from batch.slice(at, 64).to_pylist()

        def settled(page, before, after):
            mates = [x for x in (before, after) if x is not None and x["host"] == page["host"] and x["range"] == page["range"]]
            mate = max(mates, key=lambda x: _prefix(x["path"], page["path"]), default=None)
            return page["page_id"], page["url"], main_text(page["lines"], mate and mate["lines"])

        def results():
            before = page = None
            for after in rows():
                after["lines"] = page_lines(after.pop("html"))
                if page is not None and page["own"]:
                    yield settled(page, before, after)
                before, page = page, after
            if page is not None and page["own"]:
                yield settled(page, before, None)

        held: list[tuple] = []
        size = 0

        def packed():
            ids, urls, texts = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        for result in results():
            held.append(result)
            size += len(result[2])
            if size > 1 << 21 or len(held) >= 1024:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return ranged.mapInArrow(difference, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
