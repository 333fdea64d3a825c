"""Main-text extraction by differencing every page with its nearest neighbours by URL.

A page becomes lines: the text between block-level tags, character references decoded, white space folded. Every line
knows its place: the open block elements with their classes.
Pages of a host are sorted by URL path; each is aligned with the page before and the one after it by the longest
common subsequence of their lines, and the lines they share are deleted: menus, notices and footers repeat from
page to page, text does not. Shared lines also tell which places are furniture on a host: where PLACE_SHARE of all
lines that the host's pages have in one place are shared, on PLACE_PAGES pages or more, every line there goes, those
that vary too. A neighbour that has COPY of the text of a page is a copy of the page, not a sibling, and says nothing.

What a page itself declares comes on top. Lines of an <article> or <main> are text even if another page repeats them,
unless their place is furniture or a menu, form, advert, comment section or the like holds them (within an article, where
words such as "search" or "related" name its own parts, only unmistakable classes say so); in a page with such an
element no other line is text.

At scale: only hashes of lines and places are sorted (by host and path over the whole cluster, so that a host with a
third of all pages is spread like any other); a range partition's first and last page are handed to its neighbours, so
that results do not depend on where partitions end. What is to be deleted then goes back to the pages by key. Reading a
page takes time linear in its length, whatever its tags; aligning two pages takes the lines that both have, squared,
divided by the bits of a machine word, and memory linear in them.

Defined results: null html gives an empty text, null urls have an empty host and path and are neighbours of each
other; equal rows give equal results; a page without a neighbour on its host keeps all its undecided lines; where a tag
never ends, quotes no longer count from there on; an unclosed script or style takes the rest of the page.
"""

from __future__ import annotations

import functools
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .url_filter import host_and_path

#: Share of a page's text from which a neighbour counts as a copy of it.
COPY = 0.8
#: A place is furniture on a host where this share of its lines is shared, on so many pages at least.
PLACE_SHARE, PLACE_PAGES = 0.8, 3

TEXT, FURNITURE, UNDECIDED = 0, 1, 2

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"""=\s*["']|>""")
_CLOSINGS = re.compile(r"</([A-Za-z][^\s/>]*)")
#: Numeric references beyond all characters.
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9A-Fa-f]{7,});?")
_CLASSES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_FURNITURE_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|overlay"
    r"|comments?|replies|respond|discussion|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|widget|toolbar|contentinfo|complementary|dialog|pagination|pager|copyright|disclaimer|skip)(?:$|[\s_-])",
    re.I,
)
#: Within an article only these whole names count: advertisements, comments, share bars, cookie notices and the like.
_COMMENTS = r"comments?-?(?:list|section|area|form|thread)|comments|disqus_thread"
_ADDED = re.compile(
    rf"(?:{_COMMENTS}|ads?|ad-(?:slot|unit|box|banner|container|wrapper)|adsbygoogle|adsense|advert|advertisement|sponsored-(?:links|content)|share-?(?:bar|buttons?|links|tools)|social-?(?:share|sharing|links|buttons|bar)|sharing-?(?:bar|buttons)"
    r"|cookie-?(?:notice|banner|consent|bar)|gdpr-?(?:notice|banner|consent)|newsletter-?(?:signup|form)|breadcrumbs?|pagination|navbar|related-?(?:posts|articles|links|stories))",
    re.I,
)
_ADDED_SECTION = re.compile(rf"(?:{_COMMENTS})", re.I)
_ADDED_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas", "math"}
_FURNITURE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
_MAIN_TAGS = {"article", "main"}
_TO_THE_END = {"script", "style", "title", "textarea", "iframe"}
#: Numbers in class names that tell pages, not places, apart.
_DIGITS = re.compile(r"\d{2,}")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}


def added(name: str, said: list[tuple[str, str]]) -> bool:
    """Whether an element within an article says that it is no part of it; headings and a section's anchor do not."""
    if name in _HEADINGS:
        return False
    for kind, value in said:
        pattern = _ADDED_SECTION if kind == "id" and name == "section" else _ADDED
        if any(x.lower() in _ADDED_ROLE if kind == "role" else pattern.fullmatch(x) for x in value.split()):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag; comments and declarations have no name. One pass, forward."""
    at, n, quotes = 0, len(page), True
    close: dict[str, int] = {}  # where the rest of the page has no end of a raw element
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = n if end < 0 else end + 3
            yield start, end, "", False, ""
        elif page.startswith(("<!", "<?"), start):
            if (end := page.find(">", start)) < 0:
                return
            end += 1
            yield start, end, "", False, ""
        elif m := _NAME.match(page, start + 1):
            end = m.end()
            while True:
                stop = _STOP.search(page, end) if quotes else None
                if not quotes:
                    end = page.find(">", end)
                    break
                if stop is None:
                    end = -1
                elif stop[0] == ">":
                    end = stop.start()
                    break
                else:
                    end = page.find(stop[0][-1], stop.end()) + 1
                if end <= 0:  # never ends: from here on a tag ends at the next ">"
                    quotes, end = False, m.end()
            if end < 0:
                return
            name, said = m[2].lower(), page[m.end() : end]
            end += 1
            if name in _RAW and not m[1] and not said.rstrip().endswith("/"):
                if start >= close.get(name, n):
                    found = None
                else:
                    found = _closing(name).search(page, end)
                if found is None:
                    close[name] = min(start, close.get(name, n))
                    end = n if name in _TO_THE_END else end
                else:
                    end = page.find(">", found.end())
                    end = n if end < 0 else end + 1
                name = ""
            yield start, end, name, bool(m[1]), said
        else:
            end = start + 1
            at = end
            continue
        at = end


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?![^\s/>])", re.I)


@dataclass
class Open:
    """The open elements that matter: block-level ones, marked ones and those nested in their like."""

    names: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)  # "main", "furniture" or ""
    places: list[int] = field(default_factory=list)
    ends: list[float] = field(default_factory=list)  # before which the furniture open so far is closed, at the earliest
    count: Counter = field(default_factory=Counter)
    marked: Counter = field(default_factory=Counter)

    def push(self, name: str, mark: str, said: str, end: float) -> None:
        self.ends.append(min(end, self.ends[-1]) if self.ends else end)
        self.places.append(xxhash.xxh64_intdigest(f"{name} {said}", self.place()))
        self.names.append(name)
        self.marks.append(mark)
        self.count[name] += 1
        self.marked[mark] += 1

    def pop(self) -> None:
        self.count[self.names.pop()] -= 1
        self.marked[self.marks.pop()] -= 1
        self.places.pop()
        self.ends.pop()

    def close(self, name: str) -> None:
        if self.count[name]:
            while self.names[-1] != name:
                self.pop()
            self.pop()

    def place(self) -> int:
        return self.places[-1] if self.places else 0

    def state(self) -> int:
        return FURNITURE if self.marked["furniture"] else TEXT if self.marked["main"] else UNDECIDED


_ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def page_lines(page: str) -> tuple[list[str], list[int], list[int]]:
    """Lines of a page, whether each is TEXT, FURNITURE or UNDECIDED, and a hash of its place."""
    texts: list[str] = []
    kinds: list[int] = []
    places: list[int] = []
    held: list[str] = []
    stack = Open()
    last: dict[str, int] | None = None  # where each name is closed for the last time

    def flush() -> None:
        if held:
            text = "".join(held)
            held.clear()
            if "&" in text:
                text = html.unescape(_HUGE.sub("\ufffd", text))
            if text := " ".join(text.split()):
                texts.append(text)
                kinds.append(stack.state())
                places.append(stack.place())

    at = 0
    for start, end, name, closing, said in tags(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if not name:
            continue
        if closing:
            if name in _BLOCK:
                flush()
            if stack.count[name]:
                flush()
                stack.close(name)
            continue
        if name in _BLOCK:
            flush()
            if name not in _VOID:
                if stack.names and stack.names[-1] == "p":
                    stack.pop()
                while stack.names and stack.names[-1] in _ITEMS.get(name, ()):
                    stack.pop()
        if name in _VOID:
            continue
        mark = ""
        if name in _MAIN_TAGS:
            mark = "main"
            while stack.ends and stack.ends[-1] < at:  # furniture that is never closed from here on ends here at the latest
                stack.pop()
        elif name in _FURNITURE_TAGS or name == "header" and stack.state() != TEXT:
            mark = "furniture"
        classes = ""
        if said and name not in ("html", "body"):
            attributes = [(k.lower(), a or b or c) for k, a, b, c in _CLASSES.findall(said)]
            every = " ".join(x for _, x in attributes)
            classes = " ".join(x for k, x in attributes if k != "id")
            if every and name not in _MAIN_TAGS and (added(name, attributes) if stack.state() == TEXT else _FURNITURE_CLASS.search(every)):
                mark = "furniture"
            elif every == "main":
                mark = "main"
        if name in _BLOCK or mark or stack.count[name]:
            if mark and name not in _BLOCK:
                flush()
            if mark == "furniture" and last is None:
                last = {m[1].lower(): m.start() for m in _CLOSINGS.finditer(page)}
            stack.push(name, mark, _DIGITS.sub("", classes), last.get(name, -1) if mark == "furniture" else float("inf"))
    held.append(page[at:])
    flush()
    return texts, kinds, places


#: A page's lines as they are compared: hash of the text, hash of the place, code points, kind.
LINE = np.dtype([("text", "<u8"), ("place", "<u8"), ("size", "<u4"), ("kind", "u1")])


def sketch(page: str) -> np.ndarray:
    texts, kinds, places = page_lines(page)
    out = np.zeros(len(texts), LINE)
    out["text"] = [xxhash.xxh64_intdigest(t) for t in texts]
    out["size"] = [len(t) for t in texts]
    out["kind"], out["place"] = kinds, places
    return out


def _few_matches(a: list[int], places: dict[int, list[int]]) -> list[int]:
    """Hunt and Szymanski: for few pairs of equal lines."""
    tails: list[int] = []
    chain: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(places[x]):
            k = bisect_left(tails, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(node)
            else:
                tails[k] = j
                chain[k] = node
    out, node = [], chain[-1] if chain else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _row(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of a with every beginning of b, a machine word of b at a time."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if u := v & where.get(x, 0):
            v = ((v + u) | (v - u)) & full
    bits = np.frombuffer((~v & full).to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return [0, *np.cumsum(np.unpackbits(bits, bitorder="little")[: len(b)]).tolist()]


def _many_matches(a: list[int], b: list[int], base: int, out: list[int]) -> None:
    """Hirschberg: halves a and splits b where the halves' lengths add up to most."""
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out.append(base)
        return
    half = len(a) // 2
    up, down = _row(a[:half], b), _row(a[half:][::-1], b[::-1])
    cut = max(range(len(b) + 1), key=lambda j: up[j] + down[len(b) - j])
    _many_matches(a[:half], b[:cut], base, out)
    _many_matches(a[half:], b[cut:], base + half, out)


def shared_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indexes in a of a longest common subsequence of a and b."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    m = n - head
    differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    tail = int(differ[0]) if len(differ) else m
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    at = np.flatnonzero(np.isin(x, y))
    x, y = x[at].tolist(), y[np.isin(y, x)].tolist()
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y):
        places.setdefault(v, []).append(j)
    found: list[int] = []
    if sum(len(places[v]) for v in x) <= 8 * (len(x) + len(y)):
        found = _few_matches(x, places)
    else:
        _many_matches(x, y, 0, found)
    return [*range(head), *(head + at[found]).tolist(), *range(len(a) - tail, len(a))]


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """The pages with a 128-bit key of their whole row, so that null and repeated ids do no harm."""
    host, path = host_and_path(pages[url_col].cast("string"))
    url, text = pages[url_col].cast("string"), F.coalesce(pages[html_col].cast("string"), F.lit(""))
    return pages.select(pages[id_col].alias("id"), url.alias("url"), host.alias("host"), path.alias("path"), text.alias("html"), F.xxhash64(url, text).alias("k1"), F.xxhash64(text, F.lit(1), url).alias("k2"))


_ORDER = ["host", "path", "k1", "k2"]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            lines = [sketch(x).tobytes() for x in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in _ORDER), pa.array(lines, pa.binary())], [*_ORDER, "lines"])


def _shared_with(page: dict, other: dict | None) -> list[int] | None:
    """Lines of the page that the other one shares; None where it is no sibling."""
    if other is None or (other["tile"], other["host"]) != (page["tile"], page["host"]):
        return None
    a, b = np.frombuffer(page["lines"], LINE), np.frombuffer(other["lines"], LINE)
    common = shared_lines(a["text"], b["text"])
    # the text that matters: what is declared, or else what is no declared furniture
    own, others = (x["size"] * ((x["kind"] == TEXT) if (x["kind"] == TEXT).any() else (x["kind"] != FURNITURE)) for x in (a, b))
    return None if own.sum() and own[common].sum() >= COPY * max(own.sum(), others.sum()) else common


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, host, path and key: of each page with a sibling before or after it, the lines it shares, and
    how many lines each place has and shares."""
    before = page = None
    out: list[tuple] = []

    def judge(after: dict | None) -> None:
        if page is None or page["ghost"]:
            return
        told = [x for x in (_shared_with(page, before), _shared_with(page, after)) if x is not None]
        if told:
            gone = sorted({*told[0], *told[-1]})
            lines = np.frombuffer(page["lines"], LINE)
            place, of = np.unique(lines["place"], return_inverse=True)
            n = np.bincount(of, minlength=len(place))
            out.append((page["k1"], page["k2"], page["host"], gone, place.view(np.int64).tolist(), n.tolist(), np.bincount(of[gone], minlength=len(place)).tolist()))

    def told_rows() -> pa.RecordBatch:
        columns = [*zip(*out, strict=True)] if out else [()] * 7
        out.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k1", "k2", "host", "gone", "place", "n", "shared"])

    for b in batches:
        for at in range(0, b.num_rows, 256):
            for row in b.slice(at, 256).to_pylist():
                judge(row)
                before, page = page, row
            yield told_rows()
    judge(None)
    yield told_rows()


#: Parts of a host's pages that meet its furniture places apart from each other.
SALTS = 32


def differences(keyed: DataFrame) -> DataFrame:
    """k1, k2, gone (lines shared with a sibling), furniture (places) for each distinct page that has any."""
    sketches = written(keyed.select(*_ORDER, "html").mapInArrow(_sketches, "host string, path string, k1 long, k2 long, lines binary"), "page-sketches")
    ranged = sketches.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in ("host", "path", "lines"))).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    tiles = written(ranged.withColumn("tile", F.spark_partition_id()), "page-tiles")
    row = F.struct(*_ORDER, "lines")
    edges = tiles.groupBy("tile").agg(F.min_by(row, F.struct(*_ORDER)).alias("first"), F.max_by(row, F.struct(*_ORDER)).alias("last"))
    by_tile = Window.orderBy("tile")  # two rows for each partition, no more
    ghosts = edges.select(F.lag("tile").over(by_tile).alias("tile"), F.col("first").alias("g")).unionAll(edges.select(F.lead("tile").over(by_tile).alias("tile"), F.col("last").alias("g")))
    ghosts = ghosts.filter("tile IS NOT NULL").select("g.*", "tile", F.lit(True).alias("ghost"))
    both = tiles.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    told = written(both.repartition("tile").sortWithinPartitions("tile", *_ORDER).mapInArrow(_differences, "k1 long, k2 long, host string, gone array<int>, place array<long>, n array<long>, shared array<long>"), "page-differences")
    votes = told.select("host", F.explode(F.arrays_zip("place", "n", "shared")).alias("v")).groupBy("host", "v.place").agg(F.sum("v.n").alias("n"), F.sum("v.shared").alias("shared"), F.count_if(F.col("v.shared") > 0).alias("pages"))
    furniture = votes.filter((F.col("pages") >= PLACE_PAGES) & (F.col("shared") >= PLACE_SHARE * F.col("n"))).select("host", "place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = told.select("k1", "k2", "host", F.pmod("k1", F.lit(SALTS)).cast("int").alias("salt"), F.explode("place").alias("place"))
    own = own.join(furniture, ["host", "place", "salt"]).groupBy("k1", "k2").agg(F.collect_set("place").alias("furniture"))  # of one page's places
    return told.select("k1", "k2", "gone").join(own, ["k1", "k2"], "left").filter("size(gone) > 0 OR furniture IS NOT NULL")


def main_text(page: str, gone: list[int], furniture: list[int]) -> str:
    """The page's text, without the lines and the places that differencing found."""
    texts, kinds, places = page_lines(page)
    away, out = {x % (1 << 64) for x in furniture}, set(gone)
    if TEXT in kinds:
        keep = (t for t, k, p in zip(texts, kinds, places, strict=True) if k == TEXT and p not in away)
    else:
        keep = (t for i, (t, k, p) in enumerate(zip(texts, kinds, places, strict=True)) if k == UNDECIDED and i not in out and p not in away)
    return "\n".join(keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", differencing: bool = True) -> DataFrame:
    """id, url, text, n_chars and n_shared (lines that a neighbour has) of every page."""
    keyed = _keyed(pages, id_col, url_col, html_col)
    found = differences(keyed)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                gone, places = ([x or [] for x in part[c].to_pylist()] for c in ("gone", "furniture"))
                out = [main_text(*x) if differencing else main_text(x[0], [], []) for x in zip(part["html"].to_pylist(), gone, places, strict=True)]
                yield pa.RecordBatch.from_arrays([part["id"], part["url"], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64()), pa.array([len(x) for x in gone], pa.int64())], ["id", "url", "text", "n_chars", "n_shared"])

    both = keyed.join(found, ["k1", "k2"], "left").select("id", "url", "html", "gone", "furniture")
    return both.mapInArrow(finish, f"id {both.schema['id'].dataType.simpleString()}, url string, text string, n_chars long, n_shared long")


def extraction_report(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumnRenamed("id", "page_id")
