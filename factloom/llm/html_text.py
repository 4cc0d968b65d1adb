"""Main text of web pages by differencing against the page of the nearest URL.

Each page is cut into lines, its blocks. Within a host, pages stand in the order
of their URL paths; a page is paired with the neighbours of other paths, the
nearer first, their lines are aligned by a longest common subsequence, and
lines that both have are template and go, unless the two pages are copies. Markup says
what differencing can't see: elements that never hold main text are left out. Names of classes are votes,
which the density of links and text confirms or overrules.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.order import running_total
from factloom.llm.tokens import small
from factloom.session import prepare

#: Two pages are copies if they share a greater part of the lines that the other neighbour doesn't share, and where there is no other neighbour.
COPIES, COPIES_ALONE = 0.5, 0.9

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text, read up to their end tag as it stands.
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
#: Elements that hold no main text.
_NEVER = frozenset("nav aside footer form menu dialog button select svg canvas object audio video head fieldset label input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class and id that mark menus, adverts, comments and the like in any name.
_MARKED = frozenset(
    "ads adv advert adverts advertisement advertising sponsor sponsored sponsors promoted "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager topbar footer colophon "
    "sidebar sidebars widgets related recommendations trending sharing "
    "comment comments commentlist disqus cookie cookies consent gdpr popup modal newsletter subscribe subscription".split()
)
#: Words that mark as a whole name; in longer names links or short lines must confirm it.
_WEAK = frozenset(
    "ad aside banner banners promo promotion toc header masthead widget recommended popular share social follow respond reply replies discussion "
    "notice notices alert alerts overlay signup login search form skip hidden complementary contentinfo dialog".split()
)
#: Words that make a name tell a state of a page rather than what an element is.
_STATE = frozenset("no not non without has have with enabled disabled on off open opened closed active supports is".split())
#: A marked element with so great a part of the text, and the title if the mark is plain, is the page's frame.
FRAME = 0.9
#: Part of an element's text in links, and mean length of its lines, that confirm a weak mark.
LINKS, SHORT = 1 / 3, 40
_TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", regex.S)
_MARKS = regex.compile(r"(?:\bclass|\bid|\brole)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", regex.I)
_HIDDEN = regex.compile(r"\bhidden\b(?!\s*=\s*\"?false)|display\s*:\s*none|aria-hidden\s*=\s*\"?true", regex.I)
_WORDS = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = regex.compile(r"\s+")

#: What surrounds a line: an article or main element, or neither.
ARTICLE, BODY = 1, 0


def _never(tag: str, attributes: str, in_article: bool) -> bool:
    return tag in _NEVER or tag == "header" and not in_article or bool(attributes) and bool(_HIDDEN.search(attributes)) and tag not in ("html", "body")


def _mark(attributes: str) -> int:
    """What the names of class, id and role say: 2 no main text, 1 perhaps none, 0 nothing."""
    out = 0
    for m in _MARKS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if _STATE.isdisjoint(words):
                if not _MARKED.isdisjoint(words) or len(words) == 1 and words[0] in _WEAK:
                    return 2
                out = max(out, not _WEAK.isdisjoint(words))
    return out


class _Region:
    """A marked block element: what it holds."""

    def __init__(self, parent: int, mark: int):
        self.parent, self.mark, self.chars, self.links, self.lines, self.heading, self.title, self.article = parent, mark, 0, 0, 0, False, False, False

    def is_out(self, total: int) -> bool:
        if self.article or self.chars > FRAME * total and (self.title or self.mark == 1):
            return False
        return self.mark == 2 or not self.heading and (self.links > LINKS * self.chars or self.chars < SHORT * self.lines)


def lines(page: str | None) -> list[tuple[str, int]]:
    """The page's blocks in order, as (text, ARTICLE or BODY), without those that never hold main text."""
    page = page or ""
    found: list[tuple[str, int, int]] = []  # text, zone, innermost region or -1
    held: list[str] = []
    open_tags: list[tuple[str, bool, int]] = []  # block elements: name, left out, region around it
    regions: list[_Region] = []
    shut = article = linked = 0
    region, in_link = -1, False
    at = 0

    def end_block() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                found.append((text, ARTICLE if article else BODY, region))
                r = region
                while r >= 0:
                    own = regions[r]
                    own.chars, own.links, own.lines, r = own.chars + len(text), own.links + min(linked, len(text)), own.lines + 1, own.parent
        linked = 0

    while True:
        m = _TOKEN.search(page, at)
        if not shut:
            held.append(piece := page[at : m.start() if m else len(page)])
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = not m[1]
            if m[1]:
                continue
        if m[1]:
            if tag in _RAW:
                continue
            if tag in _BLOCKS:
                end_block()
            names = [n for n, _, _ in open_tags]
            if tag in names:
                while open_tags:
                    if open_tags[-1][0] in _BLOCKS:
                        end_block()
                    name, out_of, region = open_tags.pop()
                    shut -= out_of
                    article -= name in ("article", "main")
                    if name == tag:
                        break
            continue
        if tag in _RAW:
            close = regex.compile(rf"</{regex.escape(tag)}\s*>", regex.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in _BLOCKS:
            end_block()
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag == "p" and open_tags and open_tags[-1][0] == "p":
            _, out_of, region = open_tags.pop()
            shut -= out_of
        out_of = _never(tag, m[3], article > 0)
        mark = _mark(m[3]) if m[3] and not out_of and tag not in ("html", "body", "article", "main") else 0
        if mark == 2 and tag not in _BLOCKS:  # an inline element is left out at once
            out_of = True
        if tag in _BLOCKS or out_of or shut and any(n == tag for n, _, _ in open_tags):
            if out_of and tag not in _BLOCKS and not shut:
                held.append(" ")
            open_tags.append((tag, out_of, region))
            shut += out_of
            article += tag in ("article", "main")
            if tag in ("h1", "h2", "h3", "article", "main") and not shut:
                r = region
                while r >= 0:
                    own = regions[r]
                    own.article |= tag in ("article", "main")
                    own.heading |= tag in ("h1", "h2", "h3")
                    own.title |= tag == "h1"
                    r = regions[r].parent
            if mark and tag in _BLOCKS and not shut:
                regions.append(_Region(region, mark))
                region = len(regions) - 1
    end_block()
    total = sum(len(t) for t, _, _ in found)
    out = [r.is_out(total) for r in regions]
    for i, r in enumerate(regions):  # parents come first
        out[i] = out[i] or r.parent >= 0 and out[r.parent]
    return [(t, zone) for t, zone, r in found if r < 0 or not out[r]]


#: Rows of the alignment that are kept at a time.
ROWS = 512


def common(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Equal ends are set aside. A row of the table of lengths is one integer, whose zero bits are the
    columns where the length grows, so a line costs a few operations on len(b) bits (Hyyro 2004); blocks of
    rows are computed again on the way back, so memory follows (ROWS + len(a) / ROWS) x len(b) bits.
    """
    n = min(len(a), len(b))
    lead = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - lead) if a[-1 - i] != b[-1 - i]), n - lead)
    out = set(range(lead)) | set(range(len(a) - tail, len(a)))
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    where: dict[int, int] = {}
    known = set(a)
    for j, x in enumerate(b):
        if x in known:
            where[x] = where.get(x, 0) | 1 << j
    if not where:
        return out
    every = (1 << len(b)) - 1

    def rows(v: int, lo: int, hi: int) -> list[int]:
        """The rows after each of the lines lo to hi."""
        got = []
        for x in a[lo:hi]:
            u = v & where.get(x, 0)
            v = (v + u | v - u) & every
            got.append(v)
        return got

    starts = [every]  # the row before each block
    for lo in range(0, len(a), ROWS):
        starts.append(rows(starts[-1], lo, min(lo + ROWS, len(a)))[-1])
    j = len(b)
    for block in range(len(starts) - 2, -1, -1):
        lo = block * ROWS
        own = [starts[block], *rows(starts[block], lo, min(lo + ROWS, len(a)))]
        i = len(own) - 1
        while i and j:
            if own[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if own[i] >> (j - 1) & 1:
                    out.add(lead + lo + i)
                    j -= 1
    return out


def _hashes(rows: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh32_intdigest(t.encode(errors="replace")) - (1 << 31) for t, _ in rows]


def template(own: list[int], neighbours: list[list[int]]) -> set[int]:
    """Positions of the lines that a page shares with its neighbours and that aren't a copy of one of them.

    What all neighbours share is template, however much it is, unless nothing else is left.
    """
    pairs = [common(own, other) for other in neighbours]
    everywhere = set.intersection(*pairs) if len(pairs) > 1 else set()
    rest = len(own) - len(everywhere)
    if not rest:
        return set()
    most = (COPIES if len(pairs) > 1 else COPIES_ALONE) * rest
    return everywhere.union(*(both for both in pairs if len(both - everywhere) <= most))


def main_text(page: str | None, neighbours: list[list[int]]) -> str:
    """Main text of a page, given the hashed lines of the pages nearest to it."""
    rows = lines(page)
    shared = template(_hashes(rows), neighbours)
    article = {i for i, (_, zone) in enumerate(rows) if zone == ARTICLE}
    if article <= shared:  # a copied article, whatever surrounds it
        shared -= article
    return "\n".join(t for i, (t, _) in enumerate(rows) if i not in shared)


def _neighbours(pages: DataFrame) -> DataFrame:
    """page_id and the hashed lines of up to two neighbours of other paths within the host, the nearer first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [_hashes(lines(p)) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(found, pa.list_(pa.int32()))], names=["page_id", "host", "path", "found"])

    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html").mapInArrow(read, "page_id long, host string, path string, found array<int>")
    # one page stands for each path of a host, so that neighbours are of other paths
    first = rows.groupBy("host", "path").agg(F.min_by("found", F.struct("page_id")).alias("found"))
    ranked, _ = running_total(first, ["host", "path"], None, "rank")
    side = lambda by, name: ranked.select((F.col("rank") + by).alias("rank"), F.struct("host", "path", "found").alias(name))
    near = ranked.select("rank", "host", "path").join(side(1, "before"), "rank", "left").join(side(-1, "after"), "rank", "left")

    def common_prefix(name: str):
        own, other = F.split("path", "/"), F.split(F.col(name)["path"], "/")
        pairs = F.zip_with(own, other, lambda x, y: x.eqNullSafe(y))
        return F.coalesce(F.array_position(pairs, False), F.lit(1 << 20))

    usable = lambda name: F.when(F.col(name)["host"] == F.col("host"), F.col(name)["found"])
    order = F.when(common_prefix("after") > common_prefix("before"), F.array(usable("after"), usable("before"))).otherwise(F.array(usable("before"), usable("after")))
    return near.select("host", "path", F.array_compact(order).alias("others"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty html gives an empty text. A null url, or one without a host,
    belongs to the host '' . A null page_id stays null. Pages of one host and path share their neighbours; repeated rows
    stay. An empty table gives no rows; other columns aren't read.
    """
    prepare(pages.sparkSession)
    near = _neighbours(pages).withColumnRenamed("host", "__host").withColumnRenamed("path", "__path")
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    rows = own.join(near, (own["host"] == near["__host"]) & (own["path"] == near["__path"]), "left").select("page_id", "url", "html", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = [main_text(p, o or []) for p, o in zip(b.column("html").to_pylist(), b.column("others").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
