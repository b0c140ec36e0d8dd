"""Operator 10: main text of web pages, by removal of what a site's pages have in common.

Every element is hashed with all it holds; Spark counts on how many different pages of a host each hash occurs; those
that recur are cut out of the pages, inside articles too, and with them what markup itself declares to be no article.
"""

from __future__ import annotations

import html as references
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import runs_of, stored

#: An element is a template's if it stands on this many different pages of a host or more, and on this share of them.
PAGES, SHARE = 5, 0.1
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Element names by their part in a page.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes svg math object".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("head nav header footer aside form menu dialog button select datalist fieldset audio video canvas".split())
MAIN = set("article main".split())
#: Whole class names, ids and roles of what is no article text.
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "cookie-banner cookie-notice consent newsletter popup modal comments comment-list disqus_thread share sharing pagination search complementary contentinfo "
    "user-comments reader-comments commentlist comments-list comments-area comments-section comment-section comment-thread comment-form comment-respond respond discussion replies "
    "share-buttons share-bar social-share social-sharing social-links subscribe subscribe-box newsletter-signup related related-posts related-articles read-more-links recommended".split()
)
#: Elements whose text may be that of many articles on its own: inside an article they are cut only with what holds them.
TEXT = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead caption pre blockquote figcaption html body".split()) | INLINE | MAIN
#: Elements that no name of theirs leaves out.
KEPT = set("html body h1 h2 h3 h4 h5 h6".split()) | MAIN
ENDS_P = set("p div ul ol table section article h1 h2 h3 h4 h5 h6 blockquote pre footer nav aside header form".split())
#: Within which elements the end of another one is looked for; "" is for all that have no line of their own.
LIMITS = {"p": frozenset("article section div body td li".split()), "li": frozenset("ul ol menu".split()), "": frozenset("article main body".split())}


@dataclass(slots=True)
class Open:
    tag: str
    first: int  # piece
    filled: int  # pieces with text before it
    dropped: bool
    inside: bool  # of an article
    parts: list[bytes]  # of its hash: texts and the hashes of its elements


class Page:
    """A page's text pieces in order, and its elements as ranges of pieces. Time and space grow with the length alone:
    an element's hash is made of its children's."""

    def __init__(self, source: str | None):
        self.pieces: list[str] = []  # text as it stands; "\n" between blocks
        self.dropped: list[bool] = []
        self.inside: list[bool] = []  # of an article
        self.elements: list[tuple[int, int, int]] = []  # first piece, end, hash
        self.filled = 0
        self.stack: list[Open] = [Open("", 0, 0, False, False, [])]
        #: Open elements by name, and those since the last limit.
        self.all: Counter[str] = Counter()
        self.since: dict[str, list[Counter[str]]] = {k: [Counter()] for k in LIMITS}
        self.read(source or "")

    def add(self, piece: str) -> None:
        top = self.stack[-1]
        self.pieces.append(piece)
        self.dropped.append(top.dropped)
        self.inside.append(top.inside)
        if piece != "\n" and (words := piece.split()):
            self.filled += 1
            top.parts.append(" ".join(words).encode())

    def open(self, tag: str, attributes: str) -> None:
        values = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower().split()) for m in ATTRIBUTE.finditer(attributes)] if attributes.strip() else []
        if tag not in INLINE:
            self.add("\n")
            if tag in ENDS_P:
                self.close("p", "p")
            if tag == "li":
                self.close("li", "li")
        if tag in VOID:
            return
        above = self.stack[-1]
        main = tag in MAIN or ("role", ["main"]) in values
        titles = tag == "header" and above.inside  # an article's own heading
        named = tag not in KEPT and any(DROPPED_WORDS.intersection(words) for _, words in values)
        dropped = above.dropped or (tag in DROPPED and not titles) or named
        self.stack.append(Open(tag, len(self.pieces), self.filled, dropped, above.inside or (main and not dropped), [tag.encode()]))
        self.all[tag] += 1
        for kind, counts in self.since.items():
            counts[-1][tag] += 1
            if tag in LIMITS[kind]:
                counts.append(Counter())

    def close(self, tag: str, kind: str | None) -> None:
        """Ends the last open element of this name, and all in it; one beyond a limit stays open."""
        if (self.all if kind is None else self.since[kind][-1])[tag]:
            while self.pop() != tag:
                pass

    def pop(self) -> str:
        e = self.stack.pop()
        digest = xxhash.xxh64_digest(b"\0".join(e.parts), 7)
        self.stack[-1].parts.append(digest)
        self.all[e.tag] -= 1
        for kind, counts in self.since.items():
            if e.tag in LIMITS[kind]:
                counts.pop()
            counts[-1][e.tag] -= 1
        if self.filled > e.filled and (e.tag not in TEXT or not e.inside and e.tag not in ("html", "body")):
            self.elements.append((e.first, len(self.pieces), int.from_bytes(digest, "big", signed=True)))
        if e.tag not in INLINE:
            self.add("\n")
        return e.tag

    def read(self, source: str) -> None:
        at, lower, last = 0, None, source.rfind(">")
        while at < len(source):
            m = TAG.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
            if m is None:
                self.add(source[at:])
                break
            if m.start() > at:
                self.add(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            attributes = m[3] or m[6] or ""
            if m[1] or m[4]:
                if self.all[tag]:
                    self.close(tag, None if tag in LIMITS[""] or tag == "html" else "")
                elif tag not in INLINE:
                    self.add("\n")
            elif tag in RAW:
                # The slash of <script/> ends nothing; that of foreign elements does.
                if not (tag in ("svg", "math") and attributes.endswith("/")):
                    lower = source.lower() if lower is None else lower
                    end = lower.find(f"</{tag}", at)
                    end = len(source) if end < 0 else end
                    at = source.find(">", end) + 1 or len(source)
            else:
                self.open(tag, attributes)
        while len(self.stack) > 1:
            self.pop()

    def hashes(self) -> set[int]:
        return {h for _, _, h in self.elements}

    def likeness(self) -> int:
        """A hash of the article's text, or of all text where there is none: pages that share it are one page."""
        main = any(self.inside)
        text = " ".join(" ".join(p.split()) for p, i in zip(self.pieces, self.inside, strict=True) if i or not main)
        return int.from_bytes(xxhash.xxh64_digest(" ".join(text.split()), 8), "big", signed=True)

    def text(self, template: set[int]) -> str:
        """What is left, in blocks joined by one blank. If the page has an article, only what stands in one."""
        step = [0] * (len(self.pieces) + 1)
        for first, end, h in self.elements if template else ():
            if h in template:
                step[first] += 1
                step[end] -= 1
        main = any(self.inside)
        left = "".join(references.unescape(p) if p != "\n" else p for p, c, i, n in zip(self.pieces, self.dropped, self.inside, itertools.accumulate(step), strict=False) if not n and not c and (i or not main) or p == "\n")
        return " ".join(left.split())


#: The row that stands for a page among those of its elements.
PAGE = 0


def templates(rows: DataFrame, least_pages: int, share: float) -> DataFrame:
    """(site, cut): for each host (site, by hash) the hashes of its template's elements.

    Pages of a host with the same article (or text) count once. As an element of a template stands on `share` of a
    host's pages, there are no more of them than a page has elements, divided by `share`.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "html", 4 << 20):
            sites, likes, found = [], [], []
            for site, html in zip(batch.column("site").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(html)
                own = [PAGE, *page.hashes()]
                sites += [site] * len(own)
                likes += [page.likeness()] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (sites, likes, found)], ["site", "page", "h"])

    found = rows.where("site IS NOT NULL").select("site", "html").mapInArrow(hashes, "site bigint, page bigint, h bigint")
    counts = stored(found.distinct().groupBy("site", "h").agg(F.count("*").alias("n")).where((F.col("n") >= least_pages) | (F.col("h") == PAGE)))
    pages = counts.where(F.col("h") == PAGE).select("site", F.col("n").alias("pages"))
    many = counts.where(F.col("h") != PAGE).join(pages, "site").where(F.col("n") >= share * F.col("pages"))
    return stored(many.groupBy("site").agg(F.collect_list("h").alias("cut")))


def host_of(url: Column) -> Column:
    """As split_url's, null where there is none."""
    return F.nullif(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), F.lit(""))


def extract(pages: DataFrame, least_pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) per row of (page_id, url, html).

    Null or empty html gives an empty text. A page whose url has no host belongs to no site and keeps what markup
    leaves of it. Rows with the same url and html have the same text; null ids are rows like others. Pages with the same
    article count as one, so copies of an article on a site keep their text; inside an article only containers are cut
    for recurring, not single paragraphs, headings, list items or cells. A page without <article> or <main> is what is
    left of its body.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    site = F.when(host_of(F.col("url")).isNotNull(), F.xxhash64(F.translate(host_of(F.col("url")), letters, letters.lower())))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", site.alias("site"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, "html", 4 << 20):
            out = [Page(html).text(set(cut or ())) for html, cut in zip(batch.column("html").to_pylist(), batch.column("cut").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.join(templates(rows, least_pages, share), "site", "left").select("page_id", "url", "html", "cut").mapInArrow(texts, "page_id bigint, url string, text string, n_chars bigint")
