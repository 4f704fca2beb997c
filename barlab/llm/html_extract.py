"""Main text of HTML pages, with site templates removed.

A page is read once, from left to right, into blocks of text under nested containers. Every container's subtree is
hashed with all it holds, menus and footers too; Spark counts, for each host, the distinct articles whose pages hold
a subtree, and subtrees on many of them, or on a good part of a small host's, are taken out of all pages of the host.
Articles are told apart by one of their blocks, drawn by length and alike for alike texts, so that copies of one, and most
often edited copies, don't make what they hold a template. Single paragraphs, headings and list items are never compared alone, so what several articles quote stays.

What elements and roles say (menus, headers, footers, sidebars, forms, scripts) and names of adverts, notices and reader
comments goes on a host's first page already. Other names only raise a doubt, which the container's own text decides
when it ends: a "navigation" that holds prose is a chapter on navigation. Parts of compound names count for short
containers. The main part is then chosen by its share of the page's text: articles where they hold most of it, else the
main element, else the page, so that a teaser in an article element doesn't stand for the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: A subtree is template on more than this many distinct articles of its host, however large the host; or on at least so
#: many and this part of the host's distinct articles.
TEMPLATE_PAGES, LEAST_PAGES, PART_OF_HOST = 10, 4, 0.2
#: Templates up to which they are broadcast (a host and 8 bytes each); beyond, both sides shuffle.
BROADCAST_ROWS = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose subtrees are compared across pages.
CONTAINERS = frozenset("aside details dialog div dl figure footer form header menu nav ol section table ul".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("nav footer aside form button select option iframe svg dialog menu head object canvas audio video template".split()) | RAW
DROPPED_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Class words and ids that mark what isn't text anywhere.
DROPPED_NAMES = frozenset(
    "ad ads adbox ad-box ad-slot ad-container ad-banner advert adverts advertisement advertising sponsored cookie-notice "
    "cookie-banner cookie-consent cookie-bar consent-banner gdpr newsletter newsletter-signup subscribe-form sidebar side-bar navbar "
    "breadcrumb breadcrumbs pagination pager site-header site-footer comment comments comment-list commentlist "
    "comments-area comments-section comment-section reader-comments user-comments disqus disqus_thread respond share-buttons share-bar "
    "social-share social-links".split()
)
#: Those that do so unless the container holds prose, anywhere and outside articles only.
DOUBTED_NAMES = frozenset("popup modal overlay nav navigation related-posts related-articles related-links".split())
OUTER_NAMES = frozenset(
    "menu notice notices banner cookie cookies consent header footer masthead page-header page-footer promo promotion sponsor social share "
    "sharing related recommended search login signup toolbar subscribe subscription discussion replies alert".split()
)
#: Parts of compound names that mark a short container; and, of one that doesn't hold most of the page, reader comments.
DROPPED_PARTS = frozenset("ad ads advert adverts advertisement promo sponsor sponsored cookie cookies consent newsletter".split())
COMMENT_PARTS = frozenset("comment comments".split())
#: Characters of a short container. Prose: blocks that end as sentences do, of at least so many words and mostly outside links;
#: so many characters of it, and half of a container's text, make a container prose inside an article, and outside.
SHORT, WORDS, PROSE_INSIDE, PROSE_OUTSIDE = 400, 8, 60, 250
#: What part of the main element's (or the page's) text articles must hold to stand for it, what part of the page's the main
#: element must hold, and what part of the largest article's another one must, to be no teaser.
OF_MAIN, OF_PAGE, MAIN_OF_PAGE, OF_LARGEST = 0.8, 0.5, 0.3, 0.1
#: Elements of prose: names on them tell nothing.
PROSE = frozenset("a abbr b blockquote body cite code em h1 h2 h3 h4 h5 h6 html i main mark p pre q s small strong sub sup td th tr u".split())
#: An opening tag of these ends an open element of the same group first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = frozenset("article body div html main ol section table td th ul dl".split())
_WALLS_OF = {tag: tuple(sorted(_WALLS.difference(CLOSES.get(tag, ())))) for tag in BLOCKS}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^\"'>]*")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>]|$)", re.I) for name in RAW}


_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]]*$")
_PARTS = re.compile(r"[-_]+")


def _judged(tag: str, attributes: str, inside: bool) -> str:
    """What an element's name says of it: "gone", "doubted", "short" or "comment" (gone if its text bears that out), or nothing;
    ``inside``: within an article or the main part."""
    if tag in DROPPED or tag == "header" and not inside:
        return "gone"
    found = ""
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        words = "".join(values).lower().split()
        if name.lower() == "role":
            if not DROPPED_ROLES.isdisjoint(words) or "banner" in words and not inside:
                return "gone"
            continue
        if tag == "article":
            if "comment" in words:
                return "gone"
            continue
        parts = {part for w in words for part in _PARTS.split(w)}
        if tag in PROSE:
            # What marks a paragraph as an advert or a notice doesn't make a long one.
            found = found or ("short" if not parts.isdisjoint(DROPPED_PARTS) and tag not in ("html", "body", "main") else "")
        elif not DROPPED_NAMES.isdisjoint(words):
            return "gone"
        elif not DOUBTED_NAMES.isdisjoint(words) or not inside and not OUTER_NAMES.isdisjoint(words):
            found = "doubted"
        elif not parts.isdisjoint(COMMENT_PARTS):
            found = found or "comment"
        elif not parts.isdisjoint(DROPPED_PARTS):
            found = found or "short"
    return found


class Page:
    """texts: the blocks in page order, with what holds them: 0 dropped, 1 the page, 2 the main part, 3 an article (with the
    number of the outermost one, or -1, in articles). containers: digest, first block and block past the last of each container
    with text. doubts: what a name says, whether inside an article or main part, first block and block past the last of each
    container whose text decides. Work is linear in the page."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.holders: list[int] = []
        self.articles: list[int] = []
        self.mains: list[bool] = []
        self.prose: list[bool] = []
        self.doubts: list[tuple[str, bool, int, int]] = []
        self.article, self.number, self.linked, self.in_main = -1, 0, 0, 0
        self.named: list[tuple[int, str, bool]] = []  # depth, judgement and whether inside, of open containers in doubt
        self.containers: list[tuple[int, int, int]] = []
        # tag, holder, first block, parts of the innermost container
        self.stack: list[tuple[str, int, int, list]] = [("", 1, 0, [])]
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
        self.blocks: list[int] = []
        self.words: list[str] = []
        self.scan(source)
        while len(self.stack) > 1:
            self.pop()
        self.flush()

    def scan(self, s: str) -> None:
        at, n, quotes, text = 0, len(s), True, 0
        # ``text``: where the text node being read begins.
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                break
            after = s[lt + 1 : lt + 2]
            closing = after == "/"
            name = _NAME.match(s, lt + 1 + closing)
            if not name and after not in ("!", "?") and not (closing and s[lt + 2 : lt + 3] == ">"):
                at = lt + 1  # a sign of text
                continue
            self.said(s, text, lt)
            if not name:
                end = s.find("-->", lt + 4) + 2 if s.startswith("<!--", lt) else s.find(">", lt)
                if end < 2:
                    return
                at = text = end + 1
                continue
            end = self.tag_end(s, name.end(), n) if quotes else s.find(">", name.end())
            if end < 0 and quotes:  # a quote that never ends: from here on the first ">" ends a tag
                quotes = False
                end = s.find(">", name.end())
            if end < 0:
                return
            tag = name[0].lower()
            at = text = end + 1
            if closing:
                self.end(tag)
                continue
            attributes = s[name.end() : end]
            self.start(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                close = _RAW_END[tag].search(s, at)
                if not close:
                    return
                at = text = close.start()
        self.said(s, text, n)

    @staticmethod
    def tag_end(s: str, i: int, n: int) -> int:
        """The ">" that ends a tag, quoted values left out; -1 without one."""
        while True:
            i = _PLAIN.match(s, i).end()
            if i >= n:
                return -1
            if s[i] == ">":
                return i
            if s[i - 1] == "=" or s[i - 1].isspace() and s[max(0, i - 40) : i].rstrip().endswith("="):
                i = s.find(s[i], i + 1)
                if i < 0:
                    return -1
            i += 1

    def said(self, s: str, begin: int, end: int) -> None:
        """A text node; its character references are its own."""
        if end > begin:
            self.words.append(entities.unescape(s[begin:end]))
            if self.open["a"]:
                self.linked += end - begin

    def flush(self) -> None:
        line = " ".join("".join(self.words).split())
        self.words.clear()
        if line:
            _, holder, _, parts = self.stack[-1]
            self.texts.append(line)
            self.holders.append(holder)
            self.articles.append(self.article if holder == 3 else -1)
            self.mains.append(self.in_main > 0)
            self.prose.append(bool(_SENTENCE.search(line)) and line.count(" ") >= WORDS - 1 and 2 * self.linked < len(line))
            parts.append(line)
        self.linked = 0

    def last(self, tags: tuple[str, ...]) -> int:
        """The innermost open element of these."""
        return max([places[-1] for places in map(self.open.get, tags) if places], default=0)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            group = CLOSES.get(tag, ())
            wall = self.last(_WALLS_OF[tag])
            if group:
                places = [p[bisect_right(p, wall)] for p in (self.open[t] for t in (*group, "p")) if p and p[-1] > wall]
                self.pop_to(min(places, default=len(self.stack)))
            elif self.open["p"] and self.open["p"][-1] > wall:
                self.pop_to(self.open["p"][-1])
        elif tag in VOID:
            self.words.append(" ")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            return
        _, holder, _, parts = self.stack[-1]
        said = _judged(tag, attributes, holder > 1) if holder else ""
        if said == "gone":
            if tag not in BLOCKS:
                self.flush()
            holder = 0
        elif holder and (tag == "article" or holder == 3):
            if holder != 3:
                self.article, self.number = self.number, self.number + 1
            holder = 3
        elif holder and (tag == "main" or re.search(r"(?<![\w-])role\s*=\s*[\"']?main\b", attributes, re.I)):
            holder = 2
        if said and said != "gone" and (tag in BLOCKS or tag not in PROSE):
            if tag not in BLOCKS:
                self.flush()
            self.named.append((len(self.stack), said, self.stack[-1][1] > 1))
        if holder == 2 != self.stack[-1][1]:
            self.in_main += 1
        self.open[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, holder, len(self.texts), [] if tag in CONTAINERS else parts))

    def pop(self) -> None:
        tag, holder, first, parts = self.stack[-1]
        doubted = self.named and self.named[-1][0] == len(self.stack) - 1
        if tag in BLOCKS or doubted or holder == 0 != self.stack[-2][1]:
            self.flush()
        if doubted:
            _, said, inside = self.named.pop()
            if len(self.texts) > first:
                self.doubts.append((said, inside, first, len(self.texts)))
        self.stack.pop()
        if holder == 2 != self.stack[-1][1]:
            self.in_main -= 1
        self.open[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        if tag in CONTAINERS and len(self.texts) > first:
            digest = xxhash.xxh64_intdigest("\n".join([tag, *parts])) - (1 << 63)
            self.containers.append((digest, first, len(self.texts)))
            self.stack[-1][3].append(f"\t{digest}")

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.pop()

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        places = self.open[tag]
        if places and (tag in BLOCKS or not self.blocks or places[-1] > self.blocks[-1]):
            self.pop_to(places[-1])

    def main(self) -> np.ndarray:
        """The numbers of the blocks of the main part."""
        holders, articles, mains = np.array(self.holders, np.int64), np.array(self.articles, np.int64), np.array(self.mains, bool)
        sizes = np.array([len(t) for t in self.texts], np.int64) * (holders > 0)
        self._decide(holders, sizes)
        sizes *= holders > 0
        own = articles >= 0
        of_article = np.bincount(articles[own], sizes[own], minlength=self.number) if own.any() else np.zeros(0)
        kept = own & (holders > 0)
        if len(of_article):
            kept[own] &= of_article[articles[own]] >= OF_LARGEST * of_article.max()
        in_main = mains & (holders > 0)
        page, held, main = sizes.sum(), sizes[kept].sum(), sizes[in_main].sum()
        if held and (held >= OF_MAIN * main if main and not (kept & ~in_main).any() else held >= OF_PAGE * page):
            return np.flatnonzero(kept)
        scope = in_main if main and main >= MAIN_OF_PAGE * page else holders > 0
        if len(of_article):  # small articles without prose are teasers
            told = np.bincount(articles[own], np.array(self.prose, bool)[own], minlength=self.number)
            scope[own] &= ((of_article >= OF_LARGEST * sizes[scope].sum()) | (told > 0))[articles[own]]
        return np.flatnonzero(scope)

    def _decide(self, holders: np.ndarray, sizes: np.ndarray) -> None:
        """Drops the containers in doubt whose text doesn't clear them. Running sums make each a difference of two."""
        if not self.doubts:
            return
        chars = np.concatenate([[0], np.cumsum(sizes)])
        prose = np.concatenate([[0], np.cumsum(sizes * np.array(self.prose, bool))])
        edges = np.zeros(len(holders) + 1, np.int64)
        for said, inside, first, past in self.doubts:
            n, told = chars[past] - chars[first], prose[past] - prose[first]
            if said == "doubted":
                gone = 2 * told < n or told < (PROSE_INSIDE if inside else PROSE_OUTSIDE)
            else:
                gone = n <= SHORT if said == "short" else 2 * n <= chars[-1]
            if gone:
                edges[first] += 1
                edges[past] -= 1
        holders[np.cumsum(edges[:-1]) > 0] = 0


def article_of(blocks: list[str]) -> int:
    """A hash of one block, each drawn with a chance by its length: texts that share most of their blocks' characters share it
    most often, ones that share a quote or a box seldom."""
    hashes = [xxhash.xxh64_intdigest(b) for b in blocks]
    drawn = min(range(len(blocks)), key=lambda k: -math.log((hashes[k] + 1) / 2.0**64) / len(blocks[k]), default=None)
    return 0 if drawn is None else hashes[drawn] - (1 << 63)


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


_PARSED = "page_id bigint, url string, host string, main_hash bigint, blocks array<string>, containers array<struct<digest:bigint,first:int,past:int>>"
_CONTAINER = pa.list_(pa.struct([("digest", pa.int64()), ("first", pa.int32()), ("past", pa.int32())]))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its main blocks, and its containers by their stretch of main blocks (empty, where they hold none)."""
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            hashes, blocks, containers = [], [], []
            for source in batch.column(3).to_pylist():
                page = Page(source)
                main = page.main()
                own = [page.texts[i] for i in main]
                spans = [(d, *np.searchsorted(main, (a, b)).tolist()) for d, a, b in page.containers]
                hashes.append(article_of(own))
                blocks.append(own)
                containers.append([dict(zip(("digest", "first", "past"), x)) for x in spans])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(hashes, pa.int64()), pa.array(blocks, pa.list_(pa.string())), pa.array(containers, _CONTAINER)],
                ["page_id", "url", "host", "main_hash", "blocks", "containers"],
            )


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the blocks of template containers."""
    for batch in batches:
        out = []
        for blocks, containers, templates in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            edges, gone = np.zeros(len(blocks) + 1, np.int64), frozenset(templates or ())
            for c in containers if gone else ():
                if c["digest"] in gone:
                    edges[c["first"]] += 1
                    edges[c["past"]] -= 1
            out.append("\n\n".join(b for b, inside in zip(blocks, np.cumsum(edges).tolist()) if not inside))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def site_templates(parsed: DataFrame, limit: int = TEMPLATE_PAGES, least: int = LEAST_PAGES, part: float = PART_OF_HOST) -> DataFrame:
    """``parsed``: host, main_hash (of article_of), containers. The subtrees (host, digest) on more than
    ``limit`` distinct articles of a host, or on ``least`` and a ``part`` of them, with their number as ``pages``."""
    held = parsed.select("host", "main_hash", F.explode(F.array_distinct("containers.digest")).alias("digest")).distinct()
    counts = held.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min(least, limit + 1))
    hosts = parsed.select("host", "main_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    many = (F.col("pages") > limit) | (F.col("pages") >= least) & (F.col("pages") >= part * F.col("articles"))
    return counts.join(hosts, "host").where(many).select("host", "digest", "pages")


def extracted(
    pages: DataFrame, page_html: str = "html", key: str = "page_id", url: str = "url", limit: int = TEMPLATE_PAGES, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (blocks joined by two line feeds).

    A null or empty page has the empty text. A null id or url comes back as null; pages without a host in their url
    share one. Copies of an article, edited or not, count once towards their host. Repeated rows are answered alike, and other
    columns are ignored; an empty table gives no rows."""
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), _host(F.col(url)).alias("host"), F.coalesce(F.col(page_html), F.lit("")).alias("html")
    )
    parsed = staged(rows.mapInArrow(_parsed, _PARSED), "pages")
    templates = staged(site_templates(parsed, limit), "templates")
    if templates.limit(broadcast_rows + 1).count() <= broadcast_rows:
        of_host = templates.groupBy("host").agg(F.collect_list("digest").alias("known"))
        joined = parsed.join(F.broadcast(of_host), "host", "left").withColumn("templates", F.array_intersect("containers.digest", "known"))
    else:
        digests = parsed.select("host", "main_hash", F.explode(F.array_distinct("containers.digest")).alias("digest")).distinct()
        of_page = digests.join(templates, ["host", "digest"]).groupBy("host", "main_hash").agg(F.collect_set("digest").alias("templates"))
        joined = parsed.join(of_page, ["host", "main_hash"], "left")
    return joined.select("page_id", "url", "blocks", "containers", "templates").mapInArrow(_assembled, "page_id bigint, url string, text string")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
