"""Main text of web pages, after removal of what the pages of a site have in common.

Every element of a page gets a hash of its subtree: tag, texts and the hashes of its
children, without attributes. Spark counts on how many different pages of a host each hash
occurs, and subtrees that recur on at least ``LEAST_PAGES`` of them, however many pages the
host has, are deleted: menus, notices, footers and the like, whatever their markup. Pages are
different, for a subtree, if their headlines outside of it are, or without such their longest
texts: copies and near copies of a page share these and are one page here, so they never vote
for their own text, under however many URLs they stand.

Inside an ``article`` only containers (``BOXES``) can be templates, at the same path of tags
below the article: a share bar or a call to subscribe recurs as a box in its place, while what
articles quote from each other are paragraphs and quotations. Elements that say themselves
that they are no content (``NO_CONTENT`` tags, ``NO_CONTENT_NAMES`` in class, id or role)
go too, so that sites of a few pages are cleaned as well; inside an article only if they say
nothing else. What is left of the articles, else of ``main``, else of the page, is the text.

A page meets only those templates that it holds, at most as many as it has subtrees. Pages and
their lists meet by a hash of URL and source, so a host with a third of all pages is spread
over all tasks.

Defined cases: a null page is empty and gives an empty text; a URL without host belongs to the
host ''; repeated rows count as one page and get the same text; end tags may be missing; a
page cut off in a tag ends there; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.llm.registry import query

LEAST_PAGES = 5

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FORMATTING = frozenset("a b big code em font i s small strike strong tt u span".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = frozenset("html body article main section div table td th ul ol dl blockquote aside nav header footer form".split())
# Tags and names that mark what is not the article.
NO_CONTENT = frozenset("head script style noscript template iframe nav footer aside form button select textarea dialog menu svg object noembed noframes".split())
NO_CONTENT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer comment comments disqus replies share sharing social related recommended newsletter subscribe signup login popup modal skip toolbar pagination".split()
)
OUTER_NAMES = frozenset("header masthead topbar".split())
NEUTRAL_NAMES = frozenset("bar block box button buttons container group inner links list module section widget wrap wrapper".split())
BOXES = frozenset("aside center details div dl fieldset figure footer form header nav ol section ul".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)(?:>|$)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_HOST = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


class Element:
    """An open element: what its subtree hash is made of, and where its texts begin."""

    __slots__ = ("tag", "parts", "first", "dropped", "path", "text")

    def __init__(self, tag: str, first: int, dropped: bool, path: str | None) -> None:
        # path: tags from the article down to here, None outside.
        self.tag, self.parts, self.first, self.dropped, self.path, self.text = tag, [], first, dropped, path, False


class PageReader:
    """Reads one page. ``subtrees``: hashes of closed blocks that can be templates and have text, with the range of texts they hold. ``blocks``: texts that are kept, with the region they lie in."""

    def __init__(self, source: str, templates: frozenset[int] | set[int] = frozenset()) -> None:
        self.templates = templates
        self.subtrees: dict[int, tuple[int, int]] = {}
        self.blocks: list[tuple[int, str]] = []  # region: 2 article, 1 main, 0 elsewhere
        self.headlines: set[int] = set()  # numbers of the texts of first-order headings
        self.open: list[Element] = [Element("", 0, False, None)]
        self.region = [0]
        self.line: list[str] = []
        self._read(source)

    def _flush(self) -> None:
        if self.line:
            text = " ".join("".join(self.line).split())
            self.line.clear()
            if text:
                self.blocks.append((self.region[-1], text))

    def _close(self) -> None:
        inline = self.open[-1].tag in INLINE
        if not inline:
            self._flush()
        element = self.open.pop()
        self.region.pop()
        if element.tag == "h1":
            self.headlines.update(range(element.first, len(self.blocks)))
        digest = hashlib.blake2b("\x00".join([element.tag, *element.parts]).encode("utf-8", "replace"), digest_size=8).digest()
        parent = self.open[-1]
        parent.parts.append(digest.hex())
        parent.text |= element.text
        if element.text and not inline and (element.tag in BOXES if element.path is not None else element.tag not in ("html", "body", "article", "main")):
            key = int.from_bytes(digest, "little", signed=True)
            if element.path is not None:
                key ^= site_hash("article/" + element.path)
            low, high = self.subtrees.get(key, (element.first, element.first))
            self.subtrees[key] = min(low, element.first), max(high, len(self.blocks))
            if key in self.templates:
                del self.blocks[element.first :]
                self.headlines = {k for k in self.headlines if k < element.first}

    def _pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self._close()

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        """Place of the innermost open element of these tags before a barrier."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                return at
            if self.open[at].tag in BARRIERS:
                return 0
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P and (at := self._last({"p"})):
            self._pop_to(at)
        if tag in CLOSES and (at := self._last(CLOSES[tag])):
            self._pop_to(at)
        if tag not in INLINE:
            self._flush()
        parent = self.open[-1]
        if tag in VOID:
            parent.parts.append(tag)
            if tag == "br":
                self.line.append(" ")
            return
        names: set[str] = set()
        if attributes:
            for value in _NAMES.findall(attributes):
                names.update(_SPLIT.split(value.lower()))
        inside = parent.path is not None or parent.tag == "article"
        path = f"{parent.path or ''}/{tag}" if inside else None
        named = bool(names & NO_CONTENT_NAMES) and (not inside or names - {""} <= NO_CONTENT_NAMES | NEUTRAL_NAMES)
        dropped = parent.dropped or tag in NO_CONTENT or named and tag not in ("html", "body", "article", "main")
        if not inside and (tag == "header" or names & OUTER_NAMES and tag not in ("html", "body", "article", "main")):
            dropped = True
        region = 2 if tag == "article" else 1 if tag == "main" or "main" in names and "role" in attributes.lower() else 0
        self.open.append(Element(tag, len(self.blocks), dropped, path))
        self.region.append(max(self.region[-1], region))

    def _end(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                break
            if tag in FORMATTING and self.open[at].tag not in INLINE:
                return  # crossed nesting: the block stays open
            if self.open[at].tag in ("article", "body") and tag not in ("html", "body", "article", "main"):
                return
        else:
            return
        self._pop_to(at)

    def _text(self, text: str) -> None:
        plain = html.unescape(text) if "&" in text else text
        element = self.open[-1]
        if plain.strip():
            element.text = True
            element.parts.append(" ".join(plain.split()))
        if not element.dropped:
            self.line.append(plain)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = _TOKEN.search(source, at)
            if not found:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            name = found.group(1)
            if not name:
                continue
            tag = name.lower()
            if source.startswith("</", found.start()):
                self._end(tag)
                continue
            self._start(tag, found.group(2) or "")
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                at = end.start() if end else size  # such texts are never part of the page's
        self._pop_to(1)
        self._flush()

    def votes(self) -> Iterator[tuple[int, int]]:
        """Each subtree with a hash of what tells the page from others outside of it: its
        headline, else its longest text."""
        order = sorted(range(len(self.blocks)), key=lambda k: (k not in self.headlines, -len(self.blocks[k][1]), k))
        hashes: dict[int, int] = {}
        for key, (low, high) in self.subtrees.items():
            at = next((k for k in order if not low <= k < high), -1)
            if at not in hashes:
                text = self.blocks[at][1] if at >= 0 else ""
                hashes[at] = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
            yield key, hashes[at]

    def main_text(self) -> str:
        best = max((region for region, _ in self.blocks), default=0)
        return " ".join(text for region, text in self.blocks if region == best)


def site_hash(host: str) -> int:
    """Subtrees of a host are told from those of others by exclusive or with this."""
    return int.from_bytes(hashlib.blake2b(host.encode("utf-8", "replace"), digest_size=8, person=b"host").digest(), "little", signed=True)


def page_subtrees(pages: DataFrame, page: str = "page", url: str = "url", source: str = "html") -> DataFrame:
    """``page``, a hash of the page's ``content`` outside, and ``subtree``, the hash of subtree and
    host, for every different subtree of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, contents, hashes = [], [], []
            for key, link, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                read, site = PageReader(text or ""), site_hash(host_of(link))
                for subtree, outside in read.votes():
                    keys.append(key)
                    contents.append(outside)
                    hashes.append(subtree ^ site)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, contents, hashes)], names=["page", "content", "subtree"])

    return pages.select(page, url, source).mapInArrow(run, "page long, content long, subtree long")


def extract(pages: DataFrame, url: str = "url", source: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """The pages' own columns with ``text`` in place of the source and of such a column."""
    spark = pages.sparkSession
    key = F.xxhash64(F.col(url), F.col(source))
    keyed = pages.withColumn("_page", key)
    found = page_subtrees(keyed, "_page", url, source)
    counts = found.select("subtree", "content").distinct().groupBy("subtree").agg(F.count("*").alias("n"))
    common = counts.where(F.col("n") >= least_pages).select(F.col("subtree").alias("s"))
    lists = found.select("page", "subtree").join(common, F.col("subtree") == F.col("s")).groupBy(F.col("page").alias("_of_page")).agg(F.collect_set("subtree").alias("_templates"))
    joined = keyed.join(lists, F.col("_page") == F.col("_of_page"), "left")
    others = [c for c in pages.columns if c not in (source, "text")]
    ordered = joined.select(source, "_templates", F.col(url).alias("_url"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, known, link in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                site = site_hash(host_of(link)) if known else 0
                texts.append(PageReader(text or "", frozenset(subtree ^ site for subtree in known or ())).main_text())
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(texts, pa.string())], names=[*others, "text"])

    schema = spark.createDataFrame([], pages.schema).select(*others).withColumn("text", F.lit("").cast("string")).schema
    return ordered.mapInArrow(run, schema)


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
