"""Main text of web pages, with the parts of a site's template removed.

Element subtrees are hashed and counted per host. A subtree that recurs on most
pages of a host, whatever else is on those pages, belongs to the site's template
and is deleted, as are elements whose name, role or class says that they are
menus, notices, forms and the like.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, small_batches

#: A subtree on more than this share of the different pages of one host is part of the template ...
SHARE = 0.5
#: ... if it is on this many; two pages do not tell a template from a quote.
LEAST_PAGES = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not page text at all.
RAW = frozenset("script style noscript template textarea title iframe svg math object select canvas".split())
HEAD_ONLY = frozenset("meta link base title style script noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: A new one of these ends an open one.
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
#: ... but not outside one of these.
SCOPES = frozenset("ul ol menu dl table article main section div aside nav body html".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
SIDE_ELEMENTS = frozenset("nav aside footer form button menu dialog".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu alertdialog".split())
SIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside rail cookie cookies consent gdpr notice notices banner "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social widget related "
    "recommended comment comments disqus respond replies reply toolbar pagination pager skip".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    """Host in lower case; empty for null and for what is no absolute URL."""
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


class Node:
    __slots__ = ("before", "first_block", "main", "parts", "side", "tag")

    def __init__(self, tag: str, side: bool, main: bool, first_block: int) -> None:
        self.tag, self.side, self.main, self.first_block = tag, side, main, first_block
        self.parts: list[str] = []
        #: Text of the block around an inline element that is left out.
        self.before: list[str] = []


def _is_side(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is, by its own mark, not part of an article."""
    if tag in SIDE_ELEMENTS or tag == "header" and not in_main:
        return True
    if not attributes:
        return False
    for found in ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if name in ("class", "id") and tag not in ("body", "html"):
            words = WORDS.findall(value)
            if not SIDE_WORDS.isdisjoint(words) and not (in_main and tag == "header"):
                return True
        elif name == "role" and value in SIDE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def _hash(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


class Page:
    """Blocks of one page in order, and the hashes of its element subtrees.

    ``template`` holds hashes of subtrees to delete; None is a page read alone, without
    knowledge of its host. Outside an article, a text beside elements is a subtree too.
    A paragraph, heading or list item of an article is never deleted for recurring by
    itself: that is quoted text.
    """

    def __init__(self, html: str | None, template: frozenset[int] | None = None) -> None:
        self.alone = template is None
        self.template = template or frozenset()
        self.blocks: list[tuple[str, bool]] = []
        self.hashes: set[int] = set()
        self.has_main = False
        self.buffer: list[str] = []
        self.stack = [Node("", False, False, 0)]
        self._read(html or "")

    def _flush(self) -> None:
        if not self.buffer:
            return
        text = SPACE.sub(" ", entities.unescape("".join(self.buffer))).strip()
        self.buffer.clear()
        top = self.stack[-1]
        if text:
            top.parts.append(text)
            recurs = False
            if not (top.side or top.main or top.tag in PROSE):
                value = _hash(["", text])
                self.hashes.add(value)
                recurs = value in self.template
            if not (top.side or recurs):
                self.blocks.append((text, top.main))

    def _close(self) -> None:
        node = self.stack.pop()
        parent = self.stack[-1]
        if node.tag not in BLOCKS:
            self.buffer = node.before
            parent.parts += node.parts
            return
        if not node.parts:
            return
        value = _hash([node.tag, *node.parts])
        parent.parts.append(f"\x1e{value}")
        if node.tag in ("html", "body", "article", "main") or node.main and node.tag in PROSE:
            return
        self.hashes.add(value)
        if value in self.template:
            del self.blocks[node.first_block :]

    def _pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            self._flush()
            self._close()

    def _last(self, tags, scope=frozenset()) -> int:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in tags:
                return at
            if self.stack[at].tag in scope:
                return 0
        return 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if at := self._last(("p",), SCOPES):
                self._pop_to(at)
            if tag in CLOSES and (at := self._last(CLOSES[tag], SCOPES - CLOSES[tag])):
                self._pop_to(at)
        if tag in VOID:
            self.buffer.append(" ") if tag == "br" else None
            return
        top = self.stack[-1]
        side = top.side or _is_side(tag, attributes, top.main)
        main = top.main or tag in ("article", "main") and not side
        self.has_main |= main
        if tag in BLOCKS:
            self.stack.append(Node(tag, side, main, len(self.blocks)))
        elif side != top.side or tag == top.tag:
            node = Node(tag, side, main, len(self.blocks))
            node.before, self.buffer = self.buffer, []
            self.stack.append(node)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS or self.stack[-1].tag == tag:
            self._flush()
            if at := self._last((tag,), frozenset(["body"]) if tag not in ("body", "html") else frozenset()):
                self._pop_to(at)

    def _read(self, html: str) -> None:
        at = 0
        while found := TOKEN.search(html, at):
            if found.start() > at:
                self.buffer.append(html[at : found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                if found[0].startswith("<![CDATA["):
                    self.buffer.append(entities.escape(found[0][9:].removesuffix("]]>")))
                continue
            if found[1] or found[4]:
                self._end(tag)
            elif tag in RAW:
                attributes = found[3] or found[6] or ""
                if not (attributes.endswith("/") and tag in ("svg", "math", "script")):
                    end = RAW_ENDS[tag].search(html, at)
                    at = end.start() if end else len(html)
            elif tag != "head":
                self._open(tag, found[3] or found[6] or "")
        self.buffer.append(html[at:])
        self._flush()
        self._pop_to(1)

    def text(self) -> str:
        """All blocks that are left, one to a line; of a page read alone, those of its article if it names one."""
        every = not (self.alone and self.has_main)
        return "\n".join(text for text, main in self.blocks if main or every)


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html").withColumn("page_key", F.xxhash64("page_id", "url", "html"))


def subtrees(pages: DataFrame) -> DataFrame:
    """(page_key, host, content, subtrees): hashes of a page's element subtrees.

    ``content`` is a hash of the page's unmarked text, so that copies of one page count once.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, contents, hashes = [], [], []
            for url, html in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
                page = Page(html, frozenset())
                hosts.append(host_of(url))
                contents.append(xxhash.xxh64_intdigest(page.text()) - (1 << 63))
                hashes.append(sorted(page.hashes))
            yield pa.RecordBatch.from_arrays(
                [batch["page_key"], pa.array(hosts), pa.array(contents, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                ["page_key", "host", "content", "subtrees"],
            )

    schema = "page_key long, host string, content long, subtrees array<long>"
    return _keyed(pages).select("page_key", "url", "html").mapInArrow(read, schema)


def recurring(found: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, subtree) of ``found`` (host, content, subtrees) on most pages of one host.

    Pages are those that differ in their text. A subtree is on more than ``share`` of
    them, and on ``least_pages`` at least.
    """
    hosts = found.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("of_host"))
    pairs = found.select("host", "content", F.explode("subtrees").alias("subtree")).distinct()
    counts = pairs.groupBy("host", "subtree").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    known = counts.join(hosts.where(F.col("of_host") >= least_pages), "host")
    return known.where(F.col("n_pages") > share * F.col("of_host")).select("host", "subtree")


def extract(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; a null url is a host of its own. Repeated
    rows stay repeated. Character references are decoded, white space in a block
    becomes one space, and blocks are joined by a line end in page order. What has no
    mark of its own stays unless it is on most pages of its host, inside an article and outside.
    """
    small_batches(pages.sparkSession)
    found = cut_lineage(subtrees(pages))
    of_page = (
        found.select("page_key", "host", F.explode("subtrees").alias("subtree"))
        .join(recurring(found, share, least_pages), ["host", "subtree"], "left_semi")
        .groupBy("page_key")
        .agg(F.collect_set("subtree").alias("template"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["html"].to_pylist(), batch["template"].to_pylist(), strict=True)
            texts = [Page(html, frozenset(template or ())).text() for html, template in rows]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = _keyed(pages).join(of_page, "page_key", "left").select("page_id", "url", "html", "template")
    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
