"""Main text of web pages by removal of site templates.

Every block element is hashed with all below it (tags and text, no attributes). Spark counts per host in
how many surroundings a subtree stands: distinct hashes of its parent, so copies of one page count once.
Subtrees that recur across many pages of their host are the site's template and go. The article, if the
page marks one, is what the rest is taken from, and paragraphs in it go only where most of the site's
pages carry them: articles of one site may well share a passage. Elements that HTML itself sets aside
(navigation, footers, forms, ...) and those whose class or id says so go in any case, for the pages
of a host may be few.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.scratch import documents
from evalweave.llm.tokens import slices
from evalweave.llm.url_filter import host_and_path

SLICE_BYTES = 4 << 20
SALTS = 16

# Names of HTML elements, roles, and words in classes and ids, by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = set("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("body html caption tbody td tfoot th thead tr".split())
SCOPES = set("html table td th caption object button template".split())
IN_HEAD = set("base link meta noscript script style template title".split())
# What a start tag ends, and the elements that keep those outside of them from it.
CELLS = {"td", "th"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"} | CELLS, {"table"}),
    "td": (CELLS, {"table", "tr"}),
    "th": (CELLS, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr"} | CELLS, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr"} | CELLS, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr"} | CELLS, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ASIDE_TAGS = set(
    "applet aside audio button canvas datalist dialog embed footer form frame frameset head iframe input menu nav noembed noframes "
    "noscript object script select style svg template textarea title video".split()
)
ASIDE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
ASIDE_WORDS = set(
    "ad ads alert announcement advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs comment commentlist comments consent "
    "cookie cookiebar cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup promo promotion recommended related replies respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription toolbar widget".split()
)
ASIDE_ENDINGS = ("footer", "sidebar", "menu", "nav", "banner", "breadcrumbs", "comments")
HEADER_WORDS = {"header", "topbar"}
ARTICLE_WORDS = set("article articlebody content entry main post story".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
COMMENT_END = re.compile("--!?>")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
WORD = re.compile(r"[a-z0-9]+")


# Pages of a host in whose surroundings a subtree has to stand to be template: at least so many, and at
# least this share of the host's pages. The second pair is for paragraphs, lists and tables.
COMMON = (4, 0.02)
MOST = (10, 0.5)


class Page:
    """A page's elements in order and its text as ``events``, read in one pass over ``source``.

    An event is (element, text) or, at the border of a block, (element, None). ``sizes`` and
    ``link_sizes`` are characters of text and of linked text, ``links`` links, ``hashes`` of the whole
    subtree, None where it has no text. Broken markup is read as browsers do: an open tag at the end
    drops the rest, paragraphs, items and cells end where the next begins, an end tag without a start is
    nothing, and what stays open ends with what encloses it.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.marks = ["html"], [-1], [""]
        self.sizes, self.link_sizes, self.links = [0], [0], [0]
        self.hashes: list[int | None] = [None]
        self.events: list[tuple[int, str | None]] = []
        self._content: list[list[bytes] | None] = [[]]
        self._open = [0]
        self._at: dict[str, list[int]] = {}  # depths at which a tag is open
        self._blocks: list[int] = []  # depths of open blocks
        self._read(source)
        self._cut(0)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                return
            following = source[lt + 1 : lt + 2]
            name = source[lt + 2 : lt + 3] if following == "/" else following
            if not (name.isascii() and name.isalpha()) and following not in ("!", "?", "/"):
                self._text(source[at : lt + 1])  # a plain sign
                at = lt + 1
                continue
            self._text(source[at:lt])
            if following == "!" and source.startswith("--", lt + 2):
                end = COMMENT_END.search(source, lt + 2)
                if end is None:
                    return
                at = end.end()
            elif not (name.isascii() and name.isalpha()):
                end = source.find(">", lt)
                if end < 0:
                    return
                at = end + 1
            else:
                tag = TAG.match(source, lt)
                if tag is None:
                    return
                at, name = tag.end(), tag[2].lower()
                if tag[1]:
                    self._end(name)
                elif name in RAW:
                    end = RAW_END[name].search(source, at)
                    if end is None:
                        return
                    at = end.start()
                else:
                    self._start(name, tag[3])

    def _text(self, text: str) -> None:
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        words = " ".join(text.split())
        if words and self._at.get("head"):
            self._cut(self._at["head"][-1])
        top = self._open[-1]
        self.events.append((top, text))
        if words:
            self.sizes[top] += len(words)
            self._content[top].append(words.encode("utf-8", "surrogatepass"))

    def _deepest(self, names: set[str]) -> int:
        return max((d[-1] for n in names if (d := self._at.get(n))), default=0)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            if self._at.get("head"):
                self._cut(self._at["head"][-1])
            return
        if tag not in IN_HEAD and self._at.get("head"):
            self._cut(self._at["head"][-1])
        if tag in CLOSES_P and (p := self._at.get("p")) and p[-1] > self._deepest(SCOPES):
            self._cut(p[-1])
        if tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            border = self._deepest(within)
            while (depth := self._deepest(ends)) > border:
                self._cut(depth)
        element = len(self.tags)
        if tag in VOID:
            if tag in BLOCK:
                self.events.append((self._open[-1], None))
            elif tag == "br":
                self.events.append((self._open[-1], " "))
            return
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.marks.append(attributes)
        for column in (self.sizes, self.link_sizes, self.links):
            column.append(0)
        self.hashes.append(None)
        self._content.append([])
        self._at.setdefault(tag, []).append(len(self._open))
        if tag in BLOCK:
            self._blocks.append(len(self._open))
            self.events.append((element, None))
        self._open.append(element)

    def _end(self, tag: str) -> None:
        depths = self._at.get(tag)
        if not depths:
            if tag == "br":
                self.events.append((self._open[-1], " "))
            return
        depth = depths[-1]
        if tag in BLOCK:
            if tag not in SCOPES and depth < self._deepest(SCOPES) and not tag.startswith("t"):
                return  # stands outside the cell
        elif tag not in ASIDE_TAGS and self._blocks and self._blocks[-1] > depth:
            return  # blocks outlive the formatting around their start
        self._cut(depth)

    def _cut(self, depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        while len(self._open) > depth:
            element = self._open.pop()
            tag, parent = self.tags[element], self.parents[element]
            if element:
                self._at[tag].pop()
            content, self._content[element] = self._content[element], None
            if content:
                content.insert(0, tag.encode("utf-8", "surrogatepass"))
                digest = hashlib.blake2b(b"\0".join(content), digest_size=8).digest()
                self.hashes[element] = int.from_bytes(digest, "little", signed=True)
            if tag == "a":
                self.links[element] += 1
                self.link_sizes[element] = self.sizes[element]
            if element:
                if content:
                    self._content[parent].append(digest)
                for column in (self.sizes, self.link_sizes, self.links):
                    column[parent] += column[element]
                if tag in BLOCK:
                    self._blocks.pop()
                    self.events.append((element, None))

    def subtrees(self) -> Iterator[tuple[int, int]]:
        """Hashes of the blocks that have text, each with its parent's."""
        for element in range(1, len(self.tags)):
            if self.tags[element] in BLOCK and self.hashes[element] is not None:
                yield self.hashes[element], self.hashes[self.parents[element]]


def _words(marks: str) -> tuple[set[str], str, str]:
    """Words of class and id, role, and itemprop of a start tag's attributes."""
    words: set[str] = set()
    role = item = ""
    if "=" in marks:
        for name, *values in ATTRIBUTE.findall(marks):
            value, name = html.unescape("".join(values)).lower(), name.lower()
            if name == "role":
                role = value.strip()
            elif name == "itemprop":
                item = value.strip()
            else:
                words |= set(WORD.findall(value))
    return words, role, item


def main_text(page: Page, common: set[int], most: set[int]) -> str:
    """Blocks of the page's main text, joined by two line feeds.

    ``common`` and ``most`` are hashes of template subtrees: containers, and paragraphs, lists and tables.
    """
    n = len(page.tags)
    said = [_words(m) for m in page.marks]
    named = [not words.isdisjoint(ASIDE_WORDS) or any(w.endswith(ASIDE_ENDINGS) for w in words) for words, _, _ in said]
    # Elements around a title or an article: never aside if they hold half of the page's text.
    holds = [t in ("h1", "main") or (t == "article" and not named[e]) for e, t in enumerate(page.tags)]
    for e in range(n - 1, 0, -1):
        holds[page.parents[e]] |= holds[e]
    outside = [False] * n  # set aside by tag, role, class or id, or below such
    for e in range(1, n):
        tag, role = page.tags[e], said[e][1]
        wraps = holds[e] and 2 * page.sizes[e] >= page.sizes[0]
        aside = tag in ASIDE_TAGS or role in ASIDE_ROLES or (named[e] and tag != "main")
        outside[e] = outside[page.parents[e]] or (aside and not wraps)

    def roots(chosen) -> list[int]:
        below = [False] * n
        found = []
        for e in range(1, n):
            below[e] = below[page.parents[e]]
            if not below[e] and not outside[e] and page.sizes[e] and chosen(e):
                below[e] = True
                found.append(e)
        return found

    found = roots(lambda e: page.tags[e] == "article")
    found = found or roots(lambda e: page.tags[e] == "main" or said[e][1] in ("main", "article"))
    found = found or roots(lambda e: said[e][2] == "articlebody")
    found = found or roots(lambda e: page.tags[e] in BLOCK and said[e][0] & ARTICLE_WORDS and 2 * page.sizes[e] >= page.sizes[0])
    whole = not found
    inside, gone = [whole] * n, list(outside)
    starts = set(found)
    for e in range(1, n):
        parent = page.parents[e]
        inside[e] = inside[parent] or e in starts
        gone[e] = gone[e] or gone[parent]
        if gone[e] or not inside[e] or e in starts:
            continue
        tag = page.tags[e]
        if tag in BLOCK and page.hashes[e] is not None:
            gone[e] = page.hashes[e] in (most if tag in PROSE else common)
        if whole and not gone[e]:
            menu = tag in BLOCK and page.links[e] >= 3 and 5 * page.link_sizes[e] >= 4 * page.sizes[e]
            gone[e] = menu or ((tag == "header" or bool(said[e][0] & HEADER_WORDS)) and 2 * page.sizes[e] < page.sizes[0])
    blocks: list[str] = []
    parts: list[str] = []
    for e, text in page.events:
        if text is None:
            if parts and (block := " ".join("".join(parts).split())):
                blocks.append(block)
            parts = []
        elif inside[e] and not gone[e]:
            parts.append(text)
    if block := " ".join("".join(parts).split()):
        blocks.append(block)
    return "\n\n".join(blocks)


def site_templates(pages: DataFrame, *, host: str, source: str) -> DataFrame:
    """``host, common, most``: hashes of the template subtrees of each host that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", SLICE_BYTES):
                seen: dict[tuple[str, int, int], None] = {}
                for site, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    if page:
                        seen.update(((site, *pair), None) for pair in Page(page).subtrees())
                sites, nodes, parents = zip(*seen) if seen else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(nodes, pa.int64()), pa.array(parents, pa.int64())], ["host", "node", "parent"])

    sites = pages.where(F.col(f"`{host}`") != "").select(F.col(f"`{host}`").alias("host"), F.col(f"`{source}`").alias("html"))
    total = sites.groupBy("host").agg(F.count("*").alias("pages"))
    around = sites.mapInArrow(run, "host string, node long, parent long").distinct().groupBy("host", "node").agg(F.count("*").alias("places"))
    share = lambda rule: F.greatest(F.lit(float(rule[0])), rule[1] * F.col("pages"))
    found = around.where(F.col("places") >= min(COMMON[0], MOST[0])).join(total, "host").where(F.col("places") >= F.least(share(COMMON), share(MOST)))
    lists = {name: F.collect_list(F.when(F.col("places") >= share(rule), F.col("node"))).alias(name) for name, rule in (("common", COMMON), ("most", MOST))}
    return found.groupBy("host").agg(*lists.values())


def extract(pages: DataFrame, *, url: str = "url", source: str = "html", page: str = "page_id") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Templates are counted over all pages of a host; pages without a host (null url, or none in it) belong
    to no site. A host has at most 1 / ``COMMON``'s share times a page's mean of subtrees as templates.
    White space inside a block is one space, character references are decoded. A null or empty page, or one
    without text outside its template, has an empty text. Repeated rows, and rows that share an id, are
    extracted one by one and count as one page of their site. A very long page is held whole by one
    task. Without pages the result is empty; other columns are not read.
    """
    key = pages.schema[page].dataType.simpleString()
    named = pages.select(
        F.col(f"`{page}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html"), host_and_path(F.col(f"`{url}`"))[0].alias("host")
    )
    templates = site_templates(named, host="host", source="html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", SLICE_BYTES):
                rows = zip(*(part.column(c).to_pylist() for c in ("html", "common", "most")))
                texts = [main_text(Page(h), set(c or ()), set(m or ())) if h else "" for h, c, m in rows]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    # A hot host's pages are dealt over SALTS keys, each with the host's templates.
    salted = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SALTS)).cast("int"))
    templates = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(templates, ["host", "salt"], "left").select("page_id", "url", "html", "common", "most")
    return joined.mapInArrow(run, f"page_id {key}, url string, text string, n_chars long")


def op12_site_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))


QUERIES = {"op12_site_text": op12_site_text}
ORACLE: dict[str, str] = {}
