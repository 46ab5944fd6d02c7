"""Main text of web pages, with the templates of their site removed.

Pages are parsed tolerantly into element trees; every element gets two hashes of its subtree: of tags and
texts, and of its shape (tags, classes, ids and roles with texts masked and repeated children folded).
Tasks count, merged map-side, on how many pages of a host each occurs. Subtrees that recur on many pages
of their host are templates and are deleted: by shape where the page's text doesn't lie (a menu, an
advert or a footer recurs in shape while its words change), by tags and texts everywhere. The host's pages
also tell whether its template marks the main text by an article or main element; if so, what else is
left outside of it goes too. The rest is the text, block by block.

On a page without such an element the innermost container of over half of the words that aren't links stands for it; beside
that, containers and lists of links go by shape, prose doesn't. A page without such a container is main text and frame at once: there
containers go by shape, and what recurs on about article_share of the pages.

What HTML itself says isn't text (UNSHOWN, DROPPED_TAGS, DROPPED_ROLES) is never text. Lists of class words (DROPPED_WORDS)
decide in two places only: on hosts of fewer than `min_pages` pages, where next to nothing can recur, and for whole classes
within the main text, where text recurs in shape as well. No class or id deletes a heading or hides a page's only article.
What stands in the main text is kept alike on either side of min_pages; beside it, class words decide below and counts from there on.

Within the main text, be it an article, a main element or a container, a subtree goes at article_share of the host's pages; a box
(BOXES) goes, in and outside of it, when it stands in article_pages different articles (else main elements, else pages) of its
host, however many pages that has. Copies of an article count once, and where boxes hold more than half of the words none
goes. A recurring line alone isn't taken for a template below these shares: it may be the text's own.

The templates found are few for each host: one recurs on at least `share` of its pages, so there are at
most 1 / share times the mean number of subtrees a page; boxes are as many as the host has in
article_pages articles. They are broadcast while their number is
within `broadcast_rows`, which is checked; beyond that pages are joined with them by host.

Defined results: null or empty html gives empty text; a null url belongs to the host ''; repeated rows and null
ids are kept, each row alone; malformed markup never fails and takes linear time: an unclosed comment hides the rest, a
`<` that opens no tag is text. Other input columns are not carried.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import materialize, ship

TOKEN = re.compile(r"""<!--(?:-?>|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^>]*>""", re.S)
DIGITS = re.compile("[0-9]+")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A start tag that ends an open element of the second kind, unless one of the third kind stands between.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
DROPPED_TAGS = frozenset("script style noscript template svg math canvas iframe object embed audio video head title nav footer aside form button select textarea input dialog menu noembed noframes map".split())
#: Those of them that no page shows.
UNSHOWN = frozenset("script style noscript template head title iframe noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark what isn't article text.
DROPPED_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay "
    "sidebar aside rail widget widgets menu menus nav navbar navigation navigationbar breadcrumb breadcrumbs topbar masthead footer foot bottombar comment comments commentlist usercomments discussion disqus respond reply replies "
    "share sharing social related recommended recommendations pagination pager toolbar skip login signup signin paywall".split()
)
#: Elements that, when the same one recurs in several articles, are boxes put into them. A recurring line (p, h1, b) may be article text.
BOXES = frozenset("div section fieldset details".split())
#: Elements that hold prose: on pages without a main element their shape is no sign of a template.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li ul ol dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: The share of a host's pages from which a subtree goes even from within an article.
ARTICLE_SHARE = 0.5
HEADER_WORDS = frozenset("header siteheader pageheader".split())


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Node:
    __slots__ = ("attributes", "children", "hash", "holds", "links", "shape", "tag", "words")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.hash = self.shape = self.words = self.links = 0  # links: the words within links
        self.holds = False  # a main element

    def close(self, shaped: bool) -> None:
        """Hash the subtree: tag, texts with white space collapsed, hashes of the children; and its shape if asked for."""
        h = xxhash.xxh64(self.tag.encode("utf-8", "replace"))
        shapes = set()
        for c in self.children:
            if isinstance(c, str):
                if parts := c.split():
                    self.words += len(parts)
                    h.update(b"\x00" + " ".join(parts).encode("utf-8", "replace"))
                    shapes.add(1)
            else:
                self.words += c.words
                self.links += c.links
                self.holds |= c.holds or c.tag == "main"
                h.update(b"\x01" + c.hash.to_bytes(8, "little"))
                if c.words:
                    shapes.add(c.shape)
        self.hash = h.intdigest()
        if self.tag == "a":
            self.links = self.words
        if shaped and self.words:
            a = self.get() if self.attributes else {}
            marks = [*sorted(DIGITS.sub("0", a.get("class", "")).split()), "#", DIGITS.sub("0", a.get("id", "")), "@", a.get("role", "")]
            self.shape = xxhash.xxh64_intdigest("\x00".join([self.tag, *marks, *map(str, sorted(shapes))]).encode("utf-8", "replace"))

    def get(self) -> dict[str, str]:
        return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attributes)} if self.attributes else {}


def parse(page: str) -> Node:
    root = Node("", "")
    stack, at = [root], 0
    # where on the stack each open tag stands, and where blocks and buttons do: no step looks through the stack
    where: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    article, main = where["article"], where["main"]

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if stack:
                where[node.tag].pop()
                if node.tag in BLOCKS or node.tag == "button":
                    blocks.pop()
            node.close(not article and not main)

    def text(lo: int, hi: int) -> None:
        if hi > lo:
            part = page[lo:hi]
            stack[-1].children.append(entities.unescape(part) if "&" in part else part)

    while m := TOKEN.search(page, at):
        text(at, m.start())
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in where and where[tag]:
                pop_to(where[tag][-1])
            elif tag in ("br", "p"):
                stack[-1].children.append("\n")
            continue
        if tag in BLOCKS and blocks and stack[blocks[-1]].tag == "p":  # a block ends an open paragraph
            pop_to(blocks[-1])
        if tag in CLOSES:
            ends, bars = CLOSES[tag]
            last = max((where[t][-1] for t in ends.split() if where[t]), default=0)
            if last > max((where[t][-1] for t in bars if where[t]), default=0):
                pop_to(last)
        attributes = m[3] or m[6] or ""
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            node.close(False)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag in ("title", "textarea"):
                node.children.append(entities.unescape(page[at : end.start() if end else len(page)]))
            node.close(False)
            at = end.end() if end else len(page)
        else:
            where[tag].append(len(stack))
            if tag in BLOCKS or tag == "button":
                blocks.append(len(stack))
            stack.append(node)
    text(at, len(page))
    pop_to(0)
    return root


def walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in node.children if not isinstance(c, str)]


def names(attributes: dict[str, str]) -> set[str]:
    found = set()
    marks = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    for word in re.sub("([a-z])([A-Z])", r"\1-\2", marks).lower().split():
        if not word.startswith(("no-", "has-", "with-", "without-", "is-")):
            parts = re.split(r"[^a-z]+", word)
            found.update((*parts, "".join(parts)))  # side-bar is sidebar too
    return found


def marks(attributes: dict[str, str], whole: bool) -> set[str]:
    """Whole classes only, or also the pieces of classes and of the id."""
    return set(attributes.get("class", "").lower().split()) if whole else names(attributes)


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def is_boilerplate(node: Node, whole: bool = False, listed: bool = True) -> bool:
    """listed: classes count, whole ones or also their pieces."""
    if node.tag in DROPPED_TAGS:
        return True
    if not node.attributes or node.tag in ("html", "body", "main", "article"):
        return False
    a = node.get()
    if is_hidden(a) or a.get("role", "").lower() in DROPPED_ROLES:
        return True
    return listed and node.tag not in HEADINGS and not DROPPED_WORDS.isdisjoint(marks(a, whole))


def is_header(node: Node, whole: bool = False, listed: bool = True) -> bool:
    return node.tag == "header" or listed and bool(node.attributes) and node.tag not in ("html", "body", "main", "article") and node.tag not in HEADINGS and not HEADER_WORDS.isdisjoint(marks(node.get(), whole))


def hides(node: Node, anywhere: bool) -> bool:
    """Whether no article is looked for in node: a whole class or id says that it holds none, and it doesn't hold the main element.

    anywhere: only what isn't shown hides an article.
    """
    if node.tag in UNSHOWN:
        return True
    a = node.get() if node.attributes and node.tag not in ("html", "body", "main") else {}
    if node.tag != "article" and is_hidden(a):
        return True
    if anywhere or node.holds:
        return False
    return node.tag in DROPPED_TAGS or node.tag != "article" and (a.get("role", "").lower() in DROPPED_ROLES or a.get("id", "").lower() in DROPPED_WORDS) or not DROPPED_WORDS.isdisjoint(marks(a, True))


def roots(page: Node) -> list[Node]:
    """Outermost articles outside boilerplate, else main elements, else such within boilerplate, else the page.

    Where articles stand among other text of a main element, that is taken for them.
    """
    return _roots(page, False) or _roots(page, True) or [page]


def _roots(page: Node, anywhere: bool) -> list[Node]:
    articles, mains = [], []
    todo = [page]
    while todo:
        node = todo.pop()
        if hides(node, anywhere):
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main" or "role" in node.attributes and node.get().get("role") == "main":
            mains.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    articles, mains = [n for n in articles if n.words], [n for n in mains if n.words][:1]
    inner = {id(n) for m in mains for n in walk(m)} if articles and mains else set()
    if any(id(n) in inner for n in articles):
        if sum(n.words for n in articles if id(n) in inner) < mains[0].words:
            return [n for n in articles if id(n) not in inner] + mains
    return articles or mains


def boxes_in(root: Node, boxes: frozenset[int] | set[int], whole: bool) -> set[int]:
    """Recurring boxes of root to delete: none when they hold more than half of its words, as in a copied article."""
    found, words, todo = set(), 0, list(root.children)
    while todo:
        node = todo.pop()
        if isinstance(node, str) or is_boilerplate(node, whole):
            continue
        if node.tag in BOXES and node.hash in boxes:
            found.add(node.hash)
            words += node.words
        else:
            todo += node.children
    return found if 2 * words <= root.words else set()


@dataclass
class Site:
    """What a host's pages have in common."""

    #: It has min_pages pages or more; else nothing can recur, and class words decide.
    counted: bool = False
    #: The share of pages of each recurring subtree; boxes and shapes that recur; whether most pages mark their main text.
    shares: dict[int, float] = field(default_factory=dict)
    boxes: set[int] = field(default_factory=set)
    shapes: set[int] = field(default_factory=set)
    marked: bool = False


def shape_of(node: Node, marked: bool) -> int:
    """The shape on pages with, or without, a main text that is marked."""
    return node.shape ^ 0x5BD1E995 if marked else node.shape


def main_parts(tree: Node) -> tuple[list[Node], bool]:
    """The elements that hold the main text, and whether the page marks them."""
    found = roots(tree)
    if found[0] is not tree:
        return found, True
    node, most = tree, (tree.words - tree.links) / 2
    while inner := [c for c in node.children if not isinstance(c, str) and c.words - c.links > most and c.tag not in PROSE]:
        node = inner[0]
    return [node], False


def holders_of(tree: Node, kept: list[Node]) -> set[int]:
    """The elements around those of the main text."""
    up: dict[int, Node] = {}
    for node in walk(tree):
        for c in node.children:
            if not isinstance(c, str):
                up[id(c)] = node
    holders: set[int] = set()
    for n in kept:
        while id(n) in up and id(up[id(n)]) not in holders:
            n = up[id(n)]
            holders.add(id(n))
    return holders


def may_be_frame(node: Node, marked: bool) -> bool:
    """Whether an element beside the main text may go by its shape: on pages that don't mark that text, prose may not, but lists of links may."""
    return marked or node.tag not in PROSE or node.links == node.words and node.tag in BLOCKS


def outside(tree: Node, kept: list[Node], marked: bool) -> Iterator[Node]:
    """The elements beside the main text that may be templates by their shape."""
    holders, inner, todo = holders_of(tree, kept), {id(n) for n in kept}, [tree]
    while todo:
        node = todo.pop()
        if id(node) in inner:
            continue
        if node.words and id(node) not in holders and node.tag not in ("", "html", "body") and may_be_frame(node, marked):
            yield node
        todo += [c for c in node.children if not isinstance(c, str)]


def main_text(page: str | None, site: Site | None = None, article_share: float = ARTICLE_SHARE) -> str:
    """The text of a page; site: of its host, None for a page on its own.

    Within the main text, marked or not, only subtrees of article_share of the host's pages go, and boxes at any share.
    """
    if not page:
        return ""
    site = site or Site()
    tree = parse(page)
    found, marked = main_parts(tree)
    listed = not site.counted  # class words beside the main text
    # the whole page is gone through unless its main text is marked, by it alone or as on most pages of its host
    starts = found if marked and (site.marked or listed) else [tree]
    kept = {id(n) for n in found} if marked or not listed else set()
    framed = not marked and found[0].tag in ("", "html", "body")  # no container: the main text and the frame stand side by side

    def least(node: Node, main: bool) -> float:
        """The share of the host's pages from which a subtree goes; those on few pages have a little less than article_share at most."""
        if not main:
            return 1e-9
        return article_share if marked or node.tag in PROSE and not framed else 0.99 * article_share

    holders = holders_of(tree, found) if kept and starts is not found else set()
    blocks, line = [], []

    def flush() -> None:
        joined = " ".join("".join(line).split())
        if joined:
            blocks.append(joined)
        line.clear()

    for root in starts:
        gone = {h for n in (found if root is tree else [root]) for h in boxes_in(n, site.boxes, marked)} if site.boxes else site.boxes
        # entries: a text, a node to open, or None to end a block; of a header only headings are kept; whether in the main text, and in an article
        todo: list[tuple[Node | str | None, bool, bool, bool]] = [(None, False, False, False), (root, False, False, False)]
        while todo:
            item, headings, main, inside = todo.pop()
            if item is None:
                flush()
                continue
            if isinstance(item, str):
                if not headings:
                    line.append(item)
                continue
            if item.tag == "br":
                line.append(" ")
                continue
            if id(item) in kept:
                headings, main, inside = False, True, inside or item.tag == "article"
            elif item is not root and id(item) not in holders:
                if is_boilerplate(item, main, listed or main):
                    continue
                inside = inside or main and item.tag == "article"
                shaped = (framed or not main) and shape_of(item, marked) in site.shapes and may_be_frame(item, marked)
                if shaped or item.hash in gone or site.shares.get(item.hash, -1.0) >= least(item, main):
                    line.append(" ")
                    continue
                if is_header(item, main, listed or main):
                    if not inside:
                        continue
                    headings = True
                elif item.tag in HEADINGS:
                    headings = False
            if item.tag in BLOCKS:
                flush()
                todo.append((None, False, False, False))
            todo += [(c, headings, main, inside) for c in reversed(item.children)]
        flush()
    return "\n\n".join(blocks)


COUNTED = "host string, kind int, subtree bigint, content bigint, pages bigint"
#: What a count is of: a host's pages, a subtree, a box in a content, a shape, and pages with a marked main text.
PAGES, SUBTREE, BOX, SHAPE, MARKED = range(5)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _count(limit: int):
    """Pages of each host for each kind and subtree, as far as this task sees.

    content: the hash of the article (or main element or page) that a box stands in, null for the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int, int | None, int | None], int] = {}

        def out() -> pa.RecordBatch:
            keys = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int64()), pa.array(keys[3], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["host", "kind", "subtree", "content", "pages"])

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                host = host_of(url)
                tree = parse(page.as_py() or "")
                texts, marked = main_parts(tree)
                once = {(host, PAGES, None, None)} | ({(host, MARKED, None, None)} if marked else set())
                once |= {(host, SUBTREE, _signed(n.hash), None) for n in walk(tree) if n.words and n.tag not in ("", "html", "body", "article", "main")}
                once |= {(host, SHAPE, _signed(shape_of(n, marked)), None) for n in outside(tree, texts, marked)}
                for key in once:
                    found[key] = found.get(key, 0) + 1
                for root in texts if marked else [tree]:
                    for n in walk(root):
                        if n.tag in BOXES and n.words and n is not root:
                            found[host, BOX, _signed(n.hash), _signed(root.hash)] = 1
                if len(found) > limit:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return run


def _counts(pages: DataFrame, url_col: str, html_col: str, min_pages: int, task_entries: int) -> DataFrame:
    counted = pages.select(F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")).mapInArrow(_count(task_entries), COUNTED)
    sums = counted.groupBy("host", "kind", "subtree", "content").agg(F.sum("pages").alias("pages"))
    return materialize(sums.where((F.col("kind") == BOX) | (F.col("pages") >= min_pages)), "html-counts")


def _shares(sums: DataFrame, kind: int, share: float) -> DataFrame:
    hosts = sums.where(F.col("kind") == PAGES).select("host", F.col("pages").alias("all"))
    often = sums.where(F.col("kind") == kind).join(hosts, "host").withColumn("share", F.col("pages") / F.col("all"))
    return often.where(F.col("share") >= share)


def _templates(sums: DataFrame, share: float, article_pages: int, article_share: float) -> DataFrame:
    often = _shares(sums, SUBTREE, share).withColumn("share", F.when(F.col("pages") >= article_pages, F.col("share")).otherwise(F.least("share", F.lit(0.99 * article_share))))
    return often.where(F.col("share") >= share).select("host", "subtree", "share")


def _boxes(sums: DataFrame, article_pages: int) -> DataFrame:
    """(host, subtree) of boxes in at least article_pages different contents, however many pages the host has."""
    return sums.where(F.col("kind") == BOX).groupBy("host", "subtree").agg(F.count("*").alias("_n")).where(F.col("_n") >= article_pages).select("host", "subtree")


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 4, share: float = 0.1, article_pages: int = 10, article_share: float = ARTICLE_SHARE, task_entries: int = 300_000) -> DataFrame:
    """(host, subtree, share) of subtrees on at least min_pages pages and that share of their host's pages.

    A subtree on fewer than article_pages pages keeps a share under article_share, so that a text that
    a small site shows on several pages isn't taken out of its articles.
    """
    return _templates(_counts(pages, url_col, html_col, min_pages, task_entries), share, article_pages, article_share)


def site_shapes(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 4, share: float = 0.1, task_entries: int = 300_000) -> DataFrame:
    """(host, subtree, share) of the shapes outside of main texts on at least min_pages pages and that share of their host's pages."""
    return _shares(_counts(pages, url_col, html_col, min_pages, task_entries), SHAPE, share).select("host", "subtree", "share")


def site_boxes(pages: DataFrame, url_col: str = "url", html_col: str = "html", article_pages: int = 10, task_entries: int = 300_000) -> DataFrame:
    """(host, subtree) of the boxes that recur in at least article_pages different articles (or main elements, or pages) of their host."""
    return _boxes(_counts(pages, url_col, html_col, article_pages, task_entries), article_pages)


def _all_templates(sums: DataFrame, share: float, article_pages: int, article_share: float) -> DataFrame:
    """(host, kind, subtree, share): what _site reads."""
    kind = lambda k: F.lit(k).alias("kind")
    nothing, number = F.lit(None).cast("double").alias("share"), F.lit(None).cast("bigint").alias("subtree")
    parts = [
        sums.where(F.col("kind") == PAGES).select("host", kind(PAGES), number, nothing),
        _templates(sums, share, article_pages, article_share).select("host", kind(SUBTREE), "subtree", "share"),
        _boxes(sums, article_pages).select("host", kind(BOX), "subtree", nothing),
        _shares(sums, SHAPE, share).select("host", kind(SHAPE), "subtree", "share"),
        _shares(sums, MARKED, 0.5).select("host", kind(MARKED), number, "share"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _site(found: list[tuple[int, int | None, float | None]]) -> Site:
    site = Site()
    for kind, subtree, share in found:
        if kind == PAGES:
            site.counted = True
        elif kind == MARKED:
            site.marked = True
        elif kind == SUBTREE:
            site.shares[subtree % (1 << 64)] = share
        else:
            (site.boxes if kind == BOX else site.shapes).add(subtree % (1 << 64))
    return site


EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


ALONE = Site()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 300_000, min_pages: int = 4, share: float = 0.1, article_pages: int = 10, article_share: float = ARTICLE_SHARE, task_entries: int = 300_000) -> DataFrame:
    """(id, url, text, n_chars) for every page."""
    spark = pages.sparkSession
    ship(spark)
    templates = materialize(_all_templates(_counts(pages, url_col, html_col, min_pages, task_entries), share, article_pages, article_share), "html-templates")
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField(url_col, T.StringType()), *EXTRACTED.fields])
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias(id_col), F.col(f"`{url_col}`").cast("string").alias(url_col), F.col(f"`{html_col}`").cast("string").alias("_html"))
    known = None
    if templates.count() <= broadcast_rows:
        table: dict[str, list[tuple[int, int | None, float | None]]] = defaultdict(list)
        for host, *found in templates.collect():
            table[host].append(tuple(found))
        table = {host: _site(found) for host, found in table.items()}
        known = spark.sparkContext.broadcast(table)
    else:
        per_host = templates.groupBy("host").agg(F.collect_list(F.struct("kind", "subtree", "share")).alias("_templates"))

        @F.pandas_udf(T.StringType())
        def host(urls: pd.Series) -> pd.Series:
            return urls.map(host_of)

        rows = rows.withColumn("_host", host(url_col)).join(per_host, F.col("_host") == F.col("host"), "left").drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            joined = batch.column(4) if known is None else None
            for k, (url, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                site = known.value.get(host_of(url), ALONE) if known is not None else _site([(x["kind"], x["subtree"], x["share"]) for x in joined[k].as_py() or []])
                texts.append(main_text(page.as_py(), site, article_share))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
