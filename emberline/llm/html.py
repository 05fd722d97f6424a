"""Main-text extraction by removal of site templates.

Every element's subtree is hashed (tag, text and children); Spark counts on how many different pages
of a host each subtree stands, and subtrees that recur across many of them are deleted.  Pages with
equal main text count once, so copies of a page do not make a template.  What a single page tells by
itself goes as well: elements whose tag, role or whole class or id name says that they are menus,
footers, sidebars, notices, adverts, forms, scripts, styles or reader comments.  What is left of the
article becomes blocks of text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean, slices, written

# HTML element names by their role, and class words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu head title video audio map".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie-notice cookie-banner cookie-consent cookies consent gdpr notice notices notification popup modal newsletter newsletter-signup subscribe sidebar side-bar menu main-menu nav navbar navigation breadcrumb breadcrumbs header site-header page-header footer site-footer page-footer masthead comments comment-list commentlist comment-section reader-comments user-comments disqus_thread respond replies share sharing social social-links related related-posts related-articles recommended widget login signup search pagination pager toolbar skip-link".split()
)
_P_ENDS = BLOCK - {"p"}
_ITEMS, _LISTS = frozenset("li dt dd tr td th option".split()), frozenset("ul ol dl table select".split())


class Node:
    __slots__ = ("tag", "parts", "furniture", "digest", "size", "flows")

    def __init__(self, tag: str, attributes: dict[str, str | None]):
        self.tag = tag
        self.parts: list[Node | str] = []
        names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower().split()
        by_name = tag not in ("html", "body", "main") and not NAMES.isdisjoint(names)
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
        self.furniture = tag in FURNITURE or by_name or hidden or (attributes.get("role") or "").lower() in ROLES
        self.digest = self.size = 0
        self.flows = tag in FLOW


class TreeBuilder(HTMLParser):
    """A forgiving tree of any depth: paragraphs end where blocks begin, stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.count = Counter()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.open[-1].parts.append(" ")
            return
        if tag in BLOCK:
            self._close("p", _P_ENDS)
        if tag in _ITEMS:
            self._close(tag, _LISTS)
        node = Node(tag, dict(attrs))
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close(tag, frozenset() if tag in BLOCK else BLOCK)

    def _close(self, tag: str, barrier: frozenset) -> None:
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.count.subtract(n.tag for n in self.open[k:])
                del self.open[k:]
                return
            if self.open[k].tag in barrier:
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parse(html: str) -> Node:
    from xxhash import xxh64_intdigest

    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    order = [builder.root]
    for node in order:
        order.extend(p for p in node.parts if isinstance(p, Node))
    for node in reversed(order):
        text = " ".join(" ".join(f"<{p.digest}>" if isinstance(p, Node) else p for p in node.parts).split())
        node.digest = xxh64_intdigest(f"{node.tag} {text}") - (1 << 63)
        node.size = sum(p.size if isinstance(p, Node) else len(p.split()) for p in node.parts)
        node.flows |= any(p.flows for p in node.parts if isinstance(p, Node))
    return builder.root


def main_nodes(root: Node) -> list[Node]:
    """The page's articles outside furniture, in page order; else its main elements, else the whole page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in found:
            found[node.tag].append(node)
        if node.tag != "article":
            todo.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.furniture)
    return found["article"] or found["main"] or [root]


def main_text(root: Node, templates: frozenset = frozenset()) -> str:
    """Blocks of the main elements in page order, without template subtrees and furniture.

    The text blocks of an article or main element (paragraphs, headings, list items ..., and what
    holds them) are never taken for a template: sentences may recur there.
    """
    blocks, current = [], []

    def end() -> None:
        text = " ".join("".join(current).split())
        if text:
            blocks.append(text)
        current.clear()

    for top in main_nodes(root):
        explicit = top is not root
        stack = [(iter(top.parts), False, True)]
        while stack:
            parts, headings_only, block = stack[-1]
            part = next(parts, None)
            if part is None:
                stack.pop()
                if block:
                    end()
            elif not isinstance(part, Node):
                if not headings_only:
                    current.append(part)
            elif not part.furniture and not (part.digest in templates and not (explicit and (part.flows or part.tag not in BLOCK))):
                if part.tag in BLOCK:
                    end()
                stack.append((iter(part.parts), (headings_only or part.tag == "header") and part.tag not in HEADINGS, part.tag in BLOCK))
    return "\n\n".join(blocks)


def subtree_hashes(root: Node) -> list[int]:
    """Hashes of all block subtrees with text, furniture included."""
    found, todo = set(), [root]
    for node in todo:
        for part in node.parts:
            if isinstance(part, Node):
                todo.append(part)
                if part.tag in BLOCK and part.size and part.tag not in ("html", "body"):
                    found.add(part.digest)
    return sorted(found)


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.3, url: str = "url", html: str = "html") -> DataFrame:
    """(host, templates): subtrees on at least min_pages and min_share of a host's different pages.

    A host keeps at most its mean number of subtrees a page divided by min_share, so a list is short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for part in (part for batch in batches for part in slices(batch, 1)):
            hosts, contents, lists = [], [], []
            for host, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                root = parse(value.as_py())
                hosts.append(host)
                contents.append(xxh64_intdigest(main_text(root)) - (1 << 63))
                lists.append(subtree_hashes(root))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["host", "content", "subtrees"])

    seen = pages.filter(F.col(html).isNotNull()).select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(lean(run), "host string, content long, subtrees array<long>")
    seen = written(seen, "subtrees")
    sizes = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counts = seen.select("host", "content", F.explode("subtrees").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    many = counts.join(sizes, "host").filter((F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("pages")))
    return many.groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """(key, url, text, n_chars) for every page.

    Null and empty pages give an empty text; null urls and urls without a host share the host "".
    Repeated rows stay, other columns are ignored, an empty table gives no rows; very long pages and
    pages of any depth are taken whole.
    """
    side = bounded(written(site_templates(pages, url=url, html=html, **options).withColumnRenamed("host", "_host"), "templates"))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    joined = rows.join(side, F.col("host") == F.col("_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 2)):
            texts = [main_text(parse(h.as_py() or ""), frozenset(t.as_py() or ())) for h, t in zip(part.column(2), part.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, "url", "text", "n_chars"])

    return joined.select("page", "url", "html", "templates").mapInArrow(lean(run), f"`{key}` long, url string, text string, n_chars long")
