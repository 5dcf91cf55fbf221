"""Main text of web pages by a site style tree.

The element trees of all pages of a host are merged: elements with the same path (tags with their class or id, from
the root) are one node. For each node two entropies are measured over the distinct pages that have it, both relative to the
most they could be: of its content (the text below it) and of its presentation (the sequence of its children). Where
every page shows the same, the entropy is low and the node is site furniture. A node's importance weighs both and is
shrunk to a prior, higher in an article, so that hosts of few pages decide little. Some elements need no statistics:
navigation, scripts, forms and the like are never content.

Branches of low importance are cut from every page of the host, and the text of the rest is laid out in blocks: that of
its articles alone, if they hold most of what is left.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_table, small_batches, written

#: Weight of the content's entropy; the presentation's has the rest.
GAMMA = 0.9
#: Importance without evidence, the number of pages that it is worth, and the importance below which a branch is cut.
PRIOR, PRIOR_PAGES, CUT = 0.6, 8.0, 0.25
#: The same in an article or main element.
PRIOR_INSIDE = 0.9

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("label a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_NEVER = frozenset("head title script style noscript template svg math canvas nav footer aside form button select option textarea input label fieldset iframe object embed audio video dialog menu map xmp noembed noframes".split())
_HOLDS_CONTENT = frozenset(("article", "main"))
_MARKED = re.compile(
    r"(?i)(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|side-?bar|foot|footer|footnotes?-?nav|masthead|site-?header|page-?header|topbar|toolbar|banner|cookies?|consent|gdpr|notices?|notification|alert|"
    r"pop-?up|modal|overlay|ads?|advert\w*|adverts?|adsense|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|reply|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|sign-up|"
    r"adsbygoogle|outbrain|taboola|log-?in|search|search-?form|form|widgets?|pagination|pager|copyright|disclaimer|skip-?link|tags?-?cloud)(?:$|[\s_-])"
)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Words of a layout's container that say what else is on the page.
_LAYOUT = re.compile(r"(?i)(?<![\w-])(?:has|with|without|no|is)-[\w-]+")
_HEADER = re.compile(r"(?i)(?:^|[\s_-])header(?:$|\s)")
_TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
#: What a start tag closes if it is open, up to the given ancestors.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}


class Node:
    """An open element: its tag, path, whether it or one above it is never content, and whether it lies in an article."""

    __slots__ = ("tag", "path", "gone", "inside", "content", "shape")

    def __init__(self, tag: str, path: str, gone: bool, inside: bool):
        self.tag, self.path, self.gone, self.inside = tag, path, gone, inside


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


def _never(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in _NEVER or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "main", "article") and "comment" not in (attrs.get("class", "") + attrs.get("id", "")).lower():
        return False
    names = _LAYOUT.sub(" ", _HUMP.sub("-", f"{attrs.get('class', '')} {attrs.get('id', '')}"))
    if not inside and tag not in _TITLES and _HEADER.search(names):
        return True
    style = attrs.get("style", "").replace(" ", "").lower()
    return bool(_MARKED.search(names)) or attrs.get("role", "").lower() in _ROLE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


class Page:
    """One parse: blocks of text in order, and the nodes of the tree with digests of what they hold."""

    def __init__(self, text: str | None):
        self.blocks: list[tuple[str, tuple[str, ...], bool, bool]] = []  # text, paths from the root, gone, inside
        self.nodes: dict[str, list[int]] = {}  # path -> content digest, presentation digest, decided, inside
        self._parts: list[str] = []
        self._mute: list[str] = []  # open marked inline elements, the outermost first
        self._stack: list[Node] = []
        self._parse(text or "")

    def _flush(self) -> None:
        self._mute = []  # an unclosed marked inline element ends with its block
        if self._parts:
            text = _SPACE.sub(" ", "".join(self._parts)).strip()
            self._parts = []
            if text:
                top = self._stack[-1] if self._stack else None
                self.blocks.append((text, tuple(x.path for x in self._stack), bool(top and top.gone), bool(top and top.inside)))
                digest = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
                for x in self._stack:
                    n = self.nodes[x.path]
                    n[0] = (n[0] * 1099511628211 + digest) & 0x7FFFFFFFFFFFFFFF

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        top = self._stack[-1] if self._stack else None
        inside = bool(top and top.inside) or tag in _HOLDS_CONTENT
        gone = bool(top and top.gone) or _never(tag, attrs, bool(top and top.inside))
        name = attrs.get("id") or attrs.get("class", "").split(" ")[0] if attrs else ""
        own = f"{tag}.{re.sub(r'[0-9]+', '#', name)}" if name else tag
        path = f"{top.path}/{own}" if top else own
        if top:
            n = self.nodes[top.path]
            n[1] = (n[1] * 1099511628211 + xxhash.xxh64_intdigest(own)) & 0x7FFFFFFFFFFFFFFF
        decided = gone or tag in ("html", "body")
        self.nodes.setdefault(path, [0, 0, int(decided), int(inside)])
        self._stack.append(Node(tag, path, gone, inside))

    def _close(self, tags: tuple[str, ...], until: tuple[str, ...] = ()) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i].tag in tags:
                del self._stack[i:]
                return
            if self._stack[i].tag in until:
                return

    def _parse(self, text: str) -> None:
        at, size = 0, len(text)
        lower = None
        while at < size:
            m = _TOKEN.search(text, at)
            if not m:
                rest = text[at:]
                cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)  # a tag that the page breaks off in
                if not self._mute:
                    self._parts.append(html.unescape(rest[: cut.start()] if cut else rest))
                break
            if m.start() > at and not self._mute:
                self._parts.append(html.unescape(text[at : m.start()]))
            at = m.end()
            tag = m[2].lower() if m[2] else ""
            if not tag:
                continue
            if m[1]:
                if tag == "br":
                    self._parts.append(" ")
                elif tag not in _INLINE:
                    self._flush()
                    self._close((tag,))
                elif self._mute and self._mute[-1] == tag:
                    self._mute.pop()
                continue
            attrs = _attributes(m[3])
            if tag in _RAW:
                lower = lower or text.lower()
                end = lower.find(f"</{tag}", at)
                at = size if end < 0 else end
                if end >= 0:
                    close = text.find(">", at)
                    at = size if close < 0 else close + 1
                continue
            if tag == "br":
                self._parts.append(" ")
                continue
            if tag in _VOID:
                if tag == "hr":
                    self._flush()
                continue
            if tag in _INLINE or tag == "label":
                if tag == "label" or (attrs and _never(tag, attrs, True)) or (self._mute and self._mute[-1] == tag):
                    self._mute.append(tag)
                continue
            self._flush()
            if self._stack and self._stack[-1].tag == "p":
                self._stack.pop()
            if tag in _CLOSES:
                self._close(*_CLOSES[tag])
            if not m[3].endswith("/") or tag in ("div", "p"):
                self._open(tag, attrs)
        self._flush()

    def text(self, cut: frozenset[str] | set[str] = frozenset()) -> str:
        """The main text, with the branches at the given paths cut off as well: the rule of main_text() for one page.

        Text outside articles goes if those hold most of the text that is left, characters weighed by the priors.
        """
        kept = [(t, inside) for t, paths, gone, inside in self.blocks if not gone and (not cut or cut.isdisjoint(paths))]
        within = sum(len(t) for t, inside in kept if inside)
        if within and within * PRIOR_INSIDE >= sum(len(t) for t, inside in kept if not inside) * PRIOR:
            kept = [x for x in kept if x[1]]
        return "\n\n".join(t for t, _ in kept)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _id(path: str) -> int:
    return xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass")) - (1 << 63)


_NODE = "struct<path: string, id: long, content: long, shape: long, decided: boolean, inside: boolean>"
_PAGE = f"host string, nodes array<{_NODE}>, blocks array<struct<text: string, at: array<long>, inside: boolean>>"


def parsed(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """pages (their own columns but the page) with copy, host, nodes and blocks: every page is parsed once, here.

    copy is a hash of the page; blocks are those that may be content, each with the ids of the nodes around it.
    """

    @F.pandas_udf(_PAGE)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for urls, texts in batches:
            out = []
            for u, t in zip(urls, texts):
                p = Page(t)
                ids = {x: _id(x) for x in p.nodes}
                nodes = [{"path": x, "id": ids[x], "content": c, "shape": s, "decided": bool(d), "inside": bool(i)} for x, (c, s, d, i) in p.nodes.items()]
                out.append((host_of(u), nodes, [{"text": t, "at": [ids[x] for x in paths], "inside": i} for t, paths, gone, i in p.blocks if not gone]))
            yield pd.DataFrame(out, columns=["host", "nodes", "blocks"])

    rest = [x for x in pages.columns if x != page]
    return pages.select(*rest, F.md5(F.encode(page, "UTF-8")).alias("copy"), read(url, page).alias("__p")).select(*rest, "copy", "__p.*")


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, id, n_pages, importance, decided) of every node of every host's tree, from parsed() pages.

    Copies of a page are one page: they say nothing about what pages of a host share. Pages go by (host, path, digests) through a count that is combined before the shuffle, and entropies are sums of
    c log c over those counts, combined likewise: a host with a third of all pages is no group of rows in one task.
    """
    rows = pages.select("copy", "host", F.explode("nodes").alias("n")).select("copy", "host", "n.*").distinct()
    key = ["host", "path", "id"]
    each = written(rows.groupBy(*key, "content", "shape").agg(F.count(F.lit(1)).alias("c"), F.min("decided").alias("decided"), F.max("inside").alias("inside")))

    def entropy(by: str) -> DataFrame:
        c = F.col("c").cast("double")
        counts = each.groupBy(*key, by).agg(F.sum("c").alias("c"), F.min("decided").alias("decided"), F.max("inside").alias("inside"))
        return counts.groupBy(*key).agg(F.sum("c").alias("n_pages"), F.min("decided").alias("decided"), F.max("inside").alias("inside"), F.sum(c * F.log(c)).alias("s"))

    relative = lambda n, s: F.when(n > 1, (F.log(n) - s / n) / F.log(n)).otherwise(1.0)
    a, b = entropy("content").alias("a"), entropy("shape").alias("b")
    n = F.col("a.n_pages").cast("double")
    evidence = GAMMA * relative(n, F.col("a.s")) + (1 - GAMMA) * relative(n, F.col("b.s"))
    joined = a.join(b, key).select(*key, F.col("a.n_pages").alias("n_pages"), F.col("a.decided").alias("decided"), F.col("a.inside").alias("inside"), evidence.alias("e"))
    prior = F.when(F.col("inside"), PRIOR_INSIDE).otherwise(PRIOR)
    return joined.select(*key, "n_pages", ((F.col("n_pages") * F.col("e") + PRIOR_PAGES * prior) / (F.col("n_pages") + PRIOR_PAGES)).alias("importance"), "decided")


def main_text(blocks, cuts):
    """A page's text as a column: its blocks without the branches `cuts` (ids, or null), those of articles alone if they hold most.

    The same rule as Page.text().
    """
    kept = F.filter(blocks, lambda b: cuts.isNull() | ~F.arrays_overlap(b["at"], cuts))

    def size(blocks, inside: bool):
        mine = F.filter(blocks, lambda b: b["inside"] == F.lit(inside))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))

    def chosen(bs):
        within = size(bs, True)
        alone = (within > 0) & (within * PRIOR_INSIDE >= size(bs, False) * PRIOR)
        return F.transform(F.filter(bs, lambda b: b["inside"] | ~alone), lambda b: b["text"])

    return F.array_join(F.flatten(F.transform(F.array(kept), chosen)), "\n\n")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for every row.

    Null and empty pages have an empty text. Null ids and urls stay (the host is then empty). Repeated rows stay and
    count as one page of their host. Very long pages are read whole. A branch whose importance is just CUT stays.
    Extra columns are dropped, whatever their names. An empty table gives an empty result. The table of branches to
    cut has a row for each host that has any; it is broadcast if it is small, and else a host's pages are dealt out.
    """
    p = small_batches(pages).select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    p = written(parsed(p))
    low = style_tree(p).where(~F.col("decided") & (F.col("importance") < CUT))
    cuts = low.groupBy(F.col("host").alias("of")).agg(F.collect_set("id").alias("cuts"))
    joined = join_table(p.select("page_id", "url", "host", "blocks"), cuts, "host", "of", "left", spread="url")
    out = joined.select("page_id", "url", main_text(F.col("blocks"), F.col("cuts")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir):
    """op1: whole `pages`."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
