"""Main text of web pages by a site style tree.

The pages of one host are merged into a tree of presentation paths (tags with their classes and ids from the root down). Over the pages that
have a path, two entropies are taken: that of its presentation (which children it has) and that of its content (which texts stand
directly in it; a text found on many pages counts for little). They give the path's importance, between 0 (the same everywhere) and 1. From
each page the branches go whose nodes are all of low importance; a page that would lose all its text keeps it. Copies of a page on one
host count once.

Some importance is known beforehand from the element itself: menus, headers, footers, asides, scripts and styles have none. Elements that a class, id
or role calls a sidebar, notice, advert, reader comments and the like, and forms, are doubted: they go too, unless they are or hold an article or
main element, and where a page would have no text left the style tree alone judges them. Article and main elements only have a prior: their paths count as important on `PRIOR_PAGES` further pages, so what the whole
site repeats inside articles goes too, an inline element only with its block. Articles that would lose all their text keep it, unless the page has
more text of importance elsewhere. The text is taken from articles alone if they hold `AREA_SHARE` of the important text, else from articles and
main elements under the same condition, else from the whole body.

Merging is grouped sums by (host, path, feature) and then by (host, path), so a host with a third of all pages costs one row per task and feature. Pages
meet the low paths of their host by joining their own undecided paths; only these lists, never html, pass through that join.

Defined results: a null or empty html gives an empty text; a null or odd url belongs to the host ""; unclosed, misnested and truncated markup is read
as browsers do as far as text goes; repeated rows each get their own result; text inside a block is joined by single spaces, blocks by one space.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import computed, text_or_empty, written

LOW = 0.35
#: Paths on fewer pages of a host are not judged.
MIN_PAGES = 3
#: Pages on which a path inside an article or main element counts as important beforehand.
PRIOR_PAGES = 3
#: Share of the important text of a page that articles, or articles and main elements, must hold to be its main text alone.
AREA_SHARE = 0.7
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
GAPS = re.compile(r"\s+")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
#: Element names by what they do to text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
UNSEEN = {"script", "style", "template", "link", "meta"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS_OPEN = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "aside", "nav", "footer", "header", "blockquote", "select"}
UNWANTED = {"head", "nav", "footer", "aside", "script", "style", "noscript", "template", "iframe", "svg", "math", "button", "select", "textarea", "dialog", "menu", "object", "canvas", "audio", "video", "title", "xmp", "noembed", "noframes"}
UNWANTED_PARTS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "comment", "comments", "disqus", "share", "sharing", "social", "related", "newsletter", "subscribe", "popup", "modal", "widget"}
UNWANTED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
#: What says little about headings and inside articles.
HEADS = {"header", "masthead", "banner"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE, MAIN = 2, 1
FIXED, DOUBTED = 2, 1


class Node:
    __slots__ = ("parent", "tag", "path", "mark", "unwanted", "area", "children", "texts", "low")

    def __init__(self, parent, tag: str, path: int, mark: int, area: int):
        self.parent, self.tag, self.path, self.mark, self.area = parent, tag, path, mark, area
        self.unwanted = max(mark, parent.unwanted) if parent else mark  # FIXED, DOUBTED or 0, with what the elements around have
        self.children: set[str] = set()
        self.texts: list[str] = []
        self.low = False


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip(" \t\r\n/") else {}


def named_unwanted(value: str, words: set[str]) -> bool:
    """Whether a whole name of a class or id consists of the words."""
    names = [{p.lower() for p in NAME_PART.findall(name)} for name in value.split()]
    return any(n and n <= words for n in names) and not any("article" in n for n in names)


def known_unwanted(tag: str, attrs: dict[str, str], area: int) -> int:
    """FIXED for elements that are a menu, header, footer, sidebar or hold no text to read, DOUBTED for those that a class, id or role calls so and for forms."""
    if tag in UNWANTED or tag == "header" and not area:
        return FIXED
    if attrs and tag not in ("html", "body", "main"):
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
            return FIXED
        words = UNWANTED_PARTS - HEADS if area or tag in HEADINGS else UNWANTED_PARTS
        if tag != "article" and (any(named_unwanted(attrs[k], words) for k in ("class", "id") if k in attrs) or attrs.get("role", "").lower() in UNWANTED_ROLES):
            return DOUBTED
    return DOUBTED if tag == "form" else 0


class Page:
    """The tree of a page, and its texts in order with the block borders between them."""

    def __init__(self, html: str):
        self.root = Node(None, "", 0, 0, 0)
        self.nodes = [self.root]
        self.items: list[tuple[Node, str] | None] = []
        here, at = self.root, 0
        while at < len(html):
            m = TAG.search(html, at)
            self.text(here, html[at : m.start() if m else len(html)])
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag not in INLINE and tag not in UNSEEN:
                self.items.append(None)
            if m[1]:
                here = self.closed(here, tag)
                continue
            here = self.before(here, tag)
            node = self.opened(here, tag, attributes(m[3]))
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
                tail = TAG.match(html, at)
                at = tail.end() if tail else len(html)
            elif tag not in VOID and not (m[3].endswith("/") and tag in ("path", "circle", "rect", "use")):
                here = node
        self.trust_holders()

    def trust_holders(self) -> None:
        """Takes the doubt from all elements that hold an article or main element; articles within articles are comments and the like."""
        found = False
        for node in self.nodes:
            if node.unwanted == DOUBTED and node.area > node.parent.area:
                found, x = True, node
                while x is not None:
                    x.mark, x = 0, x.parent
        if found:
            for node in self.nodes[1:]:
                node.unwanted = max(node.mark, node.parent.unwanted)

    def text(self, node: Node, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self.items.append((node, text))
            if node.unwanted != FIXED and not text.isspace():
                node.texts.append(text)

    def opened(self, parent: Node, tag: str, attrs: dict[str, str]) -> Node:
        signature = tag
        for k in ("id", "class"):
            if attrs.get(k):
                signature += f"{k[0]}={' '.join(sorted(DIGITS.sub('0', attrs[k]).split()))}"
        if parent.unwanted != FIXED:
            parent.children.add(signature)
        area = max(parent.area, ARTICLE if tag == "article" else MAIN if tag == "main" or attrs.get("role", "").lower() == "main" else 0)
        node = Node(parent, tag, xxhash.xxh3_64_intdigest(signature.encode("utf-8", "surrogatepass"), parent.path), known_unwanted(tag, attrs, parent.area), area)
        self.nodes.append(node)
        return node

    def before(self, here: Node, tag: str) -> Node:
        """The parent of a new element, after the elements that it closes."""
        if tag in CLOSES_P:
            x = here
            while x is not None and (x.tag == "p" or x.tag in INLINE):
                if x.tag == "p":
                    here = x.parent
                    break
                x = x.parent
        closes = CLOSES_SAME.get(tag)
        if closes:
            x, found = here, None
            while x is not None and (x.tag in closes or x.tag not in HOLDS_OPEN):
                if x.tag in closes:
                    found = x
                x = x.parent
            if found is not None:
                here = found.parent
        return here

    def closed(self, here: Node, tag: str) -> Node:
        x = here
        while x.parent is not None:
            if x.tag == tag:
                return x.parent
            x = x.parent
        return here

    def features(self) -> list[tuple[int, bool, int, bool]]:
        """(path, is content, feature, in an article or main element) of the page, distinct: how it looks at each path, and the texts directly there."""
        looks: dict[int, set[str]] = {}
        out, prior = set(), {}
        for node in self.nodes[1:]:
            if node.unwanted == FIXED:
                continue
            looks.setdefault(node.path, set()).update(node.children)
            prior[node.path] = prior.get(node.path, False) or node.area > 0
            out.update((node.path, True, xxhash.xxh3_64_intdigest(GAPS.sub(" ", t).strip().encode("utf-8", "surrogatepass"))) for t in node.texts)
        out.update((path, False, xxhash.xxh3_64_intdigest("\n".join(sorted(x)).encode("utf-8", "surrogatepass"))) for path, x in looks.items())
        return [(signed(p), content, signed(f), prior[p]) for p, content, f in out]

    def sizes(self, fits) -> list[int]:
        """Characters of text in nodes that fit, by area."""
        out = [0] * (ARTICLE + 1)
        for node, text in (x for x in self.items if x):
            if fits(node):
                out[node.area] += sum(map(len, text.split()))
        return out

    def judge(self, low: set[int]) -> None:
        """Marks the nodes of branches that are of low importance throughout; a doubted branch is judged by itself."""
        keeps: set[int] = set()  # nodes with something of importance in or below them
        for node in reversed(self.nodes):
            if node.unwanted != FIXED and (id(node) in keeps or node.path not in low):
                keeps.add(id(node))
                if node.parent and node.unwanted == node.parent.unwanted:
                    keeps.add(id(node.parent))
        within: set[int] = set()  # inline elements of a block that has important text of its own
        for node in self.nodes[1:]:
            parent = node.parent
            held = parent.low and node.unwanted == parent.unwanted
            if node.area and node.tag in INLINE and not held and (id(parent) in within or parent.texts and parent.path not in low):
                within.add(id(node))
            node.low = held or id(node) not in keeps and id(node) not in within
        for area in (ARTICLE, MAIN):
            left = self.sizes(lambda n: not n.unwanted and not n.low)
            lost = self.sizes(lambda n: not n.unwanted and n.low)
            if sum(lost[area:]) and not sum(left[area:]) and sum(lost) >= sum(left):
                for node in self.nodes:
                    node.low = node.low and node.area < area

    def main_text(self, low_paths: set[int]) -> str:
        """The text without unwanted elements and without branches whose nodes all have low importance."""
        if low_paths:
            self.judge({int(p) & 0xFFFFFFFFFFFFFFFF for p in low_paths})
        # A page that would lose all its text keeps doubted branches of importance, else what is not doubted, else all but what holds no text to read.
        for fits in (lambda n: not n.unwanted and not n.low, lambda n: n.unwanted != FIXED and not n.low, lambda n: not n.unwanted, lambda n: n.unwanted != FIXED):
            sizes = self.sizes(fits)
            if any(sizes):
                break
        area = next((a for a in (ARTICLE, MAIN) if sum(sizes[a:]) >= AREA_SHARE * sum(sizes)), 0)
        blocks, block = [], []
        for item in [*self.items, None]:
            if item is None:
                if block and (joined := GAPS.sub(" ", "".join(block)).strip()):
                    blocks.append(joined)
                block = []
            elif fits(item[0]) and item[0].area >= area:
                block.append(item[1])
        return " ".join(blocks)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(row columns, key1, key2, host): host and key tell pages apart by their html, so copies on one host share one."""
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return named.withColumns({"key1": F.xxhash64("html"), "key2": F.hash("html"), "host": host})


def site_features(rows: DataFrame) -> DataFrame:
    """(key1, key2, host, path, content, feature, prior) of every page."""

    def run(batches):
        for batch in batches:
            found = [(k1, k2, host, *f) for k1, k2, host, html in zip(batch["key1"], batch["key2"], batch["host"], batch["html"]) for f in Page(text_or_empty(html)).features()]
            yield pd.DataFrame(found, columns=["key1", "key2", "host", "path", "content", "feature", "prior"])

    return rows.mapInPandas(run, "key1 bigint, key2 int, host string, path bigint, content boolean, feature bigint, prior boolean")


def importance(features: DataFrame, copies: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the site style trees; copies: (host, key1, key2, copies) of pages found more than once, which count once together."""
    weighed = features.join(copies, ["host", "key1", "key2"], "left").withColumn("weight", 1 / F.coalesce("copies", F.lit(1)))
    counted = weighed.groupBy("host", "path", "content", "feature").agg(F.round(F.sum("weight")).alias("n"), F.max("prior").alias("prior"))
    sums = lambda content, x: F.sum(F.when(F.col("content") == content, x))
    n_log_n = F.col("n") * F.log("n")
    merged = counted.groupBy("host", "path").agg(sums(False, F.col("n")).alias("pages"), sums(False, n_log_n).alias("looks"), sums(True, F.col("n")).alias("texts"), sums(True, n_log_n).alias("repeated"), F.max("prior").alias("prior"))
    presentation = 1 - F.col("looks") / (F.col("pages") * F.log("pages"))
    content = 1 - F.col("repeated") / (F.col("texts") * F.log("pages"))
    seen = F.coalesce(content, presentation)
    raised = F.when(F.col("prior"), (F.col("pages") * seen + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)).otherwise(seen)
    value = F.when(F.col("pages") < MIN_PAGES, 1.0).otherwise(raised)
    return merged.select("host", "path", "pages", value.alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", low: float = LOW) -> DataFrame:
    """(page_id, url, text) of every row."""
    rows = keyed(pages, id_col, url_col, html_col)
    features = written(site_features(rows), "page-features")
    copies = written(rows.groupBy("host", "key1", "key2").agg(F.count("*").alias("copies")).where("copies > 1"), "page-copies")
    unimportant = written(importance(features, copies).where(F.col("importance") < low).select("host", "path"), "low-paths")
    mine = features.where("not content").select("key1", "key2", "host", "path")
    lists = mine.join(unimportant, ["host", "path"]).groupBy("host", "key1", "key2").agg(F.collect_set("path").alias("low"))
    met = rows.join(written(lists, "page-lows"), ["host", "key1", "key2"], "left").select("page_id", "url", "html", "low")

    def read():
        return lambda rows: [Page(text_or_empty(r["html"])).main_text(set(r["low"] or ())) for r in rows]

    given = met.select("page_id", "url", F.struct("html", "low").alias("page"))
    return computed(given, "page", "text", "string", read).select("page_id", "url", "text")
