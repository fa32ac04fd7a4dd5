"""Main text of web pages by tree scoring.

A page is cut into tags and text by one pattern and built into a flat tree.
Elements that can't be article text by their kind (scripts, forms, menus,
footers, sidebars, ...), role or visibility are pruned, and so are containers
whose class or id is a name of such parts and of nothing else ("comments",
"ad-slot", but not "related-work"); inside an article or main element that
holds for div, section, lists and tables only, never for paragraphs. Every
paragraph gives points, one plus its commas plus one for each hundred
characters up to three, to its parent, and half of what each ancestor gets to
the next above; a container's score is its points times one minus its link
density. The best container, widened to the article or main element around it,
and those of its siblings that score or read like it, are kept.

The text of the kept nodes is put out in page order: character references
decoded, white space within a block turned into one space, blocks joined by
one space. Outside an article or main element, lists, tables, sections and
divs with over ``LINKED`` of their text in links are menus and are dropped;
nothing else is dropped or cut. Time is linear in the page, however deep its
elements are nested.

Defined results: null or empty html, or a page without article text, gives the
empty string and 0; a page that breaks off, unclosed tags and stray end tags
are read as far as they go; repeated rows give a row each. Extra columns pass
through the operator; columns named like a result are replaced.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lamella.llm.common import add_columns, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_COMMA = re.compile("[,،、，]")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe title textarea xmp svg object canvas audio video noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "head", "title", "option"}
#: An opening tag ends an open element of these, up to the nearest of the bounds.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ("html",)),
}
PRUNED = frozenset("head nav footer aside form button select input fieldset dialog menu".split()) | RAW
PRUNED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status".split())
#: Names, as words of class or id, of what is no article text.
REFUSED = frozenset(
    "comment comments commentlist disqus respond replies reply ad ads adv advert adverts advertisement advertisements advertising adsense "
    "adslot sponsor sponsored sponsors promo promos promotion banner sidebar navbar nav navigation menu menus breadcrumb breadcrumbs masthead footer cookie "
    "cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share sharing social related "
    "recommended recommendations widget widgets toolbar pagination pager skip login signin paywall disclaimer copyright hidden".split()
)
#: Words that may stand beside them; with any other word the name is not one of such parts.
BESIDE = frozenset(
    "area bar block bottom box button buttons center class col column container content default desktop element fixed float form global group holder icons "
    "inner item items js large layer left link links list main mobile module outer page panel post posts primary reader readers right row secondary section "
    "site slot small sticky text this title top unit user users wide wrap wrapper zone".split()
)
#: Elements that are not pruned by name, and those that are inside an article.
WHOLE = frozenset("html body article main".split())
CONTAINERS = frozenset("div section ul ol dl table details".split())
LINKED = 0.66
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol table div section dl".split())


def _names_no_text(token: str, header: bool) -> bool:
    """Whether a class or id is the name of a part that is no article text, and of nothing else."""
    words = {w.lower() for w in _WORD.findall(token) if not w.isdigit()}
    refused = {w for w in words if w in REFUSED or header and w == "header"}
    return bool(refused) and words - refused <= BESIDE


@lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def main_text(html: str | None) -> str:
    """The article text of a page."""
    if not html:
        return ""
    page = Page(html)
    return page.text(page.choose())


class Page:
    """A flat tree in page order: a node's parent has a smaller index."""

    def __init__(self, html: str):
        self.tag, self.parent, self.pruned, self.inside = ["#root"], [0], [False], [False]
        self.pieces: list[tuple[int, str]] = []
        self.stack = [0]
        #: Places in the stack of the open elements of each tag, and of open blocks.
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                continue
            name = name.lower()
            if m.group(1) or m.group(4):
                self._close(name)
                continue
            attributes = m.group(3) if m.group(2) else m.group(6)
            self._open(name, attributes or "")
            if name in RAW and not (attributes or "").endswith("/"):
                end = _raw_end(name).search(html, at)
                at = end.end() if end else size
                self._cut(len(self.stack) - 1)
            elif name in VOID:
                self._cut(len(self.stack) - 1)

    def _text(self, raw: str) -> None:
        self.pieces.append((self.stack[-1], entities.unescape(raw) if "&" in raw else raw))

    def _nearest(self, names: tuple[str, ...]) -> int:
        """Place in the stack of the innermost open element of these tags, or 0."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def _cut(self, place: int) -> None:
        """Closes the element at a place of the stack and all in it."""
        while len(self.stack) > place:
            name = self.tag[self.stack.pop()]
            self.where[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def _open(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._end(("p",), ("table", "td", "button", "article", "section", "div", "body"))
        if name in ENDS:
            self._end(*ENDS[name])
        top = self.stack[-1]
        inside = self.inside[top] or name in ("article", "main")
        self.pruned.append(self.pruned[top] or self._refused(name, attributes, inside))
        self.tag.append(name)
        self.parent.append(top)
        self.inside.append(inside)
        self.where.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.pieces.append((top, " "))
            self.blocks.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def _end(self, names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        place = self._nearest(names)
        if place > self._nearest(bounds):
            self._cut(place)
            self.pieces.append((self.stack[-1], " "))

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self.pieces.append((self.stack[-1], " "))
        if name in ("body", "html"):
            return
        place = self._nearest((name,))
        if place and (name in BLOCK or not self.blocks or place > self.blocks[-1]):
            self._cut(place)

    def _refused(self, name: str, attributes: str, inside: bool) -> bool:
        if name in PRUNED or name == "header" and not inside:
            return True
        if not attributes or name in WHOLE:
            return False
        by_name = name in CONTAINERS or not inside
        for m in _NAMES.finditer(attributes):
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if key == "role" and value.lower() in PRUNED_ROLES:
                return True
            if key == "style" and _UNSEEN.search(value):
                return True
            if key in ("class", "id") and by_name and any(_names_no_text(token, not inside and name not in HEADING) for token in value.split()):
                return True
        return False

    def choose(self) -> set[int]:
        """The best container and the siblings kept with it."""
        n = len(self.tag)
        own, length, commas, links = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for node, text in self.pieces:
            if self.pruned[node] or text == " ":
                continue
            size = len(text.strip())
            own[node] += size
            length[node] += size
            commas[node] += len(_COMMA.findall(text))
            if in_link[node]:
                links[node] += size
        own_commas = commas[:]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            length[p] += length[i]
            commas[p] += commas[i]
            links[p] += links[i]
        self.length, self.links = length, links
        points = [0.0] * n
        for i in range(n):
            if self.pruned[i]:
                continue
            tag = self.tag[i]
            if tag in PARAGRAPH and length[i]:
                give, at = 1 + commas[i] + min(length[i] // 100, 3), self.parent[i]
            elif tag not in HEADING and tag not in PARAGRAPH and own[i] and (tag in BLOCK or tag == "#root") and not in_link[i]:
                give, at = 1 + own_commas[i] + min(own[i] // 100, 3), i
            else:
                continue
            points[at] += give
        for i in range(n - 1, 0, -1):
            points[self.parent[i]] += points[i] / 2
        score = [p * (1 - links[i] / length[i]) if length[i] and not self.pruned[i] else 0.0 for i, p in enumerate(points)]
        best = max(range(n), key=lambda i: (score[i], -i))
        if score[best] <= 0:
            return {0} if length[0] and not links[0] else set()
        top, at = score[best], best
        while at:
            if self.tag[at] in ("article", "main"):
                best = at
                break
            at = self.parent[at]
        kept, self.score = {best}, score
        limit = max(3.0, 0.2 * top)
        for i in range(1, n):
            if self.parent[i] == self.parent[best] and i != best and not self.pruned[i] and length[i]:
                density = links[i] / length[i]
                tag = self.tag[i]
                if score[i] >= limit or tag in HEADING and density < 0.3 or tag in PARAGRAPH and density < 0.25 and (length[i] > 80 or density == 0):
                    kept.add(i)
        return kept

    def text(self, kept: set[int]) -> str:
        n = len(self.tag)
        inside = [False] * n
        for i in range(n):
            if self.pruned[i]:
                continue
            inside[i] = i in kept or i > 0 and inside[self.parent[i]]
            if inside[i] and i not in kept and not self.inside[i] and self.tag[i] in LISTS and self.length[i] and self.links[i] > LINKED * self.length[i]:
                inside[i] = False
        return " ".join("".join([t for node, t in self.pieces if inside[node]]).split())


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars. A pure map: no shuffle, a page at a time."""

    def make():
        def work(column):
            found = [main_text(h) for h in column.to_pylist()]
            return [(t, len(t)) for t in found]

        return work

    return add_columns(pages, [html_col], RESULT, make)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
