"""Main text of web pages by tree scoring.

A tolerant scan builds the element tree (unclosed and misplaced tags are closed as browsers do for
the common cases). Every paragraph gives points for its length and commas to its ancestors, less
to farther ones; an element's points are discounted by its share of link text. The best container
and those siblings that hold text of their own are kept, without boilerplate elements. Elements are
boilerplate by kind or by words of their class, id and role; forms and elements marked by such words
stay where they hold most of the page's paragraphs, except what readers wrote.

Null and empty pages have the empty text. A page without any paragraph worth points gives the
text of its body that is neither boilerplate nor mostly links.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame, types as T

from .common import map_text

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_REST = re.compile(r"""(?:[^>"'=]+|=\s*(?:"[^"]*"|'[^']*')?|["'])*>?""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text at all.
_RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike "
                    "strong sub sup time tt u var br wbr img input".split())
#: Elements that are never part of an article.
_BOILER = frozenset("nav footer aside button select option fieldset menu dialog template noscript svg canvas object "
                    "audio video map head".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                      "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these kinds, up to the nearest of the second kinds.
_SAME = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
         "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
         "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table")}
_SAME = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _SAME.items()}
#: Words of class, id and role names that mark boilerplate, and elements that no name can mark.
_MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
                   "navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal "
                   "overlay newsletter subscribe signup share sharing social related recommended recommendations teaser comment "
                   "comments disqus reply replies widget pagination pager toolbar hidden complementary contentinfo search login "
                   "disclaimer".split())
#: Marks of what readers wrote, however much it is.
_REPLIES = frozenset("comment comments disqus reply replies".split())
_UNMARKED = frozenset("html body main article".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_POINTS = {"article": 10, "main": 10, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3,
           "address": -3, "header": -5, "h1": -5, "h2": -5, "h3": -5, "th": -5}
#: A paragraph shorter than this gives no points; ancestors above so many levels get none.
SHORT, LEVELS = 25, 5
#: A marked element that holds more than this share of a page's paragraph points may be its layout.
MOST = 0.6


NEVER, PERHAPS = 2, 1


def _boiler(tag: str, attributes: str) -> int:
    """``NEVER`` for what is never part of an article, ``PERHAPS`` for what its name or kind marks as boilerplate, else 0."""
    if tag in _BOILER:
        return NEVER
    found = PERHAPS if tag == "form" else 0
    if not attributes or tag in _UNMARKED:
        return found
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _WORD.findall(value)}
            # a word inside a line is no layout
            if words & _REPLIES or tag in _INLINE and words & _MARKS:
                return NEVER
            if words & _MARKS:
                found = PERHAPS
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return NEVER
    return found


def _gain(text: str) -> float:
    """Points of a paragraph."""
    return 1 + text.count(",") + min(len(text) / 100, 3)


class _Page:
    """Elements in page order with their parents, and blocks of text with the element they lie in."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.marks, self.linked = ["#root"], [-1], [0], [False]
        self.gone = [False]  # inside an element that is never part of an article
        #: (element, text, characters in links)
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._links, self._home = 0, 0
        self._scan(html)
        self._drop()

    def _drop(self) -> None:
        """Drop marked elements, unless they hold most of the paragraphs of a page, several of them, and the
        element that the page itself names its article, if there is one."""
        count = len(self.tags)
        held, several, named = [0.0] * count, [0] * count, [0] * count
        for node, text, linked in self.blocks:
            if len(text) >= SHORT and 2 * linked < len(text):
                held[node] += _gain(text)
                several[node] += 1
        for node in range(count - 1, 0, -1):
            named[node] += self.tags[node] in ("article", "main")
            for sums in (held, several, named):
                sums[self.parents[node]] += sums[node]
        self.dropped = self.gone[:]
        for node in range(1, count):
            layout = held[node] > MOST * held[0] and several[node] > 1 and (named[node] or not named[0])
            marked = self.marks[node] and not layout
            self.dropped[node] = self.dropped[node] or self.dropped[self.parents[node]] or marked
        self.blocks = [b for b in self.blocks if not self.dropped[b[0]]]

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self._text)).split()) if self._text else ""
        if text:
            self.blocks.append((self._home, text, min(self._links, len(text))))
        self._text, self._links = [], 0

    def _add(self, node: int, raw: str) -> None:
        if not raw or self.gone[node]:
            return
        if not self._text:
            if raw.isspace():
                return
            home = node
            while self.tags[home] in _INLINE:
                home = self.parents[home]
            self._home = home
        self._text.append(raw)
        if self.linked[node]:
            self._links += len(raw.strip())

    def _scan(self, html: str) -> None:
        stack, open_tags, at, n = [0], {}, 0, len(html)

        def close_to(depth: int) -> None:
            for node in stack[depth:]:
                open_tags[self.tags[node]] -= 1
            del stack[depth:]

        def close_nearest(kinds, until) -> None:
            if not any(open_tags.get(k) for k in kinds):
                return
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[depth]]
                if tag in kinds:
                    return close_to(depth)
                if tag in until:
                    return None

        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                self._add(stack[-1], html[at:])
                break
            self._add(stack[-1], html[at:m.start()])
            if m[1]:
                end = html.find("-->", m.end())
                at = n if end < 0 else end + 3
                continue
            rest = _REST.match(html, m.end())
            at = rest.end()
            if m[3] is None:
                continue
            tag, attributes = m[3].lower(), rest[0]
            if tag not in _INLINE and tag not in _RAW:
                self._flush()
            if m[2]:
                if open_tags.get(tag):
                    depth = len(stack) - 1
                    while self.tags[stack[depth]] != tag:
                        depth -= 1
                    close_to(depth)
                continue
            if tag == "br":
                self._add(stack[-1], " ")
                continue
            if tag in _CLOSES_P:
                close_nearest(("p",), ("button", "td", "th", "table"))
            if tag in _SAME:
                close_nearest(*_SAME[tag])
            if tag in _RAW:
                end = re.compile(rf"</{tag}", re.I).search(html, at)
                at = n if end is None else end.start()
                if end is not None:
                    at = _REST.match(html, end.end()).end()
                continue
            if tag in _VOID or attributes.endswith("/>") and tag in ("svg", "path"):
                continue
            up = stack[-1]
            self.tags.append(tag)
            self.parents.append(up)
            mark = _boiler(tag, attributes)
            if tag == "header" and not (open_tags.get("article") or open_tags.get("main")):
                mark = mark or PERHAPS
            self.marks.append(mark)
            self.gone.append(self.gone[up] or mark == NEVER)
            self.linked.append(self.linked[up] or tag == "a")
            stack.append(len(self.tags) - 1)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        self._flush()

    def main_text(self) -> str:
        tags, parents, count = self.tags, self.parents, len(self.tags)
        points, chars, links = [0.0] * count, [0] * count, [0] * count
        scored = [False] * count
        for node, text, linked in self.blocks:
            chars[node] += len(text)
            links[node] += linked
            if len(text) < SHORT:
                continue
            gain = _gain(text)
            up = node if tags[node] in ("div", "section", "article", "main", "body", "td") else parents[node]
            share = 1.0
            for level in range(LEVELS):
                if up <= 0:
                    break
                points[up] += gain * share
                scored[up] = True
                share = 0.5 if level == 0 else 1 / (3 * (level + 1))
                up = parents[up]
        for node in range(count - 1, 0, -1):
            chars[parents[node]] += chars[node]
            links[parents[node]] += links[node]
        best, most = 0, 0.0
        final = [0.0] * count
        for node in range(1, count):
            if scored[node] and not self.dropped[node]:
                final[node] = (points[node] + _POINTS.get(tags[node], 0)) * (1 - links[node] / max(1, chars[node]))
                if final[node] > most:
                    best, most = node, final[node]
        if not best:
            listed = self._link_lists(chars, links)
            return "\n".join(t for h, t, l in self.blocks if 2 * l < len(t) and h not in listed)
        top = up = best
        while up > 0:  # the sections of one article belong together
            if tags[up] in ("article", "main"):
                top = up
                break
            up = parents[up]
        kept = {top}
        for node in range(1, count):
            if parents[node] == parents[top] and node != top and not self.dropped[node] and parents[top] >= 0:
                density = links[node] / max(1, chars[node])
                if final[node] >= max(10.0, 0.2 * most) or tags[node] == "p" and chars[node] > 80 and density < 0.25:
                    kept.add(node)
        inside = [False] * count
        for node in range(1, count):
            inside[node] = node in kept or inside[parents[node]]
        listed = self._link_lists(chars, links)
        return "\n".join(t for h, t, _ in self.blocks if inside[h] and h not in listed)

    def _link_lists(self, chars: list[int], links: list[int]) -> set[int]:
        """Items of lists that are nearly nothing but links."""
        items: dict[int, list[int]] = {}
        for node, tag in enumerate(self.tags):
            if tag == "li":
                items.setdefault(self.parents[node], []).append(node)
        return {x for up, nodes in items.items() if len(nodes) >= 3 and links[up] > 0.8 * chars[up] for x in nodes}


def main_text(html: str) -> str:
    """Main text of one page, one line per block."""
    return _Page(html).main_text() if html else ""


EXTRACTED = T.StructType([T.StructField("text", T.StringType())])


def extract(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``text``: the main text of each page, beside the other columns of ``df``."""
    return map_text(df, html, lambda: lambda pages: [[main_text(p) for p in pages]], EXTRACTED, keep)
