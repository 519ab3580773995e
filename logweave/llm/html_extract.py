"""Operator 8: main text of web pages by tree scoring.

A page becomes a light tree of its block elements. Subtrees that are boilerplate by tag, role or name (menus,
footers, sidebars, notices, adverts, forms, scripts, reader comments) are left out. A name is a whole class, or outside an
article a whole id, made of telling and neutral words alone; it doesn't cut off a node that holds the article or most of
the page's text. Each remaining paragraph passes points for its length and its commas to its nearest six ancestors, less
with the distance; a container's points are discounted by its link density. Sums run once from the leaves to the root, so
the work is in proportion to the page. The container with most points wins, or the article element around it; siblings that look like text are kept too.

A null or empty page, and one without text, give an empty text. Repeated rows come back once each. Other columns aren't read.
"""

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame

from .common import map_batches

SCHEMA = "page_id long, url string, text string, n_chars long"
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "noscript", "template", "textarea", "select", "iframe", "svg", "math", "object", "video", "audio", "canvas", "title", "noembed", "noframes"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "base", "area", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = set(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form fieldset legend address details summary dialog menu center hgroup search".split()
)
_CLOSED_BY_OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARAGRAPHS = {"p", "li", "pre", "td", "blockquote", "dd", *_HEADINGS}
#: What a paragraph gives its ancestors, from the nearest on.
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15)
_LEFT_OUT = {"nav", "footer", "aside", "form", "fieldset", "dialog", "menu", "head", "search", "button"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
#: Words that name what isn't the article, and words that only say where or how it stands. A name counts if
#: all its parts are such words and one is of the first kind: "cookie-notice" and "related-posts" do, "related-work" doesn't.
_NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist respond disqus cookie cookies consent gdpr notice notices alert alerts notification notifications footer footers masthead menu menus nav navbar navigation newsletter subscribe subscription signup pager pagination popup popups modal modals overlay promo promos promotion promotions promoted recommended recommendations related replies reply share sharing sidebar sidebars skip social sponsor sponsors sponsored toolbar widget widgets login outbrain taboola teaser teasers topbar".split()
)
_NEUTRAL = set(
    "site page main top bottom left right upper lower bar box list lists section sections wrapper wrap container content block area form post posts article articles story stories link links button buttons icon icons media inner outer global primary secondary item items slot unit group panel column col row header head title text thread user reader bottom nav sub mobile desktop sticky fixed footer email mail print tools tool stream feed more".split()
)
_READERS = {"comment", "comments", "commentlist", "respond", "disqus", "replies", "reply"}
_HEADER = {"header", "site-header", "page-header"}
_PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_KEPT_WHATEVER_NAME = {"html", "body", "article", "main"}


def _named(name: str) -> set[str]:
    """The telling words of a class or id, if the whole name is made of them and of neutral ones."""
    parts = set(_PARTS.sub(" ", name).lower().split())
    telling = parts & _NAMES
    return telling if telling and parts <= _NAMES | _NEUTRAL else set()


def _is_left_out(tag: str, attributes: str, in_article: bool) -> str:
    """Empty, "always", or for what names alone make boilerplate "named" or "readers" (their
    comments); "article" for an article with such a name, which isn't left out, but speaks for nothing around it."""
    if tag in _LEFT_OUT:
        return "always"
    if tag == "header" and not in_article:
        return "always"
    if not attributes.strip():
        return ""
    got = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in got or got.get("aria-hidden") == "true" or _HIDDEN.search(got.get("style", "")):
        return "always"
    classes = (got.get("class") or "").split()
    named = set().union(*map(_named, classes)) if tag not in _HEADINGS else set()
    own_id = got.get("id") or ""
    if not named and tag not in _HEADINGS and own_id and (not in_article or own_id.lower() in _READERS):
        named = _named(own_id)
    if not in_article and _HEADER.intersection(map(str.lower, classes)):
        named = named | {"header"}
    if tag == "p" and in_article:
        named = named - {"teaser", "teasers"}  # the lead
    if tag in _KEPT_WHATEVER_NAME:
        return ("always" if in_article else "article") if tag == "article" and named else ""  # a comment inside the article
    if got.get("role", "").lower() in _ROLES:
        return "always"
    return ("readers" if named & _READERS else "named") if named else ""


class _Page:
    """tags, parents: of the tree's nodes. blocks: (node, text, characters in links), in page order, without what is left out."""

    def __init__(self, html: str):
        self.tags, self.parents, self.blocks = ["root"], [-1], []
        self.stack, self.out_depth, self.link = [0], 0, False
        self.open: Counter = Counter()  # tags on the stack
        unclosed: set[str] = set()  # raw elements of which no end follows
        self.articles = 0
        self.named_articles: set[int] = set()
        self.named: dict[int, bool] = {}  # nodes that names alone make boilerplate; whether of readers' comments
        self.pieces: list[str] = []
        self.linked = 0
        at = 0
        size = len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            self._text(html[at : m.start() if m else size])
            if not m:
                break
            at = m.end()
            if m[0].startswith("<![CDATA["):
                self._text(m[0][9:-3])
            elif m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                elif tag in _RAW:
                    self._raw_follows(tag)
                    end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    if end is None:
                        unclosed.add(tag)
                    at = end.end() if end else size if tag in ("script", "style") else at
                else:
                    self._open(tag, m[3])
        self._flush()

    def _raw_follows(self, tag):
        if tag != "svg":
            self._text(" ")

    def _text(self, text: str) -> None:
        if text and not self.out_depth:
            text = unescape(text)
            self.pieces.append(text)
            if self.link:
                self.linked += len("".join(text.split()))

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.stack[-1], text, self.linked))
            self.pieces, self.linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in ("br", "hr"):
            if tag == "hr":
                self._flush()
            self._text(" ")
        if tag in _VOID:
            return
        if tag == "a":
            self.link = True
        if tag not in _BLOCK:
            why = _is_left_out(tag, attributes, self.articles > 0)
            if self.out_depth or not why:
                return  # inline elements aren't nodes, unless they are left out
        else:
            self._flush()
            if self.tags[self.stack[-1]] == "p":
                self._pop()
            kinds = _CLOSED_BY_OWN_KIND.get(tag, ())
            while self.tags[self.stack[-1]] in kinds:
                self._pop()
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.stack.append(len(self.tags) - 1)
        self.open[tag] += 1
        if tag in _BLOCK:
            why = _is_left_out(tag, attributes, self.articles > 0)
        if self.out_depth or why == "always" or why and tag not in _BLOCK:
            self._flush()
            self.out_depth += 1
        elif why == "article":
            self.named_articles.add(len(self.tags) - 1)
        elif why:
            self.named[len(self.tags) - 1] = why == "readers"
        if not self.out_depth and tag in ("article", "main"):
            self.articles += 1

    def _pop(self) -> None:
        self._flush()
        node = self.stack.pop()
        self.open[self.tags[node]] -= 1
        if self.out_depth:
            self.out_depth -= 1
        elif self.tags[node] in ("article", "main"):
            self.articles -= 1

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if not self.open[tag]:
            if tag == "p":
                self._flush()
            return
        while self.tags[self.stack[-1]] != tag:
            self._pop()
        self._pop()


def _worth(tag: str, text: str, in_links: int) -> float:
    bare = len(text) - text.count(" ")
    worth = len(text) / 100 + sum(map(text.count, ",،、，")) + (len(text) >= 25)
    return worth * (1 - min(1.0, in_links / bare) if tag not in _HEADINGS else 0.1)


def _without_boilerplate(page: _Page) -> list[tuple[int, str, int]]:
    """The blocks, without nodes that names make boilerplate. Such a node stays if it holds an article or main element worth more
    than all outside of such nodes, or, where no article or main element stands outside, most of the page but readers' comments."""
    if not page.named:
        return page.blocks
    n = len(page.tags)
    own, inside, readers = [0.0] * n, [False] * n, [False] * n
    for node, text, in_links in page.blocks:
        own[node] += _worth(page.tags[node], text, in_links)
    for i in range(1, n):  # parents come first
        up = page.parents[i]
        inside[i] = inside[up] or i in page.named
        readers[i] = readers[up] or page.named.get(i, False)
    worth, articles, best = own[:], [False] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        worth[up] += worth[i]
        if page.tags[i] in ("article", "main") and i not in page.named_articles and worth[i]:
            best[i] = max(best[i], worth[i])
            articles[i] = not inside[i]
        if not page.named.get(i, False):
            best[up] = max(best[up], best[i])
    outside = sum(w for w, named in zip(own, inside) if not named)
    total = sum(w for w, mine in zip(own, readers) if not mine)
    stays = {i for i, mine in page.named.items() if best[i] > outside or not mine and not any(articles) and 2 * worth[i] > total}
    out = [False] * n
    for i in range(1, n):
        out[i] = out[page.parents[i]] or i in page.named and i not in stays
    return [x for x in page.blocks if not out[x[0]]]


def _scores(page: _Page) -> tuple[list[float], list[float], list[int], list[int]]:
    """By node: points less link density, link density, and over whole subtrees the characters and the blocks with links."""
    n = len(page.tags)
    points, chars, linked, links_in = [0.0] * n, [0] * n, [0] * n, [0] * n
    for node, text, in_links in page.blocks:
        worth = _worth(page.tags[node], text, in_links)
        up = page.parents[node] if page.tags[node] in _PARAGRAPHS else node
        for share in SHARES:
            if up <= 0:
                break
            points[up] += worth * share
            up = page.parents[up]
        chars[node] += len(text) - text.count(" ")
        linked[node] += in_links
        links_in[node] += in_links > 0
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = page.parents[i]
        chars[up] += chars[i]
        linked[up] += linked[i]
        links_in[up] += links_in[i]
    density = [min(1.0, b / a) if a else 0.0 for a, b in zip(chars, linked)]
    return [p * (1 - d) for p, d in zip(points, density)], density, chars, links_in


def _looks_like_text(text: str) -> bool:
    return len(text) > 80 or re.search(r"[.!?…](?:\s|$)", text) is not None


def _siblings(page: _Page, best: int, scores, density, chars) -> set[int]:
    """Siblings of the best container that score well or look like text, and headings."""
    own = {node: text for node, text, _ in page.blocks}
    holds: set[int] = set()  # nodes with a paragraph that looks like text
    for node, text, in_links in page.blocks:
        if page.tags[node] == "p" and _looks_like_text(text) and 4 * in_links < len(text):
            while node >= 0 and node not in holds:
                holds.add(node)
                node = page.parents[node]
    kept, least = set(), max(2.0, 0.2 * scores[best])
    for i in range(1, len(page.tags)):
        if page.parents[i] == page.parents[best] and i != best and chars[i]:
            tag = page.tags[i]
            like_text = density[i] < 0.25 and (_looks_like_text(own.get(i, "")) if tag == "p" else i in holds)
            if scores[i] >= least or tag in ("p", "section", "div", "blockquote") and like_text or tag in _HEADINGS:
                kept.add(i)
    return kept


def main_text(html: str | None) -> str:
    page = _Page(html or "")
    page.blocks = _without_boilerplate(page)
    if not page.blocks:
        return ""
    n = len(page.tags)
    scores, density, chars, links_in = _scores(page)
    best = max(range(n), key=lambda i: (scores[i], -i))
    chosen = best
    while chosen > 0 and page.tags[chosen] != "article":
        chosen = page.parents[chosen]
    in_article = chosen > 0
    chosen = chosen if in_article else best
    kept = {chosen} | (_siblings(page, best, scores, density, chars) if best and not in_article else set())
    whole_page = page.tags[chosen] in ("root", "html", "body")
    inside, menu, under = [False] * n, [False] * n, [False] * n  # menus are looked for only where no narrower container was chosen; an article's lists of links belong to it
    for i in range(n):
        up = page.parents[i]
        listed = page.tags[i] in ("ul", "ol") and density[i] > 0.8 and links_in[i] >= 3 and i not in kept
        inside[i] = i in kept or i > 0 and inside[up]
        under[i] = i == chosen or i > 0 and under[up]
        menu[i] = inside[i] and i not in kept and (menu[up] or listed) and (whole_page or not under[i])
    return "\n".join(text for node, text, _ in page.blocks if inside[node] and not menu[node])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""

    def make():
        def apply(rows):
            texts = [main_text(h) for h in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": list(map(len, texts))}

        return apply

    return map_batches(pages.select("page_id", "url", "html"), make, SCHEMA)
