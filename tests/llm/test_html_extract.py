"""Operator 8: labelled pages, a scorer by brute force, and pages made to be slow."""

import random
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from logweave.llm import html_extract

LONG = "This is a paragraph of the article, with commas, and with quite enough words to be worth some points."
OTHER = "Something else, which stands beside the article, and is as long as one of its paragraphs, or longer."

#: (page, its main text)
LABELLED = [
    (f'<article><h2 id="comments-on-method">A</h2><section id="related-work"><p>B.</p></section><p id="share-price">C</p><h2 id="social-impact">D</h2><div class="widget-theory">E</div><p>{LONG}</p></article>', f"A\nB.\nC\nD\nE\n{LONG}"),
    (f"<article><p>{LONG}</p><ul>{'<li><a href=x>R</a></li>' * 3}</ul></article>", f"{LONG}\nR\nR\nR"),
    (f"<div class=ad>{OTHER}</div><article><h1>T</h1><p>{LONG}</p><div class='ad-slot'>{OTHER}</div><div class=share-buttons>Share</div></article>", f"T\n{LONG}"),
    (f"<article><p>{LONG}</p><section id=comments><p>{OTHER}</p></section></article>", LONG),
    (f"<div id=main><p>{LONG}</p><p>{LONG}</p></div><div class='related-posts'><p>{OTHER}</p></div><div id='cookie-banner'>{OTHER}</div>", f"{LONG}\n{LONG}"),
    (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</p></article><aside><p>{OTHER}</p></aside><form>{OTHER}</form>", f"Title\n{LONG}"),
    (f"<div class=site-footer>{OTHER}</div><div role=navigation>{OTHER}</div><div hidden>{OTHER}</div><main><p>{LONG}</p></main>", LONG),
    (f"<p a='1>2' b=\"</p>\">{LONG}</p><script>'<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> -->", LONG),
    ("<p>&amp;&lt;&#233;&#x41;\n\t two</p><p>a<br>b</p>", "&<éA two\na b"),
    ("", ""), ("no markup, only text", "no markup, only text"),
]


@pytest.mark.parametrize("html, text", LABELLED)
def test_labelled_pages(html, text):
    assert html_extract.main_text(f"<html><body>{html}</body></html>") == text


def brute_scores(page):
    """Every sum by walking from each block to the root, or from each node over all blocks."""
    n = len(page.tags)

    def path(i):
        while i >= 0:
            yield i
            i = page.parents[i]

    points, chars, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, in_links in page.blocks:
        own = [i for i in path(node) if i > 0]
        if page.tags[node] in html_extract._PARAGRAPHS:
            own = own[1:]
        for share, i in zip(html_extract.SHARES, own):
            points[i] += share * html_extract._worth(page.tags[node], text, in_links)
    for i in range(n):
        inside = [b for b in page.blocks if i in path(b[0])]
        chars[i] = sum(len(t.replace(" ", "")) for _, t, _ in inside)
        linked[i] = sum(x for _, _, x in inside)
    density = [min(1.0, b / a) if a else 0.0 for a, b in zip(chars, linked)]
    return [p * (1 - d) for p, d in zip(points, density)], density, chars


def test_scores_equal_brute_force():
    r = random.Random(3)
    for _ in range(60):
        html = "".join(r.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<ul>", "<li>", "</ul>", "<h2>", "</h2>", "some words, and more. ", LONG]) for _ in range(60))
        page = html_extract._Page(html)
        scores, density, chars, _ = html_extract._scores(page)
        expected = brute_scores(page)
        assert scores == pytest.approx(expected[0]) and density == pytest.approx(expected[1]) and chars == expected[2]


@pytest.mark.parametrize("html", ["<div>" * 20_000 + f"<p>{LONG}", f"<div><p>{LONG}" * 20_000, "<noscript>a" * 50_000, "<a href=\"x'" * 50_000, "</x>" * 50_000 + "<div>" * 50_000, "<!--" * 50_000, "<" * 200_000])
def test_work_is_in_proportion_to_the_page(html):
    began = time.process_time()
    html_extract.main_text(html)
    assert time.process_time() - began < 10


class Article(HTMLParser):
    """The text blocks of the article element, by the standard library's parser."""

    def __init__(self, html):
        super().__init__()
        self.depth, self.blocks, self.raw = 0, [""], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attributes):
        self.depth += tag == "article"
        if tag in ("article", "p", "h1", "h2", "ul", "li", "div", "section", "table", "tr", "td", "blockquote", "pre"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("article", "p", "h1", "h2", "ul", "li", "div", "section", "table", "tr", "td", "blockquote", "pre"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth > 0:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_the_tables_articles_are_whole(spark):
    folder = "/root/testdata/sf0.01"
    pages = pq.read_table(f"{folder}/pages.parquet").to_pydict()
    plain = {i: Article(h).text() for i, h in zip(pages["page_id"], pages["html"]) if h and h.count("<article") == 1}
    got = {r["page_id"]: r for r in html_extract.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    assert len(got) == len(pages["page_id"]) and len(plain) > 0.9 * len(got)
    assert all(got[i]["n_chars"] == len(got[i]["text"]) for i in got)
    same = [got[i]["text"] == t for i, t in plain.items()]
    assert sum(same) >= 0.98 * len(same)
