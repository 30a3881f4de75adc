"""Wrappers decide what is article text: neutral names, names inside articles, slow pages, whole tables."""

import time
from html.parser import HTMLParser

import pytest

from causeway.llm import catalog, html_extract as h


def by_wrapper(pages, at=0):
    return h.main_text(pages[at], h.plan(h.infer(pages)))


def test_expression():
    w = h.infer(["<ul><li>a</ul><p>same</p>", "<ul><li>b<li>c</ul><hr><p>same</p>"])
    assert h.expression(w) == '<#page><ul>(<li>#TEXT</li>)+</ul>(<hr></hr>)?<p>"same"</p></#page>'
    w = h.infer(["<h2>a</h2><p>b</p>" * 20])
    assert h.expression(w) == "<#page>(<h2>\"a\"</h2>)+(<p>\"b\"</p>)+</#page>"


PAGE = (
    "<html><body><div class=m1><a href=/>Start</a><a href=/n>News {n}</a></div><div class=q4><h2>Head {n}</h2><p>Some words about {n} and more of them, all varying {n}.</p>"
    "<p>Second paragraph number {n} goes on for a while.</p><div class=xq7>Get our letter every week</div>"
    "<ol class=cm>{c}</ol></div><div class=z9>All rights reserved by us</div></body></html>"
)
COMMENT = "<li><b>Ann {n}</b> <time>yesterday</time><p>nice {n}</p></li>"
PAGES = [PAGE.replace("{c}", COMMENT * (1 + n % 3)).replace("{n}", str(n)) for n in range(8)]


def test_neutral_names_only_the_wrapper_can_tell():
    want = "Head 2 Some words about 2 and more of them, all varying 2. Second paragraph number 2 goes on for a while."
    assert by_wrapper(PAGES, 2) == want
    assert "letter every week" in h.main_text(PAGES[2])  # a page alone can't show what is constant


@pytest.mark.parametrize("inner", [
    '<div class="related-work"><h2>Related work</h2><p>{}</p></div>', '<p class="share-price">{}</p>', '<blockquote class="comment">{}</blockquote>',
    '<div class="article-header"><h1>{}</h1></div>', '<div class="faq"><div><h3>Q</h3><p>{}</p></div></div>', "<header><h1>{}</h1></header>",
])
def test_article_text_under_telling_names_stays(inner):
    pages = [f"<body><nav>menu</nav><article><p>Opening words {n} of the article, long enough.</p>{inner.format(f'kept {n} text')}</article></body>" for n in range(6)]
    assert "kept 1 text" in by_wrapper(pages, 1) and "menu" not in by_wrapper(pages, 1)
    assert "kept 1 text" in h.main_text(pages[1])


@pytest.mark.parametrize("opening", ['<main class="has-sidebar">', '<div class="no-sidebar">', '<div class="layout-with-sidebar">', '<article class="notice-board">', '<div id="page_header_fixed">'])
def test_article_inside_telling_names_stays(opening):
    name = opening[1:].split()[0]
    pages = [f"<body><div class=sidebar>links</div>{opening}<h1>Title {n}</h1><p>words {n}</p></{name}><footer>f</footer></body>" for n in range(6)]
    assert by_wrapper(pages, 3) == "Title 3 words 3" and h.main_text(pages[3]) == "Title 3 words 3"


def test_parts_of_an_article_that_are_none():
    page = "<article><h1>T {n}</h1><p>Body {n} of the text, which is long.</p><div class='ad'>Buy {n}</div><aside>See {n}</aside><form>Your mail<input></form><section id=comments><p>nice {n}</p></section><footer>by {n}</footer></article>"
    pages = [page.replace("{n}", str(n)) for n in range(6)]
    assert by_wrapper(pages, 4) == h.main_text(pages[4]) == "T 4 Body 4 of the text, which is long."


def test_copies_show_no_constants():
    """Pages of a host that are near copies have most text in common: nothing is taken for boilerplate."""
    pages = [f"<body><div class=k><h1>One title</h1><p>The same long text on every page of this host, as copies have it.</p><i>{n}</i></div></body>" for n in range(6)]
    assert by_wrapper(pages, 1).startswith("One title The same long text")


def test_other_template_and_unsampled_pages():
    w = h.plan(h.infer(PAGES))
    assert h.main_text("<body><article>other <b>kind</b></article></body>", w) == "other kind"
    assert h.main_text("<body>plain", w) == "plain" and h.main_text("", w) == h.main_text(None, w) == ""
    more = PAGES[0].replace("</h2>", "</h2><table><tr><td>new part</td></tr></table>")
    assert "new part" in h.main_text(more, w)


SLOW = ["<b>" * 20_000 + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<div " * 20_000, "<!--" * 20_000, "<" * 50_000, "<p><b>" * 5_000, "<li>" * 20_000]


@pytest.mark.parametrize("n", range(len(SLOW)))
def test_time_is_linear(n):
    began = time.process_time()
    h.main_text(SLOW[n])
    h.infer([SLOW[n], SLOW[n]])
    assert time.process_time() - began < 3


def test_alternating_and_distinct_siblings_align_fast():
    began = time.process_time()
    h.infer(["<article>" + "".join(f"<h2>a{i}{j}</h2><p>t{i} {j}</p>" for i in range(8_000)) + "</article>" for j in range(6)])
    h.infer(["<div>" + "".join(f"<p class={'abcdefgh'[i % 8] * (i // 8 % 300 + 1)}>{i}{j}</p>" for i in range(3_000)) + "</div>" for j in range(6)])
    assert time.process_time() - began < 12


class Article(HTMLParser):
    """An independent reading of the test pages: what is inside <article>, blocks apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in ("b", "i", "a", "em", "span"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("b", "i", "a", "em", "span"):
            self.out.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_all_pages_against_another_parser(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = catalog.queries()["op4_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        a = Article()
        a.feed(pages[r.page_id])
        assert r.text == " ".join("".join(a.out).split()) and r.n_chars == len(r.text)


WORDS = "river stone garden winter lamp paper window forest bridge cloud market silver".split()


def prose(i, n=14):
    return " ".join(WORDS[(i * 7 + j * (i % 5 + 1)) % 12] + str((i + j) % 9) for j in range(n))


def texts_of(make, n=8):
    """What a host's wrapper and each page alone give for pages made by ``make``."""
    pages = [make(i) for i in range(n)]
    shared = h.plan(h.infer(pages))
    return [(h.main_text(p, shared), h.main_text(p)) for p in pages]


HEAD, FOOT = "<html><body><nav><a href=/>Home</a></nav>", "<footer>All rights reserved</footer></body></html>"
SHAPES = {
    "form round the page": (lambda i: f"<form action=/x><input type=hidden><article><h1>{prose(i, 3)}</h1><p>{prose(i)}</p></article></form>", lambda i: f"{prose(i, 3)} {prose(i)}"),
    "form without an article": (lambda i: f"<form id=aspnetForm><div><h1>{prose(i, 3)}</h1><p>{prose(i)}</p></div></form>", lambda i: f"{prose(i, 3)} {prose(i)}"),
    "long text in a form": (lambda i: f"<form><div><p>{prose(i, 60)}</p><p>{prose(i + 1, 60)}</p></div></form>", lambda i: f"{prose(i, 60)} {prose(i + 1, 60)}"),
    "form to fill in": (lambda i: f"<article><h1>{prose(i, 3)}</h1><p>{prose(i)}</p><form><p>Write to us</p><input></form></article>", lambda i: f"{prose(i, 3)} {prose(i)}"),
    "recipe": (
        lambda i: f"<article><h1>{prose(i, 3)}</h1><h2>Ingredients</h2><p>{prose(i)}</p><h2>Method</h2><p>{prose(i + 3)}</p></article>",
        lambda i: f"{prose(i, 3)} Ingredients {prose(i)} Method {prose(i + 3)}",
    ),
    "timeline": (
        lambda i: f"<article><h1>{prose(i, 3)}</h1><ol>" + "".join(f"<li><b>19{i}{k}</b> <time>19{i}{k}</time><p>{prose(i + k)}</p></li>" for k in range(4)) + "</ol></article>",
        lambda i: f"{prose(i, 3)} " + " ".join(f"19{i}{k} 19{i}{k} {prose(i + k)}" for k in range(4)),
    ),
    "card beside the article": (
        lambda i: f"<article><h1>{prose(i, 3)}</h1><p>{prose(i)}</p></article><article class=card><h3>{prose(i + 5, 4)}</h3><p>{prose(i + 5, 50)}</p></article>",
        lambda i: f"{prose(i, 3)} {prose(i)}",
    ),
    "long names": (
        lambda i: f"<article><h1>{prose(i, 3)}</h1><div class='cookie-notice-bar'><p>We use cookies {i}</p></div><p>{prose(i)}</p><div class='comments__list'><p>{prose(i + 2, 5)}</p></div></article>",
        lambda i: f"{prose(i, 3)} {prose(i)}",
    ),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes_of_pages(shape):
    make, want = SHAPES[shape]
    for i, (shared, alone) in enumerate(texts_of(lambda i: HEAD + make(i) + FOOT)):
        assert shared == alone == want(i)
