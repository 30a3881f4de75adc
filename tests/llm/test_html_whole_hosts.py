"""A host's wrapper is inferred from all its pages, in leaves, whatever the partitions."""

import random

import pytest

from causeway.llm import html_extract as h

RARE = "<div class=k7>Win a trip to the sea</div>"
PAGE = "<html><body><div class=m1><a href=/>Start</a></div><div class=q4><h2>Head {n}</h2><p>Some words about {n}, varying as {n} does.</p>{r}<p>More of {n} goes on here.</p></div></body></html>"


def page(n):
    return PAGE.replace("{r}", RARE if n % 25 == 3 else "").replace("{n}", f"{n} {n * n}")


def want(n):
    return f"Head {n} {n * n} Some words about {n} {n * n}, varying as {n} {n * n} does. More of {n} {n * n} goes on here."


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)


@pytest.mark.parametrize("leaf,parts", [(512, 3), (20, 3), (2, 2)])
def test_constants_of_few_pages_are_known(spark, leaf, parts):
    """A block on one page in 25, which few samples of eight pages hold three times.  With two pages
    a leaf there are 128 leaves, aligned in two rounds."""
    rows = [(n, f"http://h.example/{n}", page(n)) for n in range(200)] + [(-1, "http://small.example", page(3)), (-2, "http://h.example", None), (-3, None, "")]
    got = {r.page_id: (r.text, r.n_chars) for r in h.extract(table(spark, rows, parts), leaf).collect()}
    assert len(got) == len(rows)
    assert {n: got[n] for n in range(200)} == {n: (want(n), len(want(n))) for n in range(200)}
    assert got[-2] == got[-3] == ("", 0) and got[-1][0] == h.main_text(page(3))


def test_wrapper_does_not_depend_on_partitions_or_copies(spark):
    rng = random.Random(7)
    parts = ["<p>{n} text</p>", "<ul><li>{n}<li>x</ul>", "<div class=a{n}>fixed</div>", "<h2>{n}</h2>", "<div class=b><p>{n}</p><hr></div>", RARE]
    htmls = ["<body><div>" + "".join(rng.sample(parts, 4)).replace("{n}", str(n)) + "</div>" for n in range(60)]
    rows = [(n, f"http://h.example/{n}", x) for n, x in enumerate(htmls)]
    one = [tuple(r) for r in h.wrappers(table(spark, rows, 1), 8).collect()]
    copies = rows + [(100 + n, "http://h.example/c", htmls[n % 3]) for n in range(4)]
    assert len(one) == 1 and [tuple(r) for r in h.wrappers(table(spark, copies, 5), 8).collect()] == one


def test_a_text_on_nearly_all_pages_is_constant():
    odd = "<body><div><h1>{n}</h1><p>Words {n} that vary, and more.</p><p class=z>Other words this time</p></div>"
    usual = odd.replace("Other words this time", "Read us daily")
    pages = [(odd if n == 17 else usual).replace("{n}", str(n)) for n in range(60)]
    w = h.plan(h.infer(pages))
    assert h.main_text(pages[3], w) == "3 Words 3 that vary, and more."
    assert h.main_text(pages[17], w) == "17 Words 17 that vary, and more. Other words this time"


def test_packed_wrappers_come_back():
    w = h.infer([page(n) for n in range(30)])
    assert h.unpacked(h.packed(w)) == w and '"Win a trip to the sea"' in h.expression(w)


def test_wrappers_grow_with_ways_and_not_with_pages():
    """Every page names its blocks anew."""
    def own(n):
        x = "".join("abcdefghij"[int(d)] for d in str(n))
        return f"<body><nav>menu</nav><div class=box-{x}><h1>{n}</h1><p class=p-{x}>Text {n} of this page.</p><x-{x}>{n}</x-{x}></div><div class=c>{n} {n}</div><footer>f</footer>"

    size = {k: len(h.packed(h.infer([own(n) for n in range(k)]))) for k in (600, 2400)}
    assert size[2400] < 1.1 * size[600] < 10_000
    w = h.plan(h.infer([own(n) for n in range(600)]))
    for n in (5, 599, 700):
        assert f"{n} Text {n} of this page. {n}" in h.main_text(own(n), w) and "menu" not in h.main_text(own(n), w)
