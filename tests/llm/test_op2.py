import random

import numpy as np
import pytest

from lodestone.llm import op2_html as op

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<main><article class="post"><h1>Title &amp; more</h1>
<p>One <b>bold</b> &lt;tag&gt;&nbsp;caf&eacute; &#8212; x<br>y</p><p>Two
 lines<p>Three <a href="/l">link</a> end
<aside>Related</aside><div class="ad">Buy</div><form><p>Name</p><input></form>
<ul><li>item one<li>item two</ul><blockquote>quoted</blockquote>
<div id="comments"><p>Nice post</p></div></article></main>
<div class="sidebar">Side</div><footer>&copy; me</footer></body></html>"""


def text(page, partner=None):
    lines = op.lines_of(page)
    other = None if partner is None else op.hashes_of(op.lines_of(partner))
    return "\n".join(op.main_lines(lines, op.hashes_of(lines), other))


def test_article_text():
    want = "Title & more\nOne bold <tag> café — x y\nTwo lines\nThree link end\nitem one\nitem two\nquoted"
    assert text(PAGE) == want
    assert text(PAGE, PAGE) == want  # a copy is no template


def test_differencing_without_a_container():
    frame = "<html><body><div>Home</div><div>{}</div><div>{}</div><div>All rights kept</div></body></html>"
    one, two = frame.format("First text here", "and its second block"), frame.format("Other words", "of another page")
    assert text(one, two) == "First text here\nand its second block"
    assert text(one) == "Home\nFirst text here\nand its second block\nAll rights kept"


def test_shared_list_of_links_in_the_article():
    page = "<article><h1>{0}</h1><p>{0} body</p><p>{0} more</p><ul><li><a href=1>Up</a></li></ul><p>The same sentence</p></article>"
    assert text(page.format("A"), page.format("B")) == "A\nA body\nA more\nThe same sentence"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p>", "<!--", "<script>", "<a href='", "&am", "<p>&amp", "<![CDATA[x]]>", "<div " * 50, "<p>" * 3000 + "x", "a" * 100_000])
def test_broken_pages(page):
    op.lines_of(page)
    text(page, PAGE)


def test_truncated_references():
    assert text("<article><p>a &amp b &am c &copy d</p></article>") == "a & b &am c © d"


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_against_brute_force():
    rng = random.Random(3)
    for k in range(600):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        used = np.flatnonzero(op.shared_places(np.array(a, np.int64), np.array(b, np.int64)))
        rest = iter(b)
        assert len(used) == longest(a, b) and all(a[i] in rest for i in used)
        at = op._subsequence(a, b)
        assert len(at) == longest(a, b)
        first, second = op._lengths(a, b[: k % 5]), [longest(a[:i], b[: k % 5]) for i in range(len(a) + 1)]
        assert first == second


def test_halving_gives_the_same(monkeypatch):
    rng = random.Random(4)
    a, b = ([rng.randint(0, 9) for _ in range(60)] for _ in range(2))
    monkeypatch.setattr(op, "MOST_BITS", 64)
    assert len(op._subsequence(a, b)) == longest(a, b)


def test_pairs_and_query(spark):
    urls = ["http://h/en/100", "https://h/en/101?x=1", "http://h/en/101#top", "http://h/de/7.html", "http://other/en/5", None, "", "http://h/en/900/"]
    pages = spark.createDataFrame([(i, u, PAGE.replace("Two", f"Two{i}"), 0, 0) for i, u in enumerate(urls)] + [(50, urls[0], None, 0, 0), (0, urls[0], PAGE.replace("Two", "Two0"), 0, 0)], "page_id long, url string, html string, host int, path int")
    pairs = {(r.host, r.path): r.partner for r in op.nearest_paths(op._addressed(pages)).collect()}
    assert pairs[("h", "/en/100")] == "/en/101" and pairs[("h", "/en/101")] == "/en/100"
    assert pairs[("h", "/de/7")] is not None and ("other", "/en/5") not in pairs
    got = op.extract(pages).collect()
    assert len(got) == 10
    assert all(r.text == text(PAGE.replace("Two", f"Two{r.page_id}")) for r in got if r.page_id != 50)
    assert [(r.text, r.n_chars) for r in got if r.page_id == 50] == [("", 0)]


def test_no_pages(spark):
    assert op.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
