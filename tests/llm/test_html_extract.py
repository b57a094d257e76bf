import html
import itertools
import re
import time
import tracemalloc

import numpy as np
import pytest

from skyledger.llm import html_extract as op
from skyledger.llm.common import table


@pytest.fixture(scope="module")
def seeds():
    return op.fit_chain(op.hand_labelled())


def texts(page):
    return [block.text for block in op.leaf_blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []), ("", []), ("  \n ", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>a &amp b&nbsp; c&#233;<br>d</p>e", ["a & b cé d", "e"]),
        ("<p>x<!-- <p>no --> y", ["x y"]), ("<p>x<!-- open", ["x"]), ("<p>x<a href='>'>y</a><p cla", ["xy"]), ("1 < 2<p>3 <4", ["1 < 2", "3 <4"]),
        ("<script>var t='</p>';</script><p>a<STYLE>p{}</Style>b", ["a", "b"]), ("<script>open", []), ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<p><b>a</p><p>b</b></p>", ["a", "b"]), ("</div></p>a</article>", ["a"]), ("<div>a<div>b</div>c</div>", ["a", "b", "c"]), ("<svg/><p>a", ["a"]),
        ("<p>é<script>İ</SCRIPT >b", ["é", "b"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_decoding_and_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5):
        scores, steps = rng.normal(size=(1, size, 2)), rng.normal(size=(2, 2))
        scores[:, :, 0] = 0
        ways = list(itertools.product((0, 1), repeat=size))
        value = [sum(scores[0, k, y] for k, y in enumerate(w)) + sum(steps[a, b] for a, b in zip(w, w[1:])) for w in ways]
        blocks = [op.Block("", (), 0, [str(k)]) for k in range(size)]
        chain = op.Chain({str(k): scores[0, k, 1] for k in range(size)}, steps)
        assert tuple(chain.decode(blocks)) == ways[int(np.argmax(value))]
        nodes, pairs, total = op.forward_backward(scores, steps, np.array([size]))
        chance = np.exp(value) / np.exp(value).sum()
        assert total[0] == pytest.approx(np.log(np.exp(value).sum()))
        assert np.allclose(nodes[0, :, 1], [sum(c for c, w in zip(chance, ways) if w[k]) for k in range(size)])
        assert pairs.sum() == pytest.approx(size - 1)
    assert op.Chain({}, np.zeros((2, 2))).decode([]) == []


UNSEEN = """<html><head><title>T</title></head><body><div class="navbar"><a>Home</a> <a>News</a></div><div class="gdpr-consent"><p>We use cookies. Please agree.</p></div>
<div class="container"><div class="left-rail sidebar"><p>Popular today. Read this too.</p></div><div class="article-body"><h1>A title</h1><p>The first paragraph of the story, which has <i>two</i> clauses.</p>
<p>Second one.<p>Third &amp; last, with a <a href="x">link</a> in it.</div><div class="user-comments"><p>I do not agree with any of this at all.</p></div></div><div class="site-footer">© 2021</div></body></html>"""


def test_unseen_layout(seeds):
    want = "A title\nThe first paragraph of the story, which has two clauses.\nSecond one.\nThird & last, with a link in it."
    assert seeds.main_text(UNSEEN) == want
    assert seeds.main_text(UNSEEN.replace("article-body", "c1x")).startswith("A title\nThe first paragraph")


def test_nothing_is_cut_from_a_long_page(seeds):
    page = "<nav><a>x</a></nav><article>" + "".join(f"<p>Paragraph number {k} of many.</p>" for k in range(5000)) + "</article><footer>y</footer>"
    assert seeds.main_text(page).split("\n") == [f"Paragraph number {k} of many." for k in range(5000)]


def article(page):
    inner = page.split("<article>")[1].split("</article>")[0] if "<article>" in page else ""
    parts = re.split(r"<(?:p|/p|h1|/h1)>", inner)
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", part)).split()) for part in parts)
    return "\n".join(part for part in plain if part)


def test_whole_table(spark, small):
    pages = table(spark, small, "pages")
    odd = spark.createDataFrame([(900, None, None), (None, "u", ""), (901, "u", UNSEEN), (901, "u", UNSEEN)], pages.schema)
    got = op.extract_main_text(pages.unionByName(odd).selectExpr("*", "'x' AS text", "1 AS n_chars")).collect()
    rows = pages.collect()
    assert len(got) == len(rows) + 4
    by_id = {r.page_id: r for r in got}
    assert by_id[900].text == by_id[None].text == "" and by_id[900].n_chars == 0
    exact = sum(by_id[r.page_id].text == article(r.html or "") for r in rows)
    assert exact >= 0.99 * len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert op.extract_main_text(pages.limit(0)).count() == 0


MEGABYTE = {
    "unclosed elements": "<div>x" * 170_000,
    "elements with words of their own": "".join(f'<div class="w{k}">x' for k in range(50_000)),
    "open tags and a quote": "<a " * 330_000 + '"',
    "quotes that never end": "<a '\"" * 200_000,
    "end tags without a start": "<b>" * 170_000 + "</i>" * 120_000,
    "end tags behind a border": "<b><div>" + "<i>" * 170_000 + "</b>" * 120_000,
    "end tags of nothing": "<div>" * 100_000 + "</section>" * 50_000,
    "open paragraphs": "<p>x" * 200_000,
}


def peak(chain, page):
    tracemalloc.start()
    chain.main_text(page)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


@pytest.mark.parametrize("kind", sorted(MEGABYTE))
def test_a_megabyte_of_broken_markup_costs_seconds(seeds, kind):
    """Twice the page takes about twice the memory, and the whole of it under 300 MB and some seconds."""
    page = MEGABYTE[kind]
    half, whole = (peak(seeds, page[: len(page) // part]) for part in (10, 5))
    assert whole < 3 * half + (1 << 20) and 5 * whole < 300 << 20
    began = time.process_time()
    seeds.main_text(page)
    assert time.process_time() - began < 20


def test_end_tags_and_borders():
    assert texts("<b>a<div>b</b>c</div>d</b>e") == ["a", "bc", "de"]
    assert texts("<div><p>a<table><tr><td>b<p>c</table>d") == ["a", "b", "c", "d"]
    assert texts("<ul><li>a<div>b<li>c</ul>d") == ["a", "b", "c", "d"]
    assert texts("<a <b>x</a> y") == ["x y"] and texts('<p title="a > b">x') == ["x"] and texts('x<p title="a > b') == ["x"]


def test_features_of_a_path():
    page = '<main><div class="post"><span class="ad">x</span><div class="post other">y<nav>z</nav></div></div>'
    blocks = {block.text: op.path_features(block.element) for block in op.leaf_blocks(page)}
    assert blocks["x"] == ["in div", "in main", "near main", "tag div", "word post"]
    assert blocks["y"] == ["in div", "in main", "near main", "tag div", "word other", "word post"]
    assert blocks["z"] == ["in div", "in main", "in nav", "near nav", "tag nav", "word other", "word post"]
    blind = op.leaf_blocks(page, blind=True)
    assert op.path_features(blind[0].element) == ["in div", "near none", "tag div"]


def test_of_pages_of_one_id_one_is_trained_on(spark):
    rows = [(1, "u", f"<article><p>Page {k} says a thing.</p></article><footer>f</footer>") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = op.train(pages, op.Settings(steps=3))
    assert op.train(pages.repartition(5), op.Settings(steps=3)).weights == first.weights
