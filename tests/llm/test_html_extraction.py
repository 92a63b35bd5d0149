"""HTML extraction: parsing against known blocks, labelling on held-out pages."""

from __future__ import annotations

import html as h
import random
import re

import numpy as np
import pytest

from paperloom.llm import html_extraction as op

MEDIUM = "/root/testdata/sf0.01"


def text_of(page: str) -> list[str]:
    return [b[1] for b in op.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a <b>b</b>c<br>d</p>e", ["a bc", "d", "e"]),
        ("<p>one<p>two<div>three", ["one", "two", "three"]),
        ("<script>var a='</p>';</script><style>p{}</style><p>x", ["x"]),
        ("<script>never closed <p>x", []),
        ("<!-- <p>no --><p title='a > b' class=\"x>y\">yes</p><!-- open", ["yes"]),
        ("a < b &lt; c", ["a < b < c"]),
        ("<p\nclass=x>t&nbsp;\n\t u</P>", ["t u"]),
        ("<title>t</title><h1>&#233;&copy;</h1><p title=\"open>z", ["é©", "z"]),
        ("<ul><li>1<li>2</ul>3", ["1", "2", "3"]),
        ("<p>cut <", ["cut <"]),
    ],
)
def test_blocks(page, want):
    assert text_of(page) == want


def test_paths_and_links():
    page = op.blocks('<div class="Ad top" id=x><a href="/y">go</a></div><article><p>t</p></article>')
    assert page[0][0] == ("div ad top x",) and page[0][2] == 1
    assert page[1][0] == ("article", "p") and page[1][2] == 0
    assert op.marked(page).tolist() == [False, True]


def test_gradients():
    rng = np.random.default_rng(0)
    pages = [rng.standard_normal((n, op.SIZE)) for n in (3, 5)]
    truth = [np.arange(len(p)) % 2 == 0 for p in pages]
    model = op.Labeller(hidden=4)
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}

    def loss():
        score, real = model._both(pages)[-1], model._padded(pages)[2]
        want = np.zeros(real.shape)
        for j, t in enumerate(truth):
            want[: len(t), j] = t
        return -((want * np.log(score) + (1 - want) * np.log(1 - score)) * real).sum() / real.sum()

    before = loss()
    for _ in range(30):
        model.fit(pages, truth, epochs=1)
    assert loss() < before / 3
    assert [y.tolist() for y in model.label(pages)] == [t.tolist() for t in truth]
    assert [y.tolist() for y in model.label([pages[1], np.zeros((0, op.SIZE)), pages[0]])] == [
        truth[1].tolist(), [], truth[0].tolist()
    ]


@pytest.fixture(scope="module")
def labeller(spark):
    return op.train(spark.read.parquet(f"{MEDIUM}/pages.parquet"))


def test_articles_of_the_given_pages(spark, labeller):
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in op.extract(pages, labeller).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", html[r.page_id], re.DOTALL)[1]
        inner = re.sub(r"<(?!/?b>)[^>]*>", " ", inner)
        assert r.text == " ".join(h.unescape(re.sub(r"</?b>", "", inner)).split())
        assert r.n_chars == len(r.text)


def test_held_out_layouts(spark, labeller):
    rng = random.Random(11)
    seen = [op.blocks(r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    spare = [b[1] for p in seen for b in p]
    made = [op.variant(p, op.marked(p), spare, rng) for p in seen for _ in range(4)]
    vectors = op.Vectors()
    found = labeller.label([vectors.of(p) for p, _ in made])
    wrong = sum(int((y != t).sum()) for y, (_, t) in zip(found, made, strict=True))
    assert wrong < 0.01 * sum(len(t) for _, t in made)


def test_awkward_rows(spark, labeller):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<article><p>a</p></article>"), (2, None, "<p>" * 3000 + "x" * 100_000), (2, "", "<")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = op.extract(pages.withColumn("text", pages.url).withColumn("n_chars", pages.url), labeller)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    assert {r.text for r in got.filter("page_id = 1").collect()} == {""}
    empty = pages.limit(0)
    assert op.extract(empty).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<datalist><option value=a><option value=b></datalist><article><p>text</article>", ["text"]),
        ("<p>a<datalist id=x><option>one<option>two</datalist><p>b<select><option>c</select>d", ["a", "b", "d"]),
        ("<p>a<select><optgroup label=x><option>one<option>two</select><div>b</div>", ["a", "b"]),
        ("<div><select><option>one<option>two</div><p>b<select><option>c</select><p>d", ["b", "d"]),
        ("<datalist><option>one<p>b", ["b"]),
        ("<option>one<option>two<p>b</p><option>c</option>d", ["b", "d"]),
    ],
)
def test_options_without_end_tags(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("layout", ['<div class="post">', '<div class="content">', "<section>", "half"])
def test_pages_without_a_main_element(spark, layout):
    """The article of the given pages in other containers; the truth is the article as it was."""
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    rows, want = [], {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.DOTALL)[1]
        want[r.page_id] = " ".join(h.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())
        tag = '<div class="post">' if layout == "half" else layout
        other = r.html.replace("<article>", tag).replace("</article>", "</section>" if tag == "<section>" else "</div>")
        rows.append((r.page_id, r.url, r.html if layout == "half" and r.page_id % 2 else other))
    found = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sum(found[k] == want[k] for k in want) >= 0.95 * len(want)


HAND = [
    ('<body><div class="top"><a href=/>Home</a> <a href=/x>News</a></div><div id="story"><h1>A title</h1><p>' + "Long prose of the story. " * 20
     + '</p><p>More of it.</p></div><div class="sidebar"><p>Side text</p></div>', ["A title", "More of it."], ["Home", "Side text"]),
    ("<body><nav><a href=/>Go</a></nav><table><tr><td>" + "A cell of long prose. " * 30 + "</td></tr></table><footer>Imprint</footer>",
     ["A cell of long prose."], ["Go", "Imprint"]),
]


@pytest.mark.parametrize(("page", "inside", "outside"), HAND)
def test_densest_container_of_hand_written_pages(page, inside, outside):
    blocks = op.blocks(page)
    _, truth = op.densest(blocks)
    kept = " ".join(b[1] for b, y in zip(blocks, truth, strict=True) if y)
    assert all(x in kept for x in inside) and not any(x in kept for x in outside)


def test_windows_of_a_long_page_read_as_one(monkeypatch):
    rng = np.random.default_rng(4)
    model, page = op.Labeller(), rng.standard_normal((500, op.SIZE)).astype(np.float32)
    whole = model.label([page])[0]
    monkeypatch.setattr(op, "GROUP_BLOCKS", 64)
    assert model.label_long(500, lambda a, b: page[a:b]).tolist() == whole.tolist()


def test_a_page_of_many_blocks(spark, labeller):
    html = "<article>" + "<p>some words of text</p>" * 60_000 + "</article>"
    row = op.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), labeller).first()
    assert row.n_chars == len(row.text) and row.text.count("some words") > 50_000
