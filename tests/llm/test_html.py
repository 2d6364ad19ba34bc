import html
import re

import numpy as np
import pytest

from millrace.llm import htmltext

from .layouts import LAYOUTS, f1


def test_sum_product_equals_enumeration():
    """Marginals of a small tree against the sum over all labellings."""
    tree = htmltext.parse("<div><p>one</p><div><p>two</p><p>three</p></div></div>")
    forest, n = htmltext.Forest([tree]), len(tree.parent)
    rng = np.random.default_rng(1)
    z, edge = rng.normal(size=n), rng.normal(size=(n, 2, 2))
    got = 1 / (1 + np.exp(-forest.beliefs(z, edge)[0]))
    total, ones = 0.0, np.zeros(n)
    for k in range(1 << n):
        x = [(k >> i) & 1 for i in range(n)]
        w = np.exp(sum(z[i] * x[i] for i in range(n)) + sum(edge[i, x[tree.parent[i]], x[i]] for i in range(1, n)))
        total += w
        ones += w * np.array(x)
    assert np.allclose(got, ones / total)


def test_held_out_pages():
    model, right, wrong = htmltext.default_model(), 0, 0
    trees = [htmltext.parse(p, labels=True) for p in htmltext.labelled_pages(150, seed=5)]
    for t, m in zip(trees, model.marginals(trees)):
        for i, tag in enumerate(t.tag):
            if tag == "#text":
                right += (m[i] > 0) == (t.label[i] == 1)
                wrong += (m[i] > 0) != (t.label[i] == 1)
    assert right / (right + wrong) > 0.97


def test_articles_of_the_pages(spark, sf):
    got = {r.page_id: r for r in htmltext.op2_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    same = 0
    for p in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        inner = re.sub(r"<[^>]*\Z", "", inner)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        same += got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
    assert same == len(pages)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<article><p>Only &lt;text&gt; &amp;amp; more</p></article>", "Only <text> &amp; more"), ("<html><head><title>t</title><script>a < b</script></head><body><article><h1>A  title</h1><p>Some\n text <b>here</b>.</p></article><footer>&copy; x</footer></body></html>", "A title\nSome text here."),
        ("<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><p>First one here.</p><div class='ad'>Buy it now!</div><p>Second one here.</p></article><section id=comments><p>I liked it.</p></section></body>", "First one here.\nSecond one here."),
        ("<article><p>a first line<p>and a second<p unclosed 'quote", "a first line\nand a second"),
    ],
)
def test_pages(page, want):
    assert htmltext.default_model().extract([page]) == [want]


def test_cases(spark):
    data = [(1, None, None, 7), (None, "u", "<article><p>The same text.</p></article>", 8), (None, "u", "<article><p>The same text.</p></article>", 8), (2, "v", "<p>" + "word " * 100_000 + "</p>", 9)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text long")
    got = htmltext.extract(pages).collect()
    assert sorted(r.n_chars for r in got)[:3] == [0, 14, 14] and len(got) == 4
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_layouts_of_no_generator():
    model = htmltext.default_model()
    scores = {name: f1(model.extract([page])[0], want) for name, (page, want) in LAYOUTS.items()}
    assert sum(scores.values()) / len(scores) > 0.95 and min(scores.values()) > 0.85, scores


def test_kept_model_is_the_trained_one():
    kept, made = htmltext.default_model(), htmltext.train(htmltext.labelled_pages())
    assert kept.weights.keys() == made.weights.keys() and all(abs(kept.weights[k] - w) < 1e-3 for k, w in made.weights.items())
    assert all(np.allclose(kept.edges[k], e, atol=1e-3) for k, e in made.edges.items())


@pytest.mark.parametrize("value", ["Price", "1", "0", ""])
def test_labels_are_for_training_only(value):
    page = f'<article><p data-label="{value}">The first.</p><p>The second.</p></article>'
    assert htmltext.default_model().extract([page]) == ["The first.\nThe second."]
    assert set(htmltext.parse(page).label) == {None}


@pytest.mark.parametrize("page", ["<article>" + "<b>" * 30_000 + "<p>word</p>" * 3000, "<div>" * 50_000 + "text", "<p><i>" * 20_000, "<ul>" + "<li><b>x" * 20_000, "<table>" + "<tr><td>" * 20_000, "</b>" * 50_000 + "<article><p>x</p>", "<a>" * 30_000 + "<p>x"])
def test_long_unclosed_markup_in_linear_time(page):
    import time

    began = time.process_time()
    tree = htmltext.parse(page)
    assert time.process_time() - began < 5 and max(tree.depth) <= htmltext.DEEPEST + 1
    htmltext.default_model().extract([page])


def test_names_put_together():
    model = htmltext.default_model()
    article = "<div class='post-body'><h1>The title</h1><p>A first paragraph of some length, and a sentence. Another one follows it here.</p><p>And more of it.</p></div>"
    for name in ("cookiebar", "cookie-bar", "sidebarbox", "topmenu", "footernav"):
        assert "else" not in model.extract([f"<body><div class='{name}'><p>Something else altogether.</p></div>{article}</body>"])[0]
