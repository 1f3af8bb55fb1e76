import time

import numpy as np
import pytest
from marlstone.llm import html_main_text as h
from marlstone.llm.html_blocks import leaf_blocks


@pytest.fixture(scope="module")
def model():
    return h.default_model()


def texts(page):
    return [x.text for x in leaf_blocks(page)]


def test_blocks():
    assert texts("") == [] and texts("plain &amp; text") == ["plain & text"]
    assert texts("<p>a<b>b</b> c<br>d<p>e&nbsp;&eacute;\n\t f</div>g") == ["ab c d", "e é f", "g"]
    assert texts("<script>x<p>y</script><style>p{}</style><!-- <p>no --><p>yes</p><title>t</title>") == ["yes"]
    assert texts('<p title="a>b" data=\'<p>\'>in</p><p class="x>tail') == ["in", "tail"]
    assert texts("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>") == ["one", "two", "a", "b"]
    assert texts("<head><title>no</title><body><p>1 < 2 & 3 > 2</p><script>unclosed <p>x") == ["1 < 2 & 3 > 2"]
    assert leaf_blocks('<nav><a href="/">Home</a></nav>')[0].link_chars == 4
    assert len(texts("<p>x</p>" * 3000)) == 3000


def test_gradients(model):
    """Back-propagation agrees with finite differences."""
    net, rng = h.BiLSTM(3), np.random.default_rng(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = rng.standard_normal((5, 2, h.INPUT)), np.ones((5, 2))
    mask[3:, 1] = 0
    y = (rng.random((5, 2)) > 0.5).astype(float)

    def loss():
        p = net.predict(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = net.gradients(x, mask, y)
    for name in ("xf", "hb", "cf", "o", "p"):
        at = tuple(s // 2 for s in net.w[name].shape)
        old = net.w[name][at]
        net.w[name][at] = old + 1e-3
        up = loss()
        net.w[name][at] = old - 1e-3
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3


def test_held_out_accuracy(model):
    right = total = 0
    for x, y in h.training_set(150, 4242):
        p = model.predict(x[:, None], np.ones((len(x), 1), np.float32))[:, 0] >= 0.5
        right, total = right + (p == y).sum(), total + len(y)
    assert right / total > 0.985


PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body><div class="cookie-notice"><p>We use cookies on this site.</p></div><header><p>The Site</p></header>
<nav><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></nav><article><h1>A &lt;title&gt;</h1><p>First paragraph of the story, with words.<p>Second one, which&nbsp;goes on for some time.</p></article>
<aside class="sidebar"><ul><li><a href="/r">Related articles</a></ul></aside><form class="search"><p>Search</p></form>
<div id="comments"><h3>2 comments</h3><p>I liked it very much.</p></div><footer>&copy; site &middot; All rights reserved</footer></body></html>"""
MAIN = "A <title>\nFirst paragraph of the story, with words.\nSecond one, which goes on for some time."


def test_extract(spark, model):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, "u", None, "t"), (3, None, "", "t"), (4, "u", PAGE, "t"), (None, "u", "<nav><a href='/'>Home</a></nav>", "t")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in h.extract(df, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, MAIN), (2, ""), (3, ""), (4, MAIN), (None, "")], key=repr)
    assert h.extract(df.limit(0), model).count() == 0


def test_long_pages_keep_their_context(model, monkeypatch):
    """Stretches carry the network's state: a page of many stretches is labelled as in one piece."""
    page = PAGE.replace("<p>First", "".join(f"<p>Paragraph number {k}, of a long story that goes on.</p>" for k in range(700)) + "<p>First")
    leaves = leaf_blocks(page)
    whole = model.predict(h.block_vectors(leaves)[:, None], np.ones((len(leaves), 1), np.float32))[:, 0]
    monkeypatch.setattr(h, "STRETCH", 64)
    assert np.abs(h.label_pages([leaves], model)[0] - whole).max() < 1e-5
    assert h.main_texts([page], model)[0].split("\n")[-1] == MAIN.split("\n")[-1]


def test_pages_beyond_a_stretch(model):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></ul></nav><article>" + "".join(f"<p>Paragraph number {k}, of a long story that goes on.</p>" for k in range(20_000)) + "</article><footer>&copy; site</footer></body></html>"
    assert h.main_texts([page], model)[0].count("\n") > 19_900


def test_long_attributes_and_unclosed_tags():
    assert texts(f"<p title=\"{'a>b ' * 5000}\">in</p><p class='{'x>' * 9000}'>two</p>") == ["in", "two"]
    began = time.time()
    assert len(texts("<a " * 100_000)) <= 1 and texts("<p>x</p><!-- open " + "<b " * 50_000) == ["x"]
    assert time.time() - began < 5


def test_comment_ends_and_references_by_text_node():
    texts = lambda page: [x.text for x in leaf_blocks(page)]
    assert texts("<p>a</p><!--><p>b</p><p>c</p>") == ["a", "b", "c"] == texts("<p>a</p><!---><p>b</p><p>c</p>")
    assert texts("<p>x<!-- c --!>y</p><p>z</p>") == ["xy", "z"]
    assert texts("<p>x<!-- > -- > --></p>y<!-- open <p>z</p>") == ["x", "y"]
    assert texts("<p>AT&am<b>p;T</b> &lt;b&gt; &amp;amp;</p>") == ["AT&amp;T <b> &amp;"]


def test_math_object_and_noscript_are_text():
    page = "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><object data=x><p>in place of it</p></object><noscript><p>without scripts</p></noscript>"
    assert [x.text for x in leaf_blocks(page)] == ["so x=2 holds", "in place of it", "without scripts"]
