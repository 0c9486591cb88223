"""Main text of pages: exact marginals, parsing, held-out accuracy, odd rows."""

import itertools
import random
import re

import numpy as np

from scanhouse.llm import html_extraction as he
from scanhouse.llm.html_pages import NAMES, labelled_page
from scanhouse.llm.html_tree import DIM, Page

PAGES = "page_id bigint, url string, html string"


def truth(source):
    page = Page(source)
    return page.join(page.labels())


def texts(*sources):
    return he.main_texts([re.sub(r' ?data-main="?[01]"?', "", s) for s in sources], he.default_model())


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(2)
    for source in ("<div><p>a<b>b</b></p><ul><li>c<li>d</ul></div>", "<p>a</p>b<p>c<i>d</i></p>", "x"):
        forest = he.Forest([Page(source), Page("<p>other</p>")])
        weights, pair = rng.normal(size=DIM), rng.normal(size=(3, 2, 2))
        odds, joint = forest.messages(weights, pair)
        n = len(forest.parent)
        own = np.bincount(forest.node, weights=weights[forest.features], minlength=n)
        total, one, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            e = sum(own[i] * y[i] for i in range(n))
            e += sum(pair[forest.kind[i], y[u], y[i]] for i, u in enumerate(forest.parent) if u >= 0)
            total += (z := np.exp(e))
            one += z * np.array(y)
            for i, u in enumerate(forest.parent):
                if u >= 0:
                    both[i, y[u], y[i]] += z
        assert np.allclose(he.sigmoid(odds), one / total)
        child = forest.parent >= 0
        assert np.allclose(joint[child], both[child] / total)


def test_gradient_is_the_slope_of_the_likelihood():
    pages = [Page(labelled_page(random.Random(s))) for s in range(3)]
    known = he.Labelled(pages)
    rng = np.random.default_rng(3)
    weights, pair = rng.normal(size=DIM) * 0.1, rng.normal(size=(3, 2, 2)) * 0.1

    def energy(w, p, y):
        own = np.bincount(known.node, weights=w[known.features], minlength=len(y))
        return (own * y).sum() + p[known.kind[known.child], y[known.parent[known.child]], y[known.child]].sum()

    def log_z(w, p):  # by eliminating children first
        local = np.zeros((len(known.parent), 2))
        local[:, 1] = np.bincount(known.node, weights=w[known.features], minlength=len(known.parent))
        local[known.known, 1] = -1000.0  # never the article
        for i in range(len(known.parent) - 1, -1, -1):
            if (u := known.parent[i]) >= 0:
                local[u] += [np.logaddexp(*(p[known.kind[i], a] + local[i])) for a in (0, 1)]
        return sum(np.logaddexp(*local[i]) for i in np.flatnonzero(~known.child))

    slope_w, slope_p = known.gradient(weights, pair)
    step = 1e-5
    for f in np.unique(known.features)[:: len(np.unique(known.features)) // 6]:
        moved = weights.copy()
        moved[f] += step
        change = energy(moved, pair, known.label) - energy(weights, pair, known.label) - log_z(moved, pair) + log_z(weights, pair)
        assert abs(change / step - slope_w[f]) < 1e-3
    moved = pair.copy()
    moved[0, 1, 0] += step
    change = energy(weights, moved, known.label) - energy(weights, pair, known.label) - log_z(weights, moved) + log_z(weights, pair)
    assert abs(change / step - slope_p[0, 1, 0]) < 1e-2


def test_held_out_pages():
    rng = random.Random(77)
    pages = [labelled_page(rng) for _ in range(300)]
    got, want = texts(*pages), [truth(p) for p in pages]
    hit = sum(len(set(g.split("\n")) & set(w.split("\n"))) for g, w in zip(got, want, strict=True))
    both = sum(len(set(g.split("\n"))) + len(set(w.split("\n"))) for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.82 * len(pages)  # a third have no telling names
    assert 2 * hit / both >= 0.9


def test_names_that_training_has_not_seen():
    new = {
        "menu": "mainnav top-menu", "header": "hdr siteheader", "footer": "ftr footerlinks", "sidebar": "sidecolumn relatedlinks",
        "notice": "cookiebar noticebox", "advert": "adbox advertbox", "form": "searchform signupform", "comments": "commentsection usercomments",
        "share": "sharebar socialbox", "wrapper": "outer pagewrap", "article": "articlecontent postbody storytext",
    }
    assert set(new) == set(NAMES)
    rng = random.Random(78)
    pages = [labelled_page(rng, {k: v.split() for k, v in new.items()}) for _ in range(200)]
    got = texts(*pages)
    assert sum(g == truth(p) for g, p in zip(got, pages, strict=True)) >= 0.75 * len(pages)


ARTICLE = """<html><head><title>No</title><style>p{}</style></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<article class=post><h1>A &lt;title&gt; &amp; more</h1><p>First   <b>bold</b>
 text, and it goes on for quite a while so that it reads like a paragraph.<p>Second&nbsp;one<br>after a break.
<div class="advert">Buy now</div><script>var x = "<p>no</p>";</script><ul><li>Item one.</li><li>Item two.</ul>
<form class="newsletter"><p>Sign up</p><input><button>Go</button></form><!-- <p>comment</p> --></article>
<aside><h3>Related</h3><a href=/x>Other story</a></aside><section id="comments"><h3>Comments</h3><p>Ann: I liked it.</p></section>
<footer>&copy; 2020</footer></body></html>"""


def test_a_page_by_hand():
    want = "A <title> & more\nFirst bold text, and it goes on for quite a while so that it reads like a paragraph.\nSecond one after a break.\nItem one.\nItem two."
    assert texts(ARTICLE) == [want]


def test_trees_of_odd_sources():
    def tree(source):
        page = Page(source)
        return [(t, page.text[i].strip() if page.text[i] else None, page.parent[i]) for i, t in enumerate(page.tags)]

    assert tree("<p>a<p>b") == [("p", None, -1), ("#", "a", 0), ("p", None, -1), ("#", "b", 2)]
    assert tree("a < b <3") == [("#", "a", -1), ("#", "<", -1), ("#", "b", -1), ("#", "<", -1), ("#", "3", -1)]
    assert tree("</p>x</div><!-- y") == [("#", "x", -1)]
    assert tree("<script>if (a < b) { '</p>' }</script>x<style>y") == [("script", None, -1), ("#", "x", -1), ("style", None, -1)]
    assert tree("<A title='a > b' x=\"it's\">l</a >t<br/>") == [("a", None, -1), ("#", "l", 0), ("#", "t", -1), ("#", "", -1)]
    assert tree("<ul><li>a<ul><li>b</ul><li>c</ul>") [-2:] == [("li", None, 0), ("#", "c", 6)]
    assert tree("<b><p>x</b>y</p>")[-1] == ("#", "y", 1)
    assert tree("<p>cut <a href='") == [("p", None, -1), ("#", "cut", 0)]


def test_long_and_deep_sources_end():
    deep = "<div>" * 20_000 + "text" + "</b>" * 20_000
    quotes = "<a b=\"" * 20_000
    open_ = "<!--" * 50_000 + "<" * 50_000
    assert len(texts(deep, quotes, open_)) == 3


def test_rows(spark):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (3, "v", ""), (None, "w", "<nav>only a menu</nav>"), (4, "x", "<body><nav><a href=/>Home</a></nav><article><h1>Long</h1><p>" + "Long words here. " * 50_000 + "</article>")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS text", "'x' AS n_chars")
    got = sorted((tuple(r) for r in he.extract_main_text(df).collect()), key=str)
    want = texts(ARTICLE)[0]
    assert [(r[0], r[1]) for r in got] == sorted([(r[0], r[1]) for r in rows], key=str)
    by = {(r[0]): r for r in got}
    assert by[1][2:] == (want, len(want)) and by[2][2:] == ("", 0) and by[3][2:] == ("", 0) and by[None][2:] == ("", 0)
    assert by[4][2] == "Long\n" + ("Long words here. " * 50_000).strip()
    assert he.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0
