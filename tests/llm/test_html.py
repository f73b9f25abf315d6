"""Page extraction: given pages, hand-made pages, and cuts against enumeration."""

import itertools
import random
import re
from html import unescape

import pytest

from wardline.llm import html_extraction as hx

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return hx.train(spark.read.parquet(PAGES))


def article(html):
    """The given pages' article, by their own plain markup."""
    inside = html.split("<article>")[1].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1)>", inside)
    return "\n".join(t for t in (" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts) if t)


def test_given_pages(spark, model):
    pages = spark.read.parquet(PAGES)
    got = {r["page_id"]: r for r in hx.extract_text(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(article(r["html"])) and got[r["page_id"]]["url"] == r["url"]


LONG = "The first sentence of the article says a lot. The second one goes on for a while, and then it ends."


def test_boilerplate_of_many_kinds(model):
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style></head><body class="has-sidebar">
    <header><a href="/">Site</a><p>Tag line of the site.</p></header>
    <nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies to improve this site. Accept them all, please.</p></div>
    <main id="main-content"><article class="post"><header><h1>Title &amp; more</h1></header>
    <p>{LONG}</p><div class="ad-slot">Buy now!</div><p>Yes.</p>
    <p>A&nbsp;B <i>it</i>alic &lt;tag&gt; &#233;&eacute; a<br>b</p><aside><p>Related: another article about things.</p></aside>
    <ul><li>first</li><li>second<p>inner</ul><blockquote>Quoted text.</blockquote><pre>x
   y</pre><form><label>Mail</label><input value="x"><button>Go</button></form>
    <script>var x = "<p>no</p>";</script><!-- <p>no</p> --><table><tr><td>c1<td>c2</table>
    </article><section id="comments"><h2>Comments</h2><div class="comment"><p>{LONG}</p></div></section></main>
    <div class="sidebar"><p>Popular posts of the week.</p></div><footer>&copy; 2024 Site. {LONG}</footer></body></html>"""
    assert hx.main_text(html, model).split("\n") == [
        "Title & more", LONG, "Yes.", "A B italic <tag> éé a b", "first", "second", "inner", "Quoted text.", "x y", "c1", "c2",
    ]


def test_pages_without_marks(model):
    links = "".join(f'<li><a href="/{i}">Page {i}</a></li>' for i in range(8))
    html = f"<html><body><div><ul>{links}</ul></div><div><h1>Title</h1><p>{LONG}</p><p>{LONG} More.</p><p>{LONG}</p></div><div><ul>{links}</ul></div></body></html>"
    text = hx.main_text(html, model)
    assert text.count(LONG) == 3 and "Page 3" not in text


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "<p>a", "a<b", "</p></div>", "<script>", "<!--", "<article><p>x</article></article><p>", "&am &amp &#x41; &bogus;", "<p class='a>x</p>", "\x00<p>�"])
def test_broken_pages(model, html):
    assert isinstance(hx.main_text(html, model), str)


def test_long_and_deep_pages(model):
    body = "<p>Some words of a sentence.</p>" * 20_000
    assert hx.main_text(f"<article>{body}</article>", model).count("\n") == 19_999
    assert hx.main_text("<div>" * 3000 + "<article><p>deep words here</p></article>", model) == "deep words here"


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 9)
        s, t = ([round(rng.random() * 3, 2) for _ in range(n)] for _ in range(2))
        edges = [(a, b, round(rng.random() * 2, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(kept):
            return sum(s[i] if not k else t[i] for i, k in enumerate(kept)) + sum(c for a, b, c in edges if kept[a] != kept[b])

        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert abs(cost(hx.minimum_cut(s, t, edges)) - best) < 1e-9


def test_edge_rows(spark, model):
    rows = [(1, None, None, "x"), (2, "u", "", "y"), (2, "u", "", "y"), (None, "v", "<article><p>word</p></article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in hx.extract_text(df, model).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (2, "u", "", 0), (None, "v", "word", 4)], key=str)
    assert hx.extract_text(df.limit(0), model).count() == 0
    assert hx.train(df.limit(0)) == hx.PLAIN


def test_scripts_with_signs_and_quotes(model):
    """What a script holds is never read as a tag, and the blocks after it stay whole."""
    for body in ("var a = 1<b; // don't", "for (i=0;i<n;i++) s='it\\'s'", "if (a<b && c>d) { x = \"<p>'\"; }", "<!-- x"):
        html = f"<html><body><article><p>{LONG}</p><script>{body}</script><p class=\"x\">Main text, it's here.</p><p>it's more.</p></article></body></html>"
        assert hx.main_text(html, model).split("\n") == [LONG, "Main text, it's here.", "it's more."]


def test_unclosed_tags_take_linear_time():
    import time

    n = 60_000
    for html in ("<b>" * n + "</i>" * n, "<div>x " * n, "<p>x<ul><b>" + "<i>" * n + "<li>y" * n, "<span>" * n + "<hr>x" * n):
        started = time.process_time()
        page = hx.parse(html)
        hx.containers(page)
        assert time.process_time() - started < 6


def test_container_sums_match_walks():
    rng = random.Random(4)
    for _ in range(60):
        html = "".join(rng.choice(["<div>", "</div>", "<p>", "<nav>", "</nav>", "<b>", "</b>", "<article>", "</article>", "word ", "two words ", "<li>"]) for _ in range(60))
        page = hx.parse(html)
        hx.containers(page)
        sums = [0] * len(page.elements)
        for block in page.blocks:
            e = block.element
            while e >= 0:
                sums[e] += len(block.text.split())
                e = page.elements[e].parent
        assert [e.words for e in page.elements] == sums
