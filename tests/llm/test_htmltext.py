from __future__ import annotations

import html as entities
import json
import re

import pytest

from shardlake.llm.htmltext import Extractor, dump, expression, host_of, infer, load, main_text, op5_html_text, parse, wrappers


def plain(page):
    """What the synthetic pages hold in their article, found without any tree."""
    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(b for b in blocks if b)


def test_all_pages(spark, sf):
    right = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in op5_html_text(spark, sf).collect()}
    assert {k: r.text for k, r in got.items()} == right
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_wrapper_has_optional_and_repeated_parts():
    pages = ["<div><p>a</p><p>b</p></div>", "<div><h2>t</h2><p>c</p></div>", "<div><p>d</p><ul><li>x<li>y</ul></div>"]
    wrapper = infer([parse(p)[0] for p in pages])
    assert expression(wrapper) == "<div>(<h2>#TEXT</h2>)?(<p>#TEXT</p>)+(<ul>(<li>#TEXT</li>)+</ul>)?</div>"
    assert dump(load(json.loads(json.dumps(dump(wrapper))))) == dump(wrapper)


def test_groups_repeat():
    tree, texts = parse("<dl><dt>a<dd>1<dt>b<dd>2<dt>c<dd>3</dl>")
    assert expression(tree) == "<dl>(<dt>#TEXT</dt><dd>#TEXT</dd>)+</dl>" and texts == list("a1b2c3")


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav>
<div class="cookie-notice">We use cookies</div><aside>More</aside><main><article><header><h1>Title &amp; more</h1></header>
<p>One&nbsp;<b>two</b>
 three<p>Four<form><input><button>Send</button></form><script>var x = "<p>no</p>";</script><div class="ad">Buy</div>
<ul><li>x<li>y</ul><section class="comments"><p>First!</p></section></article></main><footer>(c)</footer></body></html>"""


def test_furniture_goes():
    assert Extractor(None).text(PAGE) == "Title & more\n\nOne two three\n\nFour\n\nx\n\ny"


def test_words_on_the_layout_say_nothing():
    assert Extractor(None).text('<body class="sidebar"><div class="with-sidebar"><p>text</p><div class="sidebar">no</div></div>') == "text"
    assert Extractor(None).text('<div class="widget"><nav>n</nav><p>text</p><figure><figcaption>c</figcaption></figure></div>') == "text\n\nc"


def test_constant_text_is_template(spark):
    body = "<div><div><p>Follow us everywhere</p></div><div><p>{}</p><p>{}</p></div></div>"
    rows = [(i, f"http://h/{i}", body.format(f"text {i}", f"more {i}")) for i in range(8)] + [(9, "http://other/", body.format("a", "b"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert got[3] == "text 3\n\nmore 3" and got[9] == "Follow us everywhere\n\na\n\nb"
    assert {r.host: r.pages for r in wrappers(df).collect()} == {"h": 8, "other": 1}


@pytest.mark.parametrize("around", ["article", "main", 'div class="content"'])
def test_copies_of_an_article_stay_whole(spark, around):
    end = around.split()[0]
    copy = f"<{around}><h1>One title</h1><p>first</p><p>second</p><blockquote>said</blockquote></{end}><footer>(c)</footer>"
    other = [(20 + i, f"http://hot/{i}", copy if i < 5 else f"<{around}><h1>T {i}</h1><p>a {i}</p><p>b</p></{end}>") for i in range(30)]
    df = spark.createDataFrame([(i, f"http://copies/{i}", copy) for i in range(8)] + other, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert all(got[i] == "One title\n\nfirst\n\nsecond\n\nsaid" for i in [*range(8), *range(20, 25)]) and got[49] == "T 29\n\na 29\n\nb"


@pytest.mark.parametrize("page", ["", "<", "a < b", "<p", "</div>x", "<!-- x", "<script>", "<p class='x", "<<p>>", "<div>" * 3000 + "deep" + "</div>" * 3000, "x" * 200_000, "<p>a" * 5000], ids=range(12))
def test_broken_pages(page):
    tree, texts = parse(page)
    assert Extractor(json.dumps(dump(infer([tree])))).text(page) == "\n\n".join(texts)


def test_deep_text_is_kept():
    assert Extractor(None).text("<div>" * 300 + "deep" + "</div>" * 300 + "<p>out") == "deep\n\nout"


def test_odd_rows(spark):
    rows = [(1, "http://A:80/x", "<p>Hi &amp; <b>you</b><br>there<p>B", 1), (1, "http://a/x", None, 1), (None, None, None, 2), (4, "", "<nav>n</nav>", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    for sent in (1 << 20, 0):
        got = sorted(((r.page_id, r.text, r.n_chars) for r in main_text(df, sent).collect()), key=str)
        assert got == sorted([(1, "Hi & you there\n\nB", 17), (1, "", 0), (None, "", 0), (4, "", 0)], key=str)
    assert main_text(df.limit(0)).count() == 0
    assert host_of("https://u:p@Ex.org:8/x") == "ex.org" and host_of(None) == "" and host_of("no url") == ""


def _unmarked(i, word):
    """A page that names nothing: constant and varying furniture around an article of some paragraphs."""
    paragraphs = "".join(f"<p>{word} paragraph {k} of page {i}, long enough to be prose.</p>" for k in range(2 + i % 4))
    section = f"<h2>About us</h2><blockquote>{word} said {i}</blockquote>" if i % 2 else ""
    page = (
        "<html><body><div class=a1><div>Welcome to the site</div><span>Since 1999</span></div>"
        f"<div class=a2><a href=/{i}>next {i}</a><a href=/x>up {word}</a></div>"
        f"<div class=a3><div class=a4><h1>Press release</h1>{paragraphs}{section}</div><div class=a5>Buy {word} {i}</div></div>"
        "<div class=a6><p>All rights reserved by the owner of this site, who reserves them.</p></div></body></html>"
    )
    text = ["Press release", *(f"{word} paragraph {k} of page {i}, long enough to be prose." for k in range(2 + i % 4))]
    return page, "\n\n".join([*text, *(["About us", f"{word} said {i}"] if i % 2 else [])])


@pytest.mark.parametrize("n", [4, 5, 50])
def test_the_wrapper_decides_where_nothing_is_named(spark, n):
    pages = [_unmarked(i, "apple") for i in range(n)]
    df = spark.createDataFrame([(i, f"http://h/{i}", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(pages)}  # recurring headings stay, whatever the number of pages
    assert all(Extractor(None).text(p) != t for p, t in pages)


def test_headings_inside_a_marked_article_stay_at_any_number_of_pages(spark):
    for n in (2, 4, 5, 50):
        rows = [(i, f"http://h/{i}", f"<nav>n</nav><article><h1>Press release</h1><p>text {i}</p><h2>About us</h2><p>We sell.</p></article>") for i in range(n)]
        got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: f"Press release\n\ntext {i}\n\nAbout us\n\nWe sell." for i in range(n)}


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_any_columns_and_a_hot_host(spark, sent, monkeypatch):
    from shardlake.llm import htmltext

    monkeypatch.setattr(htmltext, "HOST_PAGES", 3)
    pages = [_unmarked(i, "pear") for i in range(40)]
    rows = [(i, f"HTTP://User@Hot:80/{i}" if i % 4 else f"http://h{i}/", p, "own", "mine", "salty", 7) for i, (p, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string, salt string, _host int")
    got = main_text(df, sent).collect()
    assert {r.page_id: r.text for r in got if r.page_id % 4} == {i: t for i, (_, t) in enumerate(pages) if i % 4}
    assert len(got) == 40 and all((r.host, r.wrapper, r.salt, r._host) == ("own", "mine", "salty", 7) for r in got)


def test_alignment_is_a_longest_common_subsequence():
    import random

    from shardlake.llm.htmltext import Node, _pairs

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([Node(rng.choice("pqrs")) for _ in range(rng.randrange(9))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x.key == y.key else max(best[i][j + 1], best[i + 1][j])
        found = _pairs(a, b)
        assert len(found) == best[-1][-1] and found == sorted(set(found)) and all(a[i].key == b[j].key for i, j in found)
        assert all(p < r and q < s for (p, q), (r, s) in zip(found, found[1:], strict=False))


def test_long_sequences_are_aligned_in_order(monkeypatch):
    from shardlake.llm import htmltext

    monkeypatch.setattr(htmltext, "MOST_PAIRS", 3)
    a, b = ([htmltext.Node(k) for k in keys] for keys in ("xabcd", "ybzcaw"))
    assert htmltext._pairs(a, b) == [(1, 4)] or [(a[i].key, b[j].key) for i, j in htmltext._pairs(a, b)] == [("b", "b"), ("c", "c")]


def test_unclosed_character_data():
    assert Extractor(None).text("<p><![CDATA[abcdef") == "abcdef" and Extractor(None).text("<p><![CDATA[ab]]>c") == "abc"
