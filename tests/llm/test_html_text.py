import html
import re

import pytest

from tidebook.llm.html_text import Wrapper, content, extract, match, merge, parse, wrapper_of

PAGE = """<html><head><title>t {i}</title><script>var a = "<p>no</p>";</script></head><body class="home">
<header><a href="/">Site</a></header><div id="top-nav"><ul><li><a>Home</a></li><li><a>News</a></li></ul></div>
<div class="cookie-notice">We use cookies {i}</div>
<div class="story"><h2>Title {i} &amp; more</h2><p>First   {i}<br>line &eacute;&#8364;</p><p class="lead">See <a href="x">this</a> {i}</p><ul><li>item {i}</li></ul><p>All rights reserved.</p></div>
<div class="sidebar"><p>Popular {i}</p></div><form><p>Search {i}</p></form>
<div id="comments"><p>I like it {i}</p></div><footer>foot {i}</footer></body></html>"""
WANTED = "Title {i} & more\n\nFirst {i} line é€\n\nSee this {i}\n\nitem {i}"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_constant_slots_are_template_and_varying_ones_content(spark):
    rows = [(i, f"https://A.example.com:80/{i}", PAGE.replace("{i}", f"n{i}")) for i in range(12)]
    rows += [(50, "https://alone.example.com/", PAGE.replace("{i}", "x"))]
    found = {r.page_id: r for r in extract(pages_of(spark, rows).repartition(4)).collect()}
    for i in range(12):
        assert found[i].text == WANTED.replace("{i}", f"n{i}")
        assert found[i].n_chars == len(found[i].text)
    assert found[50].text == WANTED.replace("{i}", "x") + "\n\nAll rights reserved."


def test_main_region(spark):
    page = "<body><div><p>Welcome {i}</p></div><article><header><h1>H{i}</h1></header><p>Body {i}<p>More<aside>side</aside><div class='share-buttons'>Share</div></article><div>Other {i}</div>"
    same = "<body><article><h1>Copy</h1><p>Always the same.</p></article><p>x{i}</p>"
    rows = [(i, "http://b.org/x", page.replace("{i}", str(i))) for i in range(4)] + [(10 + i, "http://c.org/x", same.replace("{i}", str(i))) for i in range(20)]
    found = {r.page_id: r.text for r in extract(pages_of(spark, rows)).collect()}
    assert [found[i] for i in range(4)] == [f"H{i}\n\nBody {i}\n\nMore" for i in range(4)]
    assert {found[10 + i] for i in range(20)} == {"Copy\n\nAlways the same."}


def test_nulls_empty_and_broken_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "just text &amp; more &am"), (4, "http://x.y/", "<p>a<p>b</div></p>c"), (4, "http://x.y/", "<p>a<p>b</div></p>c"), (5, "http://deep.z/", "<div>" * 3000 + "deep" + "</div>" * 10), (None, "http://x.y/", "<article><p>unclosed <b>bold")]
    df = pages_of(spark, rows).selectExpr("*", "'clash' as host", "1 as wrapper", "2 as text")
    found = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect()))
    assert [x[1] for x in found] == ["unclosed bold", "", "", "just text & more &am", "a\n\nb\n\nc", "a\n\nb\n\nc", "deep"]
    assert all(len(t) == n for _, t, n in found)
    assert extract(pages_of(spark, [])).count() == 0


def test_whole_pages_as_brute_force(spark, sf_dir):
    """Of the given pages, all text is in an article whose blocks are its headings and paragraphs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</h1>", inner))
        assert found[r.page_id] == "\n\n".join(b for b in blocks if b)


def size(w):
    return 1 + sum(map(size, w.children))


def test_matching_of_trees():
    a, b = (wrapper_of([parse(x)]) for x in ("<div><p>1</p><h2>t</h2><ul><li>x</ul></div>", "<div><h2>t</h2><ul><li>y<li>z</ul><pre>k</pre></div>"))
    nodes = lambda pairs: 1 + sum(nodes(below) for _, _, below in pairs)
    texts = 3  # p, h2, li
    assert match(a, a)[0] == size(a) + texts and nodes(match(a, a)[1]) == size(a)
    assert nodes(match(a, b)[1]) == 5  # root, div, h2, ul, li
    assert match(a, b)[0] == 5 + 1  # one equal text
    both = merge(a, b)
    assert size(both) == 7
    assert [c.label for c in both.children[0].children] == ["p", "h2", "ul", "pre"]
    assert merge(merge(a, b), a).dump()[1] == 3
    assert Wrapper.load(both.dump()).dump() == both.dump()


@pytest.mark.parametrize("markup", ["<p>a</p>", "text", ""])
def test_a_page_without_wrapper(markup):
    assert content(markup, None) == ([t] if (t := re.sub("<.*?>", "", markup)) else [])
