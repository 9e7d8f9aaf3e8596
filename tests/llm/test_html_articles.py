"""What belongs to an article stays, however many pages its host has."""

from functools import reduce

import pytest

from tidebook.llm.html_text import content, merge, parse, wrapper_of


def wrapper(pages):
    return reduce(merge, (wrapper_of([parse(p)]) for p in pages))


ARTICLE = """<body><nav><a href='/'>Home</a></nav><OPEN><h2>Introduction</h2><p>On {i}, a first paragraph of some length about {i}.</p><h2>Methods</h2><p>Text {i} goes on and on for {i} words.</p>
<p>As usual.</p><h2>Results</h2><p>The last paragraph of {i}, as long as the others.</p></CLOSE><footer>Imprint</footer></body>"""


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 12, 100])
@pytest.mark.parametrize("tag", ["article", "main", "div class='post'"])
def test_repeated_headings_stay(size, tag):
    pages = [ARTICLE.replace("OPEN", tag).replace("CLOSE", tag.split()[0]).replace("{i}", f"n{i}") for i in range(size)]
    w = wrapper(pages)
    for i in (0, size - 1):
        x = f"n{i}"
        wanted = ["Introduction", f"On {x}, a first paragraph of some length about {x}.", "Methods", f"Text {x} goes on and on for {x} words.", "As usual.", "Results", f"The last paragraph of {x}, as long as the others."]
        assert content(pages[i], w) == wanted


def test_names_of_topics_need_evidence():
    page = """<main><p>Intro.</p><section id="search"><h2>Search</h2><p>binary search halves it</p></section><div id="share"><p>The share rose</p></div>
<div class="share"><a href="x">Tweet it</a> <a href="y">Mail it</a></div><div id="search"><p>Find</p><form><input></form></div><div class="ad"><p>Buy now</p></div><div id="comments"><p>Nice text!</p></div></main>"""
    assert content(page, None) == ["Intro.", "Search", "binary search halves it", "The share rose"]


def test_formulas_stay_in_their_paragraph():
    assert content("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold</p></article>", None) == ["Let x=1 hold"]


def test_headers_of_posts_without_main_tags():
    page = "<body><header><h1>Site</h1></header><div class='post'><header><h1>The title</h1></header><p>The text.</p></div><div><header><h2><a href='/'>Links</a></h2></header><p>More.</p></div></body>"
    assert content(page, None) == ["The title", "The text.", "More."]


@pytest.mark.parametrize("size", [3, 8, 40])
def test_template_goes_at_the_edges(size):
    page = "<body><div class='story'><div>Our paper</div><p>A text on {i} and what {i} does.</p><p>Between.</p><p>And more on {i}, as much as that.</p><p>All rights reserved.</p></div></body>"
    pages = [page.replace("{i}", f"n{i}") for i in range(size)]
    assert content(pages[1], wrapper(pages)) == ["A text on n1 and what n1 does.", "Between.", "And more on n1, as much as that."]
