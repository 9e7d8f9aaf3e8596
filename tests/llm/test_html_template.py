import json
import re
from collections import defaultdict
from functools import reduce
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest

from tidebook.llm.html_text import Wrapper, content, induce, merge, parse, wrapper_of

PAGE = "<body><div class='top'>Template line</div><div class='story'><p>Story {i}</p></div>"


def wrapper(pages):
    return reduce(merge, (wrapper_of([parse(p)]) for p in pages))


def test_a_host_of_copies_keeps_its_text():
    pages = [PAGE.replace("{i}", "always")] * 5
    assert content(pages[0], wrapper(pages)) == ["Template line", "Story always"]


def test_deviating_pages_do_not_undo_the_template():
    for size in (20, 100, 1000):
        pages = [PAGE.replace("{i}", str(i)) for i in range(size)]
        for k in range(0, size, 20):
            pages[k] = pages[k].replace("Template line", f"Deviation {k}")
        left = [wrapper(pages[a::4]) for a in range(4)]
        for w in (wrapper(pages), reduce(merge, left)):
            assert Wrapper.load(w.dump()).dump() == w.dump()
            assert content(pages[1], w) == ["Story 1"]
            assert content(pages[0], w) == ["Story 0"]  # what stands in a slot of the template is none of the region that varies


def test_rare_texts_are_forgotten_within_the_bound():
    pages = [f"<body><p>{'common' if i % 100 < 92 else 'other'}</p><p>rare {i}</p><p>{'half' if i % 2 else 'odd'}</p>" for i in range(3000)]
    p = wrapper(pages).children[0].children[0]
    assert p.error <= 300 and len(p.shared) < 400
    assert content(pages[1], wrapper(pages)) == ["rare 1", "half"]


BARE = "<body><div><div>Menu</div><div>Home</div></div><div>Offer {i} of the day</div><div><h2>Title {i}</h2><p>A first paragraph on {i} goes here and on and on for {i}.<p>A second one on {i}, which is as long as the other {i}.</div><div>Imprint and all rights</div>"


def test_a_host_without_roles_and_names():
    """Only the alignment tells the story from the menu, the offer and the imprint."""
    pages = [BARE.replace("{i}", f"n{i}") for i in range(10)]
    w = wrapper(pages)
    for i, p in enumerate(pages):
        assert content(p, w) == [f"Title n{i}", f"A first paragraph on n{i} goes here and on and on for n{i}.", f"A second one on n{i}, which is as long as the other n{i}."]
        assert len(content(p, None)) == 7


def test_pages_without_telling_tags(sf_dir):
    """The given pages with main elements, menus, adverts and footers as bare divs: what the wrapper finds is the article, as by its tags."""
    bare = lambda h: re.sub(r"<(/?)(?:article|nav|footer|div)(?: class=\"ad\")?>", r"<\1div>", h)
    hosts = defaultdict(list)
    for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist():
        hosts[urlparse(r["url"]).netloc.lower()].append(r["html"])
    right = of = 0
    for pages in hosts.values():
        if len(pages) >= 6:
            w = wrapper([bare(p) for p in pages])
            right += sum(content(bare(p), w) == content(p, None) for p in pages)
            of += len(pages)
    assert right == of > 5


@pytest.mark.parametrize("mark", ["<h2 id='related-work'>T</h2>", "<h2 id='comments-on-method'>T</h2>", "<div class='search-results-discussion'>T</div>", "<p class='notice'>T</p>", "<section id='ad-hoc-networks'>T</section>", "<p id='search'>T"])
def test_names_do_not_silence_content(mark):
    assert content(f"<article><p>a</p>{mark}<p>b</p></article>", None) == ["a", "T", "b"]


def test_names_do_not_silence_what_is_around_the_content():
    assert content("<div class='sidebar'><main><p>a</p></main></div>", None) == ["a"]
    assert content("<div class='page with-sidebar'><p>a</p><div class='sidebar'>b</div><div id='cookie-notice'>c</div></div>", None) == ["a"]
    pages = [f"<div class='widget'><p>The story of {i}, a long one with {i * 7} words</p></div><div class='top'>Same</div>" for i in range(9)]
    assert content(pages[3], wrapper(pages)) == ["The story of 3, a long one with 21 words"]


def test_a_wrapper_is_bounded_by_the_template():
    size = lambda w: 1 + sum(map(size, w.children))
    pages = [f"<body><div class='{'q' * (i % 97)}x{chr(97 + i % 26)}'>own {i}</div><div class='story'><h2 id='t{i}'>Title {i}</h2><p>Some long text about {i} and more</p></div>" for i in range(2000)]
    w = wrapper(pages)
    assert size(w) < 30
    assert content(pages[5], w) == ["Title 5", "Some long text about 5 and more"]


def test_parts_are_merged_in_rounds(spark):
    pages = [(f"h{i % 2}", BARE.replace("{i}", f"n{i}")) for i in range(400)]
    df = spark.createDataFrame(pages, "host string, html string").repartition(150)
    found = {r.host: Wrapper.load(json.loads(r.wrapper)) for r in induce(df).collect()}
    assert {h: w.pages for h, w in found.items()} == {"h0": 200, "h1": 200}
    assert content(pages[0][1], found["h0"])[0] == "Title n0" and len(content(pages[0][1], found["h0"])) == 3
