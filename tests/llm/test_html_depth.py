import pytest

from tidebook.llm.html_text import content


@pytest.mark.parametrize("depth", [10, 58, 59, 60, 61, 70, 2000])
def test_blocks_and_silence_at_every_depth(depth):
    inner = "<div>x<p>a</p>y<p>b <i>c</i></p><nav>menu<p>more</p></nav><script>x()</script><div class='advert'><p>buy</p></div>z</div>"
    assert content("<div>" * depth + inner, None) == ["x", "a", "y", "b c", "z"]


def test_a_main_region_below_the_bound():
    page = "<div>" * 70 + "<p>out</p><article><header><h1>T</h1></header><p>in</p></article><header>top</header>"
    assert content(page, None) == ["T", "in"]
