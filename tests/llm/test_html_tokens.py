"""Comments that end at once and tags with very many attributes."""

import pytest

from quire.llm.html_text import parse


def texts(page):
    return [t for _, _, t in parse(page)[0]]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>a<!-->b</p><p>c</p></article>", ["ab", "c"]),
        ("<article><p>a<!--->b<!-- x --!>d</p><p>c<!-- y --z", ["abd", "c"]),
        ("<article><p>a<!-- <p>x</p> -->b<!---->c</p></article>", ["abc"]),
    ],
)
def test_comments(page, want):
    assert texts(page) == want


def test_attributes_of_any_length():
    for n in (10, 1500, 150_000):
        many = " ".join(f'a{i}="v"' for i in range(n))
        assert texts(f'<article><div {many} data-y="p>q">text</div></article>') == ["text"]
    assert texts("<article><div title='" + "x>" * 100_000 + "'>text</div></article>") == ["text"]


def test_open_quotes_end_in_linear_time():
    for piece in ("<a b=\"c' ", "<a x='", "<a b ", "<a \"' x>"):
        assert len(texts("<p>" + piece * 30_000 + ">tail")) <= 1
