"""Unclosed, hostile and oddly named markup."""

import time

import pytest

from tidewire.llm import html_text

TEXT = "The quick story of the day is that it was in the river and the water was cold for all of them. " * 2
MORE = "And this is what the people of the town said about it when they came to the market in the morning."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav><a href=x>menu</a><article><h1>Title</h1><p>{TEXT}</p></article>", f"Title {TEXT}"),  # a menu that never ends
        (f'<div class="search"><p>{TEXT}</p></div>', TEXT),  # names alone would leave nothing
        (f'<div class="alert article"><p>{TEXT}</p></div>', TEXT),
        (f'<p>{TEXT}</p><div class="post-comments"><p>{MORE}</p></div>', TEXT),
        (f'<p>{TEXT}</p><div class="footer-bottom"><p>{MORE}</p></div>', TEXT),
        (f'<p>{TEXT}</p><div class="cookie_notice"><p>{MORE}</p></div>', TEXT),
        (f'<p>{TEXT}</p><div id="sidebar-1"><p>{MORE}</p></div>', TEXT),
        (f'<div class="content-with-sidebar"><p>{TEXT}</p></div><div class="cookie-recipes"><p>{MORE}</p></div>', f"{TEXT}{MORE}"),
        (f"<p>{TEXT}</p><a href=x><div>{MORE}</div></a>", TEXT),  # a link around blocks
        (f"<p>{TEXT}</p><p><a href=x>{MORE}</p><p>{MORE}</p>", f"{TEXT}{MORE}"),  # a link that never ends stops at its block
        (f"<article><header><h1>Title</h1></header><p>{TEXT}</p></article>", f"Title {TEXT}"),
        (f"<header><p>{MORE}</p></header><article><p>{TEXT}</p></article>", TEXT),
        (f"<p>{TEXT}</p><table><tr><td>{'Anna Berta Carla ' * 6}</td></tr></table><p>{MORE}</p>", f"{TEXT}{'Anna Berta Carla ' * 6}{MORE}"),
        (f"<p>{TEXT} 3 < 4 and a <b", f"{TEXT} 3 < 4 and a <b"),  # nothing ends the tag: it is text
        (f'<p title="a > b">{TEXT}</p><p title="unpaired>{MORE}</p>', f"{TEXT}{MORE}"),
        ("", ""),
        (None, ""),
        ("<p>", ""),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == " ".join(want.split())


@pytest.mark.parametrize("piece", ["<b ", "<!x", '<b ">" ', "<a \"'", "<div>", "<nav>", "<p>a", "<a>x", "<script>", "<!--", "</span>", "<div></span>", "<a><div>", "&amp;&", "<article><nav>"])
def test_hostile_pages_take_linear_time(piece):
    def seconds(size):
        page = piece * (size // len(piece))
        start = time.process_time()
        html_text.main_text(page + "</i>" * 1000)
        return time.process_time() - start

    seconds(10_000)
    assert seconds(400_000) < 12 * seconds(100_000) + 0.5 and seconds(400_000) < 10


def test_order_of_markup():
    page = "a<b x='>'>c</b ><!-- <p> --><script>if (a<b) </script>d<br/>e</ p>f<1"
    found = [(kind, tag, page[b:e]) for b, e, kind, tag, _ in html_text.tokens_of(page)]
    assert found == [("start", "b", "<b x='>'>"), ("end", "b", "</b >"), ("", "", "<!-- <p> -->"), ("raw", "script", "<script>if (a<b) </script>"), ("start", "br", "<br/>"), ("", "", "</ p>")]
