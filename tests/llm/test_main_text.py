"""The main text comes from scores and their best run."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import main_text as M

BARE = M.Weights([])


def text(page, weights=BARE):
    return M.main_text(page, weights)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=30))
def test_best_region(scores):
    begin, end = M.best_region(scores)
    sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    assert sum(scores[begin:end]) == max([0, *sums])


LINKS = "<nav><ul>" + "<li><a href=x>some link here</a></li>" * 12 + "</ul></nav>"


def test_the_scan_decides(monkeypatch):
    page = f"<body><p>Two teasers</p>{LINKS}<div><p>{'word ' * 60}</p></div>{LINKS}<p>Legal note</p></body>"
    assert text(page) == " ".join(["word"] * 60)
    monkeypatch.setattr(M, "best_region", lambda scores: (0, len(scores)))
    assert text(page).startswith("Two teasers\n") and text(page).endswith("\nLegal note")


def test_learned_weights_decide():
    page = '<body><div class="zug">Left out on other pages</div><article><p>The story itself.</p></article></body>'
    inside, outside = M.counted(page)
    assert outside["div.zug"] == 5 and inside["p"] == 3 and "<p" in inside and "<div" in outside
    weights = M.Weights([(k, 9 * inside[k], 9 * outside[k]) for k in {*inside, *outside}])
    other = page.replace("article>", "section>")
    assert text(other, weights) == "The story itself."
    assert text(other) == "Left out on other pages\nThe story itself."


def test_words_of_wrappers_and_of_furniture_in_articles_say_nothing():
    inside, outside = M.counted('<div class="wrap"><nav><p>menu</p></nav><article><aside>see also</aside><p>a b</p></article></div>')
    assert "div.wrap" not in {*inside, *outside} and "aside" not in {*inside, *outside}
    assert outside["nav"] == 1 and "p" not in outside and inside["p"] == 2
    assert not any(M.counted("<div><p>no mark</p></div>"))
    assert not any(M.counted("<!-- <article> --><p>no mark</p><script><article></script>"))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article class="post"><header><h1>Title</h1></header><p>Body text</p></article>', "Title\nBody text"),
        ("<!-- <article>old</article> --><div><p>Body text</p></div>", "Body text"),
        ("<script>var a = '<article>'</script><p>Body text</p>", "Body text"),
        ('<article><p>One two</p><div class="social-history"><p>Three</p></div></article>', "One two\nThree"),
        ("<body><nav><a href=/>Home</a><article><p>Body text</p></article></body>", "Body text"),
        ("<body><nav><a href=/>Home</a><h1>Title</h1><p>Body text</p></body>", "Title\nBody text"),
        ('<p>Body text</p><div class="site-footer">Us</div><ol class="comment-list"><li>First</li></ol>', "Body text"),
        ('<p>Body</p><div class="comments"><article><p>First one here</p></article></div>', "Body"),
        ("<p>a <a href='x>y'>b</a> < c <d</p>", "a b < c"),
        ("<p>x<br/>y</p><P>z&eacute;&nbsp;\n w</P>", "x\ny\nzé w"),
        ('<ul><li>One</li><li>Two</li></ul><p title="a>b">Three</p>', "One\nTwo\nThree"),
        ("<p>5 < 6 and <", "5 < 6 and <"),
        ("<script>never closed</scripty><p>x</p>", ""),
        ("<nav>only</nav>", ""),
        (" \n", ""),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def plain_text(page):
    """Generated pages only: what stands in ``<section>``, by removing markup step by step."""
    body = re.search(r"<section>(.*)</section>", page, re.DOTALL)[1]
    blocks = re.split(r"</?(?:h1|p|br|ul|li)[^>]*>", body)
    blocks = [" ".join(re.sub(r"</?b>|<a href='q>r'>|</a>", "", b).replace("&lt;", "<").replace("&amp;", "&").split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


WORDS = st.lists(st.sampled_from(["ab", "&amp;", "x&lt;y", "é", "<b>in</b>", "<a href='q>r'>to</a>", "<br>", "\n"]), min_size=1, max_size=8).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=3, max_size=8), WORDS)
def test_generated_pages(paragraphs, title):
    inner = f"<h1>Title {title}</h1><p>{'long ' * 30}</p>" + "".join(f"<p>Words: {p} end</p>" for p in paragraphs)
    page = f"<html><head><title>T</title></head><body>{LINKS}<div class='ad'>Buy</div><section>{inner}</section><footer>Us</footer></body></html>"
    assert text(page) == plain_text(page)


LONG = {
    "opens": "<a ",
    "nested": "<div class=x>",
    "quotes": '<a b="',
    "stray closes": "<b></i>",
    "unclosed": "<nav><p>",
    "articles": "<nav><article>",
    "raw": "<script></script",
    "comments": "<!--x",
    "spaces": "<a class =    ",
    "less": "<",
}


@pytest.mark.parametrize("unit", LONG.values(), ids=LONG)
def test_time_is_linear(unit):
    def seconds(size):
        page = unit * (size // len(unit))
        started = time.process_time()
        text(page)
        M.counted("<article>" + page)
        return time.process_time() - started

    small, large = seconds(100_000), seconds(800_000)
    assert large < 30 * small + 1
