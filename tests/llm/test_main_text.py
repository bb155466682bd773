"""Main text of pages: hand-made pages, and the given layout by a plain pattern."""

import random
import re
import time
from html import unescape

import pytest

from weftlink.llm.main_text import extract_main_text, main_text

LONG = "This is a paragraph of some length, with commas, and with enough words to look like an article."


def test_a_page_with_everything_around_the_article():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies, all of them, on every page.</div>
    <main><article><header><h2>Title</h2><p>By someone</p></header><p>{LONG}</p><p>Short.<p><b>Bold&nbsp;words <i>in</i>side<br>two lines &amp; more
    <div class="ad">Buy now, pay later, {LONG}</div><ul><li>first<li>second</ul><table><tr><td>cell<td>other</table><aside>{LONG}</aside><p hidden>secret</p>
    <p>Before <span class="ad">an ad</span>after.</p><form><p>{LONG}</p></form></article>
    <section id="comments"><article><p>{LONG}</p></article><article><p>{LONG} {LONG}</p></article></section></main>
    <div class="sidebar"><p>{LONG}</p><p>{LONG}</p></div><footer>{LONG}</footer></body></html>"""
    assert main_text(page).split("\n") == ["Title", LONG, "Short.", "Bold words inside two lines & more", "first", "second", "cell", "other", "Before after."]


def test_best_container_without_an_article():
    links = "".join(f"<li><a href=/{i}>A link with rather a lot of words, {i}</a></li>" for i in range(40))
    page = f"<div id=top><ul>{links}</ul></div><div><h2>Head</h2><div class=story><p>{LONG}</p><p>{LONG}</p><p>tiny</p></div><p>A sentence that follows.</p></div><div><p>else</p></div>"
    assert main_text(page).split("\n") == ["Head", LONG, LONG, "tiny", "A sentence that follows."]


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""), ("   ", ""), ("plain text &lt; only", "plain text < only"), ("<p>one", "one"), ("<nav>menu</nav>", ""), ("a < b <", "a < b <"),
        ("<article class=comment><p>no</p></article>", ""), ("<div class='page has-sidebar'><p>yes</p></div>", "yes"), ("<div class=sidebar><article><p>yes</p></article></div>", "yes"),
        ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no", "yes"), ("<p>yes</p><script>if (a<b) document.write('<p>no</p>')", "yes"), ("<p title='a > b'>x</p>", "x"), ('<p title="open>x</p>', "x"),
        ("<article><p>a</p><p>a</p></article>", "a\na"), ("<article><article><p>in</p></article></article>", "in"), ("<p>&copy &#x41;&#66; &notanentity;</p>", "© AB ¬anentity;"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


def layout(rng):
    """A page of the given tables' layout, and its text by a pattern."""
    words = lambda n: " ".join(rng.choice(["über", "The", "a,", "x&amp;y", "%%%", "of."]) for _ in range(n))
    blocks = [f"<h1>{words(6)}</h1>"]
    for _ in range(rng.randrange(1, 12)):
        blocks.append(f"<p>{words(rng.choice([1, 5, 60]))}</p>" if rng.random() < 0.7 else f"<p><b>{words(4)}<br>")
    article = "".join(blocks)
    page = f"<!DOCTYPE html><html><head><title>{words(6)}</title></head><body><nav><ul><li><a href='/x'>{words(2)}</a></li></ul></nav><div class=\"ad\">{words(200)}</div><article>{article}</article><footer>&copy; {words(9)}</footer>"
    plain = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"(?=<p>)|</h1>", article)]
    return page, "\n".join(x for x in plain if x)


def test_against_a_plain_pattern(spark):
    rng = random.Random(5)
    made = [layout(rng) for _ in range(200)]
    rows = [(i, f"u{i}", p, "clash") for i, (p, _) in enumerate(made)] + [(None, None, None, None), (7, "again", made[7][0], "")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    expected = [(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(made)] + [(None, None, "", 0), (7, "again", made[7][1], len(made[7][1]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_and_deep_pages_take_linear_time():
    began = time.perf_counter()
    assert main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>").count("\n") == 19_999
    for odd in ("<div>" * 50_000 + "x", "<p " * 50_000, "<a href='" * 50_000, "</div>" * 50_000, "<td><section>" * 20_000 + "</div>" * 20_000, "<!--" * 50_000, "<title>" * 50_000, "<span hidden>" * 20_000, "<" * 100_000, "<x '\">" * 50_000):
        main_text(odd)
    assert time.perf_counter() - began < 60
