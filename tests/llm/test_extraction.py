"""Main text of pages: the block rules on pages of known text."""

import time

import pytest

from logloom.llm.extraction import extracted, main_text

LONG = ("It is the habit of this town that the market opens with the first light of the day, and that the people who "
        "come to it from the hills bring what they have, for there is no other way to sell it before the winter.")
OTHER = ("Es ist nicht die Art der Leute in diesem Dorf, dass sie mit dem ersten Licht auf das Feld gehen, und für die "
         "Kinder ist es auch nicht mehr so, wie es bei den Alten war, die von der Arbeit und der Kirche lebten.")


def page(body, head="<title>The title of the page</title><script>var a = '<p>it is not the text</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_with_everything_around():
    body = f"""<header><h2>The Daily</h2><p>{LONG}</p></header><nav><ul><li><a href="/a">It is the menu</a></ul></nav>
      <aside><p>{OTHER}</p></aside><div class="cookie-notice">We use it for you and it is not the text of this. {LONG}</div>
      <form><label>Name</label><input name=x><textarea>it is the form</textarea><button>Send</button></form>
      <article><h1>Short title</h1><p>One &amp; two<br>three\t&lt;b&gt;.</p><p class="lead">{LONG}</p><div class="ad">{OTHER}</div>
      <p>To.<p>Be <b>bold</b> and <i>it</i>alic.</p><style>p {{}}</style><!-- <p>{LONG}</p> --><ul><li>First</li><li>Second</li></ul>
      <section id="comments"><article class="comment"><p>{OTHER}</p></article></section></article>
      <div id="sidebar"><p>{OTHER}</p></div><footer>&copy; it is the footer of the page</footer>"""
    assert main_text(page(body)).split("\n\n") == [
        "Short title", "One & two three <b>.", LONG, "To.", "Be bold and italic.", "First", "Second"]


def test_short_article_and_junk_without_stop_words():
    assert main_text(page("<nav><a href=x>Menu</a></nav><article><p>Hi.</p></article><footer>it is the end</footer>")) == "Hi."
    junk = "zxq%%% " * 100
    assert main_text(page(f"<article><p>{junk}</p></article>")) == junk.strip()
    assert main_text(page(f"<div><p>{junk}</p></div>")) == ""


def test_page_without_article_takes_neighbours():
    body = f"""<div class="menu"><a href=1>One</a></div><div><a href=1>Home</a> <a href=2>It is the list of the news</a></div>
      <div id="content"><h1>A title</h1><p>{LONG}</p><p>Short one.</p><p>{OTHER}</p><p>Last one.</p></div>
      <div><p>Contact</p><p>© it is the owner of the site</p></div>"""
    assert main_text(page(body)).split("\n\n") == ["A title", LONG, "Short one.", OTHER, "Last one."]


def test_main_and_nested_article():
    assert main_text(page(f"<main><p>Around.</p><article><p>{LONG}</p></article></main>")) == LONG
    assert main_text(page(f"<main><h1>T</h1><p>{LONG}</p></main><p>{OTHER}</p>")) == f"T\n\n{LONG}"
    # A form or a class around the whole article does not hide it; readers' comments stay hidden.
    assert main_text(page(f"<form><article><p>{LONG}</p></article></form>")) == LONG
    assert main_text(page(f"<div class='has-sidebar widget'><article><p>{LONG}</p></article></div>")) == LONG
    assert main_text(page(f"<div class='comments'><article><p>{LONG}</p></article></div>")) == ""


def test_link_lists_in_the_article_go():
    links = "".join(f"<li><a href={i}>Related story number {i}</a></li>" for i in range(4))
    assert main_text(page(f"<article><p>{LONG}</p><ul>{links}</ul></article>")) == LONG
    assert main_text(page(f"<article><p>{LONG} <a href=x>More</a></p></article>")) == f"{LONG} More"


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("   \n", ""), ("<", ""), ("<article>", ""), ("<article>a < b &amp;amp; c &unknown; d", "a < b &amp; c &unknown; d"),
    ("<article><p title='a>b'>x</p>", "x"), ("<article><p title=\"a", ""), ("<article>a<!-- b", "a"), ("<article>a<script>b", "a"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<article><p hidden>h</p><p>v</p></article>", "v"),
    ("<article><div style='display: none'>h</div>v</article>", "v"), ("<article>a</p></div></article>", "a"),
    ("<article>&#233;&#x1F600;&nbsp;x</article>", "é😀 x"),
])
def test_broken_and_small(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("part", ["<div>", "<", "<a b=\"", "<!--", "</x>", "<p a ", "&", "<script>", "<li class=ad>x", "<p>x "])
def test_time_is_linear(part):
    start = time.perf_counter()
    main_text("<article>" + part * 200_000)
    assert time.perf_counter() - start < 20


def test_query_keeps_columns_and_replaces_its_own(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "mine", "b"), (1, "u", None, "mine", "b"), (2, None, "x" * 3_000_000, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, blocks string")
    got = extracted(df)
    assert got.columns == ["page_id", "url", "html", "blocks", "text", "n_chars"]
    assert sorted((r.page_id, r.url, r.blocks, r.text, r.n_chars) for r in got.collect() if r.url) == [
        (1, "u", "b", "", 0), (1, "u", "b", LONG, len(LONG))]
    assert extracted(df.limit(0)).count() == 0
