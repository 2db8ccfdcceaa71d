"""Pages without an article element, with broken tags, lists, columns and great depth."""

import time

import numpy as np
import pyarrow.parquet as pq
from edge_rows import DATA

from seriesmill.llm import tagpath

LONG = "A long text, with commas and stops. " * 8
OTHER = "Another column, of some length; it has marks. " * 7


def lines(page):
    return tagpath.extract(page).split("\n")


def test_scores_decide():
    """With the same score for every path, pages are cut differently: also those with an article element."""
    pages = pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist()[:100]
    pages += [f"<body><div><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div><p>{LONG}</p><p>{OTHER}</p></div><div>Small print</div></body>"]
    changed = 0
    for page in pages:
        found = tagpath.read(page)
        by_ratio = tagpath.select(found, tagpath.path_scores(found))
        changed += by_ratio != tagpath.select(found, np.ones(len(found.blocks)))
    assert changed == len(pages)
    assert lines(pages[-1]) == [LONG.strip(), OTHER.strip()]


def test_quotes_out_of_place():
    assert lines('<p>Hello there, this has <a href="x"" >a link</a> in it.</p><p class="b">Second one, here.</p>') == [
        "Hello there, this has a link in it.", "Second one, here."]
    assert lines("<div data-x=it's><p>Text one, two.</p></div><p title=\"a > b\">And three.</p>") == ["Text one, two.", "And three."]
    assert lines('<p class="open>Swallowed</p><p>Text that stays, in full.</p>')[-1] == "Text that stays, in full."


def test_lists_columns_and_headings():
    page = f"<div id=m><div class='header-image'>Caption</div><h2>Head</h2><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{OTHER}</p></div>"
    assert lines(page) == ["Caption", "Head", LONG.strip(), "One", "Two", OTHER.strip()]
    assert lines(f"<article><p>{LONG}</p><ul><li><a href=1>One</a></ul></article>") == [LONG.strip(), "One"]
    assert lines(f"<article><p>{LONG}</p></article><article><p>{OTHER}</p></article>") == [LONG.strip(), OTHER.strip()]
    columns = f"<div class=left><p>{LONG}</p></div><div class=right><p>{OTHER}</p></div><div><a href=1>Home</a> <a href=2>About</a></div>"
    assert lines(columns) == [LONG.strip(), OTHER.strip()]
    assert lines(f"<h1>Title</h1><div><p>{LONG}</p></div>") == ["Title", LONG.strip()]


def test_asides_go():
    aside = "Readers say a lot, really; they do. " * 14
    for name in ("comments", "user-comments", "commentThread", "cookie-notice", "ad-slot", "sidebar right"):
        assert lines(f"<div><p>{LONG}</p><p>{OTHER}</p></div><div class='{name}'><p>{aside}</p></div>") == [LONG.strip(), OTHER.strip()]
    assert lines(f"<article><p>{LONG}</p><div class='related links'><p>{aside}</p></div><form><p>Name, please.</p></form></article>") == [LONG.strip()]
    # Words of an aside among others tell nothing, and a page that names nothing else is read as it is.
    assert lines(f"<div class='share-price'><p>{LONG}</p></div>") == lines(f"<div class='comments'><p>{LONG}</p></div>") == [LONG.strip()]
    assert lines(f"<form><p>{LONG}</p></form>") == [LONG.strip()]


def test_ties_repeats_and_nothing():
    assert lines("<p>Same.</p><p>Same.</p>") == ["Same.", "Same."]
    assert tagpath.extract(None) == tagpath.extract("") == tagpath.extract("<script>var a='<p>x</p>';</script>") == ""
    assert lines("<svg/><p>After it, a text.</p>") == ["After it, a text."]


def test_time_grows_with_the_page_only():
    def took(n):
        start = time.process_time()
        tagpath.extract("<div><b>x</b>" * n)
        tagpath.extract("<div>" * n + "deep text, here" + "</div>" * n)
        return time.process_time() - start

    took(500)
    assert took(16_000) < 12 * max(took(4_000), 0.05)
