"""Main text of pages: the two passes, what pages set aside, odd pages."""

import html as references
import os
import re

import pytest

import __spark_entry__ as contract
from feedloom.llm.html_text import GOOD, blocks_of, extract, labelled, main_text
from feedloom.llm.queries import op13_html_text

PROSE = ("The quick fox and the dog walk to the river in the morning, and it was a day for the people of the town that "
         "they would remember for a long time.")


def test_article_alone_is_kept():
    page = (f"<nav><ul><li><a href=/a>A</a></ul></nav><div class=ad>Buy the car of the year and save for it now</div><article>"
            f"<h1>Ti&amp;tle</h1><p>{PROSE}<p>So\n it  is.&nbsp;Yes<br>no.</p><aside>{PROSE}</aside><form><p>{PROSE}</p></form>"
            f"<div id='comments-list'><article class=comment><p>{PROSE}</p></article></div></article><p>{PROSE}</p>"
            f"<footer>{PROSE}</footer>")
    assert main_text(page) == f"Ti&tle\n{PROSE}\nSo it is. Yes no."


def test_short_blocks_take_the_nearest_label():
    page = (f"<table><tr><td><a>Home</a></td><td>Today</td><td><a>About</a></td></tr></table><div><p>{PROSE}</p><p>Short.</p>"
            f"<p>{PROSE}</p></div><div><h3>More</h3><ul><li><a>One</a></li><li>Two</li><li><a>Three</a></li></ul></div>")
    assert main_text(page) == f"{PROSE}\nShort.\n{PROSE}"


def test_passages_without_stop_words_stay_in_an_article_and_go_elsewhere():
    junk = "zorb | quix | flam " * 15
    assert main_text(f"<article><p>{junk}</p></article>") == " ".join(junk.split())
    assert main_text(f"<div><p>{junk}</p></div>") == ""


def test_headings_go_with_what_follows():
    page = (f"<article><p>{PROSE}</p><h2>Part</h2><p>{PROSE}</p><h2>Related</h2><ul><li><a>One story</a></li></ul></article>")
    assert main_text(page) == f"{PROSE}\nPart\n{PROSE}"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<", ""), ("<article>a < b &lt; c &amp d &am", "a < b < c & d &am"),
    ("<article><p>abc <scr", "abc"), ("<article><p>x<!-- <p>y</p> --><p>z", "x\nz"), ("<article><p>x<!-- y", "x"),
    ("<article><p>one</p><script>'</p><p>no'</script><style>p{}</style><p title='a > b'>two</p>", "one\ntwo"),
    ("<ARTICLE><P>é&eacute;&#233;&#xe9;</P></ARTICLE>", "éééé"), ("<article><p hidden>no</p><p>yes", "yes"),
    ("<article><header><p>By Jo</p></header><p>x</p></article>", "By Jo\nx"), ("<article><p> \n </p></article>", ""),
    ("<article><table><tr><td>a<td>b</table>c</article>", "a\nb\nc"), ("<article>a<br><br>b<br>c", "a\nb c"),
    ("</p></div><article>x</section></article>", "x"),
])
def test_markup(page, text):
    assert main_text(page) == text


def test_hostile_pages_end_soon():
    for part in ("<", "<a href='", "<!--", "<p ", "<div>", '<x ="', "</", "&", "<ul><li>"):
        blocks_of("<article>" + part * 50_000)


def test_whole_long_pages():
    page = "<article>" + f"<p>{PROSE}</p>" * 20_000
    assert main_text(page).count(PROSE) == 20_000


def test_every_block_has_a_label():
    assert all(b.label == GOOD for b in labelled(f"<main><p>{PROSE}</p><p>x</p></main>"))


def test_odd_tables(spark):
    ddl = "page_id long, url string, html string, text string, n_chars string, label int"
    rows = [(1, "u", None, "t", "n", 1), (None, None, "<article>x</article>", "t", "n", 1), (2, "u", "", "t", "n", 1),
            (2, "u", "", "t", "n", 1)]
    found = extract(spark.createDataFrame(rows, ddl))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, found.collect())) == sorted(
        ["Row(page_id=1, url='u', text='', n_chars=0)", "Row(page_id=None, url=None, text='x', n_chars=1)",
         "Row(page_id=2, url='u', text='', n_chars=0)", "Row(page_id=2, url='u', text='', n_chars=0)"])
    assert extract(spark.createDataFrame([], ddl)).count() == 0


@pytest.mark.skipif(not os.path.isdir(contract.SMOKE_DIR), reason="no test data")
def test_given_pages_beside_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{contract.SMOKE_DIR}/pages.parquet").collect()}
    for row in op13_html_text(spark, contract.SMOKE_DIR).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[row.page_id], re.S)[1]
        pieces = [" ".join(references.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", p))).split())
                  for p in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert row.text == "\n".join(p for p in pieces if p) and row.n_chars == len(row.text)
