"""Hosts without `article` or `main`: the template's blocks beside the core go, whatever they are called."""

import pytest

from yomibon.llm import html_extract

PAGE = """<html><body><div class="top"><p>Site Name</p><ul><li>Home<li>News<li>Sport</ul></div>
<div class="lead"><p>Short lead {k}, in a few more words than a title has</p><p>Standing line of the lead</p></div>
<div class="col1"><h1>Title {k}</h1><p>{body}</p><div class="box"><p>Standing disclaimer</p></div></div>
<p>Straight in the body</p>
<div class="base"><div class="inner"><p>Copyright Site</p></div></div></body></html>"""


def bodies(n):
    return [" ".join(f"word{(k * 37 + i * 11) % 101}" for i in range(40)) for k in range(n)]


def texts(spark, rows):
    rows = [(k, f"http://{host}/{k}", page) for k, (host, page) in enumerate(rows)]
    return [r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [2, 12])
def test_unfilled_elements_beside_the_core_go(spark, monkeypatch, n):
    monkeypatch.setattr(html_extract, "FURNITURE_WORDS", frozenset())
    got = texts(spark, [("a.org", PAGE.format(k=k, body=b)) for k, b in enumerate(bodies(n))])
    for k, b in enumerate(bodies(n)):
        assert got[k].split("\n") == [f"Short lead {k}, in a few more words than a title has", "Standing line of the lead", f"Title {k}", b, "Standing disclaimer", "Straight in the body"]


def test_a_filled_element_stays_whole(spark):
    rows = [("a.org", PAGE.format(k=k, body=b)) for k, b in enumerate(bodies(12))]
    rows[5] = ("a.org", rows[5][1].replace("<p>Copyright Site</p>", "<p>Copyright Site</p><p>A correction of this page</p>"))
    got = texts(spark, rows)
    assert all("Copyright Site" in x and "Site Name" not in x for x in got) and "A correction of this page" in got[5]


def test_no_page_is_emptied(spark):
    """A page that has nothing but the template's blocks keeps them."""
    rows = [("a.org", PAGE.format(k=k, body=b)) for k, b in enumerate(bodies(11))]
    rows.append(("a.org", '<html><body><div class="top"><p>Site Name</p></div></body></html>'))
    assert texts(spark, rows)[-1] == "Site Name"


def test_of_one_page_all_stays(spark):
    got = texts(spark, [("a.org", PAGE.format(k=1, body=bodies(1)[0]))])
    assert "Site Name" in got[0] and "Copyright Site" in got[0]


def test_beside():
    unfilled = ["/body/div.top", "/body/div.top/ul", "/body/div.col1/div.box", "/body/div.wrap", "/html", "/body/div.col1"]
    assert html_extract.beside(unfilled, "/body", "/body/div.col1") == ["/body/div.top", "/body/div.wrap"]
    assert html_extract.beside(["/body/div.wrap"], "/body", "/body/div.wrap/div.text") == []
    assert html_extract.beside(["/body/div.top"], None, None) == []
