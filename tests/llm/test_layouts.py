"""Main text of hosts with several layouts and of copied pages."""

from flowsieve.llm import wrappers

PAGES = "page_id bigint, url string, html string"


def texts_of(spark, pages):
    rows = [(i, "http://h.example/p", page) for i, page in enumerate(pages)]
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_layouts_of_one_host_are_judged_apart(spark):
    long = "words of this page stand here in a row " * 5
    marked = [f"<body><article><p>marked {i} {long}</p></article></body>" for i in range(12)]
    plain = [f"<body><div class='one'><p>plain {i} {long}</p></div></body>" for i in range(12)]
    second = [f"<body><section class='two'><p>second {i} {long}</p></section></body>" for i in range(3)]
    got = texts_of(spark, marked + plain + second)
    for i, start in enumerate([f"marked {i}" for i in range(12)] + [f"plain {i}" for i in range(12)] + [f"second {i}" for i in range(3)]):
        assert got[i].startswith(start), (i, got[i])


def test_copies_of_a_page_are_one_page(spark):
    long = "words of this page stand here in a row " * 5
    copied = "<body><div class='one'><p>copied %s</p><blockquote>only here %s</blockquote></div></body>" % (long, long)
    other = [f"<body><div class='one'><p>plain {i} {long}</p><h6>the same on every page</h6></div></body>" for i in range(6)]
    got = texts_of(spark, [copied] * 7 + other)
    assert all("only here" in got[i] for i in range(7))
    assert all("plain" in got[i] and "the same" not in got[i] for i in range(7, 13))
