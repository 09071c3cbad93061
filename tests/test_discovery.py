"""Listing pages: selectors, next pages, rounds."""

import pytest

from threatloom.sources import discovery as D

LIST = '<div class="list big"><p><a class="post" href="{}">One</a></p></div><a class="post" href="/out">Out</a>'


def pages(spark):
    rows = [
        ("https://a.example/list", LIST.format("/p/1?utm_source=x") + '<a class="nav" href="/about">About</a><a class="nav" href="?p=2">2</a>'),
        ("https://a.example/list?p=2", LIST.format("p/2/") + '<a class="nav" href="?p=1">1</a><a class="nav" href="/list?p=3">Next page</a>'),
        ("https://a.example/list?p=3", LIST.format("https://b.example/p/3#top") + '<a class="nav" href="/list?p=4">Next</a>'),
        ("https://a.example/list?p=4", LIST.format("/p/4")),
        ("https://c.example/?p=7", LIST.format("/c/7")),
        ("https://c.example/?p=8", LIST.format("/c/8")),
        ("https://d.example/", LIST.format("/d/1") + '<a class="nav" href="/">next</a>'),
        ("https://e.example/", None),
        ("https://f.example/", '<a class=post href="http://[broken">x</a><div class=list><a class="post extra" href="/f<1>">F &amp; <b>G</b>'),
    ]
    return spark.createDataFrame(rows, "url string, html string")


def test_listings_are_followed(spark):
    p = pages(spark)
    start = p.select("url").where("url NOT RLIKE 'p=[2348]$'").unionByName(spark.createDataFrame([("https://gone.example/",), ("https://d.example/",)], "url string"))
    for rounds, more in ((1, set()), (2, {("https://a.example/list", "https://a.example/p/2"), ("https://c.example/?p=7", "https://c.example/c/8")}), (3, {("https://a.example/list", "https://b.example/p/3")}), (9, {("https://a.example/list", "https://a.example/p/4")})):
        found = {tuple(r) for r in D.discover(p, start, "div.list a.post", "a.nav", most_pages=rounds).collect()}
        if rounds == 1:
            first = found
            assert first == {("https://a.example/list", "https://a.example/p/1"), ("https://c.example/?p=7", "https://c.example/c/7"), ("https://d.example/", "https://d.example/d/1"), ("https://f.example/", "https://f.example/f<1>")}
        else:
            first = first | more
            assert found == first


def test_links_and_patterns(spark):
    p = pages(spark)
    got = {(r.url, r.position): (r.href, r.label, r.address) for r in D.links(p, "a").collect()}
    assert got["https://f.example/", 1] == ("/f<1>", "F & G", "https://f.example/f<1>") and ("https://f.example/", 0) not in got and not any(u == "https://e.example/" for u, _ in got)
    assert {r.address for r in D.by_pattern(p, [r"https://a\.example/p/", "nothing"]).collect()} == {"https://a.example/p/1", "https://a.example/p/2", "https://a.example/p/4"}
    assert D.by_pattern(p, []).count() == 0 and D.links(p.where("false")).count() == 0
    with pytest.raises(ValueError, match="selector"):
        D.parsed("a[href]")
