"""Pages and feeds by hand-written examples."""

import json
from datetime import datetime

from threatloom.sources import feeds, pages

PAGE = """<html><head><title> A  title </title><meta name="Author" content="ignored"><meta name="author" content="Ann Bo; Cy, Dee"><meta property="og:title" content="OG">
<meta name="keywords" content="b, a,,"><meta property="article:tag" content="c"><link rel="canonical" href="https://x.org/a">
<script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": ["NewsArticle"], "headline": "H", "datePublished": "2024-01-02"}]}</script></head>
<body><nav>menu</nav><div class="heading">gone, as "ad" is part of the name</div><main><h1>Top</h1><p>First line<br>second &amp; more<p>Third <b>bold</b> naïve text that is long enough to count</p>
<ul><li>one</li><li>two</li></ul><div id="share-bar">gone</div></main><footer>gone</footer></body></html>"""


def test_page():
    text, title, canonical, description, who, words, meta, headline, published = pages.read_page(PAGE)
    assert text == "Top\nFirst line\nsecond & more\nThird bold na ve text that is long enough to count\n\none\ntwo"
    assert (title, canonical, description, headline, published) == ("A title", "https://x.org/a", None, "H", "2024-01-02")
    assert who == ["Ann Bo; Cy", "Dee"] and words == ["a", "b", "c"] and dict(meta)["og:title"] == "OG"
    assert pages.read_page(None)[0] == "" and pages.read_page("<p>open <b>tags")[0] == "open tags"
    assert pages.read_page("<script type='application/ld+json'>{broken</script>plain")[0] == "plain"


def test_only_whole_references_are_decoded():
    page = """<title>a&amp b &amp;&lt; R&D &nosuch; &#65; &#65 x&amp</title><script type="application/ld+json">{"@type": "Article", "headline": "q&amp r&b"}</script>
<article><p>cut off in a reference, and longer than fifty characters: and&amp</p><a href="/?a=1&copy=2&amp;b">&copy c &copy;</a></article>"""
    text, title, *_, headline, _ = pages.read_page(page)
    assert title == "a&amp b &< R&D &nosuch; A &#65 x&amp" and headline == "q&amp r&b"
    assert "characters: and&amp\n" in text and text.rstrip().endswith("&copy c")


def test_pages_of_a_frame(spark):
    frame = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    out = {r.page_id: r for r in pages.read_pages(frame).collect()}
    assert out[1].title == "A title" and out[1].meta["author"] == "Ann Bo; Cy, Dee" and out[2].text == ""
    assert pages.read_pages(frame.where("false")).count() == 0


RSS = """<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>feed</title><item><title>One
 two</title><link>https://x.org/1</link><description><![CDATA[<p>Hi</p>]]></description><pubDate>Wed, 31 Jan 2024 10:00:00 +0200</pubDate><dc:creator>Ann</dc:creator><category>b</category><category>a</category></item>
<item><title/><guid>g2</guid><pubDate>Thu, 01 Jan 1970 00:00:00 GMT</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="https://x.org/s"/><link href="https://x.org/a"/><summary>short</summary>
<content type="html">long</content><updated>2024-02-03T04:05:06Z</updated><author><name>Bo</name><email>b@x.org</email></author><category term="t"/></entry></feed>"""


def test_feeds(spark):
    frame = spark.createDataFrame([(1, RSS), (2, ATOM), (3, "<broken"), (4, None)], "id long, xml string")
    out = {(r.feed, r.entry): r for r in feeds.read_feeds(frame, "id", "xml").collect()}
    one = out[1, 0]
    assert (one.title, one.url, one.content, one.published, one.authors, one.tags) == ("One two", "https://x.org/1", "<p>Hi</p>", datetime(2024, 1, 31, 8), ["Ann"], ["a", "b"])
    assert (out[1, 1].title, out[1, 1].url, out[1, 1].published) == ("", "g2", None)
    atom = out[2, 0]
    assert (atom.url, atom.content, atom.published, atom.authors, atom.tags) == ("https://x.org/a", "long", datetime(2024, 2, 3, 4, 5, 6), ["Bo"], ["t"])
    assert (3, None) in out and (4, None) in out


def test_sitemaps_and_posts(spark):
    frame = spark.createDataFrame([(1, "<urlset><url><loc> https://x.org/?a=1&amp;b=2 </loc></url><url><loc>https://x.org/b</loc>")], "id long, xml string")
    assert [(r.position, r.url) for r in feeds.sitemap_urls(frame, "id", "xml").orderBy("position").collect()] == [(0, "https://x.org/?a=1&b=2"), (1, "https://x.org/b")]
    body = json.dumps([{"link": "l", "date": "2024-01-02T03:04:05", "title": {"rendered": "T"}, "content": {"rendered": "short"}, "excerpt": {"rendered": "excerpt"}}])
    r = feeds.posts(spark.createDataFrame([(1, body)], "id long, json string"), "id", "json").first()
    assert (r.url, r.title, r.content) == ("l", "T", "excerpt")
