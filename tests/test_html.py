"""HTML expressions against a stdlib parser on hand-made pages."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from perdura.functions import html


class Counter(HTMLParser):
    """Independent count of the features, tag by tag."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.internal = self.external = self.links = self.iframes = 0
        self.charset = None
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        if tag == "script" and "src" in found:
            if found["src"].startswith("http"):
                self.external += 1
            else:
                self.internal += 1
        if tag == "a" and found.get("href", "").lower().startswith("http"):
            self.links += 1
        if tag == "iframe":
            self.iframes += 1
        if tag == "meta" and "charset" in found and self.charset is None:
            self.charset = found["charset"].lower().replace("'", "").replace('"', "")

    handle_startendtag = handle_starttag


PAGES = [
    "",
    "<html><body><p>plain</p></body></html>",
    '<script src="http://x/a.js"></script><script src="/b.js"></script>',
    "<script src='//cdn/c.js'></script><SCRIPT SRC=http://y/d.js></SCRIPT>",
    '<script async src="http://x/a.js" defer></script><script>var s="<script src=\'q\'>";</script>',
    '<!-- <script src="http://no"></script> --><script src></script>',
    '<script data-x="a src=http://b"></script><script data-src="http://c"></script>',
    "<a>none</a><a href>empty</a><a href='HTTP://X'>up</a><a HREF=https://y>q</a>",
    '<a class="n" href="http://h/1">x</a><a href="/rel">y</a><abbr href="http://z">n</abbr>',
    '<meta charset="UTF-8"><meta charset="gbk">',
    "<meta http-equiv='Content-Type' content='text/html; charset=latin1'>",
    "<meta charset='\"iso-8859-1\"'/>",
    '<iframe src="x"></iframe><IFRAME/>',
    '<a title="1 > 0" href="http://gt">x</a>',
    "<style>a{content:'<iframe>'}</style><script>document.write('<iframe>')</script>",
    '<a\nhref="http://newline"\n>x</a>',
]


def test_counts_match_a_tag_by_tag_parse(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)), "i int, html_text string")
    for r in html.default_registry().apply(df).collect():
        want = Counter(r["html_text"])
        page = r["html_text"]
        assert r["internal_js_cnt"] == want.internal, page
        assert r["external_js_cnt"] == want.external, page
        assert r["hyperlink_cnt"] == want.links, page
        assert r["charset"] == (want.charset or ""), page
        assert r["has_iframe"] == int(want.iframes == 0), page


@pytest.mark.parametrize(
    "page, length",
    [
        (None, 0),
        ("<p>no title</p>", 0),
        ("<title>abc</title>", 3),
        ("<TITLE lang='x'> a b </TITLE>", 5),
        ("<title>a &amp; b &#233;</title>", 7),
        ("<title>one <b>two</b></title>", 0),
        ("<title>first</title><title>second one</title>", 5),
        ("<!-- <title>hidden</title> --><title>seen</title>", 4),
        ("<title>1 < 2</title>", 5),
    ],
)
def test_title_length(spark, page, length):
    df = spark.createDataFrame([(page,)], "html_text string")
    assert html.default_registry().apply(df).first()["title_length"] == length


def test_page_shape(spark):
    pages = [
        (None, 0, 0),
        ("", 0, 0),
        ("\n\r\n  <!DOCTYPE html><p>", 23, 1),
        ("<!doc\ntype HTML>", 16, 1),
        ('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0">', 47, 0),
    ]
    df = spark.createDataFrame([(p,) for p, _, _ in pages], "h string")
    got = df.select(html.code_size(F.col("h")), html.is_html5(F.col("h"))).collect()
    assert [tuple(r) for r in got][1:2] == [(0, 0)]
    assert [r[1] for r in got] == [w for _, _, w in pages]
    assert [r[0] for r in got][:2] == [0, 0]


def test_missing_page_has_neutral_features(spark):
    df = spark.createDataFrame([(None,)], "html_text string")
    r = html.default_registry().apply(df).first()
    assert (r["title_length"], r["internal_js_cnt"], r["charset"], r["has_iframe"]) == (0, 0, "", 1)


def test_long_attribute_lists_do_not_overflow(spark):
    page = "<a " + "x='1' " * 3000 + "href='http://h'>t</a>" + "<p>" * 50_000
    df = spark.createDataFrame([(page,)], "html_text string")
    assert html.default_registry().apply(df).first()["hyperlink_cnt"] == 1


def test_content_type_ignores_case_and_takes_the_last(spark):
    heads = [
        '{"Content-Type": "Text/HTML"}',
        "{'content-type': 'application/PDF', 'Server': 'x'}",
        '{"CONTENT-TYPE": "a", "content-type": "b"}',
        '{"Server": "x"}',
        "__import__('os').getcwd()",
        None,
    ]
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    got = [r[0] for r in df.select(html.content_type(F.col("h"))).collect()]
    assert got == ["text/html", "application/pdf", "b", None, None, None]
