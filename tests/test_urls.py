import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import urls

PLAIN = "https://example.com/news/ai"


def one(spark, url, f):
    return spark.createDataFrame([(url,)], "u string").select(f(F.col("u")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("url", "normal"),
    [
        (PLAIN, PLAIN), (PLAIN + "?utm_source=x", PLAIN), ("https://example.com/amp/news/ai/", PLAIN), ("https://example.com/mobile/news/ai", PLAIN), ("HTTPS://Example.com/print/news/ai#c", PLAIN),
        ("https://e.com", "https://e.com/"), ("https://e.com/a?b=2&a=1&c=", "https://e.com/a?a=1&b=2"), ("https://e.com/amplifier", "https://e.com/lifier"), ("https://e.com/a?q=x+y%26z&REF=1", "https://e.com/a?q=x+y%26z"),
        ("https://e.com/amp", "https://e.com/"),
    ],
)
def test_normal_form(spark, url, normal):
    assert one(spark, url, urls.normalize) == normal


@pytest.mark.parametrize(
    ("path", "reason"),
    [
        ("/archive/2021/05/page/400", "pagination_depth_too_high"), ("/archive/2021/05/page/7", "calendar_archive_trap"), ("/archive/2021/05/page/001", "pagination_depth_too_high"), ("/x?page=21", "pagination_depth_too_high"),
        ("/x?page=no", None), ("/search?sort=a&order=b&filter=c&facet=d&page=1", "filter_url_trap"), ("/news/2026/ai-regulation-explained", None), ("/blog/post/comment-page-3", "comment_pagination_trap"),
        ("/a?a=1&b=1&c=1&d=1&e=1", "filter_url_trap"), ("/1/2/3/4/5/6/7/8/9", "path_too_deep"), ("/page/" + "9" * 60, "pagination_depth_too_high"), ("/page/20", None),
    ],
)
def test_traps(spark, path, reason):
    got = one(spark, "https://example.com" + path, urls.trap)
    assert (got["crawl_decision"], got["reason"]) == ("skip" if reason else "crawl", reason)


def test_url_classes_and_resolution(spark):
    assert one(spark, "https://e.com/", urls.url_skip)["reason"] == "homepage"
    assert one(spark, "https://e.com/tag/ai", urls.url_skip)["reason"] == "url_pattern:tag_page"
    assert one(spark, "https://e.com/research?x=1", urls.url_skip)["reason"] == "url_pattern:search_page"
    assert one(spark, "https://e.com/wiki/Web_crawler", urls.url_skip) is None
    assert one(spark, "https://e.com/wiki/Web_crawler", urls.url_boost) == "wiki"
    assert one(spark, "https://e.com/a/b", lambda u: urls.resolve(u, F.lit("../c?d#e"))) == "https://e.com/c?d#e"
    assert one(spark, None, urls.normalize) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("abcxyz%+ é", min_size=1, max_size=4), st.text("abc&= é", max_size=4)), max_size=4), st.text("abc/", max_size=8))
def test_normal_form_is_stable(spark, pairs, path):
    from urllib.parse import urlencode

    url = "https://e.com/z" + path + "?" + urlencode(pairs)
    once = one(spark, url, urls.normalize)
    assert one(spark, once, urls.normalize) == once
