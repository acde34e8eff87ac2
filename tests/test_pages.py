import random
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, text
from millrace.functions.html import _Tree, facts, html_facts, stripped
from millrace.operators import pages

WORDS = "word " * 300
ARTICLE = f"""<html lang="en"><head><title>Site | A title</title><link rel="canonical" href="https://e.com/a"><meta property="og:type" content="article">
<meta property="article:published_time" content="2024-05-30"><meta property="og:image" content="/top.jpg"></head><body><nav>Home Privacy</nav>
<article itemscope itemtype="https://schema.org/NewsArticle"><h1>A title</h1><span itemprop="author">Jo</span><p>{WORDS}First one. Second! Third.</p><h2>Part</h2><h3></h3>
<img src="/big.jpg" width="600" height="400"><img src="/small.jpg" width="20" height="20"><img data-src="/lazy.jpg" class="x"><img src="/l.png" class="site-logo">
<a href="/next">next</a><a href="https://other.com/x">out</a><a href="#top">top</a></article><footer>Foot</footer><script>var t="</p>";</script></body></html>"""


def rows(spark, *pages_):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages_)], "page_id long, url string, html string")


def classified(spark, *pages_):
    d = pages.with_facts(rows(spark, *pages_))
    return d.withColumn("cls", pages.classify(F.col("url"), F.col("facts")))


@pytest.mark.parametrize(
    ("path", "content"),
    [("/news/2026/x", True), ("/blog/how", True), ("/wiki/Web_crawler", True), ("/docs/best", True), ("/tag/ai", False), ("/category/news", False), ("/search?q=c", False), ("/login", False), ("/author/john", False), ("/page/20", False), ("/", False)],
)
def test_classification(spark, path, content):
    r = classified(spark, ("https://e.com" + path, ARTICLE)).first()["cls"]
    assert r["is_content_page"] is content
    assert 0 <= r["confidence"] <= 1


def test_extraction(spark):
    r = pages.extract(classified(spark, ("https://e.com/news/a", ARTICLE))).first()
    assert (r["title"], r["author"], r["published_date"], r["canonical_url"]) == ("A title", "Jo", "2024-05-30", "https://e.com/a")
    assert "Home" not in r["main_content"] and "Foot" not in r["main_content"] and "First one." in r["main_content"]
    assert r["headings"] == ["A title", "Part"] and r["html_quality"] == "ok" and r["problems_detected"] == []
    assert r["images"] == ["https://e.com/top.jpg", "https://e.com/big.jpg", "https://e.com/lazy.jpg"]
    d = classified(spark, ("https://e.com/news/a", ARTICLE)).withColumns({"depth": F.lit(0), "main_content": F.lit("x")})
    assert [x["url"] for x in pages.same_site_links(d, 2).collect()] == ["https://e.com/next"]


def test_broken_and_odd_pages(spark):
    odd = [("https://e.com/x", None), ("https://e.com/y", ""), ("https://e.com/z", "<div>" * 9 + "<main><h1>T</h1>" + WORDS), (None, "<p>x"), ("https://e.com/[", "<a href='http://[x'>a</a>" + "<b>" * 3000)]
    got = {r["page_id"]: r for r in pages.extract(classified(spark, *odd)).collect()}
    assert len(got) == 5 and got[2]["html_quality"] == "messy" and "broken_html" in got[2]["problems_detected"] and len(got[2]["main_content"].split()) > 50


def test_blocks_and_thin_pages(spark):
    cases = [
        (200, {}, "<p>g-recaptcha</p>", "captcha_detected", False), (403, {}, "", "http_403", False), (429, {}, "", "http_429", True), (200, {"Server": "cloudflare"}, "Just a moment", "cloudflare_challenge", False),
        (200, {}, "just a moment", "cloudflare_detected", False), (200, {}, "captcha-checkbox " + "w " * 600, None, False), (200, {}, "access denied " + "w " * 600, "generic_bot_detected", False), (200, None, None, None, False),
    ]
    d = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, status int, headers map<string,string>, body string")
    got = {r["i"]: r["b"] for r in d.select("i", pages.block(F.col("status"), F.col("headers"), F.col("body")).alias("b")).collect()}
    for i, c in enumerate(cases):
        assert (got[i]["reason"], got[i]["should_retry"]) == c[3:], c
    shell = "<div id=root></div>" + "<script></script>" * 4
    assert [r["t"] for r in pages.with_facts(rows(spark, ("https://e.com/s", shell), ("https://e.com/a", ARTICLE))).select(pages.thin(F.col("facts")).alias("t")).collect()] == [True, False]


def test_quality(spark):
    good = ("u", "T", "A", "2024-05-30", "word " * 400, ["a", "b", "c"], "ok", [])
    poor = ("v", "T", None, None, "just three words", [], "messy", ["a", "b", "c", "d"])
    d = spark.createDataFrame([good, poor], "url string, title string, author string, published_date string, main_content string, headings array<string>, html_quality string, problems_detected array<string>")
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    a, b = (r for r in pages.quality(d, at, F.when(F.col("url") == "v", 0.9).otherwise(0.0)).orderBy("url").collect())
    assert a["quality_score"] == 0.87 and a["quality_factors"]["completeness"] == 1.0
    assert b["quality_score"] < 0.6 and b["quality_reasons"][:2] == ["missing author/date or short body", "noisy HTML / boilerplate detected"] and "overlaps existing content" in b["quality_reasons"]


def test_freshness_and_ttl(spark):
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    dated = [("2024-05-30", 1.0), ("2024-05-10T10:00:00", 0.8), ("2024-04-01 00:00:00", 0.6), ("2023-09-01", 0.4), ("2020-01-01", 0.2), ("soon", 0.3), ("", 0.2), (None, 0.2), ("2030-01-01", 1.0), ("2024-5-3", 0.8)]
    d = spark.createDataFrame([(i, x[0]) for i, x in enumerate(dated)], "i int, d string")
    assert [r["f"] for r in d.orderBy("i").select(dates.freshness(F.col("d"), at).alias("f")).collect()] == [x[1] for x in dated]
    one = spark.range(1).select(dates.next_ttl(F.lit("wiki"), F.lit(True)).alias("a"), dates.next_ttl(F.lit("odd"), F.lit(False)).alias("b"), dates.next_ttl(F.lit("wiki"), F.lit(True), F.lit(8)).alias("c"), dates.next_ttl(F.lit("wiki"), F.lit(False), F.lit(700)).alias("d")).first()
    assert tuple(one) == (84, 144, 6, 720)


def test_text(spark):
    def one(s, f):
        return spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("r")).first()["r"]

    assert one(" A  b\n", text.collapse) == "A b" and one(None, text.word_count) == 0 and one("", text.content_hash) is None
    assert one("a b c d e f", text.shingles) == ["a b c d e", "b c d e f"] and one("a b", text.shingles) == ["a b"] and one("", text.shingles) == []
    assert one("One. Two! Three.", text.summary) == "One. Two!" and len(one("x" * 500, text.summary)) == 400
    assert one("der Hund und die Katze sind nicht da", text.language) == "de" and one("short", text.language) is None
    assert one("Abcd", lambda s: text.title_ratio(s, F.lit("abce"))) == 0.75 and one(None, lambda s: text.title_ratio(s, F.lit("a"))) == 0.0


def test_facts_of_nested_text():
    f = facts("https://e.com", "<p>a<p>b <b>c</b><style>x</style><!-- y --><div>d</div>")
    assert f["visible_text"] == "a b c d"


def test_references_end_with_a_semicolon():
    """As in the SQL of e_html_facts; scripts keep their text."""
    f = facts("https://e.com", '<title>a &amp;&amp</title><p>b &lt c &copy; &#65; &#65 d&</p><a href="/x?a=1&copy=2&amp;b=3">l</a><script type="application/ld+json">{"@type": "A&amp"}</script>')
    assert f["title"] == "a &&amp" and f["visible_text"] == "a &&amp b &lt c \u00a9 A &#65 d& l"
    assert f["links"] == ["https://e.com/x?a=1&copy=2&b=3"] and f["jsonld"] == ['{"@type": "A&amp"}']


def test_facts_are_made_a_slice_at_a_time():
    """A batch of 10,000 large pages would otherwise stand in memory as parsed facts all at once."""
    html = [f"<p>{i} " + "word " * 20_000 for i in range(50)] + [None, ""]
    out = list(html_facts.__wrapped__(iter([(pa.array(html), pa.array(["https://e.com"] * 52))])))
    assert len(out) >= 5 and sum(map(len, out)) == 52 and max(map(len, out)) <= 12
    assert [x["visible_text"][:2].strip() for o in out for x in o.to_pylist()][:50] == [str(i) for i in range(50)]


class Plainly(_Tree):
    parse_starttag, parse_endtag, updatepos = HTMLParser.parse_starttag, HTMLParser.parse_endtag, HTMLParser.updatepos


def shape(n):
    return n if isinstance(n, str) else (n.tag, n.attrs, [shape(k) for k in n.kids])


def test_runs_of_plain_tags_are_read_as_by_the_parser():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<P>", '<div class="ad x">', "<div class='ad'>", "</div>", '<a href="/x y">', '<a href="/x&amp;y" rel="u">', "<a href=/z>", '<a href="q"title="r">', "</a >", "</ a>", "<script>", "</script>", "<style>", "</STYLE>"]
    bits += ["<title>", "</title>", "<textarea>", "<br>", "<br/>", "<br />", "<", ">", '"', "&", "&amp;", "&lt", "&#65;", "<!--", "-->", "<!doctype html>", "<![CDATA[", "]]>", "<?x", "?>", "text ", "\n", "<li>", "</ul>", '<img src="a>b">', "<x-y>", '<a:b c="d">', '<p A="" a="z">', "<p a=\"'b'\">", '<p a="b=" c="d">', '<p  a="b">', '<p a ="b">', "<plaintext>"]
    for _ in range(3000):
        html = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert shape(_Tree(html).root) == shape(Plainly(html).root), html


def test_only_the_facts_asked_for(spark):
    """Duplicates need seven facts of a page; the others are not made, and the fields are those of extract."""
    odd = [("https://e.com/news/a", ARTICLE), ("https://e.com/x", None), ("https://e.com/y", ""), ("https://e.com/z", "<div class='ad'>Buy\x1c now</div><div>" + WORDS + "<footer>Foot  er</footer> end x</div>"), (None, "<p>x")]
    d = rows(spark, *odd)
    want = {r["page_id"]: tuple(r)[1:] for r in pages.extract(d.withColumns({"facts": html_facts("html", "url"), "cls": pages.classify(F.col("url"), html_facts("html", "url"))})).select("page_id", "url", "canonical_url", "title", "main_content").collect()}
    got = pages.compared(d, "page_id")
    assert {r["page_id"]: tuple(r)[1:] for r in got.collect()} == want and "visible_text" not in got._jdf.queryExecution().toString()
    assert "Buy" not in facts(*odd[3])["main_content"] and facts("u", ARTICLE, ("title", "h1")) == {"title": "Site | A title", "h1": "A title"}
    slow = spark.createDataFrame([("a b  c\x1cd  e ", ["b"])], "t string, n array<string>").select(pages.strip_noise(F.col("t"), F.col("n")).alias("r")).first()["r"]
    assert stripped("a b  c\x1cd  e ", ["b"]) == slow
