"""One query for each operator of the curation engine, on the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import dates, text, urls
from millrace.operators import dedup, frontier, pages, stats, store
from millrace.operators.tables import Work
from millrace.plans import crawl, standins
from millrace.plans.standins import ARTICLES_SQL, LOG_SQL, URLS_SQL
from millrace.settings import DEFAULT
from millrace.streaming import log as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-06-01 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# URLs

_PARTS = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_SPLIT = f"""
u AS ({URLS_SQL}),
p AS (
  SELECT page_id, url, lower(regexp_extract(url, '{_PARTS}', 1)) AS scheme, regexp_extract(url, '{_PARTS}', 2) AS host,
         regexp_extract(url, '{_PARTS}', 3) AS path, regexp_extract(url, '{_PARTS}', 4) AS query
  FROM u
), q AS (
  SELECT *, list_transform(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '^[^=]*=.')),
                           lambda x: {{'k': regexp_extract(x, '^([^=]*)=', 1), 'v': regexp_extract(x, '^[^=]*=(.*)$', 1)}}) AS ps
  FROM p
)"""
_TRACKING = ", ".join(f"'{x}'" for x in DEFAULT.tracking_params)


@query("f1_normalize_url", f"""
WITH {_SPLIT},
a AS (SELECT *, CASE WHEN starts_with(path, '/amp') THEN coalesce(nullif(substr(path, 5), ''), '/') ELSE path END AS p1 FROM q),
b AS (SELECT *, CASE WHEN starts_with(p1, '/mobile') THEN coalesce(nullif(substr(p1, 8), ''), '/') ELSE p1 END AS p2 FROM a),
c AS (SELECT *, CASE WHEN starts_with(p2, '/print') THEN coalesce(nullif(substr(p2, 7), ''), '/') ELSE p2 END AS p3 FROM b),
d AS (SELECT *, coalesce(nullif(rtrim(p3, '/'), ''), '/') AS p4,
      array_to_string(list_transform(list_sort(list_filter(ps, lambda x: lower(x.k) NOT IN ({_TRACKING}))), lambda x: x.k || '=' || x.v), '&') AS line FROM c)
SELECT page_id, url, scheme || '://' || lower(host) || CASE WHEN starts_with(p4, '/') THEN '' ELSE '/' END || p4 || CASE WHEN line <> '' THEN '?' || line ELSE '' END AS normalized FROM d
""")  # fmt: skip
def _(spark, sf):
    return standins.urls(spark, sf).select("page_id", "url", urls.normalize(F.col("url")).alias("normalized"))


@query("f2_f4_f6_url_parts", f"""
WITH {_SPLIT}
SELECT page_id, split_part(url, '/', 3) AS domain, host AS netloc, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS depth,
       CAST(len(ps) AS INTEGER) AS n_params FROM q
""")
def _(spark, sf):
    u = F.col("url")
    return standins.urls(spark, sf).select("page_id", urls.domain(u).alias("domain"), urls.netloc(u).alias("netloc"), urls.path_depth(u).alias("depth"), F.size(urls.params(u)).alias("n_params"))


@query("t1_t8_trap_rules", f"""
WITH {_SPLIT},
r AS (SELECT *, TRY_CAST(nullif(regexp_extract(path, '(?i)/page/(\\d+)', 1), '') AS HUGEINT) AS page,
             TRY_CAST(list_filter(ps, lambda x: x.k = 'page')[1].v AS HUGEINT) AS asked,
             regexp_matches(path, '(?i)/archive/\\d{{4}}/\\d{{2}}') AS archive FROM q),
s AS (SELECT page_id, CASE
  WHEN page > 20 OR asked > 20 THEN 'pagination_depth_too_high'
  WHEN archive AND page > 1 THEN 'calendar_archive_trap'
  WHEN archive AND regexp_matches(path, '/page/\\d{{3,}}') THEN 'pagination_depth_too_high'
  WHEN regexp_matches(path, '(?i)/comment-page-\\d+') THEN 'comment_pagination_trap'
  WHEN len(list_filter(ps, lambda x: lower(x.k) IN ('sort', 'order', 'filter', 'facet', 'orderby', 'sortby'))) > 0 THEN 'filter_url_trap'
  WHEN len(list_distinct(list_transform(ps, lambda x: x.k))) > 4 THEN 'filter_url_trap'
  WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) > 8 THEN 'path_too_deep' END AS reason FROM r)
SELECT page_id, CASE WHEN reason IS NULL THEN 'crawl' ELSE 'skip' END AS crawl_decision, reason FROM s
""")
def _(spark, sf):
    return standins.urls(spark, sf).select("page_id", urls.trap(F.col("url")).alias("t")).select("page_id", "t.*")


_SKIPS = " ".join(f"WHEN regexp_matches(f, '{a}') THEN 'url_pattern:{b}'" for a, b in DEFAULT.skip_url_rules)
_BOOSTS = " ".join(f"WHEN regexp_matches(lower(path), '{a}') THEN '{b}'" for a, b in DEFAULT.boost_url_rules)


@query("c1_c4_url_classification", f"""
WITH {_SPLIT}, g AS (SELECT *, lower(path) || CASE WHEN query <> '' THEN '?' || lower(query) ELSE '' END AS f FROM q),
h AS (SELECT page_id, path, CASE WHEN path IN ('', '/') THEN 'homepage' {_SKIPS} WHEN contains(f, '?q=') OR contains(f, 'search?') THEN 'url_pattern:search_page' END AS skip_reason FROM g)
SELECT page_id, skip_reason, CASE {_BOOSTS} END AS boost FROM h
""")
def _(spark, sf):
    u = F.col("url")
    return standins.urls(spark, sf).select("page_id", urls.url_skip(u)["reason"].alias("skip_reason"), urls.url_boost(u).alias("boost"))


@query("f5_urljoin")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.resolve("url", F.concat(F.lit("../x/"), F.col("page_id").cast("string"))).alias("joined"))


# Text

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')"


@query("f8_f10_words_and_content_hash", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS words,
       CASE WHEN length(text) > 0 THEN sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) END AS hash FROM documents
""")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), text.content_hash(F.col("text")).alias("hash"))


@query("f11_shingle_counts", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1
       ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS INTEGER) AS n_shingles FROM w
""")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(text.shingles(F.coalesce("text", F.lit("")))).alias("n_shingles"))


@query("f14_summary", """
WITH t AS (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
j AS (SELECT doc_id, array_to_string(s[1:2], ' ') AS two FROM t)
SELECT doc_id, CASE WHEN length(two) > 400 THEN substr(two, 1, 397) || '...' ELSE two END AS summary FROM j
""")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("f16_paragraph_proxy", """
SELECT doc_id, CAST((length(text) - length(replace(text, chr(10), ''))) + (length(text) - length(replace(text, '. ', ''))) // 2 AS BIGINT) AS paragraphs FROM documents
""")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.paragraphs(F.col("text")).cast("long").alias("paragraphs"))


@query("f12_title_ratio")
def _(spark, sf):
    d = read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("t"))
    w = W.partitionBy(F.pmod("page_id", F.lit(64))).orderBy("page_id")
    return d.withColumn("b", F.lag("t").over(w)).select("page_id", text.title_ratio("t", "b").alias("ratio"))


@query("f13_minhash_signatures")
def _(spark, sf):
    d = read(spark, sf, "documents").where(text.has_words(F.col("text")))
    return d.select("doc_id", text.text_minhash(F.col("text"), 5, DEFAULT.minhash_permutations).alias("signature"))


@query("f15_language")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.language(F.col("text")).alias("language"))


# Dates

_DATED = "case o_orderkey % 6 when 0 then substr(cast(o_orderdate as varchar(30)), 1, 10) when 1 then concat(substr(cast(o_orderdate as varchar(30)), 1, 10), 'T12:00:00') when 2 then '' when 3 then 'soon' when 4 then concat(substr(cast(o_orderdate as varchar(30)), 1, 10), ' 23:59:59') end"


@query("f22_freshness", f"""
WITH d AS (SELECT o_orderkey, {_DATED} AS day FROM orders),
t AS (SELECT *, coalesce(try_strptime(substr(day, 1, 19), '%Y-%m-%d'), try_strptime(substr(day, 1, 19), '%Y-%m-%dT%H:%M:%S'), try_strptime(substr(day, 1, 19), '%Y-%m-%d %H:%M:%S')) AS stamp FROM d),
a AS (SELECT *, floor((epoch(TIMESTAMP '1998-08-03 00:00:00') - epoch(stamp)) / 86400) AS days FROM t)
SELECT o_orderkey, CAST(CASE WHEN coalesce(day, '') = '' THEN 0.2 WHEN stamp IS NULL THEN 0.3 WHEN days <= 7 THEN 1.0 WHEN days <= 30 THEN 0.8
       WHEN days <= 90 THEN 0.6 WHEN days <= 365 THEN 0.4 ELSE 0.2 END AS DOUBLE) AS freshness FROM a
""")
def _(spark, sf):
    d = read(spark, sf, "orders").selectExpr("o_orderkey", f"{_DATED} AS date")
    return d.select("o_orderkey", dates.freshness(F.col("date"), F.lit("1998-08-03 00:00:00").cast("timestamp")).alias("freshness"))


@query("f23_f24_recrawl_ttl", f"""
WITH a AS ({ARTICLES_SQL}), b AS (SELECT *, CASE page_type WHEN 'news_article' THEN 24 WHEN 'blog_post' THEN 72 WHEN 'wiki' THEN 168 WHEN 'educational' THEN 168 WHEN 'financial' THEN 48 ELSE 96 END AS base, id % 2 = 0 AS changed FROM a)
SELECT id, base AS base_ttl, CAST(CASE WHEN changed THEN greatest(6, floor(base * 0.5)) ELSE least(720, floor(base * 1.5)) END AS INTEGER) AS next_ttl,
       CASE WHEN changed THEN 'content_changed_ttl_halved' ELSE 'content_unchanged_ttl_extended' END AS why FROM b
""")
def _(spark, sf):
    kind, changed = F.col("page_type"), F.col("id") % 2 == 0
    return standins.articles(spark, sf).select("id", dates.base_ttl(kind).alias("base_ttl"), dates.next_ttl(kind, changed).alias("next_ttl"), dates.ttl_reason(changed).alias("why"))


# Pages

_MARKED = "case page_id % 8 when 0 then concat('<html>Just a moment', html) when 1 then '<p>please solve hcaptcha</p>' when 2 then '<p>Access Denied</p>' else html end"
_STATUS = "case page_id % 9 when 4 then 403 when 5 then 429 else 200 end"


@query("b1_b5_block_detection", f"""
WITH p AS (SELECT page_id, {_STATUS} AS status, lower({_MARKED}) AS low, page_id % 16 = 0 AS cf FROM pages),
m AS (SELECT *, len(regexp_extract_all(low, '\\S+')) AS words, contains(low, 'just a moment') OR contains(low, 'checking your browser') OR contains(low, 'cf-browser-verification') OR contains(low, 'cf-challenge') AS cloud,
  contains(low, 'g-recaptcha') OR contains(low, 'hcaptcha') OR contains(low, 'cf-turnstile') OR contains(low, 'captcha-checkbox') OR contains(low, 'verify you are human') OR contains(low, 'are you a robot') AS captcha,
  contains(low, 'access denied') OR contains(low, 'unusual traffic') OR contains(low, 'request blocked') OR contains(low, 'rate limited') AS bot FROM p),
r AS (SELECT page_id, status, CASE WHEN status IN (403, 429, 503) THEN 'http_' || status WHEN cf AND cloud THEN 'cloudflare_challenge' WHEN cloud THEN 'cloudflare_detected'
  WHEN captcha AND words <= 500 THEN 'captcha_detected' WHEN bot AND words <= 1000 THEN 'generic_bot_detected' END AS reason FROM m)
SELECT page_id, reason IS NOT NULL AS blocked, reason, status = 429 AS should_retry FROM r
""")
def _(spark, sf):
    p = read(spark, sf, "pages").selectExpr("page_id", f"{_STATUS} AS status", f"{_MARKED} AS html", "case when page_id % 16 = 0 then map('Server', 'cloudflare') else map('Server', 'x') end AS headers")
    return p.select("page_id", pages.block(F.col("status"), F.col("headers"), F.col("html")).alias("b")).select("page_id", "b.*")


_CLEAN = "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis')"
_UNESCAPED = "replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_FACTS = f"""
t AS (SELECT page_id, url, html, {_CLEAN} AS clean FROM pages),
n AS (SELECT *, list_filter(list_transform(regexp_split_to_array(clean, '<[^>]*>'), lambda x: trim({_UNESCAPED}, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS nodes FROM t),
f AS (SELECT *, array_to_string(nodes, ' ') AS body, len(regexp_extract_all(clean, '(?i)<a[\\s>]')) AS n_links,
  list_sum(list_transform(regexp_extract_all(clean, '(?s)<a[^>]*>(.*?)</a>', 1), lambda x: length({_UNESCAPED}))) AS link_len,
  contains(clean, '<article') AS has_article FROM n),
w AS (SELECT *, len(regexp_extract_all(body, '\\S+')) AS words FROM f)"""


@query("e_html_facts", f"WITH {_FACTS} SELECT page_id, CAST(words AS INTEGER) AS words, CAST(length(body) AS INTEGER) AS body_length, CAST(n_links AS INTEGER) AS n_links, CAST(link_len AS INTEGER) AS link_text_len, has_article FROM w")
def _(spark, sf):
    f = F.col("facts")
    rows = pages.with_facts(read(spark, sf, "pages"))
    return rows.select("page_id", text.word_count(f["visible_text"]).alias("words"), F.length(f["visible_text"]).alias("body_length"), f["n_links"].alias("n_links"), f["link_text_len"].alias("link_text_len"), f["has_article"].alias("has_article"))


@query("c5_c15_classify_pages", f"""
WITH {_FACTS}, s AS (SELECT *, CAST(0 AS DOUBLE) + CASE WHEN has_article THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN words >= 250 THEN 0.15::DOUBLE WHEN words < 100 THEN -0.25::DOUBLE ELSE 0 END
  + CASE WHEN n_links > 0 AND greatest(length(body), 1) / greatest(link_len, 1) > 3 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN n_links > 100 THEN -0.20::DOUBLE ELSE 0 END AS score FROM w)
SELECT page_id, CASE WHEN has_article THEN 'news_article' ELSE 'other' END AS page_type, score >= 0.40 AS is_content_page, CASE WHEN score < 0.40 THEN 'low_confidence' END AS skip_reason FROM s
""")
def _(spark, sf):
    rows = pages.with_facts(read(spark, sf, "pages"))
    return rows.select("page_id", pages.classify(F.col("url"), F.col("facts")).alias("c")).select("page_id", "c.page_type", "c.is_content_page", "c.skip_reason")


@query("e10_broken_html", """
SELECT page_id, abs(len(regexp_extract_all(html, '<[a-zA-Z][^/>]*>')) - len(regexp_extract_all(html, '</[a-zA-Z][^>]*>'))) > 5 AS broken FROM pages
""")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", pages.broken_html(F.col("html")).alias("broken"))


@query("b_thin_content", f"WITH {_FACTS} SELECT page_id, words < 50 AND len(regexp_extract_all(html, '(?i)<script')) >= 3 AS thin FROM w")
def _(spark, sf):
    return pages.with_facts(read(spark, sf, "pages")).select("page_id", pages.thin(F.col("facts")).alias("thin"))


@query("e8_strip_noise", """
WITH s AS (SELECT doc_id, text, split_part(text, ' ', 1) AS a, split_part(text, ' ', 2) AS b FROM documents),
t AS (SELECT *, CASE WHEN length(a) < length(text) * 0.3 AND a <> '' THEN replace(text, a, '') ELSE text END AS u FROM s),
v AS (SELECT *, CASE WHEN length(b) < length(u) * 0.3 AND b <> '' THEN replace(u, b, '') ELSE u END AS x FROM t)
SELECT doc_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS body FROM v
""")
def _(spark, sf):
    parts = F.filter(F.slice(F.split("text", " "), 1, 2), lambda w: w != "")
    return read(spark, sf, "documents").select("doc_id", pages.strip_noise(F.col("text"), parts).alias("body"))


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.with_facts(read(spark, sf, "pages"))
    return pages.extract(rows.withColumn("cls", pages.classify(F.col("url"), F.col("facts"))))


@query("e1_e12_extract_articles")
def _(spark, sf):
    return _extracted(spark, sf).drop("html", "facts", "cls")


@query("links_same_site")
def _(spark, sf):
    return pages.same_site_links(_extracted(spark, sf).withColumn("depth", F.lit(0)), 2)


@query("quality_articles")
def _(spark, sf):
    return pages.quality(_extracted(spark, sf), as_of()).select("page_id", "quality_score", "quality_factors", "quality_reasons")


_W = "len(regexp_extract_all(text, '\\S+'))"


@query("quality_five_factors", f"""
WITH d AS (SELECT doc_id, text, {_W} AS words, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'x' END AS title, CASE WHEN doc_id % 4 = 0 THEN 'a' END AS author,
  CASE WHEN doc_id % 5 = 0 THEN '2024-05-20' WHEN doc_id % 5 = 1 THEN 'soon' END AS published_date, CAST(doc_id % 7 AS INTEGER) AS heads, CAST(doc_id % 6 AS INTEGER) AS probs, CASE WHEN doc_id % 6 >= 2 THEN 'messy' ELSE 'ok' END AS hq,
  (length(text) - length(replace(text, chr(10), ''))) + (length(text) - length(replace(text, '. ', ''))) // 2 AS paras FROM documents WHERE length(text) > 0),
f AS (SELECT doc_id, (CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN author <> '' THEN 1 ELSE 0 END + CASE WHEN published_date <> '' THEN 1 ELSE 0 END + CASE WHEN words >= 125 THEN 1 ELSE 0 END + CASE WHEN heads > 0 THEN 1 ELSE 0 END) / 5.0::DOUBLE AS completeness,
  greatest(0, least(1, (1.0::DOUBLE - 0.08::DOUBLE * probs - CASE WHEN hq = 'messy' THEN 0.15::DOUBLE ELSE 0 END) * CASE WHEN words > 0 THEN 0.5::DOUBLE + 0.5::DOUBLE * least(words / 250.0::DOUBLE, 1) ELSE 1 END)) AS cleanliness,
  least(1, least(words / 1000.0::DOUBLE, 1) * 0.6::DOUBLE + least(heads / 5.0::DOUBLE, 1) * 0.2::DOUBLE + least(paras / 10.0::DOUBLE, 1) * 0.2::DOUBLE) AS usefulness,
  CASE WHEN published_date IS NULL THEN 0.2::DOUBLE WHEN published_date = 'soon' THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS freshness FROM d)
SELECT doc_id, CAST(round((0.30::DOUBLE * completeness + 0.25::DOUBLE * cleanliness + 0.20::DOUBLE * usefulness + 0.15::DOUBLE + 0.10::DOUBLE * freshness) * 1000000) AS BIGINT) AS millionths FROM f
""")
def _(spark, sf):
    k = F.col("doc_id")
    d = read(spark, sf, "documents").where(F.length("text") > 0)
    rows = d.select(
        "doc_id", F.col("text").alias("main_content"), F.when(k % 3 == 0, "").otherwise("x").alias("title"), F.when(k % 4 == 0, "a").alias("author"),
        F.when(k % 5 == 0, "2024-05-20").when(k % 5 == 1, "soon").alias("published_date"), F.array_repeat(F.lit("h"), (k % 7).cast("int")).alias("headings"),
        F.array_repeat(F.lit("p"), (k % 6).cast("int")).alias("problems_detected"), F.when(k % 6 >= 2, "messy").otherwise("ok").alias("html_quality"),
    )
    return pages.quality(rows, as_of()).select("doc_id", F.round(F.col("raw_quality") * 1000000).cast("long").alias("millionths"))


# Duplicates


@query("l4_max_similarity", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, a.n AS ni, b.n AS nj, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
m AS (SELECT j, max(shared / (ni + nj - shared)) AS best FROM p WHERE shared >= 0.85 * (ni + nj - shared) GROUP BY j)
SELECT doc_id AS id, CAST(round(coalesce(best, 0) * 1000000) AS BIGINT) AS millionths FROM s LEFT JOIN m ON j = doc_id WHERE len(s) > 0
""")
def _(spark, sf):
    work = Work(spark, "similarity")
    members, links = dedup.similar_sets(read(spark, sf, "documents"), "doc_id", "text", work)
    return dedup.max_similarity(members, links).select("id", F.round(F.col("max_similarity") * 1000000).cast("long").alias("millionths"))


@query("j7_minhash_bands")
def _(spark, sf):
    return dedup.banded_pairs(read(spark, sf, "pages").withColumn("body", F.regexp_replace("html", "<[^>]*>", " ")), "page_id", "body", Work(spark, "bands"))


@query("l1_l4_deduplicate_pages")
def _(spark, sf):
    return dedup.resolve(pages.compared(read(spark, sf, "pages").withColumnRenamed("page_id", "seq"), "seq"), Work(spark, "dedup"))


@query("j4_j6_exact_layers", """
WITH k AS (SELECT doc_id AS seq, 'h' || sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key FROM documents WHERE length(text) > 0),
f AS (SELECT key, min(seq) AS first FROM k GROUP BY key)
SELECT seq AS id, seq = first AS kept FROM k JOIN f USING (key)
""")
def _(spark, sf):
    work = Work(spark, "layers")
    d = read(spark, sf, "documents").where(F.length("text") > 0)
    keys = work.table(d.select(F.col("doc_id").alias("id"), F.concat(F.lit("h"), text.content_hash(F.col("text"))).alias("key")), "keys")
    none = spark.createDataFrame([], "id long, c long"), spark.createDataFrame([], "c long, d long")
    return dedup.first_kept(keys, *none, work)


# Store

_A = f"a AS ({ARTICLES_SQL})"
_L = f"l AS ({LOG_SQL})"


@query("k1_upsert", f"""
WITH {_A}, t AS (SELECT * FROM a WHERE id % 2 = 0), r AS (SELECT url, concat(title, ' new') AS title, 1.0::DOUBLE AS quality_score FROM a)
SELECT coalesce(t.url, r.url) AS url, coalesce(r.title, t.title) AS title, CASE WHEN r.url IS NOT NULL THEN r.quality_score ELSE t.quality_score END AS quality_score, t.id IS NULL AS inserted FROM t FULL JOIN r ON t.url = r.url
""")
def _(spark, sf):
    a = standins.articles(spark, sf)
    table = a.where("id % 2 = 0").select("id", "url", "title", "quality_score")
    rows = a.select("url", F.concat("title", F.lit(" new")).alias("title"), F.lit(1.0).alias("quality_score"), F.col("id").alias("seq"))
    old = table.select(F.col("url").alias("_u"))
    out = store.upsert(table, rows, "seq")
    return out.join(old, F.col("url") == F.col("_u"), "left").select("url", "title", "quality_score", F.col("_u").isNull().alias("inserted"))


@query("k2_insert_absent", f"WITH {_A} SELECT min(id) AS id, url, 'first' AS offer FROM a WHERE url NOT IN (SELECT url FROM a WHERE id % 2 = 0) GROUP BY url")
def _(spark, sf):
    a = standins.articles(spark, sf).select("id", "url")
    offers = F.explode(F.array(F.struct(F.lit("second").alias("offer"), (F.col("id") * 2 + 1).alias("seq")), F.struct(F.lit("first").alias("offer"), (F.col("id") * 2).alias("seq"))))
    rows = a.select("id", "url", offers.alias("o")).select("id", "url", "o.offer", "o.seq")
    return store.insert_absent(a.where("id % 2 = 0"), rows, "seq").select("id", "url", "offer")


@query("k3_log_status", f"WITH {_L} SELECT id, CASE WHEN blocked THEN 'blocked' ELSE coalesce(CASE WHEN id % 4 <> 0 THEN '200' END, 'skipped') END AS status FROM l")
def _(spark, sf):
    return standins.log(spark, sf).select("id", store.log_status(F.when(F.col("id") % 4 != 0, 200), F.col("blocked")).alias("status"))


@query("k4_mark_frontier", f"WITH {_A} SELECT id, url, CASE WHEN id % 5 = 0 THEN 'done' ELSE 'queued' END AS status, CASE WHEN id % 10 = 0 THEN 'late' ELSE 'early' END AS skip_reason FROM a")
def _(spark, sf):
    a = standins.articles(spark, sf)
    table = a.select("id", "url", F.lit("queued").alias("status"), F.lit("early").alias("skip_reason"))
    step = lambda seq, status, reason: F.struct(F.lit(seq).alias("seq"), F.lit(status).alias("status"), reason.cast("string").alias("skip_reason"))
    late = F.when(F.col("id") % 10 == 0, "late")
    steps = F.explode(F.array(step(3, "done", F.lit(None)), step(1, "in_progress", F.lit(None)), step(2, "skipped", late)))
    return frontier.mark(table, a.where("id % 5 = 0").select("url", steps.alias("s")).select("url", "s.*"))


@query("k5_r11_set_recrawl", f"WITH {_A} SELECT id, strftime(CASE WHEN id % 4 = 0 THEN TIMESTAMP '{AS_OF}' ELSE next_recrawl_at END, '%Y-%m-%d %H:%M:%S') AS next_at FROM a")
def _(spark, sf):
    a = standins.articles(spark, sf)
    step = lambda seq, days: F.struct(F.lit(seq).alias("seq"), (as_of() + F.make_interval(days=F.lit(days))).alias("next_at"))
    times = a.where("id % 4 = 0").select("url", F.explode(F.array(step(2, 0), step(1, 9))).alias("s")).select("url", "s.*")
    return store.set_recrawl(a, times).select("id", F.date_format("next_recrawl_at", "yyyy-MM-dd HH:mm:ss").alias("next_at"))


@query("p1_p2_o1_o2_search", f"WITH {_A} SELECT id, url, quality_score FROM a WHERE (title ILIKE '%urgent%' OR main_content ILIKE '%urgent%' OR url ILIKE '%urgent%') AND page_type = 'wiki' AND quality_score >= 0.25 ORDER BY quality_score DESC NULLS LAST, id LIMIT 50 OFFSET 10")
def _(spark, sf):
    return store.search(standins.articles(spark, sf), "urgent", "wiki", 0.25, "quality", 50, 10).select("id", "url", "quality_score")


@query("o1_search_by_date", f"WITH {_A} SELECT id, published_date FROM a ORDER BY published_date DESC NULLS LAST, id LIMIT 200")
def _(spark, sf):
    return store.search(standins.articles(spark, sf), sort="date", limit=200).select("id", "published_date")


@query("p3_by_id", f"WITH {_A} SELECT id, url, title FROM a WHERE id = 7")
def _(spark, sf):
    return store.by_id(standins.articles(spark, sf), 7).select("id", "url", "title")


@query("p4_due_recrawls", f"WITH {_A} SELECT url FROM a WHERE next_recrawl_at IS NOT NULL AND next_recrawl_at <= TIMESTAMP '1997-01-01 00:00:00'")
def _(spark, sf):
    return store.due(standins.articles(spark, sf), F.lit("1997-01-01 00:00:00").cast("timestamp"))


@query("p6_article_view", f"WITH {_A} SELECT id, coalesce(quality_score, 0.0) AS quality_score, coalesce(html_quality, 'ok') AS html_quality, false AS is_duplicate FROM a")
def _(spark, sf):
    return store.as_article(standins.articles(spark, sf)).select("id", "quality_score", "html_quality", "is_duplicate")


_DECISION = "CASE WHEN coalesce(blocked, false) THEN 'blocked' WHEN coalesce(is_duplicate, false) THEN 'duplicate' WHEN coalesce(skip_reason, '') <> '' THEN 'skipped' WHEN coalesce(extraction_ok, false) THEN 'saved' ELSE 'error' END"


@query("p7_p8_p11_log_entries", f"""WITH {_L} SELECT id, url, coalesce(TRY_CAST(status AS INTEGER), 0) AS status, {_DECISION} AS decision,
  coalesce(nullif(blocked_reason, ''), nullif(skip_reason, ''), nullif(duplicate_reason, ''), CASE WHEN quality_score IS NOT NULL THEN 'quality ' || printf('%.2f', quality_score) END) AS reason FROM l""")
def _(spark, sf):
    return store.as_log_entry(standins.log(spark, sf)).select("id", "url", "status", "decision", "reason")


@query("p12_p13_tier_and_initials", f"WITH {_A} SELECT id, CASE WHEN quality_score >= 0.8 THEN 'high' WHEN quality_score >= 0.6 THEN 'medium' ELSE 'low' END AS tier, upper(substr(split_part(regexp_replace(split_part(url, '/', 3), '^www\\.', ''), '.', 1), 1, 2)) AS initials FROM a")
def _(spark, sf):
    return standins.articles(spark, sf).select("id", store.tier(F.col("quality_score")).alias("tier"), store.initials(urls.domain(F.col("url"))).alias("initials"))


@query("o3_log_tail", f"WITH {_L} SELECT id, url FROM l ORDER BY id OFFSET 100")
def _(spark, sf):
    return store.tail(standins.log(spark, sf), 100).select("id", "url")


@query("o5_u1_top_headings", """
SELECT doc_id, list_filter(string_split(text, ' ')[1:10], lambda x: x <> '') AS heads FROM documents
""")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.filter(F.slice(F.split("text", " "), 1, 10), lambda x: x != "").alias("heads"))


@query("j3_j9_alias_join", f"WITH {_A}, m AS (SELECT url, concat('page', cast(id AS VARCHAR)) AS name FROM a WHERE id % 100 = 0) SELECT a.id, m.name FROM a LEFT JOIN m USING (url)")
def _(spark, sf):
    from millrace.sources import readers

    a = standins.articles(spark, sf).select("id", "url")
    return readers.with_aliases(a, a.where("id % 100 = 0").select("url", F.concat(F.lit("page"), F.col("id").cast("string")).alias("name"))).select("id", "name")


@query("p5_recrawl_time", f"WITH {_A} SELECT strftime(next_recrawl_at, '%Y-%m-%d %H:%M:%S') AS next_at FROM a WHERE url IN (SELECT url FROM a WHERE id = 3)")
def _(spark, sf):
    a = standins.articles(spark, sf)
    return store.recrawl_time(a, store.by_id(a, 3).first()["url"]).select(F.date_format("next_recrawl_at", "yyyy-MM-dd HH:mm:ss").alias("next_at"))


@query("p9_fetch_report", f"WITH {_L} SELECT id, url, CASE WHEN blocked THEN 'blocked' ELSE '200' END AS status FROM l")
def _(spark, sf):
    rows = standins.log(spark, sf).select("id", "url", "blocked", F.lit(200).alias("status"), F.lit("<p>").alias("html"))
    return store.without_body(rows).select("id", "url", "status")


@query("f20_json_interchange", "SELECT doc_id, '[\"' || source || '\",\"' || lang || '\"]' AS line, source AS first FROM documents")
def _(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.array("source", "lang").alias("line"))
    text_ = store.interchange(rows, ["line"])
    back = store.from_interchange(text_.withColumn("back", F.col("line")), {"back": "array<string>"})
    return back.select("doc_id", "line", F.get("back", F.lit(0)).alias("first"))


# Statistics

_GOOD = "NOT coalesce(blocked, false) AND NOT coalesce(is_duplicate, false) AND coalesce(skip_reason, '') = '' AND coalesce(extraction_ok, false)"
_TOTALS = f"""
SELECT total_attempted, blocked_count, duplicates_removed, traps_skipped, good, ok, tried, articles_saved, messy_html_count, avg_quality FROM (
 SELECT count(*) AS total_attempted, count(*) FILTER (blocked) AS blocked_count, count(*) FILTER (is_duplicate) AS duplicates_removed, count(*) FILTER (coalesce(skip_reason, '') <> '') AS traps_skipped,
  count(*) FILTER ({_GOOD}) AS good, count(*) FILTER (extraction_ok) AS ok, count(extraction_ok) AS tried FROM l),
 (SELECT count(*) AS articles_saved, count(*) FILTER (html_quality = 'messy') AS messy_html_count, avg(nullif(quality_score, 0)) AS avg_quality FROM a)"""


@query("a1_a9_totals", f"WITH {_L}, {_A}, s AS ({_TOTALS}) SELECT total_attempted, blocked_count, duplicates_removed, traps_skipped, articles_saved, messy_html_count, CAST(round(good / total_attempted * 1000000) AS BIGINT) AS success_millionths, CAST(round(ok / tried * 1000000) AS BIGINT) AS extraction_millionths, CAST(round(avg_quality * 1000000) AS BIGINT) AS quality_millionths FROM s")
def _(spark, sf):
    t = stats.totals(standins.log(spark, sf), standins.articles(spark, sf))
    m = lambda c, name: F.round(F.col(c) * 1000000).cast("long").alias(name)
    return t.select("total_attempted", "blocked_count", "duplicates_removed", "traps_skipped", "articles_saved", "messy_html_count", m("crawl_success_rate", "success_millionths"), m("extraction_success_rate", "extraction_millionths"), m("avg_quality", "quality_millionths"))


@query("p10_stats_contract", f"WITH {_L}, {_A}, s AS ({_TOTALS}) SELECT total_attempted AS attempted, articles_saved AS saved, blocked_count AS blocked, duplicates_removed AS duplicates, traps_skipped AS skipped FROM s")
def _(spark, sf):
    return stats.contract(stats.totals(standins.log(spark, sf), standins.articles(spark, sf))).select("attempted", "saved", "blocked", "duplicates", "skipped")


@query("p14_outcome_slices", f"WITH {_L}, {_A}, s AS ({_TOTALS}), o AS (SELECT 'saved' AS outcome, articles_saved AS n FROM s UNION ALL SELECT 'blocked', blocked_count FROM s UNION ALL SELECT 'duplicate', duplicates_removed FROM s UNION ALL SELECT 'skipped', traps_skipped FROM s) SELECT * FROM o WHERE n > 0")
def _(spark, sf):
    return stats.outcomes(stats.totals(standins.log(spark, sf), standins.articles(spark, sf)))


for _kind, _test in (("blocked", "blocked"), ("skip", "coalesce(skip_reason, '') <> ''"), ("duplicate", "is_duplicate")):

    @query(f"a10_{_kind}_reasons", f"WITH {_L} SELECT coalesce(nullif({_kind}_reason, ''), 'unknown') AS reason, count(*) AS n FROM l WHERE {_test} GROUP BY 1 ORDER BY n DESC, reason")
    def _(spark, sf, kind=_kind):
        return stats.reasons(standins.log(spark, sf), kind)


@query("o4_k8_report_lines", f"WITH {_L} SELECT substr(coalesce(nullif(skip_reason, ''), 'unknown'), 1, 12) AS reason, count(*) AS n FROM l WHERE coalesce(skip_reason, '') <> '' GROUP BY coalesce(nullif(skip_reason, ''), 'unknown')")
def _(spark, sf):
    return stats.report_lines(stats.reasons(standins.log(spark, sf), "skip"), 12)


@query("a11_j8_per_domain", f"""WITH {_L}, {_A}, d AS (SELECT split_part(url, '/', 3) AS domain, 1 AS attempted, CASE WHEN blocked THEN 1 ELSE 0 END AS blocked, 0 AS saved FROM l
 UNION ALL SELECT coalesce(nullif(source_domain, ''), split_part(url, '/', 3)), 0, 0, 1 FROM a)
SELECT domain, CAST(sum(attempted) AS BIGINT) AS attempted, CAST(sum(blocked) AS BIGINT) AS blocked, CAST(sum(saved) AS BIGINT) AS saved FROM d GROUP BY domain ORDER BY domain""")
def _(spark, sf):
    return stats.per_domain(standins.log(spark, sf), standins.articles(spark, sf))


@query("a12_domain_counts", f"WITH {_A} SELECT source_domain, count(*) AS n FROM a WHERE source_domain IS NOT NULL GROUP BY source_domain")
def _(spark, sf):
    return store.domain_counts(standins.articles(spark, sf))


@query("a13_log_count", "SELECT count(*) AS n FROM events")
def _(spark, sf):
    return standins.log(spark, sf).agg(F.count("*").alias("n"))


@query("a_outcome_rollup", f"WITH {_L}, d AS (SELECT {_DECISION} AS decision, split_part(url, '/', 3) AS domain FROM l) SELECT decision, domain, count(*) AS n FROM d GROUP BY ROLLUP (decision, domain)")
def _(spark, sf):
    return stats.by_outcome_and_domain(standins.log(spark, sf))


# Frontier


@query("r1_j1_j2_enqueue", f"""WITH {_A}, s AS (SELECT split_part(url, '/', 3) AS domain, count(*) * 10 AS n FROM a GROUP BY 1)
SELECT url, CAST(min_by(id % 3, id) AS INTEGER) AS depth, CASE WHEN max(n) >= 500 THEN 'skipped' ELSE 'queued' END AS status, CASE WHEN max(n) >= 500 THEN 'domain_budget_exceeded' END AS skip_reason
FROM a JOIN s ON s.domain = split_part(url, '/', 3) WHERE id % 2 = 1 AND url NOT IN (SELECT url FROM a WHERE id % 4 = 1) GROUP BY url""")
def _(spark, sf):
    a = standins.articles(spark, sf)
    new = a.where("id % 2 = 1").select(F.col("id").alias("seq"), "url", (F.col("id") % 3).cast("int").alias("depth"))
    saved = a.groupBy(urls.domain(F.col("url")).alias("domain")).agg((F.count("*") * 10).alias("n"))
    return frontier.enqueue(new, a.where("id % 4 = 1").select("url"), saved)


@query("r2_o6_dequeue_order", f"WITH {_A} SELECT id, url FROM a WHERE id % 2 = 0 ORDER BY id % 3 DESC, id")
def _(spark, sf):
    a = standins.articles(spark, sf).select("id", "url", (F.col("id") % 3).alias("depth"), F.when(F.col("id") % 2 == 0, "queued").otherwise("done").alias("status"))
    return frontier.next_level(a).select("id", "url")


@query("r7_fetch_slots", f"WITH {_A} SELECT id AS seq, split_part(url, '/', 3) AS host, CAST((row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY id) - 1) * 1.5 AS DOUBLE) AS not_before FROM a")
def _(spark, sf):
    rows = frontier.slots(standins.articles(spark, sf).select(F.col("id").alias("seq"), "url"))
    return rows.select("seq", "host", "not_before")


@query("r6_j3_robots", f"WITH {_A} SELECT id, CASE WHEN o.host IS NULL THEN true ELSE id % 10 <> 3 END AS allowed, CASE WHEN o.host IS NOT NULL THEN 2.5::DOUBLE END AS crawl_delay FROM (SELECT id, split_part(url, '/', 3) AS h FROM a) LEFT JOIN (SELECT DISTINCT split_part(url, '/', 3) AS host FROM a WHERE id % 50 = 0) o ON o.host = h")
def _(spark, sf):
    a = standins.articles(spark, sf)
    robots = a.where("id % 50 = 0").select(urls.netloc(F.col("url")).alias("host")).distinct().withColumn("text", F.lit("User-agent: *\nDisallow: /*3$\nCrawl-delay: 2.5\n"))
    return frontier.allowed(a.select("id", "url"), robots).select("id", "allowed", "crawl_delay")


@query("s1_seed_lines", "SELECT DISTINCT url FROM pages")
def _(spark, sf):
    from millrace.sources import readers

    work = Work(spark, "seeds")
    path = f"{work.root}/seeds"
    lines = read(spark, sf, "pages").select(F.explode(F.array(F.concat(F.lit("  "), "url"), F.lit("# note"), F.lit(""))).alias("value"))
    lines.write.text(path)
    return readers.seeds(spark, path).distinct()


@query("crawl_rounds")
def _(spark, sf):
    p = read(spark, sf, "pages")
    return crawl.crawl(spark, p.select(F.col("page_id").alias("seq"), "url"), p.select("url", "html"), Work(spark, "crawl"), 1, as_of=as_of())[0]


def curated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, "pages").select(F.col("page_id").alias("seq"), "url", F.lit(200).alias("status"), F.create_map(F.lit("server"), F.lit("x")).alias("headers"), "html")
    return crawl.curate(rows, Work(spark, "curate"), as_of())


@query("pipeline_curate_articles")
def _(spark, sf):
    return curated(spark, sf)[0].select("seq", "url", "title", "page_type", "language", "html_quality", "quality_score", "max_similarity")


@query("pipeline_curate_log")
def _(spark, sf):
    return curated(spark, sf)[1]


# Streams


def _complete(df: DataFrame, work: Work, name: str) -> DataFrame:
    """The final result of a stream that is run over what there is."""
    path = f"{work.root}/{name}"
    run = df.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    schema = read(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.selectExpr(*(f"{e} AS {c}" for c, e in standins.LOG.items()))


@query("r9_r10_stream_counts", f"WITH {_L} SELECT {_DECISION} AS decision, count(*) AS n FROM l GROUP BY 1")
def _(spark, sf):
    return _complete(stream.counts(_streamed(spark, sf)), Work(spark, "stream"), "counts")


@query("r13_stream_windows", f"WITH {_L} SELECT strftime(time_bucket(INTERVAL '1 hour', crawled_at), '%Y-%m-%d %H:%M') AS start, {_DECISION} AS decision, count(*) AS n FROM l GROUP BY 1, 2")
def _(spark, sf):
    out = _complete(stream.rates(_streamed(spark, sf)), Work(spark, "stream"), "rates")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "decision", "n")
