"""Tables of the store, derived from the driver's star schema: each column is one expression that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG = {
    "id": "event_id",
    "url": "concat('https://site', cast(user_id % 97 as varchar(20)), '.example.com/p/', cast(event_id % 5000 as varchar(20)))",
    "status": "case when event_type = 'error' then 'blocked' when event_type = 'signup' then 'skipped' else '200' end",
    "blocked": "event_type = 'error'",
    "blocked_reason": "case when event_type = 'error' then case event_id % 3 when 0 then cast(null as varchar(20)) when 1 then 'http_403' else 'captcha_detected' end end",
    "is_duplicate": "event_type = 'purchase'",
    "duplicate_reason": "case when event_type = 'purchase' then case event_id % 4 when 0 then 'same_content_hash' when 1 then '' else 'same_canonical_url' end end",
    "skip_reason": "case when event_type = 'signup' then case event_id % 2 when 0 then 'filter_url_trap' else 'low_confidence' end when event_id % 10 = 0 then '' end",
    "page_type": "case event_id % 3 when 0 then 'wiki' when 1 then 'news_article' else 'other' end",
    "quality_score": "case when event_type = 'click' then cast(event_id % 101 as double) / 100 end",
    "html_quality": "case event_id % 5 when 0 then 'messy' else 'ok' end",
    "extraction_ok": "case when event_type in ('click', 'view') then event_id % 7 <> 0 end",
    "elapsed_ms": "value",
    "crawled_at": "cast(ts as timestamp)",
}
ARTICLES = {
    "id": "o_orderkey",
    "url": "concat('https://site', cast(o_custkey % 97 as varchar(20)), '.example.com/a/', cast(o_orderkey as varchar(20)))",
    "title": "concat(o_orderpriority, ' order')",
    "main_content": "concat('Status ', o_orderstatus, ' of customer ', cast(o_custkey as varchar(20)))",
    "page_type": "case o_orderkey % 4 when 0 then 'wiki' when 1 then 'news_article' when 2 then 'blog_post' else 'financial' end",
    "quality_score": "case when o_orderkey % 11 <> 3 then cast(o_orderkey % 101 as double) / 100 end",
    "published_date": "case when o_orderkey % 9 <> 1 then substr(cast(o_orderdate as varchar(30)), 1, 10) end",
    "html_quality": "case o_orderkey % 6 when 0 then 'messy' when 1 then cast(null as varchar(5)) else 'ok' end",
    "source_domain": "case when o_orderkey % 8 <> 5 then concat('site', cast(o_custkey % 97 as varchar(20)), '.example.com') end",
    "next_recrawl_at": "case when o_orderkey % 3 = 0 then cast(o_orderdate as timestamp) end",
}
URLS = (
    "concat('https://Host', cast(page_id % 5 as varchar(20)), '.Example.com', case page_id % 14 when 0 then '/page/21' when 1 then '/page/20' when 2 then '/archive/2021/05/page/7' "
    "when 3 then '/archive/2021/05/page/001' when 4 then '/blog/post/comment-page-3' when 5 then '/a?sort=x' when 6 then '/a?a=1&b=2&c=3&d=4&e=5' when 7 then '/1/2/3/4/5/6/7/8/9' "
    "when 8 then '/amp/news/2024/x/?utm_source=f&b=2&a=1' when 9 then '/mobile/blog/y?page=33&ref=z#top' when 10 then '/tag/ai' when 11 then '/search?q=w' when 12 then '/' else '/amplifier/docs/x.xml' end)"
)


def select(exprs: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in exprs.items()) + f" FROM {table}"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*(f"{e} AS {c}" for c, e in LOG.items()))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*(f"{e} AS {c}" for c, e in ARTICLES.items()))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url): the pages' own URLs, and made ones that every URL rule meets."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", "url").union(p.selectExpr("page_id + 1000000000 AS page_id", f"{URLS} AS url"))


LOG_SQL, ARTICLES_SQL = select(LOG, "events"), select(ARTICLES, "orders")
URLS_SQL = f"SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000000, {URLS} FROM pages"
