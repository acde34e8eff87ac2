"""Fixed rules of the curation engine, in one frozen place; values go into plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, field


# Thresholds, weights and word lists that results depend on.
@dataclass(frozen=True)
class Settings:
    crawl_delay: float = 1.5
    concurrency: int = 8
    request_timeout: int = 15
    max_retries: int = 3
    backoff_base: float = 1.5
    content_threshold: float = 0.40
    min_article_words: int = 250
    high_link_count: int = 100
    max_pagination: int = 20
    max_query_params: int = 4
    max_path_depth: int = 8
    domain_budget: int = 500
    near_dup_jaccard: float = 0.85
    title_similarity: float = 0.90
    shingle_words: int = 5
    minhash_permutations: int = 128
    minhash_bands: int = 8
    max_seeds: int = 30
    min_ttl_hours: int = 6
    max_ttl_hours: int = 720
    ttl_hours: dict = field(default_factory=lambda: {"news_article": 24, "blog_post": 72, "wiki": 168, "educational": 168, "financial": 48, "other": 96})
    weights: dict = field(default_factory=lambda: {"completeness": 0.30, "cleanliness": 0.25, "usefulness": 0.20, "uniqueness": 0.15, "freshness": 0.10})
    tracking_params: tuple = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "gclid", "fbclid")
    path_prefixes: tuple = ("/amp", "/mobile", "/print")
    filter_params: tuple = ("sort", "order", "filter", "facet", "orderby", "sortby")
    skip_url_rules: tuple = (
        ("/tag/", "tag_page"), ("/category/", "category_page"), ("/search", "search_page"), (r"\?q=", "search_page"), ("/login", "login_page"),
        ("/author/", "author_page"), (r"/page/\d+", "pagination_page"), ("/archive/", "archive_page"), ("/feed", "feed_page"), (r"\.xml$", "feed_page"),
    )
    boost_url_rules: tuple = (
        ("/news/", "news_article"), ("/blog/", "blog_post"), ("/article/", "news_article"), ("/post/", "blog_post"),
        ("/story/", "news_article"), ("/wiki/", "wiki"), ("/docs/", "wiki"), (r"/\d{4}/\d{2}/", "news_article"),
    )
    schema_types: tuple = (("NewsArticle", "news_article"), ("Article", "news_article"), ("BlogPosting", "blog_post"), ("ScholarlyArticle", "educational"), ("TechArticle", "educational"))
    cloudflare_markers: tuple = ("just a moment", "checking your browser", "cf-browser-verification", "cf-challenge")
    captcha_markers: tuple = ("g-recaptcha", "hcaptcha", "cf-turnstile", "captcha-checkbox", "verify you are human", "are you a robot")
    bot_markers: tuple = ("access denied", "unusual traffic", "request blocked", "rate limited")
    noise_tags: tuple = ("nav", "footer", "header")
    noise_classes: tuple = ("cookie", "newsletter", "popup", "ad", "ads", "advertisement", "social-share", "comments", "related-articles", "sidebar")
    noise_ids: tuple = ("comments",)
    image_class_words: tuple = ("icon", "logo", "avatar", "pixel", "tracking")


DEFAULT = Settings()
