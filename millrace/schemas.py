"""Schemas of the three tables of the store."""

FRONTIER = "id long, url string, depth int, status string, skip_reason string, created_at timestamp"
CRAWL_LOG = (
    "id long, url string, status string, blocked boolean, blocked_reason string, is_duplicate boolean, duplicate_reason string, skip_reason string, "
    "page_type string, quality_score double, html_quality string, extraction_ok boolean, elapsed_ms double, crawled_at timestamp"
)
FACTORS = "struct<completeness:double,cleanliness:double,usefulness:double,uniqueness:double,freshness:double>"
ARTICLES = (
    "id long, url string, canonical_url string, title string, author string, published_date string, language string, page_type string, main_content string, summary string, "
    f"headings array<string>, images array<string>, quality_score double, quality_factors {FACTORS}, quality_reasons array<string>, html_quality string, "
    "problems_detected array<string>, content_hash string, source_domain string, next_recrawl_at timestamp, crawled_at timestamp"
)
