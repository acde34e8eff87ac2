"""Page operators on (url, html) or on the facts of a page: blocks, thin pages, classification, extraction, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates, text, urls
from millrace.functions.html import compared_facts, html_facts
from millrace.settings import DEFAULT, Settings


def with_facts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The pages with a struct column `facts`; parsed once, and after any filter on other columns."""
    return pages.withColumn("facts", html_facts(F.col(html), F.col(url)))


def _any(body: Column, markers: tuple) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(body, F.lit(m))
    return found


def block(status: Column, headers: Column, body: Column, settings: Settings = DEFAULT) -> Column:
    """(blocked, reason, should_retry) of a response; headers: map of strings."""
    low = F.lower(F.coalesce(body, F.lit("")))
    words = text.word_count(low)
    said = F.lower(F.coalesce(F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " "), F.lit("")))
    cloud = _any(low, settings.cloudflare_markers)
    reason = (
        F.when(status.isin(403, 429, 503), F.concat(F.lit("http_"), status.cast("string")))
        .when((F.contains(said, F.lit("cf-ray")) | F.contains(said, F.lit("cloudflare"))) & cloud, "cloudflare_challenge")
        .when(cloud, "cloudflare_detected")
        .when(_any(low, settings.captcha_markers) & (words <= 500), "captcha_detected")
        .when(_any(low, settings.bot_markers) & (words <= 1000), "generic_bot_detected")
    )
    return F.struct(reason.isNotNull().alias("blocked"), reason.alias("reason"), (F.coalesce(status == 429, F.lit(False))).alias("should_retry"))


def thin(facts: Column) -> Column:
    """Under 50 visible words and three scripts or more."""
    return (text.word_count(facts["visible_text"]) < 50) & (facts["n_scripts"] >= 3)


def classify(url: Column, facts: Column, settings: Settings = DEFAULT) -> Column:
    """(page_type, is_content_page, confidence, raw_score, skip_reason). Doubles are added in the order of the rules."""
    early = urls.url_skip(url, settings)
    boost = urls.url_boost(url, settings)
    words = text.word_count(facts["visible_text"])
    add = lambda score, test, d: score + F.when(F.coalesce(test, F.lit(False)), d).otherwise(0.0)
    score = add(F.lit(0.0), boost.isNotNull(), 0.25)
    kind = F.coalesce(boost, F.lit("other"))
    other = lambda k, test, to: F.when((k == "other") & F.coalesce(test, F.lit(False)), to).otherwise(k)
    score = add(score, facts["has_article"], 0.20)
    kind = other(kind, facts["has_article"], "news_article")
    score = add(score, facts["has_main"], 0.10)
    typed = F.contains(F.lower(F.coalesce(facts["og_type"], F.lit(""))), F.lit("article"))
    score = add(score, typed, 0.20)
    kind = F.when(typed, "news_article").otherwise(kind)
    schema = F.lit(None).cast("string")
    for key, to in reversed(settings.schema_types):
        schema = F.when(F.contains(facts["itemtype"], F.lit(key)), to).otherwise(schema)
    score = add(score, schema.isNotNull(), 0.25)
    kind = F.coalesce(schema, kind)
    hits = F.flatten(F.transform(facts["jsonld"], lambda s: F.array_compact(F.array(*(F.when(F.contains(s, F.lit(key)), to) for key, to in settings.schema_types)))))
    score = F.aggregate(hits, score, lambda a, _: a + 0.20)
    kind = other(kind, F.size(hits) > 0, F.get(hits, F.lit(0)))
    score = score + F.when(words >= settings.min_article_words, 0.15).when(words < 100, -0.25).otherwise(0.0)
    ratio = F.greatest(F.length(facts["visible_text"]), F.lit(1)) / F.greatest(facts["link_text_len"], F.lit(1))
    score = add(score, (facts["n_links"] > 0) & (ratio > 3), 0.10)
    score = add(score, facts["n_links"] > settings.high_link_count, -0.20)
    score = add(score, facts["has_author_mark"], 0.10)
    score = add(score, facts["has_date_mark"], 0.10)
    learned = (kind == "other") & (words > 800) & (F.size(facts["headings"]) >= 3)
    score = add(score, learned, 0.10)
    kind = F.when(learned, "educational").otherwise(kind)
    content = score >= settings.content_threshold
    return F.when(
        early.isNotNull(),
        F.struct(F.lit("other").alias("page_type"), F.lit(False).alias("is_content_page"), early["confidence"].alias("confidence"), F.lit(None).cast("double").alias("raw_score"), early["reason"].alias("skip_reason")),
    ).otherwise(
        F.struct(kind.alias("page_type"), content.alias("is_content_page"), F.bround(text.clamp(score), 2).alias("confidence"), score.alias("raw_score"), F.when(~content, "low_confidence").alias("skip_reason"))
    )


def broken_html(html: Column) -> Column:
    """Opening and closing tags differ by more than five; a tag with a slash in an attribute is not counted."""
    return F.abs(F.regexp_count(html, F.lit("<[a-zA-Z][^/>]*>")) - F.regexp_count(html, F.lit("</[a-zA-Z][^>]*>"))) > 5


def strip_noise(body: Column, noise: Column) -> Column:
    """Each noise text shorter than 30 % of what is left is removed wherever it stands, in order."""
    cut = F.aggregate(noise, body, lambda t, n: F.when(F.length(n) < F.length(t) * 0.3, F.replace(t, n, F.lit(""))).otherwise(t))
    return text.collapse(cut)


def images(facts: Column, settings: Settings = DEFAULT) -> Column:
    """At most ten image URLs: that of og:image, then those of the article that are neither small nor decoration."""
    number = lambda s: F.when(s.rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(s).cast("int"))
    small = lambda i: (F.coalesce(i["width"], F.lit("")) != "") & (F.coalesce(i["height"], F.lit("")) != "") & F.coalesce(number(i["width"]).isNotNull() & ((number(i["width"]) < 100) | (number(i["height"]) < 100)), F.lit(False))
    good = F.filter(facts["images"], lambda i: ~small(i) & ~i["cls"].rlike("|".join(settings.image_class_words)))
    return F.slice(F.array_distinct(F.concat(F.array_compact(F.array(facts["og_image"])), F.transform(good, lambda i: i["url"]))), 1, 10)


def _title(f: Column) -> Column:
    return F.coalesce(F.nullif(f["article_h1"], F.lit("")), F.when(f["has_og_title"], f["og_title"]).otherwise(F.coalesce(f["h1"], f["title"])))


def _canonical(f: Column) -> Column:
    return F.coalesce(F.nullif(f["canonical"], F.lit("")), F.col("url"))


def compared(pages: DataFrame, *keep: str) -> DataFrame:
    """The fields of `extract` that duplicates are told by (url, canonical_url, title, main_content), of pages (url, html), with other columns to keep."""
    f = F.col("facts")
    rows = pages.withColumn("facts", compared_facts(F.col("html"), F.col("url")))
    return rows.select(*keep, "url", _canonical(f).alias("canonical_url"), _title(f).alias("title"), f["main_content"].alias("main_content"))


def extract(pages: DataFrame) -> DataFrame:
    """Article fields of pages with `facts` and `cls` columns."""
    f = F.col("facts")
    body, title = f["main_content"], _title(f)
    cookie = F.contains(F.lower("html"), F.lit("cookie")) | f["has_cookie_class"]
    said = lambda test, name: F.when(test, name)
    missing = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    problems = F.array_compact(
        F.array(
            said(~f["from_article"], "used_fallback_extractor"),
            said(body.isNull(), "empty_body"),
            said(missing(f["author"]), "missing_author"),
            said(missing(f["date"]), "missing_date"),
            said(~f["has_article"] & ~f["has_main"], "large_navigation_noise"),
            said(broken_html(F.col("html")), "broken_html"),
            said(cookie, "cookie_banner_removed"),
        )
    )
    out = pages.withColumn("main_content", body).withColumn("problems_detected", problems)
    return out.select(
        *pages.columns,
        _canonical(f).alias("canonical_url"),
        title.alias("title"),
        f["author"].alias("author"),
        f["date"].alias("published_date"),
        F.coalesce(f["language"], text.language(F.col("main_content")), F.lit("en")).alias("language"),
        "main_content",
        F.when(F.length("main_content") > 0, text.summary(F.col("main_content"))).alias("summary"),
        F.filter(f["headings"], lambda h: h != "").alias("headings"),
        images(f).alias("images"),
        F.col("cls.page_type").alias("page_type"),
        F.when(F.size("problems_detected") >= 2, "messy").otherwise("ok").alias("html_quality"),
        "problems_detected",
        text.content_hash(F.col("main_content")).alias("content_hash"),
        urls.netloc(F.col("url")).alias("source_domain"),
    )


def same_site_links(pages: DataFrame, max_depth: int, depth: str = "depth") -> DataFrame:
    """(url, depth) of links to the same host, for pages above the depth limit that have a body."""
    open_ = pages.where((F.col(depth) < max_depth) & (F.length("main_content") > 0))
    rows = open_.select(F.col("url").alias("base"), (F.col(depth) + 1).alias("depth"), F.explode("facts.links").alias("url"))
    return rows.where(urls.netloc(F.col("url")) == urls.netloc(F.col("base"))).select("url", "depth").distinct()


def quality(article: DataFrame, as_of: Column, similarity: Column | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The articles with quality_factors, raw_quality, quality_score and quality_reasons, from columns of `extract`."""
    words = text.word_count(F.col("main_content"))
    filled = lambda c: F.when(F.length(F.col(c)) > 0, 1.0).otherwise(0.0)
    least = settings.min_article_words
    complete = (filled("title") + filled("author") + filled("published_date") + F.when(words >= least // 2, 1.0).otherwise(0.0) + F.when(F.size("headings") > 0, 1.0).otherwise(0.0)) / 5.0
    clean = F.aggregate("problems_detected", F.lit(1.0), lambda a, _: a - 0.08) - F.when(F.col("html_quality") == "messy", 0.15).otherwise(0.0)
    clean = text.clamp(F.when(words > 0, clean * (0.5 + 0.5 * F.least(words / float(least), F.lit(1.0)))).otherwise(clean))
    useful = F.least(F.lit(1.0), F.least(words / 1000.0, F.lit(1.0)) * 0.6 + F.least(F.size("headings") / 5.0, F.lit(1.0)) * 0.2 + F.least(text.paragraphs(F.col("main_content")) / 10.0, F.lit(1.0)) * 0.2)
    useful = F.when(F.length("main_content") > 0, useful).otherwise(0.0)
    unique = 1.0 - F.coalesce(similarity if similarity is not None else F.lit(0.0), F.lit(0.0))
    fresh = dates.freshness(F.col("published_date"), as_of)
    factors = {"completeness": complete, "cleanliness": clean, "usefulness": useful, "uniqueness": unique, "freshness": fresh}
    out = article.withColumn("_f", F.struct(*(v.alias(k) for k, v in factors.items())))
    total = F.lit(0.0)
    for k in factors:
        total = total + F.lit(settings.weights[k]) * F.col("_f")[k]
    reasons = [("completeness", 0.6, "missing author/date or short body"), ("cleanliness", 0.6, "noisy HTML / boilerplate detected"), ("freshness", 0.3, "stale or undated"), ("uniqueness", 0.5, "overlaps existing content"), ("usefulness", 0.5, "thin or poorly structured content")]
    said = F.array_compact(F.array(*(F.when(F.col("_f")[k] < most, name) for k, most, name in reasons)))
    rounded = F.struct(*(F.bround(F.col("_f")[k], 2).alias(k) for k in factors))
    return out.withColumn("raw_quality", total).withColumn("quality_score", F.bround(total, 2)).withColumn("quality_factors", rounded).withColumn("quality_reasons", said).drop("_f")
