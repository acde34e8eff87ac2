"""Crawl statistics: one pass over each table, with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls


def _yes(name: str):
    return F.coalesce(F.col(name), F.lit(False))


def _skipped():
    return F.coalesce(F.col("skip_reason"), F.lit("")) != ""


def totals(log: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: the counts and rates of a crawl."""
    good = ~_yes("blocked") & ~_yes("is_duplicate") & ~_skipped() & _yes("extraction_ok")
    tried = F.col("extraction_ok").isNotNull()
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    from_log = log.agg(
        F.count("*").alias("total_attempted"),
        F.count_if(_yes("blocked")).alias("blocked_count"),
        F.count_if(_yes("is_duplicate")).alias("duplicates_removed"),
        F.count_if(_skipped()).alias("traps_skipped"),
        rate(F.count_if(good), F.count("*")).alias("crawl_success_rate"),
        rate(F.count_if(tried & F.col("extraction_ok")), F.count_if(tried)).alias("extraction_success_rate"),
    )
    scored = F.nullif("quality_score", F.lit(0.0))
    from_articles = articles.agg(
        F.count("*").alias("articles_saved"),
        F.count_if(F.col("html_quality") == "messy").alias("messy_html_count"),
        F.coalesce(F.avg(scored), F.lit(0.0)).alias("avg_quality"),
    )
    one = F.lit(1).alias("_one")  # a row each
    return from_log.select(one, "*").join(from_articles.select(one, "*"), "_one").drop("_one")


def reasons(log: DataFrame, kind: str) -> DataFrame:
    """(reason, n) of blocked, skip or duplicate rows, most frequent first; no reason is 'unknown' (A10, O4)."""
    test = {"blocked": _yes("blocked"), "skip": _skipped(), "duplicate": _yes("is_duplicate")}[kind]
    name = F.coalesce(F.nullif(F.col(f"{kind}_reason"), F.lit("")), F.lit("unknown")).alias("reason")
    return log.where(test).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def per_domain(log: DataFrame, articles: DataFrame) -> DataFrame:
    """(domain, attempted, blocked, saved), by name (A11, J8): both tables are aggregated before they meet."""
    tried = log.groupBy(urls.domain(F.col("url"), "fixture").alias("domain")).agg(F.count("*").alias("attempted"), F.count_if(_yes("blocked")).alias("blocked"))
    host = F.coalesce(F.nullif("source_domain", F.lit("")), urls.domain(F.col("url"), "fixture"))
    saved = articles.groupBy(host.alias("domain")).agg(F.count("*").alias("saved"))
    zero = F.lit(0).cast("long")
    rows = tried.withColumn("saved", zero).unionByName(saved.withColumns({"attempted": zero, "blocked": zero}))
    return rows.groupBy("domain").agg(F.sum("attempted").alias("attempted"), F.sum("blocked").alias("blocked"), F.sum("saved").alias("saved")).orderBy("domain")


def outcomes(totals_: DataFrame) -> DataFrame:
    """(outcome, n) of the outcome chart, zeros left out."""
    rows = totals_.select(F.expr("stack(4, 'saved', articles_saved, 'blocked', blocked_count, 'duplicate', duplicates_removed, 'skipped', traps_skipped) as (outcome, n)"))
    return rows.where("n > 0")


def contract(totals_: DataFrame) -> DataFrame:
    """The totals under the names of the API (P10)."""
    return totals_.select(
        F.col("total_attempted").alias("attempted"), F.col("articles_saved").alias("saved"), F.col("blocked_count").alias("blocked"), F.col("duplicates_removed").alias("duplicates"),
        F.col("traps_skipped").alias("skipped"), F.col("crawl_success_rate").alias("success_rate"), "avg_quality",
    )


def by_outcome_and_domain(log: DataFrame) -> DataFrame:
    """Counts for each decision and domain with subtotals."""
    from millrace.operators.store import decision

    rows = log.select(decision(F.col("blocked"), F.col("is_duplicate"), F.col("skip_reason"), F.col("extraction_ok")).alias("decision"), urls.domain(F.col("url"), "fixture").alias("domain"))
    return rows.rollup("decision", "domain").agg(F.count("*").alias("n"))


def report_lines(reasons_: DataFrame, width: int = 60) -> DataFrame:
    """Reasons as the console report shows them, labels cut to the width."""
    return reasons_.select(F.substring("reason", 1, width).alias("reason"), "n")
