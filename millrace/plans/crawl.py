"""The whole curation plan over fetched pages, and rounds of a crawl over a table of stored pages."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators import dedup, frontier, pages, store
from millrace.operators.tables import Work, numbered
from millrace.settings import DEFAULT, Settings


def _judge(fetched: DataFrame, work: Work, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with trap and block, skipped pages with their reason, classified pages with facts, extracted pages) of fetched pages."""
    rows = fetched.select("seq", "url", "status", "headers", "html").withColumn("trap", urls.trap_reason(F.col("url"), settings))
    rows = rows.withColumn("block", pages.block(F.col("status"), F.col("headers"), F.col("html"), settings))
    rows = work.table(rows, "fetched")
    empty = F.coalesce(F.length("html"), F.lit(0)) == 0
    usable = rows.where("trap is null and not block.blocked").where(~empty)
    early = usable.where(urls.url_skip(F.col("url"), settings).isNotNull())
    parsed = pages.with_facts(usable.where(urls.url_skip(F.col("url"), settings).isNull()))
    classed = work.table(parsed.withColumn("cls", pages.classify(F.col("url"), F.col("facts"), settings)), "classified")
    content = classed.where("cls.is_content_page")
    extracted = work.table(pages.extract(content).drop("facts", "headers", "trap", "block", "status", "html"), "extracted")
    skip = lambda df, reason: df.select("seq", "url", "status", reason.alias("skip_reason"))
    said = (
        skip(rows.where("trap is not null"), F.col("trap"))
        .union(skip(rows.where("trap is null and not block.blocked").where(empty), F.lit("no_html")))
        .union(skip(early, urls.url_skip(F.col("url"), settings)["reason"]))
        .union(skip(classed.where("not cls.is_content_page"), F.col("cls.skip_reason")))
    )
    return rows, said, classed, extracted


def _settle(extracted: DataFrame, work: Work, as_of: Column, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(duplicate marks, articles) of extracted pages. Texts are compared once; uniqueness counts kept pages alone."""
    members, links = dedup.similar_sets(extracted.where(F.length("main_content") > 0), "seq", "main_content", work, settings)
    marks = work.table(dedup.resolve(extracted.select("seq", "url", "canonical_url", "title", "main_content"), work, settings, (members, links)), "duplicates")
    kept = marks.where("not is_duplicate").select("seq")
    similar = dedup.max_similarity(members.join(kept.withColumnRenamed("seq", "id"), "id", "left_semi"), links).withColumnRenamed("id", "seq")
    fresh = extracted.join(kept, "seq", "left_semi").join(similar, "seq", "left")
    return marks, work.table(pages.quality(fresh, as_of, F.col("max_similarity"), settings).withColumn("crawled_at", as_of), "articles")


def curate(fetched: DataFrame, work: Work, as_of: Column, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(articles, log) from pages (seq, url, status, headers, html): trap, block, classify, extract, deduplicate, score.

    Cheap rules on URL and status come first, so only the pages that pass them are parsed, once. Duplicates are
    found in order of seq.
    """
    rows, said, _, extracted = _judge(fetched, work, settings)
    marks, articles = _settle(extracted, work, as_of, settings)
    none = lambda kind="string": F.lit(None).cast(kind)
    log = said.select("seq", "url", store.log_status(F.col("status"), F.lit(False)).alias("status"), F.lit(False).alias("blocked"), none().alias("blocked_reason"), F.lit(False).alias("is_duplicate"), none().alias("duplicate_reason"), "skip_reason", none("boolean").alias("extraction_ok"))
    stopped = rows.where("trap is null and block.blocked")
    log = log.union(stopped.select("seq", "url", F.lit("blocked"), F.lit(True), F.col("block.reason"), F.lit(False), none(), none(), none("boolean")))
    done = extracted.select("seq", "url", "main_content").join(marks, "seq").join(rows.select("seq", "status"), "seq")
    log = log.union(done.select("seq", "url", store.log_status(F.col("status"), F.lit(False)), F.lit(False), none(), "is_duplicate", "duplicate_reason", none(), F.length("main_content") > 0))
    return articles, log.withColumn("decision", store.decision(F.col("blocked"), F.col("is_duplicate"), F.col("skip_reason"), F.col("extraction_ok")))


@dataclass
class Job:
    """State of a crawl job on the driver."""

    seeds: list[str]
    id: str = field(default_factory=lambda: str(uuid.uuid4())[:8])
    status: str = "queued"
    started_at: datetime | None = None
    finished_at: datetime | None = None
    error: str | None = None

    def run(self, work) -> None:
        self.status, self.started_at = "running", datetime.now(timezone.utc)
        try:
            work(self)
            self.status = "done"
        except Exception as e:
            self.status, self.error = "error", str(e)
            raise
        finally:
            self.finished_at = datetime.now(timezone.utc)


def crawl(spark: SparkSession, seeds_: DataFrame, stored: DataFrame, work: Work, max_depth: int = 2, settings: Settings = DEFAULT, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(frontier, articles): a crawl in rounds, a level of depth each, over stored pages (url, html; status and headers if there are) that stand for the network.

    The frontier is (url, depth, status, skip_reason). By outcome a page is done (saved), blocked, or skipped with its
    reason; pages without html and duplicates stay in_progress. Links are taken from saved pages, and the budget of a domain counts its saved pages.
    A page is parsed in its own round and compared with the kept pages of all rounds, in order of arrival; in a round that is the order of URLs' hashes.
    All state is written, so a lost executor costs one round at most.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    kind = dict(stored.dtypes)
    status = F.col("status").cast("int") if "status" in kind else F.when(F.col("html").isNotNull(), 200).otherwise(0)
    headers = F.col("headers") if "headers" in kind else F.lit(None).cast("map<string,string>")
    network = stored.select("url", status.alias("status"), headers.alias("headers"), "html")
    known = work.table(spark.createDataFrame([], "url string, depth int, status string, skip_reason string"), "known")
    saved = spark.createDataFrame([], "domain string, n long")
    candidates = seeds_.select("seq", "url", F.lit(0).alias("depth"))
    extracted = articles = None
    arrived = 0
    for depth in range(max_depth + 1):
        admitted = work.table(frontier.enqueue(candidates, known, saved, settings).withColumn("depth", F.col("depth").cast("int")), "admitted")
        taken = work.table(numbered(admitted.where("status = 'queued'").select("url"), "url", "seq", arrived), "taken")
        count = taken.count()
        if articles is not None and not count:
            known = work.table(known.unionByName(admitted), "known")
            break
        arrived += count
        rows, said, classed, fresh = _judge(taken.join(network.dropDuplicates(["url"]), "url", "left"), work, settings)
        extracted = fresh if extracted is None else work.table(extracted.unionByName(fresh), "extracted")
        _, articles = _settle(extracted, work, as_of, settings)
        mine = articles.join(taken.select("seq"), "seq", "left_semi")
        outcome = taken.select("seq", "url", F.lit("in_progress").alias("status"), F.lit(None).cast("string").alias("skip_reason"), F.lit(0).alias("turn"))
        outcome = outcome.union(said.where("skip_reason != 'no_html'").select("seq", "url", F.lit("skipped"), "skip_reason", F.lit(1)))
        outcome = outcome.union(rows.where("trap is null and block.blocked").select("seq", "url", F.lit("blocked"), F.lit(None).cast("string"), F.lit(1)))
        outcome = outcome.union(mine.select("seq", "url", F.lit("done"), F.lit(None).cast("string"), F.lit(1)))
        known = work.table(frontier.mark(known.unionByName(admitted), outcome, "turn"), "known")
        if depth == max_depth:
            break
        found = classed.join(mine.select("seq", "main_content"), "seq").withColumn("depth", F.lit(depth))
        linked = pages.same_site_links(found, max_depth)
        candidates = work.table(linked.select(F.xxhash64("url").alias("seq"), "url", "depth"), "links")
        counted = known.where("status = 'done'").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
        saved = work.table(counted, "saved")
    return known, articles
