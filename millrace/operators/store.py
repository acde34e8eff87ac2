"""The store: upserts, appends and updates as joins, and reads as pushed-down filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators.tables import numbered


def upsert(table: DataFrame, rows: DataFrame, seq: str, key: str = "url", keep: tuple = ("id", "next_recrawl_at")) -> DataFrame:
    """The table with rows inserted or, where the key is there, all columns but `keep` replaced; the last of several rows of a key counts (K1)."""
    names = [c for c in rows.columns if c not in (key, seq, *keep)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names), seq).alias("_new"))
    held = table.join(last, key, "full")
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    fresh = numbered(held.where("id is null").drop("id"), key, "id", top + 1)
    out = held.where("id is not null").unionByName(fresh)
    return out.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns))


def insert_absent(table: DataFrame, rows: DataFrame, seq: str, key: str = "url") -> DataFrame:
    """Rows whose key is not in the table; of several rows of a key the first by `seq` (K2). Null keys count as one key that is never there."""
    names = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*names), seq).alias("_row"))
    return first.join(table.select(key), key, "left_anti").select(*(F.col(key) if c == key else F.col(f"_row.{c}") for c in rows.columns))


def log_status(status: Column, blocked: Column) -> Column:
    """The status as it is logged: 'blocked', else the number, else 'skipped' (K3)."""
    return F.when(F.coalesce(blocked, F.lit(False)), "blocked").otherwise(F.coalesce(status.cast("string"), F.lit("skipped")))


def set_recrawl(articles: DataFrame, times: DataFrame, seq: str = "seq") -> DataFrame:
    """Articles with next_recrawl_at from (url, next_at); of several times of a URL the last by `seq`."""
    last = times.groupBy("url").agg(F.max_by("next_at", seq).alias("_at"))
    held = articles.join(last, "url", "left")
    return held.withColumn("next_recrawl_at", F.coalesce("_at", "next_recrawl_at")).select(*articles.columns)


def search(articles: DataFrame, q: str | None = None, page_type: str | None = None, least_quality: float | None = None, sort: str = "quality", limit: int = 50, offset: int = 0) -> DataFrame:
    """Article search: any of title, text and URL like %q%, % and _ in q being wildcards; sorted, ties by id."""
    if not 1 <= limit <= 200 or offset < 0 or sort not in ("quality", "date"):
        raise ValueError("limit is 1 to 200, offset 0 or more, sort quality or date")
    out = articles
    if q:
        out = out.where(F.col("title").ilike(f"%{q}%") | F.col("main_content").ilike(f"%{q}%") | F.col("url").ilike(f"%{q}%"))
    if page_type:
        out = out.where(F.col("page_type") == page_type)
    if least_quality is not None:
        out = out.where(F.col("quality_score") >= least_quality)
    return out.orderBy(F.desc_nulls_last("quality_score" if sort == "quality" else "published_date"), "id").offset(offset).limit(limit)


def by_id(articles: DataFrame, id_: int) -> DataFrame:
    return articles.where(F.col("id") == id_)


def due(articles: DataFrame, as_of: Column) -> DataFrame:
    """URLs whose recrawl time has come."""
    return articles.where(F.col("next_recrawl_at").isNotNull() & (F.col("next_recrawl_at") <= as_of)).select("url")


def recrawl_time(articles: DataFrame, url: str) -> DataFrame:
    return articles.where(F.col("url") == url).select("next_recrawl_at")


def as_article(articles: DataFrame) -> DataFrame:
    """What the API shows of an article."""
    return articles.withColumns({"quality_score": F.coalesce("quality_score", F.lit(0.0)), "html_quality": F.coalesce("html_quality", F.lit("ok")), "is_duplicate": F.lit(False), "duplicate_of": F.lit(None).cast("string")})


def interchange(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows with some columns as JSON text, as the relational form of the store has lists and maps."""
    return df.withColumns({c: F.to_json(c) for c in names})


def from_interchange(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The rows with JSON text columns read as the given types; bad JSON is null."""
    return df.withColumns({c: F.from_json(c, k) for c, k in kinds.items()})


def without_body(fetched: DataFrame) -> DataFrame:
    """A fetch result as it is reported: no HTML, and the status 'blocked' where it was."""
    return fetched.drop("html").withColumn("status", log_status(F.col("status"), F.col("blocked")))


def decision(blocked: Column, duplicate: Column, skip_reason: Column, extracted: Column) -> Column:
    """blocked, duplicate, skipped, saved or error, in this order."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(blocked), "blocked").when(yes(duplicate), "duplicate").when(F.coalesce(skip_reason, F.lit("")) != "", "skipped").when(yes(extracted), "saved").otherwise("error")


def as_log_entry(log: DataFrame) -> DataFrame:
    """What the API shows of a log row; a status that is no number is 0."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    quality = F.when(F.col("quality_score").isNotNull(), F.format_string("quality %.2f", "quality_score"))
    return log.select(
        "id", "url", F.coalesce(F.col("status").try_cast("int"), F.lit(0)).alias("status"),
        decision(F.col("blocked"), F.col("is_duplicate"), F.col("skip_reason"), F.col("extraction_ok")).alias("decision"),
        F.coalesce(some("blocked_reason"), some("skip_reason"), some("duplicate_reason"), quality).alias("reason"), "elapsed_ms", "crawled_at",
    )


def tail(log: DataFrame, offset: int = 0) -> DataFrame:
    """Log rows in order of id from an offset (O3).

    An offset in a plan would bring all rows to one task. Here only the rows to be left out are looked for: all below the last of
    their ids go, and of those with that id so many as were among them; the rest is sorted in ranges.
    """
    if not offset:
        return log.orderBy("id")
    order = F.struct(F.col("id").isNotNull(), "id")  # nulls come first
    last = log.select(order.alias("at")).orderBy("at").limit(offset).groupBy("at").agg(F.count("*").alias("cut")).agg(F.max_by("cut", "at").alias("cut"), F.max("at").alias("last"))
    held = log.withColumn("_at", order).join(F.broadcast(last), F.col("_at") >= F.col("last"))
    edge = held.where("_at = last").withColumn("_r", F.row_number().over(W.partitionBy("_at").orderBy("_at"))).where("_r > cut")
    return held.where("_at > last").select(*log.columns).union(edge.select(*log.columns)).orderBy("id")


def tier(score: Column) -> Column:
    """Quality tier of the UI."""
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def initials(host: Column) -> Column:
    """Two letters for a host."""
    return F.upper(F.substring(F.split_part(F.regexp_replace(host, r"^www\.", ""), F.lit("."), F.lit(1)), 1, 2))


def domain_counts(articles: DataFrame) -> DataFrame:
    """Articles by source_domain."""
    return articles.where("source_domain is not null").groupBy("source_domain").agg(F.count("*").alias("n"))


def host_of(url: Column) -> Column:
    return urls.domain(url, "fixture")
