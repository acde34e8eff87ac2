"""The crawl log as a stream: events, running statistics, rates by window, first sights of URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace import schemas
from millrace.operators import store


def read_log(spark: SparkSession, path: str, schema: str = schemas.CRAWL_LOG, files_at_once: int | None = None) -> DataFrame:
    """An append-only log folder as a stream; only new files are read."""
    r = spark.readStream.schema(schema)
    if files_at_once:
        r = r.option("maxFilesPerTrigger", files_at_once)
    return r.parquet(path)


def entries(log: DataFrame) -> DataFrame:
    """The log entries that an event stream shows."""
    return store.as_log_entry(log)


def counts(log: DataFrame) -> DataFrame:
    """Running counts by decision."""
    d = store.decision(F.col("blocked"), F.col("is_duplicate"), F.col("skip_reason"), F.col("extraction_ok"))
    return log.groupBy(d.alias("decision")).agg(F.count("*").alias("n"))


def rates(log: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by window of crawled_at and decision; rows later than `late` are dropped."""
    d = store.decision(F.col("blocked"), F.col("is_duplicate"), F.col("skip_reason"), F.col("extraction_ok")).alias("decision")
    w = F.window("crawled_at", window, slide) if slide else F.window("crawled_at", window)
    out = log.withWatermark("crawled_at", late).groupBy(w.alias("w"), d).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "decision", "n")


def sessions(log: DataFrame, host, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of crawling of a host."""
    out = log.withWatermark("crawled_at", late).groupBy(F.session_window("crawled_at", gap).alias("w"), host.alias("host")).agg(F.count("*").alias("n"))
    return out.select("host", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_sights(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Each URL once within the watermark."""
    return log.withWatermark("crawled_at", late).dropDuplicatesWithinWatermark(["url"])


def send(log: DataFrame, emit: Callable[[str, list[dict]], None], checkpoint: str, most: int = 1000) -> StreamingQuery:
    """Events of each micro-batch in order of id: ('log', rows), then ('stats', counts). The driver gets `most` rows at a time."""

    def batch(df: DataFrame, _: int) -> None:
        held: list[dict] = []
        for row in entries(df).orderBy("id").toLocalIterator(prefetchPartitions=False):
            held.append(row.asDict())
            if len(held) == most:
                emit("log", held)
                held = []
        if held:
            emit("log", held)
        emit("stats", [r.asDict() for r in counts(df).collect()])  # at most five rows

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frames(kind: str, rows: list[dict]) -> str:
    """Events in the wire form of server-sent events (K7)."""
    import json

    if kind == "close":
        return "event: close\ndata: {}\n\n"
    return "".join(f"data: {json.dumps({'type': kind, 'data': r}, default=str)}\n\n" for r in rows)
