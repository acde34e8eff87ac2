"""Where rows come from: seeds, stored pages, tables, databases, the network."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.settings import DEFAULT


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a seed file, stripped; blank ones and those that start with # go. An indented # line stays."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    return lines.select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("url")).where("url != ''")


def seed_list(spark: SparkSession, given: list[str], most: int = DEFAULT.max_seeds) -> DataFrame:
    """Seeds of a request; none, or too many, is an error."""
    kept = [s.strip() for s in given if s.strip() and not s.startswith("#")]
    if not kept or len(kept) > most:
        raise ValueError(f"1 to {most} seeds are taken, not {len(kept)}")
    return spark.createDataFrame(list(enumerate(kept)), "seq long, url string")


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """HTML files as pages: name, url, html (S3)."""
    files = spark.read.text(f"{folder}/*.html", wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.html$", 1)
    return files.select(name.alias("name"), F.concat(F.lit("https://example.com/"), name).alias("url"), F.col("value").alias("html"))


def with_aliases(urls_: DataFrame, aliases: DataFrame) -> DataFrame:
    """URLs with the name of the stored page that stands for them, if any."""
    return urls_.join(aliases.select(F.col("url").alias("_u"), "name"), F.col("url") == F.col("_u"), "left").drop("_u")


def database_url(given: str) -> str:
    """A database address as JDBC has it; a bare path is a SQLite file."""
    if given.startswith("jdbc:"):
        return given
    m = re.fullmatch(r"(?:postgres|postgresql)(?:\+\w+)?://(.*)", given)
    if m:
        return f"jdbc:postgresql://{m[1]}"
    m = re.fullmatch(r"sqlite:(?://)?/?(.*)", given)
    return f"jdbc:sqlite:{m[1] if m else given}"


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    """A table of the store: a Parquet folder of the warehouse, or one of a database if `where` is an address."""
    if "://" in where and not re.match(r"(file|hdfs|s3a?|gs|abfss?|viewfs)://", where):
        return spark.read.format("jdbc").option("url", database_url(where)).option("dbtable", name).load()
    return spark.read.parquet(f"{where}/{name}.parquet")


class Fetch(DataSource):
    """`spark.read.format("millrace_fetch")`: URLs fetched politely, one partition a host.

    Options: urls (a line each), delay, timeout, retries, agent. Only timeouts are retried, with exponential
    backoff; any other failure is a row with its text in blocked_reason.
    """

    @classmethod
    def name(cls) -> str:
        return "millrace_fetch"

    def schema(self) -> str:
        return "url string, final_url string, status int, headers map<string,string>, html string, elapsed_ms double, blocked_reason string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Host(InputPartition):
    def __init__(self, host: str, urls_: list[str]):
        self.host, self.urls = host, urls_


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Host]:
        hosts: dict[str, list[str]] = {}
        for u in self.options.get("urls", "").splitlines():
            if u.strip():
                hosts.setdefault(u.strip().split("/")[2] if "://" in u else "", []).append(u.strip())
        return [_Host(h, us) for h, us in sorted(hosts.items())]

    def read(self, partition: _Host) -> Iterator[tuple]:
        import time
        import urllib.error
        import urllib.request

        o = self.options
        delay, timeout, retries = float(o.get("delay", DEFAULT.crawl_delay)), float(o.get("timeout", DEFAULT.request_timeout)), int(o.get("retries", DEFAULT.max_retries))
        for k, url in enumerate(partition.urls):
            if k:
                time.sleep(delay)
            began = time.time()
            row: tuple = (url, None, 0, {}, None, 0.0, "unknown")
            for attempt in range(retries + 1):
                try:
                    asked = urllib.request.Request(url, headers={"User-Agent": o.get("agent", "millrace/1"), "Accept": "text/html,application/xhtml+xml"})
                    with urllib.request.urlopen(asked, timeout=timeout) as r:
                        body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
                        row = (url, r.geturl(), r.status, {k.lower(): v for k, v in r.headers.items()}, body, (time.time() - began) * 1e3, None)
                    break
                except TimeoutError:
                    row = (url, None, 0, {}, None, (time.time() - began) * 1e3, "timeout")
                    if attempt < retries:
                        time.sleep(DEFAULT.backoff_base**attempt)
                except urllib.error.HTTPError as e:
                    row = (url, e.geturl(), e.code, {k.lower(): v for k, v in e.headers.items()}, e.read().decode("utf-8", "replace"), (time.time() - began) * 1e3, None)
                    break
                except (OSError, ValueError) as e:
                    row = (url, None, 0, {}, None, (time.time() - began) * 1e3, str(e))
                    break
            yield row


def robots(spark: SparkSession, hosts: list[str], **options) -> DataFrame:
    """(host, text) of the hosts' robots.txt; anything but a 200 is null, which allows all."""
    got = fetch(spark, [f"https://{h}/robots.txt" for h in hosts], **options)
    return got.select(F.get(F.split("url", "/"), F.lit(2)).alias("host"), F.when(F.col("status") == 200, F.col("html")).alias("text"))


def fetch(spark: SparkSession, urls_: list[str], **options) -> DataFrame:
    spark.dataSource.register(Fetch)
    return spark.read.format("millrace_fetch").options(urls="\n".join(urls_), **{k: str(v) for k, v in options.items()}).load()
