"""The crawl frontier: admission, order, politeness, robots rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.ship import ship
from millrace.operators.tables import ranks
from millrace.settings import DEFAULT, Settings


def enqueue(candidates: DataFrame, known: DataFrame, saved: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(url, depth, status, skip_reason) for candidates (seq, url, depth) not yet known (url), against saved counts (domain, n).

    Of repeated URLs the first counts (J1, J2, R1, R4). The counts are one row a domain; a join on them stays
    as the planner sees fit.
    """
    fresh = candidates.join(known.select("url").distinct(), "url", "left_anti")
    one = fresh.groupBy("url").agg(F.min_by("depth", "seq").alias("depth")).withColumn("domain", urls.domain(F.col("url")))
    full = F.coalesce(F.col("n"), F.lit(0)) >= settings.domain_budget
    held = one.join(saved, "domain", "left")
    return held.select("url", "depth", F.when(full, "skipped").otherwise("queued").alias("status"), F.when(full, "domain_budget_exceeded").alias("skip_reason"))


def next_level(frontier: DataFrame) -> DataFrame:
    """Queued URLs, deepest first, then by id: the order in which they are taken."""
    return frontier.where("status = 'queued'").orderBy(F.desc("depth"), "id")


def mark(frontier: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """The frontier with updates (url, status, skip_reason) applied in order of `seq`: the last status and the last skip_reason that is not null count."""
    reason = F.max_by("skip_reason", F.when(F.col("skip_reason").isNotNull(), F.col(seq)))
    new = updates.groupBy("url").agg(F.max_by("status", seq).alias("_status"), reason.alias("_skip"))
    held = frontier.join(new, "url", "left")
    return held.withColumn("status", F.coalesce("_status", "status")).withColumn("skip_reason", F.coalesce("_skip", "skip_reason")).drop("_status", "_skip").select(*frontier.columns)


def slots(urls_: DataFrame, robots: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """When each URL (seq, url) may be fetched, in seconds after the start: one at a time a host, a delay apart."""
    rows = urls_.withColumn("host", urls.netloc(F.col("url")))
    delay = F.lit(settings.crawl_delay)
    if robots is not None:
        rows = rows.join(robots.select("host", "crawl_delay"), "host", "left")
        delay = F.coalesce("crawl_delay", F.lit(settings.crawl_delay))
    rows = ranks(rows.withColumn("delay", delay), "host", "seq", "turn")
    return rows.select("seq", "url", "host", ((F.col("turn") - 1) * F.col("delay")).alias("not_before"))


def parse_robots(text: str | None, agent: str) -> tuple[list[tuple[bool, str]], float | None]:
    """(allow, path) rules and the delay for an agent, by RFC 9309: the groups that name it, else those of *."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    delays: dict[str, float] = {}
    agents: list[str] = []
    ruled = False
    for line in (text or "").splitlines():
        name, _, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if ruled:
                agents, ruled = [], False
            agents.append(value.lower())
            groups.setdefault(value.lower(), [])
        elif name in ("allow", "disallow"):
            ruled = True
            for a in agents:
                if value:
                    groups[a].append((name == "allow", value))
        elif name == "crawl-delay":
            ruled = True
            for a in agents:
                try:
                    delays[a] = float(value)
                except ValueError:
                    pass
    mine = next((a for a in groups if a != "*" and a in agent.lower()), "*")
    return groups.get(mine, []), delays.get(mine, delays.get("*"))


def robots_allow(text: str | None, agent: str, path: str) -> bool:
    """The longest rule that matches decides, allow before disallow; none allows."""
    import re

    best = (-1, True)
    for allow, rule in parse_robots(text, agent)[0]:
        pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.rstrip("$")) + ("$" if rule.endswith("$") else "")
        if re.match(pattern, path):
            best = max(best, (len(rule), allow))
    return best[1]


def allowed(urls_: DataFrame, robots: DataFrame, agent: str = "millrace") -> DataFrame:
    """The URLs with `allowed` and `crawl_delay`, by robots (host, text); a host without robots.txt allows all."""

    @F.pandas_udf("struct<allowed:boolean,crawl_delay:double>")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, path in parts:
            yield pd.DataFrame([(robots_allow(t, agent, p or "/"), parse_robots(t, agent)[1]) for t, p in zip(text, path, strict=True)], columns=["allowed", "crawl_delay"])

    ship(urls_.sparkSession.sparkContext)
    rows = urls_.withColumn("host", urls.netloc(F.col("url"))).join(robots.select("host", F.col("text").alias("_robots")), "host", "left")
    target = F.concat(urls.path(F.col("url")), F.when(urls.query(F.col("url")) != "", F.concat(F.lit("?"), urls.query(F.col("url")))).otherwise(""))
    return rows.withColumn("_j", judge("_robots", target)).select(*urls_.columns, "host", "_j.allowed", "_j.crawl_delay")
