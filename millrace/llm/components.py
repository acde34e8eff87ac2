"""Connected components of an edge table, by alternating large and small stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

MOST_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u goes to the smallest of u and its neighbours."""
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small(edges: DataFrame) -> DataFrame:
    """u > v in every edge. u and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) pairs of longs to (node, root): the smallest node reachable, for each node that an edge touches.

    Loops, repeated and reversed edges do no harm; no edges give no rows. Each round is written out, and
    all its aggregates combine on the map side; joins on a node of very many edges are split by adaptive skew handling.
    """
    now = scratch.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        stars = scratch.table(_small(_large(now).distinct()), "stars")
        after = _mark(stars)
        scratch.drop(now)
        now = stars
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
