"""Written intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Work:
    """Tables that cut lineage: what a lost executor held is read again, not computed again."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, path, True)
            root = f"file://{path}"
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root, self.used = spark, f"{root.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.used += 1
        path = f"{self.root}/{self.used:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str, name: str, start: int = 0, buckets: int = 4096) -> DataFrame:
    """The rows with consecutive numbers, fixed by the (distinct) key: ranks in hash buckets and a running count over the buckets, so no task sees all rows."""
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    order = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # over at most `buckets` rows
    before = dealt.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(key)))
    return ranked.join(before, "_b").withColumn(name, F.col("_r") + F.col("_before") + (start - 1)).drop("_b", "_r", "_before")


def ranks(df: DataFrame, key: str, order: str, name: str, buckets: int = 256) -> DataFrame:
    """row_number over (key, order) for a numeric order, with each key split into ranges of the order: a key of very many rows is not sorted in one task."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    low, width = float(ends["lo"] or 0), float((ends["hi"] or 0) - (ends["lo"] or 0)) + 1.0
    dealt = df.withColumn("_b", F.floor((F.col(order).cast("double") - low) * buckets / width).cast("int"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # at most `buckets` rows a key
    counted = dealt.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    sums = counted.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_r", F.row_number().over(W.partitionBy(key, "_b").orderBy(order)))
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c"))
    return ranked.join(sums, same).withColumn(name, F.col("_r") + F.col("_before")).drop("_b", "_r", "_k", "_c", "_before")
