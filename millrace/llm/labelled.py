"""The bounded sample of labelled documents that the classifiers are fitted on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bucket, texts

#: Longest text, in bytes, in the sample: with the number of rows this bounds what comes to the driver.
MOST_BYTES = 32 * 1024


def sample(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int]) -> tuple[pd.DataFrame, float]:
    """Rows (text, y) for fitting, and the share of label 1 among all rows that may be learnt from.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Of each label the `most` rows with the
    smallest hash of doc_id are taken; null labels and ids are left out, and of several labels of a document the largest holds.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).where(bucket() != 0)
    counted = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y]) for y in (0, 1)]
    chosen = parts[0].union(parts[1]).select(F.col("doc_id").alias("k"), "y")  # at most sum(most) rows
    rows = texts(docs).where(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).select("doc_id", "text", "y")
    got = rows.toPandas().sort_values(["doc_id", "text"]).drop_duplicates("text").reset_index(drop=True)
    return got, counted.get(1, 0) / max(1, sum(counted.values()))
