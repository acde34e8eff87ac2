"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Every bit of a fingerprint gets a nonzero vector of radius + 1 bits; for each of the 2^(radius+1) - 1
nonzero vectors v there is a table whose mask keeps the bits whose vector has an odd inner product with v.
Two fingerprints that differ in at most `radius` bits leave some v orthogonal to all differing bits, so
they agree under that table's mask: every such pair meets, with certainty.

Distinct fingerprints alone are hashed, so that exact copies cost one row. In a table's bucket of few
fingerprints the pairs are compared directly. Fingerprints in larger buckets are linked through the
points at distance 0 or 1 around them: two are within distance 2 if and only if they share such a
point, and no point has more than 65, so no group is large and no link is lost.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; a text of one
or two words is one shingle; repeated rows share a fingerprint; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, ship, texts
from millrace.llm.components import components

RADIUS = 2
WORDS = 3
SEED = 42
#: Up to so many fingerprints of a bucket are compared pair by pair.
PAIRED = 32


def fingerprint(text: bytes, words: int = WORDS) -> int:
    w = text.lower().split()  # bytes: A-Z alone change case; space and \t\n\v\f\r divide
    if not w:
        return 0
    shingles = [b" ".join(x) for x in zip(*(w[i:] for i in range(words)), strict=False)] or [b" ".join(w)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, len(shingles))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(h)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        found = [fingerprint(column[i].as_buffer().to_pybytes()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), batch.column(2)], names=["doc_id", "fp", "tid"])


def _tid(text: str = "text") -> Column:
    """A hash of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long), tid (a hash of the text, which tells apart rows of one doc_id)."""
    ship(docs.sparkSession)
    return texts(docs, key, text).withColumn("tid", _tid()).mapInArrow(_fingerprints, "doc_id long, fp long, tid long")


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks. Bits take the nonzero vectors in turn, so the masks are equally wide."""
    n = 1 << radius + 1
    vector = [1 + i % (n - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect all of the distinct fingerprints `fp` within the radius (2)."""
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("k")) for i, m in enumerate(masks())))).alias("b")).select("fp", "b.t", "b.k")
    met = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.table(keyed.join(met, ["t", "k"]), "buckets")
    few = members.where(F.col("n") <= PAIRED)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    pairs = few.select("t", "k", F.col("fp").alias("u")).join(few.select("t", "k", F.col("fp").alias("v")), ["t", "k"]).where("u > v").where(near).select("u", "v")
    crowded = members.where(F.col("n") > PAIRED).select("fp").distinct()
    around: list[Column] = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_long(1 << i))) for i in range(64))]
    points = crowded.select("fp", F.explode(F.array(*around)).alias("p"))
    balls = points.groupBy("p").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return pairs.union(balls.select(F.explode("all").alias("u"), "v").where("u != v")).distinct()


def _members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, tid, fp, component_id, a row for each row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table(fingerprints(docs, key, text), "fingerprints")
    distinct = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct.select("fp"), scratch), scratch)
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(named, "root").select(F.col("fp").alias("of"), "component_id")
    return marked.join(of, F.col("fp") == F.col("of"), "left").select("doc_id", "tid", "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable over links."""
    return _members(docs, key, text).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that have a smaller doc_id in their component; of equal (doc_id, text) one stays.

    Rows of one doc_id with different texts are judged each by its own component. Rows without a doc_id all stay, but one of
    equal texts, as nothing says which of them is first.
    """
    scratch = Scratch(docs.sparkSession, "simhash-kept")
    kept = _members(docs, "doc_id", "text").where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id"), F.col("tid").alias("_kept_tid")).distinct()
    kept = scratch.table(kept, "kept")
    named = docs.where(docs["doc_id"].isNotNull()).withColumn("_of_tid", _tid())
    # one shuffle of the texts, by doc_id and hash of the text, serves the join and the fold of equal rows, whatever the size of `kept`
    on = (F.col("doc_id").cast("long") == F.col("_kept_id")) & (F.col("_of_tid") == F.col("_kept_tid"))
    first = named.join(kept.hint("merge"), on, "left_semi").dropDuplicates(["doc_id", "_of_tid"]).drop("_of_tid")
    return first.union(docs.where(docs["doc_id"].isNull()).dropDuplicates(["doc_id", "text"]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
