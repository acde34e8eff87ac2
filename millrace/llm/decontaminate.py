"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Each benchmark item keeps a bottom-k MinHash sketch of its five-word shingles. k depends on the size
class of the item: it is one more than the number of shingles that an item of that class may miss and
still be contained to `threshold`. So a document that contains the item shares at least one value of the
sketch, whatever the length of the document: the search loses nothing. Candidates are verified by
counting the item's distinct shingles in the document, as texts.

Documents are read once. Of their shingles only those that pass a Bloom filter of all item shingles go
on; the filter is the one thing that is broadcast, and its size is bounded (`most_bits`). Beyond that size it
lets more through, and results stay the same. Everything else is joins on shingle, item or document.

Defined cases: null texts are empty; an item without words never matches; an item of fewer than five words is one
shingle of all its words; repeated shingles count once; long documents are read in pieces (`PART`) that share
four words, so that memory does not grow with them but with the longest words; rows with the same doc_id count as one document,
rows with the same item_id as one item each per text; other columns are ignored; the comparison at the threshold is exact (integers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, chunks, ship, texts
from millrace.llm.wordgrams import Words, pieces, plain

WORDS = 5
#: Containment of 4/5, as integers.
THRESHOLD = (4, 5)
#: Bits of the Bloom filter: 16 for each item shingle, within these.
LEAST_BITS, MOST_BITS = 24, 28
#: Bytes of a document that are looked at together.
PART = 1 << 20


def _spare(n: int) -> int:
    """Shingles that an item of n may miss."""
    a, b = THRESHOLD
    return n - -(-n * a // b)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("item_id", pa.int64()), ("item", pa.int64()), ("shingle", pa.string()), ("hash", pa.int64()), ("words", pa.int32()), ("n", pa.int64()), ("sketched", pa.bool_())]
    for ids, held in chunks(batches):
        rows = []
        for key, raw in zip(ids, held, strict=True):
            w = Words([plain(raw)])
            size = min(WORDS, len(w.first))
            if not size:
                continue
            at, h = w.grams(size)
            found = dict(zip((w.text(int(i), size) for i in at), h.tolist(), strict=True))
            n = len(found)
            k = _spare((1 << n.bit_length()) - 1) + 1  # for the largest item of this size class
            least = set(sorted(found.values())[:k])
            mark = int(np.bitwise_xor.reduce(np.fromiter(found.values(), np.uint64, n)).view(np.int64))
            rows += [(key, mark, s, int(np.uint64(x).view(np.int64)), size, n, x in least) for s, x in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], names=[k for k, _ in fields])


def _bits(items: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The Bloom filter, made by one aggregation; at most 2^MOST_BITS bits come to the driver."""
    log = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    at = items.select(F.shiftrightunsigned("hash", 64 - log).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toPandas()
    table = np.zeros(1 << log - 6, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table.view(np.uint8), log


def _passing(ids: list, held: list[bytes], sizes: list[int], bits: np.ndarray, log: int) -> tuple[list, list[str]]:
    """Keys and shingles that pass the filter."""
    w = Words(held)
    keys, shingles = [], []
    for size in sizes:
        at, h = w.grams(size)
        place = h >> np.uint64(64 - log)
        found = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
        for i in at[np.flatnonzero(found)].tolist():
            keys.append(ids[w.of[i]])
            shingles.append(w.text(i, size))
    return keys, shingles


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment, for each item contained in a document to the threshold."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "decontaminate")
    of_items = texts(items, item_key, item_text).mapInArrow(_item_rows, "item_id long, item long, shingle string, hash long, words int, n long, sketched boolean")
    index = scratch.table(of_items.distinct(), "items")
    sizes = sorted(r["words"] for r in index.select("words").distinct().collect())  # at most five
    table, log = _bits(index, index.count())
    filter_ = spark.sparkContext.broadcast(table)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for ids, held in chunks(batches):
            ready = [plain(x) for x in held]
            keys, shingles = _passing(ids, [x if len(x) <= PART else b"" for x in ready], sizes, bits, log)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shingles, pa.string())], names=["doc_id", "shingle"])
            for key, raw in zip(ids, ready, strict=True):
                for piece in pieces(raw, WORDS - 1, PART) if len(raw) > PART else ():
                    keys, shingles = _passing([key], [piece], sizes, bits, log)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shingles, pa.string())], names=["doc_id", "shingle"])

    seen = scratch.table(texts(docs, key, text).mapInArrow(hits, "doc_id long, shingle string").distinct(), "hits")
    candidates = seen.join(index.where("sketched").select("item_id", "item", "shingle"), "shingle").select("doc_id", "item_id", "item").distinct()
    wanted = candidates.join(index.select("item_id", "item", "shingle", "n"), candidates["item_id"].eqNullSafe(index["item_id"]) & (candidates["item"] == index["item"]))
    wanted = wanted.select("doc_id", candidates["item_id"], candidates["item"], "shingle", "n")
    other = seen.select(F.col("doc_id").alias("d"), F.col("shingle").alias("s"))
    shared = wanted.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("shingle") == F.col("s")), "left_semi")
    counted = shared.groupBy("doc_id", "item_id", "item", "n").agg(F.count("*").alias("n_shared"))
    a, b = THRESHOLD
    good = counted.where(F.col("n_shared") * b >= F.col("n") * a)
    return good.select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item."""
    bad = Scratch(docs.sparkSession, "decontaminated").table(contained(docs, items).select("doc_id").distinct(), "bad")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")


OP8_SQL = r"""
WITH q AS (SELECT DISTINCT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, text, w, least(5, len(w)) AS size FROM q WHERE len(w) > 0),
a AS (SELECT DISTINCT item_id, text, array_to_string(w[k : k + size - 1], ' ') AS s FROM i, unnest(range(1, len(w) - size + 2)) AS t(k)),
n AS (SELECT item_id, text, count(*) AS n_shingles FROM a GROUP BY ALL),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + size - 1], ' ') AS s FROM d, (SELECT DISTINCT size FROM i), unnest(range(1, len(w) - size + 2)) AS t(k)),
c AS (SELECT doc_id, item_id, text, count(*) AS n_shared FROM b JOIN a USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM c JOIN n USING (item_id, text) WHERE 5 * n_shared >= 4 * n_shingles
"""


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
