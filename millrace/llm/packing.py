"""Packing of token pieces into sequences: dominance reduction, then best fit.

Only lengths matter to a packing, and there are at most `capacity` of them. So the instance is the
histogram of lengths, however many documents there are: the reduction and best fit work on counts,
and a solution is a list of (length, how many bins, slots in each). Pieces then take slots by their
rank among those of their length; ranks come from salted groups with running offsets, so that a
length that a third of all pieces have is not ranked in one task.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table
packs to nothing; the string of a special token in a text is that token's one id,
as the tokenizer has it; long texts are encoded in parts; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, ship, texts

CAPACITY = 2048
END_ID = 0
#: Pieces of a length that are ranked together, about: each length is dealt into shards of so many, at every size.
RANKED_TOGETHER = 1000
#: Characters of a text that are encoded at once, about.
PART = 1 << 16
_CUT = re.compile(r"(?<=\S)(?= [^\W\d_])")


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """Martello and Toth's reduction on counts: fixed bins [(how many, [(length, copies)])], and what is left.

    Of all sets that hold an item, one that dominates the others may be fixed without loss:
    the item alone if nothing fits beside it; with an item that fills the bin exactly; with the
    largest that fits, if no two others fit together beside it.
    """
    left = {k: v for k, v in counts.items() if v}
    fixed: list[tuple[int, list[tuple[int, int]]]] = []

    def take(n: int, *items: int) -> None:
        kinds = [(x, items.count(x)) for x in sorted(set(items), reverse=True)]
        fixed.append((n, kinds))
        for x, k in kinds:
            left[x] -= n * k
            if not left[x]:
                del left[x]

    changed = True
    while changed and left:
        changed = False
        for x in sorted(left, reverse=True):
            if x not in left:
                continue
            mate = capacity - x
            if mate == 0:
                take(left[x], x)
                changed = True
                continue
            if mate in left and (mate != x or left[x] > 1):
                take(left[x] // 2 if mate == x else min(left[x], left[mate]), x, mate)
                changed = True
                if x not in left:
                    continue
            sizes = sorted(left)
            others = [s for s in sizes for _ in range(min(3, left[s] - (s == x)))][:2]
            if not others or x + others[0] > capacity:
                take(left[x] if x + x > capacity else 1, x)
                changed = True
            elif len(others) == 1 or x + sum(others) > capacity:
                i = bisect_left(sizes, capacity - x + 1) - 1
                if sizes[i] == x and left[x] == 1:
                    i -= 1
                best = sizes[i]
                take(left[x] // 2 if best == x else min(left[x], left[best]), x, best)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit decreasing on counts: [(how many bins, [(length, copies)])]."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []  # sorted keys of open_

    def put(room: int, bins: int, items: list[tuple[int, int]]) -> None:
        if bins:
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
            open_.setdefault(room, []).append((bins, items))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                room, bins, items = capacity, n, []
            else:
                room = rooms[at]
                bins, items = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = room // x
            full = min(bins, n // each)
            put(room - each * x, full, [*items, (x, each)])
            n -= full * each
            if full < bins and n:  # fewer than `each` are left
                put(room - n * x, 1, [*items, (x, n)])
                full, n = full + 1, 0
            if items:
                put(room, bins - full, items)
    return [group for groups in open_.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first bin, offset in it): which slots the pieces of a length take, by rank."""
    fixed, left = reduce_by_dominance(counts, capacity)
    at: dict[int, int] = {}
    rows, base = [], 0
    for bins, items in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for x, copies in items:
            rows.append((x, at.get(x, 0), copies, base, offset))
            at[x] = at.get(x, 0) + bins * copies
            offset += x * copies
        base += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def parts(text: str, size: int) -> Iterator[str]:
    """A long text, cut only between a character that is no white space and a space with a letter behind it: there the tokenizer always begins a new token."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encoder(vocabulary: str, ranks: str, pattern: str):
    """Text to its ids as the tokenizers library has them, with its defaults (the string of a special token is that token).

    Its ids for ordinary parts are those of plain merging by rank, so these come from the faster reader of the same
    vocabulary (`ranks`, `pattern`; equal for every code point, see the tests). Parts with the string of a special token, and
    parts that cannot be cut, which that reader cannot bear, go through the library itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a process for each core already
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    special = [token.content for token in whole.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def ids(part: str) -> list[int]:
        if len(part) > 2 * PART or any(x in part for x in special):
            return whole.encode(part, add_special_tokens=False).ids
        return plain(part)

    return lambda text: np.array([*(i for p in parts(text, PART) for i in ids(p)), END_ID], "<u4")


PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 (and ids). `vocabulary`: path of the tokenizer's files without their suffixes, found on each executor if None."""
    ship(docs.sparkSession)
    fields = [*PIECE, ("ids", pa.list_(pa.int32()))] if with_ids else PIECE

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as P

        name = vocabulary or P.path("byte_bpe_50k")
        encode = encoder(f"{name}.json", f"{name}.tiktoken", P.PATTERN)
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py())
                start, n = 0, len(ids)
                length = n % capacity or capacity
                piece = 0
                while start < n:
                    part = ids[start : start + length]
                    row = (key, piece, start, length, zlib.crc32(part), part)
                    for c, v in zip(columns, row, strict=False):
                        c.append(v)
                    start, length, piece = start + length, capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[k for k, _ in fields])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return texts(docs).mapInArrow(go, schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (as from pieces, written out) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = plan(histogram, capacity)
    shards = cut.sparkSession.createDataFrame([(k, -(-n // RANKED_TOGETHER)) for k, n in histogram.items()], "length long, _shards long")
    dealt = cut.join(F.broadcast(shards), "length").withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("_shards")).cast("int")).drop("_shards")
    order = W.partitionBy("length").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy("length", "_shard").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_shard").orderBy("doc_id", "piece", "start", "ids_crc32")))
    ranked = ranked.join(before, ["length", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    names = [c for c in cut.columns if c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")]

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        hit = table[np.searchsorted(keys, n * (1 << 48) + r, side="right") - 1]
        within = r - hit[:, 1]
        return pd.DataFrame({"sequence_id": hit[:, 3] + within // hit[:, 2], "offset": hit[:, 4] + within % hit[:, 2] * n})

    return ranked.withColumn("_slot", slot("length", "_rank")).select(*names, "_slot.sequence_id", "_slot.offset")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and the offset in it."""
    cut = Scratch(docs.sparkSession, "packing").table(pieces(docs, vocabulary, capacity, with_ids), "pieces")
    return place(cut, capacity)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
