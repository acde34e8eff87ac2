"""Removal of repeated 100-byte strings over a whole corpus, by run-length indexes.

Windows of `LENGTH` bytes are dealt out by content: the anchor of a window is its 32-byte gram of least
hash, leftmost of equals. Equal windows have equal anchors, so they can be judged anchor by anchor.
Neighbouring windows with one anchor make a strip, a string of at most 168 bytes.

1. One pass over the texts cuts them into strips: (hash of the anchor, hash of the strip, document, place).
   Copies of a strip within about 32 MB of text are folded there and then: all but the first are repeats.
2. Anchors are counted, with map-side combination. Strips whose anchor occurs once cannot hold a repeat and go no further.
3. Copies of a strip elsewhere are repeats of the first one (two 64-bit hashes stand for its content).
4. What is left are first copies of different strips on one anchor: the edges of repeated passages, edits in near copies. Their
   bytes are fetched and put, anchor by anchor, into run-length indexes; the matching statistics mark each
   window that starts earlier too.
   An anchor with more than `CROWD` different strips is not put into one index: its windows are dealt out again, each by
   a 128-bit hash of its own bytes, and the first of each keeps its place.
5. Removed windows go back to their documents, which are read once more for what is left of them.

Order is (doc_id, start); null ids come last. Defined cases: null texts are empty; texts under 100 bytes stay
whole; rows with equal doc_id and text count as one document, each with its row; of rows with one doc_id and
different texts the one with the smaller hash is earlier; long texts are cut into segments that overlap, so memory does
not grow with them in the first pass; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, ship
from millrace.llm.rlindex import RunLengthIndex

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes that one numpy pass takes, windows in a segment of a longer text, bytes of text whose strips are folded together, of an index.
PASS_BYTES, SEGMENT, FOLD_BYTES, INDEX_BYTES = 256 * 1024, 256 * 1024, 32 << 20, 1 << 20
CROWD = 20_000
NO_ID = (1 << 63) - 1
#: A place: 22 bits of the text's hash (apart for rows of one doc_id), 41 bits of position.
PLACE = 41
TEXT_BITS = (1 << 22) - 1

_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


def strips(data: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Strips of segments: `first` is where each starts in data, `windows` how many windows it has.

    Gives, for each strip: its segment, the offset of its first window there, its number of windows, anchor hash, content hash.
    """
    h = _BYTES[data]
    for level in range(5):  # grams of 2, 4, ... 32 bytes
        step = 1 << level
        h = _mix(h[:-step] * _ODD[level] + h[step:])
    double = _mix(h[:-GRAM] * _ODD[5] + h[GRAM:])  # grams of 64 bytes
    at = np.arange(len(h), dtype=np.uint64)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | at
    for step in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: -(SPAN - 64)], least[SPAN - 64 :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.repeat(first - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    segment = np.repeat(np.arange(len(first)), windows)
    a = anchor[start]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (segment[1:] != segment[:-1])
    i = np.flatnonzero(new)
    count = np.diff(np.append(i, len(a)))
    lo, p = start[i], a[i]
    hi = lo + count - 1
    content = double[lo]
    for part in (double[lo + LENGTH - 64], double[hi], double[hi + LENGTH - 64], (count * 1024 + (p - lo)).astype(np.uint64)):
        content = _mix(content * _ODD[6] + part)
    return segment[i], lo - first[segment[i]], count, h[p], content


def _fold(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    mh, ch, doc, at, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((at, doc, mh ^ (ch * _ODD[0])))
    mh, ch, doc, at, n = mh[order], ch[order], doc[order], at[order], n[order]
    same = np.zeros(len(mh), bool)
    same[1:] = (mh[1:] == mh[:-1]) & (ch[1:] == ch[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(mh))))
    itself = same & (doc == doc[lead]) & (at == at[lead])  # a repeated row
    kept = ~itself
    columns = [pa.array(x[kept].view(np.int64)) for x in (mh, ch)] + [pa.array(doc[kept]), pa.array(at[kept]), pa.array(n[kept].astype(np.int32)), pa.array(same[kept])]
    return pa.RecordBatch.from_arrays(columns, names=["mh", "ch", "doc_id", "at", "n", "again"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[bytes, int, int, int]] = []  # bytes, windows, doc_id, place
    held = folded = 0

    def run() -> None:
        data = np.frombuffer(b"".join(x[0] for x in pieces) + bytes(2 * LENGTH), np.uint8)
        sizes = np.array([len(x[0]) for x in pieces])
        windows = np.array([x[1] for x in pieces])
        segment, offset, n, mh, ch = strips(data, np.concatenate([[0], np.cumsum(sizes)[:-1]]), windows)
        doc = np.array([x[2] for x in pieces], np.int64)[segment]
        at = np.array([x[3] for x in pieces], np.int64)[segment] + offset
        parts.append((mh, ch, doc, at, n))
        pieces.clear()

    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = value.as_buffer().to_pybytes()
            total = len(raw) - LENGTH + 1
            if total < 1:
                continue
            place = (xxhash.xxh64_intdigest(raw, seed=42) & TEXT_BITS) << PLACE
            for a in range(0, total, SEGMENT):
                windows = min(SEGMENT, total - a)
                pieces.append((raw[a : a + windows + LENGTH - 1], windows, key, place + a))
                held += windows + LENGTH - 1
                if held >= PASS_BYTES:
                    folded += held
                    run()
                    held = 0
                    if folded >= FOLD_BYTES:
                        yield _fold(parts)
                        parts, folded = [], 0
    if pieces:
        run()
    if parts:
        yield _fold(parts)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strips of the joined documents, as bytes; of crowded anchors the hashes of their windows."""
    for batch in batches:
        out: list[tuple] = []
        for key, value, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = value.as_buffer().to_pybytes()
            for w in wanted:
                pos = w["at"] & ((1 << PLACE) - 1)
                if not w["crowded"]:
                    out.append((w["mh"], key, w["at"], raw[pos : pos + w["n"] + LENGTH - 1], None, None))
                    continue
                for o in range(w["n"]):
                    d = xxhash.xxh3_128_digest(raw[pos + o : pos + o + LENGTH])
                    out.append((w["mh"], key, w["at"] + o, None, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["mh", "doc_id", "at", "strip", "w1", "w2"])


def repeats_in(doc: np.ndarray, at: np.ndarray, strip: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (doc_id, place, how many) of some strips that start earlier among them."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])  # repeated rows bring a strip twice
    order, doc, at = order[fresh], doc[fresh], at[fresh]
    held = [strip[i] for i in order.tolist()]
    index = RunLengthIndex(np.frombuffer(b"".join(held), np.uint8), np.fromiter(map(len, held), np.int64, len(held)))
    k, offset = index.repeats(LENGTH)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (offset[1:] != offset[:-1] + 1)
    i = np.flatnonzero(new)
    return doc[k[i]], at[k[i]] + offset[i], np.diff(np.append(i, len(k)))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole anchors are gathered to about INDEX_BYTES."""
    rows: list[tuple] = []
    size = 0

    def judged() -> pa.RecordBatch:
        doc, at, n = repeats_in(np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), [r[3] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(n.astype(np.int32))], names=["doc_id", "at", "n"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
            if size >= INDEX_BYTES and row[0] != rows[-1][0]:
                yield judged()
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield judged()


def _rest(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, value, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = value.as_buffer().to_pybytes()
            spans: list[list[int]] = []
            for a, n in sorted((r["pos"], r["n"]) for r in runs or ()):
                end = a + n - 1 + LENGTH
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([a, end])
            kept, last = [], 0
            for a, b in spans:
                kept.append(raw[last:a])
                last = b
            rest = b"".join([*kept, raw[last:]])
            row = (key, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())
            out.append((*row, rest) if with_text else row)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names=names)


def _first() -> Column:
    """The earliest (doc_id, at) of a group. A long text can bring a strip more than once, in segments folded apart."""
    return F.min(F.struct("doc_id", "at"))


def removed_windows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, at, n): runs of windows that also start earlier. docs: doc_id, text, text_bits."""
    strip = scratch.table(docs.select("doc_id", "text").mapInArrow(_cut, "mh long, ch long, doc_id long, at long, n int, again boolean"), "strips")
    folded = scratch.table(strip.where("again").select("doc_id", "at", "n"), "folded")
    fresh = strip.where("not again").drop("again")
    met = fresh.groupBy("mh").agg(F.count("*").alias("k")).where("k > 1").select("mh")
    shared = scratch.table(fresh.join(met, "mh", "left_semi"), "shared")
    scratch.drop(strip)
    scratch.release()
    firsts = scratch.table(shared.groupBy("mh", "ch").agg(_first().alias("f"), F.max("n").alias("n"), F.count("*").alias("k")), "firsts")
    many = firsts.where("k > 1").select("mh", "ch", "f")
    copies = shared.join(many, ["mh", "ch"]).where("doc_id != f.doc_id or at != f.at").select("doc_id", "at", "n")
    copies = scratch.table(copies, "copies")
    scratch.drop(shared)
    scratch.release()
    differ = firsts.groupBy("mh").agg(F.count("*").alias("contents")).where("contents > 1").select("mh", (F.col("contents") > CROWD).alias("crowded"))
    wanted = firsts.join(differ, "mh").select("mh", F.col("f.doc_id").alias("d"), F.col("f.at").alias("at"), "n", "crowded")
    by_doc = wanted.groupBy("d", F.shiftright("at", PLACE).cast("int").alias("t")).agg(F.collect_list(F.struct("mh", "at", "n", "crowded")).alias("wanted"))
    read = docs.join(by_doc, (F.col("doc_id") == F.col("d")) & (F.col("text_bits") == F.col("t"))).select("doc_id", "text", "wanted")
    fetched = scratch.table(read.mapInArrow(_fetch, "mh long, doc_id long, at long, strip binary, w1 long, w2 long"), "fetched")
    scratch.release()
    dealt = fetched.where("strip is not null").select("mh", "doc_id", "at", "strip").repartition("mh").sortWithinPartitions("mh")
    indexed = scratch.table(dealt.mapInArrow(_index, "doc_id long, at long, n int"), "indexed")
    window = fetched.where("strip is null").select("w1", "w2", "doc_id", "at")
    earliest = window.groupBy("w1", "w2").agg(_first().alias("f"), F.count("*").alias("k")).where("k > 1").select("w1", "w2", "f")
    again = window.join(earliest, ["w1", "w2"]).where("doc_id != f.doc_id or at != f.at").select("doc_id", "at", F.lit(1).alias("n"))
    again = scratch.table(again, "crowded")
    scratch.drop(fetched)
    scratch.release()
    return folded.union(copies).union(indexed).union(again)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes), a row for each row."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "repeats")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_bits", F.xxhash64("text").bitwiseAND(F.lit(TEXT_BITS)).cast("int"))
    runs = removed_windows(rows, scratch)
    place = F.col("at").bitwiseAND(F.lit((1 << PLACE) - 1))
    by_doc = runs.groupBy(F.col("doc_id").alias("d"), F.shiftright("at", PLACE).cast("int").alias("t")).agg(F.collect_list(F.struct(place.alias("pos"), "n")).alias("runs"))
    held = rows.join(by_doc, (F.col("doc_id") == F.col("d")) & (F.col("text_bits") == F.col("t")), "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = held.mapInArrow(lambda batches: _rest(batches, with_text), schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM d, unnest(range(0, length(h) // 2 - 99)) AS t(i)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n),
p AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY ALL),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM p),
j AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS e, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
