"""Quality scores: learned hashed word and character n-gram vectors, averaged, with a softmax.

Features of a text: its words and pairs of words (as white space divides them), pairs of one word with
itself as a feature of their own, and its 3-, 4- and 5-grams of bytes, each hashed to one of 2^18
vectors. They are learned with the softmax by stochastic gradient descent in numpy, on a bounded sample
of labelled rows (`SAMPLE`), outside the held-out fold. As the output is linear in the average, a fitted
model folds into one number for each bucket: a score is the average of those numbers over a text.

Defined cases: null texts are empty; a text without features scores the share of label 1; without
labels of both kinds every text scores that share (0.5 if there are no labels); repeated rows are scored each;
long texts are read in parts (`PART`), with the same features, so memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bucket, chunks, ship, texts
from millrace.llm.labelled import sample
from millrace.llm.wordgrams import SOLID, Words, WordStream

BUCKETS = 1 << 18
#: Labelled rows of label 0 and of label 1 at most.
SAMPLE = (2500, 3500)
DIM, EPOCHS, RATE, SEED = 10, 6, 0.4, 7
KEPT = 0.3
#: Bytes of a text that are looked at together.
PART = 1 << 20

_TABLES = np.random.default_rng(11).integers(0, 1 << 32, (5, 256), dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(held: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, index of its text), kind by kind; the features of a text stand together."""
    w = Words(held, SOLID)
    low = np.uint64(BUCKETS - 1)
    yield (w.hash & low).astype(np.int64), w.of
    if len(w.first) > 1:
        with np.errstate(over="ignore"):
            pair = (w.hash[:-1] * _STEP + w.hash[1:]) >> np.uint64(40)
        pair = np.where(w.hash[:-1] == w.hash[1:], np.uint64(1), pair & low)
        same = w.of[:-1] == w.of[1:]
        yield pair[same].astype(np.int64), w.of[:-1][same]
    doc = np.repeat(np.arange(len(held)), w.stops - w.starts + 1)
    h = _TABLES[0][w.data]
    for n in range(1, 5):
        h = h[: len(w.data) - n] ^ _TABLES[n][w.data[n:]]
        if n >= 2:
            place = np.arange(len(h))
            whole = place + n < w.stops[doc[: len(h)]]
            yield ((h[whole] * np.uint32(2 * n + 1)) & np.uint32(BUCKETS - 1)).astype(np.int64), doc[: len(h)][whole]


def features_in_parts(raw: bytes, size: int) -> Iterator[np.ndarray]:
    """Buckets of the features of one text, as `features` gives them, part by part."""
    low = np.uint64(BUCKETS - 1)
    words = WordStream(SOLID)
    before, tail = np.zeros(0, np.uint64), b""
    for a in range(0, len(raw), size):
        part = raw[a : a + size]
        found = words.part(part, a + size >= len(raw))
        yield (found & low).astype(np.int64)
        run = np.concatenate([before, found])
        if len(run) > 1:
            with np.errstate(over="ignore"):
                pair = (run[:-1] * _STEP + run[1:]) >> np.uint64(40)
            yield np.where(run[:-1] == run[1:], np.uint64(1), pair & low).astype(np.int64)
        before = run[-1:]
        data = np.frombuffer(tail + part, np.uint8)
        h = _TABLES[0][data]
        for n in range(1, 5):
            h = h[: max(0, len(data) - n)] ^ _TABLES[n][data[n:]]
            if n >= 2:
                new = h[max(0, len(tail) - n) :]  # those that end in this part
                yield ((new * np.uint32(2 * n + 1)) & np.uint32(BUCKETS - 1)).astype(np.int64)
        tail = (tail + part[-4:])[-4:]


def fit(held: list[bytes], labels: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """A number for each bucket and a bias: log odds of label 1."""
    rng = np.random.default_rng(SEED)
    docs = []
    for raw in held:
        all_ = np.concatenate([b for b, _ in features([raw])])
        ids, counts = np.unique(all_, return_counts=True)
        docs.append((ids, (counts / max(1, len(all_))).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    total, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            rate = np.float32(RATE * (1 - done / total))
            done += 1
            mean = share @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * p
            vectors[ids] -= (rate * len(ids) ** 0.5 * share)[:, None] * back[None, :]
    seen = labels.mean()
    shift = np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))  # the sample holds the labels in other shares
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0] + shift)


def model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray | None, float]:
    rows, prior = sample(docs, labels, "quality", SAMPLE)
    y = rows["y"].to_numpy(np.int64)
    if not 0 < y.sum() < len(y):
        return None, float(prior if len(y) else 0.5)
    weights, bias = fit([t.encode() for t in rows["text"]], y, prior)
    return weights, bias


def score(docs: DataFrame, fitted: tuple[np.ndarray | None, float]) -> DataFrame:
    """doc_id, score. The model is 1 MB, whatever the data."""
    ship(docs.sparkSession)
    held_model = docs.sparkSession.sparkContext.broadcast(fitted)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held_model.value
        for ids, held in chunks(batches):
            total, n = np.zeros(len(held)), np.zeros(len(held))
            if weights is None:
                p = np.full(len(held), bias)
            else:
                for place, of in features([x if len(x) <= PART else b"" for x in held]):
                    total += np.bincount(of, weights[place], len(held))
                    n += np.bincount(of, minlength=len(held))
                for i in (i for i, x in enumerate(held) if len(x) > PART):
                    for place in features_in_parts(held[i], PART):
                        total[i] += weights[place].sum(dtype=np.float64)
                        n[i] += len(place)
                p = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p)], names=["doc_id", "score"])

    return texts(docs).mapInArrow(go, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = score(docs, model(docs, labels))
    return rows.select("doc_id", (F.coalesce(bucket() == 0, F.lit(False))).alias("held_out"), "score", F.when(F.col("score") >= KEPT, 1).otherwise(0).cast("int").alias("predicted"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
