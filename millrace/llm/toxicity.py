"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

A text is lower-cased, what divides words becomes one space, and each byte is written with the three
that follow it as a hash of four bytes. (In plain text a literal costs zstandard half a byte and a match three
bytes, so it cannot tell short words apart; written wide, a letter costs as much as a match.) Windows of `WINDOW` words,
one from each word on, are compressed twice: with the dictionaries of ordinary text, and with the toxic one beside
them. What the toxic dictionary saves, beyond `SLACK` bytes and up to `MOST_SAVED`, is added up over the
windows of a text and divided by the root of their number: that is the text's distance. A sigmoid about
a threshold makes it a score.

All dictionaries are trained by zstandard, on windows of a bounded sample of labelled rows (`SAMPLE`) outside the held-out fold:

1. The ordinary dictionary, on windows of ordinary texts.
2. One toxic dictionary for each half of the toxic texts. Windows of a half that the other half's dictionary saves
   bytes on, more than it does on nearly all ordinary windows, are toxic beyond their own text; the next round
   trains on them alone.
3. Ordinary windows that a toxic dictionary saves bytes on train a second ordinary dictionary.

2 and 3 alternate for `ROUNDS` rounds. The threshold is always chosen on a quarter of the sample that no dictionary has seen.

Defined cases: null, empty and wordless texts have distance 0 and so are not toxic; without labels of both
kinds, or with too few texts to train on, every text has distance 0; texts of any length are read whole, in pieces; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bucket, ship, texts
from millrace.llm.labelled import sample

#: Labelled rows of label 0 and of label 1 at most.
SAMPLE = (4000, 2000)
REJECTED = 0.5
WINDOW = 3
ORDINARY_BYTES, HARD_BYTES, FIRST_BYTES, TOXIC_BYTES = 110 * 1024, 32 * 1024, 110 * 1024, 8 * 1024
ROUNDS = 4
#: Bytes of windows that one training, and one half's or round's comparison, takes at most.
TRAINED_ON, COMPARED = 16 << 20, 24 << 20
SLACK, MOST_SAVED, SMOOTH = 3, 12, 20
#: Savings from which a window counts as toxic, or as ordinary but hard, while fitting.
TELLING, HARD = 8, 6
LEAST_TEXTS = 8
#: A false alarm weighs so many misses (as rates) when the threshold is chosen.
ALARM = 3
#: Characters of a text that are coded at once.
PIECE = 1 << 16
#: Bits of a code by which it is looked up (a table of 16 MB in each worker).
CODE_BITS = 24
_ODD = np.random.default_rng(3).integers(1 << 40, 1 << 63, 6, dtype=np.uint64) | np.uint64(1)
_OTHER = re.compile(r"[\W_]+")


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    threshold: float
    slope: float


def plain(text: str) -> str:
    return " " + _OTHER.sub(" ", text.lower()).strip() + " "


def wide(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of a plain text: four bytes for each byte, hashing it with the next three, and where words start (and where the last one ends)."""
    raw = np.frombuffer(text.encode("utf-8", "replace") + bytes(3), np.uint8)
    b = raw.astype(np.uint32)
    h = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(0x9E3779B1)
    h = (h ^ h >> 15) * np.uint32(0x85EBCA77)
    return (h ^ h >> 13).astype("<u4"), np.flatnonzero(raw[:-3] == 32)


def pieces(text: str) -> Iterator[str]:
    """The plain text, in pieces that share WINDOW - 1 words, so that each window stands in one piece."""
    lead: list[str] = []
    held, some = "", False
    for a in range(0, len(text), PIECE):
        *whole, held = _OTHER.sub(" ", held + text[a : a + PIECE].lower()).split(" ")
        lead += [w for w in whole if w]
        if len(lead) >= WINDOW:
            yield " " + " ".join(lead) + " "
            lead, some = lead[1 - WINDOW :], True
    lead += [held] if held else []
    if len(lead) >= WINDOW or (lead and not some):
        yield " " + " ".join(lead) + " "


def windows(piece: str, step: int = 1) -> list[bytes]:
    """The windows of a plain text of one or more words; fewer words than a window make one."""
    codes, at = wide(piece)
    n = len(at) - 1
    return _cut(codes, at, range(0, max(1, n - WINDOW + 1), step)) if n > 0 else []


def _cut(codes: np.ndarray, at: np.ndarray, first: Iterable[int]) -> list[bytes]:
    """The windows from some words on."""
    raw, n = codes.tobytes(), len(at) - 1
    at4 = (4 * at).tolist()
    return [raw[at4[i] : max(at4[min(i + WINDOW, n)] - 8, at4[i] + 4)] for i in first]


def _some(held: list[str], most: int, step: int = 1) -> list[bytes]:
    """Windows of plain texts, at most about so many bytes of them, by a fixed random choice."""
    rng = np.random.default_rng(7)
    size = sum(len(t.encode("utf-8", "replace")) for t in held) * 4 * (WINDOW if step == 1 else 1)
    share = min(1.0, most / max(1, size))
    found = []
    for text in held:
        part = windows(text, step)
        found += part if share == 1 else [w for w, r in zip(part, rng.random(len(part)), strict=True) if r < share]
    return found


def _trained(found: list[bytes], size: int) -> bytes:
    """A dictionary trained on windows in mixed order (zstandard gives up on runs that bring nothing new); of few windows a smaller one."""
    rng = np.random.default_rng(7)
    total = sum(map(len, found))
    found = [found[i] for i in rng.permutation(len(found))[: int(len(found) * min(1, TRAINED_ON / max(1, total))) + 1]]
    total = min(total, TRAINED_ON)
    return zstandard.train_dictionary(max(1024, min(size, total // 3)), found, k=32, d=8).as_bytes()


def _compressor(raw: bytes):
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(9, min_match=4, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


def _saved(found: list[bytes], ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    a, b = _compressor(ordinary), _compressor(toxic + ordinary)
    return np.fromiter((len(a(w)) - len(b(w)) for w in found), np.int64, len(found))


def _own(toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Whether a code, by its last bits, stands in the toxic dictionary and not in the ordinary ones."""
    codes = [np.unique(np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), 4).copy().view("<u4").ravel()) for raw in (toxic, ordinary)]
    table = np.zeros(1 << CODE_BITS, bool)
    table[np.setdiff1d(*codes) & np.uint32((1 << CODE_BITS) - 1)] = True
    return table


class Distance:
    """How much better the toxic dictionary explains a text.

    A match costs zstandard about three bytes and a code is four: windows without two codes in a row that the toxic dictionary alone
    has can save no more than `SLACK`, or little more, and are not compressed (they count as windows that save nothing).
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.ordinary, self.both = _compressor(ordinary), _compressor(toxic + ordinary)
        self.own = _own(toxic, ordinary)

    def text(self, text: str) -> float:
        total = n = 0
        a, b = self.ordinary, self.both
        for piece in pieces(text):
            codes, at = wide(piece)
            many = max(1, len(at) - WINDOW)
            n += many
            own = self.own[codes & np.uint32((1 << CODE_BITS) - 1)]
            word = np.unique(np.searchsorted(at, np.flatnonzero(own[:-1] & own[1:]), side="right") - 1)
            first = np.unique((word[:, None] - np.arange(WINDOW)).clip(0, many - 1))
            for w in _cut(codes, at, first.tolist()) if len(at) > 1 else ():
                saved = len(a(w)) - len(b(w)) - SLACK
                if saved > 0:
                    total += min(saved, MOST_SAVED)
        return total / (SMOOTH + n) ** 0.5


def _one_of_near_copies(held: list[str]) -> list[str]:
    """The texts that do not share all of six minima of their hashed windows with earlier ones: a toxic text's copies would vouch for its ordinary words."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for text in held:
        marked = np.fromiter(map(zlib.crc32, windows(text)), np.uint64) + np.uint64(1)
        marks = [(k, int((marked * odd >> np.uint64(20)).min())) for k, odd in enumerate(_ODD)]
        if not all(m in seen for m in marks):
            kept.append(text)
        seen.update(marks)
    return kept


def _threshold(toxic: np.ndarray, ordinary: np.ndarray) -> float:
    """The middle of the first widest range of thresholds that lose least, by rates of misses and false alarms."""
    at = np.unique(np.concatenate([[0.0], toxic, ordinary]))
    between = np.append((at[1:] + at[:-1]) / 2, at[-1] + 1)
    width = np.append(np.diff(at), 0)
    loss = np.array([(toxic < t).mean() + ALARM * (ordinary >= t).mean() for t in between])
    least = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float(between[least[np.argmax(width[least])]])


def fit(held: list[str], labels: np.ndarray) -> Model | None:
    """The dictionaries and the threshold."""
    toxic, ordinary = (_one_of_near_copies([p for t, y in zip(held, labels, strict=True) if y == label and len(p := plain(t)) > 2]) for label in (1, 0))
    if min(len(toxic), len(ordinary)) < LEAST_TEXTS:
        return None
    seen = [[t for i, t in enumerate(part) if i % 4 != 3] for part in (toxic, ordinary)]
    try:
        halves = [_some(seen[0][h::2], COMPARED) for h in (0, 1)]
        common = _trained(_some(seen[1], TRAINED_ON, WINDOW), ORDINARY_BYTES)
        chosen, hard, extra = halves, [], b""
        for turn in range(ROUNDS):
            tried = [_trained(c, TOXIC_BYTES if turn else FIRST_BYTES) for c in chosen]
            null = _some(seen[1][turn::ROUNDS], COMPARED // 2)
            saved = [_saved(null, extra + common, t) for t in tried]
            hard += [w for w, a, b in zip(null, *saved, strict=True) if max(a, b) > HARD]
            extra = _trained(hard, HARD_BYTES) if len(hard) >= 50 else b""
            chosen = []
            for h in (0, 1):
                least = max(TELLING, float(np.quantile(_saved(null, extra + common, tried[1 - h]), 0.999)))
                better = _saved(halves[h], extra + common, tried[1 - h])
                least = min(least, float(np.quantile(better, 0.999)) - 1)  # the best thousandth is always looked at again
                chosen.append([w for w, s in zip(halves[h], better.tolist(), strict=True) if s > least])
        dictionary = _trained(chosen[0] + chosen[1], TOXIC_BYTES)
    except zstandard.ZstdError:  # too little to train a dictionary on
        return None
    distance = Distance(dictionary, extra + common)
    told = [np.array([distance.text(t) for t in part[3::4]]) for part in (toxic, ordinary)]
    threshold = max(_threshold(*told), 1e-3)
    return Model(dictionary, extra + common, threshold, threshold / 4)


def model(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows, _ = sample(docs, labels, "toxic", SAMPLE)
    return fit(list(rows["text"]), rows["y"].to_numpy(np.int64))


def score(docs: DataFrame, fitted: Model | None) -> DataFrame:
    """doc_id, score, distance. The model is dictionaries of bounded size."""
    ship(docs.sparkSession)
    held_model = docs.sparkSession.sparkContext.broadcast(fitted)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held_model.value
        distance = Distance(fitted.toxic, fitted.ordinary) if fitted else None
        threshold, slope = (fitted.threshold, fitted.slope) if fitted else (1.0, 0.25)
        for batch in batches:
            d = np.array([distance.text(t.as_py()) if distance else 0.0 for t in batch.column(1)], np.float64)
            p = 1 / (1 + np.exp(np.clip((threshold - d) / slope, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(d)], names=["doc_id", "score", "distance"])

    return texts(docs).mapInArrow(go, "doc_id long, score double, distance double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, distance."""
    rows = score(docs, model(docs, labels))
    return rows.select("doc_id", (F.coalesce(bucket() == 0, F.lit(False))).alias("held_out"), "score", F.when(F.col("score") >= REJECTED, 1).otherwise(0).cast("int").alias("predicted"), "distance")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose text is not rejected; all their columns, judged row by row and without a join."""
    fitted = model(docs, labels)
    ship(docs.sparkSession)
    held_model = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("boolean")
    def fine(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = held_model.value
        distance = Distance(fitted.toxic, fitted.ordinary) if fitted else None
        for text in parts:
            yield pd.Series([distance is None or distance.text(t) < fitted.threshold for t in text], dtype=bool)

    return docs.where(fine(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
