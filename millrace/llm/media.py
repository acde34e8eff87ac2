"""Media columns: magic bytes found by an Aho-Corasick automaton, confirmed by format validators, carved.

`sniff` takes a column of blobs with the type that each was declared to be. One pass of the automaton
finds every signature; a validator walks the format's own structure and lengths from there and gives
the exact extent or rejects the hit. The first valid file at offset 0 corrects the declared type;
valid files elsewhere are carved.

Defined cases: a null or empty blob has no media and keeps its declared type; text that only looks
like a signature is rejected by its validator; a truncated file is rejected; equal blobs give equal rows; a blob of very
many signatures costs one pass, as validators share what they have seen.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import ship, texts

ROW = 64
# Signatures by type, with the offset in the file at which each stands.
SIGNATURES = {
    "audio/basic": (b".snd", 0),
    "audio/wav": (b"RIFF", 0),
    "image/bmp": (b"BM", 0),
    "image/gif": (b"GIF8", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "application/pdf": (b"%PDF-", 0),
    "application/zip": (b"PK\x03\x04", 0),
    "video/mp4": (b"ftyp", 4),
}


class Blob:
    """Bytes with what validators have learnt of them, so that many hits cost one pass: where markers stand, and where walks end."""

    def __init__(self, data: bytes):
        self.data = data
        self.marks: dict[bytes, list[int]] = {}
        self.ends: dict[str, dict[int, int | None]] = {}

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, at):
        return self.data[at]

    def next(self, marker: bytes, at: int) -> int | None:
        """Where the marker stands next, from `at` on."""
        if marker not in self.marks:
            self.marks[marker] = [m.start() for m in re.finditer(re.escape(marker), self.data)]
        found = self.marks[marker]
        i = bisect_left(found, at)
        return found[i] if i < len(found) else None

    def walk(self, name: str, at: int, step: Callable[[int], tuple[int | None, int | None]]) -> int | None:
        """Follow step(place) -> (next place, None) or (None, result) from `at`. Walks of one name that meet go on together, once."""
        known = self.ends.setdefault(name, {})
        passed = []
        end = None
        while at is not None and at < len(self.data):
            if at in known:
                end = known[at]
                break
            passed.append(at)
            at, end = step(at)
        for p in passed:
            known[p] = end
        return end


def _wav(b: Blob, at: int) -> int | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        seen.add(b[p : p + 4])
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + n + n % 2
    return end if p == end and {b"fmt ", b"data"} <= seen else None


def _au(b: Blob, at: int) -> int | None:
    if len(b) < at + 24:
        return None
    head, n, kind, rate, channels = struct.unpack_from(">5I", b.data, at + 4)
    end = at + head + n
    return end if 24 <= head and 1 <= kind <= 27 and rate and 1 <= channels <= 256 and end <= len(b) else None


def _bmp(b: Blob, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, zero, first, dib, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b.data, at + 2)
    if zero or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or dib < 40 or width <= 0 or not height or first < 14 + dib:
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return at + size if first + rows <= size and at + size <= len(b) else None


def _gif(b: Blob, at: int) -> int | None:
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or len(b) < at + 13:
        return None

    def block(p: int) -> tuple[int | None, int | None]:
        """(where the next block starts, None), or (None, the end if this was the last)."""
        kind = b[p]
        if kind == 0x3B:
            return None, p + 1
        if kind == 0x21:
            q = p + 2
        elif kind == 0x2C and p + 10 < len(b):
            q = p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0)
        else:
            return None, None
        q = b.walk("gif data", q, lambda x: (x + 1 + b[x], None) if b[x] else (None, x + 1))
        return q, None

    return b.walk("gif", at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0), block)


def _jpeg(b: Blob, at: int) -> int | None:
    def segment(p: int) -> tuple[int | None, int | None]:
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if b[p] != 0xFF or p + 4 > len(b) or n < 2 or p + 2 + n > len(b):
            return None, None
        if b[p + 1] != 0xDA:
            return p + 2 + n, None
        end = b.next(b"\xff\xd9", p + 2 + n)
        return None, end if end is None else end + 2

    return b.walk("jpeg", at + 2, segment)


def _png(b: Blob, at: int) -> int | None:
    def chunk(p: int) -> tuple[int | None, int | None]:
        n = int.from_bytes(b[p : p + 4], "big")
        if p + 12 + n > len(b) or zlib.crc32(memoryview(b.data)[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None, None
        return (None, p + 12 + n) if b[p + 4 : p + 8] == b"IEND" else (p + 12 + n, None)

    return b.walk("png", at + 8, chunk) if b[at + 8 : at + 16] == b"\0\0\0\x0dIHDR" else None


def _pdf(b: Blob, at: int) -> int | None:
    end, table = b.next(b"%%EOF", at), b.next(b"startxref", at)
    return end + 5 if b[at + 5 : at + 6].isdigit() and end is not None and table is not None and table < end else None


def _zip(b: Blob, at: int) -> int | None:
    end = b.next(b"PK\x05\x06", at)
    if end is None or end + 22 > len(b):
        return None
    size, offset, note = struct.unpack_from("<IIH", b.data, end + 12)
    return end + 22 + note if at + offset + size == end and b[at + offset : at + offset + 4] == b"PK\x01\x02" and end + 22 + note <= len(b) else None


def _mp4(b: Blob, at: int) -> int | None:
    def box(kind: bytes | None, p: int) -> int | None:
        """The end of the box at p (of that kind), if one is there."""
        n = int.from_bytes(b[p : p + 4], "big")
        good = p + 8 <= len(b) and n >= 8 and p + n <= len(b) and b[p + 4 : p + 8].isalnum() and kind in (None, b[p + 4 : p + 8])
        return p + n if good else None

    def on(p: int) -> tuple[int | None, int | None]:
        q = box(None, p)
        return (q, None) if q is not None and q < len(b) else (None, p if q is None else q)

    def moov(p: int) -> tuple[int | None, int | None]:
        q = box(None, p)
        return (None, p) if box(b"moov", p) else (q, None)

    return b.walk("mp4", at, on) if box(b"ftyp", at) and b.walk("moov", at, moov) is not None else None


VALIDATORS = {
    "audio/basic": _au, "audio/wav": _wav, "image/bmp": _bmp, "image/gif": _gif, "image/jpeg": _jpeg, "image/png": _png,
    "application/pdf": _pdf, "application/zip": _zip, "video/mp4": _mp4,
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, (magic, before) in SIGNATURES.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + before))
    a.make_automaton()
    return a


def media_in(blob: bytes, machine: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, type) of each valid file, in order of start; files inside another are listed too."""
    found = []
    b = Blob(blob)
    for last, (kind, back) in machine.iter(blob.decode("latin-1")):
        at = last - back
        if at >= 0 and (end := VALIDATORS[kind](b, at)):
            found.append((at, end, kind))
    return sorted(found)


def outermost(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those that lie in no earlier one."""
    kept: list[tuple[int, int, str]] = []
    for x in found:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def examine(blob: bytes, declared: str | None, machine: ahocorasick.Automaton) -> tuple[str | None, list[tuple[int, int, str]], int]:
    """The true type of a blob (the declared one if no valid file starts it), its outermost files, and how many lie inside those."""
    found = media_in(blob, machine)
    top = outermost(found)
    return top[0][2] if top and top[0][0] == 0 else declared, top, len(found) - len(top)


def samples(blob: bytes, at: int, end: int, kind: str) -> bytes | None:
    """The 8-bit samples of a file in one of the four lossless forms that `encode` writes."""
    if kind == "audio/wav":
        p = at + 12
        while blob[p : p + 4] != b"data":
            p += 8 + (n := int.from_bytes(blob[p + 4 : p + 8], "little")) + n % 2
        return blob[p + 8 : p + 8 + int.from_bytes(blob[p + 4 : p + 8], "little")]
    if kind == "audio/basic":
        return blob[at + int.from_bytes(blob[at + 4 : at + 8], "big") : end]
    if kind == "image/bmp":
        first, _, width, height = struct.unpack_from("<IIii", blob, at + 10)
        step = (width + 3) // 4 * 4
        rows = [blob[at + first + y * step : at + first + y * step + width] for y in range(abs(height))]
        return b"".join(rows if height < 0 else rows[::-1])
    if kind == "image/png":
        p, parts = at + 8, []
        width, height = struct.unpack_from(">II", blob, at + 16)
        while p < end:
            n = int.from_bytes(blob[p : p + 4], "big")
            if blob[p + 4 : p + 8] == b"IDAT":
                parts.append(blob[p + 8 : p + 8 + n])
            p += 12 + n
        lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
        return lines[:, 1:].tobytes() if not lines[:, 0].any() else None
    return None


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, kind: str) -> bytes:
    """The payload (a multiple of 64 bytes) as 8-bit samples: mono sound or a grey picture 64 wide."""
    n, height = len(payload), len(payload) // ROW
    if kind == "audio/wav":
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload
    if kind == "audio/basic":
        return b".snd" + struct.pack(">5I", 24, n, 2, 8000, 1) + payload
    if kind == "image/bmp":
        grey = bytes(v for i in range(256) for v in (i, i, i, 0))
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 1078 + n, 0, 1078, 40, ROW, -height, 1, 8, 0, n, 2835, 2835, 256, 0) + grey + payload
    lines = np.zeros((height, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


#: What the table says of its texts; sniffing corrects it for the stored forms.
DECLARED = "text/plain"
FORMS = ("audio/wav", "audio/basic", "image/bmp", "image/png")


def padded(raw: bytes) -> bytes:
    return raw + bytes(ROW - len(raw) % ROW if len(raw) % ROW or not raw else 0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            raw = batch.column(1)[i].as_buffer().to_pybytes()
            payload = padded(raw)
            stored = encode(payload, FORMS[zlib.crc32(payload) % len(FORMS)])
            kind, top, inner = examine(stored, DECLARED, machine)
            at, end, _ = top[0]
            back = samples(stored, at, end, kind)
            shape = f"{ROW}x{len(back) // ROW}" if kind.startswith("image") else f"1x{len(back)}"
            rows.append((batch.column(0)[i].as_py(), len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), end - at, hashlib.sha256(stored[at:end]).hexdigest(), f"{kind} {shape} declared={DECLARED} inner={inner}"))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(_features, schema)


def sniff(df: DataFrame, key: str, blob: str, declared: str | None = None) -> DataFrame:
    """For each row: key, declared and true type, whether the declaration was right, and the carved files (start, end, type, bytes)."""
    from pyspark.sql import functions as F

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for frame in frames:
            out = []
            for k, b, said in zip(frame["key"], frame["blob"], frame["declared"], strict=True):
                b = b or b""
                true, top, _ = examine(b, said, machine)
                out.append((k, said, true, bool(true == said), [(s, e, t, b[s:e]) for s, e, t in top if s > 0]))
            yield pd.DataFrame(out, columns=["key", "declared_type", "true_type", "declared_right", "carved"])

    ship(df.sparkSession)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(blob).cast("binary").alias("blob"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("declared"))
    return rows.mapInPandas(go, "key string, declared_type string, true_type string, declared_right boolean, carved array<struct<start:long,end:long,type:string,data:binary>>")
