"""What the training-data operators share: scratch tables, shipping of the package, batches of texts."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles together (documents are never split, so a longer one makes a longer pass).
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local mode only) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


class Scratch:
    """Tables written in the shared folder; reading one back cuts the lineage, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
        self.used = 0

    def path(self, name: str) -> str:
        self.used += 1
        return f"{self.root}/{self.used:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table made here that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark delete shuffle files of finished steps."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    folder = tempfile.mkdtemp(prefix="millrace-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "millrace_package.zip")
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)
    sc._millrace_shipped = True


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, null texts empty: extra columns, whatever their names, never reach an operator."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def bucket(key: str = "doc_id"):
    """crc32 of the key written as text, mod 5; 0 is the held-out fold."""
    return F.crc32(F.col(key).cast("string")) % 5


def chunks(batches: Iterable[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, UTF-8 texts) of about so many bytes each."""
    ids: list = []
    held: list[bytes] = []
    size = 0
    for batch in batches:
        keys = batch.column(0).to_pylist()
        column = batch.column(1)
        for i, key in enumerate(keys):
            value = column[i].as_buffer()
            raw = value.to_pybytes() if value is not None else b""
            ids.append(key)
            held.append(raw)
            size += len(raw)
            if size >= most:
                yield ids, held
                ids, held, size = [], [], 0
    if ids:
        yield ids, held


def joined(held: list[bytes], gap: bytes = b"\0") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one uint8 array with `gap` after each; where each starts and ends."""
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    starts = np.zeros(len(held), np.int64)
    np.cumsum(lengths[:-1] + len(gap), out=starts[1:])
    data = np.frombuffer(gap.join(held) + gap, np.uint8)
    return data, starts, starts + lengths
