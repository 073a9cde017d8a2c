"""Helpers shared by the training-data operators.

Everything that has to outlive a task goes to a table in the folder named by
``spark.checkpoint.dir``; nothing is kept on one machine.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
_LOCAL_SCRATCH: list[str] = []
#: Settings of batches, where the session has Spark's own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    # Batches of whole texts: bounded in bytes, so that long ones do not pile up in a task.
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) in (None, "10000", "67108864b"):
            spark.conf.set(name, value)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a private one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="lorespark-"))
    return f"file://{_LOCAL_SCRATCH[0]}"


def tidy(run):
    """``run`` over batches, giving freed memory back at its end: workers outlive their tasks, several to an executor."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


class Table:
    """A DataFrame written once to the shared folder and read back, with its path."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def utf8(column: pa.Array | pa.ChunkedArray):
    """The values of a string column as zero-copy uint8 arrays; None for nulls."""
    for arr in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if pa.types.is_null(arr.type):
            yield from (None for _ in range(len(arr)))
            continue
        wide = arr.type in (pa.large_string(), pa.large_binary())
        _, offs, data = arr.buffers()
        if offs is None or len(arr) == 0:
            yield from (None for _ in range(len(arr)))
            continue
        o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].tolist()
        b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        valid = None if arr.null_count == 0 else arr.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(arr)):
            yield None if valid is not None and not valid[i] else b[o[i] : o[i + 1]]


def crc32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
