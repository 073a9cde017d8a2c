"""Values compressed one by one, with a header that says how.

A value of ``least`` bytes or more is compressed, a smaller one stays as it is; either has a
header of three bytes, so that a column may hold values of several codecs and is read back without being told which.
Tables of such values are partitioned by codec, so that a reader that wants one codec opens its folder only.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ship
from .tables import folder, spread, table

MARK = b"\xf5\x4c"
#: Codecs by the byte that stands for them; 0 is a value as it is.
CODECS = {"gzip": (1, lambda b: gzip.compress(b, 6, mtime=0), gzip.decompress), "zlib": (2, zlib.compress, zlib.decompress), "bz2": (3, bz2.compress, bz2.decompress), "lzma": (4, lzma.compress, lzma.decompress)}
_READ = {n: read for n, _, read in CODECS.values()}


def packed(value: bytes | None, codec: str, least: int = 1024) -> bytes | None:
    if value is None:
        return None
    number, write, _ = CODECS[codec]
    return MARK + (bytes([number]) + write(value) if len(value) >= least else b"\0" + value)


def unpacked(value: bytes | None) -> bytes | None:
    """The value of ``packed``; ValueError where there is no such header."""
    if value is None:
        return None
    if value[:2] != MARK or len(value) < 3 or (value[2] and value[2] not in _READ):
        raise ValueError("not a packed value")
    return _READ[value[2]](value[3:]) if value[2] else value[3:]


def _over(df: DataFrame, schema: str, names: list[str], change) -> DataFrame:
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            out = pa.array([change(*x) for x in zip(*(batch.column(n).to_pylist() for n in names), strict=True)], pa.binary())
            at = batch.schema.names.index(names[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], out, *batch.columns[at + 1 :]], batch.schema.names)

    return df.mapInArrow(run, schema)


def _schema(df: DataFrame, name: str) -> str:
    return ", ".join(f"`{f.name}` {'binary' if f.name == name else f.dataType.simpleString()}" for f in df.schema)


def pack(df: DataFrame, name: str, codec_col: str, least: int = 1024) -> DataFrame:
    """``df`` with the values of a string or binary column packed, by the codec that each row names; a null stays null."""
    df = df.withColumn(name, F.col(name).cast("binary"))
    return _over(df, _schema(df, name), [name, codec_col], lambda v, c: packed(v, c, least))


def unpack(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the bytes of a packed column."""
    return _over(df, _schema(df, name), [name], unpacked)


def save(df: DataFrame, path: str, name: str, codec_col: str, least: int = 1024) -> None:
    """``df`` with a packed column as Parquet in a folder for each codec; Parquet's own compression is left off."""
    pack(df, name, codec_col, least).write.option("compression", "none").partitionBy(codec_col).parquet(path)


def load(spark: SparkSession, path: str, name: str, codec_col: str, codec: str | None = None) -> DataFrame:
    """What ``save`` wrote, unpacked; of one codec where it is given."""
    df = spark.read.parquet(path)
    return unpack(df.where(F.col(codec_col) == codec) if codec else df, name)


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, codec, is_packed, n_bytes, text_sha256): every text written, read back and told by its digest."""
    path = f"{folder(docs.sparkSession)}/values-{uuid.uuid4().hex}"
    codec = F.element_at(F.array(*map(F.lit, CODECS)), (F.pmod("doc_id", F.lit(len(CODECS))) + 1).cast("int"))
    save(docs.select("doc_id", "text", codec.alias("codec")), path, "text", "codec")
    stored = docs.sparkSession.read.parquet(path).select("doc_id", (F.substring("text", 3, 1) != F.lit(b"\0")).alias("is_packed"))
    back = load(docs.sparkSession, path, "text", "codec").select("doc_id", "codec", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
    return back.join(stored, "doc_id")


QUERIES = {"io_packed_values": lambda s, d: round_trip(spread(table(s, d, "documents")))}
ORACLE = {"io_packed_values": f"SELECT doc_id, [{', '.join(repr(c) for c in CODECS)}][doc_id % {len(CODECS)} + 1] AS codec, octet_length(encode(text)) >= 1024 AS is_packed, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"}
