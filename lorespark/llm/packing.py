"""Best-fit packing of tokenised documents into sequences, by bin completion.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of piece
lengths (at most ``capacity`` numbers) reaches the driver, where ``binpack`` finds the
fillings; each piece then takes the slot that its rank among the pieces of its length
names.  Ranks come from salted groups whose sizes are summed, so that one length may hold
any share of all pieces.

Defined results: a null text counts as empty and packs as the end token alone; repeated
rows are packed as often as they come; extra columns of the input are not carried.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import binpack, tokens
from .common import Table, crc32, ship, tidy

_log = logging.getLogger(__name__)
#: Pieces of one length that one task ranks.
RANKED = 200_000


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones last, the rest first."""
    first = length % capacity or capacity
    return [(0, min(first, length))] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]) for each piece of each document."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([rows.schema.fields[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), *extra])

    def run(batches):
        path = tokenizer or tokens.default_path()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                of, out, ids = [], [], []
                for i, text in enumerate(some.column(1)):
                    doc = np.append(tokens.encode(text.as_py() or "", path), np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(doc), capacity)):
                        part = doc[start : start + length]
                        of.append(i)
                        out.append((k, start, length, crc32(part.tobytes())))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                cols = [some.column(0).take(pa.array(of, pa.int64())), *[pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], schema.names)

    return rows.mapInArrow(tidy(run), schema)


def _slots(packing: binpack.Packing) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, past the last, first sequence, of it in each, offset): the slots of a length, by rank."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for filling, bins in packing:
        offset = 0
        for size in sorted(set(filling), reverse=True):
            each = filling.count(size)
            low = taken.get(size, 0)
            out.append((size, low, low + each * bins, sequence, each, offset))
            taken[size] = low + each * bins
            offset += each * size
        sequence += bins
    return out


def assign(parts: DataFrame, *, id_col: str = "doc_id", capacity: int = 1024, work: int = 250_000) -> DataFrame:
    """``parts`` (a table that reads back alike) with sequence_id and offset."""
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    packing, bound, proved = binpack.pack(counts, capacity, work)
    _log.info("%d sequences, at least %d needed%s", binpack.bins_of(packing), bound, ", none fewer possible" if proved else "")
    # Fillings number a few for each length, whatever the number of documents; so do the slots.
    slots = spark.createDataFrame(_slots(packing), "s_length long, low long, high long, sequence long, each long, at long")
    salts = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (int(k), -(-n // RANKED))]) if counts else F.create_map(F.lit(0), F.lit(1)).cast("map<bigint,int>")
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64(id_col, "piece"), salts[F.col("length")]).cast("int"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(id_col, "piece"))
    ranked = salted.withColumn("__k", within - 1).join(starts, ["length", "__salt"]).withColumn("__rank", F.col("__first") + F.col("__k"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("s_length")) & (F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("high")))
    nth = F.col("__rank") - F.col("low")
    return placed.select(*parts.columns, (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, work: int = 250_000, **how) -> DataFrame:
    """Documents as placed pieces; tokenised once, into a table of the shared folder."""
    parts = Table(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, **how), "pack-pieces").df
    return assign(parts, id_col=id_col, capacity=capacity, work=work)
