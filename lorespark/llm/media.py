"""Media columns: GIF bytes, and timed frames with colour histograms read back from them.

Defined results: a null text is an empty payload, padded like any other; equal texts give
equal bytes; texts of any length are stored whole, in as many frames as they need.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gif
from .common import ship

FRAMES = "array<struct<frame:int,start_ms:long,delay_ms:long,left:int,top:int,width:int,height:int,disposal:int,transparent:int,histogram:array<long>>>"
_FRAME = pa.list_(pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), *[(x, pa.int32()) for x in ("left", "top", "width", "height", "disposal", "transparent")], ("histogram", pa.list_(pa.int64()))]))
UNIT = 192
#: Rows that leave a task together.
ROWS = 256


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b" ")


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): texts as the samples of grey GIF frames."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__bytes"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                raw = [x.as_py() for x in batch.column(1)]
                media = pa.array([gif.encode(padded(x), UNIT) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), media], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def read(stored: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id_col, n_bytes, media, samples, frames) of a table of GIFs; bytes that are no GIF give nulls."""
    ship(stored.sparkSession)
    rows = stored.select(id_col, "n_bytes", F.col(media_col).alias("media"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                samples, frames = [], []
                for value in batch.column(2):
                    try:
                        found = gif.decode(value.as_py() or b"")
                    except (ValueError, IndexError):
                        samples.append(None)
                        frames.append(None)
                        continue
                    samples.append(b"".join(f.drawn()[..., 0].tobytes() for f in found))
                    start, rows = 0, []
                    for f in found:
                        rows.append({"frame": f.index, "start_ms": start, "delay_ms": 10 * f.delay_cs, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "transparent": f.transparent, "histogram": gif.histogram(f)})
                        start += 10 * f.delay_cs
                    frames.append(rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(samples, pa.binary()), pa.array(frames, _FRAME)], [id_col, "n_bytes", "media", "samples", "frames"])

    kind = stored.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary, samples binary, frames {FRAMES}")


def feature(frames: Column) -> Column:
    """Number of frames, duration and the summed colour histogram, as text."""
    total = F.aggregate(frames, F.array_repeat(F.lit(0).cast("long"), 48), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    length = F.aggregate(frames, F.lit(0).cast("long"), lambda acc, f: acc + f["delay_ms"])
    return F.concat_ws(";", F.concat(F.lit("frames="), F.size(frames).cast("string")), F.concat(F.lit("ms="), length.cast("string")), F.concat(F.lit("rgb="), F.array_join(total.cast("array<string>"), ",")))
