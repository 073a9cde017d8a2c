"""Packed values: headers, every codec, folders by codec."""

import uuid

import pytest

from lorespark.sources import codecs, tables


@pytest.mark.parametrize("codec", list(codecs.CODECS))
@pytest.mark.parametrize("value", [b"", b"x", b"y" * 1023, b"z" * 1024, bytes(range(256)) * 40, codecs.MARK + b"\1looks packed"])
def test_values_there_and_back(codec, value):
    made = codecs.packed(value, codec)
    assert codecs.unpacked(made) == value and (made[2] != 0) == (len(value) >= 1024)
    assert codecs.packed(value, codec) == made  # the same bytes each time


def test_what_is_no_packed_value():
    assert codecs.packed(None, "gzip") is None and codecs.unpacked(None) is None
    for value in (b"", b"plain", codecs.MARK, codecs.MARK + b"\x09abc"):
        with pytest.raises(ValueError):
            codecs.unpacked(value)


def test_tables_by_codec(spark):
    rows = [(1, "short", "gzip", 7), (2, "long " * 999, "gzip", 8), (3, "long " * 999, "lzma", None), (4, None, "bz2", 1), (5, "é" * 600, "zlib", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, codec string, codec_n int")
    path = f"{tables.folder(spark)}/packed-{uuid.uuid4().hex}"
    codecs.save(df, path, "text", "codec")
    back = {r["doc_id"]: (r["text"].decode() if r["text"] is not None else None, r["codec"], r["codec_n"]) for r in codecs.load(spark, path, "text", "codec").collect()}
    assert back == {i: (t, c, n) for i, t, c, n in rows}
    one = codecs.load(spark, path, "text", "codec", "gzip")
    assert sorted(r["doc_id"] for r in one.collect()) == [1, 2] and "codec" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    for n in (1, 2):
        tables.append(df.drop("text"), f"{path}-log", "codec")
        assert spark.read.parquet(f"{path}-log").count() == 5 * n
    tables.write_json(df, f"{path}-json")
    assert sorted(map(str, tables.read_json(spark, f"{path}-json", "doc_id long, text string, codec string, codec_n int").collect())) == sorted(map(str, df.collect()))
    files = tables.text_files(spark, f"{path}-json/part*").collect()
    assert all(r["status"] == 200 and "doc_id" in r["html"] for r in files if r["html"])
