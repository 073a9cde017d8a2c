"""The version store batch by batch, against all rows at once."""

import random
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorespark.operators import store
from lorespark.sources import tables

DAY = datetime(2024, 1, 1)


def plain(rows, keep):
    out, seen = {}, {}
    for key, at, tie, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        if seen.get(key) != (text or ""):
            seen[key] = text or ""
            out.setdefault(key, []).append((len(out.get(key, [])) + 1, tie, text or ""))
    return sorted((k, v, t, x) for k, vs in out.items() for v, t, x in vs[-keep:])


def test_batches_equal_all_rows_at_once(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", "c", None]), DAY + timedelta(hours=i // 2), i, r.choice(["x", "y", "z", "", None])) for i in range(200)]
    made = store.VersionStore(spark, f"{tables.folder(spark)}/store-{uuid.uuid4().hex}", keep=4)
    assert made.versions().count() == 0 and made.generation() == 0
    for k in range(0, 200, 50):
        batch = spark.createDataFrame(rows[k : k + 50], "key string, at timestamp, tie long, text string").repartition(3)
        assert made.apply(batch) == k // 50 + 1
    got = made.versions().join(made.contents(), "digest").collect()
    assert sorted((x["key"], x["version"], x["tie"], x["text"]) for x in got) == plain(rows, 4)
    assert made.contents().count() == len({x[3] or "" for x in rows}) and made.manifest().count() == 4
    assert made.apply(spark.createDataFrame([], "key string, at timestamp, tie long, text string")) == 5
    assert sorted((x["key"], x["version"]) for x in made.texts().collect()) == [(k, v) for k, v, _, _ in plain(rows, 4)]


def test_a_batch_that_was_cut_off_is_applied_again(spark):
    made = store.VersionStore(spark, f"{tables.folder(spark)}/store-{uuid.uuid4().hex}")
    first = spark.createDataFrame([("a", DAY, 1, "x")], "key string, at timestamp, tie long, text string")
    made.apply(first)
    spark.createDataFrame([("half", 1, DAY, 1, "d")], store.VERSIONS).write.parquet(f"{made.path}/versions/2")  # no manifest row
    assert [x["key"] for x in made.versions().collect()] == ["a"]
    made.apply(spark.createDataFrame([("a", DAY, 2, "x"), ("b", DAY, 3, None)], "key string, at timestamp, tie long, text string"))
    assert sorted((x["key"], x["version"], x["text"]) for x in made.texts().collect()) == [("a", 1, "x"), ("b", 1, "")]


def test_versions_as_of_a_time(spark):
    rows = [("a", 1, DAY, 1, "d1"), ("a", 2, DAY + timedelta(days=2), 2, "d2"), ("b", 5, DAY + timedelta(days=9), 3, "d3")]
    asked = [("a", DAY + timedelta(days=1)), ("a", DAY + timedelta(days=2)), ("a", DAY - timedelta(days=1)), ("b", DAY), ("zz", DAY)]
    got = store.as_of(spark.createDataFrame(rows, store.VERSIONS), spark.createDataFrame(asked, "key string, asked_at timestamp")).collect()
    assert {(r["key"], r["asked_at"]): (r["version"], r["digest"]) for r in got} == {asked[0]: (1, "d1"), asked[1]: (2, "d2"), asked[2]: (None, None), asked[3]: (None, None), asked[4]: (None, None)}


def test_registry_of_versions(spark):
    rows = [("lib", "1.0", "u1", True, 1), ("lib", "1.1", "u2", True, 2), ("lib", "1.0", "u3", False, 3), ("other", "2", "u4", False, 4), ("late", "1", "u5", True, 5), ("late", "1", "u6", False, 6)]
    frame = spark.createDataFrame(rows, "library string, version string, url string, is_latest boolean, seq long")
    registry = store.registered(frame, F.col("seq"))
    assert sorted(map(tuple, registry.collect())) == [("late", "1", "u6", False), ("lib", "1.0", "u3", False), ("lib", "1.1", "u2", True), ("other", "2", "u4", False)]
    asked = spark.createDataFrame([(1, "lib", "1.1"), (2, "lib", "9"), (3, "none", "1"), (4, "lib", None)], "id long, library string, version string")
    bases = spark.createDataFrame([("lib", "https://lib.example/")], "library string, base_url string")
    got = {r["id"]: (r["url"], r["is_registered"], r["is_latest"]) for r in store.doc_urls(asked, registry, bases).collect()}
    assert got == {1: ("u2", True, True), 2: ("https://lib.example/", False, False), 3: (None, False, False), 4: ("https://lib.example/", False, False)}
