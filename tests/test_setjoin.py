"""Set-similarity join against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lorespark.operators import history, search, setjoin


def plain(rows, least):
    t, out = Fraction(str(least)), []
    sets = [(i, {x for x in s or [] if x is not None}) for i, s in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i != j and a & b and len(a & b) >= t * len(a | b):
                out.append((min(i, j), max(i, j), len(a & b), round(len(a & b) / len(a | b), 6)))
    return sorted(out)


def sets_of(seed, n=150):
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, 81)
    rows = []
    for i in range(n):
        k = int(rng.integers(1, 25))
        rows.append((i, [f"w{x}" for x in rng.choice(80, k, p=weights / weights.sum())]))
    for i in range(n, n + 30):  # near copies
        own = list(dict.fromkeys(rows[i - n][1]))
        rows.append((i, own[1:] + [f"own{i}"]))
    return rows + [(500, None), (501, []), (502, [None]), (503, ["w0", None]), (504, ["w0"]), (504, ["w0", "w1"]), (None, ["w0"])]


@pytest.mark.parametrize("least", [0, 0.2, 0.3, 0.8])
def test_equals_all_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(setjoin, "CELL", 10)  # common elements go to many cells
    rows = sets_of(int(100 * least))
    df = spark.createDataFrame(rows, "id long, terms array<string>").repartition(3)
    got = sorted(map(tuple, setjoin.jaccard_pairs(df, least).collect()))
    assert got == plain(rows, least)


def test_few_common_elements_known(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HEAVY", 3)
    rows = sets_of(9)
    df = spark.createDataFrame([(f"id{i}" if i is not None else None, s) for i, s in rows], "id string, terms array<string>")
    assert sorted(map(tuple, setjoin.jaccard_pairs(df, 0.3).collect())) == plain([(f"id{i}" if i is not None else None, s) for i, s in rows], 0.3)


def test_no_sets(spark):
    assert setjoin.jaccard_pairs(spark.createDataFrame([], "id long, terms array<string>"), 0.3).count() == 0
    assert setjoin.jaccard_pairs(spark.createDataFrame([(1, ["a"])], "id long, terms array<string>"), 0.3).count() == 0


def test_most_related_documents(spark):
    docs = spark.createDataFrame([(1, "river water boat shore"), (2, "river water boat"), (3, "river boat engine wheel"), (4, "flour oven"), (5, None)], "doc_id long, text string")
    got = [tuple(r) for r in search.most_related(docs, top=1, least=0.3).orderBy("doc_id").collect()]
    assert got == [(1, 1, 2, 0.75), (2, 1, 1, 0.75), (3, 1, 2, 0.4)]


def test_users_alike(spark):
    days = {1: [1, 2, 3], 2: [1, 2, 3, 4], 3: [4], 4: [9], 5: [1, 10, 11, 12, 13]}
    rows = [(u, f"2024-01-{d:02d} 0{h}:00:00", "purchase") for u, ds in days.items() for d in ds for h in (1, 2)] + [(3, "2024-01-01 00:00:00", "view"), (None, "2024-01-01 00:00:00", "purchase")]
    events = spark.createDataFrame(rows, "user_id long, t string, event_type string").selectExpr("user_id", "cast(t as timestamp_ntz) as ts", "event_type")
    got = sorted(tuple(r) for r in history.similar_users(events).collect())
    assert got == [(1, 2, 0.75, 1), (2, 1, 0.75, 1), (2, 3, 0.25, 2), (3, 2, 0.25, 1)]


def test_sources_by_shared_tags(spark):
    docs = spark.createDataFrame([("a", "spark table"), ("a", "index"), ("b", "table index"), ("c", "engine"), (None, "engine table")], "source string, text string")
    assert [tuple(r) for r in search.related_sources(docs).collect()] == [("a", "b", 2, round(2 / 3, 6))]


@pytest.mark.parametrize("top,least", [(3, 0.2), (1, 0.0), (2, 0.6)])
def test_most_alike_makes_no_pairs(spark, monkeypatch, top, least):
    monkeypatch.setattr(setjoin, "CLASSES", 7)
    monkeypatch.setattr(setjoin, "jaccard_pairs", None)
    rng = random.Random(top)
    base = [sorted(rng.sample(range(12), rng.randint(1, 8))) for _ in range(60)]
    rows = [(500 - i, base[i % 60]) for i in range(180)] + [(None, [1, 2]), (900, []), (901, None), (902, [None, 3])]
    got = sorted(map(tuple, setjoin.most_alike(spark.createDataFrame(rows, "id long, terms array<int>"), top, least).collect()))
    sets = [(i, {x for x in t or () if x is not None}) for i, t in rows if i is not None]
    want = []
    for i, s in sets:
        alike = sorted((-round(len(s & t) / len(s | t), 6), j) for j, t in sets if j != i and s & t)
        want += [(i, r, j, -v) for r, (v, j) in enumerate([x for x in alike if -x[0] > least][:top], 1)]
    assert got == sorted(want)


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "CELL", 10)
    monkeypatch.setattr(setjoin, "COUNTED", 7)  # what blocks share is counted in many steps
    rows = sets_of(5)
    got = setjoin.jaccard_pairs(spark.createDataFrame(rows, "id long, terms array<string>"), 0.2)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == plain(rows, 0.2)


@pytest.mark.parametrize("top,least", [(1, 0), (3, 0.2), (500, 0.3)])
def test_best_of_each_set(spark, monkeypatch, top, least):
    monkeypatch.setattr(setjoin, "CELL", 10)
    monkeypatch.setattr(setjoin, "HEAVY", 3)
    monkeypatch.setattr(setjoin, "jaccard_pairs", None)
    rows = sets_of(7)[:-2]
    rows = [r for r in rows if r[0] != 504]  # ids once
    got = sorted(map(tuple, setjoin.jaccard_best(spark.createDataFrame(rows, "id long, terms array<string>"), top, least).collect()))
    by = {}
    for a, b, _, v in plain(rows, least):
        by.setdefault(a, []).append((-v, b))
        by.setdefault(b, []).append((-v, a))
    assert got == sorted((i, r, j, -v) for i, found in by.items() for r, (v, j) in enumerate(sorted(found)[:top], 1))


def test_common_middle_and_rare_elements(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HEAVY", 4)
    monkeypatch.setattr(setjoin, "MIDDLE", 20)
    monkeypatch.setattr(setjoin, "CELL", 10)
    monkeypatch.setattr(setjoin, "LONG", 2)  # many tiles
    rows = sets_of(13)
    df = spark.createDataFrame(rows, "id long, terms array<string>")
    assert sorted(map(tuple, setjoin.jaccard_pairs(df, 0.25).collect())) == plain(rows, 0.25)


def test_few_pairs_are_compared_closely(monkeypatch):
    rng = np.random.default_rng(3)
    # Elements by how common they are: twenty in most sets, eighty in one of four, others in few.
    made = [np.unique(np.concatenate([np.flatnonzero(rng.random(100) < np.repeat([0.8, 0.25], [20, 80])), rng.integers(100, 4000, 50)])) for _ in range(120)]
    made += [np.append(x[3:], 5000 + i) for i, x in enumerate(made[:30])]
    st = pa.StructArray.from_arrays([pa.array(range(150)), pa.array([x.tolist() for x in made], pa.list_(pa.int64()))], ["id", "hashes"])
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.ListArray.from_arrays([0, 150], st)], ["block", "sets"])
    x = setjoin._read(next(setjoin._packed(np.arange(100))([batch])), 0)
    looked, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda a: looked.append(len(a)) or count(a))
    least = Fraction("0.5")
    a, b = (y | setjoin._common_parts(y, least, 20, 100, first) for y, first in ((setjoin._by_set(x), True), (x, False)))
    got = sorted(zip(*(v.tolist() for v in setjoin._close(a, b, least, 1000)), strict=True))
    sets = [set(v.tolist()) for v in made]
    assert got == sorted((i, j, len(s & t)) for i, s in enumerate(sets) for j, t in enumerate(sets) if len(s & t) >= least * len(s | t))
    assert len(got) >= 210 and sum(looked) < 4 * len(got)


def test_best_by_common_middle_and_rare_elements(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HEAVY", 4)
    monkeypatch.setattr(setjoin, "MIDDLE", 20)
    monkeypatch.setattr(setjoin, "CELL", 10)
    monkeypatch.setattr(setjoin, "LONG", 2)
    rows = [r for r in sets_of(17) if r[0] != 504]
    got = sorted(map(tuple, setjoin.jaccard_best(spark.createDataFrame(rows, "id long, terms array<string>"), 2, 0.3).collect()))
    by = {}
    for a, b, _, v in plain(rows, 0.3):
        by.setdefault(a, []).append((-v, b))
        by.setdefault(b, []).append((-v, a))
    assert got == sorted((i, r, j, -v) for i, found in by.items() for r, (v, j) in enumerate(sorted(found)[:2], 1))
