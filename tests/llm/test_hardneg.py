"""Hard negatives against all pairs in Python's integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import hardneg, queries


def plain(rows, rule, anchor):
    part = []
    for i, vec, label in rows:
        if i is None or label is None or not vec or any(x is None or not math.isfinite(x) for x in vec):
            continue
        ints = [math.floor(rule.scale * x) for x in vec]
        if sum(x * x for x in ints) < 1 << 62:
            part.append((i, ints, label))
    out = []
    for n, (i, a, la) in enumerate(part):
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), j, m, lb) for m, (j, v, lb) in enumerate(part) if m != n and len(v) == len(a))
        for s, p, _, _ in [x for x in scored if x[3] == la][: rule.positives]:
            fit = [(j, -t) for t, j, _, lb in scored if lb != la and rule.low * -s <= 100 * -t <= rule.high * -s]
            out += [(i, p, r, j, -s, t) for r, (j, t) in enumerate(fit[: rule.negatives], 1)]
    return sorted(out)


def mined(df, rule):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in hardneg.mine(df, F.col("vec_id") % 10 == 0, rule).collect())


@pytest.mark.parametrize("seed,dim", [(1, 5), (2, 16), (3, 33), (4, 1)])
def test_equals_all_pairs(spark, seed, dim, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 40)
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    rows = []
    for i in range(220):
        c = int(rng.integers(0, 4))
        rows.append((i, (0.7 * centre[c] + 0.5 * rng.normal(size=dim) + 0.3).astype(np.float32).tolist(), int(rng.integers(0, 3))))
    rows += [(230 + k, rows[k][1], rows[k][2]) for k in range(0, 40, 4)]  # ties
    rows += [(40, rows[3][1], 1), (40, rows[5][1], 1), (300, None, 1), (310, [1.0, None, *[0.0] * dim], 1), (320, [math.nan] * dim, 1), (330, [], 1), (340, rows[1][1], None), (None, rows[1][1], 1)]
    rows += [(350, [1.0, *[0.5] * dim], 1), (351, [1.0, *[0.25] * dim], 1), (352, [0.75, *[0.25] * dim], 2), (360, [0.0] * dim, 1), (370, [math.inf] * dim, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x")).withColumn("p", F.lit(1)).repartition(3)
    rule = hardneg.Rule()
    assert mined(df, rule) == plain(rows, rule, lambda i: i % 10 == 0)


def test_large_components_and_narrow_rules(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) * 10.0 ** float(rng.integers(-3, 6)) + 100).tolist(), i % 2) for i in range(80)]
    rows += [(90, [1e300] * 8, 0), (91, [3e7] * 8, 1), (100, [5e6] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for rule in (hardneg.Rule(), hardneg.Rule(16, 2, 1, 0, 100), hardneg.Rule(positives=1, negatives=9, low=-100, high=30)):
        assert mined(df, rule) == plain(rows, rule, lambda i: i % 10 == 0)


def test_bounds_hold_the_exact_products():
    rng = np.random.default_rng(3)
    for size in (3, 1000, 1 << 29):
        a, v = (rng.integers(-size, size, (50, 24)) for _ in range(2))
        both = hardneg.Rotated(a, v)
        s = a @ v.T
        i, j = both.survivors(np.arange(50), np.arange(50), None, np.quantile(s, 0.9, axis=1), None)
        kept = set(zip(i.tolist(), j.tolist(), strict=True))
        assert {(x, y) for x, y in zip(*np.nonzero(s >= np.quantile(s, 0.9, axis=1)[:, None]), strict=True)} <= kept and len(kept) < 2500
        assert (both.exact(i, j) == s[i, j]).all()


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert mined(df, hardneg.Rule()) == [] and mined(df.limit(0), hardneg.Rule()) == []


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = queries.op13_hard_negatives(spark, sf)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(hardneg.ORACLE).fetchall())


def test_no_block_is_broadcast(spark):
    rows = [(i, [float((i * k) % 13 - 6) for k in range(1, 9)], i % 3) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    plan = hardneg.mine(vectors, F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
