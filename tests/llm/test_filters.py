"""Filter audit against a replay of every order, document by document."""

from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from lorespark.llm import filters, queries

SF = "/root/testdata/sf0.001"


def replay(docs, labels, limits):
    """Rows by (part, order, step), each filter applied to each document in turn."""
    import re

    rows = []
    for d, t, p in docs:
        text = t or ""
        w = [x for x in re.split(r"[ \t-\r]+", text) if x]
        fails = {"A": len(w) < limits.least_words, "B": 100 * len(set(w)) < limits.distinct_percent * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > limits.capital_percent * len(text), "D": bool(re.search("[#$%&*|]", text))}
        fails["E"] = d is not None and any(e is not None and e < d and (u or "") == text for e, u, _ in docs)
        marks = [m for m in labels if m[0] == d and d is not None]
        rows.append((p or "", fails, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                before = [r for r in rows if r[0] == part and r[1][x] and any(r[1][y] for y in order[: step - 1])]
                left = [r for r in left if not r[1][x]]
                alone = [r for r in rows if r[0] == part and r[1][x] and sum(r[1].values()) == 1]
                out[part, order, step] = (len(left), len(gone), len(before), len(alone), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def table(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def test_every_order_and_step(spark):
    limits = filters.Limits(3, 60, 20)
    docs = [
        (1, "one two three four", "a"),
        (2, "one two three four", "b"),
        (3, "A B # x x x x", "a"),
        (4, None, "a"),
        (5, "", None),
        (6, "x x x x", "a"),
        (7, "x x x x", "a"),
        (7, "x x x x", "a"),
        (6, "x x x x", "b"),
        (None, "one two three four", "a"),
        (None, None, None),
        (9, "long text of words " * 20_000, "b"),
        (10, "é  ünder\tx\x0bAb", "b"),
    ]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, 0), (7, 1, None), (None, 1, 1), (9, None, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*r, 0, "z") for r in docs], "doc_id long, text string, source string, mask int, part string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert table(filters.audit(frame, marks, limits)) == replay(docs, labels, limits)
    assert filters.audit(frame.limit(0), marks).count() == 0
    assert table(filters.audit(frame, marks.limit(0), limits))["a", "ABCDE", 1][4:6] == (0, 0)


def test_matrices_add_up():
    m = filters.incidence()
    assert all(x.shape == (32, 600) for x in m.values())
    for name in ("kept", "removed", "redundant", "unique"):
        assert set(m[name].ravel().tolist()) <= {0, 1}
    steps = m["removed"].reshape(32, 120, 5).sum(2)
    assert (steps[1:] == 1).all() and (steps[0] == 0).all() and (m["kept"].reshape(32, 120, 5)[:, :, 4] + steps == 1).all()


def test_query_equals_its_sql(spark):
    got = queries.op12_filter_audit(spark, SF)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(filters.ORACLE)
    assert got.columns == rel.columns
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
    assert got.groupBy("part").agg(F.count("*").alias("n")).where("n <> 600").count() == 0
