"""Hunks against plain longest common subsequences, and applied."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lorespark.operators import diffs


def put_in(old, hunks):
    out, at = [], 0
    for i, removed, j, added in hunks:
        out += old[at:i]
        assert len(out) == j and old[i : i + len(removed)] == removed
        out += added
        at = i + len(removed)
    return out + old[at:]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
def test_smallest_differences(letters):
    r = random.Random(len(letters))
    for _ in range(150):
        a, b = ([r.choice(letters) for _ in range(r.randrange(25))] for _ in range(2))
        hunks = diffs.hunks_of(a, b)
        assert put_in(a, hunks) == b
        assert sum(len(h[1]) for h in hunks) == len(a) - longest(a, b)
        for most in (0, 1, 3):
            assert put_in(a, diffs.hunks_of(a, b, most)) == b


def test_a_million_lines():
    old = [f"line {i}" for i in range(1_000_000)]
    new = [x for i, x in enumerate(old) if i % 100_000] + ["end"]
    new[5000:5000] = ["put in"] * 3
    start = time.time()
    hunks = diffs.hunks_of(old, new)
    assert put_in(old, hunks) == new and sum(len(h[1]) for h in hunks) == 10 and sum(len(h[3]) for h in hunks) == 4
    turned = old[500_000:] + old[:500_000]
    assert put_in(old, diffs.hunks_of(old, turned)) == turned
    assert put_in(old, diffs.hunks_of(old, [x + "!" for x in old])) == [x + "!" for x in old]
    assert time.time() - start < 120


def test_unified_form():
    import difflib

    r = random.Random(3)
    for _ in range(100):
        old = [f"{i}" for i in range(r.randrange(1, 30))]
        new = [x for x in old if r.random() < 0.9]
        for _ in range(r.randrange(3)):
            new.insert(r.randrange(len(new) + 1), "new")
        hunks = diffs.hunks_of(old, new)
        got = diffs.unified(old, hunks)
        want = [x.rstrip() if x[:3] in ("---", "+++") else x for x in difflib.unified_diff(old, new, lineterm="", n=1)]
        if "new" not in old and new.count("new") <= 1:
            assert got.split("\n") == want if want else got == ""


def test_hunks_applied_on_spark(spark):
    texts = ["", "a", "a\nb\nc", "a\n\nb\n", "x\ny", "c\nb\na", None]
    rows = [(f"{i}-{j}", a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "id string, old string, new string")
    got = diffs.hunks(pairs).withColumnRenamed("id", "k")
    back = {r["id"]: r["text"] for r in pairs.join(got, F.col("id") == F.col("k")).select("id", diffs.applied(F.col("old"), F.col("hunks")).alias("text")).collect()}
    assert back == {k: b or "" for k, _, b in rows}
