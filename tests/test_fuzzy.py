"""Fuzzy join against all pairs."""

import random

import pytest

from lorespark.operators import fuzzy


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(r, word, n, letters):
    w = list(word)
    for _ in range(n):
        i = r.randrange(len(w) + 1)
        kind = r.randrange(3)
        if kind == 0:
            w.insert(i, r.choice(letters))
        elif w and kind == 1:
            w.pop(min(i, len(w) - 1))
        elif w:
            w[min(i, len(w) - 1)] = r.choice(letters)
    return "".join(w)


@pytest.mark.parametrize("seed,most", [(1, 1), (2, 2), (3, 2)])
def test_equals_all_pairs(spark, seed, most):
    r = random.Random(seed)
    letters = "abcé😀"
    known = {"".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 4, 6, 9, 18, 19, 20, 21, 22, 23, 24, 40, 90]))) for _ in range(120)}
    asked = {changed(r, w, r.randrange(4), letters) for w in sorted(known) for _ in range(2)} | {"", "zzz"}
    a = spark.createDataFrame([(w,) for w in asked] + [(None,), ("zzz",)], "word string")
    b = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(known))] + [(None, -1), ("", -2)], "term string, n long")
    got = sorted((x["word"], x["term"], x["edits"]) for x in fuzzy.fuzzy_join(a, b, most).collect())
    assert got == sorted((w, t, edits(w, t)) for w in asked for t in known if w and edits(w, t) <= most)


def test_order_of_suggestions(spark):
    found = spark.createDataFrame([("tab", "table", 5, 2), ("tab", "tabs", 5, 1), ("tab", "stab", 9, 1), ("tab", "tap", 99, 1), ("tab", "cab", 99, 1)], "word string, term string, n long, edits int")
    assert [r["term"] for r in fuzzy.ranked_suggestions(found, 4).orderBy("rank").collect()] == ["tabs", "table", "stab", "cab"]


def test_use_cases_by_part(spark):
    asked = spark.createDataFrame([("Test",), ("zzzz",), ("",), (None,)], "part string")
    got = [(r["rank"], r["suggestion"]) for r in fuzzy.use_case_suggestions(asked).orderBy("rank").collect()]
    names = [k for k, ws in fuzzy.USE_CASES.items() if "test" in k or any("test" in w for w in ws)]
    words = [w for ws in fuzzy.USE_CASES.values() for w in ws if "test" in w and w not in names]
    assert got == list(enumerate(list(dict.fromkeys(names + words))[:10], 1)) and got
