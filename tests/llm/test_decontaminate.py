"""Suffix arrays, windows and longest matches against plain Python."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespark.llm import decontaminate, queries

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain(docs, items, window):
    out = {}
    for d, text in docs:
        w, hit, named = words(text), set(), set()
        for name, t in items:
            v = words(t)
            k = min(len(v), window)
            have = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1) if v else []:
                if tuple(w[i : i + k]) in have:
                    hit |= set(range(i, i + k))
                    named.add(str(name))
        out[d] = (len(w), len(hit), sorted(named))
    return out


def random_case(seed, n_docs=60, n_items=12, vocabulary=9):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(rng.choice(list("abcdefghijklmnop")[:vocabulary] + ["Ünder", "x1"], n))
    items = [(i, text(int(rng.integers(0, 25)))) for i in range(n_items)] + [(n_items, None), (n_items + 1, "..."), (n_items + 2, "unseen words only")]
    docs = [(i, text(int(rng.integers(0, 120)))) for i in range(n_docs)]
    docs += [(n_docs, None), (n_docs + 1, ""), (n_docs + 2, " -- "), (n_docs + 3, items[3][1]), (n_docs + 4, f"Foo, {items[4][1]}! bar{items[4][1]}")]
    return docs, items


@pytest.mark.parametrize("seed,window,vocabulary", [(1, 3, 9), (2, 4, 4), (3, 10, 2)])
def test_scan_equals_all_windows(spark, seed, window, vocabulary):
    docs, items = random_case(seed, vocabulary=vocabulary)
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window=window).collect()
    want = plain(docs, items, window)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] and [s["start"] for s in r["spans"]] == sorted(s["start"] for s in r["spans"])


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    docs, items = random_case(5)
    items += [(90, " ".join(t for _, t in items[:8] if t)), (90, "a b c d e f a b")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontaminate.scan(a, b, window=4).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    assert len(list(decontaminate.blocks(b, 4, "item_id", "text"))) > 3
    assert sorted(map(str, decontaminate.scan(a, b, window=4).collect())) == one
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(a, b, window=4).collect()} == plain(docs, items, 4)


def test_longest_match_of_each_place(spark):
    docs, items = random_case(7, n_docs=25, n_items=6, vocabulary=3)
    got = decontaminate.longest(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"), window=4).collect()
    at = {i: words(t) for i, t in items}
    texts = {d: words(t) for d, t in docs}
    best = {}
    for i, v in at.items():
        k = min(len(v), 4)
        for s in range(len(v) - k + 1 if v else 0):
            for d, w in texts.items():
                for p in range(len(w)):
                    n = 0
                    while s + n < len(v) and p + n < len(w) and v[s + n] == w[p + n]:
                        n += 1
                    if n >= k:
                        best[i, s] = max(best.get((i, s), 0), n)
    for r in got:
        i, s, n = int(r["item_id"]), r["item_start"], r["length"]
        assert best[i, s] >= n and at[i][s : s + n] == texts[r["doc_id"]][r["doc_start"] : r["doc_start"] + n]
    reached = {(int(r["item_id"]), r["item_start"]): r["length"] for r in got}
    for (i, s), n in best.items():  # named itself, or the rest of one that begins earlier
        assert any(reached.get((i, s - b)) == n + b or reached.get((i, s - b), 0) >= n + b for b in range(s + 1)), (i, s, n)


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(0)
    tokens = np.concatenate([np.append(rng.integers(1, 4, int(rng.integers(1, 30))), 0) for _ in range(20)])
    text = "".join(map(chr, tokens))
    for depth in (1, 3, 8, 64):
        array = decontaminate.suffix_array(tokens, depth, 2)
        reach = 1
        while reach < depth:
            reach *= 2
        keys = [text[p:].split("\0")[0][:reach] for p in array]
        assert keys == sorted(keys)
        assert sorted(array.tolist()) == [p for p in range(len(tokens)) if 0 not in tokens[p : p + 2] and p + 2 <= len(tokens)]


def test_words_are_split_as_bytes():
    texts = ["Ärger, A1-b", None, "", "x" * 70_000, "a\x00b"]
    flat, counts = decontaminate.words_of(pa.array(texts))
    assert counts.tolist() == [len(words(t)) for t in texts] and flat.to_pylist() == [w for t in texts for w in words(t)]


def test_clean_keeps_other_rows_as_they_are(spark):
    rows = [(1, "one two three four five", 7, "a"), (2, "nothing of it", None, "b"), (2, "nothing of it", None, "b"), (None, None, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, `items.x` string")
    items = spark.createDataFrame([(1, "Two three; four")], "item_id long, text string")
    got = decontaminate.clean(docs, items, window=3)
    assert got.dtypes == docs.dtypes and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()[1:]))
    assert decontaminate.clean(docs, items.limit(0)).count() == 4 and decontaminate.clean(docs.limit(0), items).count() == 0
    named = decontaminate.scan(docs.withColumnRenamed("doc_id", "n_hit").select("n_hit", "text"), items, window=3, id_col="n_hit")
    assert named.columns == ["n_hit", "n_words", "_n_hit", "spans", "items"]


def test_query_on_the_tables(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = queries.op11_suffix_decontamination(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d: (w, h, len(n), hashlib.sha256(",".join(n).encode()).hexdigest(), h > 0) for d, (w, h, n) in plain(docs, items, 10).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()} == want
    assert any(r[4] for r in want.values())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(decontaminate.ORACLE)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.collect()) == sorted(rel.fetchall())


def test_item_without_id_marks_words(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c"), (7, "c d"), (7, "a b")], "item_id long, text string")
    r = decontaminate.scan(docs, items).select(F.col("n_hit"), F.col("items")).first()
    assert (r["n_hit"], r["items"]) == (4, ["7"])
