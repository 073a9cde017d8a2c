"""The stages against plain Python on a small table, and on an empty one."""

import corpus_pipeline
from lorespark.llm import jaccard
from lorespark.llm.common import Table


def test_stages(spark):
    rows = []
    for i in range(24):
        text = " ".join(f"w{(i * 7 + k * 13) % 97}{chr(97 + (i + k) % 26)}" for k in range(60))
        rows.append((i, text if i < 20 else rows[i - 20][1], "en" if i % 2 else "de", f"s{i % 3}", len(text)))
    rows += [(50, None, None, None, None), (51, "", "en", "s0", 0), (52, "write to a.b@c.example please, thank you all very much indeed", "en", "s1", 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    named = Table(corpus_pipeline.STAGES[0][1](spark, docs, ""), "t").df
    assert named.columns == docs.columns and {50, 51}.isdisjoint({r["doc_id"] for r in named.collect()})
    kept = Table(corpus_pipeline.STAGES[1][1](spark, named, ""), "t").df
    want = {r["doc_id"] for r in named.collect()}
    sets = {r["doc_id"]: r["text"] for r in named.collect()}
    first = {}
    for i in sorted(want):
        first.setdefault(sets[i], i)
    assert {r["doc_id"] for r in kept.collect()} == set(first.values())
    clean = Table(corpus_pipeline.STAGES[2][1](spark, kept, ""), "t").df
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    if 52 in texts:
        assert texts[52] == "write to <email> please, thank you all very much indeed"
    mixed = Table(corpus_pipeline.STAGES[3][1](spark, clean, ""), "t").df
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, "")
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = Table(stage(spark, docs, ""), "t").df
    assert docs.count() == 0


def test_rule_of_the_stage():
    assert jaccard.Rule() == jaccard.Rule(5, 80, 100)
