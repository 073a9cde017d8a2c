"""Language identification and toxicity: held-out accuracy, and the odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import langid, toxicity
from lorespark.llm.common import crc_bucket


@pytest.fixture(scope="module")
def language(sample):
    return langid.fit(sample, where=crc_bucket("doc_id", 3) != 1)


def test_languages_of_held_out_documents(sample, language):
    got = langid.identify(sample, language, keep=["doc_id", "lang"]).where(crc_bucket("doc_id", 3) == 1)
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.avg(F.col("accepted").cast("int")).alias("k")).first()
    assert row["a"] > 0.9 and row["k"] > 0.9


def test_odd_texts(odd, language):
    with pytest.raises(ValueError):
        langid.identify(odd, language, keep=odd.columns)
    got = langid.identify(odd, language, keep=odd.columns, prefix="x_").collect()
    assert len(got) == 9
    for r in got:
        if r["doc_id"] in (1, 2, 6, 7):
            assert (r["x_lang_pred"], r["x_score"], r["x_accepted"]) == ("und", 0.0, False)
        else:
            assert r["x_lang_pred"] in language.labels and 0 < r["x_score"] <= 1


def test_no_rows(empty):
    model = langid.fit(empty)
    assert model.labels == [] and langid.identify(empty, model, keep=["doc_id"]).count() == 0


def test_histogram_counts_each_subword_once_whatever_the_slices(monkeypatch):
    raw = np.frombuffer(("Straße und Öl " * 50).encode(), np.uint8)
    want = dict(zip(*(x.tolist() for x in langid.histogram(langid.fold(raw), 1 << 12)), strict=True))
    monkeypatch.setattr(langid, "SLICE", 37)
    assert dict(zip(*(x.tolist() for x in langid.histogram(langid.fold(raw), 1 << 12)), strict=True)) == want


def test_machine_learns_a_pair_that_single_weights_miss():
    words = {w: toxicity.terms(np.frombuffer(w.encode(), np.uint8), 12) for w in ("awful", "people", "weather", "kind")}
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(2000):
        some = [w for w in words if rng.random() < 0.7]
        docs.append(np.unique(np.concatenate([words[w] for w in some] or [np.zeros(0, np.int32)])))
        y.append(("awful" in some) == ("people" in some))  # additive weights cannot tell
    m = toxicity.train(docs, np.array(y), bits=12, rank=8, terms_kept=64, epochs=60, rate=0.1, l2=1e-5, seed=1)
    assert len(m.weights) >= 2
    assert np.mean([(m.score_terms(d) >= 0.5) == t for d, t in zip(docs, y, strict=True)]) > 0.9


def test_machine_learns_a_pair_whose_words_tell_nothing_alone():
    words = [toxicity.terms(np.frombuffer(w.encode(), np.uint8), 12) for w in ("awful", "people", "weather", "kind")]
    docs, y = [], []
    for k in range(1600):  # every combination equally often: no word is commoner in either class
        some = [w for j, w in enumerate(words) if k >> j & 1]
        docs.append(np.unique(np.concatenate(some or [np.zeros(0, np.int32)])))
        y.append((k & 1) == (k >> 1 & 1))
    m = toxicity.train(docs, np.array(y), bits=12, rank=8, epochs=60, rate=0.1, l2=1e-5, seed=1)
    assert np.mean([(m.score_terms(d) >= 0.5) == t for d, t in zip(docs, y, strict=True)]) > 0.9
    assert len(m.weights) == len(np.unique(np.concatenate(words)))


def test_toxicity(spark, sample, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(docs, labels, where=crc_bucket("doc_id", 5) != 0)
    scored = toxicity.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(crc_bucket("doc_id", 5) == 0)
    row = scored.agg(F.avg(F.when(F.col("toxic") == 1, F.col("score"))).alias("t"), F.avg(F.when(F.col("toxic") == 0, F.col("score"))).alias("c")).first()
    assert row["t"] > row["c"] + 0.3
    with pytest.raises(ValueError):
        toxicity.score(odd, model, keep=["score"])
    assert all(0 <= r["s"] <= 1 for r in toxicity.score(odd, model, keep=["score"], output="s").collect())
    none = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score(odd, none, keep=["doc_id"]).agg(F.max("score")).first()[0] == 0.0


def test_predictions_are_those_of_plain_python(language):
    for text in ("Der Hund und die Katze", "the cat & the dog 42", "éàü ß", "x"):
        folded = langid.fold(np.frombuffer(text.encode(), np.uint8)).tobytes()
        total, n, z = np.zeros(language.embeddings.shape[1]), 0, None
        for size in langid.NGRAMS:
            for at in range(len(folded) - size + 1):
                gram = folded[at : at + size]
                if 32 in gram[1:-1] or (gram[0] == 32 and gram[-1] == 32):
                    continue
                h = 0
                for b in gram:
                    h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
                bucket = ((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - (len(language.embeddings) - 1).bit_length())
                total, n = total + language.embeddings[bucket], n + 1
        z = (total / n @ language.weights + language.bias) / language.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        label, score, accepted = language.predict(np.frombuffer(text.encode(), np.uint8))
        assert label == language.labels[int(p.argmax())] and abs(score - p.max()) < 1e-4 and accepted == (score >= language.threshold)


def test_machine_scores_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    slots = np.full(64, -1, np.int32)
    slots[:20] = np.arange(20)
    m = toxicity.FactorizationMachine(6, slots, 0.3, rng.normal(size=20), rng.normal(size=(20, 4)) * 0.3)
    for size in (0, 1, 5, 15):
        some = np.sort(rng.choice(40, size, replace=False))
        known = [int(x) for x in some if x < 20]
        z = 0.3 + sum(m.weights[i] for i in known) + sum(float(m.factors[i] @ m.factors[j]) for i in known for j in known if i < j)
        assert abs(m.score_terms(some) - 1 / (1 + np.exp(-z))) < 1e-9
