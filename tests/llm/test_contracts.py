"""Each registered query on tables with nulls, empty and repeated rows, and columns whose names clash: columns, types, and what each field must be."""

import hashlib
import math
import re
import uuid
import zlib

import pytest

from lorespark.llm import queries
from lorespark.llm.common import scratch_dir

WANT = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_embedding_neardup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op4_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_gif_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op7_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_suffix_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op12_filter_audit": {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "removed": "bigint", "redundant": "bigint", "unique_fails": "bigint", "good_lost": "bigint", "toxic_lost": "bigint", "shapley": "bigint"},
    "op13_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
}
SPACE = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def tables(spark):
    """A folder with small odd tables, and their rows."""
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(80).collect()]
    base = 10_000
    mail = "write to a.b@c.example or +49 (30) 1234567 from 10.0.0.1, card 4111 1111 1111 1111 now"
    odd = [(base, None, None, None, None), (base + 1, "", "en", "src0", 0), (base + 2, " \n\t", "en", None, 3), (base + 3, "12 34 !?", None, "src1", 8), (base + 4, mail, "en", "src0", 80), (base + 5, mail, "en", "src9", 80), (base + 6, "é" * 40_000, "fr", "src0", 40_000), (base + 7, "one long text of words " * 9000, "en", "src0", 207_000)]
    docs = real + odd
    home = f"{scratch_dir(spark)}/contracts-{uuid.uuid4().hex}"
    spark.createDataFrame([(*d, 0.5, "x", 7) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, length int").repartition(3).write.parquet(f"{home}/documents.parquet")
    labels = [(d[0], i % 2, int(i % 5 == 0)) for i, d in enumerate(docs)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [(900, None), (901, ""), (902, "or +49 (30) 1234567 from")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    vecs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()]
    vecs = [(int(a), [float(x) for x in b], c) for a, b, c in vecs]
    vecs += [(100_000, None, 1), (100_001, [0.0] * 64, 1), (100_002, [math.nan] * 64, 2), (100_003, [None] * 64, 2), (100_004, vecs[0][1], None), (100_005, vecs[0][1], 3), (100_006, [1.0], 3)]
    spark.createDataFrame([(*v, 1) for v in vecs], "vec_id long, embedding array<float>, label int, n_links int").write.parquet(f"{home}/embeddings.parquet")
    return home, docs, vecs


@pytest.mark.parametrize("name", sorted(WANT))
def test_columns_types_and_rows(spark, tables, name):
    home, docs, vecs = tables
    df = queries.queries()[name](spark, home)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in WANT[name]} == WANT[name]
    rows = [r.asDict() for r in df.select(*WANT[name]).collect()]
    if name in ("op2_best_fit_packing", "op12_filter_audit", "op13_hard_negatives"):
        CHECKS[name](rows, docs, vecs)
        return
    key = "vec_id" if name == "op3_embedding_neardup" else "doc_id"
    ids = [v[0] for v in vecs] if key == "vec_id" else [d[0] for d in docs]
    assert sorted(r[key] for r in rows) == sorted(ids)
    CHECKS[name]({r[key]: r for r in rows}, docs, vecs)


def crc(i):
    return zlib.crc32(str(i).encode())


def language(rows, docs, vecs):
    langs = {d[2] for d in docs if d[2]}
    for d, text, *_ in docs:
        r = rows[d]
        assert r["held_out"] == (crc(d) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == "und" if not text or not re.search(r"[^\W\d_]", text) else r["lang_pred"] in langs


def packing(rows, docs, vecs):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {d[0] for d in docs}
    for own in by.values():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and own[0]["start"] == 0
        assert all(a["start"] + a["length"] == b["start"] for a, b in zip(own, own[1:], strict=False))
        assert all(r["length"] == 1024 for r in own[1:-1]) and all(0 < r["length"] <= 1024 for r in own)
    assert by[10_000][0]["length"] == 1 == by[10_001][0]["length"] and by[10_000][0]["ids_crc32"] == zlib.crc32((2).to_bytes(4, "little"))
    lines = {}
    for r in rows:
        lines.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in lines.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024


def neardup(rows, docs, vecs):
    for i in (100_000, 100_001, 100_002, 100_003, 100_006):
        assert (rows[i]["n_links"], rows[i]["component_id"], rows[i]["kept"]) == (0, i, True)
    first = vecs[0][0]
    assert rows[first]["n_links"] >= 2 and rows[100_004]["component_id"] == rows[100_005]["component_id"] == rows[first]["component_id"]
    assert all(r["kept"] == (i == r["component_id"]) and r["component_id"] <= i for i, r in rows.items())


def mix(rows, docs, vecs):
    sizes, by = {}, {}
    for d, text, _, source, _ in docs:
        n = len(re.findall(SPACE, text or ""))
        assert rows[d]["size"] == n and rows[d]["taken"] <= 2 * n
        sizes[source] = sizes.get(source, 0) + n
        by.setdefault(source, []).append(rows[d])
    for source, own in by.items():
        assert {r["source_size"] for r in own} == {sizes[source]} and len({r["target"] for r in own}) == 1 and own[0]["target"] <= 2 * sizes[source] + 1e-9


def media(rows, docs, vecs):
    for d, text, *_ in docs:
        raw = (text or "").encode()
        size = max(192, -(-len(raw) // 192) * 192)
        padded = raw + b" " * (size - len(raw))
        r = rows[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), size, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert {k: v for k, v in rows[10_004].items() if k != "doc_id"} == {k: v for k, v in rows[10_005].items() if k != "doc_id"}


def shingles(rows, docs, vecs):
    for d, text, *_ in docs:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = len({tuple(w[i : i + 4]) for i in range(len(w) - 3)}) if len(w) > 3 else int(bool(w))
        assert rows[d]["n_shingles"] == n
        if not n:
            assert rows[d]["component_id"] == d
    assert rows[10_004]["component_id"] == rows[10_005]["component_id"] == 10_004


def personal(rows, docs, vecs):
    r = rows[10_004]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    text = docs[-4][1]
    spans = [f"{k}:{text.index(x)}:{text.index(x) + len(x)}" for k, x in (("email", "a.b@c.example"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567"))]
    assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(r["spans"].split(","))
    assert rows[10_000]["spans"] == "" and rows[10_000]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def toxic(rows, docs, vecs):
    for d, r in rows.items():
        assert r["held_out"] == (crc(d) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def leaks(rows, docs, vecs):
    assert (rows[10_004]["n_items"], rows[10_004]["n_hit"], rows[10_004]["items_sha256"]) == (1, 5, hashlib.sha256(b"902").hexdigest())
    for i in (10_000, 10_001, 10_002):
        assert (rows[i]["n_words"], rows[i]["n_hit"], rows[i]["contaminated"]) == (0, 0, False)


def audit(rows, docs, vecs):
    parts = {d[3] or "" for d in docs}
    assert len(rows) == 600 * len(parts) and {r["part"] for r in rows} == parts
    for r in rows:
        if r["step"] == 1:
            assert r["kept"] + r["removed"] == sum((d[3] or "") == r["part"] for d in docs) and r["redundant"] == 0


def negatives(rows, docs, vecs):
    out = {100_000, 100_001, 100_002, 100_003, 100_004, 100_006}
    assert all(r["anchor_id"] % 50 == 0 and not out & {r["anchor_id"], r["positive_id"], r["negative_id"]} for r in rows)
    assert all(50 * r["positive_score"] <= 100 * r["negative_score"] <= 95 * r["positive_score"] for r in rows)


CHECKS = {"op1_language_id": language, "op2_best_fit_packing": packing, "op3_embedding_neardup": neardup, "op4_source_mix": mix, "op5_gif_media": media, "op7_ngram_jaccard": shingles, "op8_pii": personal, "op9_toxicity": toxic, "op11_suffix_decontamination": leaks, "op12_filter_audit": audit, "op13_hard_negatives": negatives}
