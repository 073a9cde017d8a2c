"""Near copies of texts and of vectors, against all pairs; components; mixing; personal data; licences; media."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from lorespark.llm import gif, jaccard, licences, media, mixing, neardup, pii
from lorespark.llm.components import components


def _components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    ids = {i for p in links for i in p if p[0] != p[1]}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == _components(ids, [p for p in links if p[0] != p[1]])


def _texts():
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(4))
    common = [word() for _ in range(60)]
    docs = []
    for n in (6, 9, 14, 30, 60, 200, 900):
        for _ in range(4):
            base = [word() for _ in range(n)]
            docs.append(base)
            for changes in (0, 1, 1, 2, 4, max(1, n // 60), max(1, n // 30)):
                copy = list(base)
                for _ in range(changes):
                    copy[random.randrange(len(copy))] = word()
                docs.append(copy[: random.choice([len(copy), len(copy), len(copy) - 1])])
            docs.append(base[: n // 2] + common)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("rule", [jaccard.Rule(4, 85), jaccard.Rule()])
def test_every_link_joins(spark, rule):
    rows = _texts()
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = frozenset(tuple(w[k : k + rule.words]) for k in range(max(1, len(w) - rule.words + 1)))
    links = [(a, b) for a in sets for b in sets if a < b and rule.den * len(sets[a] & sets[b]) >= rule.num * len(sets[a] | sets[b])]
    assert len(links) > 100
    got = {r["doc_id"]: r for r in jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == _components(sets, links)
    assert all(got[i]["n_shingles"] == len(sets[i]) for i in sets)


def test_linked_sets_share_enough_kept_parts():
    rule, rng = jaccard.Rule(4, 85), np.random.default_rng(1)
    for n in (7, 12, 20, 50, 130, 500):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            d = rule.differ(2 * n)
            gone = int(rng.integers(0, d + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, max(0, d - gone - 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if rule.den * both < rule.num * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            shared = {s: len(np.intersect1d(jaccard.kept_keys(a, s, rule), jaccard.kept_keys(b, s, rule))) for s in set(rule.schemes(len(a))) & set(rule.schemes(len(b)))}
            top = max(rule.band(len(a)), rule.band(len(b)))
            assert shared[top] >= rule.parts(top)[2]


def test_odd_texts_link_as_defined(odd, empty):
    got = {r["doc_id"]: r for r in jaccard.cluster(odd).collect()}
    assert [got[i]["n_shingles"] for i in (1, 2, 6)] == [0, 0, 0] and got[4]["component_id"] == 3 and got[3]["n_shingles"] == 1
    assert got[1]["component_id"] == 1 and got[8]["component_id"] == 8
    assert sorted(r["doc_id"] for r in jaccard.keep_first(odd).collect()) == [1, 2, 3, 5, 6, 7, 8]
    assert jaccard.cluster(empty).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        base = rng.normal(size=16)
        for _ in range(1 + k % 5 * 3):
            rows.append((base + rng.normal(size=16) * 0.08).tolist())
    rows += [rows[0], rows[0], [0.0] * 16, None, [], [math.nan] * 16, [None] * 16, [1.0, 2.0], [1e300] * 16, [1e-300] * 16]
    got = {r["vec_id"]: r for r in neardup.link(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    fine = {i: np.array(v, float) / np.abs(v).max() for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, x in fine.items() for b, y in fine.items() if a < b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9]
    assert len(links) > 300
    assert {i: r["component_id"] for i, r in got.items()} == _components(range(len(rows)), links)
    assert all(r["n_links"] == sum(i in p for p in links) for i, r in got.items())
    assert neardup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _pairs_beside_a_group(pairs, group):
    rng = np.random.default_rng(8)
    base = rng.normal(size=32)
    rows = [base + rng.normal(size=32) * 0.05 for _ in range(group)]
    for _ in range(pairs):
        v = rng.normal(size=32)
        rows += [v, v + rng.normal(size=32) * 0.3]
    return np.stack(rows)


def test_audit_sees_lone_pairs_beside_a_large_group(spark):
    rows = _pairs_beside_a_group(60, 60)
    nodes = spark.createDataFrame([(i, 1, v.tobytes()) for i, v in enumerate(rows)], "id long, n long, vec binary")
    missed = spark.createDataFrame([(i, 60) for i in range(60)], "id long, links long")  # the group whole, of the pairs none
    assert neardup.audit(nodes, missed, 0.9) < 0.9


@pytest.mark.parametrize("tables", [1, 8])
def test_lone_pairs_are_found_beside_a_large_group(spark, monkeypatch, tables):
    rows = _pairs_beside_a_group(300, 200)
    if tables == 1:  # buckets that no two vectors share: all pairs are what is left
        monkeypatch.setattr(neardup, "_buckets", lambda nodes, *_: nodes.selectExpr("id as group", "id", "vec as code").limit(0))
    got = {r["vec_id"]: r for r in neardup.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"), tables=tables, rounds=1).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = np.triu(unit @ unit.T >= 0.9, 1)
    assert {i: r["component_id"] for i, r in got.items()} == _components(range(len(rows)), np.argwhere(linked).tolist())
    assert [got[i]["n_links"] for i in range(len(rows))] == (linked | linked.T).sum(1).tolist()


def test_tables_grow_with_the_bits():
    assert [neardup.tables_for(0.9, b, 8) for b in (0, 6, 12, 15)] == [8, 8, 24, 39]


def test_mix(spark, odd, empty, sample):
    got = mixing.mix(odd).collect()
    assert len(got) == 9 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(empty).count() == 0
    again = sorted(map(tuple, mixing.mix(sample).select("doc_id", "taken").collect()))
    assert again == sorted(map(tuple, mixing.mix(sample.repartition(7)).select("doc_id", "taken").collect()))
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert again == sorted((r[0], r[4]) for r in con.sql(mixing.ORACLE).fetchall())
    taken = dict(again)
    words = {}
    for r in mixing.draw(sample).select("doc_id", "text").collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {i: n for i, n in taken.items() if n}


def test_seats_are_those_of_the_highest_quotients(spark):
    amounts = [53, 24, 23, 7, 1, 0]
    df = spark.createDataFrame([(0, i, a, 17, 100) for i, a in enumerate(amounts)], "g int, i int, amount long, seats long, most long")
    got = {r["i"]: r["won"] for r in mixing.sainte_lague(df, ["g"], ["i"], "amount", "seats", "most", "won").collect()}
    want = dict.fromkeys(range(6), 0)
    for _ in range(17):
        want[max(want, key=lambda i: (amounts[i] / (2 * want[i] + 1), -i))] += 1
    assert got == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_are_those_of_the_patterns():
    random.seed(4)
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    for _ in range(5000):
        t = "".join(random.choice("ab@.1234 +-()é5%") for _ in range(random.randint(0, 60)))
        assert pii.base_spans(t) == [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if ok[k](m[0])]
    assert len(pii.base_spans("9" * 200_000 + " " + "a" * 200_000)) == 0


def test_contexts_find_what_patterns_miss(spark, odd, empty):
    rows = [(i, f"please write to user{i}@mail.example.com now") for i in range(30)] + [(99, "please write to user99(at)mail.example.com now"), (100, "we saw 7 birds today")]
    got = {r["doc_id"]: r["found"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s["kind"] for s in got[99]] == ["email"] and got[100] == []
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert red[99] == red[0] == "please write to <email> now" and red[100] == rows[-1][1]
    assert pii.find(odd).count() == 9 and pii.redact(odd).count() == 9 and pii.find(empty).count() == 0
    assert [r["text"] for r in pii.redact(odd.where("doc_id in (1, 8)")).collect()].count("mail <email> now, call <phone> é") == 2


def test_contexts_find_tokens_without_digit_or_sign_and_of_any_length(spark):
    long = "anna" + "(dot)anna" * 30 + "7(at)mail.example.com"
    missed = ["anna(at)mail.example.com", "anna[at]mail[dot]org", long]
    rows = [(i, f"please write to user{i}@mail.example.com now") for i in range(60)] + [(100 + i, f"please write to {t} now") for i, t in enumerate(missed)] + [(200, "we saw seven birds today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["found"] for r in pii.find(df).collect()}
    assert [[(s["kind"], s["start"], s["end"]) for s in got[100 + i]] for i in range(3)] == [[("email", 16, 16 + len(t))] for t in missed]
    assert all(not s for i, s in got.items() if i < 100 or i == 200)
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert {red[100 + i] for i in range(3)} == {"please write to <email> now"} and red[200] == rows[-1][1]


def test_licences(spark, odd, empty):
    mit = licences.TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 A. Body\n\n" + mit.upper().replace("LICENSE", "LICENCE")), (2, "text\nReleased under the MIT Licence!\nmore"), (3, None), (4, mit + " and more")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["license"] == "MIT" and got[2]["notices"] == ["MIT"] and got[2]["license"] is None and got[4]["license"] is None
    assert (got[3]["digest"], got[3]["notices"], got[3]["n_lines"]) == (None, [], 0)
    assert licences.scan(odd).count() == 9 and licences.scan(empty).count() == 0


def test_media_round_trip(spark, odd, empty):
    seen = {r["doc_id"]: r for r in media.read(media.store(odd)).collect()}
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        assert bytes(seen[r["doc_id"]]["samples"]) == raw.ljust(max(192, -(-len(raw) // 192) * 192)) and seen[r["doc_id"]]["n_bytes"] == len(raw)
    assert len(seen[5]["frames"]) > 1 and seen[5]["frames"][1]["start_ms"] == 40
    assert hashlib.sha256(seen[3]["media"]).digest() == hashlib.sha256(seen[4]["media"]).digest()
    assert media.read(media.store(empty)).count() == 0
    broken = spark.createDataFrame([(1, 3, bytearray(b"GIF")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r["samples"] for r in media.read(broken).collect()] == [None, None]


def test_lzw_of_random_and_of_even_bytes():
    rng = np.random.default_rng(5)
    for data in (bytes(192), bytes(192 * 3000), rng.integers(0, 256, 192 * 700, dtype=np.uint8).tobytes(), b"ab" * 96 * 500):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_disposal_transparency_and_palettes():
    red_blue = bytes([255, 0, 0, 0, 0, 255])
    head = b"GIF89a" + (2).to_bytes(2, "little") + (1).to_bytes(2, "little") + b"\x80\0\0" + red_blue

    def frame(pixels, disposal, transparent=None, left=0, local=b""):
        flags = disposal << 2 | (transparent is not None)
        body = {(0, 0): b"\x04\x0a", (1, 1): b"\x4c\x0a", (0, 1): b"\x44\x0a", (1,): b"\x4c\x01", (0,): b"\x44\x01"}[pixels]
        return b"\x21\xf9\x04" + bytes([flags, 7, 0, transparent or 0, 0]) + b"\x2c" + bytes([left, 0, 0, 0, len(pixels), 0, 1, 0, 0x80 if local else 0]) + local + b"\x02" + gif._blocks(body)

    assert [list(gif.lzw_decode(b, 2, 9)) for b in (b"\x4c\x01", b"\x44\x01")] == [[1], [0]]
    shown = [f.canvas[0].tolist() for f in gif.decode(head + frame((1,), 1) + frame((0,), 3, left=1) + frame((1,), 2, transparent=1) + frame((0,), 0, left=1, local=bytes([9, 9, 9, 0, 0, 0])) + b"\x3b")]
    blue, red, clear = [0, 0, 255, 255], [255, 0, 0, 255], [0, 0, 0, 0]
    assert shown == [[blue, clear], [blue, red], [blue, clear], [clear, [9, 9, 9, 255]]]


def _brute_components(rows, rule):
    """Row numbers -> (smallest id reachable, row numbers of the component)."""
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").split()
        sets[k] = frozenset(tuple(w[j : j + rule.words]) for j in range(max(1, len(w) - rule.words + 1))) if w else frozenset()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and rule.den * len(sets[a] & sets[b]) >= rule.num * len(sets[a] | sets[b])]
    top = _components(sets, links)
    return {k: {j for j in top if top[j] == top[k]} for k in top}


def test_repeated_and_unknown_ids_link_by_their_own_texts(spark):
    t, u = (" ".join(f"{x}{k}" for k in range(40)) for x in "tu")
    rows = [(1, t), (1, u), (2, t + " x"), (3, u + " y"), (None, t), (None, "one text of nobody at all"), (5, "one text of nobody at all"), (6, ""), (6, ""), (7, None), (8, u), (8, u), (None, "alone among all of them here")]
    rule = jaccard.Rule()
    df = spark.createDataFrame([(*r, k, 0) for k, r in enumerate(rows)], "doc_id long, text string, row int, group int")
    groups = _brute_components(rows, rule)
    want = sorted((str(rows[k][0]), str(min((rows[j][0] for j in own if rows[j][0] is not None), default=None))) for k, own in groups.items())
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.cluster(df, rule).collect()) == want
    kept = [r["row"] for r in jaccard.keep_first(df, rule).collect()]
    assert len(kept) == len(set(kept)) and {7, 8, 9, 12} <= set(kept)
    for own in groups.values():
        assert len(own & set(kept)) == 1
        first = min((rows[j][0] for j in own if rows[j][0] is not None), default=None)
        assert {rows[j][0] for j in own & set(kept)} == {first}


def test_draw_with_clashing_columns_and_repeated_rows(spark):
    rows = [(k % 5, f"some words of text {k % 7} to mix in", f"s{k % 3}" if k % 4 else None, k, k * 2) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken int")
    drawn = mixing.draw(df)
    assert drawn.columns == df.columns
    got = drawn.groupBy("source").agg({"*": "count"}).collect()
    words = {}
    for r in drawn.select("source", "text").collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    want = {}
    sources = {(r[0], r[1]): r[2] for r in rows}
    assert len(sources) <= len(rows) and got
    mixed = mixing.mix(df, keep_keys=True).collect()
    for r in mixed:
        source = None if r["__sk"] == "n" else r["__sk"][1:]
        want[source] = want.get(source, 0) + r["taken"]
    assert len(mixed) == 40 and words == {k: n for k, n in want.items() if n}


def test_wrapped_licences(spark):
    import textwrap

    rows, want = [], {}
    for n, (name, text) in enumerate(licences.TEXTS.items()):
        for w in (40, 60, 66, 72, 80, 100):
            rows.append((100 * n + w, "Copyright (c) 2020, A. Body\nAll rights reserved.\n\n" + "\n\n".join(textwrap.fill(p, w) for p in text.split("\n\n"))))
            want[rows[-1][0]] = name
    got = {r["doc_id"]: r["license"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_digests_are_those_of_the_published_texts():
    import os

    own = "/usr/share/common-licenses/"
    for file, name in {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items():
        if os.path.exists(own + file):
            assert licences.known_digests()[licences._digest(open(own + file, encoding="utf-8").read())] == name


def test_secrets_and_words_are_found_by_sure_contexts_only(spark):
    key = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'we set token = "{key(k)}" here {k}') for k in range(20)] + [(50, 'we set token = "hunter2" here'), (51, "commit " + key(51) + " fixed it"), (52, "the bird is here")]
    rows += [(60 + k, f"{'abcdefghijkl'[k]} reach: user{k}@mail.example.com {'mnopqrstuvwx'[k]}") for k in range(12)] + [(80, "z reach: bob(at)mail(dot)example y")]
    got = {r["doc_id"]: [(s["kind"], t[s["start"] : s["end"]]) for s in r["found"]] for r, t in ((r, dict(rows)[r["doc_id"]]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())}
    assert got[50] == [("secret", "hunter2")] and got[51] == got[52] == []
    assert all(got[k] == [("secret", key(k))] for k in range(20))
    assert got[80] == [("email", "bob(at)mail(dot)example")] and got[60] == []


def test_scores_of_patterns_are_those_of_plain_python(spark):
    rng = random.Random(8)
    seen = [(f"p{rng.randrange(8)}", f"i{rng.randrange(30)}") for _ in range(200)]
    seeds = {f"i{k}": ("email" if k % 2 else "phone") for k in range(12)}
    df = spark.createDataFrame([(p, i, seeds.get(i)) for p, i in seen], "pattern string, instance string, seed string")
    got = {(r["pattern"], r["kind"]): (r["seeds"], r["confidence"]) for r in pii.score_patterns(df).collect()}
    edges = set(seen)
    members = {p: {i for q, i in edges if q == p} for p, _ in edges}
    pairs = {(p, seeds[i]) for p, i in edges if i in seeds}
    belief = {}
    for _ in range(3):
        score = lambda i, k: float(seeds[i] == k) if i in seeds else belief.get((i, k), 0.0)
        conf = {(p, k): sum(score(i, k) for i in members[p]) / (len(members[p]) + 1) for p, k in pairs}
        belief = {}
        for p, k in pairs:
            for i in members[p]:
                if i not in seeds:
                    belief.setdefault((i, k), []).append(conf[p, k])
        belief = {ik: 1 - math.prod(1 - c for c in own if c >= 0.5) for ik, own in belief.items()}
    assert set(got) == pairs
    for pk in pairs:
        assert got[pk][0] == sum(seeds.get(i) == pk[1] for i in members[pk[0]]) and abs(got[pk][1] - conf[pk]) < 1e-9


def test_links_of_long_vectors_with_one_large_component(spark):
    rng = np.random.default_rng(2)
    sign = np.where(rng.random(8191) < 0.5, 1.0, -1.0)
    rows = [(1, [1.0, *(0.0045 * sign).tolist()]), (2, [1.0, *(0.0038 * sign).tolist()]), (3, [0.0] * 8191 + [1.0]), (4, None), (5, [0.0] * 8192)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
