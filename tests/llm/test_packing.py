"""Packing, tokens and token counts."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorespark.llm import binpack, packing, tokens, tokentree
from lorespark.llm.common import Table, crc32


def brute(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for i, b in enumerate(bins):
            if b + items[k] <= capacity and b not in seen:
                seen.add(b)
                bins[i] += items[k]
                place(k + 1, bins)
                bins[i] -= items[k]
        bins.append(items[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_bins_are_as_few_as_can_be(items):
    packed, bound, proved = binpack.pack(Counter(items), 30)
    got = Counter()
    for filling, n in packed:
        assert sum(filling) <= 30
        for s in filling:
            got[s] += n
    assert got == Counter(items)
    assert bound <= brute(items, 30) == binpack.bins_of(packed) and proved


def test_large_counts_stay_near_the_bound():
    random.seed(1)
    counts = {s: random.randint(0, 2000) for s in range(1, 257)} | {180: 200_000}
    packed, bound, _ = binpack.pack(counts, 256, work=20_000)
    assert binpack.bins_of(packed) <= bound * 1.01


def test_sequences(spark, odd, empty):
    got = packing.pack(odd, with_ids=True, capacity=64).collect()
    tk = Tokenizer.from_file(tokens.default_path())
    texts = {r["doc_id"]: r["text"] or "" for r in odd.select("doc_id", "text").collect()}
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 2})
    for i in (1, 3, 5, 7):
        want = np.array([*tk.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert np.array_equal(np.concatenate([r["ids"] for r in mine]), want)
        assert [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist()
        assert all(r["ids_crc32"] == crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == 64 for r in mine[1:])
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab 's\n\t.é1<|>", max_size=200))
def test_ids_are_those_of_the_tokenizers_library(text):
    tk = Tokenizer.from_file(tokens.default_path())
    for t in (text, text + "<|endoftext|>"):
        assert tokens.encode(t, tokens.default_path()).tolist() == tk.encode(t, add_special_tokens=False).ids


def test_edits_count_as_a_full_count_does():
    path = tokens.default_path()
    count = lambda t: len(tokens.encoding(path).encode_ordinary(t))
    random.seed(2)
    letters = list("ab 's\n\t.é12") + ["the ", " and", "  ", "'ll "]
    for _ in range(60):
        tree = tokentree.TokenTree("".join(random.choice(letters) for _ in range(random.randint(0, 3000))), path)
        for _ in range(5):
            text, at = tree.text, random.randint(0, len(tree.text))
            remove, insert = random.choice([0, 1, 20, 500]), "".join(random.choice(letters) for _ in range(random.choice([0, 1, 30, 900])))
            tree.edit(at, remove, insert)
            assert tree.text == text[:at] + insert + text[at + remove :] and tree.total == count(tree.text)


def test_few_leaves_are_encoded_again():
    tree = tokentree.TokenTree("some words to count " * 5000, tokens.default_path())
    first = tree.encoded
    tree.edit(50_000, 4, "other")
    assert tree.encoded - first < 3000


def test_counts_of_odd_texts(spark, odd, empty):
    edits = "array(named_struct('at', 3L, 'remove', 2L, 'insert', ' x '), named_struct('at', 1000000000L, 'remove', 5L, 'insert', 'end'))"
    got = {r["doc_id"]: r for r in tokentree.count_edited(odd.selectExpr("*", f"{edits} as edits")).collect()}
    assert (got[1]["n_tokens"], got[1]["n_chars_edited"]) == (0, 6)
    assert got[3]["n_chars_edited"] == 25 - 2 + 3 + 3
    assert got[5]["encoded_again"] < 5000 and got[5]["n_tokens"] > 90_000
    assert tokentree.count_edited(odd.selectExpr("*", "cast(null as string) as e").selectExpr("doc_id", "text", f"case when e is not null then {edits} end as edits")).count() == 9
    assert tokentree.count_edited(empty.selectExpr("*", f"{edits} as edits")).count() == 0


def test_bad_capacity():
    with pytest.raises(ValueError):
        binpack.pack({9: 1}, 8)


def test_a_narrow_first_search_is_widened_until_nothing_is_left_out():
    rng = random.Random(3)
    for _ in range(40):
        items = [rng.randint(8, 60) for _ in range(10)]
        packed, _, proved = binpack.pack(Counter(items), 100, most=1)
        assert proved and binpack.bins_of(packed) == brute(items, 100)


BLANKS = [" " * 2_000_000, "\n" * 1_000_000 + "x", "a" + " \n" * 300_000 + " b", "x " + "\t" * 20_000 + "<|endoftext|>" + " " * 9_000 + "<|endoftext|>"]


def test_long_runs_of_white_space():
    path = tokens.default_path()
    tk = Tokenizer.from_file(path)
    for t in BLANKS:
        assert b"".join(tokens.encoding(path).decode_single_token_bytes(i) for i in tokens.encode(t, path).tolist()).decode() == t
        assert tokentree.TokenTree(t, path).total == tokens.count_plain(t, path)
    for blank in (" ", "\n", " \n"):
        for t in (blank * 6000, "a" + blank * 6000 + "b", "a" + blank * 6000 + "<|endoftext|>", blank * 6000 + "<|endoftext|>" + blank * 6000 + "."):
            assert tokens.encode(t, path).tolist() == tk.encode(t, add_special_tokens=False).ids


def test_trees_outlive_their_job(spark, odd):
    path = tokens.default_path()
    one = "array(named_struct('at', 3L, 'remove', 2L, 'insert', ' x '), named_struct('at', 40L, 'remove', 5L, 'insert', 'end'))"
    two = "array(named_struct('at', 100000L, 'remove', 900L, 'insert', 'another passage of words'))"
    trees = Table(tokentree.grow(odd), "trees").df
    later = Table(tokentree.edit(trees.selectExpr("*", f"{one} as edits")), "trees").df
    last = Table(tokentree.edit(later.selectExpr("*", f"{two} as edits")), "trees").df
    for r in last.collect():
        assert r["n_tokens"] == tokens.count_plain(r["text"], path) == sum(r["leaf_tokens"]) and sum(r["leaf_chars"]) == len(r["text"]) == r["n_chars"]
        assert r["n_leaves"] < 100 or r["encoded"] < 5000
    assert {r["doc_id"]: r["n_edits"] for r in later.collect()} == dict.fromkeys(range(1, 9), 2)
