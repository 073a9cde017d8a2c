"""Benchmark decontamination by suffix arrays of the training texts.

Documents are taken in shards (the batches of a task).  The words of a shard get a suffix
array by prefix doubling, and every suffix of the test items is binary-searched in it, word
by word: where a whole window of the item (``window`` words, or all words of a shorter item)
is found, the suffixes between the bounds are all its occurrences; from there the search goes
on to the longest verbatim match and its locations.  Documents with an occurrence are removed.

What makes this cheap without losing a match: words that no item has end every match, so
suffixes reach no further than the next such word, and stretches of known words shorter than
the shortest window are left out before sorting; suffixes are sorted only as deep as the longest
item reaches.  Words are compared as bytes, never by hash.  Documents are not shuffled: the
test items are the query set, sent to the shards in blocks of at most ``BLOCK_WORDS`` words;
each block is one pass over the batches.  Items of more than ``PIECE_WORDS`` words are cut
into pieces that overlap by a window less one word, so that no window is lost.

Defined results: a null or empty text has no words and no occurrences; an item that is null or
has no words occurs nowhere; an item without an id marks words, but is not named; items of equal id are
one item; equal items each count; repeated rows are searched each; texts are whole whatever
their length, and no match runs from one text into the next; without items nothing is hit;
an output whose name the id column has gets an underscore in front; ``clean`` returns all
columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, tidy

#: Words of the items that are searched at once, and of a piece of an item.
BLOCK_WORDS, PIECE_WORDS = 1 << 20, 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of all texts one after the other, and how many each text has."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    low = _LOWER[raw]
    inside = _WORD[low]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    own = ends[:-1][ends[:-1] < ends[1:]]  # where a text begins, so does a word
    begins[own] = inside[own]
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    at = np.concatenate([[0], np.cumsum(np.flatnonzero(stops) + 1 - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[inside]))])
    return words, np.diff(np.searchsorted(starts, ends))


class Items:
    """A block of test items: their words as numbers, and the suffixes that hold a whole window."""

    def __init__(self, names: list[str | None], texts: list[list[bytes]], window: int):
        flat = pa.array([w for t in texts for w in t], pa.large_binary())
        self.vocabulary = pc.unique(flat)
        self.words = pc.index_in(flat, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        self.names = names
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        need = np.minimum(sizes, window)
        count = sizes - need + 1
        self.item = np.repeat(np.arange(len(texts)), count)
        first = np.repeat(np.cumsum(count) - count, count)
        self.start = np.repeat(ends - sizes, count) + np.arange(len(first)) - first
        self.first = np.repeat(ends - sizes, count)
        self.end, self.need = ends[self.item], need[self.item]
        self.least, self.longest = int(need.min()), int(sizes.max())


@dataclass
class Found:
    """Of one shard: its suffix array's texts, and for each test suffix that occurs the bounds of its window and of its longest match."""

    array: np.ndarray
    tokens: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    window: np.ndarray
    deepest: np.ndarray
    length: np.ndarray


def stretches(ids: np.ndarray, counts: np.ndarray, least: int):
    """Known words in stretches of ``least`` and more, a 0 after each: tokens, their document and their place in it."""
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    known = ids > 0
    opens, shuts = known.copy(), known.copy()
    same = doc[1:] == doc[:-1]
    opens[1:] &= ~(known[:-1] & same)
    shuts[:-1] &= ~(known[1:] & same)
    lo, hi = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    keep = hi - lo >= least
    lo, hi = lo[keep], hi[keep]
    size = hi - lo
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    source = np.repeat(lo, size) + at
    to = np.arange(len(source)) + np.repeat(np.arange(len(lo)), size)
    tokens = np.zeros(len(source) + len(lo), np.int64)
    docs, places = np.full(len(tokens), -1), np.zeros(len(tokens), np.int64)
    tokens[to], docs[to], places[to] = ids[source], doc[source], place[source]
    return tokens, docs, places


def suffix_array(tokens: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Places whose stretch has ``least`` words left, ordered by up to ``depth`` words; 0 ends a suffix."""
    rank, h, zero = tokens.astype(np.int64), 1, tokens == 0
    while h < depth:
        nxt = np.zeros_like(rank)
        nxt[:-h] = rank[h:]
        key = rank * (rank.max(initial=0) + 1) + nxt
        key[zero] = 0
        values, rank = np.unique(key, return_inverse=True)
        h *= 2
        if len(values) >= len(tokens) - np.count_nonzero(zero) + 1:
            break  # all suffixes differ by now
    ends = np.flatnonzero(zero)
    places = np.flatnonzero(~zero)
    places = places[ends[np.searchsorted(ends, places)] - places >= least] if len(places) else places
    return places[np.argsort(rank[places], kind="stable")]


def _bound(tokens, array, column, lo, hi, value, upper: bool) -> np.ndarray:
    """For many searches at once: where in [lo, hi) the word at ``column`` is not below (or is above) the value."""
    lo, hi = lo.copy(), hi.copy()
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) >> 1
        word = tokens[array[mid] + column]
        right = word <= value[live] if upper else word < value[live]
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]
    return lo


def search(tokens: np.ndarray, docs: np.ndarray, places: np.ndarray, items: Items) -> Found:
    array = suffix_array(tokens, items.longest, items.least)
    live = np.arange(len(items.start))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(array))
    window, length = np.zeros((len(live), 2), np.int64), np.zeros(len(live), np.int64)
    j = 0
    while len(live):
        value = items.words[items.start[live] + j]
        a = _bound(tokens, array, j, lo[live], hi[live], value, False)
        b = _bound(tokens, array, j, a, hi[live], value, True)
        some = a < b
        live, j = live[some], j + 1
        lo[live], hi[live], length[live] = a[some], b[some], j
        whole = live[items.need[live] == j]
        window[whole, 0], window[whole, 1] = lo[whole], hi[whole]
        live = live[items.start[live] + j < items.end[live]]
    suffix = np.flatnonzero(length >= items.need)
    return Found(array, tokens, docs, places, suffix, window[suffix], np.stack([lo, hi], 1)[suffix], length[suffix])


def _expand(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of all ranges."""
    size = bounds[:, 1] - bounds[:, 0]
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + bounds[row, 0]


def hits(found: Found, items: Items, n_docs: int) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """For each document the stretches of words inside occurrences, and the numbers of the items."""
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    named: list[list[int]] = [[] for _ in range(n_docs)]
    if not len(found.suffix):
        return spans, named
    need = items.need[found.suffix]
    keys, back = np.unique(np.column_stack([found.window, need]), axis=0, return_inverse=True)
    back = back.ravel()
    row, at = _expand(keys[:, :2])
    place = found.array[at]
    edge = np.zeros(len(found.tokens) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + keys[row, 2], -1)
    hit = np.cumsum(edge)[:-1] > 0
    lo = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
    hi = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]))
    for d, a, b in zip(found.doc[lo].tolist(), found.word[lo].tolist(), found.word[hi].tolist(), strict=True):
        spans[d].append((a, b + 1))
    # Windows with the same items count as one; then documents by such sets, and last their items.
    order = np.lexsort((items.item[found.suffix], back))
    cuts = np.flatnonzero(np.diff(back[order])) + 1
    sets: dict[bytes, int] = {}
    lists, which = [], np.zeros(len(keys), np.int64)
    for k, own in enumerate(np.split(items.item[found.suffix][order], cuts)):
        own = np.unique(own)
        n = sets.setdefault(own.tobytes(), len(lists))
        if n == len(lists):
            lists.append(own)
        which[k] = n
    pairs = np.unique(np.column_stack([found.doc[place], which[row]]), axis=0)
    for d, n in pairs.tolist():
        named[d].extend(lists[n].tolist())
    return spans, [sorted(set(x)) for x in named]


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*a, *b]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def blocks(items: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks of at most ``BLOCK_WORDS`` words, read one partition after the other."""

    def run(batches):
        for batch in batches:
            words, counts = words_of(batch.column(1))
            ends = np.cumsum(counts)
            for i, (lo, hi) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                for at in range(lo, hi, PIECE_WORDS):
                    if at > lo and hi - at < window:
                        break
                    piece = words.slice(at, min(hi - at, PIECE_WORDS + window - 1))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([piece.to_pylist()], pa.list_(pa.binary()))], ["name", "words"])

    packed = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("t")).mapInArrow(run, "name string, words array<binary>")
    names, texts, size = [], [], 0
    for row in packed.toLocalIterator():
        if texts and size + len(row["words"]) > BLOCK_WORDS:
            yield Items(names, texts, window)
            names, texts, size = [], [], 0
        names.append(row["name"])
        texts.append([bytes(w) for w in row["words"]])
        size += len(row["words"])
    if texts:
        yield Items(names, texts, window)


_STATE = T.StructType().add("n_words", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("items", T.ArrayType(T.StringType()))
_SPANS, _NAMES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())


def _passes(rows: DataFrame, items: DataFrame, window: int, item_id: str, item_text: str) -> DataFrame:
    """``rows`` (columns ``c0`` and so on, texts in ``c0``) with ``_STATE``, a pass for each block of items."""
    spark = rows.sparkSession
    ship(spark)
    kept = [*rows.schema.fields]
    schema = T.StructType([*kept, *_STATE.fields])
    out = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<struct<start: long, end: long>>)"), "items": F.expr("cast(array() as array<string>)")})

    def one(sent):
        def run(batches):
            block = sent.value if sent is not None else None
            for batch in batches:
                words, counts = words_of(batch.column(0))
                columns, spans, names = batch.columns[: len(kept)], batch.column(len(kept) + 1), batch.column(len(kept) + 2)
                if block is not None:
                    ids = pc.fill_null(pc.index_in(words, block.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                    new, numbers = hits(search(*stretches(ids, counts, block.least), block), block, len(counts))
                    if any(new):
                        old_s, old_n = spans.to_pylist(), names.to_pylist()
                        spans = pa.array([[{"start": a, "end": b} for a, b in merge([(x["start"], x["end"]) for x in o], n)] if n else o for o, n in zip(old_s, new, strict=True)], _SPANS)
                        names = pa.array([sorted({*o, *(block.names[i] for i in n if block.names[i] is not None)}) if n else o for o, n in zip(old_n, numbers, strict=True)], _NAMES)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), spans, names], [f.name for f in schema])

        return tidy(run)

    sent = [spark.sparkContext.broadcast(b) for b in blocks(items, window, item_id, item_text)]
    for b in sent or [None]:
        out = out.mapInArrow(one(b), schema)
    return out


def _hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def scan(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The id, ``n_words``, ``n_hit``, ``spans`` (words inside occurrences, end exclusive) and ``items`` (ids as sorted strings) of each row."""
    rows = docs.select(F.col(text_col).alias("c0"), F.col(id_col).alias("c1"))
    found = _passes(rows, items, window, item_id, item_text)
    out = {"n_words": F.col("n_words"), "n_hit": _hit(), "spans": F.col("spans"), "items": F.col("items")}
    return found.select(F.col("c1").alias(id_col), *(c.alias(n if n != id_col else f"_{n}") for n, c in out.items()))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without an occurrence, with all their columns."""
    rows = docs.select(F.col(text_col).alias("c0"), *(F.col(f"`{c}`").alias(f"c{i + 1}") for i, c in enumerate(docs.columns)))
    kept = _passes(rows, items, window, item_id, item_text).where(F.size("spans") == 0)
    return kept.select(*(F.col(f"c{i + 1}").alias(c) for i, c in enumerate(docs.columns)))


def longest(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, item_start, length, doc_id, doc_start) of the longest verbatim match of each place of an item where a window or more matches.

    Places are counted in words.  A place whose match is only the rest of the match one word
    before is left out; of equal lengths the smallest doc_id and place is named.  Matches of
    more than ``PIECE_WORDS`` words are named in pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    best = None
    names = "item_id string, item_start long, length long, doc_id string, doc_start long"

    def one(sent):
        def run(batches):
            block = sent.value
            for batch in batches:
                words, counts = words_of(batch.column(0))
                ids = pc.fill_null(pc.index_in(words, block.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                found = search(*stretches(ids, counts, block.least), block)
                row, at = _expand(found.deepest)
                place, suffix = found.array[at], found.suffix[row]
                before = np.where(place > 0, found.tokens[place - 1], 0)
                inner = (block.start[suffix] > block.first[suffix]) & (before == block.words[block.start[suffix] - 1])
                row, place, suffix = row[~inner], place[~inner], suffix[~inner]
                taken = batch.column(1).take(pa.array(found.doc[place]))
                yield pa.RecordBatch.from_arrays([pa.array([block.names[i] for i in block.item[suffix]], pa.string()), pa.array(block.start[suffix] - block.first[suffix]), pa.array(found.length[row]), taken, pa.array(found.word[place])], [n.split()[0] for n in names.split(", ")])

        return tidy(run)

    rows = docs.select(F.col(text_col).alias("t"), F.col(id_col).cast("string").alias("i"))
    for b in blocks(items, window, item_id, item_text):
        part = rows.mapInArrow(one(spark.sparkContext.broadcast(b)), names)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], names)
    first = best.groupBy("item_id", "item_start").agg(F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").cast(docs.schema[id_col].dataType).alias("d"), F.col("doc_start").alias("s"))).alias("b"))
    return first.select("item_id", "item_start", (-F.col("b.l")).alias("length"), F.col("b.d").alias("doc_id"), F.col("b.s").alias("doc_start"))


ORACLE = """
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
n as (select item_id, w, least(len(w), 10) as k from b where len(w) > 0),
windows as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as x from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from n)),
sizes as (select distinct k from windows),
places as (select r, k, w, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k),
occur as (select p.r, p.i, p.k, x.item_id from places p join windows x on p.k = x.k and array_to_string(p.w[p.i : p.i + p.k - 1], ' ') = x.x),
hit as (select r, count(distinct i) as n_hit from (select r, unnest(range(i, i + k)) as i from (select distinct r, i, k from occur)) group by r),
named as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from occur group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (r) left join named using (r)
"""
