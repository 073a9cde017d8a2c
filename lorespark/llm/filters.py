"""Audit of how quality filters interact, as a product of incidence matrices.

Each document has a mask of the filters that it fails.  The histograms of masks (of all
documents, of those labelled good, of those labelled toxic; one of 32 numbers each) are the
rows of one matrix for each part of the corpus; its products with four integer matrices of
32 x 600 are what every step of every order of the five filters keeps, removes, finds
removed already, and would be alone to remove.  Only masks are counted by Spark; the
products need 32 numbers a histogram, whatever the number of documents.

Filters, by letter: A fewer than ``least_words`` words; B less than ``distinct_percent`` % of
the words distinct; C more than ``capital_percent`` % of the characters A-Z; D holds one of
``#$%&*|``; E has the text of a document with a smaller id, kept or not.

Defined results: a null text is empty (and so equal to empty texts); a null part is the empty
string; a document without an id is a copy of nothing and nothing is a copy of it, and has no label; rows that
repeat an id and a text are not copies of one another; of several labels of one id any 1
counts; a table without rows gives none; texts are whole whatever their length; only the
named columns are read, whatever the others are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, ship

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
ORDERS = ["".join(p) for p in permutations(LETTERS)]
COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Parts whose products are made at once.
PARTS = 32


@dataclass(frozen=True)
class Limits:
    least_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2


def incidence() -> dict[str, np.ndarray]:
    """The 32 x 600 matrices: a row for each mask, a column for each order and step."""
    mask = np.arange(MASKS)[:, None]
    at = np.array([[LETTERS.index(x) for x in order] for order in ORDERS])  # order, step
    own = 1 << at
    seen = np.cumsum(own, axis=1)
    before, bit, upto = (x.ravel()[None, :] for x in (seen - own, own, seen))
    removed = ((mask & bit) != 0) & ((mask & before) == 0)
    shapley = np.stack([removed[:, at.ravel() == f].sum(1) for f in range(len(LETTERS))], 1)
    return {
        "kept": ((mask & upto) == 0).astype(np.int64),
        "removed": removed.astype(np.int64),
        "redundant": (((mask & bit) != 0) & ((mask & before) != 0)).astype(np.int64),
        "unique": (mask == bit).astype(np.int64),
        "shapley": shapley[:, at.ravel()].astype(np.int64),
    }


def failures(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask): the filters each document fails, the first the lowest bit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    first = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.struct(F.size(words).cast("long").alias("n"), F.size(F.array_distinct(words)).cast("long").alias("d")).alias("w"), (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("capitals"), F.length(text).cast("long").alias("chars"), text.rlike("[#$%&*|]").alias("sign"), F.unhex(F.sha2(text, 256)).alias("digest"))
    bits = [F.col("w.n") < limits.least_words, F.col("w.d") * 100 < F.col("w.n") * limits.distinct_percent, F.col("capitals") * 100 > F.col("chars") * limits.capital_percent, F.col("sign")]
    low = sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))
    marked = Table(first.select("id", "part", low.alias("low"), "digest"), "filter-masks").df
    # The first document of each text; whatever has another id than the first fails E.  The second join is on text and id, so that a hot text is dealt by id.
    firsts = marked.groupBy("digest").agg(F.min("id").alias("first")).where("first is not null").withColumn("is_first", F.lit(True))
    own = marked.join(firsts, (marked["digest"] == firsts["digest"]) & (marked["id"] == firsts["first"]), "left")
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    return own.select("id", "part", (F.col("low") + copy.cast("int") * 16).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``COLUMNS``: one row for each part, order and step."""
    ship(docs.sparkSession)
    failed = Table(failures(docs, limits, id_col, text_col, part_col), "filter-failures").df
    marks = labels.groupBy(F.col(id_col).alias("l_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where("l_id is not null and (good = 1 or toxic = 1)")
    zero = F.lit(0).cast("long")
    every = failed.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    known = failed.join(marks, failed["id"] == marks["l_id"]).groupBy("part", "mask").agg(F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic"))
    rows = every.unionByName(known.select("part", "mask", zero.alias("n"), "good", "toxic"))
    rows = rows.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    stacked = rows.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))  # at most 32 entries
    return stacked.mapInArrow(_products, COLUMNS)


def _products(batches):
    m = incidence()
    orders, steps = np.repeat(np.array(ORDERS, object), len(LETTERS)), np.tile(np.arange(1, len(LETTERS) + 1), len(ORDERS))
    for batch in batches:
        for lo in range(0, batch.num_rows, PARTS):
            part, lists = batch.column(0).slice(lo, PARTS), batch.column(1).slice(lo, PARTS)
            at = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            mask = flat.field("mask").to_numpy()
            h = np.zeros((3, len(part), MASKS), np.int64)  # all, good, toxic
            for k, name in enumerate(("n", "good", "toxic")):
                np.add.at(h[k], (at, mask), flat.field(name).to_numpy())
            removed = h.reshape(-1, MASKS) @ m["removed"]
            removed, good, toxic = removed.reshape(3, len(part), -1)
            out = [h[0] @ m["kept"], removed, h[0] @ m["redundant"], h[0] @ m["unique"], good, toxic, h[0] @ m["shapley"]]
            each = len(orders)
            names = part.take(pa.array(np.repeat(np.arange(len(part)), each)))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(orders, len(part)), pa.string()), pa.array(np.tile(steps, len(part)).astype(np.int32)), *(pa.array(x.ravel()) for x in out)], [c.split()[0] for c in COLUMNS.split(", ")])


ORACLE = """
with base as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
words as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by t) as first from base),
fails as (
  select w.doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] as f,
    coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic
  from words w left join labels l using (doc_id)),
counted as (select part, f, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from fails group by all),
letters as (select unnest([1, 2, 3, 4, 5]) as i),
orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
cells as (
  select part, o, s.i as step, o[s.i] as filter, n, good, toxic, f[o[s.i]] as fail, len(list_filter(o[1 : s.i - 1], lambda x: f[x])) > 0 as gone, len(list_filter(f, lambda x: x)) = 1 as alone
  from counted, orders, letters s),
steps as (
  select part, o, step, filter, sum(case when not fail and not gone then n else 0 end) as kept, sum(case when fail and not gone then n else 0 end) as removed,
    sum(case when fail and gone then n else 0 end) as redundant, sum(case when fail and alone then n else 0 end) as unique_fails,
    sum(case when fail and not gone then good else 0 end) as good_lost, sum(case when fail and not gone then toxic else 0 end) as toxic_lost
  from cells group by all)
select part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x::int, 1)), '') as filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley
from steps
"""
