"""Hard negatives by inner product, with an orthogonal PCA rotation.

Vectors are packed into blocks.  Every block of anchors (the query set) meets every block of
vectors once; the block of vectors is rotated onto the principal axes of its own second
moments, and so are the anchors.  Products of the leading components are summed up first:
what the other components can add is at most the product of the two residual norms, and the
rounding of all of it at most a slack in proportion to the two norms.  Pairs whose bounds
miss what is asked for are dropped after an eighth, a quarter and a half of the components;
those that are left get their exact integer product.  The rotation decides how
early pairs go, never which stay.

First the positives: an anchor's ``positives`` best others of its label.  Then for each
positive the ``negatives`` best rows of other labels whose score is from ``low`` to ``high``
percent of the positive's.  What a task knows to be good enough already (of the anchor block
in hand) raises the bound for what follows.

Components are scaled and floored to integers.  Defined results: rows without id, label or
vector, with null or non-finite components or an empty vector take no part, nor do vectors whose squared
norm is 2^62 or more, since scores might not fit a long; vectors of different lengths have no score; rows that repeat an id
are rows of their own, anchors included; ties go to the smaller id; ids and labels that are
no integers count as null; only the named columns are read, whatever the others are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, ship, tidy

#: Vectors of a block; anchors whose products are made at once; blocks of vectors that one anchor block meets in a row.
BLOCK, AT_ONCE, STRIP = 4096, 256, 64
#: Pairs whose integer products are made at once.
PAIRS = 1 << 17
LIMIT = 1 << 62


@dataclass(frozen=True)
class Rule:
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def prepare(vectors: DataFrame, anchor: Column, rule: Rule = Rule(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, anchor, dim, vec): rows that take part, components as 8-byte integers."""
    ship(vectors.sparkSession)
    scale = float(rule.scale)
    rows = vectors.select(F.expr(f"try_cast(`{id_col}` as bigint)").alias("id"), F.expr(f"try_cast(`{label_col}` as bigint)").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            column = batch.column(3)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy())
            at, out, dims = [], [], []
            for i, (lo, hi) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)):
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(values[lo:hi] * scale)
                    fine = hi > lo and np.isfinite(v).all() and np.abs(v).max() < 1 << 31
                if fine and (v @ v < LIMIT / 2 or sum(int(x) ** 2 for x in v.tolist()) < LIMIT):
                    at.append(i)
                    out.append(v.astype(np.int64).tobytes())
                    dims.append(hi - lo)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "label", "anchor", "dim", "vec"])

    return rows.where("id is not null and label is not null and v is not null").mapInArrow(run, "id long, label long, anchor boolean, dim int, vec binary")


def _pack(rows: DataFrame, size: int, bands: bool = False) -> DataFrame:
    """Rows (uid, id, label, dim, vec[, lo, hi]) as blocks, one binary for each column."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            own = held.pop(dim)
            n, cells = len(own), list(zip(*own, strict=True))
            packed = [np.array(c, np.int64).tobytes() for c in cells[:3]] + [b"".join(c) for c in cells[3:]]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)], ["dim", "n", *names])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, *range(4, batch.num_columns))]
            for dim, *row in zip(batch.column(3).to_pylist(), *columns, strict=True):
                own = held.setdefault(dim, [])
                own.append(row)
                if len(own) == size:
                    yield out(dim)
                elif len(held) > 64:  # many lengths: blocks of the first one go out unfilled
                    yield out(next(iter(held)))
        for dim in list(held):
            yield out(dim)

    names = ["uid", "id", "label", "vec", *(["lo", "hi"] if bands else [])]
    return rows.select("uid", "id", "label", "dim", "vec", *(["lo", "hi"] if bands else [])).mapInArrow(run, "dim int, n int, " + ", ".join(f"{n} binary" for n in names))


class Rotated:
    """Two blocks on the principal axes of the second one's second moments."""

    def __init__(self, a: np.ndarray, v: np.ndarray):
        d = v.shape[1]
        self.a, self.v = a, v
        fa, fv = a.astype(np.float64), v.astype(np.float64)
        q = np.linalg.eigh(fv.T @ fv)[1][:, ::-1]
        self.cuts = sorted({d // 8, d // 4, d // 2} - {0}) or [d]
        self.ra, self.rv = fa @ q, fv @ q
        # What the remaining components can add at most, for each cut.
        self.ta, self.tv = ([np.sqrt((r[:, k:] ** 2).sum(1)) for k in self.cuts] for r in (self.ra, self.rv))
        off = float(np.linalg.norm(q.T @ q - np.eye(d)))
        slack = 2 * off + 16 * d**1.5 * 2.0**-52
        self.na, self.nv = np.sqrt((fa**2).sum(1)) * slack, np.sqrt((fv**2).sum(1))

    def survivors(self, rows: np.ndarray, cols: np.ndarray, allowed: np.ndarray | None, low: np.ndarray, high: np.ndarray | None, best: int = 0):
        """Pairs (row, column) whose score may lie from ``low`` to ``high``, or among the row's ``best`` ones."""
        p = np.zeros((len(rows), len(cols)))
        done, low = 0, low.astype(np.float64)
        slack = self.na[rows][:, None] * self.nv[cols][None, :]
        mask = np.ones(p.shape, bool) if allowed is None else allowed
        i = j = None
        for n, k in enumerate(self.cuts):
            if i is None:
                p += self.ra[rows, done:k] @ self.rv[cols, done:k].T
                rest = self.ta[n][rows][:, None] * self.tv[n][cols][None, :] + slack
                if best and len(cols) > best:
                    sure = np.where(mask, p - rest, -np.inf)
                    low = np.maximum(low, np.partition(sure, len(cols) - best, axis=1)[:, len(cols) - best])
                mask = mask & (p + rest >= low[:, None])
                if high is not None:
                    mask &= p - rest <= high[:, None]
                if np.count_nonzero(mask) * 16 < mask.size or k == self.cuts[-1]:
                    i, j = np.nonzero(mask)
                    p = p[i, j]
            else:
                p = p + np.einsum("ij,ij->i", self.ra[rows[i], done:k], self.rv[cols[j], done:k])
                rest = self.ta[n][rows[i]] * self.tv[n][cols[j]] + slack[i, j]
                keep = p + rest >= low[i]
                if high is not None:
                    keep &= p - rest <= high[i]
                i, j, p = i[keep], j[keep], p[keep]
            done = k
        return rows[i], cols[j]

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", self.a[i[k : k + PAIRS]], self.v[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
        return np.concatenate([np.zeros(0, np.int64), *parts])


def first_of(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """Places of each group's ``k`` highest scores, ties by id."""
    order = np.lexsort((uid, ids, -score, group))
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return order[rank < k]


class Best:
    """The best rows so far of each group, as columns (group, score, id, uid)."""

    def __init__(self, groups: int, k: int):
        self.k, self.held, self.kth = k, [np.zeros(0, np.int64)] * 4, np.full(groups, -np.inf)

    def add(self, group, score, ids, uid) -> None:
        columns = [np.concatenate(x) for x in zip(self.held, (group, score, ids, uid), strict=True)]
        keep = first_of(self.k, *columns)
        self.held = [c[keep] for c in columns]
        g, s = self.held[:2]
        size = np.bincount(g, minlength=len(self.kth))
        full = np.flatnonzero(size >= self.k)
        last = np.cumsum(size) - 1
        self.kth[full] = s[last[full]]


def _longs(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int64)


def _best_pairs(rule: Rule, negatives: bool):
    """Over pairs of blocks: of each anchor (and positive) the best rows that this task has seen."""
    k = rule.negatives if negatives else rule.positives
    out = ["a_uid", "a_id", "p", "uid", "id", "score"]

    def emit(state):
        _, a_uid, a_id, best = state
        group, score, ids, uid = best.held
        per = rule.positives if negatives else 1
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a_uid[group // per], a_id[group // per], group % per, uid, ids, score)], out)

    def run(batches):
        state = None
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {n: batch.column(n)[r] for n in batch.schema.names}
                block, d = cell["block"].as_py(), cell["dim"].as_py()
                a_uid, a_id, a_label = (_longs(cell[n]) for n in ("a_uid", "a_id", "a_label"))
                if state is None or state[0] != block:
                    if state is not None:
                        yield emit(state)
                    state = (block, a_uid, a_id, Best(len(a_uid) * (rule.positives if negatives else 1), k))
                best = state[3]
                uid, ids, label = (_longs(cell[n]) for n in ("uid", "id", "label"))
                both = Rotated(_longs(cell["a_vec"]).reshape(-1, d), _longs(cell["vec"]).reshape(-1, d))
                if negatives:
                    lo, hi = (_longs(cell[n]).reshape(-1, rule.positives) for n in ("lo", "hi"))
                    every = np.arange(len(uid))
                    for at in range(0, len(a_uid), AT_ONCE):
                        rows = np.arange(at, min(at + AT_ONCE, len(a_uid)))
                        kth = best.kth.reshape(-1, rule.positives)[rows]
                        low, high = np.maximum(lo[rows], kth).min(1), hi[rows].max(1).astype(np.float64)
                        i, j = both.survivors(rows, every, a_label[rows][:, None] != label[None, :], low, high)
                        s = both.exact(i, j)
                        for p in range(rule.positives):
                            fit = (lo[i, p] <= s) & (s <= hi[i, p])
                            best.add(i[fit] * rule.positives + p, s[fit], ids[j[fit]], uid[j[fit]])
                else:
                    order = np.argsort(label, kind="stable")
                    for value in np.unique(a_label):
                        cols = order[np.searchsorted(label[order], value) : np.searchsorted(label[order], value, "right")]
                        own = np.flatnonzero(a_label == value)
                        for at in range(0, len(own), AT_ONCE) if len(cols) else []:
                            rows = own[at : at + AT_ONCE]
                            i, j = both.survivors(rows, cols, a_uid[rows][:, None] != uid[cols][None, :], best.kth[rows], None, k)
                            best.add(i, both.exact(i, j), ids[j], uid[j])
        if state is not None:
            yield emit(state)

    return tidy(run)


def _pairs(anchors: DataFrame, blocks: DataFrame, strips: int) -> DataFrame:
    """Each block of anchors with each block of vectors of the same length, strip by strip.

    Both sides are shuffled: packed files look small to the planner, and a broadcast would hold every block of anchors once for each strip.
    """
    named = anchors.select("dim", F.monotonically_increasing_id().alias("block"), *(F.col(c).alias(f"a_{c}") for c in ("uid", "id", "label", "vec")), *[c for c in ("lo", "hi") if c in anchors.columns])
    dealt = named.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    return dealt.hint("merge").join(blocks, ["dim", "strip"]).drop("strip", "n")


def mine(vectors: DataFrame, anchor: Column, rule: Rule = Rule(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` says which rows are anchors."""
    spark = vectors.sparkSession
    rows = Table(prepare(vectors, anchor, rule, id_col, vector_col, label_col).withColumn("uid", F.monotonically_increasing_id()), "negatives-rows").df
    packed = Table(_pack(rows, BLOCK), "negatives-blocks").df
    n_blocks, n_anchors = packed.count(), rows.where("anchor").count()
    strips = max(1, -(-n_blocks // STRIP), min(n_blocks, 4 * spark.sparkContext.defaultParallelism))
    blocks = packed.withColumn("strip", F.pmod(F.xxhash64("uid"), F.lit(strips)).cast("int"))
    groups = max(1, -(-n_anchors // BLOCK))
    anchors = rows.where("anchor").repartition(groups, "uid")
    seen = "a_uid long, a_id long, p long, uid long, id long, score long"
    near = _pairs(Table(_pack(anchors, BLOCK), "negatives-anchors").df, blocks, strips).mapInArrow(_best_pairs(rule, False), seen)
    by_score = [F.col("score").desc(), "id", "uid"]
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("a_uid").orderBy(*by_score))).where(F.col("r") <= rule.positives)
    positives = Table(ranked.select("a_uid", "a_id", (F.col("r") - 1).cast("long").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives").df
    ends = positives.groupBy("a_uid").agg(F.sort_array(F.collect_list(F.struct("p", "positive_score"))).alias("b")).mapInArrow(_ends(rule), "b_uid long, lo binary, hi binary")
    banded = Table(_pack(anchors.hint("merge").join(ends, F.col("uid") == F.col("b_uid")).repartition(groups, "uid"), BLOCK, bands=True), "negatives-bands").df
    hard = _pairs(banded, blocks, strips).mapInArrow(_best_pairs(rule, True), seen).drop("a_id")
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("a_uid", "p").orderBy(*by_score))).where(F.col("rank") <= rule.negatives)
    whole = ranked.select("a_uid", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge").join(positives, ["a_uid", "p"])
    return whole.select(F.col("a_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def band(score: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest integer from ``low`` to ``high`` percent of a score, without overflow."""
    whole, part = score // 100, score % 100
    return whole * rule.low - (-part * rule.low) // 100, whole * rule.high + part * rule.high // 100


def _ends(rule: Rule):
    """The ends of each positive's band; of a positive that an anchor lacks, an empty one."""

    def run(batches):
        for batch in batches:
            lo, hi = [], []
            for entry in batch.column(1).to_pylist():
                a, b = band(np.array([x["positive_score"] for x in entry], np.int64), rule)
                lacking = rule.positives - len(entry)
                lo.append(np.concatenate([a, np.full(lacking, LIMIT)]).tobytes())
                hi.append(np.concatenate([b, np.full(lacking, -LIMIT)]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lo, pa.binary()), pa.array(hi, pa.binary())], ["b_uid", "lo", "hi"])

    return run


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as a_label, b.vec_id, b.label, list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
pos as (select anchor_id, a_label, vec_id as positive_id, score as positive_score from scored where label = a_label qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
neg as (
  select p.anchor_id, positive_id, s.vec_id as negative_id, positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from pos p join scored s on p.anchor_id = s.anchor_id and s.label <> p.a_label and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from neg where rank <= 3
"""
