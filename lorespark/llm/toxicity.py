"""Toxicity: a factorization machine over hashed terms.

The terms of a text (runs of letters, case folded, and their stems) are hashed to ``buckets``; the
machine has a weight and a small vector for each bucket of the sample, so that beside the
additive weights it learns what two terms mean together, even where neither tells
anything alone; a penalty, the same for rare and common terms, keeps rare ones small.  It is trained in numpy by
AdaGrad steps on a bounded sample of labelled documents.

Defined results: a null or empty text scores as a text without terms (the bias alone);
repeated rows score alike; without labelled rows every score is 0; a document labelled
more than once is toxic if any of its labels says so.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32, give_back, ship, tidy, utf8
from .langid import fold

#: Bytes hashed in one go; slices end between words unless a word is longer than this.
SLICE = 1 << 20
#: A word's first so many bytes are terms too, so that endings don't hide a root.
STEMS = (4, 5, 6)
#: Multipliers by place in a word; a longer word's further letters take them again.
_PLACES = np.random.default_rng(20240501).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def terms(raw: np.ndarray | None, bits: int) -> np.ndarray:
    """Distinct buckets of a text's terms, in order."""
    if raw is None or not len(raw):
        return np.zeros(0, np.int32)
    found = []
    lo = 0
    while lo < len(raw):
        hi = min(lo + SLICE, len(raw))
        if hi < len(raw):
            gaps = np.flatnonzero(raw[lo:hi] == 32)
            hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
        text = fold(raw[lo:hi])
        lo = hi
        letter = text != 32
        starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        if not len(starts):
            continue
        at = np.flatnonzero(letter)
        first = np.searchsorted(at, starts)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        h = np.add.reduceat(text[at].astype(np.uint64) * _PLACES[place & 63], first)
        hashes = [h]
        long = np.diff(np.append(first, len(at)))
        for k in STEMS:
            own = starts[long > k]
            stem = np.full(len(own), k, np.uint64)
            for j in range(k):
                stem += text[own + j].astype(np.uint64) * _PLACES[j]
            hashes.append(stem)
        h = np.concatenate(hashes)
        h ^= h >> np.uint64(29)
        found.append(np.unique((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)))
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.zeros(0, np.int32)


@dataclass
class FactorizationMachine:
    bits: int
    slots: np.ndarray  # bucket -> place of its weights, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    trained: bool = True

    def score_terms(self, buckets: np.ndarray) -> float:
        if not self.trained:
            return 0.0
        at = self.slots[buckets]
        at = at[at >= 0]
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        z = self.bias + float(self.weights[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, raw: np.ndarray | None) -> float:
        return self.score_terms(terms(raw, self.bits))


def _informative(docs: list[np.ndarray], y: np.ndarray, bits: int, most: int = 4096, least_df: int = 3) -> np.ndarray:
    """Buckets whose share among toxic documents differs most surely from that among the others."""
    pos = np.bincount(np.concatenate([d for d, t in zip(docs, y, strict=True) if t] or [np.zeros(0, np.int32)]), minlength=1 << bits).astype(float)
    neg = np.bincount(np.concatenate([d for d, t in zip(docs, y, strict=True) if not t] or [np.zeros(0, np.int32)]), minlength=1 << bits).astype(float)
    n1, n0 = max(1, y.sum()), max(1, len(y) - y.sum())
    odds = np.log((pos + 0.5) / (n1 - pos + 0.5)) - np.log((neg + 0.5) / (n0 - neg + 0.5))
    error = np.sqrt(1 / (pos + 0.5) + 1 / (n1 - pos + 0.5) + 1 / (neg + 0.5) + 1 / (n0 - neg + 0.5))
    z = np.where(pos + neg >= least_df, np.abs(odds / error), 0)
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 2.0])


def train(docs: list[np.ndarray], labels: np.ndarray, *, bits: int, rank: int, epochs: int, rate: float, l2: float, seed: int, terms_kept: int | None = None) -> FactorizationMachine:
    """Every bucket of ``docs`` gets a weight and a vector; ``terms_kept`` leaves only the most frequent ones.

    Half of the passes are over the buckets that tell something alone, so that the many that
    do not have only what is left to explain; the other half are over all, in smaller steps.
    """
    y = np.asarray(labels, np.int8)
    slots = np.full(1 << bits, -1, np.int32)
    if not len(docs):
        return FactorizationMachine(bits, slots, 0.0, np.zeros(0), np.zeros((0, rank)), False)
    kept, df = np.unique(np.concatenate(docs), return_counts=True)
    if terms_kept is not None and len(kept) > terms_kept:
        some = np.sort(np.argsort(-df, kind="stable")[:terms_kept])
        kept, df = kept[some], df[some]
    slots[kept] = np.arange(len(kept))
    rng = np.random.default_rng(seed)
    batch, held = 64, max(1.0, df.sum() / len(docs))
    early = np.zeros(len(kept), bool)
    some = slots[_informative(docs, y, bits)]
    early[some[some >= 0]] = True
    # The more terms a text has, the smaller the vectors to start from, so that their pairs' sum stays small.
    w, v = np.zeros(len(kept)), rng.normal(0, 0.02 * min(1, np.sqrt(16 / held)), (len(kept), rank))
    gw = np.where(early, 1e-6, 10 * held / batch**2)
    gv = np.repeat(gw[:, None], rank, 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    rare = np.sqrt((1 - share) / share)  # the rarer class counts more, by the root of the odds
    bias, gb = float(np.log(share / (1 - share))), 1e-6
    # A penalty falls due only in batches that hold the term: the rarer the term, the more of it at once.
    due = l2 / (1 - (1 - df / len(docs)) ** batch)
    every = [at[at >= 0] for at in (slots[d] for d in docs)]
    for rows in [[r[early[r]] for r in every]] * (epochs if early.any() else 0) + [every] * (epochs if len(kept) else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            take = order[lo : lo + batch]
            n = np.array([len(rows[i]) for i in take])
            at, of = np.concatenate([rows[i] for i in take]), np.repeat(np.arange(len(take)), n)
            ids, back = np.unique(at, return_inverse=True)
            own, s = v[at], np.zeros((len(take), rank))
            if len(at):
                s[n > 0] = np.add.reduceat(own, (np.cumsum(n) - n)[n > 0])
            z = bias + np.bincount(of, w[at] - 0.5 * (own**2).sum(1), len(take)) + 0.5 * (s**2).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) * np.where(y[take] == 1, rare, 1) / len(take)
            db = g.sum()
            sums = np.bincount(back, g[of], len(ids))
            cross = np.stack([np.bincount(back, (g * s[:, j])[of], len(ids)) for j in range(rank)], 1)
            dw = sums + due[ids] * w[ids]
            dv = cross - sums[:, None] * v[ids] + due[ids][:, None] * v[ids]
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
            gw[ids] += dw * dw
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            gv[ids] += dv * dv
            v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
    return FactorizationMachine(bits, slots, bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", where: Column | None = None, per_class: int = 12_000, bits: int = 18, rank: int = 8, epochs: int = 16, rate: float = 0.1, l2: float = 5e-4, seed: int = 11) -> FactorizationMachine:
    """Fit on at most about ``per_class`` labelled documents of each class, drawn by a hash of the id.

    The bound holds whatever the corpus; term buckets of the sampled documents meet in one
    task, which trains, and only the machine reaches the driver.  Equal rows are drawn once.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), (F.lit(True) if where is None else where).alias("ok")).where("ok and y is not null and id is not null").groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes:
        return train([], np.zeros(0), bits=bits, rank=rank, epochs=epochs, rate=rate, l2=l2, seed=seed)
    # One share for both classes, so that the sample keeps the corpus's odds.
    share = min(1.0, 2 * per_class / sum(sizes.values()))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = known.where(place < share).select("id", "y").limit(3 * per_class)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select(F.col("id").cast("string").alias("id"), "y", "text").dropDuplicates()
    how = {"bits": bits, "rank": rank, "epochs": epochs, "rate": rate, "l2": l2, "seed": seed}

    def features(batches):
        for batch in batches:
            lists = [terms(raw, bits).tobytes() for raw in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary())], ["id", "y", "terms"])

    def learn(batches):
        got = []
        for batch in batches:
            got += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        got.sort(key=lambda r: (crc32(r[0].encode()), r[0], r[2]))
        model = train([np.frombuffer(t, np.int32) for _, _, t in got], np.array([y for _, y, _ in got]), **how)
        del got
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = sample.mapInArrow(features, "id string, y int, terms binary")
    models = made.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else train([], np.zeros(0), **how)


def score(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text", keep: list[str], output: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` with the score of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^bits slots and at most as many vectors
    if output in keep:
        raise ValueError(f"column {output} is there already; give another name")
    inner = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField(output, T.DoubleType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            got = pa.array([m.score(raw) for raw in utf8(batch.column(batch.num_columns - 1))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], [*batch.schema.names[:-1], output])

    return inner.mapInArrow(tidy(run), schema)
