"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is mapped to letters (case folded, everything else a separator); every byte
n-gram of 1 to 4 bytes that has no separator inside is hashed to one of ``buckets``
embedding rows; the embeddings are averaged and a linear softmax gives the language.
Embeddings and output layer are trained together by stochastic gradient descent in
numpy.  A temperature fitted on documents kept out of training calibrates the
confidence, and documents below a threshold chosen on them are rejected.

Defined results: a null text, an empty one and one without a letter give ``und``, score
0 and are rejected; equal texts give equal rows; without any labelled row every text is
``und``.  Extra columns are carried through by ``identify(keep=...)``.
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

NGRAMS = (1, 2, 3, 4)
#: Bytes looked at in one go; longer texts are taken in overlapping slices.
SLICE = 1 << 20
UNDETERMINED = "und"


def _letter_table() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    for c in range(ord("a"), ord("z") + 1):
        table[c] = c
        table[c - 32] = c
    table[0x80:] = np.arange(0x80, 0x100)
    return table


_LETTERS = _letter_table()


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower-case letters and spaces, with one space at either end (ASCII and Latin-1 capitals fold)."""
    out = np.empty(len(raw) + 2, np.uint8)
    out[0] = out[-1] = 32
    out[1:-1] = _LETTERS[raw]
    caps = np.flatnonzero((out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[:-1] == 0xC3)) + 1
    out[caps] += 32
    return out


def histogram(folded: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords and how often each occurs."""
    total = np.zeros(buckets + 1, np.int64)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    longest = max(NGRAMS)
    for lo in range(0, len(folded), SLICE):
        part = folded[lo : lo + SLICE + longest - 1]
        own = min(SLICE, len(folded) - lo)
        sep = part == 32
        h = np.zeros(len(part), np.uint32)
        bad = np.zeros(len(part), bool)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            m = len(part) - n + 1
            h = h[:m] * np.uint32(0x01000193) + part[n - 1 :].astype(np.uint32) + np.uint32(1)
            if n > 2:
                bad = bad[:m] | sep[n - 2 : n - 2 + m]
            ids = (h * np.uint32(0x9E3779B1)) >> shift
            skip = bad[:m] | (sep[:m] & sep[n - 1 : n - 1 + m])
            ids = np.where(skip, np.uint32(buckets), ids)[:own]
            total += np.bincount(ids, minlength=buckets + 1)
    idx = np.flatnonzero(total[:-1])
    return idx.astype(np.int32), total[idx].astype(np.float32)


def has_letter(raw: np.ndarray) -> bool:
    if ((raw | 32) - 97 < 26).any():
        return True
    return bool((raw >= 0x80).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


@dataclass
class LanguageModel:
    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, idx: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mean = counts @ self.embeddings[idx] / counts.sum()
        z = (mean @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, raw: np.ndarray | None) -> tuple[str, float, bool]:
        if raw is None or not self.labels or not has_letter(raw):
            return UNDETERMINED, 0.0, False
        idx, counts = histogram(fold(raw), len(self.embeddings))
        if not len(idx):
            return UNDETERMINED, 0.0, False
        p = self.probabilities(idx, counts)
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] >= self.threshold)


def _examples(id_text: str, raw: np.ndarray, buckets: int):
    """The whole text and two short spans of it at places that its id decides, so that short texts are learned too."""
    folded = fold(raw)
    yield 0, histogram(folded, buckets)
    starts = np.flatnonzero((folded[1:] != 32) & (folded[:-1] == 32)) + 1
    rng = np.random.default_rng(crc32(id_text.encode()))
    for kind, most in ((1, 3), (2, 16)):
        if len(starts) > most:
            a = int(rng.integers(0, len(starts) - most))
            b = a + int(rng.integers(1, most + 1))
            yield kind, histogram(folded[starts[a] - 1 : starts[b]], buckets)


def train(rows: list[tuple[str, bool, int, np.ndarray, np.ndarray]], *, buckets: int, dim: int, epochs: int, rate: float, seed: int, max_error: float) -> LanguageModel:
    """``rows``: label, for calibration, kind, buckets, counts; in an order that doesn't depend on the cluster."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return LanguageModel([], np.zeros((1, dim), np.float32), np.zeros((dim, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    code = {x: i for i, x in enumerate(labels)}
    fit = [r for r in rows if not r[1]] or rows
    size = np.bincount([code[r[0]] for r in fit], minlength=len(labels)).astype(np.float32)
    balance = np.sqrt(size.max() / np.maximum(size, 1))
    batch = 32
    steps, step = max(1, epochs * -(-len(fit) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for lo in range(0, len(order), batch):
            take = [fit[i] for i in order[lo : lo + batch]]
            ids, back = np.unique(np.concatenate([r[3] for r in take]), return_inverse=True)
            x = np.zeros((len(take), len(ids)), np.float32)
            at = 0
            for i, r in enumerate(take):
                x[i, back[at : at + len(r[3])]] = r[4] / r[4].sum()
                at += len(r[3])
            y = np.array([code[r[0]] for r in take])
            mean = x @ emb[ids]
            z = mean @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= balance[y][:, None]
            now = rate * (1 - step / steps)
            grad = p @ w.T
            w -= now * (mean.T @ p)
            bias -= now * p.sum(0) * 0.1
            emb[ids] -= now * (x.T @ grad)
            step += 1
    model = LanguageModel(labels, emb, w, bias, 1.0, 0.0)
    held = [r for r in rows if r[1]] or fit
    z = np.array([(r[4] @ emb[r[3]] / r[4].sum()) @ w + bias for r in held])
    y = np.array([code[r[0]] for r in held])

    def softmax(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.25, 8, 61)
    losses = [-np.log(softmax(t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = softmax(model.temperature)
    best, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-best, kind="stable")
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(errors <= max_error)
    # The lowest confidence down to which the accepted ones err seldom enough; one label at even odds is always enough.
    model.threshold = float(min(best[order[good[-1]]] if len(good) else 0.5, 0.5))
    return model


def fit(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", where: Column | None = None, per_label: int = 600, max_labels: int = 8192, max_rows: int = 120_000, buckets: int = 1 << 15, dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 7, max_error: float = 0.02) -> LanguageModel:
    """Fit on about ``per_label`` labelled documents of each language (``max_rows`` of all), drawn by a hash of id and text.

    The bounds hold whatever the size of the corpus.  N-gram counts of the sampled documents
    are made on the executors and meet in one task, which trains; only the model reaches the
    driver.  ``where`` limits the rows learned from; equal rows are drawn once.
    """
    spark = docs.sparkSession
    ship(spark)
    how = {"buckets": buckets, "dim": dim, "epochs": epochs, "rate": rate, "seed": seed, "max_error": max_error}
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), (F.lit(True) if where is None else where).alias("ok"))
    rows = rows.where("ok and label is not null and text is not null")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(max_labels + 1).collect()}
    if len(sizes) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not sizes:
        return train([], **how)
    wanted = min(per_label, max(1, max_rows // len(sizes)))
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, wanted / n))])
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("text")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = rows.where(place < share[F.col("label")]).select("id", "label", "text").dropDuplicates()

    def features(batches):
        for batch in batches:
            out = []
            for i, label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                if has_letter(raw):
                    cal = crc32(f"calibrate {i}".encode()) % 5 == 0
                    out += [(i or "", label, cal, kind, x.tobytes(), c.tobytes()) for kind, (x, c) in _examples(i or "", raw, buckets) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()))], ["id", "label", "cal", "kind", "idx", "n"])

    def learn(batches):
        got = []
        for batch in batches:
            got += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        got.sort(key=lambda r: (r[1], r[0], r[3], r[4]))
        model = train([(label, cal, kind, np.frombuffer(x, np.int32), np.frombuffer(n, np.float32)) for _, label, cal, kind, x, n in got], **how)
        del got
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = drawn.mapInArrow(features, "id string, label string, cal boolean, kind int, idx binary, n binary")
    models = made.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else train([], **how)


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str], prefix: str = "") -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score and accepted (each name after ``prefix``)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x dim floats, whatever the corpus
    names = [f"{prefix}{x}" for x in ("lang_pred", "score", "accepted")]
    if clash := set(names) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are there already; give another prefix")
    inner = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [m.predict(raw) for raw in utf8(batch.column(batch.num_columns - 1))]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*batch.schema.names[:-1], *names])

    return inner.mapInArrow(tidy(run), schema)
