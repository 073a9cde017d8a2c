"""Embedding near-duplicates by NN-descent.

Distinct vectors get neighbour lists from random-hyperplane buckets (the more tables, the
finer the buckets of a larger input; vectors that share no bucket get arbitrary neighbours
to start from), then lists are refined by local joins: whoever is near one vector (in its list, or having it in theirs)
is compared with one another.  Lists full of neighbours over the threshold are saturated
and keep more.  Searching uses codes of the directions (one
byte a component, two where that would turn a vector too far); every pair seen over the
threshold is verified in double precision, and connects its two vectors.  Vectors that
are connected form a component, in which the lists of all members are at last enlarged to
the whole component, block by block, so that links are counted without being emitted.
An audit compares a bounded set of queries with all vectors, half of them drawn among the
vectors with few or no links, and averages over vectors; while it finds too many links
missing, rounds with as many tables again follow.  Once those would cost more than all
pairs, all pairs are compared in blocks.  The recall of every audit is logged.

Defined results: vectors that are null, empty or zero, or that hold null or non-finite
components, link with nothing; vectors of different lengths do not link; equal vectors
link with each other and count one by one; a repeated id is one vector for each of its
distinct values and one row for each of its rows.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, ship
from .components import components

#: Vectors compared at once inside a bucket, and in a block of a component.
CHUNK, BLOCK = 128, 512
#: Tables written at once; vectors that all others are compared with at once when all pairs are.
BATCH, STRIP = 8, 4096
#: Share of the links at the threshold that the first tables are to bring together, and pairs of all pairs that cost as much as a vector's place in a table.
MET, PAIRS = 0.98, 512
#: Links up to which a vector is one with few.
FEW = 3
_log = logging.getLogger(__name__)


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.float64) for x in column]


def directions(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): finite, non-zero vectors as bytes of doubles; vec is null for the others."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            column, out = batch.column(1), []
            flat, sizes = column.flatten(), column.value_lengths().fill_null(0).to_numpy()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            ends = np.cumsum(sizes)
            for lo, hi in zip(ends - sizes, ends, strict=True):
                v = values[lo:hi]
                with np.errstate(over="ignore", under="ignore"):
                    fine = len(v) and np.isfinite(v).all() and v.any()
                # Scaled by a power of two, so that no square overflows or vanishes.
                out.append(np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])).tobytes() if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    return rows.mapInArrow(run, "id long, vec binary")


#: How far a code's direction may be off (as a sine): two such errors change a cosine of 0.9 by less than ``SLACK``.
OFF, SLACK = 0.02, 0.02


def code_of(v: np.ndarray, width: int) -> bytes:
    top = (1 << (8 * width - 1)) - 1
    return np.rint(v * (top / np.abs(v).max())).astype(f"i{width}").tobytes()


def off(v: np.ndarray, width: int) -> float:
    """A bound on the sine of the angle between a vector and its code: rounding moves each component by at most a half."""
    return float(0.5 * np.sqrt(len(v)) * np.abs(v).max() / (((1 << (8 * width - 1)) - 1) * np.linalg.norm(v)))


def _width(nodes: DataFrame) -> int:
    """Bytes of a code's component: one, unless that would turn some vector too far."""

    def run(batches):
        for batch in batches:
            worst = max((off(v, 1) for v in _matrix(batch.column(0))), default=0.0)
            yield pa.RecordBatch.from_arrays([pa.array([worst])], ["off"])

    return 1 if (nodes.select("vec").mapInArrow(run, "off double").agg(F.max("off")).collect()[0][0] or 0.0) <= OFF else 2


def _unit(codes: list[bytes], width: int) -> np.ndarray:
    c = np.frombuffer(b"".join(codes), f"i{width}").reshape(len(codes), -1).astype(np.float32)
    return c / np.linalg.norm(c, axis=1, keepdims=True)


_CANDIDATE = "u long, v long, sim float, star boolean"


def _local_join(ids: np.ndarray, codes: list[bytes], k: int, loose: float, width: int):
    """Each member's best others, and for each its smallest other that looks linked (star)."""
    lengths = {len(c) for c in codes}
    if len(lengths) > 1:
        for n in sorted(lengths):
            own = [i for i, c in enumerate(codes) if len(c) == n]
            yield from _local_join(ids[own], [codes[i] for i in own], k, loose, width)
        return
    if len(ids) < 2:
        return
    c = _unit(codes, width)
    s = c @ c.T
    np.fill_diagonal(s, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-s, axis=1)[:, :k]
    yield np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel(), False
    linked = s >= loose
    some = np.flatnonzero(linked.any(1))
    if len(some):
        to = np.where(linked[some], ids, np.iinfo(np.int64).max).min(1)
        yield ids[some], to, np.full(len(some), loose, np.float32), True


def _grouped(k: int, loose: float, chunk: int | None, width: int):
    """A function over batches of (group, id, code), sorted by group: local joins of each group, in chunks that overlap by half if told."""

    def emit(found):
        found = list(found)
        if found:
            u, v, s = (np.concatenate([f[j] for f in found]) for j in range(3))
            star = np.concatenate([np.full(len(f[0]), f[3]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s.astype(np.float32)), pa.array(star)], ["u", "v", "sim", "star"])

    def run(batches):
        half = chunk // 2 if chunk else None
        keep_g, keep_i, keep_c = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        before, joined = None, False  # the last half chunk, and whether it was joined with the one before it

        def push(piece):
            nonlocal before, joined
            last, was, before, joined = before, joined, piece, False
            if last is None:
                return []
            if piece is not None and piece[0] == last[0]:
                joined = True
                return list(_local_join(np.concatenate([last[1], piece[1]]), last[2] + piece[2], k, loose, width))
            return [] if was else list(_local_join(last[1], last[2], k, loose, width))

        for batch in batches:
            g = np.concatenate([keep_g, batch.column(0).to_numpy()])
            i = np.concatenate([keep_i, batch.column(1).to_numpy()])
            c = keep_c + batch.column(2).to_pylist()
            cuts = np.flatnonzero(np.diff(g)) + 1
            if half:
                edges = np.concatenate([[0], cuts, [len(g)]])
                cuts = np.unique(np.concatenate([np.arange(a, b, half) for a, b in zip(edges[:-1], edges[1:], strict=True)])) if len(g) else cuts
                cuts = cuts[cuts > 0]
            last = int(cuts[-1]) if len(cuts) else 0
            found = []
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True) if len(cuts) else []:
                found += push((int(g[a]), i[a:b], c[a:b]))
            yield from emit(found)
            keep_g, keep_i, keep_c = g[last:], i[last:], c[last:]
        found = push((int(keep_g[0]), keep_i, keep_c)) if len(keep_g) else []
        yield from emit(found + push(None))

    return run


def _buckets(nodes: DataFrame, tables: int, bits: int, seed: int, width: int) -> DataFrame:
    """(group, place, id, code): each vector in a bucket of each table, placed in it along one more direction."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(), _matrix(batch.column(1))
            out = [[], [], [], []]
            for d in sorted({len(v) for v in vecs}):
                own = [k for k, v in enumerate(vecs) if len(v) == d]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).normal(size=(d, tables * (bits + 1)))
                x = np.stack([vecs[k] for k in own])
                z = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ planes[d]
                codes = [code_of(vecs[k], width) for k in own]
                for t in range(tables):
                    part = z[:, t * (bits + 1) : (t + 1) * (bits + 1)]
                    key = (part[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(own), np.int64)
                    out[0].append(key * tables + t)
                    out[1].append(part[:, bits])
                    out[2].append(ids[own])
                    out[3] += codes
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2])), pa.array(out[3], pa.binary())], ["group", "place", "id", "code"])

    rows = nodes.select("id", "vec").mapInArrow(run, "group long, place double, id long, code binary")
    # By range, so that a bucket of any size is spread over tasks.
    return rows.repartitionByRange("group", "place").sortWithinPartitions("group", "place")


def _refine(graph: DataFrame, coded: DataFrame, k: int, loose: float, seed: int, width: int) -> DataFrame:
    """One local join around every vector: members are its list and about ``k`` of those that list it."""
    back = graph.groupBy("v").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "u", "v"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    reverse = graph.join(back, "v").where(draw * F.col("n") < k).select(F.col("v").alias("group"), F.col("u").alias("id"))
    own = graph.select("u").distinct().select(F.col("u").alias("group"), F.col("u").alias("id"))
    members = graph.select(F.col("u").alias("group"), F.col("v").alias("id")).unionByName(reverse).unionByName(own).distinct()
    rows = members.join(coded, "id").select("group", "id", "code").repartition("group").sortWithinPartitions("group", "id")
    return rows.mapInArrow(_grouped(k, loose, None, width), _CANDIDATE)


def _best(candidates: DataFrame, k: int, enlarged: int, threshold: float) -> DataFrame:
    """Lists of the ``k`` nearest; of a saturated list, neighbours over the threshold up to ``enlarged``."""
    once = candidates.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return once.withColumn("r", place).where((F.col("r") <= k) | ((F.col("r") <= enlarged) & (F.col("sim") >= threshold))).drop("r")


def _verify(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose cosine in double precision is at least the threshold."""
    met = pairs.join(nodes.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a").join(nodes.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")

    def run(batches):
        for batch in batches:
            x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
            ok = [len(p) == len(q) and bool(_unit64([p])[0] @ _unit64([q])[0] >= threshold) for p, q in zip(x, y, strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _unit64(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links) over members (id, component, n, vec): every list enlarged to its component, in pairs of blocks."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # Block i meets every block j of its component: once as the rows counted for, once as those counted.
    twice = placed.select("component", "id", "n", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "block")
    lefts = twice.select("component", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("counted"), "id", "n", "vec")
    rights = twice.select("component", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("counted"), "id", "n", "vec")
    rows = lefts.unionByName(rights).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "counted")

    def tally(group):
        left, right = [r for r in group if r[3]], [r for r in group if not r[3]]
        a, b = _unit64([r[6] for r in left]), _unit64([r[6] for r in right])
        weight = np.array([r[5] for r in right], np.int64)
        counts = (a @ b.T >= threshold) @ weight
        return [r[4] for r in left], counts

    def run(batches):
        held, key = [], None
        for batch in batches:
            ids, links = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if held and any(r[3] for r in held):
                        i, n = tally(held)
                        ids += i
                        links += n.tolist()
                    held, key = [], row[:3]
                held.append(row)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], ["id", "links"])
        if held and any(r[3] for r in held):
            i, n = tally(held)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int64())], ["id", "links"])

    return rows.select("component", "i", "j", "counted", "id", "n", "vec").mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _against(nodes: DataFrame, drawn: list, threshold: float) -> DataFrame:
    """(id, links): the links of the drawn (id, vec), counted against all vectors."""
    by_size: dict[int, list] = {}
    for r in drawn:
        by_size.setdefault(len(r["vec"]), []).append((r["id"], bytes(r["vec"])))
    asked = nodes.sparkSession.sparkContext.broadcast({d: (np.array([i for i, _ in q]), _unit64([v for _, v in q])) for d, q in by_size.items()})

    def run(batches):
        for batch in batches:
            ids, links = [], []
            n, vecs = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for d, (q_ids, q) in asked.value.items():
                own = [k for k, v in enumerate(vecs) if len(v) == d]
                total = np.zeros(len(q_ids), np.int64)
                for lo in range(0, len(own), BLOCK):
                    some = own[lo : lo + BLOCK]
                    total += (q @ _unit64([vecs[k] for k in some]).T >= threshold) @ n[some]
                ids.append(q_ids)
                links.append(total)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links))], ["id", "links"])

    return nodes.select("id", "n", "vec").mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, counted: DataFrame, threshold: float, queries: int = 512, seed: int = 3) -> float:
    """Share of a vector's links that was found: the mean over vectors that have any, the lower one of two draws.

    One draw is of all vectors, one of those with few links or none found; each of at most ``queries``.
    """
    held = nodes.join(counted, "id", "left").select("id", "n", "vec", (F.coalesce("links", "n") - F.col("n")).alias("found"))
    order = F.xxhash64(F.lit(seed), "id")
    draws = [held.orderBy(order).limit(queries).collect(), held.where(F.col("found") <= FEW).orderBy(order).limit(queries).collect()]
    drawn = list({r["id"]: r for d in draws for r in d}.values())
    if not drawn:
        return 1.0
    truth = {r["id"]: r["links"] for r in _against(nodes, drawn, threshold).collect()}
    shares = [[r["found"] / (truth[r["id"]] - r["n"]) for r in d if truth[r["id"]] > r["n"]] for d in draws]
    return float(min([np.mean(s) for s in shares if s], default=1.0))


def _all_pairs(nodes: DataFrame, total: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, links) of every vector and links (a, b) that connect all that is linked: all pairs, a strip of vectors against all at a time."""
    strips = -(-total // STRIP)
    place = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(strips))
    counts, ties = [], []
    for strip in range(strips):
        by_size: dict[int, list] = {}
        for r in nodes.where(place == strip).select("id", "n", "vec").collect():
            by_size.setdefault(len(r["vec"]), []).append((r["id"], r["n"], bytes(r["vec"])))
        asked = nodes.sparkSession.sparkContext.broadcast({d: (np.array([i for i, _, _ in q]), np.array([n for _, n, _ in q]), _unit64([v for _, _, v in q])) for d, q in by_size.items()})

        def run(batches, asked=asked):
            # Vectors of the strip with one name are connected by ties sent already.
            names = {d: np.arange(len(q[0])) for d, q in asked.value.items()}
            for batch in batches:
                out = [[], [], []]
                ids, vecs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                for d, (q_ids, q_n, q) in asked.value.items():
                    own = [k for k, v in enumerate(vecs) if len(v) == d]
                    for lo in range(0, len(own), BLOCK):
                        some = own[lo : lo + BLOCK]
                        linked = _unit64([vecs[k] for k in some]) @ q.T >= threshold
                        n_links = linked @ q_n
                        for row in np.flatnonzero(n_links):
                            met, at = np.unique(names[d][linked[row]], return_index=True)
                            if len(met) > 1:
                                names[d][np.isin(names[d], met)] = met[0]
                            to = q_ids[linked[row]][at]
                            out[0] += [ids[some[row]]] * len(to)
                            out[1] += to.tolist()
                            out[2] += [n_links[row]] + [0] * (len(to) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "links"])

        found = Table(nodes.select("id", "vec").mapInArrow(run, "a long, b long, links long"), "nn-strip")
        asked.destroy()
        counts.append(found.df.select(F.col("a").alias("id"), "links"))
        ties.append(found.df.where("a <> b").select("a", "b"))
    links, tied = counts[0], ties[0]
    for c, t in zip(counts[1:], ties[1:], strict=True):
        links, tied = links.unionByName(c), tied.unionByName(t)
    return Table(links.groupBy("id").agg(F.sum("links").alias("links")), "nn-counts").df, tied


def _arbitrary(graph: DataFrame, coded: DataFrame, total: int, seed: int) -> DataFrame:
    """(group, id, code): groups of about 32 by a hash, those that hold a vector without a list."""
    group = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(-(-total // 32)))
    lone = coded.join(graph.select(F.col("u").alias("id")).distinct(), "id", "left_anti").select(group.alias("group")).distinct()
    return coded.select(group.alias("group"), "id", "code").join(lone, "group", "left_semi").repartition("group").sortWithinPartitions("group", "id")


def tables_for(threshold: float, bits: int, least: int) -> int:
    """Tables in which a pair at the threshold shares a bucket with probability ``MET``."""
    same = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return least if same >= 1 or same <= 0 else max(least, int(np.ceil(np.log(1 - MET) / np.log1p(-same))))


def link(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, k: int = 8, tables: int = 8, rounds: int = 2, recall: float = 0.99, seed: int = 5) -> DataFrame:
    """(id_col, n_links, component_id) of each row of ``vectors``; ``tables`` are made at least."""
    rows = Table(directions(vectors, id_col, vector_col), "nn-rows")
    nodes = Table(rows.df.where("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "vec"), "nn-nodes")
    total = nodes.df.count()
    bits = int(np.clip(np.round(np.log2(max(1, total) / 32)), 0, 30))
    width = _width(nodes.df)
    loose = threshold - SLACK
    coded = nodes.df.select("id", "vec").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([b.column(0), pa.array([code_of(v, width) for v in _matrix(b.column(1))], pa.binary())], ["id", "code"]) for b in it), "id long, code binary")
    stars: list[Table] = []
    graph, made, done = None, 0, 0

    def take(candidates: DataFrame, most: int) -> None:
        """Keep the stars of the candidates, and the best of them and of the lists as the lists."""
        nonlocal graph
        step = Table(candidates, "nn-candidates")
        stars.append(Table(step.df.where("star").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "nn-stars"))
        lists = step.df.where("not star").select("u", "v", "sim")
        better = Table(_best(lists if graph is None else lists.unionByName(graph.df), k, most, threshold), "nn-graph")
        if graph is not None:
            graph.drop()
        step.drop()
        graph = better

    while True:
        end = 2 * made or tables_for(threshold, bits, tables)
        while made < end:
            count = min(BATCH, end - made)
            take(_buckets(nodes.df, count, bits, seed + 7919 * made, width).select("group", "id", "code").mapInArrow(_grouped(k, loose, CHUNK, width), _CANDIDATE), k << done)
            made += count
        take(_arbitrary(graph.df, coded, total, seed + made).mapInArrow(_grouped(k, loose, CHUNK, width), _CANDIDATE), k << done)
        for _ in range(rounds if not done else 1):
            done += 1
            take(_refine(graph.df, coded, k, loose, seed + done, width), k << done)
        pairs = stars[0].df
        for s in stars[1:]:
            pairs = pairs.unionByName(s.df)
        listed = graph.df.where(F.col("sim") >= loose).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        links = Table(_verify(pairs.unionByName(listed).distinct(), nodes.df, threshold), "nn-links")
        names = components(links.df)
        members = nodes.df.join(names, "id").select("id", "component", "n", "vec")
        counted = Table(_count_links(members, threshold), "nn-counts").df
        share = audit(nodes.df, counted, threshold)
        _log.info("recall %.4f after %d tables and %d rounds", share, made, done)
        if share >= recall:
            break
        if total <= PAIRS * 2 * made:
            counted, ties = _all_pairs(nodes.df, total, threshold)
            names = components(ties)
            _log.info("recall 1: all pairs of %d vectors compared", total)
            break
    known = nodes.df.join(names, "id", "left").join(counted, "id", "left").select("vec", F.coalesce("links", "n").alias("links"), F.coalesce("component", "id").alias("component"))
    joined = rows.df.join(known, "vec", "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
