"""Pairs of sets by Jaccard similarity, at low thresholds, block by block.

At a threshold of 0.3 most pairs share a rare element, so pairs are not shuffled to be counted: sets are dealt into
blocks of like sizes, blocks whose sizes allow the threshold meet, and a task counts what all pairs of two blocks share.
The commonest elements are columns of two matrices that are multiplied, rare ones are counted from their lists; those
between are at first only bounded by how many of them a set has, and compared where a pair may still be alike enough.
Only pairs that are alike enough leave a task, or of each set only its best.  Blocks meet in tiles of two strips of
blocks: a task holds the one and passes the other by, so that each is copied as often as there are strips.

Elements are compared by 64-bit hashes, with a seed for which no two elements at hand have the same.

Where few elements make nearly all sets alike and only each set's best are asked for, ``most_alike`` makes no pairs:
equal sets are one class, blocks of classes meet as matrices, and of each class only its best are kept.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import ship
from ..sources.tables import kept

#: Columns of the matrices that are multiplied, and elements that are only bounded at first; an element that at most this share of the sets have is neither.
HEAVY, MIDDLE, RARE = 256, 4096, 0.01
#: Sets of a block, and elements that a set of a block may have on average.
CELL, WIDE = 2048, 1024
#: Pairs counted at once, places of their counts, and pairs looked at closely at once.
COUNTED, CELLS, CHOSEN = 1 << 22, 1 << 19, 1 << 13
#: Strips of blocks at least, for enough tiles, and blocks of a strip at most.
STRIPS, LONG = 12, 32
#: Classes of a block, and blocks that a block meets in one task.
CLASSES, STRIP = 1024, 32


def _common(base: DataFrame, n_sets: int) -> tuple[int, list[int]]:
    """The first seed for which the elements at hand have hashes of their own; and the hashes of those that most sets have, the commonest first, at most ``HEAVY + MIDDLE``."""
    terms = kept(base.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("sets")), "elements")
    n, seed = terms.count(), 42
    while terms.select(F.xxhash64("term", F.lit(seed))).distinct().count() < n:
        seed += 1
    often = terms.where(F.col("sets") > RARE * n_sets).orderBy(F.col("sets").desc(), "term").limit(HEAVY + MIDDLE)
    return seed, [r["h"] for r in often.select(F.xxhash64("term", F.lit(seed)).alias("h")).collect()]


def _cuts(sizes: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """For sizes in order and how many sets have them: what comes before each size, by the weight of its sets; and the least and largest size of each block."""
    room, before, seen = CELL * WIDE, [], 0
    spans: dict[int, tuple[int, int]] = {}
    for n, sets in sizes:
        before.append(seen)
        seen += sets * max(n, WIDE)
        for block in range(before[-1] // room, (seen - 1) // room + 1):
            spans[block] = (spans.get(block, (n, n))[0], n)
    return before, [spans[k] for k in range(len(spans))]


def _kind(rows: int) -> type:
    """What places in a block are packed as."""
    return np.uint16 if rows <= 1 << 16 else np.int32


def _packed(common: np.ndarray):
    """Over blocks of sets: (block, ids, sizes, often, held, words, counts, rows): of common elements each set's numbers and how many it has; of the others the places of the sets that have each."""
    order = np.argsort(common)
    known = common[order]

    def run(batches):
        for batch in batches:
            for block, sets in zip(batch.column("block"), batch.column("sets"), strict=True):
                own = sets.values
                lists = own.field("hashes")
                sizes = lists.value_lengths().to_numpy().astype(np.int32)
                flat = lists.flatten().to_numpy()
                row = np.repeat(np.arange(len(sizes), dtype=_kind(len(sizes))), sizes)
                often, rest = np.zeros(0, np.uint16), np.ones(len(flat), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    rest = known[at] != flat
                    often = order[at[~rest]].astype(np.uint16)
                held = np.bincount(row[~rest], minlength=len(sizes)).astype(np.int32)
                by = np.argsort(flat[rest], kind="stable")
                words, counts = np.unique(flat[rest], return_counts=True)
                parts = (sizes, often, held, words, counts.astype(np.int32), row[rest][by])
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.ListArray.from_arrays([0, len(sizes)], own.field("id")), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["block", "ids", *_PARTS])

    return run


_PARTS = {"sizes": np.int32, "often": np.uint16, "held": np.int32, "words": np.int64, "counts": np.int32, "rows": None}


def _read(batch: pa.RecordBatch, r: int) -> dict:
    """A block as ``_packed`` wrote it, on its own memory."""
    x = {"block": batch.column("block")[r].as_py(), "ids": pa.concat_arrays([batch.column("ids")[r].values])}
    for name, kind in _PARTS.items():
        x[name] = np.frombuffer(batch.column(name)[r].as_py(), kind or _kind(len(x["sizes"])))
    return x


def _common_parts(x: dict, least: Fraction, heavy: int, n_common: int, first: bool) -> dict:
    """A block with the matrix of its sets' heavy elements, the bits of its middle ones and how many of these each set has.

    Two sets of n and m elements are alike enough if they share t / (s + t) of n + m. Middle elements that they share
    are at most half of those that both have, so that what they share of the others must reach the sum of what either
    is short of; two more columns take that off the product, in quarters, rounded down, which floats hold exactly.
    """
    t, s = least.numerator, least.denominator
    n, width = len(x["sizes"]), min(heavy, n_common)
    row = np.repeat(np.arange(n), x["held"])
    up = x["often"] < width
    bits = np.zeros((n, width + 2), np.float32)
    bits[row[up], x["often"][up]] = 1
    middle = np.zeros((n, -(-max(n_common - width, 1) // 64) * 64), bool)
    middle[row[~up], x["often"][~up].astype(np.int64) - width] = True
    n_middle = np.bincount(row[~up], minlength=n)
    short = np.floor(4 * (x["sizes"].astype(np.float64) * t / (s + t) - n_middle / 2)) / 4
    bits[:, width], bits[:, width + 1] = (-short, 1) if first else (1, -short)
    return {"bits": bits, "middle": np.packbits(middle, axis=1).view(np.uint64), "n_middle": n_middle, "short": short}


def _by_set(x: dict) -> dict:
    """The rare elements of a block set by set: the place of each among the block's words, and how many each set has."""
    order = np.argsort(x["rows"], kind="stable")
    return x | {"codes": np.repeat(np.arange(len(x["words"]), dtype=np.int32), x["counts"])[order], "own": x["rows"][order].astype(np.int64)}


def _close(a: dict, b: dict, least: Fraction, counted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in two blocks of the sets that are ``least`` alike, and how many elements they share."""
    t, s = least.numerator, least.denominator
    n, m = len(a["sizes"]), len(b["sizes"])
    _, i, j = np.intersect1d(a["words"], b["words"], assume_unique=True, return_indices=True)
    at = np.full(len(a["words"]) + 1, -1, np.int32)
    at[i] = j
    word = at[a["codes"]]
    met = word >= 0
    word, mine = word[met], a["own"][met]
    first = np.cumsum(b["counts"], dtype=np.int64) - b["counts"]
    k, start = b["counts"][word], first[word]
    # Sets of the first block at a time, so many that their places with all sets of the second stay few.
    ends = np.concatenate([[0], np.cumsum(np.bincount(mine, k, n).astype(np.int64))])
    of = np.searchsorted(mine, np.arange(n + 1))
    out: list[list[np.ndarray]] = [[], [], []]
    lo = 0
    while lo < n:
        hi = min(n, lo + max(1, CELLS // m), max(lo + 1, int(np.searchsorted(ends, ends[lo] + counted, "right")) - 1))
        total = a["bits"][lo:hi] @ b["bits"].T
        own = slice(of[lo], of[hi])
        if of[hi] > of[lo]:
            c = k[own]
            behind = np.cumsum(c, dtype=np.int64)
            place = np.arange(behind[-1]) + np.repeat(start[own] - behind + c, c)
            cells = b["rows"][place] + np.repeat((mine[own] - lo) * m, c)
            total += np.bincount(cells, minlength=(hi - lo) * m).reshape(hi - lo, m).astype(np.float32)
        cell = np.flatnonzero(total >= 0)
        for few in np.split(cell, range(CHOSEN, len(cell), CHOSEN)):
            i, j = np.divmod(few, m)
            shared = np.rint(total.ravel()[few] + a["short"][lo + i] + b["short"][j]).astype(np.int64)
            i += lo
            need = t * (a["sizes"][i].astype(np.int64) + b["sizes"][j])
            may = (shared + np.minimum(a["n_middle"][i], b["n_middle"][j])) * (s + t) >= need
            i, j, shared, need = i[may], j[may], shared[may], need[may]
            shared += np.bitwise_count(a["middle"][i] & b["middle"][j]).sum(axis=1, dtype=np.int64)
            keep = (shared > 0) & (shared * (s + t) >= need)
            for x, found in zip(out, (i, j, shared), strict=True):
                x.append(found[keep])
        lo = hi
    i, j, shared = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    return i, j, shared


def _alike(least: Fraction, top: int | None, heavy: int, n_common: int, counted: int):
    """Over blocks by tile, those of the tile's first strip before those of its second: (a, b, shared, union) of the pairs that are ``least`` alike; with ``top``, both ways and of each set its ``top`` best in a block."""

    def best(row: np.ndarray, other: pa.Array, own: pa.Array, shared: np.ndarray, union: np.ndarray) -> np.ndarray:
        """Places of each row's best, by similarity to six places and the smaller id."""
        differ = np.flatnonzero(own.to_numpy(zero_copy_only=False) != other.to_numpy(zero_copy_only=False))
        key = (2_000_000 * shared + union) // (2 * union)
        order = differ[np.lexsort((other.to_numpy(zero_copy_only=False)[differ], -key[differ], row[differ]))]
        return order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < top]

    def pairs(a: dict, b: dict):
        i, j, shared = _close(a, b, least, counted)
        if a["block"] == b["block"]:
            keep = i < j
            i, j, shared = i[keep], j[keep], shared[keep]
        union = a["sizes"][i].astype(np.int64) + b["sizes"][j] - shared
        one, two = a["ids"].take(pa.array(i)), b["ids"].take(pa.array(j))
        ways = [(one, two, np.arange(len(i)))]
        if top:
            # A block with itself has each set's others on either side.
            if a["block"] == b["block"]:
                i, j, one, two, shared, union = np.concatenate([i, j]), np.concatenate([j, i]), pa.concat_arrays([one, two]), pa.concat_arrays([two, one]), np.tile(shared, 2), np.tile(union, 2)
                ways = [(one, two, best(i, two, one, shared, union))]
            else:
                ways = [(one, two, best(i, two, one, shared, union)), (two, one, best(j, one, two, shared, union))]
        for x, y, at in ways:
            if len(at):
                yield pa.RecordBatch.from_arrays([x.take(pa.array(at)), y.take(pa.array(at)), pa.array(shared[at]), pa.array(union[at])], ["a", "b", "shared", "union"])

    def run(batches):
        tile, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                if tile != batch.column("tile")[r].as_py():
                    tile, held = batch.column("tile")[r].as_py(), []
                x = _read(batch, r)
                if batch.column("side")[r].as_py() == 0:
                    held.append(_by_set(x))
                    continue
                b = x | _common_parts(x, least, heavy, n_common, False)
                for a in held:
                    if a["block"] <= b["block"] and int(a["sizes"].max()) * least.denominator >= int(b["sizes"].min()) * least.numerator:
                        yield from pairs(a | _common_parts(a, least, heavy, n_common, True), b)

    return run


def _compared(sets: DataFrame, least: Fraction, top: int | None, id_col: str, terms_col: str) -> DataFrame:
    """(a, b, shared, union): rows that are ``least`` alike, as ``_alike`` gives them."""
    spark = sets.sparkSession
    ship(spark)
    terms = F.array_distinct(F.array_compact(F.col(terms_col)))
    base = kept(sets.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), terms.alias("terms")).where(F.size("terms") > 0), "sets")
    kind = base.schema["id"].dataType.simpleString()
    sizes = [(r["n"], r["count"]) for r in base.groupBy(F.size("terms").alias("n")).count().orderBy("n").collect()]
    if not sizes:
        return spark.createDataFrame([], f"a {kind}, b {kind}, shared long, union long")
    before, spans = _cuts(sizes)
    seed, common = _common(base, sum(c for _, c in sizes))
    # A set's block: what comes before its size, and a place among the sets of its size.
    each = spark.createDataFrame([(n, at, c) for (n, c), at in zip(sizes, before, strict=True)], "n int, at long, sets long")
    hashed = base.select("id", F.size("terms").alias("n"), F.transform("terms", lambda x: F.xxhash64(x, F.lit(seed))).alias("hashes"))
    place = F.pmod(F.xxhash64("id", "hashes"), F.col("sets")) * F.greatest(F.col("n"), F.lit(WIDE))
    dealt = hashed.join(F.broadcast(each), "n").select(F.floor((F.col("at") + place) / F.lit(CELL * WIDE)).cast("int").alias("block"), F.struct("id", "hashes").alias("x"))
    packed = dealt.groupBy("block").agg(F.collect_list("x").alias("sets"))
    blocks = kept(packed.mapInArrow(_packed(np.array(common, np.int64)), f"block int, ids array<{kind}>, " + ", ".join(f"{x} binary" for x in _PARTS)), "blocks")
    width = max(1, min(LONG, len(spans) // STRIPS))
    strips = [spans[k : k + width] for k in range(0, len(spans), width)]

    def work(p: int, q: int) -> int:
        return sum(x[1] * least.denominator >= y[0] * least.numerator for x in strips[p] for y in strips[q])

    # Most work first, a partition for each tile.
    tiles = sorted(((w, p, q) for p in range(len(strips)) for q in range(p, len(strips)) if (w := work(p, q))), reverse=True)
    of = spark.createDataFrame([(k, side, strip) for k, (_, *both) in enumerate(tiles) for side, strip in enumerate(both)], "tile int, side int, strip int")
    met = blocks.withColumn("strip", F.floor(F.col("block") / F.lit(width)).cast("int")).join(F.broadcast(of), "strip")
    rows = met.select("tile", "side", "block", "ids", *_PARTS).repartitionById(len(tiles), F.col("tile")).sortWithinPartitions("tile", "side", "block")
    return rows.mapInArrow(_alike(least, top, HEAVY, len(common), COUNTED), f"a {kind}, b {kind}, shared long, union long")


def jaccard_pairs(sets: DataFrame, least: float | str, id_col: str = "id", terms_col: str = "terms") -> DataFrame:
    """(a, b, shared, similarity): pairs of rows whose sets are ``least`` alike or more (0: share anything), the smaller id as a.

    Arrays count as sets, nulls in them and null or empty arrays as nothing; rows that repeat an id
    are sets of their own, and not paired with one another; a row with a null id is left out.
    Work is quadratic in the number of sets of like sizes, memory is that of two blocks.
    """
    found = _compared(sets, Fraction(str(least)), None, id_col, terms_col).where("a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", F.round(F.col("shared") / F.col("union"), 6).alias("similarity"))


def jaccard_best(sets: DataFrame, top: int, least: float | str, id_col: str = "id", terms_col: str = "terms") -> DataFrame:
    """(id, rank, other, similarity): of each id the ``top`` most alike others of ``jaccard_pairs``, ties by the smaller id; ids are integers; pairs are not shuffled, only each block's best."""
    found = _compared(sets, Fraction(str(least)), top, id_col, terms_col)
    each = found.select(F.col("a").alias("id"), F.col("b").alias("other"), F.round(F.col("shared") / F.col("union"), 6).alias("similarity"))
    line = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other")
    return each.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top).select("id", "rank", "other", "similarity")


def _best_of_blocks(top: int, least: float):
    """Over pairs of blocks of classes: of each class of the first the ``top`` + 1 most alike rows that this task has seen."""

    def run(batches):
        block, uids, held = None, None, None

        def emit():
            row, key, ids = held
            return pa.RecordBatch.from_arrays([pa.array(uids[row]), pa.array(ids), pa.array(key)], ["uid", "other", "millionths"])

        for batch in batches:
            for r in range(batch.num_rows):
                a, b = batch.column("own")[r].values, batch.column("met")[r].values
                if block != batch.column("block")[r].as_py():
                    if block is not None:
                        yield emit()
                    block, uids, held = batch.column("block")[r].as_py(), a.field("uid").to_numpy(), [np.zeros(0, np.int64)] * 3
                terms = [x.field("terms") for x in (a, b)]
                sizes = [t.value_lengths().to_numpy().astype(np.int64) for t in terms]
                flat = [t.flatten().to_numpy() for t in terms]
                words, at = np.unique(np.concatenate(flat), return_inverse=True)
                bits = [np.zeros((len(n), len(words)), np.float32) for n in sizes]
                for m, n, i in zip(bits, sizes, (at[: len(flat[0])], at[len(flat[0]) :]), strict=True):
                    m[np.repeat(np.arange(len(n)), n), i] = 1
                shared = (bits[0] @ bits[1].T).astype(np.int64)
                union = sizes[0][:, None] + sizes[1][None, :] - shared
                key = (2_000_000 * shared + union) // (2 * union)  # rounded to six places, halves up
                # Classes better than the (top + 1)-th best class cannot be missed: each has a row at least.
                floor = np.full(len(key), least * 1e6)
                if key.shape[1] > top:
                    floor = np.maximum(floor, np.partition(key, -top - 1, axis=1)[:, -top - 1] - 0.5)
                i, j = np.nonzero((shared > 0) & (key > floor[:, None]))
                n_ids = b.field("ids").value_lengths().to_numpy()
                start = np.cumsum(n_ids) - n_ids
                ids = b.field("ids").flatten().to_numpy()
                k = n_ids[j]
                place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[j], k)
                row, key, ids = (np.concatenate(x) for x in zip(held, (np.repeat(i, k), np.repeat(key[i, j], k), ids[place]), strict=True))
                order = np.lexsort((ids, -key, row))
                row, key, ids = row[order], key[order], ids[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) <= top
                held = [row[best], key[best], ids[best]]
        if block is not None:
            yield emit()

    return run


def most_alike(sets: DataFrame, top: int, least: float, id_col: str = "id", terms_col: str = "terms") -> DataFrame:
    """(id, rank, other, similarity): of each row the ``top`` others whose sets are most alike (Jaccard, rounded to six places), more than ``least``; ties by the smaller id.

    Ids are integers, each once; terms are integers.  Rows of equal sets are one class, which is compared once and shown by its
    ``top`` + 1 smallest ids.  Work is quadratic in the number of different sets, memory is that of two blocks.
    """
    spark = sets.sparkSession
    ship(spark)
    made = sets.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.array_sort(F.array_distinct(F.array_compact(F.col(terms_col)))).alias("terms")).where(F.size("terms") > 0)
    rows = kept(made, "sets")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("terms").orderBy("id"))).where(F.col("r") <= top + 1)
    classes = kept(first.groupBy("terms").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("uid", F.monotonically_increasing_id()), "classes")
    n_blocks = max(1, -(-classes.count() // CLASSES))
    strips = max(1, -(-n_blocks // STRIP), min(n_blocks, 4 * spark.sparkContext.defaultParallelism))
    block = F.pmod(F.xxhash64("uid"), F.lit(n_blocks))
    packed = kept(classes.groupBy(block.alias("block")).agg(F.collect_list(F.struct("uid", "terms", "ids")).alias("rows")), "blocks")
    own = packed.select("block", F.col("rows").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"))
    # Shuffled: one block is not small, and each is there once for each strip.
    met = own.hint("merge").join(packed.select(F.pmod("block", F.lit(strips)).cast("int").alias("strip"), F.col("rows").alias("met")), "strip")
    found = met.select("block", "own", "met").mapInArrow(_best_of_blocks(top, least), "uid long, other long, millionths long")
    line = Window.partitionBy("uid").orderBy(F.col("millionths").desc(), "other")
    best = found.withColumn("r", F.row_number().over(line)).where(F.col("r") <= top + 1).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("r", "other", "millionths"))).alias("best"))
    named = classes.select("uid", "terms").hint("merge").join(best, "uid").drop("uid")
    others = F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, top)
    each = rows.hint("merge").join(named, "terms").select("id", F.posexplode(others).alias("pos", "x"))
    return each.select("id", (F.col("pos") + 1).alias("rank"), F.col("x.other").alias("other"), (F.col("x.millionths") / F.lit(1e6)).alias("similarity"))
