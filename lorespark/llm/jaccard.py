"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles.  Sets are banded by size; a band
fixes how many shingles two linked sets in reach of it can differ by (``d``), and the
sketch of a set is cut into ``d + 1 + slack`` parts of 2^24 bits: each shingle's hash names
a part and a bit in it, and the bit is flipped (XOR).  A differing shingle flips one bit
of one part, so the Hamming distance of two sketches never exceeds the symmetric
difference, and of two linked sets at least ``1 + slack`` parts are equal.  Each set
drops its ``drop`` weakest parts (fewest bits, then lowest number): of the equal parts the
strongest ``1 + slack - drop`` are never among them, because ``drop`` weaker equals come
first on both sides.  The kept parts are joined by equality; a set that shares fewer of
them than that with all others together links with nothing; what stays is verified on
whole sets.

Equal sets are one class from the start.  The first pass verifies each class
against the one that comes first under most of its parts, the second what that leaves
apart against the hubs of its groups (the classes that share most).  The third takes up
what is still open: members of one group in different components, filtered by folded
sketches (which bound the difference from below as well).  So a group of many copies of
one text costs its size, not its square, and no link that could join two components goes unverified.

Defined results: null and empty texts have no shingle and link with nothing; fewer words
than a shingle's make one shingle of the whole sequence; repeated rows are one class; ids
need not be distinct or known (a null id is in a component whose id is the smallest of the
others, and null if there is no other); texts may have any length; columns other than id
and text play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, release, ship, tidy, utf8
from .components import components

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(975318642)
_PLACES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TURNS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX1, _MIX2, _MIX3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: A part of a sketch has two to this power bits: few enough flips that other shingles hardly ever set the same ones.
BITS = 24
#: Bytes hashed in one go.
SLICE = 1 << 21


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words link when den * intersection >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def differ(self, both: int) -> int:
        """The largest symmetric difference of two linked sets of so many shingles together."""
        return (self.den - self.num) * both // (self.den + self.num)

    def partner(self, size: int) -> int:
        """The largest size that a set of this size can link to."""
        return size * self.den // self.num

    def band(self, size: int) -> int:
        """Number of the band of a size; linked sizes are in the same or in neighbouring bands."""
        band, low = 0, 1
        while (high := self._next(low)) <= size:
            band, low = band + 1, high
        return band

    def schemes(self, size: int) -> tuple[int, ...]:
        """Bands under which a set is sketched: its own, and the next if a larger partner can be there."""
        own = self.band(size)
        return (own, own + 1) if self.partner(size) > self.limits(own)[1] else (own,)

    def _next(self, low: int) -> int:
        for _ in range(2):  # two steps of the threshold: fewer sets reach the next band, and no partner lies beyond it
            low = self.partner(low) + 1
        return low

    def limits(self, band: int) -> tuple[int, int]:
        low = 1
        for _ in range(band):
            low = self._next(low)
        return low, self._next(low) - 1

    def parts(self, band: int) -> tuple[int, int, int]:
        """Parts of a band's sketches, how many of the weakest each set drops, and how many kept ones two linked sets share at least."""
        d = self.differ(2 * self.limits(band)[1])
        slack = (d + 2) // 3 + 1 if d else 0
        drop = (slack + 1) // 2
        return d + 1 + slack, drop, 1 + slack - drop


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (ASCII lower case), in order."""
    out = []
    lo = 0
    while lo < len(raw):
        hi = min(lo + SLICE, len(raw))
        while hi < len(raw):  # a slice ends at white space; a longer word makes a longer slice
            gaps = np.flatnonzero(_SPACE[raw[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
                break
            hi = min(hi + SLICE, len(raw))
        part = _LOWER[raw[lo:hi]]
        at = np.flatnonzero(~_SPACE[part])
        lo = hi
        if not len(at):
            continue
        new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        sizes = np.diff(np.append(new, len(at)))
        place = np.arange(len(at)) - np.repeat(new, sizes)
        coef = _PLACES[place & 255]
        if len(place) and place.max() > 255:
            coef = mix(coef + (place >> 8).astype(np.uint64) * _MIX3) | np.uint64(1)
        out.append(mix(np.add.reduceat((part[at].astype(np.uint64) + np.uint64(1)) * coef, new) + sizes.astype(np.uint64) * _MIX3))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(raw: np.ndarray | None, words: int) -> np.ndarray:
    """The set's distinct 64-bit shingle hashes, sorted."""
    if raw is None or not len(raw):
        return np.zeros(0, np.uint64)
    w = word_hashes(raw)
    if not len(w):
        return w
    n = min(words, len(w))
    m = len(w) - n + 1
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h += w[k : k + m] * _TURNS[k % len(_TURNS)]
    h = mix(h)
    return np.unique(h)


def _scheme(band: int) -> np.uint64:
    return np.uint64((band + 1) * int(_MIX3) % (1 << 64))


def parity_parts(s: np.ndarray, parts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketch, part by part: a digest of the bits that are set, and how many are.

    Each shingle flips one bit of one part; a bit flipped twice is clear again.
    """
    h = mix(s + _scheme(seed))
    part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    place = np.sort(part << np.uint64(BITS) | h & np.uint64((1 << BITS) - 1))
    first = np.flatnonzero(np.diff(place, prepend=np.uint64((1 << 64) - 1)) != 0)
    odd = place[first[np.diff(np.append(first, len(place))) % 2 == 1]]
    digests, weights = np.zeros(parts, np.uint64), np.zeros(parts, np.int64)
    if len(odd):
        own = (odd >> np.uint64(BITS)).astype(np.intp)
        at = np.flatnonzero(np.diff(own, prepend=-1))
        digests[own[at]] = np.bitwise_xor.reduceat(mix(odd * _MIX3), at)
        weights = np.bincount(own, minlength=parts)
    return digests, weights


def kept_keys(s: np.ndarray, band: int, rule: Rule) -> np.ndarray:
    """Join keys of a set under the scheme of ``band``: the parts that aren't among the weakest."""
    parts, drop, _ = rule.parts(band)
    sketch, weights = parity_parts(s, parts, band)
    order = np.lexsort((np.arange(parts), weights))[drop:]
    return mix(mix(sketch[order] + _scheme(band)) + (order.astype(np.uint64) + np.uint64(1)) * _MIX1)


def digest_of(s: np.ndarray) -> bytes:
    """16 bytes that name a set; the first eight are its head, by which blobs know it."""
    return int(np.bitwise_xor.reduce(mix(s ^ _MIX1))).to_bytes(8, "big") + np.add.reduce(mix(s ^ _MIX2)).tobytes()


#: Keys gathered in a task before they leave it.
KEYS = 500_000
_SKETCHED = "bucket int, id long, key long, n long, digest binary, blob binary"


def sketch(docs: DataFrame, rule: Rule, buckets: int, *, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: (id, key, n, digest) of a document, with no bucket, key being a hash of its text; and blobs of the join keys of many, by bucket.

    A blob holds 48 bits of each key, the place of its set and band in a table, and that table: 64 bits of each set's digest, then each band.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    names = ["bucket", "id", "key", "n", "digest", "blob"]

    def blobs(keys: list[np.ndarray], sets: list[int], of_band: list[int]):
        k = np.concatenate(keys)
        of = np.repeat(np.arange(len(keys), dtype=np.uint16), [len(x) for x in keys])
        bucket = ((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        k, of, bucket = k[order], of[order], bucket[order]
        heads, in_band = np.array(sets, np.uint64), np.array(of_band, np.uint8)
        cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
        out = []
        for lo, hi in zip(cuts, [*cuts[1:], len(k)], strict=True):
            used, place = np.unique(of[lo:hi], return_inverse=True)
            low = k[lo:hi].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            out.append(np.uint32(hi - lo).tobytes() + low + place.astype(np.uint16).tobytes() + heads[used].tobytes() + in_band[used].tobytes())
        n = len(out)
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), *[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.binary()), pa.array(out, pa.binary())], names)

    def run(batches):
        schemes: dict[int, tuple[int, ...]] = {}
        keys, sets, bands, sent = [], [], [], set()
        held = 0
        for batch in batches:
            n, digest = [], []
            for raw in utf8(batch.column(2)):
                s = shingles(raw, rule.words)
                n.append(len(s))
                if not len(s):
                    digest.append(None)
                    continue
                digest.append(digest_of(s))
                head = int.from_bytes(digest[-1][:8], "big")
                if head in sent:  # an equal set's keys have left this task
                    continue
                sent.add(head)
                if len(s) not in schemes:
                    # Where the sizes allow no difference, only equal sets link, and they are one class already.
                    schemes[len(s)] = rule.schemes(len(s)) if rule.differ(len(s) + rule.partner(len(s))) else ()
                for b in schemes[len(s)]:
                    keys.append(kept_keys(s, b, rule))
                    sets.append(head)
                    bands.append(b)
                    held += len(keys[-1])
                if held > KEYS or len(keys) > 65_000:
                    yield blobs(keys, sets, bands)
                    keys, sets, bands, held = [], [], [], 0
            m = len(n)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.nulls(m, pa.binary())], names)
            if len(sent) > 1_000_000:
                sent.clear()
        if keys:
            yield blobs(keys, sets, bands)

    return rows.mapInArrow(tidy(run), _SKETCHED)


def _meet(blobs: DataFrame) -> DataFrame:
    """(key, head, band): the sets of each key that more than one set has; blobs sorted by bucket."""

    def meet(parts: list[bytes]):
        keys, heads, bands = [], [], []
        for p in parts:
            n = int(np.frombuffer(p, np.uint32, 1)[0])
            k = np.zeros((n, 8), np.uint8)
            k[:, :6] = np.frombuffer(p, np.uint8, 6 * n, 4).reshape(n, 6)
            keys.append(k.view(np.uint64)[:, 0])
            place = np.frombuffer(p, np.uint16, n, 4 + 6 * n)
            entries = (len(p) - 4 - 8 * n) // 9
            heads.append(np.frombuffer(p, np.uint64, entries, 4 + 8 * n)[place])
            bands.append(np.frombuffer(p, np.uint8, entries, 4 + 8 * n + 8 * entries)[place])
        k, h, b = np.concatenate(keys), np.concatenate(heads), np.concatenate(bands)
        order = np.argsort(k, kind="stable")
        k, h, b = k[order], h[order], b[order]
        same = k[1:] == k[:-1]
        some = np.zeros(len(k), bool)
        some[1:] |= same
        some[:-1] |= same
        k, h, b = k[some], h[some], b[some]
        order = np.lexsort((h, k))
        k, h, b = k[order], h[order], b[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
        k, h, b = k[new], h[new], b[new]  # of one key, each set once
        same = k[1:] == k[:-1]
        some = np.zeros(len(k), bool)
        some[1:] |= same
        some[:-1] |= same
        return k[some], h[some], b[some]

    def rows(bucket: int, parts: list[bytes]):
        k, h, b = meet(parts)
        return pa.RecordBatch.from_arrays([pa.array((k | np.uint64(bucket << 48)).view(np.int64)), pa.array(h.view(np.int64)), pa.array(b.astype(np.int32))], ["key", "head", "band"])

    def run(batches):
        bucket, parts = None, []
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and parts:
                    yield rows(bucket, parts)
                    parts = []
                bucket = b
                parts.append(p)
        if parts:
            yield rows(bucket, parts)

    return blobs.mapInArrow(tidy(run), "key long, head long, band int")


def _sets(texts: DataFrame, rule: Rule) -> DataFrame:
    """(digest, s) of the texts, each set once a task."""

    def run(batches):
        sent: set[bytes] = set()
        for batch in batches:
            names, got = [], []
            for raw in utf8(batch.column(0)):
                s = shingles(raw, rule.words)
                if len(s) and (name := digest_of(s)) not in sent:
                    sent.add(name)
                    names.append(name)
                    got.append(s.tobytes())
            if len(sent) > 1_000_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(got, pa.binary())], ["digest", "s"])

    return texts.mapInArrow(tidy(run), "digest binary, s binary")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, common, na, nb) of every candidate pair.

    Pairs meet the sets twice; the side that repeats is the pairs', which Spark can split where it is skewed.
    """
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            common, na, nb = [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = x.as_buffer(), y.as_buffer()
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                at = np.searchsorted(q, p)
                common.append(int((q[np.minimum(at, len(q) - 1)] == p).sum()))
                na.append(len(p))
                nb.append(len(q))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in (common, na, nb)]], ["a", "b", "common", "na", "nb"])

    return both.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long, common long, na long, nb long")


def _links(verified: DataFrame, rule: Rule) -> Column:
    return F.col("common") * rule.den >= (F.col("na") + F.col("nb") - F.col("common")) * rule.num


def cluster(docs: DataFrame, rule: Rule | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, class_id, component_id) for each row of ``docs``.

    The class is the smallest id with an equal set, the component the smallest id reachable by
    links.  Rows of one id and different texts link each by its own text.
    """
    own = _grouped(docs, rule or Rule(), id_col, text_col)
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def _grouped(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, class_id, component_id, group) of each row; the group, null without a shingle, tells components apart that have one id in common."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(4 * partitions, 1 << 15)
    sketched = Table(sketch(docs, rule, buckets, id_col=id_col, text_col=text_col), "jac-sketched")
    sketches = Table(sketched.df.where("bucket is null").select("id", "key", "n", "digest"), "jac-sets").df
    # A class is an equal set; its name is its row in this table, so that no two classes share one whatever their ids; names go by ids.
    classes = Table(sketches.where("n > 0").groupBy("digest").agg(F.min("id").alias("class_id")).repartitionByRange("class_id").sortWithinPartitions("class_id").withColumn("name", F.monotonically_increasing_id()), "jac-classes")
    # The digest's first eight bytes, as the number that blobs hold.
    heads = classes.df.select(F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("head"), "name")
    met = Table(_meet(sketched.df.where("bucket is not null").select("bucket", "blob").repartition(partitions, "bucket").sortWithinPartitions("bucket")), "jac-met")
    sketched.drop()
    least = F.element_at(F.array(*[F.lit(rule.parts(b)[2]) for b in range(rule.band(1 << 40))]), F.col("band") + 1)
    able = met.df.groupBy("head", "band").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("head", "band")
    shared = Table(met.df.join(able, ["head", "band"]).join(heads, "head").select("key", F.col("name").alias("id")), "jac-shared")
    met.drop()
    # First, each class against the one that comes first under most of its keys: chance brings others together under one or two.
    groups = shared.df.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("k")).where("k > 1").select("key", "a")
    members = shared.df.join(groups, "key")
    first = Table(_most_shared(members.where("a <> id").select("a", F.col("id").alias("b"))), "jac-star")
    wanted = Table(members.select(F.col("id").alias("name")).distinct().join(classes.df, "name"), "jac-wanted")
    asked = wanted.df.select(F.col("class_id").alias("__asked")).distinct()
    texts = docs.join(asked, F.col(id_col).cast("long").eqNullSafe(F.col("__asked")), "left_semi").select(text_col)
    sets = Table(_sets(texts, rule).dropDuplicates(["digest"]).join(wanted.df, "digest").select(F.col("name").alias("id"), "s"), "jac-kept")
    wanted.drop()
    release(docs.sparkSession)
    done = Table(_verified(first.df, sets.df, rule), "jac-verified")
    first.drop()
    links = done.df.where(_links(done.df, rule)).select("a", "b")
    names = components(links)
    # What that leaves apart is compared with the hubs of its groups; whatever is apart then, with one another.
    for open_pairs in (lambda: _hub_pairs(shared.df, names), lambda: _open_pairs(shared.df, names, sets.df, rule)):
        pairs = Table(open_pairs(), "jac-open")
        done = Table(_verified(pairs.df, sets.df, rule), "jac-verified")
        pairs.drop()
        more = done.df.where(_links(done.df, rule)).select("a", "b")
        if more.limit(1).count():
            links = links.unionByName(more)
            names = components(links)
    sets.drop()
    shared.drop()
    linked = classes.df.join(names.withColumnRenamed("id", "name"), "name", "left").select("digest", "class_id", F.coalesce("component", "name").alias("group"))
    smallest = linked.groupBy("group").agg(F.min("class_id").alias("component_id"))
    full = Table(linked.join(smallest, "group"), "jac-named").df
    return sketches.join(full, "digest", "left").select("id", "key", "n", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"), "group")


def _hub_pairs(shared: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b): each class that shares a key with a class of another component, with the hub among those: the one that shares keys most."""
    named = shared.join(names, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("k")).where("c0 <> c1").select("key", "k")
    members = named.join(mixed, "key")
    degree = members.groupBy("id").agg(F.sum("k").alias("degree"))
    ranked = members.join(degree, "id")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("last"), "c")).alias("hub"))
    met = ranked.select("key", "id", "c").join(hubs, "key").where(F.col("hub.c") != F.col("c"))
    best = _most_shared(met.select((-F.col("hub.last")).alias("a"), F.col("id").alias("b")))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _most_shared(met: DataFrame) -> DataFrame:
    """(a, b): of (a, b) of each key, for each b the a that it meets under most keys, the first of equals."""
    times = met.groupBy("b", "a").agg(F.count("*").alias("n"))
    return times.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")


#: Bits of a folded sketch for each shingle: unrelated sets then differ in over twice what linked ones may.
_FOLD = 1


def _fold(s: np.ndarray, bits: int) -> np.ndarray:
    at = mix(s ^ _MIX1) & np.uint64(bits - 1)
    words = np.zeros(bits // 64, np.uint64)
    np.bitwise_xor.at(words, (at >> np.uint64(6)).astype(np.intp), np.uint64(1) << (at & np.uint64(63)))
    return words


#: Members of a group that are compared in one go.
BLOCK = 2048


def _open_pairs(shared: DataFrame, names: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of different components that share a key, unless their folded sketches differ too much.  Large groups are compared in pairs of blocks."""
    named = shared.join(names, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).where("c0 <> c1").select("key", "blocks")
    placed = named.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = placed.select("key", "id", "c", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("own"), "id", "c")
    folded = sets.mapInArrow(tidy(_folded_rows), "id long, n long, f binary")
    rows = spread.join(folded, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield from _pairs(held, rule)
                    held = []
                held.append(row)
        if held:
            yield from _pairs(held, rule)

    return rows.select("key", "i", "j", "id", "c", "n", "f").mapInArrow(tidy(run), "a long, b long").distinct()


def _folded_rows(batches):
    for batch in batches:
        n, f = [], []
        for raw in batch.column(1):
            s = np.frombuffer(raw.as_buffer(), np.uint64)
            n.append(len(s))
            f.append(_fold(s, max(64, 1 << (len(s) * _FOLD).bit_length())).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f, pa.binary())], ["id", "n", "f"])


#: Pairs sent on at once.
SENT = 50_000


def _pairs(held: list[tuple], rule: Rule):
    ids, c, n = (np.array([r[k] for r in held]) for k in (3, 4, 5))
    if (c == c[0]).all():
        return
    least = min(len(r[6]) for r in held) // 8
    sketch = np.empty((len(held), least), np.uint64)
    for i, r in enumerate(held):  # a longer fold folds onto a shorter one
        sketch[i] = np.bitwise_xor.reduce(np.frombuffer(r[6], np.uint64).reshape(-1, least), axis=0)
    a, b, size = [], [], 0
    for i in range(len(held) - 1):
        j = np.flatnonzero(c[i + 1 :] != c[i]) + i + 1
        if not len(j):
            continue
        apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1)
        j = j[apart <= (rule.den - rule.num) * (n[j] + n[i]) // (rule.den + rule.num)]
        a.append(np.minimum(ids[i], ids[j]))
        b.append(np.maximum(ids[i], ids[j]))
        size += len(j)
        if size > SENT:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            a, b, size = [], [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def keep_first(docs: DataFrame, rule: Rule | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id (null comes last), of rows with that id the one whose text has the smallest hash.

    Rows equal in id and text count as copies, of which any one stays; rows without a shingle
    all stay.
    """
    own = Table(_grouped(docs, rule or Rule(), id_col, text_col), "jac-rows").df.where("group is not null")
    place = F.struct(F.col("id").isNull(), F.col("id").alias("__jac_id"), F.col("key").alias("__jac_key"))
    first = own.groupBy("group").agg(F.min(place).alias("first"))
    gone = own.join(first, "group").where(~(F.col("first.__jac_id").eqNullSafe(F.col("id")) & (F.col("first.__jac_key") == F.col("key")))).select(F.col("id").alias("__jac_id"), F.col("key").alias("__jac_key")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__jac_id")) & (F.xxhash64(text_col) == F.col("__jac_key"))
    kept = docs.join(gone, same, "left_anti")
    # Texts are only brought together where a row that stays does come twice.
    twice = Table(own.groupBy(F.col("id").alias("__jac_id"), F.col("key").alias("__jac_key")).agg(F.count("*").alias("n")).where("n > 1").select("__jac_id", "__jac_key"), "jac-twice").df
    if not twice.limit(1).count():
        return kept
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
