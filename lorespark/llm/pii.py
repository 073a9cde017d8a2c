"""Personal data: base patterns, and what bootstrapped contexts add to them.

``scan`` finds the four base kinds in whole texts and, beside them, every other token
that could be an identifier (it holds a digit or an at sign), each with the lexical
patterns around it: the two words before, the word before with the word after, and, as
the pattern to back off to, the word before alone.  Base finds are the seeds; tokens that
look like a key or a digest are seeds of a kind of their own, ``secret``, which have to
stand in a sure context to be marked.  ``score_patterns`` then lets scores flow over the
graph of patterns and instances: a pattern is as sure as the mean score of its distinct
instances, an instance as sure as its patterns together, seeds staying at 1 for their
kind.  Patterns that end sure enough and rest on enough distinct seeds mark the tokens
that no base pattern finds.  Tokens without digit or at sign are candidates too: those
that stand in a context that is sure among identifier-like ones are looked up in a
further pass, and marked by patterns that stay sure when all tokens count.

Defined results: a null text counts as empty and has no spans; offsets are code points,
ends exclusive; equal rows (same id, same text) get equal spans; tokens, contexts and base
spans may be of any length; an instance or a word of a context longer than 128 code
points is known by its digest; columns other than id and text are not read by ``find``
and carried as they are by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, ship, tidy

KINDS = ("email", "ip", "card", "phone")
#: Kinds of discovered spans: the base ones and what only contexts can tell.
FOUND = (*KINDS, "secret")
SPAN = "array<struct<kind:string,start:int,end:int>>"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its first digit alone: from a later one the same tail fails or was taken.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
#: Longer instances and words of contexts are named by a digest; bits of the filter that contexts are looked up in.
_TOKEN, _BITS = 128, 1 << 24
#: What keys and digests look like: long hexadecimal runs, issuers' prefixes, long mixes of small and capital letters and digits.
_SECRET = re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|[sr]k_(?:live|test)_[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[\w-]+\.[\w-]+\.[\w-]*|(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=[^0-9]*[0-9])[0-9A-Za-z+/_-]{32,}={0,2})\Z")
_EDGE = "\"'<>()[]{}.,;:!?*|"


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def _tokens(text: str, taken: list[tuple[str, int, int]]):
    """Identifier-like tokens outside the base spans."""
    spans = sorted((a, b) for _, a, b in taken)
    k, done = 0, 0
    for m in _HINT.finditer(text):
        at = m.start()
        if at < done:
            continue
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if k < len(spans) and spans[k][0] <= at:
            done = spans[k][1]
            continue
        a, b = at, at + 1
        while a > done and not text[a - 1].isspace():
            a -= 1
        high = spans[k][0] if k < len(spans) else len(text)
        while b < high and not text[b].isspace():
            b += 1
        done = b
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if b > a:
            yield a, b


def _short(word: str) -> str:
    return word if len(word) <= _TOKEN else hashlib.sha256(word.encode(errors="surrogatepass")).hexdigest()


def _instance(token: str) -> str:
    return _short(token.lower())


@lru_cache(1 << 16)
def _plain(word: str) -> str:
    low = re.sub(r"[0-9]", "0", word.lower())
    return _short(low.strip("\"'<>()[]{}.,;!?*|") or low)


def _before(text: str, start: int) -> list[str]:
    """The last two words before a place, whole."""
    reach = 80
    while True:
        low = max(0, start - reach)
        words = _WORD.findall(text[low:start])
        # The first one may be cut off unless the text begins there or white space does.
        if low == 0 or len(words) > 2 or (len(words) == 2 and text[low].isspace()):
            return words[-2:]
        reach *= 8


def _contexts(before: list[str], after: str | None) -> list[str]:
    found = [f"L {before[0]} {before[1]}"] if len(before) == 2 else []
    if before and after is not None:
        found.append(f"B {before[-1]} _ {after}")
    if before:
        found.append(f"P {before[-1]}")
    return found


def _word_around(text: str, start: int, end: int, last: tuple[int, int] = (0, 0)) -> tuple[int, int]:
    """From white space to white space; ``last`` is what the place before gave, so that a long word is walked once."""
    if last[0] <= start and end <= last[1]:
        return last
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return start, end


def patterns(text: str, start: int, end: int) -> list[str]:
    """Of a place that begins and ends at white space."""
    after = _WORD.search(text, end)
    return _contexts([_plain(w) for w in _before(text, start)], _plain(after[0]) if after else None)


class _Known(dict):
    """Whether a word, as it stands, comes last before a place in some wanted pattern; asked once a word."""

    def __init__(self, wanted):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        found = bool(self.wanted("W " + _plain(word)))
        self[word] = found
        return found


def _words_in(text: str, wanted, known: _Known):
    """(start, end, patterns) of the words without digit or at sign, outside base spans, that stand in a context ``wanted`` knows."""
    words = text.split()
    after = [i + 1 for i, w in enumerate(words[:-1]) if known[w]]
    if not after:
        return
    spans = [m.span() for m in _WORD.finditer(text)]
    base = None
    for i in after:
        word, (a, b) = words[i], spans[i]
        if _HINT.search(word):
            continue
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a == b:
            continue
        held = _contexts([_plain(w) for w in words[max(0, i - 2) : i]], _plain(words[i + 1]) if i + 1 < len(words) else None)
        held = [p for p in held if wanted(p)]
        if held:
            base = base_spans(text) if base is None else base
            if not any(x < b and a < y for _, x, y in base):
                yield a, b, held


def contexts(docs: DataFrame, known: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(__pii_id, key, start, end, instance, pattern): words that are no identifiers by their look, in the contexts ``known`` (pattern).

    A filter of fixed size goes to the tasks; what it lets through by chance is dropped by a join.
    """
    spark = docs.sparkSession
    ship(spark)
    place = F.pmod(F.crc32(F.col("pattern").cast("binary")), F.lit(_BITS)) + 1
    parted = F.split("pattern", " ")
    last = F.concat(F.lit("W "), F.when(F.startswith("pattern", F.lit("L ")), F.try_element_at(parted, F.lit(3))).otherwise(F.try_element_at(parted, F.lit(2))))
    parts = known.select("pattern").unionByName(known.select(last.alias("pattern"))).select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = bytearray(_BITS // 8)
    for r in parts:
        bits[(r["part"] - 1) * 4096 : r["part"] * 4096] = r["bits"]
    shared = spark.sparkContext.broadcast(bytes(bits))
    rows = docs.select(F.col(id_col).alias("__pii_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string("start int, end int, instance string, pattern string").fields])

    def run(batches):
        filter_, crc = shared.value, zlib.crc32

        def wanted(pattern):
            at = crc(pattern.encode(errors="surrogatepass")) % _BITS
            return filter_[at >> 3] >> (at & 7) & 1

        known = _Known(wanted)
        for batch in batches:
            of, out = [], ([], [], [], [])
            for i, text in enumerate(batch.column(2)):
                text = text.as_py() or ""
                for a, b, held in _words_in(text, wanted, known):
                    for p in held:
                        of.append(i)
                        for column, value in zip(out, (a, b, _instance(text[a:b]), p), strict=True):
                            column.append(value)
            take = pa.array(of, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], schema.names)

    return rows.mapInArrow(tidy(run), schema).join(known.select("pattern").distinct(), "pattern", "left_semi")


_OCCURRENCE = "array<struct<kind:string,start:int,end:int,instance:string,patterns:array<string>>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_contexts: bool = True) -> DataFrame:
    """Rows (__pii_id, key, base, occurrences): the id, whatever its column is called; key tells texts of the same id apart."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__pii_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("base", T._parse_datatype_string(SPAN)), T.StructField("occurrences", T._parse_datatype_string(_OCCURRENCE))])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    occurrence_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            bases, seen = [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                base = base_spans(text)
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                held = []
                if with_contexts and (base or _HINT.search(text)):
                    held = [(k, a, b) for k, a, b in base] + [("secret" if _SECRET.match(text[a:b]) else None, a, b) for a, b in _tokens(text, base)]
                rows, last = [], (0, 0)
                for k, a, b in sorted(held, key=lambda h: h[1]):
                    last = _word_around(text, a, b, last)
                    rows.append({"kind": k, "start": a, "end": b, "instance": _instance(text[a:b]), "patterns": patterns(text, *last)})
                seen.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bases, span_type), pa.array(seen, occurrence_type)], schema.names)

    return rows.mapInArrow(tidy(run), schema)


def occurrences(scanned: DataFrame) -> DataFrame:
    """(pattern, instance, seed) of the scanned tokens."""
    return scanned.select(F.explode("occurrences").alias("o")).select(F.explode("o.patterns").alias("pattern"), F.col("o.instance").alias("instance"), F.col("o.kind").alias("seed"))


def score_patterns(seen: DataFrame, *, rounds: int = 3, smoothing: float = 1.0) -> DataFrame:
    """(pattern, kind, seeds, confidence) after ``rounds`` of scoring over the pattern-instance graph."""
    # One row for each edge: what a hot pattern or a copied text repeats is gone before any join.
    edges = Table(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    sizes = edges.df.groupBy("pattern").agg(F.count("*").alias("n"))
    # Only patterns that hold a seed can ever be sure of a kind.
    kinds = edges.df.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds"))
    graph = Table(edges.df.join(kinds, "pattern").join(sizes, "pattern").select("pattern", "kind", "seeds", "n", "instance", "seed"), "pii-graph")
    edges.drop()
    own = F.when(F.col("seed").isNotNull(), (F.col("seed") == F.col("kind")).cast("double"))
    scored = graph.df.withColumn("s", F.coalesce(own, F.lit(0.0)))
    result = None
    for r in range(rounds):
        confidence = scored.groupBy("pattern", "kind").agg(F.max("seeds").alias("seeds"), (F.sum("s") / (F.max("n") + F.lit(smoothing))).alias("confidence"))
        if r == rounds - 1:
            result = confidence
            break
        # Noisy-or over an instance's patterns that are likelier right than wrong: many weak contexts are no evidence.
        doubt = F.sum(F.when(F.col("confidence") >= 0.5, F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))).otherwise(0.0))
        open_ones = graph.df.where("seed is null").join(confidence.select("pattern", "kind", "confidence"), ["pattern", "kind"])
        belief = open_ones.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("belief"))
        scored = graph.df.join(belief, ["instance", "kind"], "left").withColumn("s", F.coalesce(own, F.col("belief"), F.lit(0.0)))
    return result


def discover(scanned: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_confidence: float = 0.8, least_seeds: int = 5) -> DataFrame:
    """(__pii_id, key, found): spans that sure patterns mark beside the base ones."""
    place = ["__pii_id", "key", "start", "end", "pattern"]

    def sure(seen):
        return score_patterns(seen, rounds=rounds).where((F.col("confidence") >= least_confidence) & (F.col("seeds") >= least_seeds))

    seen = occurrences(scanned)
    likely = Table(sure(seen), "pii-likely").df
    marks = scanned.select("__pii_id", "key", F.explode("occurrences").alias("o")).where("o.kind is null or o.kind = 'secret'").select("__pii_id", "key", "o.start", "o.end", F.explode("o.patterns").alias("pattern")).distinct().join(likely, "pattern")
    # Plain words can only make a pattern less sure: the others need not be looked for.
    able = likely.select("pattern").distinct()
    if able.limit(1).count():
        words = contexts(docs, able, id_col=id_col, text_col=text_col).select("pattern", "instance", F.lit(None).cast("string").alias("seed"))
        surer = Table(sure(seen.join(able, "pattern", "left_semi").unionByName(words)), "pii-sure").df
        if surer.limit(1).count():
            more = contexts(docs, surer.select("pattern"), id_col=id_col, text_col=text_col).select(*place).distinct().join(surer, "pattern")
            marks = marks.unionByName(more)
    best = marks.groupBy("__pii_id", "key", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    return best.groupBy("__pii_id", "key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(id_col, base, found) for every row of ``docs``."""
    scanned = Table(scan(docs, id_col=id_col, text_col=text_col), "pii-scan").df
    found = discover(scanned, docs, id_col=id_col, text_col=text_col, **limits)
    s, f = scanned.alias("s"), found.alias("f")
    met = s.join(f, F.col("s.__pii_id").eqNullSafe(F.col("f.__pii_id")) & (F.col("s.key") == F.col("f.key")), "left")
    return met.select(F.col("s.__pii_id").alias(id_col), F.col("s.base").alias("base"), F.coalesce("f.found", F.array().cast(SPAN)).alias("found"))


def ordered(spans: Column) -> Column:
    """Spans by kind as listed, then start, written kind:start:end and joined by commas."""
    place = F.array(*[F.lit(k) for k in FOUND])
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(place, s["kind"]).alias("p"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with every base and discovered span replaced by its kind in angle brackets.

    Discovered spans are few: documents meet them by a join in which only those with such spans find a partner.
    """
    spark = docs.sparkSession
    ship(spark)
    scanned = Table(scan(docs, id_col=id_col, text_col=text_col), "pii-scan").df
    found = Table(discover(scanned, docs, id_col=id_col, text_col=text_col, **limits).select(F.col("__pii_id").alias("__id"), F.col("key").alias("__key"), F.col("found").alias("__found")), "pii-found").df
    # A table whose size is known: Spark sends it to all tasks if it is below its threshold, and then texts stay where they are.
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__key")), "left").select(*docs.columns, "__found")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                text, found = text.as_py(), found.as_py() or []
                texts.append(text if text is None else blank(text, [*base_spans(text), *((s["kind"], s["start"], s["end"]) for s in found)]))
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return joined.mapInArrow(tidy(run), docs.schema)


def blank(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans become one, named by the one that starts first."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join(out) + text[end:]
