"""Fuzzy matching of many words at once, by deletion neighbourhoods.

Two words at most k edits apart have a common string that k deletions or fewer make of either,
so these strings are the keys of an equi-join, and only words that meet are compared.
Long words would have too many: where both are longer than ``LONG``, one of k + 1 segments of
one word is left untouched by k edits and stands in the other at most k places further on, so
segments are the keys.  Both find every pair; ``levenshtein`` decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import quote
from ..sources.tables import spread, table
from .discovery import USE_CASES
from .search import _TOKENS_SQL, tokens

#: Length up to which words are joined by deletions.
LONG = 20


def _deleted(word: Column) -> Column:
    """The word and what is left of it without one of its characters."""
    one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_append(one, word)


def deletions(word: Column, most: int) -> Column:
    """All strings that ``most`` deletions or fewer make of a word."""
    keys = F.array(word)
    for _ in range(most):
        keys = F.array_distinct(F.flatten(F.transform(keys, _deleted)))
    return keys


def _segments(length: Column, parts: int) -> list[tuple[Column, Column]]:
    """(first place, length) of each of the segments of words of a length; the last ones are longer by one if need be."""
    size, rest = F.floor(length / parts).cast("int"), F.pmod(length, F.lit(parts)).cast("int")
    out = []
    for i in range(parts):
        longer = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - rest))
        out.append((size * i + longer + 1, size + (F.lit(i) >= F.lit(parts) - rest).cast("int")))
    return out


def _key(i: int, length: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.lit(str(i)), length.cast("string"), text)


def _own_segments(word: Column, most: int) -> Column:
    n = F.length(word)
    return F.array(*[_key(i, n, F.substring(word, at, size)) for i, (at, size) in enumerate(_segments(n, most + 1))])


def _met_segments(word: Column, most: int) -> Column:
    """Wherever a segment of a word at most ``most`` edits away may stand in this one."""
    keys = []
    for more in range(-most, most + 1):
        n = F.length(word) + more
        for i, (at, size) in enumerate(_segments(n, most + 1)):
            keys += [F.when(at + d >= 1, _key(i, n, F.substring(word, at + d, size))) for d in range(-most, most + 1)]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def fuzzy_join(words: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(word, columns of ``vocabulary``, edits): each distinct word with the terms at most ``most`` edits away.

    Null and empty words and terms match nothing; terms are taken to be distinct (a repeated one repeats its rows).
    """
    asked = words.select("word").where(F.length("word") > 0).distinct()
    known = vocabulary.select(F.col("term").alias("__term")).where(F.length("__term") > 0).distinct()
    short = LONG + most

    def pairs(left: Column, right: Column, a: DataFrame, b: DataFrame) -> DataFrame:
        keyed = a.select("word", F.explode(left).alias("key")).join(b.select("__term", F.explode(right).alias("key")), "key")
        return keyed.select("word", "__term")

    near = pairs(deletions(F.col("word"), most), deletions(F.col("__term"), most), asked.where(F.length("word") <= short), known.where(F.length("__term") <= short))
    far = pairs(_met_segments(F.col("word"), most), _own_segments(F.col("__term"), most), asked.where(F.length("word") > LONG), known.where(F.length("__term") > LONG))
    met = near.unionByName(far).distinct().withColumn("edits", F.levenshtein("word", "__term", most)).where("edits >= 0")
    return met.withColumnRenamed("__term", "term").join(vocabulary, "term").select("word", *vocabulary.columns, "edits")


def ranked_suggestions(found: DataFrame, top: int = 10) -> DataFrame:
    """(word, rank, term, n, edits): terms that begin with the word first, then those that hold it, then by number, then the shortest."""
    line = Window.partitionBy("word").orderBy(F.startswith("term", F.col("word")).desc(), F.contains("term", F.col("word")).desc(), F.col("n").desc(), F.length("term"), "term")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top).select("word", "rank", "term", "n", "edits")


def terms_of(docs: DataFrame) -> DataFrame:
    """(term, n): how often each term is in the texts."""
    return docs.select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def misspelled(texts: DataFrame) -> DataFrame:
    """(word): words of more than five letters with their second and third exchanged."""
    w = F.col("w")
    return texts.select(F.explode(tokens(F.col("text"), 5)).alias("w")).select(F.concat(F.substring(w, 1, 1), F.substring(w, 3, 1), F.substring(w, 2, 1), F.substring(w, F.lit(4), F.length(w))).alias("word")).distinct()


def corrections(docs: DataFrame, texts: DataFrame, most: int = 2, top: int = 5) -> DataFrame:
    return ranked_suggestions(fuzzy_join(misspelled(texts), terms_of(docs), most), top)


def use_case_suggestions(asked: DataFrame, top: int = 10) -> DataFrame:
    """(part, rank, suggestion): for rows (part) the use cases that hold it in their name or a word, then such words."""
    part = F.lower("part")
    names = [F.when(F.contains(F.lit(k), part) | F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(w, part)), F.lit(k)) for k, ws in USE_CASES.items()]
    words = [F.when(F.contains(F.lit(w), part), F.lit(w)) for ws in USE_CASES.values() for w in ws]
    found = F.slice(F.array_distinct(F.array_compact(F.array(*names, *words))), 1, top)
    return asked.where(F.length("part") > 0).select("part").distinct().select("part", F.posexplode(found).alias("at", "suggestion")).select("part", (F.col("at") + 1).alias("rank"), "suggestion")


def parts_of(docs: DataFrame, size: int = 3) -> DataFrame:
    """(part): beginnings of the terms of all texts."""
    return docs.select(F.explode(tokens(F.col("text"))).alias("t")).select(F.substring("t", 1, size).alias("part")).distinct()


QUERIES = {
    "se_corrections": lambda s, d: corrections(spread(table(s, d, "documents")), table(s, d, "benchmark")),
    "se_use_case_suggestions": lambda s, d: use_case_suggestions(parts_of(spread(table(s, d, "documents")))),
}
#: The SQL engine's distance counts bytes: for it, letters beyond ASCII become capitals, which no lower-case term has.
_LETTERS = "àáâãäåæçèéêëìíîïñòóôõöùúûüß"
_FLAT = lambda x: f"translate({x}, '{_LETTERS}', '{''.join(chr(65 + i) for i in range(len(_LETTERS)))}')"
_BENCHMARK_SQL = _TOKENS_SQL.replace("FROM documents", "FROM benchmark")
_NAMES = ", ".join(f"({i}, {quote(k)}, [{', '.join(map(quote, ws))}])" for i, (k, ws) in enumerate(USE_CASES.items()))
ORACLE = {
    "se_corrections": f"""WITH w AS (SELECT DISTINCT substr(w, 1, 1) || substr(w, 3, 1) || substr(w, 2, 1) || substr(w, 4) AS word FROM (SELECT unnest(ts) AS w FROM {_BENCHMARK_SQL}) WHERE length(w) > 5),
t AS (SELECT term, count(*) AS n FROM (SELECT unnest(ts) AS term FROM {_TOKENS_SQL}) GROUP BY term),
a AS MATERIALIZED (SELECT word, {_FLAT('word')} AS f, unnest(range(length(word) - 2, length(word) + 3)) AS k FROM w), b AS MATERIALIZED (SELECT term, n, {_FLAT('term')} AS g, length(term) AS k FROM t),
p AS (SELECT word, term, n, levenshtein(f, g)::INT AS edits FROM a JOIN b USING (k) WHERE edits <= 2)
SELECT word, rank::INT AS rank, term, n, edits FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY starts_with(term, word) DESC, contains(term, word) DESC, n DESC, length(term), term) AS rank FROM p) WHERE rank <= 5""",
    "se_use_case_suggestions": f"""WITH p AS (SELECT DISTINCT substr(t, 1, 3) AS part FROM (SELECT unnest(ts) AS t FROM {_TOKENS_SQL})), u AS (SELECT * FROM (VALUES {_NAMES}) AS x(i, name, words)),
k AS (SELECT i, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM u),
s AS (SELECT part, 0 AS step, i, 0 AS j, name AS suggestion FROM p, u WHERE contains(name, part) OR len(list_filter(words, lambda x: contains(x, part))) > 0 UNION ALL SELECT part, 1, i, j, word FROM p, k WHERE contains(word, part)),
f AS (SELECT part, suggestion, min(step * 1000000 + i * 1000 + j) AS place FROM s GROUP BY ALL)
SELECT part, rank::INT AS rank, suggestion FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY place) AS rank FROM f) WHERE rank <= 10""",
}
