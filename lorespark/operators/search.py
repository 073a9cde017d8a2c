"""Organising, indexing and searching a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import any_of, quote, sql_any
from ..sources.tables import spread, table
from .setjoin import jaccard_best, jaccard_pairs
from .text import STOP

# Categories by substrings, in the order they are tried.
CATEGORIES = {"api": ["api", "endpoint", "rest", "graphql"], "guide": ["guide", "tutorial", "how-to", "howto"], "reference": ["reference", "doc", "documentation"], "concept": ["concept", "overview", "introduction"], "example": ["example", "sample", "demo"]}
#: A query for the corpus at hand.
TERMS = ["the", "and", "data", "license"]


def tokens(text: Column, longer_than: int = 0) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP) & (F.length(w) > longer_than))


_STOP_SQL = ", ".join(quote(w) for w in STOP)
_TOKENS_SQL = rf"(SELECT *, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({_STOP_SQL})) AS ts FROM documents)"


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf): the inverted index."""
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def index_statistics(docs: DataFrame, top: int = 50) -> DataFrame:
    """The terms in most documents: document and collection frequency."""
    by = postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return by.orderBy(F.col("df").desc(), "term").limit(top)


def search(docs: DataFrame, terms: list[str], top: int = 20) -> DataFrame:
    """Term hits weigh 2 and the source's name 3; best first, then by id."""
    query = F.array(*[F.lit(t) for t in terms])
    hits = F.size(F.array_intersect(F.array_distinct(tokens(F.col("text"))), query))
    named = any_of(F.lower("source"), terms).cast("int")
    return docs.select("doc_id", (hits * 2 + named * 3).cast("long").alias("score")).where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(top)


def snippets(docs: DataFrame, term: str, around: int = 50) -> DataFrame:
    """The first mention of a term with what stands around it; without one, the beginning."""
    at = F.locate(term, F.lower("text"))
    start = F.greatest(F.lit(1), at - around)
    cut = F.substring("text", start, F.lit(len(term)) + around + at - start)
    return docs.select("doc_id", F.when(at > 0, cut).otherwise(F.concat(F.substring("text", 1, 200), F.lit("..."))).alias("snippet"))


def categories(docs: DataFrame) -> DataFrame:
    low = F.lower("text")
    out = F.when(F.lit(False), "")
    for name, terms in CATEGORIES.items():
        out = out.when(any_of(low, terms), name)
    return docs.select("doc_id", out.otherwise("uncategorized").alias("category"))


def organized(docs: DataFrame) -> DataFrame:
    met = categories(docs).join(docs.select("doc_id", "source", "n_chars"), "doc_id")
    return met.groupBy("category").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_doc"))


_CATEGORY_SQL = "SELECT doc_id, CASE " + " ".join(f"WHEN {sql_any('lower(text)', ts)} THEN '{n}'" for n, ts in CATEGORIES.items()) + " ELSE 'uncategorized' END AS category FROM documents"


def source_tags(docs: DataFrame, longer_than: int = 3) -> DataFrame:
    """(source, tag, n): words of more than three letters as tags of their source, with the documents that have them."""
    tags = F.array_distinct(tokens(F.col("text"), longer_than))
    return docs.select("source", F.explode(tags).alias("tag")).groupBy("source", "tag").agg(F.count("*").alias("n"))


_TAGS_SQL = rf"(SELECT source, tag, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_filter(ts, lambda w: length(w) > 3))) AS tag FROM {_TOKENS_SQL}) GROUP BY ALL)"


def popular_tags(docs: DataFrame, top: int = 20) -> DataFrame:
    by = source_tags(docs).groupBy("tag").agg(F.count("*").alias("popularity"), F.sum("n").alias("n_docs"), F.min("source").alias("first_source"))
    return by.orderBy(F.col("popularity").desc(), F.col("n_docs").desc(), "tag").limit(top)


def tag_relevance(docs: DataFrame) -> DataFrame:
    """Rarity of each source's tags: 1, and 0.3 if the tag is the source's own or 0.2 if at most three have it."""
    tags = source_tags(docs)
    spread = tags.groupBy("tag").agg(F.count("*").alias("popularity"))
    scored = tags.join(spread, "tag").withColumn("bonus", F.when(F.col("popularity") == 1, 30).when(F.col("popularity") <= 3, 20).otherwise(0))
    return scored.groupBy("source").agg(F.count("*").alias("n_tags"), F.count_if(F.col("popularity") == 1).alias("n_unique"), F.count_if(F.col("popularity") > 5).alias("n_common"), F.sum(F.col("bonus") + 100).alias("relevance"))


def related_sources(docs: DataFrame) -> DataFrame:
    """Jaccard of the sources' tag sets, of all pairs that share a tag.

    Tags of the very same sources count as one, with their number: a tag that many sources have makes
    its pairs once, together with all tags like it, and each of these pairs is in the result.
    """
    tags = source_tags(docs).where("source IS NOT NULL").select("source", "tag")
    size = tags.groupBy("source").agg(F.count("*").alias("n"))
    alike = tags.groupBy("tag").agg(F.sort_array(F.collect_set("source")).alias("holders")).where(F.size("holders") > 1).groupBy("holders").agg(F.count("*").alias("k"))
    first = alike.select("holders", "k", F.posexplode("holders").alias("pos", "a"))
    pairs = first.select("a", "k", F.explode(F.slice("holders", F.col("pos") + 2, F.size("holders"))).alias("b"))
    both = pairs.groupBy("a", "b").agg(F.sum("k").alias("shared"))
    met = both.join(size.select(F.col("source").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("source").alias("b"), F.col("n").alias("nb")), "b")
    return met.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("similarity"))


def all_related(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, shared, similarity): all pairs of documents whose terms are ``least`` alike or more."""
    return jaccard_pairs(docs.select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("terms")), least)


def most_related(docs: DataFrame, top: int = 5, least: float = 0.3) -> DataFrame:
    """(doc_id, rank, related_id, similarity): each document's most alike others."""
    best = jaccard_best(docs.select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("terms")), top, least)
    return best.select(F.col("id").alias("doc_id"), "rank", F.col("other").alias("related_id"), "similarity")


def related_tags(docs: DataFrame, tag: str, top: int = 10) -> DataFrame:
    """Tags of the sources that have ``tag``: in how many of these, in what share of them, in how many sources at all."""
    tags = source_tags(docs).where("source IS NOT NULL")
    holders = tags.where(F.col("tag") == tag).select("source", F.lit(True).alias("held"))
    by = tags.join(holders, "source", "left").groupBy("tag").agg(F.count_if("held").alias("together"), F.count("*").alias("total_usage")).where("together > 0")
    # The tag itself comes first and has all holders; the window sees these few rows only.
    first = by.orderBy((F.col("tag") == tag).desc(), F.col("together").desc(), "tag").limit(top + 1)
    share = F.round(F.col("together") / F.max("together").over(Window.partitionBy()), 2)
    return first.withColumn("score", share).where(F.col("tag") != tag).select("tag", "together", "total_usage", "score")


def tag_suggestions(docs: DataFrame, part: str, top: int = 10) -> DataFrame:
    """Tags that hold ``part``: those that begin with it first, then the shortest."""
    found = source_tags(docs).where(F.contains("tag", F.lit(part.lower()))).select("tag").distinct()
    return found.orderBy(~F.startswith("tag", F.lit(part.lower())), F.length("tag"), "tag").limit(top)


def multi_tag(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Documents with any of the tags, and what share of them they have."""
    hits = F.array_intersect(F.array_distinct(tokens(F.col("text"))), F.array(*[F.lit(t) for t in wanted]))
    return docs.select("doc_id", F.size(hits).alias("n"), F.round(F.size(hits) / len(wanted), 6).alias("ratio")).where("n > 0")


def facets(docs: DataFrame) -> DataFrame:
    """Counts by field and value over the scalar fields."""
    wide = docs.select("lang", "source", F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("size"))
    return wide.unpivot([], ["lang", "source", "size"], "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


def suggestions(docs: DataFrame, prefix: str, top: int = 10) -> DataFrame:
    """Terms with a prefix by how many documents have them, with their edits from it."""
    by = postings(docs).where(F.startswith(F.col("term"), F.lit(prefix))).groupBy("term").agg(F.count("*").alias("n"))
    return by.select("term", "n", F.levenshtein("term", F.lit(prefix)).alias("edits")).orderBy(F.col("n").desc(), "term").limit(top)


def text_rank(docs: DataFrame, term: str, top: int = 20) -> DataFrame:
    """min(10 * mentions / words, 1), best first."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    mentions = (F.length("text") - F.length(F.replace(F.lower("text"), F.lit(term), F.lit("")))) / len(term)
    return docs.select("doc_id", F.round(F.least(10 * mentions / words, F.lit(1.0)), 6).alias("score")).where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(top)


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def semantic(vectors: DataFrame, query_id: int = 0, top: int = 20, least: float = 0.1) -> DataFrame:
    """The vectors nearest to one of them by cosine: one row is broadcast, whatever the table's size."""
    asked = vectors.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    met = vectors.crossJoin(F.broadcast(asked)).where(F.col("vec_id") != query_id)
    scored = met.select("vec_id", "label", F.round(_cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.where(F.col("score") > least).orderBy(F.col("score").desc(), "vec_id").limit(top)


def group_means(vectors: DataFrame) -> DataFrame:
    """(label, embedding): mean vectors."""
    each = vectors.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))


def similar_groups(vectors: DataFrame) -> DataFrame:
    """Cosine of the labels' mean vectors, for each pair of labels (which are few)."""
    m = group_means(vectors)
    a, b = m.select(F.col("label").alias("a"), F.col("embedding").alias("x")), m.select(F.col("label").alias("b"), F.col("embedding").alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(_cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


def collections(docs: DataFrame) -> DataFrame:
    """A collection for each language: its key, and how many of its documents have labels' ids' neighbours."""
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).withColumn("collection", F.substring(F.sha2("lang", 256), 1, 16))


QUERIES = {
    "se_index": lambda s, d: index_statistics(table(s, d, "documents")),
    "se_search": lambda s, d: search(table(s, d, "documents"), TERMS),
    "se_snippets": lambda s, d: snippets(table(s, d, "documents"), "license"),
    "se_categories": lambda s, d: categories(table(s, d, "documents")),
    "se_organized": lambda s, d: organized(table(s, d, "documents")),
    "se_popular_tags": lambda s, d: popular_tags(table(s, d, "documents")),
    "se_tag_relevance": lambda s, d: tag_relevance(table(s, d, "documents")),
    "se_related_sources": lambda s, d: related_sources(table(s, d, "documents")),
    "se_all_related": lambda s, d: all_related(spread(table(s, d, "documents"))),
    "se_most_related": lambda s, d: most_related(spread(table(s, d, "documents"))),
    "se_related_tags": lambda s, d: related_tags(table(s, d, "documents"), "license"),
    "se_tag_suggestions": lambda s, d: tag_suggestions(table(s, d, "documents"), "en"),
    "se_multi_tag": lambda s, d: multi_tag(table(s, d, "documents"), TERMS),
    "se_facets": lambda s, d: facets(table(s, d, "documents")),
    "se_suggestions": lambda s, d: suggestions(table(s, d, "documents"), "th"),
    "se_text_rank": lambda s, d: text_rank(table(s, d, "documents"), "license"),
    "se_semantic": lambda s, d: semantic(table(s, d, "embeddings")),
    "se_similar_groups": lambda s, d: similar_groups(table(s, d, "embeddings")),
    "se_collections": lambda s, d: collections(table(s, d, "documents")),
}
_Q = "[" + ", ".join(quote(t) for t in TERMS) + "]"
_POSTINGS_SQL = f"(SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM {_TOKENS_SQL}) GROUP BY ALL)"
_MEANS_SQL = "(SELECT label, list(x ORDER BY pos) AS e FROM (SELECT label, pos, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label)"
_RELATED_SQL = f"(WITH t AS (SELECT doc_id, unnest(list_distinct(ts)) AS term FROM {_TOKENS_SQL}), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM t x JOIN t y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL) SELECT a, b, shared, round(shared / (m.n + k.n - shared), 6) AS similarity FROM p JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE 10 * shared >= 3 * (m.n + k.n - shared))"
ORACLE = {
    "se_all_related": f"SELECT * FROM {_RELATED_SQL}",
    "se_most_related": f"WITH p AS {_RELATED_SQL} SELECT doc_id, rank::INT AS rank, related_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, related_id) AS rank FROM (SELECT a AS doc_id, b AS related_id, similarity FROM p UNION ALL SELECT b, a, similarity FROM p)) WHERE rank <= 5",
    "se_index": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {_POSTINGS_SQL} GROUP BY term ORDER BY df DESC, term LIMIT 50",
    "se_search": f"SELECT doc_id, (2 * len(list_intersect(list_distinct(ts), {_Q})) + 3 * {sql_any('lower(source)', TERMS)}::INT)::BIGINT AS score FROM {_TOKENS_SQL} WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "se_snippets": "SELECT doc_id, CASE WHEN a > 0 THEN substr(text, b, 57 + a - b) ELSE substr(text, 1, 200) || '...' END AS snippet FROM (SELECT *, greatest(1, a - 50) AS b FROM (SELECT *, instr(lower(text), 'license') AS a FROM documents))",
    "se_categories": _CATEGORY_SQL,
    "se_organized": f"SELECT category, count(*) AS n_docs, count(DISTINCT source) AS n_sources, sum(n_chars)::BIGINT AS n_chars, min(doc_id) AS first_doc FROM ({_CATEGORY_SQL}) JOIN documents USING (doc_id) GROUP BY category",
    "se_popular_tags": f"SELECT tag, count(*) AS popularity, sum(n)::BIGINT AS n_docs, min(source) AS first_source FROM {_TAGS_SQL} GROUP BY tag ORDER BY popularity DESC, n_docs DESC, tag LIMIT 20",
    "se_tag_relevance": f"SELECT source, count(*) AS n_tags, count(*) FILTER (p = 1) AS n_unique, count(*) FILTER (p > 5) AS n_common, sum(100 + CASE WHEN p = 1 THEN 30 WHEN p <= 3 THEN 20 ELSE 0 END)::BIGINT AS relevance FROM (SELECT *, count(*) OVER (PARTITION BY tag) AS p FROM {_TAGS_SQL}) GROUP BY source",
    "se_related_sources": f"WITH t AS {_TAGS_SQL}, s AS (SELECT source, count(*) AS n FROM t GROUP BY source), b AS (SELECT x.source AS a, y.source AS b, count(*) AS shared FROM t x JOIN t y ON x.tag = y.tag AND x.source < y.source GROUP BY ALL) SELECT a, b, shared, round(shared / (p.n + q.n - shared), 6) AS similarity FROM b JOIN s p ON p.source = a JOIN s q ON q.source = b",
    "se_related_tags": f"WITH t AS {_TAGS_SQL}, h AS (SELECT source FROM t WHERE tag = 'license' AND source IS NOT NULL) SELECT tag, count(*) FILTER (source IN (FROM h)) AS together, count(*) AS total_usage, round(together / (SELECT count(*) FROM h), 2) AS score FROM t WHERE source IS NOT NULL AND tag <> 'license' GROUP BY tag HAVING together > 0 ORDER BY together DESC, tag LIMIT 10",
    "se_tag_suggestions": f"SELECT tag FROM (SELECT DISTINCT tag FROM {_TAGS_SQL}) WHERE contains(tag, 'en') ORDER BY NOT starts_with(tag, 'en'), length(tag), tag LIMIT 10",
    "se_multi_tag": f"SELECT doc_id, n::INT AS n, round(n / {len(TERMS)}, 6) AS ratio FROM (SELECT doc_id, len(list_intersect(list_distinct(ts), {_Q})) AS n FROM {_TOKENS_SQL}) WHERE n > 0",
    "se_facets": "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'size', CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END, count(*) FROM documents GROUP BY ALL",
    "se_suggestions": f"SELECT term, count(*) AS n, levenshtein(term, 'th')::INT AS edits FROM {_POSTINGS_SQL} WHERE starts_with(term, 'th') GROUP BY term ORDER BY n DESC, term LIMIT 10",
    "se_text_rank": r"SELECT * FROM (SELECT doc_id, round(least(10 * ((length(text) - length(replace(lower(text), 'license', ''))) / 7) / len(regexp_split_to_array(trim(text), '\s+')), 1.0::DOUBLE), 6) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "se_semantic": "SELECT * FROM (SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0) WHERE score > 0.1 ORDER BY score DESC, vec_id LIMIT 20",
    "se_similar_groups": f"SELECT x.label AS a, y.label AS b, round(list_cosine_similarity(x.e, y.e), 6) AS similarity FROM {_MEANS_SQL} x JOIN {_MEANS_SQL} y ON x.label < y.label",
    "se_collections": "SELECT lang, count(*) AS n_docs, min(doc_id) AS first_doc, substr(sha256(lang), 1, 16) AS collection FROM documents GROUP BY lang",
}
