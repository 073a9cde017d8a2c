"""Finding things: use cases, related documents, fuzzy terms, highlights, filters; versions, errors, usage and who might like what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import any_of, matches, quote, sql_any, sql_matches
from ..sources.tables import spread, table
from .code import _DOCS, sample_docs
from .crawl import outcomes
from .history import AS_OF
from .search import _TOKENS_SQL, tokens
from .text import _ASCII, SECTION_AGAINST, SECTION_FOR
from .urls import _RESOLVED, host_of, page_links, resolve, split

# Use cases and the words that speak for them.
USE_CASES = {
    "web development": ["web", "http", "server", "api", "rest", "framework", "flask", "django", "fastapi", "web application", "web service", "endpoint", "route", "middleware"],
    "data science": ["data", "analysis", "machine learning", "ml", "statistics", "numpy", "pandas", "visualization", "plot", "chart", "dataset", "model", "algorithm"],
    "database": ["database", "sql", "orm", "query", "table", "record", "sqlalchemy", "mongodb", "postgresql", "mysql", "sqlite", "nosql"],
    "testing": ["test", "testing", "unittest", "pytest", "mock", "assertion", "coverage", "test case", "test suite", "automation", "quality assurance"],
    "networking": ["network", "socket", "tcp", "udp", "protocol", "client", "server", "connection", "request", "response", "http", "https"],
    "file processing": ["file", "io", "read", "write", "parse", "csv", "json", "xml", "document", "text processing", "format", "encoding"],
    "gui development": ["gui", "interface", "window", "button", "widget", "tkinter", "qt", "user interface", "desktop", "application", "form"],
    "security": ["security", "encryption", "authentication", "authorization", "crypto", "hash", "password", "token", "ssl", "tls", "certificate"],
    "image processing": ["image", "picture", "photo", "pixel", "filter", "resize", "crop", "opencv", "pillow", "graphics", "vision", "processing"],
    "automation": ["automation", "script", "task", "schedule", "cron", "workflow", "batch", "process", "selenium", "scraping", "bot"],
}
# Titles of sections that are documentation and that are not.
DOC_TITLES = ["installation", "getting started", "quick start", "usage", "examples", "example", "api", "documentation", "tutorial", "guide", "configuration", "features", "overview", "introduction", "install"]
OTHER_TITLES = ["contributing", "code of conduct", "license", "changelog", "releases", "issues", "pull requests", "contributors", "acknowledgments", "build status", "badges", "development", "testing"]
# Sections of complete documentation with weight, priority, effort and what they build on.
ESSENTIAL = [
    ("installation", 0.20, "high", "low", ""),
    ("quick_start", 0.15, "high", "medium", "installation"),
    ("api_reference", 0.25, "high", "high", ""),
    ("examples", 0.15, "medium", "medium", "api_reference"),
    ("configuration", 0.05, "low", "medium", "api_reference"),
    ("troubleshooting", 0.05, "low", "high", "api_reference,examples"),
    ("overview", 0.15, "medium", "low", ""),
]
# Words that tell what a text is when no model can be asked.
LEGAL = ["license", "copyright", "mit license", "legal text"]
META = ["contributing", "changelog", "history", "code of conduct"]
CLEAR = ["api", "tutorial", "guide", "installation", "usage", "example", "reference", "documentation"]
# Categories of errors by type and by message, in the order they are tried.
ERRORS = [
    ("network", ["connection", "network", "http", "socket", "dns"], ["network", "connection", "http", "socket", "dns"]),
    ("parsing", ["parse", "syntax", "value", "type", "attribute"], []),
    ("validation", ["validation", "valid", "schema"], ["validation", "valid", "schema"]),
    ("configuration", ["config", "setting", "option"], ["config", "setting", "option"]),
    ("authentication", ["auth", "login", "credential"], []),
    ("authorization", ["permission", "access", "forbidden"], []),
    ("resource", ["resource", "memory", "disk", "file"], []),
    ("timeout", ["timeout", "deadline"], []),
    ("internal", ["internal"], []),
    ("external", ["external"], []),
]
# Libraries by category, what is on the rise in each, and what is offered to the unknown.
CATEGORIES = {
    "web": ["requests", "fastapi", "flask", "django", "aiohttp", "httpx"],
    "data": ["pandas", "numpy", "matplotlib", "seaborn", "scikit-learn"],
    "testing": ["pytest", "unittest", "mock", "coverage"],
    "async": ["asyncio", "aiohttp", "aiofiles", "uvloop"],
    "database": ["sqlalchemy", "psycopg2", "pymongo", "redis"],
    "api": ["fastapi", "flask", "django", "requests", "httpx"],
}
TRENDS = [("web", "fastapi", 0.9), ("web", "httpx", 0.8), ("web", "starlette", 0.7), ("data", "polars", 0.9), ("data", "plotly", 0.8), ("data", "streamlit", 0.7), ("testing", "pytest-xdist", 0.8), ("testing", "hypothesis", 0.7)]
DEFAULTS = [("requests", 1.0), ("pandas", 0.9), ("pytest", 0.8), ("fastapi", 0.8), ("numpy", 0.7), ("matplotlib", 0.7), ("flask", 0.6), ("sqlalchemy", 0.6)]
# Groups and kinds of libraries by content.
GROUPS = [("core", ["framework", "core", "main", "primary"]), ("development", ["test", "debug", "development", "dev"])]
LIBRARY_KINDS = [("web_development", ["web", "http", "api", "server", "framework"]), ("data_processing", ["data", "analysis", "numpy", "pandas"]), ("testing", ["test", "mock", "pytest"]), ("utilities", ["util", "tool", "helper"])]


def _cascade(text: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    out = F.when(F.lit(False), "")
    for name, marks in rules:
        out = out.when(any_of(text, marks), name)
    return out.otherwise(otherwise)


def _sql_cascade(text: str, rules: list[tuple[str, list[str]]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(text, m)} THEN '{n}'" for n, m in rules) + f" ELSE '{otherwise}' END"


def _word_score(low: Column, words: list[str]) -> Column:
    """Whole words for a thousand characters, ten at most; a word that isn't there costs no pattern."""
    hits = sum((F.when(F.contains(low, F.lit(w)), matches(low, rf"\b{w}\b")).otherwise(0) for w in words), F.lit(0))
    return F.when(F.length(low) > 0, F.least(hits / (F.length(low) / 1000), F.lit(10.0))).otherwise(0.0)


def _sql_word_score(low: str, words: list[str]) -> str:
    return f"CASE WHEN length({low}) > 0 THEN least(({' + '.join(sql_matches(low, rf'{chr(92)}b{w}{chr(92)}b') for w in words)}) / (length({low}) / 1000::DOUBLE), 10.0) ELSE 0 END::DOUBLE"


def use_cases(docs: DataFrame, top: int = 3) -> DataFrame:
    """(doc_id, use_case, score, rank): the use cases a text speaks for most."""
    # Lower case is made once, in a step of its own.
    low = F.col("__low")
    each = docs.select("doc_id", F.lower("text").alias("__low")).select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("use_case"), F.round(_word_score(low, w), 6).alias("score")) for k, w in USE_CASES.items()])))
    ranked = each.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "use_case")))
    return ranked.where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


_CASES = f"(SELECT doc_id, unnest([{', '.join(map(quote, USE_CASES))}]) AS use_case, round(unnest([{', '.join(_sql_word_score('t', w) for w in USE_CASES.values())}]), 6) AS score FROM (SELECT doc_id, {_ASCII} AS t FROM documents WHERE text IS NOT NULL))"


def detected_use_cases(docs: DataFrame) -> DataFrame:
    """(doc_id, use_cases): those of which at least two words are in the text."""
    low = F.col("__low")
    some = [F.when(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) >= 2, F.lit(k)) for k, words in USE_CASES.items()]
    return docs.select("doc_id", F.lower("text").alias("__low")).select("doc_id", F.array_join(F.array_compact(F.array(*some)), ",").alias("use_cases"))


def use_case_search(docs: DataFrame, query: str, top: int = 20) -> DataFrame:
    """The texts that speak most for the use cases that a query names, or for the query itself."""
    low = query.lower()
    words = [w for k, own in USE_CASES.items() for w in own * (any(x in low for x in own) + (k in low))] or [low]
    scored = docs.select("doc_id", F.round(_word_score(F.lower("text"), words), 6).alias("score")).where("score > 0")
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(top)


def related_documents(docs: DataFrame, doc_id: int, least: float = 0.3) -> DataFrame:
    """(doc_id, similarity): documents whose terms are like those of one."""
    own = docs.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("terms"))
    asked = own.where(F.col("doc_id") == doc_id).select(F.col("terms").alias("asked")).limit(1)
    both = F.size(F.array_intersect("terms", "asked"))
    met = own.where(F.col("doc_id") != doc_id).join(F.broadcast(asked))  # one row
    similarity = both / (F.size("terms") + F.size("asked") - both)
    return met.select("doc_id", F.round(similarity, 6).alias("similarity")).where(F.col("similarity") >= least)


def fuzzy_terms(docs: DataFrame, word: str, most: int = 2) -> DataFrame:
    """(term, n, edits): terms of the corpus within so many edits of a word."""
    counted = docs.select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counted.withColumn("edits", F.levenshtein("term", F.lit(word))).where(F.col("edits") <= most)


def highlights(docs: DataFrame, word: str, around: int = 20) -> DataFrame:
    """(doc_id, highlight): the first place of a word, marked, with what is around it."""
    text = F.col("text")
    at = F.locate(word.lower(), F.lower(text))
    start, end = F.greatest(at - around, F.lit(1)), F.least(at + len(word) - 1 + around, F.length(text))
    found = F.substring(text, at, F.lit(len(word)))
    context = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))
    return docs.where(F.contains(F.lower("text"), F.lit(word.lower()))).select("doc_id", F.replace(context, found, F.concat(F.lit("<mark>"), found, F.lit("</mark>"))).alias("highlight"))


def filtered(docs: DataFrame, filters: dict[str, object], sort: str, descending: bool, limit: int, offset: int = 0) -> DataFrame:
    """Rows equal to all filters, sorted (nulls last going up, first going down), a page of them."""
    for name, value in filters.items():
        docs = docs.where(F.col(name).eqNullSafe(F.lit(value)))
    order = F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()
    return docs.orderBy(order, "doc_id").offset(offset).limit(limit)


def checked_queries(queries: DataFrame, least: int = 3) -> DataFrame:
    q = F.col("text")
    error = F.when(q.isNull() | (F.trim(q) == ""), "empty").when(F.length(q) > 500, "too long").when(F.length(q) < least, "too short")
    return queries.select("conv_id", "turn", error.alias("error"), error.isNull().alias("is_valid"))


def recent_queries(events: DataFrame, top: int = 50) -> DataFrame:
    """Distinct queries (here: who asks for what), the last one first."""
    q = F.concat_ws(" ", F.col("user_id").cast("string"), "event_type")
    return events.groupBy(q.alias("query")).agg(F.max(F.struct("ts", "event_id")).alias("last")).orderBy(F.col("last").desc()).limit(top).select("query", F.col("last.event_id").alias("event_id"))


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk): the whole text, and its title with each paragraph."""
    lines = F.split("text", "\n", -1)
    title = F.element_at(lines, 1)
    rest = F.transform(F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.length(F.trim(x)) > 0), lambda x: F.concat(title, F.lit(". "), x))
    return docs.where("text is not null").select("doc_id", F.posexplode(F.concat(F.array("text"), rest)).alias("pos", "chunk"))


def basic_search(docs: DataFrame, word: str, top: int = 20) -> DataFrame:
    """Ten times a word's share of all words, 1 at most; best first."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) > 0)
    hits = matches(F.lower("text"), word)
    score = F.least(10 * hits / F.greatest(F.size(words), F.lit(1)), F.lit(1.0))
    return docs.select("doc_id", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(top)


def references(links: DataFrame) -> DataFrame:
    """(page_id, n_internal, n_external): resolved links that hold the page's host, and others."""
    t = links.select("page_id", host_of(split(F.col("url"))["netloc"]).alias("host"), resolve(F.col("url"), F.col("link")).alias("target")).where("target like 'http%'")
    own = F.contains("target", F.col("host"))
    return t.groupBy("page_id").agg(F.count_if(own).alias("n_internal"), F.count_if(~own).alias("n_external"))


def corpus_statistics(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"), F.max(F.length("text")).alias("longest"))


def second_versions(docs: DataFrame) -> DataFrame:
    """The sample documents a version later: some gone, some without their definitions."""
    k = F.col("doc_id")
    return docs.where(k % 7 != 0).withColumn("text", F.when(k % 3 == 0, F.regexp_replace("text", r"(?m)^.*\b(def|class) .*\n", "")).otherwise(F.col("text")))


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, kind, line): pages that are gone, and lines that are gone from the others and name an interface, a deprecation or a break."""
    met = old.select("doc_id", F.col("text").alias("before")).join(new.select("doc_id", F.col("text").alias("after"), F.lit(True).alias("there")), "doc_id", "left")
    gone = met.where("there is null").select("doc_id", F.lit("removed_page").alias("kind"), F.lit(None).cast("string").alias("line"))
    lines = met.where("there").select("doc_id", F.explode(F.array_except(F.split("before", "\n", -1), F.split("after", "\n", -1))).alias("line"))
    low = F.lower("line")
    kind = F.when(F.regexp_like("line", F.lit(r"def\s+\w+|class\s+\w+|function\s+\w+|method\s+\w+")), "removed_api").when(F.contains(low, F.lit("deprecated")), "deprecation").when(F.contains(low, F.lit("break")), "explicit_breaking")
    return gone.unionByName(lines.select("doc_id", kind.alias("kind"), "line").where("kind is not null"))


def version_graph(orders: DataFrame) -> DataFrame:
    """(o_custkey, o_orderkey, next, days, is_latest): orders as versions, each with an edge to the one after it."""
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    after = F.lead("o_orderkey").over(line)
    return orders.select("o_custkey", "o_orderkey", after.alias("next"), F.datediff(F.lead("o_orderdate").over(line), "o_orderdate").alias("days"), after.isNull().alias("is_latest"))


def query_lengths(turns: DataFrame) -> DataFrame:
    n = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: F.length(x) > 0))
    return turns.where("role = 'user' and text is not null").select(n.alias("n")).agg(F.round(F.avg("n"), 4).alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"), F.count_if(F.col("n") == 1).alias("n_single"), F.count_if(F.col("n") > 1).alias("n_multi"))


def filter_usage(events: DataFrame, top: int = 5) -> DataFrame:
    """(key, n, share): filters that searches carry, in percent of all."""
    keys = events.select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return keys.join(F.broadcast(events.agg(F.count("*").alias("all"))), how="cross").select("key", "n", F.round(100 * F.col("n") / F.col("all"), 4).alias("share")).orderBy(F.col("n").desc(), "key").limit(top)  # one row


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def click_positions(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'click'").agg(F.count("*").alias("n"), F.round(F.avg(_k()), 6).alias("position"))


def most_interacted(events: DataFrame, kind: str, top: int = 5) -> DataFrame:
    return events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("rating")).orderBy(F.col("n").desc(), "user_id").limit(top)


def performance_scores(events: DataFrame) -> DataFrame:
    """(user_id, event_type, score): response time, memory, processor and success of a backend at a domain, each from none to its weight."""
    by = events.groupBy("user_id", "event_type").agg((F.avg("value") / 100).alias("seconds"), F.avg(_k() * 4).alias("memory"), F.avg(_k() / 2).alias("cpu"), F.avg((F.col("value") < 400).cast("int")).alias("success"))
    part = lambda weight, used, most: weight * F.greatest(1 - used / most, F.lit(0.0))
    return by.select("user_id", "event_type", F.round(part(0.4, F.col("seconds"), 5) + part(0.3, F.col("memory"), 200) + part(0.2, F.col("cpu"), 50) + 0.1 * F.col("success"), 6).alias("score"))


def kept_metrics(events: DataFrame, as_of: str = AS_OF, days: int = 20) -> DataFrame:
    """Calls, errors, extremes and means by kind, of the last days only."""
    recent = events.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
    return recent.groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 400).alias("errors"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("mean"))


_TYPES = ["ConnectionError", "ParseError", "KeyError", "PermissionDenied", "TimeoutError", "InternalFault", "AuthFailure", "MemoryError", "ExternalFault"]
_MESSAGES = ["gone", "invalid schema", "bad option given", "nothing", "dns lookup failed"]


def error_categories(events: DataFrame) -> DataFrame:
    """(category, n): what failures are about, by type and message."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))
    kind, message = F.lower(pick(_TYPES)), F.lower(pick(_MESSAGES))
    out = F.when(F.lit(False), "")
    for name, types, words in ERRORS:
        hit = any_of(kind, types)
        out = out.when(hit | any_of(message, words) if words else hit, name)
    return events.groupBy(out.otherwise("unknown").alias("category")).agg(F.count("*").alias("n"))


def _errors_sql() -> str:
    pick = lambda values: f"lower([{', '.join(map(quote, values))}][(event_id % {len(values)} + 1)::INT])"
    case = " ".join(f"WHEN {sql_any('k', t)}{' OR ' + sql_any('m', w) if w else ''} THEN '{n}'" for n, t, w in ERRORS)
    return f"SELECT CASE {case} ELSE 'unknown' END AS category, count(*) AS n FROM (SELECT {pick(_TYPES)} AS k, {pick(_MESSAGES)} AS m FROM events) GROUP BY 1"


def liked_by_similar(items: DataFrame, user: int, least: float = 0.2, users: int = 5, top: int = 10) -> DataFrame:
    """(item, score) of (user_id, item): what the users most like one have, and it has not, by the sum of their likeness."""
    pairs = items.select("user_id", "item").distinct()
    own = pairs.where(F.col("user_id") == user).select("item", F.lit(1).alias("own"))
    size = pairs.where(F.col("user_id") == user).agg(F.count("*").alias("mine"))
    met = pairs.where(F.col("user_id") != user).join(own, "item", "left").groupBy("user_id").agg(F.count("own").alias("both"), F.count("*").alias("theirs"))
    alike = met.join(F.broadcast(size), how="cross").select("user_id", (F.col("both") / (F.col("mine") + F.col("theirs") - F.col("both"))).alias("similarity"))  # one row
    best = alike.where(F.col("similarity") > least).orderBy(F.col("similarity").desc(), "user_id").limit(users)
    unseen = pairs.join(F.broadcast(best), "user_id").join(own, "item", "left_anti")  # a few users
    return unseen.groupBy("item").agg(F.round(F.sum("similarity"), 6).alias("score")).orderBy(F.col("score").desc(), "item").limit(top)


_LIBRARIES = sorted({x for own in CATEGORIES.values() for x in own} | {"left-pad", "tox"})
_ITEMS = "(SELECT DISTINCT user_id, event_type || ':' || (json_extract_string(props, '$.k')::INT % 10) AS item FROM events)"


def categories_of_users(events: DataFrame) -> DataFrame:
    """(user_id, categories, offers): categories whose weight is at least 0.3 of the user's greatest; what is on the rise there, or what is offered to the unknown."""
    lib = F.element_at(F.array(*[F.lit(x) for x in _LIBRARIES]), (_k() % len(_LIBRARIES) + 1).cast("int"))
    weight = F.when(F.col("event_type") == "purchase", 3.0).when(F.col("event_type") == "click", 2.0).otherwise(1.0)
    sums = events.groupBy("user_id").agg(*[F.coalesce(F.sum(F.when(lib.isin(own), weight)), F.lit(0.0)).alias(c) for c, own in CATEGORIES.items()])
    most = F.greatest(*CATEGORIES)
    some = F.array_compact(F.array(*[F.when((F.col(c) > 0) & (F.col(c) >= 0.3 * most), F.lit(c)) for c in CATEGORIES]))
    rising = F.array(*[F.struct(F.lit(-t).alias("t"), F.lit(n).alias("n"), F.lit(c).alias("c")) for c, n, t in TRENDS])
    offers = F.transform(F.slice(F.array_sort(F.filter(rising, lambda x: F.array_contains(some, x["c"]))), 1, 5), lambda x: x["n"])
    fallback = F.array(*[F.lit(n) for n, _ in DEFAULTS[:5]])
    return sums.select("user_id", F.array_join(some, ",").alias("categories"), F.array_join(F.when(F.size(offers) > 0, offers).otherwise(fallback), ",").alias("offers"))


def _categories_sql() -> str:
    lib = f"[{', '.join(map(quote, _LIBRARIES))}][(json_extract_string(props, '$.k')::INT % {len(_LIBRARIES)} + 1)::INT]"
    sums = ", ".join(f"coalesce(sum(w) FILTER (lib IN ({', '.join(map(quote, own))})), 0) AS {c}_w" for c, own in CATEGORIES.items())
    some = f"list_filter([{', '.join(f'CASE WHEN {c}_w > 0 AND {c}_w >= 0.3::DOUBLE * greatest({chr(44).join(x + chr(95) + chr(119) for x in CATEGORIES)}) THEN {quote(c)} END' for c in CATEGORIES)}], lambda x: x IS NOT NULL)"
    rising = f"[{', '.join(f'row({-t}, {quote(n)}, {quote(c)})' for c, n, t in sorted(TRENDS, key=lambda r: (-r[2], r[1])))}]"
    fallback = ",".join(n for n, _ in DEFAULTS[:5])
    return f"""SELECT user_id, array_to_string(cats, ',') AS categories, CASE WHEN len(offers) > 0 THEN array_to_string(offers, ',') ELSE '{fallback}' END AS offers FROM (SELECT user_id, cats, list_transform(list_filter({rising}, lambda x: list_contains(cats, x[3]))[1:5], lambda x: x[2]) AS offers FROM (
      SELECT user_id, {some} AS cats FROM (SELECT user_id, {sums} FROM (SELECT user_id, CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'click' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, {lib} AS lib FROM events) GROUP BY user_id)))"""


def library_groups(docs: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", _cascade(low, GROUPS, "utility").alias("library_group"), _cascade(low, LIBRARY_KINDS, "other").alias("kind"))


def repository_complexity(lines: DataFrame) -> DataFrame:
    """(l_orderkey, complexity) of orders as lists of dependencies: how many, of how many kinds, any for development."""
    by = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("kinds"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("dev"))
    return by.select("l_orderkey", F.round(F.least(F.least(F.col("n") / 10, F.lit(1.0)) + (F.col("kinds") - 1) * 0.1 + F.col("dev") * 0.1, F.lit(1.0)), 6).alias("complexity"))


def search_queries(parts: DataFrame) -> DataFrame:
    """(p_partkey, query): what to search the web for, for a project of a name and perhaps a version."""
    name = F.col("p_name")
    major, minor = F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")
    say = lambda *x: F.concat_ws(" ", *[F.lit(v) if isinstance(v, str) else v for v in x])
    version = F.concat_ws(".", major, minor, F.lit("0"))
    known = F.array(say(name, version, "documentation"), say(name, version, "api reference"), say(name, F.concat_ws(".", major, minor), "documentation"), say(name, major, "documentation"), say(name, "documentation"))
    plain = F.array(*[say(name, x) for x in ("documentation", "api reference", "tutorial", "guide")])
    return parts.select("p_partkey", F.explode(F.array_distinct(F.when(F.col("p_partkey") % 2 == 0, known).otherwise(plain))).alias("query"))


def discovered_sources(parts: DataFrame) -> DataFrame:
    """(p_partkey, source, url): where a package may have documentation."""
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.concat(F.lit(a), name, F.lit(b)).alias("url")) for s, a, b in SOURCES])
    return parts.select("p_partkey", F.inline(rows))


SOURCES = [("github", "https://github.com/search?q=", ""), ("pypi", "https://pypi.org/project/", "/"), ("readthedocs", "https://", ".readthedocs.io/")]


def planned_tasks(orders: DataFrame, top: int = 100) -> DataFrame:
    """The queue's next tasks: by priority, then age."""
    return orders.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(top).select("o_orderkey", "o_orderpriority")


def review_split(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(decision, n, n_relevant): texts over fifty characters that pass by themselves, and those that someone has to look at."""
    low = F.lower("text")
    n_for = sum((F.contains(low, F.lit(t)).cast("int") for t in SECTION_FOR), F.lit(0))
    n_against = sum((F.contains(low, F.lit(t)).cast("int") for t in SECTION_AGAINST), F.lit(0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n_for - n_against + 5) / 10))
    by = docs.where(F.length("text") > 50).select(score.alias("s"))
    return by.groupBy(F.when(F.col("s") >= threshold, "auto").otherwise("manual").alias("decision")).agg(F.count("*").alias("n"), F.count_if(F.col("s") > 0.5).alias("n_relevant"))


def keyword_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, verdict, is_relevant, confidence, provider): what rules say of a text where no model answers, how sure they are, and which model would be asked."""
    low = F.lower(F.coalesce("text", F.lit("")))
    verdict = _cascade(low, [("legal", LEGAL), ("meta", META), ("documentation", CLEAR)], "unclear")
    sure = F.when(F.col("verdict") == "unclear", 0.5).otherwise(0.8) + F.when(F.col("source") == "src0", 0.2).when(F.col("source") == "src1", 0.1).otherwise(0.0)
    n = F.coalesce(F.length("text"), F.lit(0))
    provider = F.when((F.col("doc_id") % 2 == 0) & (n > 2000), "remote").otherwise("local")
    return docs.withColumn("verdict", verdict).select("doc_id", "verdict", (F.col("verdict") == "documentation").alias("is_relevant"), F.round(F.least(sure, F.lit(1.0)), 6).alias("confidence"), provider.alias("provider"))


_BODY = "# {name}\nwhat it is\n## Installation\npip install it\n### License of {name}\nfree\n## Notes {size}\nusage of the api with an example\n## Odd {size}\nbug and issue\nno heading:#x\n"


def section_docs(parts: DataFrame) -> DataFrame:
    text = F.replace(F.replace(F.lit(_BODY), F.lit("{name}"), F.col("p_name")), F.lit("{size}"), F.col("p_size").cast("string"))
    return parts.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, level, title, is_relevant): sections by headings; told by title, else by content."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)))
    line = Window.partitionBy("doc_id").orderBy("pos")
    numbered = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    by = numbered.groupBy("doc_id", "section").agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.regexp_replace("line", r"^#{1,6}\s+", ""))).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("body"))
    low, body = F.lower(F.coalesce("title", F.lit("introduction"))), F.lower("body")
    score = (sum((F.contains(body, F.lit(t)).cast("int") for t in SECTION_FOR), F.lit(0)) - sum((F.contains(body, F.lit(t)).cast("int") for t in SECTION_AGAINST), F.lit(0)) + 5) / 10
    relevant = F.when(any_of(low, OTHER_TITLES), False).when(any_of(low, DOC_TITLES), True).otherwise(score > 0.5)
    return by.select("doc_id", "section", "level", F.coalesce("title", F.lit("Introduction")).alias("title"), relevant.alias("is_relevant"))


def gaps(docs: DataFrame) -> DataFrame:
    """(doc_id, section, priority, effort, needs): essential sections that a text does not name."""
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = F.array(*[F.when(~F.contains(low, F.lit(s.split("_")[0])), F.struct(F.lit(s).alias("section"), F.lit(p).alias("priority"), F.lit(e).alias("effort"), F.lit(d).alias("needs"))) for s, _, p, e, d in ESSENTIAL])
    return docs.select("doc_id", F.inline(F.array_compact(rows)))


def fetched(pages: DataFrame) -> DataFrame:
    """(page_id, status, is_success, is_valid) of fetched pages: an empty one came without content."""
    blank = F.length(F.trim("html")) == 0
    return outcomes(pages, F.when(blank, 204), F.lit(None).cast("string"), F.col("html")).select("page_id", "status", "is_success", "is_valid")


def _t(name: str, f):
    return lambda s, d: f(spread(table(s, d, name)) if name == "documents" else table(s, d, name))


QUERIES = {
    "se_use_cases": _t("documents", use_cases),
    "se_detected_use_cases": _t("documents", detected_use_cases),
    "se_use_case_search": _t("documents", lambda t: use_case_search(t, "web server with a database")),
    "se_related_documents": _t("documents", lambda t: related_documents(t, 0)),
    "se_fuzzy_terms": _t("documents", lambda t: fuzzy_terms(t, "licence")),
    "se_highlights": _t("documents", lambda t: highlights(t, "License")),
    "se_filtered": _t("documents", lambda t: filtered(t, {"lang": "en"}, "n_chars", True, 10, 5).select("doc_id", "n_chars")),
    "se_query_checks": _t("conversations", checked_queries),
    "se_recent_queries": _t("events", recent_queries),
    "se_chunks": _t("documents", chunks),
    "se_basic_search": _t("documents", lambda t: basic_search(t, "license")),
    "se_references": lambda s, d: references(page_links(table(s, d, "pages"))),
    "se_statistics": _t("documents", corpus_statistics),
    "ve_breaking_changes": lambda s, d: breaking_changes(sample_docs(table(s, d, "part")), second_versions(sample_docs(table(s, d, "part")))),
    "ve_version_graph": _t("orders", version_graph),
    "an_query_lengths": _t("conversations", query_lengths),
    "an_filter_usage": _t("events", filter_usage),
    "an_click_positions": _t("events", click_positions),
    "an_most_viewed": _t("events", lambda t: most_interacted(t, "view")),
    "an_performance_scores": _t("events", performance_scores),
    "an_kept_metrics": _t("events", kept_metrics),
    "an_error_categories": _t("events", error_categories),
    "re_liked_by_similar": _t("events", lambda t: liked_by_similar(t.select("user_id", F.concat_ws(":", "event_type", (_k() % 10).cast("string")).alias("item")), 1)),
    "re_user_categories": _t("events", categories_of_users),
    "dg_library_groups": _t("documents", library_groups),
    "dg_complexity": _t("lineitem", repository_complexity),
    "cr_search_queries": _t("part", search_queries),
    "cr_discovered_sources": _t("part", discovered_sources),
    "cr_planned_tasks": _t("orders", planned_tasks),
    "cr_review_split": _t("documents", review_split),
    "tx_keyword_verdicts": _t("documents", keyword_verdicts),
    "tx_markdown_sections": lambda s, d: markdown_sections(section_docs(table(s, d, "part"))),
    "tx_gaps": _t("documents", gaps),
    "io_fetched": _t("pages", fetched),
}
_SEARCHED = [w for k, own in USE_CASES.items() for w in own * (any(x in "web server with a database" for x in own) + (k in "web server with a database"))]
_NEW = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '(?m)^.*\\b(def|class) .*\\n', '', 'g') ELSE text END AS text FROM " + _DOCS + " WHERE doc_id % 7 <> 0)"
_SECTION_ROWS = "(1, 1, p_name, false), (2, 2, 'Installation', true), (3, 3, 'License of ' || p_name, false), (4, 2, 'Notes ' || p_size, true), (5, 2, 'Odd ' || p_size, false)"
ORACLE = {
    "se_use_cases": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, use_case) AS rank FROM {_CASES} WHERE score > 0) WHERE rank <= 3",
    "se_detected_use_cases": "SELECT doc_id, CASE WHEN t IS NULL THEN '' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN {' + '.join(f'contains(t, {quote(w)})::INT' for w in words)} >= 2 THEN {quote(k)} END" for k, words in USE_CASES.items()) + ") END AS use_cases FROM (SELECT doc_id, lower(text) AS t FROM documents)",
    "se_use_case_search": f"SELECT * FROM (SELECT doc_id, round({_sql_word_score('t', _SEARCHED)}, 6) AS score FROM (SELECT doc_id, {_ASCII} AS t FROM documents)) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "se_related_documents": f"WITH t AS (SELECT doc_id, list_distinct(ts) AS ts FROM {_TOKENS_SQL}), q AS (SELECT ts AS asked FROM t WHERE doc_id = 0) SELECT * FROM (SELECT doc_id, round(len(list_intersect(ts, asked)) / (len(ts) + len(asked) - len(list_intersect(ts, asked))), 6) AS similarity FROM t, q WHERE doc_id <> 0) WHERE similarity >= 0.3",
    "se_fuzzy_terms": f"SELECT term, n, levenshtein(term, 'licence')::INT AS edits FROM (SELECT term, count(*) AS n FROM (SELECT unnest(ts) AS term FROM {_TOKENS_SQL}) GROUP BY term) WHERE levenshtein(term, 'licence') <= 2",
    "se_highlights": "SELECT doc_id, replace(CASE WHEN a > 1 THEN '...' ELSE '' END || substr(text, a, b - a + 1) || CASE WHEN b < length(text) THEN '...' ELSE '' END, w, '<mark>' || w || '</mark>') AS highlight FROM (SELECT *, greatest(p - 20, 1) AS a, least(p + 26, length(text)) AS b, substr(text, p, 7) AS w FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents)) WHERE p > 0",
    "se_filtered": "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC NULLS FIRST, doc_id LIMIT 10 OFFSET 5",
    "se_query_checks": "SELECT conv_id, turn, error, error IS NULL AS is_valid FROM (SELECT *, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 500 THEN 'too long' WHEN length(text) < 3 THEN 'too short' END AS error FROM conversations)",
    "se_recent_queries": "SELECT query, event_id FROM (SELECT user_id || ' ' || event_type AS query, max(ts) AS ts, arg_max(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY 1) ORDER BY ts DESC, event_id DESC LIMIT 50",
    "se_chunks": "SELECT doc_id, (generate_subscripts(cs, 1) - 1)::INT AS pos, unnest(cs) AS chunk FROM (SELECT doc_id, [text] || list_transform(list_filter(ls[2:], lambda x: length(trim(x)) > 0), lambda x: ls[1] || '. ' || x) AS cs FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))",
    "se_basic_search": r"SELECT * FROM (SELECT doc_id, round(least(10 * len(regexp_extract_all(lower(text), 'license')) / greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 0)), 1), 1.0), 6)::DOUBLE AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "se_references": f"SELECT page_id, count(*) FILTER (contains(target, host)) AS n_internal, count(*) FILTER (NOT contains(target, host)) AS n_external FROM (SELECT page_id, regexp_replace(target, '#.*', '') AS target, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM {_RESOLVED}) WHERE starts_with(target, 'http') GROUP BY page_id",
    "se_statistics": "SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, max(length(text))::INT AS longest FROM documents",
    "ve_breaking_changes": rf"""SELECT doc_id, 'removed_page' AS kind, NULL AS line FROM {_DOCS} WHERE doc_id % 7 = 0 UNION ALL SELECT * FROM (SELECT doc_id, CASE WHEN regexp_matches(line, 'def\s+\w+|class\s+\w+|function\s+\w+|method\s+\w+') THEN 'removed_api' WHEN contains(lower(line), 'deprecated') THEN 'deprecation' WHEN contains(lower(line), 'break') THEN 'explicit_breaking' END AS kind, line
      FROM (SELECT o.doc_id, unnest(list_distinct(list_filter(string_split(o.text, chr(10)), lambda x: NOT list_contains(string_split(n.text, chr(10)), x)))) AS line FROM {_DOCS} o JOIN {_NEW} n USING (doc_id))) WHERE kind IS NOT NULL""",
    "ve_version_graph": "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS next, date_diff('day', o_orderdate::DATE, (lead(o_orderdate) OVER w)::DATE)::INT AS days, lead(o_orderkey) OVER w IS NULL AS is_latest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "an_query_lengths": r"SELECT round(avg(n), 4) AS mean, min(n)::INT AS low, max(n)::INT AS high, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n > 1) AS n_multi FROM (SELECT len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: length(x) > 0)) AS n FROM conversations WHERE role = 'user' AND text IS NOT NULL)",
    "an_filter_usage": "SELECT key, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM events), 4) AS share FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key ORDER BY n DESC, key LIMIT 5",
    "an_click_positions": "SELECT count(*) AS n, round(avg(json_extract_string(props, '$.k')::INT), 6) AS position FROM events WHERE event_type = 'click'",
    "an_most_viewed": "SELECT user_id, count(*) AS n, round(coalesce(avg(value), 0), 4) AS rating FROM events WHERE event_type = 'view' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5",
    "an_performance_scores": "SELECT user_id, event_type, round(0.4::DOUBLE * greatest(1 - avg(value) / 100 / 5, 0) + 0.3::DOUBLE * greatest(1 - avg(k * 4) / 200, 0) + 0.2::DOUBLE * greatest(1 - avg(k / 2) / 50, 0) + 0.1::DOUBLE * avg((value < 400)::INT), 6) AS score FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY ALL",
    "an_kept_metrics": f"SELECT event_type, count(*) AS calls, count(*) FILTER (value > 400) AS errors, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY GROUP BY event_type",
    "an_error_categories": _errors_sql(),
    "re_liked_by_similar": f"WITH p AS (SELECT * FROM {_ITEMS}), o AS (SELECT item FROM p WHERE user_id = 1), a AS (SELECT p.user_id, count(o.item) AS both_n, count(*) AS theirs FROM p LEFT JOIN o USING (item) WHERE p.user_id <> 1 GROUP BY 1), b AS (SELECT user_id, both_n / ((SELECT count(*) FROM o) + theirs - both_n) AS s FROM a WHERE both_n / ((SELECT count(*) FROM o) + theirs - both_n) > 0.2 ORDER BY s DESC, user_id LIMIT 5) SELECT item, round(sum(s), 6) AS score FROM p JOIN b USING (user_id) WHERE item NOT IN (SELECT item FROM o) GROUP BY item ORDER BY score DESC, item LIMIT 10",
    "re_user_categories": _categories_sql(),
    "dg_library_groups": f"SELECT doc_id, {_sql_cascade('t', GROUPS, 'utility')} AS library_group, {_sql_cascade('t', LIBRARY_KINDS, 'other')} AS kind FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)",
    "dg_complexity": "SELECT l_orderkey, round(least(least(count(*) / 10, 1.0) + (count(DISTINCT l_returnflag) - 1) * 0.1::DOUBLE + max((l_linestatus = 'O')::INT) * 0.1::DOUBLE, 1.0), 6) AS complexity FROM lineitem GROUP BY l_orderkey",
    "cr_search_queries": "SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN [p_name || ' ' || p_size || '.' || (p_partkey % 7) || '.0 documentation', p_name || ' ' || p_size || '.' || (p_partkey % 7) || '.0 api reference', p_name || ' ' || p_size || '.' || (p_partkey % 7) || ' documentation', p_name || ' ' || p_size || ' documentation', p_name || ' documentation'] ELSE [p_name || ' documentation', p_name || ' api reference', p_name || ' tutorial', p_name || ' guide'] END) AS query FROM part",
    "cr_discovered_sources": f"SELECT p_partkey, source, a || replace(p_name, ' ', '-') || b AS url FROM part CROSS JOIN (VALUES {', '.join(f'({quote(s)}, {quote(a)}, {quote(b)})' for s, a, b in SOURCES)}) AS v(source, a, b)",
    "cr_planned_tasks": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100",
    "cr_review_split": "SELECT CASE WHEN s >= 0.6 THEN 'auto' ELSE 'manual' END AS decision, count(*) AS n, count(*) FILTER (s > 0.5) AS n_relevant FROM (SELECT greatest(0.0, least(1.0, (" + " + ".join(f"contains(t, {quote(x)})::INT" for x in SECTION_FOR) + " - (" + " + ".join(f"contains(t, {quote(x)})::INT" for x in SECTION_AGAINST) + ") + 5) / 10)) AS s FROM (SELECT lower(text) AS t FROM documents WHERE length(text) > 50)) GROUP BY 1",
    "tx_keyword_verdicts": f"SELECT doc_id, verdict, verdict = 'documentation' AS is_relevant, round(least(CASE verdict WHEN 'unclear' THEN 0.5 ELSE 0.8 END::DOUBLE + CASE source WHEN 'src0' THEN 0.2 WHEN 'src1' THEN 0.1 ELSE 0 END, 1.0), 6) AS confidence, CASE WHEN doc_id % 2 = 0 AND length(text) > 2000 THEN 'remote' ELSE 'local' END AS provider FROM (SELECT *, {_sql_cascade('lower(coalesce(text, ' + chr(39) * 2 + '))', [('legal', LEGAL), ('meta', META), ('documentation', CLEAR)], 'unclear')} AS verdict FROM documents)",
    "tx_markdown_sections": f"SELECT p_partkey AS doc_id, v.section::BIGINT AS section, v.level AS level, v.title AS title, v.is_relevant AS is_relevant FROM part, LATERAL (VALUES {_SECTION_ROWS}) AS v(section, level, title, is_relevant)",
    "tx_gaps": f"SELECT doc_id, section, priority, effort, needs FROM documents CROSS JOIN (VALUES {', '.join(f'({quote(s)}, {quote(s.split(chr(95))[0])}, {quote(p)}, {quote(e)}, {quote(n)})' for s, _, p, e, n in ESSENTIAL)}) AS v(section, mark, priority, effort, needs) WHERE NOT contains(lower(coalesce(text, '')), mark)",
    "io_fetched": "SELECT page_id, status, coalesce(status < 300, false) AS is_success, coalesce(status = 200, false) AS is_valid FROM (SELECT page_id, CASE WHEN html IS NULL THEN NULL WHEN length(trim(html)) = 0 THEN 204 ELSE 200 END AS status FROM pages)",
}
