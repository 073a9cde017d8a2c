"""Scoring and classifying texts by rules: relevance, difficulty, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import any_of, clamp, guarded_like, guarded_matches, guarded_occurrences, present, sql_any, sql_matches, sql_occurrences, sql_present
from ..sources.tables import spread, table

# Weighted patterns of documentation and of other project text.
WEIGHTS = {"strong_indicators": 3, "medium_indicators": 2, "weak_indicators": 1}
DOCUMENTATION = {
    "strong_indicators": [
        r"\b(?:api|documentation|docs?)\b",
        r"\b(?:installation|install|setup)\b",
        r"\b(?:tutorial|guide|getting started)\b",
        r"\b(?:example|usage|how to)\b",
        r"\b(?:configuration|config|parameters)\b",
        r"```[\s\S]*?```",
        r"\bimport\s+\w+",
        r"\bpip install\b|\bnpm install\b",
    ],
    "medium_indicators": [
        r"\b(?:function|method|class|module)\b",
        r"\b(?:parameter|argument|option|setting)\b",
        r"\b(?:return|returns|output)\b",
        r"\b(?:description|overview|introduction)\b",
        r"\b(?:feature|functionality|capability)\b",
    ],
    "weak_indicators": [
        r"\b(?:library|package|framework|tool)\b",
        r"\b(?:version|release|update)\b",
        r"\b(?:support|help|assistance)\b",
    ],
}
OTHER = {
    "strong_indicators": [
        r"\b(?:pull request|merge request|pr #|mr #)\b",
        r"\b(?:issue #|bug report|feature request)\b",
        r"\b(?:contributing|code of conduct|license)\b",
        r"\b(?:changelog|release notes|version history)\b",
        r"\b(?:build|ci/cd|continuous integration)\b",
        r"\b(?:test|testing|unit test|integration test)\b",
        r"\bassignee:|reviewer:|milestone:|labels:",
        r"\b(?:reproduction steps|expected behavior|actual behavior)\b",
    ],
    "medium_indicators": [
        r"\b(?:development|dev environment|local setup)\b",
        r"\b(?:workflow|pipeline|automation)\b",
        r"\b(?:coverage|quality|metrics)\b",
        r"\b(?:deployment|production|staging)\b",
    ],
    "weak_indicators": [
        r"\b(?:commit|branch|fork|clone)\b",
        r"\b(?:repository|repo|github|gitlab)\b",
        r"\b(?:maintainer|contributor|author)\b",
    ],
}
# Substrings that speak for and against documentation.
FOR_DOCS = ["installation", "getting started", "quick start", "tutorial", "guide", "documentation", "api reference", "examples", "usage", "how to", "configuration", "parameters", "options", "methods", "functions", "import", "install", "pip install", "npm install", "requirements", "example:", "for example", "code example", "```", "syntax", "description", "overview", "introduction", "features"]
AGAINST_DOCS = ["pull request", "merge request", "issue #", "bug report", "feature request", "contributing", "code of conduct", "license", "changelog", "release notes", "build status", "ci/cd", "travis", "github actions", "workflow", "test suite", "unit test", "integration test", "coverage", "development setup", "dev environment", "local development", "reproduction steps", "expected behavior", "actual behavior", "assignee:", "reviewer:", "milestone:", "labels:", "projects:"]
# Terms of a section's body.
SECTION_FOR = ["install", "usage", "example", "api", "function", "method", "parameter", "return", "import", "configuration", "option"]
SECTION_AGAINST = ["contribute", "pull request", "issue", "bug", "license", "copyright", "author", "maintainer", "build", "test"]
# Levels of difficulty.
LEVELS = {
    "beginner": (
        ["introduction", "getting started", "quick start", "tutorial", "basics", "simple", "easy", "first", "hello world", "install", "setup", "beginner", "start", "guide", "overview", "what is", "how to"],
        ["step by step", "for beginners", "getting started", "first time", "new to", "introduction to", "basic usage", "simple example"],
        [r"\bstep \d+\b", r"\bfirst\b.*\btime\b", r"\bbasic\b.*\bexample\b"],
    ),
    "intermediate": (
        ["configuration", "customize", "options", "parameters", "features", "integration", "middleware", "plugin", "extension", "api", "methods", "functions", "classes", "modules", "framework"],
        ["advanced features", "configuration options", "api reference", "method parameters", "custom implementation", "integration guide"],
        [r"\bapi\b.*\breference\b", r"\bconfigur\w+\b", r"\bparameter\w*\b"],
    ),
    "advanced": (
        ["architecture", "internals", "performance", "optimization", "scaling", "advanced", "expert", "complex", "sophisticated", "enterprise", "production", "deployment", "security", "threading", "async", "concurrency", "distributed", "microservices", "algorithms"],
        ["advanced topics", "expert level", "production deployment", "performance optimization", "architectural patterns", "best practices", "enterprise features", "complex scenarios"],
        [r"\badvanced\b.*\btopic\w*\b", r"\bperformance\b.*\boptimiz\w+\b", r"\bproduction\b.*\bready\b"],
    ),
}
COMPLEXITY = {
    3: ["algorithm", "complexity", "big o", "optimization", "performance", "memory", "cpu", "threading", "multiprocessing", "async", "await", "decorator", "metaclass", "inheritance", "polymorphism", "abstraction"],
    2: ["class", "function", "method", "object", "instance", "attribute", "parameter", "argument", "return", "exception", "error", "debug"],
    1: ["print", "input", "variable", "string", "number", "list", "dictionary", "if", "else", "for", "while", "import", "from"],
}
# Sections of complete documentation and what speaks for them.
SECTIONS = {"installation": "install", "usage": "usage", "api": "api", "examples": "example", "configuration": "config", "troubleshooting": "troubleshoot", "license": "license"}


def pattern_score(text: Column, patterns: dict[str, list[str]]) -> Column:
    return sum((guarded_matches(text, p) * WEIGHTS[level] for level, ps in patterns.items() for p in ps), F.lit(0))


def _sql_pattern_score(text: str, patterns: dict[str, list[str]]) -> str:
    return "(" + " + ".join(f"{sql_matches(text, p)} * {WEIGHTS[level]}" for level, ps in patterns.items() for p in ps) + ")::BIGINT"


#: RE2 takes only ASCII for word characters: for it, Latin letters beyond ASCII become one that is.
_ASCII = "regexp_replace(lower(text), '[À-ÖØ-öø-ÿĀ-ɏ]', 'z', 'g')"


def rule_relevance(docs: DataFrame, *keep: str) -> DataFrame:
    """Weighted pattern counts for and against documentation, brought to 0..1; texts under 20 characters score 0; with the columns to keep."""
    # Lower case is made once, in a step of its own.
    low = F.col("__low")
    long = F.length(F.trim(F.coalesce("text", F.lit("")))) >= 20
    scored = docs.select("doc_id", *keep, long.alias("long"), F.lower("text").alias("__low")).select("doc_id", *keep, "long", F.coalesce(pattern_score(low, DOCUMENTATION), F.lit(0)).cast("long").alias("doc_score"), F.coalesce(pattern_score(low, OTHER), F.lit(0)).cast("long").alias("non_doc_score"))
    score = F.when(F.col("long"), clamp((F.col("doc_score") - F.col("non_doc_score") + 5) / 10, 0.0, 1.0)).otherwise(0.0)
    return scored.select("doc_id", *keep, "doc_score", "non_doc_score", score.alias("score"), (score > 0.5).alias("is_relevant"))


_RELEVANCE_SQL = f"""SELECT doc_id, doc_score, non_doc_score, CASE WHEN long THEN greatest(0.0, least(1.0, (doc_score - non_doc_score + 5) / 10))::DOUBLE ELSE 0.0 END AS score,
  CASE WHEN long THEN greatest(0.0, least(1.0, (doc_score - non_doc_score + 5) / 10))::DOUBLE ELSE 0.0 END > 0.5 AS is_relevant
FROM (SELECT doc_id, length(trim(text)) >= 20 AS long, {_sql_pattern_score(_ASCII, DOCUMENTATION)} AS doc_score, {_sql_pattern_score(_ASCII, OTHER)} AS non_doc_score FROM documents)"""


def matched_patterns(docs: DataFrame) -> DataFrame:
    """Numbers of the patterns that match, documentation first."""
    # Lower case is made once, in a step of its own; a pattern runs only where a plain string of it is there.
    low = F.col("__low")
    all_patterns = [p for group in (DOCUMENTATION, OTHER) for ps in group.values() for p in ps]
    hits = F.array(*[F.when(guarded_like(low, p), F.lit(str(i))) for i, p in enumerate(all_patterns)])
    return docs.select("doc_id", F.lower("text").alias("__low")).select("doc_id", F.array_join(F.array_compact(hits), ",").alias("matched"))


def _matched_sql() -> str:
    all_patterns = [p for group in (DOCUMENTATION, OTHER) for ps in group.values() for p in ps]
    return "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({_ASCII}, '{p}') THEN '{i}' END" for i, p in enumerate(all_patterns)) + ") AS matched FROM documents"


def indicator_counts(docs: DataFrame) -> DataFrame:
    low = F.lower("text")
    return docs.select("doc_id", present(low, FOR_DOCS).alias("n_for"), present(low, AGAINST_DOCS).alias("n_against"))


def section_score(docs: DataFrame) -> DataFrame:
    low = F.lower("text")
    return docs.select("doc_id", clamp((present(low, SECTION_FOR) - present(low, SECTION_AGAINST) + 5) / 10, 0.0, 1.0).alias("score"))


def relevance_cascade(docs: DataFrame) -> DataFrame:
    """The first rule that holds gives the score; without one, the pattern score."""
    docs = docs.select("doc_id", "text", F.lower("text").alias("__low"))
    low = F.col("__low")
    has = lambda *t: any_of(low, t)
    rules = F.when(has("documentation"), 0.9).when(has("installation", "getting started"), 0.8).when(has("example") & has("tutorial"), 0.85).when(has("contributing", "pull request"), 0.2).when(has("license"), 0.1).when(has("issue") & has("bug"), 0.15).when(has("changelog", "release"), 0.3)
    score = clamp((pattern_score(low, DOCUMENTATION) - pattern_score(low, OTHER) + 5) / 10, 0.0, 1.0)
    return docs.select("doc_id", rules.otherwise(F.when(F.length(F.trim("text")) >= 20, score).otherwise(0.0)).alias("score"))


_CASCADE_SQL = f"""SELECT doc_id, (CASE WHEN contains(t, 'documentation') THEN 0.9 WHEN {sql_any("t", ["installation", "getting started"])} THEN 0.8
  WHEN contains(t, 'example') AND contains(t, 'tutorial') THEN 0.85 WHEN {sql_any("t", ["contributing", "pull request"])} THEN 0.2
  WHEN contains(t, 'license') THEN 0.1 WHEN contains(t, 'issue') AND contains(t, 'bug') THEN 0.15 WHEN {sql_any("t", ["changelog", "release"])} THEN 0.3
  WHEN length(trim(text)) >= 20 THEN greatest(0.0, least(1.0, ({_sql_pattern_score("t", DOCUMENTATION)} - {_sql_pattern_score("t", OTHER)} + 5) / 10)) ELSE 0.0 END)::DOUBLE AS score
FROM (SELECT *, {_ASCII} AS t FROM documents)"""


def optimal_threshold(docs: DataFrame) -> DataFrame:
    """Median pattern score of each source, kept between 0.3 and 0.9."""
    scored = rule_relevance(docs, "source")
    return scored.groupBy("source").agg(clamp(F.median("score"), 0.3, 0.9).alias("threshold"))


def method_accuracy(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Confusion counts and accuracy of the rules against labelled quality."""
    met = rule_relevance(docs).join(labels.select("doc_id", "quality"), "doc_id")
    hit = F.col("is_relevant")
    good = F.col("quality") == 1
    return met.agg(F.count_if(hit & good).alias("tp"), F.count_if(hit & ~good).alias("fp"), F.count_if(~hit & good).alias("fn"), F.count_if(~hit & ~good).alias("tn"), F.round(F.avg((hit == good).cast("int")), 6).alias("accuracy"))


def _level_score(text: Column, level: str) -> Column:
    words, phrases, patterns = LEVELS[level]
    total = sum((guarded_occurrences(text, w) for w in words), F.lit(0)) * 1.0 + sum((guarded_occurrences(text, p) for p in phrases), F.lit(0)) * 2.0 + sum((guarded_matches(text, p) for p in patterns), F.lit(0)) * 1.5
    return F.when(F.length(text) > 0, total / (F.length(text) / 1000)).otherwise(0.0)


def _sql_level_score(text: str, level: str) -> str:
    words, phrases, patterns = LEVELS[level]
    parts = [" + ".join(sql_occurrences(text, w) for w in words), " + ".join(sql_occurrences(text, p) for p in phrases), " + ".join(sql_matches(text, p) for p in patterns)]
    return f"CASE WHEN length({text}) > 0 THEN (({parts[0]}) * 1.0::DOUBLE + ({parts[1]}) * 2.0::DOUBLE + ({parts[2]}) * 1.5::DOUBLE) / (length({text}) / 1000::DOUBLE) ELSE 0.0 END"


def difficulty(docs: DataFrame) -> DataFrame:
    """The level of the highest score after complexity and length; the easier one on ties."""
    docs = docs.select("doc_id", "text", F.lower("text").alias("__low"))
    low = F.col("__low")
    h, m, n = (present(low, COMPLEXITY[k]) for k in (3, 2, 1))
    base = docs.select("doc_id", F.length("text").alias("len"), h.alias("h"), m.alias("m"), n.alias("l"), *[_level_score(low, x).alias(x) for x in LEVELS])
    total = F.col("h") + F.col("m") + F.col("l")
    complexity = F.when(total == 0, 0.0).otherwise(F.least((F.col("h") * 3 + F.col("m") * 2 + F.col("l")) / total / 3, F.lit(1.0)))
    s = base.withColumn("complexity", complexity)
    s = s.select("doc_id", "complexity", (F.col("beginner") + F.when(F.col("complexity") > 0.4, 0.0).otherwise(1.0)).alias("b"), (F.col("intermediate") + F.when((F.col("complexity") > 0.4) & (F.col("complexity") <= 0.7), 1.0).otherwise(0.0)).alias("i"), (F.col("advanced") + F.when(F.col("complexity") > 0.7, 2.0).otherwise(0.0) + F.least(F.col("len") / 5000, F.lit(1.0)) * 0.5).alias("a"))
    level = F.when((F.col("b") >= F.col("i")) & (F.col("b") >= F.col("a")), "beginner").when(F.col("i") >= F.col("a"), "intermediate").otherwise("advanced")
    return s.select("doc_id", F.round("complexity", 6).alias("complexity"), level.alias("level"))


_DIFFICULTY_SQL = f"""WITH s AS (SELECT doc_id, length(text) AS len, {sql_present("t", COMPLEXITY[3])} AS h, {sql_present("t", COMPLEXITY[2])} AS m, {sql_present("t", COMPLEXITY[1])} AS l,
  {", ".join(f"{_sql_level_score('t', x)} AS {x}" for x in LEVELS)} FROM (SELECT doc_id, text, lower(text) AS t FROM documents)),
c AS (SELECT *, CASE WHEN h + m + l = 0 THEN 0.0 ELSE least((h * 3 + m * 2 + l) / (h + m + l) / 3, 1.0) END::DOUBLE AS complexity FROM s),
d AS (SELECT doc_id, complexity, beginner + CASE WHEN complexity > 0.4 THEN 0.0 ELSE 1.0 END AS b, intermediate + CASE WHEN complexity > 0.4 AND complexity <= 0.7 THEN 1.0 ELSE 0.0 END AS i,
  advanced + CASE WHEN complexity > 0.7 THEN 2.0 ELSE 0.0 END + least(len / 5000, 1.0) * 0.5 AS a FROM c)
SELECT doc_id, round(complexity, 6) AS complexity, CASE WHEN b >= i AND b >= a THEN 'beginner' WHEN i >= a THEN 'intermediate' ELSE 'advanced' END AS level FROM d"""

# Marks of programming languages, in the order they are tried.
LANGUAGE_MARKS = (("python", ["import ", "def ", "class ", "print(", "if __name__", "elif ", "from "]), ("javascript", ["function ", "var ", "let ", "const ", "console.log", "=>", "require("]), ("bash", ["#!/bin/bash", "echo ", "cd ", "ls ", "grep ", "awk ", "sed "]))
SQL_MARKS = ["select ", "from ", "where ", "insert ", "update ", "delete "]


def code_language(code: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, marks in LANGUAGE_MARKS:
        out = out.when(any_of(code, marks), name)
    return out.when(any_of(F.lower(code), SQL_MARKS), "sql").otherwise("unknown")


def languages_of(docs: DataFrame) -> DataFrame:
    kind = F.when(F.contains("text", F.lit("def ")), "Function definition example").when(F.contains("text", F.lit("class ")), "Class definition example").when(F.contains("text", F.lit("print(")), "Basic output example").when(any_of(F.col("text"), ["for ", "while "]), "Loop example").when(F.contains("text", F.lit("if ")), "Conditional logic example").otherwise("code example")
    return docs.select("doc_id", code_language(F.col("text")).alias("language"), kind.alias("kind"))


_LANGUAGE_SQL = "SELECT doc_id, CASE " + " ".join(f"WHEN {sql_any('text', marks)} THEN '{name}'" for name, marks in LANGUAGE_MARKS) + f""" WHEN {sql_any("lower(text)", SQL_MARKS)} THEN 'sql' ELSE 'unknown' END AS language,
CASE WHEN contains(text, 'def ') THEN 'Function definition example' WHEN contains(text, 'class ') THEN 'Class definition example' WHEN contains(text, 'print(') THEN 'Basic output example' WHEN {sql_any("text", ["for ", "while "])} THEN 'Loop example' WHEN contains(text, 'if ') THEN 'Conditional logic example' ELSE 'code example' END AS kind FROM documents"""

# Words without topics of their own.
STOP = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "this", "that", "these", "those", "it", "its", "they", "them", "their"]


def topic_words(docs: DataFrame, top: int = 20) -> DataFrame:
    """Lower case, letters only, no stop words; the most frequent words of each language."""
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\s]+", "")
    words = docs.select("lang", F.explode(F.split(plain, r"\s+")).alias("word")).where((F.length("word") > 0) & ~F.col("word").isin(STOP))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")))
    return ranked.where(F.col("rank") <= top).select("lang", "word", "n", F.col("rank").cast("long").alias("rank"))


_TOPIC_SQL = rf"""SELECT lang, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\s]+', '', 'g'), '\s+')) AS word FROM documents)
  WHERE length(word) > 0 AND word NOT IN ({", ".join(f"'{w}'" for w in STOP)}) GROUP BY ALL)) WHERE rank <= 20"""


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length, whatever the case; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longer)


def name_similarity(nations: DataFrame) -> DataFrame:
    """Pairs of a small dimension's names; regions limit the pairs."""
    a, b = nations.alias("a"), nations.alias("b")
    met = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return met.select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"), F.round(similarity(F.col("a.n_name"), F.col("b.n_name")), 6).alias("similarity"))


def checksums(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.substring(F.sha2(F.concat_ws(":", "source", "text"), 256), 1, 16).alias("document_key"))


def line_sections(docs: DataFrame) -> DataFrame:
    """Texts cut at short lines without a full stop (headings): lines and characters of each section."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heading = (F.length("line") < 40) & (F.length("line") > 0)
    numbered = lines.withColumn("section", F.sum(heading.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


_SECTIONS_SQL = """SELECT doc_id, section, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (
  SELECT doc_id, line, (sum((length(line) < 40 AND length(line) > 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS section FROM (
    SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) GROUP BY ALL"""


def completeness(docs: DataFrame) -> DataFrame:
    """Which sections of complete documentation a text names, and what share is missing."""
    low = F.lower("text")
    there = F.array_compact(F.array(*[F.when(F.regexp_like(low, F.lit(rf"\b{p}")), F.lit(s)) for s, p in SECTIONS.items()]))
    return docs.select("doc_id", F.array_join(there, ",").alias("sections"), F.size(there).alias("n_sections"), F.round(1 - F.size(there) / len(SECTIONS), 6).alias("missing"))


_COMPLETE_SQL = "SELECT doc_id, concat_ws(',', " + ", ".join(rf"CASE WHEN regexp_matches(t, '\b{p}') THEN '{s}' END" for s, p in SECTIONS.items()) + ") AS sections, n::INT AS n_sections, round(1 - n / 7, 6) AS missing FROM (SELECT *, " + " + ".join(rf"regexp_matches(t, '\b{p}')::INT" for p in SECTIONS.values()) + " AS n FROM (SELECT doc_id, lower(text) AS t FROM documents))"


def versions_in(pages: DataFrame) -> DataFrame:
    """First dotted version in a text, if any, and its cleaned three parts."""
    found = F.regexp_extract("p_name", r"(\d+\.\d+\.\d+)", 1)
    return pages.select("p_partkey", F.nullif(found, F.lit("")).alias("version"))


def distinct_tokens(docs: DataFrame) -> DataFrame:
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return docs.select("doc_id", F.size(tokens).alias("n_tokens"), F.array_min(tokens).alias("first_token"))


def batch_summary(docs: DataFrame) -> DataFrame:
    """Share of relevant texts of each source, and what to do about it."""
    scored = rule_relevance(docs, "source")
    by = scored.groupBy("source").agg(F.count("*").alias("total"), F.count_if("is_relevant").alias("relevant"))
    rate = F.col("relevant") / F.col("total")
    return by.select("source", "total", "relevant", F.when(rate > 0.8, "good").when(rate > 0.5, "review").otherwise("filter").alias("advice"))


def _docs(s, d: str) -> DataFrame:
    return spread(table(s, d, "documents"))


QUERIES = {
    "tx_rule_relevance": lambda s, d: rule_relevance(_docs(s, d)),
    "tx_matched_patterns": lambda s, d: matched_patterns(_docs(s, d)),
    "tx_indicator_counts": lambda s, d: indicator_counts(_docs(s, d)),
    "tx_section_score": lambda s, d: section_score(_docs(s, d)),
    "tx_relevance_cascade": lambda s, d: relevance_cascade(_docs(s, d)),
    "tx_optimal_threshold": lambda s, d: optimal_threshold(_docs(s, d)),
    "tx_method_accuracy": lambda s, d: method_accuracy(_docs(s, d), table(s, d, "labels")),
    "tx_difficulty": lambda s, d: difficulty(_docs(s, d)),
    "tx_code_language": lambda s, d: languages_of(_docs(s, d)),
    "tx_topic_words": lambda s, d: topic_words(_docs(s, d)),
    "tx_name_similarity": lambda s, d: name_similarity(table(s, d, "nation")),
    "tx_checksums": lambda s, d: checksums(_docs(s, d)),
    "tx_line_sections": lambda s, d: line_sections(_docs(s, d)),
    "tx_completeness": lambda s, d: completeness(_docs(s, d)),
    "tx_versions": lambda s, d: versions_in(table(s, d, "part")),
    "tx_distinct_tokens": lambda s, d: distinct_tokens(_docs(s, d)),
    "tx_batch_summary": lambda s, d: batch_summary(_docs(s, d)),
}
ORACLE = {
    "tx_rule_relevance": _RELEVANCE_SQL,
    "tx_matched_patterns": _matched_sql(),
    "tx_indicator_counts": f"SELECT doc_id, {sql_present('lower(text)', FOR_DOCS)} AS n_for, {sql_present('lower(text)', AGAINST_DOCS)} AS n_against FROM documents",
    "tx_section_score": f"SELECT doc_id, greatest(0.0, least(1.0, ({sql_present('lower(text)', SECTION_FOR)} - {sql_present('lower(text)', SECTION_AGAINST)} + 5) / 10))::DOUBLE AS score FROM documents",
    "tx_relevance_cascade": _CASCADE_SQL,
    "tx_optimal_threshold": f"SELECT source, greatest(0.3, least(0.9, median(score)))::DOUBLE AS threshold FROM ({_RELEVANCE_SQL}) JOIN documents USING (doc_id) GROUP BY source",
    "tx_method_accuracy": f"SELECT count(*) FILTER (is_relevant AND quality = 1) AS tp, count(*) FILTER (is_relevant AND quality <> 1) AS fp, count(*) FILTER (NOT is_relevant AND quality = 1) AS fn, count(*) FILTER (NOT is_relevant AND quality <> 1) AS tn, round(avg((is_relevant = (quality = 1))::INT), 6) AS accuracy FROM ({_RELEVANCE_SQL}) JOIN labels USING (doc_id)",
    "tx_difficulty": _DIFFICULTY_SQL,
    "tx_code_language": _LANGUAGE_SQL,
    "tx_topic_words": _TOPIC_SQL,
    "tx_name_similarity": "SELECT a.n_name AS left_name, b.n_name AS right_name, round(1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(length(a.n_name), length(b.n_name)), 6) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "tx_checksums": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, substr(sha256(source || ':' || text), 1, 16) AS document_key FROM documents",
    "tx_line_sections": _SECTIONS_SQL,
    "tx_completeness": _COMPLETE_SQL,
    "tx_versions": r"SELECT p_partkey, nullif(regexp_extract(p_name, '(\d+\.\d+\.\d+)', 1), '') AS version FROM part",
    "tx_distinct_tokens": r"SELECT doc_id, len(ts)::INT AS n_tokens, list_min(ts) AS first_token FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ts FROM documents)",
    "tx_batch_summary": f"SELECT source, total, relevant, CASE WHEN relevant / total > 0.8 THEN 'good' WHEN relevant / total > 0.5 THEN 'review' ELSE 'filter' END AS advice FROM (SELECT source, count(*) AS total, count(*) FILTER (is_relevant) AS relevant FROM ({_RELEVANCE_SQL}) JOIN documents USING (doc_id) GROUP BY source)",
}
