"""Repositories as lists of files: project types, structure, what is missing, documentation maps, priorities, crawl targets.

Every operator takes files (repo, path, size) and groups them by repository in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import any_of, quote, sql_any
from ..sources.tables import table

# What speaks for a project's type, in the order that decides ties.
INDICATORS = {
    "python": {"files": ["requirements.txt", "setup.py", "pyproject.toml", "Pipfile", "setup.cfg", "tox.ini", "pytest.ini", "conftest.py"], "extensions": [".py"], "directories": ["__pycache__", ".pytest_cache", "venv", "env"], "patterns": [r".*\.py$", r"requirements.*\.txt$"]},
    "javascript": {"files": ["package.json", "package-lock.json", "yarn.lock", "bower.json", "npm-shrinkwrap.json", ".npmrc", "webpack.config.js", "vite.config.js"], "extensions": [".js", ".ts", ".jsx", ".tsx", ".mjs"], "directories": ["node_modules", "dist", "build"], "patterns": [r".*\.(js|ts|jsx|tsx|mjs)$"]},
    "rust": {"files": ["Cargo.toml", "Cargo.lock"], "extensions": [".rs"], "directories": ["target", "src"], "patterns": [r".*\.rs$"]},
    "go": {"files": ["go.mod", "go.sum", "Gopkg.toml", "Gopkg.lock"], "extensions": [".go"], "directories": ["vendor"], "patterns": [r".*\.go$"]},
    "java": {"files": ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle"], "extensions": [".java", ".kt", ".scala"], "directories": ["target", "build", ".gradle"], "patterns": [r".*\.(java|kt|scala)$"]},
    "csharp": {"files": ["*.csproj", "*.sln", "packages.config", "project.json"], "extensions": [".cs", ".vb"], "directories": ["bin", "obj", "packages"], "patterns": [r".*\.(cs|vb)$"]},
    "php": {"files": ["composer.json", "composer.lock"], "extensions": [".php"], "directories": ["vendor"], "patterns": [r".*\.php$"]},
    "ruby": {"files": ["Gemfile", "Gemfile.lock", "*.gemspec"], "extensions": [".rb"], "directories": ["vendor"], "patterns": [r".*\.rb$"]},
}
# Files that a project of a type should have.
EXPECTED = {
    "python": [("README.md", "Project documentation"), ("requirements.txt", "Python dependencies"), ("setup.py", "Package setup script"), (".gitignore", "Git ignore file"), ("tests/", "Test directory"), ("LICENSE", "License file")],
    "javascript": [("README.md", "Project documentation"), ("package.json", "Node.js dependencies"), (".gitignore", "Git ignore file"), ("src/", "Source code directory"), ("tests/", "Test directory"), ("LICENSE", "License file")],
    "rust": [("README.md", "Project documentation"), ("Cargo.toml", "Rust dependencies"), (".gitignore", "Git ignore file"), ("src/", "Source code directory"), ("tests/", "Test directory"), ("LICENSE", "License file")],
}
# Kinds of documentation by path, in the order they are tried.
KINDS = [
    ("api_documentation", ["api", "reference"]),
    ("tutorial", ["tutorial", "guide", "getting"]),
    ("example", ["example", "demo", "sample"]),
    ("meta", ["contributing", "changelog", "history"]),
    ("legal", ["license", "copying"]),
    ("media", [".png", ".jpg", ".gif", ".mp4", ".svg"]),
    ("configuration", ["setup", "config", "requirements"]),
]
# Kinds of sources by pattern, with their priorities.
SOURCES = [
    ("readme", 5, [r"readme\.md$", r"readme\.rst$", r"readme\.txt$", r"readme$"]),
    ("api_docs", 4, [r"api\.md$", r"reference\.md$", r"docs/api/", r"docs/reference/"]),
    ("tutorials", 4, [r"tutorial", r"guide", r"getting.?started", r"quickstart"]),
    ("examples", 3, [r"example", r"demo", r"sample"]),
    ("contributing", 2, [r"contributing\.md$", r"contribute\.md$"]),
    ("changelog", 2, [r"changelog\.md$", r"history\.md$", r"releases\.md$"]),
    ("license", 1, [r"license", r"copying", r"copyright"]),
    ("config", 1, [r"setup\.py$", r"requirements\.txt$", r"pyproject\.toml$", r"package\.json$", r"makefile$", r"dockerfile$"]),
]
# Documentation systems by their files, in the order they are tried.
SYSTEMS = {
    "sphinx": [r"conf\.py$", r"index\.rst$", r"makefile$"],
    "mkdocs": [r"mkdocs\.yml$", r"mkdocs\.yaml$"],
    "gitbook": [r"book\.json$", r"summary\.md$"],
    "docusaurus": [r"docusaurus\.config\.js$", r"sidebars\.js$"],
    "vuepress": [r"\.vuepress/config\.js$"],
    "docsify": [r"index\.html$", r"_sidebar\.md$"],
}
# Languages, frameworks and documentation hosts by URL.
LANGUAGES = {
    "python": [r"\.py$", r"requirements\.txt$", r"setup\.py$", r"pyproject\.toml$"],
    "javascript": [r"\.js$", r"package\.json$", r"node_modules"],
    "java": [r"\.java$", r"pom\.xml$", r"build\.gradle$"],
    "ruby": [r"\.rb$", r"Gemfile$"],
    "go": [r"\.go$", r"go\.mod$"],
    "rust": [r"\.rs$", r"Cargo\.toml$"],
    "php": [r"\.php$", r"composer\.json$"],
}
FRAMEWORKS = {
    "django": [r"django", r"urls\.py$", r"wsgi\.py$"],
    "flask": [r"flask", r"app\.py$"],
    "react": [r"react", r"jsx$", r"tsx$"],
    "angular": [r"angular", r"component\.ts$"],
    "vue": [r"vue", r"vue-cli"],
    "spring": [r"spring-boot", r"springframework"],
    "rails": [r"rails", r"activerecord"],
}
PLATFORMS = {"readthedocs.org": 0.9, "docs.python.org": 0.9, "developer.mozilla.org": 0.8, "docs.microsoft.com": 0.8, "docs.oracle.com": 0.8, "pkg.go.dev": 0.8, "docs.rs": 0.8, "hexdocs.pm": 0.8, "rubydoc.info": 0.8, "godoc.org": 0.8}
# Wiki pages by title.
WIKI = [("home", ["home"]), ("documentation", ["install", "setup", "config"]), ("guides", ["guide", "tutorial", "how"]), ("faq", ["faq", "question"])]

#: How the parts of the tables are seen as files of repositories (brands).
_SPECIAL = ["README.md", "setup.py", "package.json", "Cargo.toml", "go.mod", "LICENSE", "mkdocs.yml", "requirements-dev.txt", "CHANGELOG.md", "conf.py", "app.csproj"]
_DIRS = ["", "src/", "docs/api/", "docs/guides/deep/", "tests/", "examples/", "lib/", "documentation/part/", "venv/lib/"]
_EXTS = [".py", ".md", ".js", ".rs", ".go", ".txt", ".java", ".PNG", ".rb", ".vue", ""]
_HOSTS = ["docs.rs", "pkg.go.dev", "example.org", "docs.python.org", "react.example.com"]
_TITLES = ["Home", "Install guide", "How to use a", "FAQ on a", "Setup of a", "Notes on a"]


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], at: str) -> str:
    return f"[{', '.join(quote(v) for v in values)}][(({at}) % {len(values)} + 1)::INT]"


def part_files(parts: DataFrame) -> DataFrame:
    """(repo, path, size, key): parts as the files of repositories."""
    k = F.col("p_partkey")
    plain = F.concat(_pick(_DIRS, k), F.replace("p_name", F.lit(" "), F.lit("_")), _pick(_EXTS, F.col("p_size")))
    path = F.when(k % 10 == 0, _pick(_SPECIAL, F.floor(k / 10))).otherwise(plain)
    return parts.select(F.col("p_brand").alias("repo"), path.alias("path"), (F.col("p_size") * 97).cast("long").alias("size"), k.alias("key"))


_FILES = f"(SELECT p_brand AS repo, CASE WHEN p_partkey % 10 = 0 THEN {_sql_pick(_SPECIAL, 'p_partkey // 10')} ELSE {_sql_pick(_DIRS, 'p_partkey')} || replace(p_name, ' ', '_') || {_sql_pick(_EXTS, 'p_size')} END AS path, (p_size * 97)::BIGINT AS size, p_partkey AS key FROM part)"


def type_scores(files: DataFrame) -> DataFrame:
    """(repo, type, score, confidence): 5 for a known file, 3 for a pattern of names, 1 for each extension and each name that matches, 2 for a directory."""
    p = F.col("path")
    suffix = F.lower(F.regexp_extract(p, r"[^/](\.[^./]+)$", 1))
    scores = []
    for kind, own in INDICATORS.items():
        parts = [F.sum(suffix.isin(own["extensions"]).cast("int"))]
        for name in own["files"]:
            there = F.max((p == name).cast("int"))
            if "*" in name:
                alike = F.max(F.regexp_like(p, F.lit("^" + name.replace("*", ".*"))).cast("int"))
                parts.append(F.when(there == 1, 5).when(alike == 1, 3).otherwise(0))
            else:
                parts.append(there * 5)
        parts += [F.max(F.contains(p, F.lit(d)).cast("int")) * 2 for d in own["directories"]]
        parts += [F.sum(F.regexp_like(p, F.lit("^" + x)).cast("int")) for x in own["patterns"]]
        scores.append(F.struct(F.lit(kind).alias("type"), sum(parts[1:], parts[0]).cast("long").alias("score")))
    by = files.groupBy("repo").agg(F.array(*scores).alias("scores"))
    return by.select("repo", F.inline("scores")).where("score > 0").withColumn("confidence", F.least(F.col("score") / 10, F.lit(1.0)))


def _type_scores_sql() -> str:
    out = []
    for kind, own in INDICATORS.items():
        parts = [f"sum((lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ({', '.join(map(quote, own['extensions']))}))::INT)"]
        for name in own["files"]:
            if "*" in name:
                parts.append(f"CASE WHEN bool_or(path = {quote(name)}) THEN 5 WHEN bool_or(regexp_matches(path, '^{name.replace('*', '.*')}')) THEN 3 ELSE 0 END")
            else:
                parts.append(f"5 * bool_or(path = {quote(name)})::INT")
        parts += [f"2 * bool_or(contains(path, {quote(d)}))::INT" for d in own["directories"]]
        parts += [f"sum(regexp_matches(path, '^{x}')::INT)" for x in own["patterns"]]
        out.append(f"SELECT repo, {quote(kind)} AS type, ({' + '.join(parts)})::BIGINT AS score FROM {_FILES} GROUP BY repo")
    return f"SELECT *, least(score / 10, 1.0)::DOUBLE AS confidence FROM ({' UNION ALL '.join(out)}) WHERE score > 0"


def best_types(files: DataFrame) -> DataFrame:
    """(repo, type): the type of the highest score, the first of equals."""
    order = F.array_position(F.array(*[F.lit(t) for t in INDICATORS]), F.col("type"))
    return type_scores(files).groupBy("repo").agg(F.max_by("type", F.struct("score", -order)).alias("type"))


_ORDER_SQL = f"list_position([{', '.join(map(quote, INDICATORS))}], type)"
_BEST_SQL = f"SELECT repo, arg_max(type, score * 100 - {_ORDER_SQL}) AS type FROM ({_type_scores_sql()}) GROUP BY repo"


def structure(files: DataFrame) -> DataFrame:
    has = lambda *names: F.max(any_of(F.col("path"), names).cast("int")) == 1
    depth = F.max(F.length("path") - F.length(F.replace("path", F.lit("/"))))
    return files.groupBy("repo").agg(has("src/").alias("has_src"), has("lib/").alias("has_lib"), has("test/", "tests/", "__tests__/").alias("has_tests"), has("docs/").alias("has_docs"), has("examples/").alias("has_examples"), depth.cast("int").alias("depth"), F.count("*").alias("n_files"))


_STRUCTURE_SQL = f"SELECT repo, bool_or(contains(path, 'src/')) AS has_src, bool_or(contains(path, 'lib/')) AS has_lib, bool_or({sql_any('path', ['test/', 'tests/', '__tests__/'])}) AS has_tests, bool_or(contains(path, 'docs/')) AS has_docs, bool_or(contains(path, 'examples/')) AS has_examples, max(length(path) - length(replace(path, '/', '')))::INT AS depth, count(*) AS n_files FROM {_FILES} GROUP BY repo"


def missing_files(files: DataFrame) -> DataFrame:
    """(repo, file, description, priority): what a project of the repository's type should have and has not."""
    wanted = sorted({name for own in EXPECTED.values() for name, _ in own})
    there = files.groupBy("repo").agg(F.array_compact(F.array(*[F.when(F.max(F.contains("path", F.lit(w)).cast("int")) == 1, F.lit(w)) for w in wanted])).alias("present"))
    rows = [(kind, name, text, "high" if name in ("README.md", "LICENSE") else "medium") for kind, own in EXPECTED.items() for name, text in own]
    expected = files.sparkSession.createDataFrame(rows, "type string, file string, description string, priority string")
    met = best_types(files).join(there, "repo").join(F.broadcast(expected), "type")  # a row for each expected file
    return met.where(~F.array_contains("present", F.col("file"))).select("repo", "file", "description", "priority")


_EXPECTED_SQL = ", ".join(f"({quote(k)}, {quote(n)}, {quote(t)}, '{'high' if n in ('README.md', 'LICENSE') else 'medium'}')" for k, own in EXPECTED.items() for n, t in own)
_MISSING_SQL = f"SELECT b.repo, file, description, priority FROM ({_BEST_SQL}) b JOIN (VALUES {_EXPECTED_SQL}) AS e(type, file, description, priority) USING (type) WHERE NOT EXISTS (SELECT 1 FROM {_FILES} f WHERE f.repo = b.repo AND contains(f.path, e.file))"


def file_kind(path: Column) -> Column:
    low = F.lower(path)
    out = F.when(F.regexp_like(low, F.lit(r"readme\.")), "primary_documentation")
    for kind, marks in KINDS:
        out = out.when(any_of(low, marks), kind)
    return out.otherwise("primary_documentation")


_KIND_SQL = "CASE WHEN regexp_matches(lower(path), 'readme\\.') THEN 'primary_documentation' " + " ".join(f"WHEN {sql_any('lower(path)', marks)} THEN '{kind}'" for kind, marks in KINDS) + " ELSE 'primary_documentation' END"


def documentation_map(files: DataFrame) -> DataFrame:
    """(repo, kind, n_files, size, minutes): five characters a word, two hundred words a minute, one at least."""
    by = files.groupBy("repo", file_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n_files"), F.sum("size").alias("size"))
    return by.withColumn("minutes", F.greatest(F.floor(F.col("size") / 1000), F.lit(1)).cast("long"))


_MAP_SQL = f"SELECT *, greatest(size // 1000, 1)::BIGINT AS minutes FROM (SELECT repo, {_KIND_SQL} AS kind, count(*) AS n_files, sum(size)::BIGINT AS size FROM {_FILES} GROUP BY ALL)"


def documentation_quality(files: DataFrame) -> DataFrame:
    """(repo, completeness, quality, missing): which of four kinds are there; size, files and reading time against what is enough."""
    kind = file_kind(F.col("path"))
    n = {k: F.count_if(kind == k) for k in ("primary_documentation", "api_documentation", "tutorial", "example")}
    by = files.groupBy("repo").agg(F.sum("size").alias("size"), F.count("*").alias("n_files"), *[c.alias(k) for k, c in n.items()])
    minutes = F.greatest(F.floor(F.col("size") / 1000), F.lit(1))
    whole = lambda c, most: F.least(c / most, F.lit(1.0))
    absent = F.array_compact(F.array(*[F.when(F.col(k) == 0, F.lit(k)) for k in n]))
    return by.select("repo", ((len(n) - F.size(absent)) / len(n)).alias("completeness"), F.round((whole(F.col("size"), 10000) + whole(F.col("n_files"), 10) + whole(minutes, 30)) / 3, 6).alias("quality"), F.array_join(absent, ",").alias("missing"))


_FOUR = ("primary_documentation", "api_documentation", "tutorial", "example")
_QUALITY_SQL = f"SELECT repo, (4 - len(absent)) / 4 AS completeness, round((least(size / 10000, 1.0) + least(n / 10, 1.0) + least(greatest(size // 1000, 1) / 30, 1.0)) / 3, 6)::DOUBLE AS quality, array_to_string(absent, ',') AS missing FROM (SELECT repo, sum(size)::BIGINT AS size, count(*) AS n, list_filter([{', '.join(f'CASE WHEN count(*) FILTER (kind = {quote(k)}) = 0 THEN {quote(k)} END' for k in _FOUR)}], lambda x: x IS NOT NULL) AS absent FROM (SELECT *, {_KIND_SQL} AS kind FROM {_FILES}) GROUP BY repo)"


def source_priorities(files: DataFrame) -> DataFrame:
    """(repo, path, source, priority, confidence) of each distinct file: raised for size and for interfaces, lowered for next to nothing."""
    low = F.lower("path")
    source, base = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for name, priority, patterns in SOURCES:
        hit = F.regexp_like(low, F.lit("|".join(patterns)))
        source, base = source.when(hit, name), base.when(hit, priority)
    own = files.groupBy("repo", "path").agg(F.max("size").alias("size")).select("*", source.otherwise("unknown").alias("source"), base.otherwise(3).alias("base"))
    raised = F.when((F.col("size") > 5000) & (F.col("base") < 4), F.col("base") + 1).otherwise(F.col("base"))
    raised = F.when(any_of(F.lower("path"), ["api", "reference"]), 4).otherwise(raised)
    priority = F.when((F.col("size") < 100) & (raised > 1), raised - 1).otherwise(raised)
    sure = 0.5 + F.when(any_of(F.lower("path"), ["readme", "api", "docs/"]), 0.3).otherwise(0.0) + F.when(F.col("size") > 1000, 0.2).otherwise(0.0) - F.when(F.col("source") == "unknown", 0.2).otherwise(0.0)
    return own.select("repo", "path", "source", priority.cast("int").alias("priority"), F.round(F.greatest(F.least(sure, F.lit(1.0)), F.lit(0.0)), 6).alias("confidence"))


def _priorities_sql() -> str:
    hit = lambda patterns: f"regexp_matches(lower(path), '{'|'.join(patterns)}')"
    source = " ".join(f"WHEN {hit(p)} THEN '{n}'" for n, _, p in SOURCES)
    base = " ".join(f"WHEN {hit(p)} THEN {k}" for _, k, p in SOURCES)
    return f"""SELECT repo, path, source, (CASE WHEN size < 100 AND r > 1 THEN r - 1 ELSE r END)::INT AS priority,
      round(greatest(least(0.5::DOUBLE + CASE WHEN {sql_any('lower(path)', ['readme', 'api', 'docs/'])} THEN 0.3 ELSE 0 END + CASE WHEN size > 1000 THEN 0.2 ELSE 0 END - CASE WHEN source = 'unknown' THEN 0.2 ELSE 0 END, 1.0), 0.0), 6) AS confidence
    FROM (SELECT *, CASE WHEN {sql_any('lower(path)', ['api', 'reference'])} THEN 4 WHEN size > 5000 AND base < 4 THEN base + 1 ELSE base END AS r FROM (
      SELECT repo, path, max(size) AS size, CASE {source} ELSE 'unknown' END AS source, CASE {base} ELSE 3 END AS base FROM {_FILES} GROUP BY repo, path))"""


def nested_structure(files: DataFrame) -> DataFrame:
    """(repo, folder, n_files, n_folders, depth) of the folders of documentation."""
    parts = F.split("path", "/")
    n = F.size(parts)
    first, under = F.element_at(parts, 1), (F.element_at(parts, 1) == "docs") & (n > 2)
    top = first.isin("docs", "documentation", "guides", "tutorials", "examples")
    rows = files.where(n > 1).select("repo", F.when(under, F.element_at(parts, 2)).when(top, first).alias("folder"), F.when(under, n - 2).otherwise(n - 1).alias("depth"), F.when(under & (n > 3), F.element_at(parts, F.when(n > 3, 3).otherwise(1))).when(~under & (n > 2), F.element_at(parts, 2)).alias("inner"))
    return rows.where("folder is not null").groupBy("repo", "folder").agg(F.count("*").alias("n_files"), F.count_distinct("inner").alias("n_folders"), F.max("depth").alias("depth"))


_NESTED_SQL = f"""SELECT repo, folder, count(*) AS n_files, count(DISTINCT inside) AS n_folders, max(depth)::INT AS depth FROM (
  SELECT repo, CASE WHEN ps[1] = 'docs' AND n > 2 THEN ps[2] WHEN ps[1] IN ('docs', 'documentation', 'guides', 'tutorials', 'examples') THEN ps[1] END AS folder, CASE WHEN ps[1] = 'docs' AND n > 2 THEN n - 2 ELSE n - 1 END AS depth,
    CASE WHEN ps[1] = 'docs' AND n > 2 THEN CASE WHEN n > 3 THEN ps[3] END WHEN n > 2 THEN ps[2] END AS inside FROM (SELECT repo, string_split(path, '/') AS ps, len(string_split(path, '/')) AS n FROM {_FILES}) WHERE n > 1) WHERE folder IS NOT NULL GROUP BY ALL"""


def wiki_categories(pages: DataFrame) -> DataFrame:
    """(repo, category, n_pages, size) of wiki pages (repo, title, size)."""
    low = F.lower("title")
    kind = F.when(F.lit(False), "")
    for name, marks in WIKI:
        kind = kind.when(any_of(low, marks), name)
    return pages.groupBy("repo", kind.otherwise("other").alias("category")).agg(F.count("*").alias("n_pages"), F.sum("size").alias("size"))


_WIKI_PAGES = f"(SELECT repo, {_sql_pick(_TITLES, 'key')} || ' ' || path AS title, size FROM {_FILES})"
_WIKI_SQL = "SELECT repo, CASE " + " ".join(f"WHEN {sql_any('lower(title)', m)} THEN '{n}'" for n, m in WIKI) + f" ELSE 'other' END AS category, count(*) AS n_pages, sum(size)::BIGINT AS size FROM {_WIKI_PAGES} GROUP BY ALL"


def _has_system(system: str) -> Column:
    return F.max(F.regexp_like(F.lower("path"), F.lit("|".join(SYSTEMS[system]))).cast("int")) == 1


def documentation_systems(files: DataFrame) -> DataFrame:
    out = F.when(F.lit(False), "")
    for system in SYSTEMS:
        out = out.when(_has_system(system), system)
    return files.groupBy("repo").agg(out.when(F.max(F.contains("path", F.lit("docs/")).cast("int")) == 1, "custom").otherwise("basic").alias("system"))


_SYSTEMS_SQL = "SELECT repo, CASE " + " ".join(f"WHEN bool_or(regexp_matches(lower(path), '{'|'.join(p)}')) THEN '{s}'" for s, p in SYSTEMS.items()) + f" WHEN bool_or(contains(path, 'docs/')) THEN 'custom' ELSE 'basic' END AS system FROM {_FILES} GROUP BY repo"


def crawl_targets(files: DataFrame, base: str = "https://git.example.org/", with_wiki: bool = True) -> DataFrame:
    """(repo, url, kind, depth, priority): where to start in a repository that has the folders for it."""
    by = files.groupBy("repo").agg((F.max(F.startswith("path", F.lit("docs/")).cast("int")) == 1).alias("docs"), (F.max(F.contains(F.lower("path"), F.lit("example")).cast("int")) == 1).alias("examples"))
    url = F.concat(F.lit(base), F.lower("repo"))
    target = lambda there, tail, kind, depth, priority: F.when(there, F.struct(F.concat(url, F.lit(tail)).alias("url"), F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), F.lit(priority).alias("priority")))
    rows = F.array(target(F.lit(True), "", "repository_main", 2, 4), target(F.col("docs"), "/tree/main/docs", "docs_folder", 3, 4), target(F.col("examples"), "/tree/main/examples", "examples", 2, 3), target(F.lit(with_wiki), "/wiki", "wiki", 2, 3))
    return by.select("repo", F.inline(F.array_compact(rows)))


_TARGETS_SQL = f"""SELECT repo, 'https://git.example.org/' || lower(repo) || tail AS url, kind, depth, priority FROM (SELECT repo, bool_or(starts_with(path, 'docs/')) AS docs, bool_or(contains(lower(path), 'example')) AS examples FROM {_FILES} GROUP BY repo)
  CROSS JOIN (VALUES ('', 'repository_main', 2, 4), ('/tree/main/docs', 'docs_folder', 3, 4), ('/tree/main/examples', 'examples', 2, 3), ('/wiki', 'wiki', 2, 3)) AS t(tail, kind, depth, priority) WHERE CASE kind WHEN 'docs_folder' THEN docs WHEN 'examples' THEN examples ELSE true END"""


def identify_urls(urls: DataFrame) -> DataFrame:
    """(key, language, framework, type, confidence) by a URL (key, url): the first language and framework whose pattern it holds."""
    u = F.col("url")

    def first(rules: dict[str, list[str]]) -> Column:
        out = F.when(F.lit(False), "")
        for name, patterns in rules.items():
            out = out.when(F.regexp_like(u, F.lit("(?i)" + "|".join(patterns))), name)
        return out

    platform = F.when(F.lit(False), 0.0)
    for host, sure in PLATFORMS.items():
        platform = platform.when(F.contains(u, F.lit(host)), sure)
    named = urls.select("key", first(LANGUAGES).alias("language"), first(FRAMEWORKS).alias("framework"), platform.otherwise(0.0).alias("p"))
    sure = F.greatest("p", F.when(F.col("language").isNotNull(), 0.7).otherwise(0.0), F.when(F.col("framework").isNotNull(), 0.8).otherwise(0.0))
    return named.select("key", "language", "framework", F.when(F.col("framework").isNotNull(), "framework").otherwise("unknown").alias("type"), sure.alias("confidence"))


def _identify_sql() -> str:
    first = lambda rules: "CASE " + " ".join(f"WHEN regexp_matches(url, '(?i){'|'.join(p)}') THEN '{n}'" for n, p in rules.items()) + " END"
    platform = "CASE " + " ".join(f"WHEN contains(url, '{h}') THEN {c}" for h, c in PLATFORMS.items()) + " ELSE 0 END"
    return f"""SELECT key, language, framework, CASE WHEN framework IS NULL THEN 'unknown' ELSE 'framework' END AS type, greatest(p, CASE WHEN language IS NULL THEN 0 ELSE 0.7 END, CASE WHEN framework IS NULL THEN 0 ELSE 0.8 END)::DOUBLE AS confidence
    FROM (SELECT key, {first(LANGUAGES)} AS language, {first(FRAMEWORKS)} AS framework, {platform} AS p FROM (SELECT key, 'https://' || {_sql_pick(_HOSTS, 'key')} || '/' || path AS url FROM {_FILES}))"""


def type_confidence(files: DataFrame, content: str = "content") -> DataFrame:
    """(key, confidence): how sure a file's kind is by its path and content."""
    p, low, text = F.col("path"), F.lower("path"), F.col(content)
    total = 0.5 + F.when(F.contains(p, F.lit("docs/")), 0.2).otherwise(0.0) + F.when(F.contains(low, F.lit("api")), 0.3).otherwise(0.0) + F.when(F.startswith(low, F.lit("readme")), 0.4).otherwise(0.0) + F.when(F.length(text) > 1000, 0.1).otherwise(0.0) + F.when(any_of(text, ["```", ".. code-block::"]), 0.1).otherwise(0.0)
    return files.select("key", F.round(F.least(total, F.lit(1.0)), 6).alias("confidence"))


_CONFIDENCE_SQL = f"SELECT key, round(least(0.5::DOUBLE + 0.2 * contains(path, 'docs/')::INT + 0.3 * contains(lower(path), 'api')::INT + 0.4 * starts_with(lower(path), 'readme')::INT + 0.1 * (length(text) > 1000)::INT + 0.1 * {sql_any('text', ['```', '.. code-block::'])}::INT, 1.0), 6) AS confidence FROM {_FILES} JOIN documents ON doc_id = key"


def _files(s, d: str) -> DataFrame:
    return part_files(table(s, d, "part"))


def _with_text(s, d: str) -> DataFrame:
    return _files(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content")), "key")


QUERIES = {
    "dg_type_scores": lambda s, d: type_scores(_files(s, d)),
    "dg_best_types": lambda s, d: best_types(_files(s, d)),
    "dg_structure": lambda s, d: structure(_files(s, d)),
    "dg_missing_files": lambda s, d: missing_files(_files(s, d)),
    "dg_documentation_map": lambda s, d: documentation_map(_files(s, d)),
    "dg_documentation_quality": lambda s, d: documentation_quality(_files(s, d)),
    "dg_source_priorities": lambda s, d: source_priorities(_files(s, d)),
    "dg_nested_structure": lambda s, d: nested_structure(_files(s, d)),
    "dg_wiki": lambda s, d: wiki_categories(_files(s, d).withColumn("title", F.concat(_pick(_TITLES, F.col("key")), F.lit(" "), F.col("path")))),
    "dg_documentation_systems": lambda s, d: documentation_systems(_files(s, d)),
    "dg_crawl_targets": lambda s, d: crawl_targets(_files(s, d)),
    "dg_identify_urls": lambda s, d: identify_urls(_files(s, d).select("key", F.concat(F.lit("https://"), _pick(_HOSTS, F.col("key")), F.lit("/"), F.col("path")).alias("url"))),
    "tx_type_confidence": lambda s, d: type_confidence(_with_text(s, d)),
}
ORACLE = {
    "dg_type_scores": _type_scores_sql(),
    "dg_best_types": _BEST_SQL,
    "dg_structure": _STRUCTURE_SQL,
    "dg_missing_files": _MISSING_SQL,
    "dg_documentation_map": _MAP_SQL,
    "dg_documentation_quality": _QUALITY_SQL,
    "dg_source_priorities": _priorities_sql(),
    "dg_nested_structure": _NESTED_SQL,
    "dg_wiki": _WIKI_SQL,
    "dg_documentation_systems": _SYSTEMS_SQL,
    "dg_crawl_targets": _TARGETS_SQL,
    "dg_identify_urls": _identify_sql(),
    "tx_type_confidence": _CONFIDENCE_SQL,
}
