"""Dependencies, compatibility, trees and graphs, project files, and the crawl frontier."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import any_of
from ..sources.tables import folder, kept, table
from .rendering import PROJECTS_SQL, failed_calls, projects
from .urls import resolve
from .web import HREF

# Pairs known to conflict and families of which one is enough.
CONFLICTS = [("python", "requests", "urllib3", "version_dependency"), ("python", "fastapi", "starlette", "version_dependency"), ("python", "django", "flask", "framework_conflict"), ("javascript", "react", "vue", "framework_conflict"), ("javascript", "webpack", "vite", "build_tool_conflict")]
FAMILIES = {"web_frameworks": ["django", "flask", "fastapi", "tornado"], "frontend_frameworks": ["react", "vue", "angular", "svelte"]}
# Files that tell a project's type, in the order they are tried.
PROJECT_FILES = {
    "python": ["requirements.txt", "setup.py", "pyproject.toml", "Pipfile", "setup.cfg", "tox.ini"],
    "javascript": ["package.json", "package-lock.json", "yarn.lock", "npm-shrinkwrap.json", "bower.json"],
    "rust": ["Cargo.toml", "Cargo.lock"],
    "go": ["go.mod", "go.sum", "Gopkg.toml"],
    "java": ["pom.xml", "build.gradle", "build.gradle.kts"],
}
_PROJECTS_SQL = PROJECTS_SQL
_LINE = r"^([a-zA-Z0-9_.-]+)(?:\[[^\]]*\])?([><=!~]+.*)?$"


def parse_requirements(df: DataFrame) -> DataFrame:
    """(project, name, version): comments go first, lines that are addresses are left out."""
    lines = df.select("project", F.explode(F.split("requirements", "\n")).alias("line")).select("project", F.trim(F.substring_index("line", "#", 1)).alias("line"))
    ok = lines.where((F.length("line") > 0) & ~F.contains("line", F.lit("://")) & ~F.startswith("line", F.lit("git+")) & F.regexp_like("line", F.lit(_LINE)))
    return ok.select("project", F.regexp_extract("line", _LINE, 1).alias("name"), F.regexp_extract("line", _LINE, 2).alias("version"))


_REQ_SQL = rf"""(SELECT project, regexp_extract(line, '{_LINE}', 1) AS name, regexp_extract(line, '{_LINE}', 2) AS version FROM (SELECT project, trim(string_split(unnest(string_split(requirements, chr(10))), '#')[1]) AS line FROM {_PROJECTS_SQL})
  WHERE length(line) > 0 AND NOT contains(line, '://') AND NOT starts_with(line, 'git+') AND regexp_matches(line, '{_LINE}'))"""


def compatibility(df: DataFrame) -> DataFrame:
    """Known conflicts, names with several versions, families with several members, and the score of them all."""
    deps = parse_requirements(df)
    names = deps.groupBy("project").agg(F.collect_set("name").alias("names"))
    clash = sum(((F.array_contains("names", a) & F.array_contains("names", b)).cast("int") for _, a, b, _ in CONFLICTS), F.lit(0))
    families = sum(((F.size(F.array_intersect("names", F.array(*[F.lit(x) for x in f]))) > 1).cast("int") for f in FAMILIES.values()), F.lit(0))
    several = deps.where("version <> ''").groupBy("project", "name").agg(F.countDistinct("version").alias("n")).where("n > 1").groupBy("project").agg(F.count("*").alias("n_versions"))
    met = names.join(several, "project", "left").select("project", clash.alias("n_conflicts"), F.coalesce("n_versions", F.lit(0)).alias("n_versions"), families.alias("n_families"))
    return met.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - 0.3 * F.col("n_conflicts") - 0.4 * F.col("n_versions") - 0.1 * F.col("n_families")), 6))


_COMPAT_SQL = f"""WITH d AS {_REQ_SQL}, n AS (SELECT project, list(DISTINCT name) AS names FROM d GROUP BY project), v AS (SELECT project, count(*) AS n_versions FROM (SELECT project, name FROM d WHERE version <> '' GROUP BY ALL HAVING count(DISTINCT version) > 1) GROUP BY project),
m AS (SELECT n.project, ({" + ".join(f"(list_contains(names, '{a}') AND list_contains(names, '{b}'))::INT" for _, a, b, _ in CONFLICTS)})::INT AS n_conflicts, coalesce(n_versions, 0) AS n_versions,
  ({" + ".join(f"(len(list_intersect(names, {f})) > 1)::INT" for f in FAMILIES.values())})::INT AS n_families FROM n LEFT JOIN v USING (project))
SELECT *, round(greatest(0.0, 1 - 0.3::DOUBLE * n_conflicts - 0.4::DOUBLE * n_versions - 0.1::DOUBLE * n_families), 6) AS score FROM m"""


def project_types(df: DataFrame) -> DataFrame:
    files = F.split("files", ",")
    out = F.when(F.lit(False), "")
    for name, marks in PROJECT_FILES.items():
        out = out.when(F.arrays_overlap(files, F.array(*[F.lit(m) for m in marks])), name)
    depth = F.array_max(F.transform(files, lambda f: F.size(F.split(f, "/"))))
    return df.select("project", out.otherwise("unknown").alias("type"), depth.alias("depth"), F.size(files).alias("n_files"))


_TYPES_SQL = f"""SELECT project, CASE {" ".join(f"WHEN list_has_any(fs, {m}) THEN '{n}'" for n, m in PROJECT_FILES.items())} ELSE 'unknown' END AS type, list_max([len(string_split(f, '/')) for f in fs])::INT AS depth, len(fs)::INT AS n_files FROM (SELECT project, string_split(files, ',') AS fs FROM {_PROJECTS_SQL})"""

# What a path tells of its file, in the order tried.
FILE_KINDS = [("primary", ["readme."]), ("api", ["api", "reference"]), ("tutorial", ["tutorial", "guide", "getting"]), ("example", ["example", "demo", "sample"]), ("meta", ["contributing", "changelog", "history"]), ("legal", ["license", "copying"]), ("media", [".png", ".jpg", ".gif", ".mp4", ".svg"]), ("config", ["setup", "config", "requirements"])]


def file_map(df: DataFrame) -> DataFrame:
    """Files by project and kind."""
    path = F.lower("file")
    kind = F.when(F.lit(False), "")
    for name, marks in FILE_KINDS:
        kind = kind.when(any_of(path, marks), name)
    each = df.select("project", F.explode(F.split("files", ",")).alias("file"))
    return each.groupBy("project", kind.otherwise("primary").alias("kind")).agg(F.count("*").alias("n"), F.min("file").alias("first_file"))


_FILES_SQL = f"""SELECT project, kind, count(*) AS n, min(file) AS first_file FROM (SELECT project, file, CASE {" ".join("WHEN " + " OR ".join(f"contains(lower(file), '{m}')" for m in ms) + f" THEN '{k}'" for k, ms in FILE_KINDS)} ELSE 'primary' END AS kind FROM (SELECT project, unnest(string_split(files, ',')) AS file FROM {_PROJECTS_SQL})) GROUP BY ALL"""


def order_chain(orders: DataFrame) -> DataFrame:
    """(child, parent): each order hangs below the customer's last; one of eleven starts a tree of its own."""
    line = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    parent = F.when(F.col("o_orderkey") % 11 != 0, F.lag("o_orderkey").over(line))
    return orders.select(F.col("o_orderkey").alias("child"), parent.alias("parent"))


def depths(edges: DataFrame) -> DataFrame:
    """(child, root, depth) of a forest, by pointer doubling: the rounds grow with the logarithm of the depth.

    Nodes on or below a cycle have no root and are left out: they are what is left once a
    round brings no further node to its root.  Every round ends in a table.
    """
    spark = edges.sparkSession
    root = f"{folder(spark)}/depths-{uuid.uuid4().hex}"

    def kept(df: DataFrame, step: int) -> DataFrame:
        df.write.parquet(f"{root}/{step}")
        return spark.read.schema(df.schema).parquet(f"{root}/{step}")

    now = kept(edges.select("child", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("parent", "child").alias("root")), 0)
    step, left = 0, now.where("up is not null").count()
    while left:
        step += 1
        above = now.select(F.col("child").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        # Nodes that are at their root stay as they are: joined, they would all come to one task, that of the null key.
        met = now.where("up is not null").join(above, "up", "left")
        moved = met.select("child", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("r2", "root").alias("root"))
        now = kept(now.where("up is null").unionByName(moved), step)
        before, left = left, now.where("up is not null").count()
        if left == before:
            break  # a path of any length to a root gets some node there each round; only cycles are left
    return now.where("up is null").select("child", "root", "depth")


_CHAIN_SQL = "(SELECT o_orderkey AS child, CASE WHEN o_orderkey % 11 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parent FROM orders)"
_DEPTH_SQL = f"WITH RECURSIVE e AS MATERIALIZED {_CHAIN_SQL}, t AS (SELECT child, child AS root, 0::BIGINT AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.child, t.root, t.depth + 1 FROM e JOIN t ON e.parent = t.child) SELECT * FROM t"


def tree_metrics(orders: DataFrame) -> DataFrame:
    by = depths(order_chain(orders)).groupBy("root").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"))
    return by.groupBy("max_depth").agg(F.count("*").alias("n_trees"), F.sum("n_nodes").alias("n_nodes"))


def rendered_edges(nations: DataFrame, regions: DataFrame) -> DataFrame:
    """A diagram's lines for each region: edges to its nations, in order."""
    met = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    edge = F.concat(F.lit("  "), F.col("r_name"), F.lit(" --> "), F.col("n_name"))
    return met.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(edge)), "\n").alias("lines"), F.count("*").alias("n"))


def pair_matrix(nations: DataFrame) -> DataFrame:
    """A small dimension with itself: same, compatible (one region) or different."""
    a, b = nations.select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("ra")), nations.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("rb"))
    kind = F.when(F.col("a") == F.col("b"), "same").when(F.col("ra") == F.col("rb"), "compatible").otherwise("different")
    return a.crossJoin(F.broadcast(b)).select("a", "b", kind.alias("kind"))


def url_links(pages: DataFrame) -> DataFrame:
    """(src, dst): the links of every page as URLs, resolved against the page's own, fragments left out."""
    href = F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href")
    each = pages.select("url", href).select(F.substring_index("url", "#", 1).alias("src"), resolve(F.col("url"), F.col("href")).alias("dst"))
    return each.where("dst like 'http%'").distinct()


def entry_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(url,): pages that no link leads to, where a crawl of them all has to begin."""
    own = pages.select(F.substring_index("url", "#", 1).alias("url")).where("url is not null").distinct()
    return own.join(links.select(F.col("dst").alias("url")), "url", "left_anti")


def frontier(links: DataFrame, seeds: DataFrame, budget: int | None = None) -> DataFrame:
    """(url, depth): breadth first from the seeds along (src, dst), each URL once, until nothing new is found.

    ``budget`` is the most new URLs that a depth takes, first by name; all where it is not given.
    Every depth is a table in the shared folder, so that the plan stays flat and a lost executor costs one depth.
    """
    links = kept(links.select("src", "dst"), "frontier-links")
    edge = kept(seeds.select("url", F.lit(0).alias("depth")).dropDuplicates(["url"]), "frontier")
    visited, depth = edge, 0
    while not edge.isEmpty():
        depth += 1
        found = edge.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
        if budget is not None:
            found = found.orderBy("url").limit(budget)
        edge = kept(found.withColumn("depth", F.lit(depth)), "frontier")
        visited = visited.unionByName(edge)
    return visited


def page_frontier(pages: DataFrame) -> DataFrame:
    links = kept(url_links(pages), "frontier-links")
    return frontier(links, entry_pages(pages, links))


_FRONTIER_SQL = rf"""WITH RECURSIVE l AS MATERIALIZED (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS src, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') AS dst FROM (SELECT url, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM pages) WHERE starts_with(href, '/')),
t AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url, 0 AS depth FROM pages WHERE regexp_replace(url, '#.*$', '') NOT IN (SELECT dst FROM l) UNION SELECT l.dst, t.depth + 1 FROM t JOIN l ON l.src = t.url WHERE t.depth < 50) SELECT url, min(depth)::INT AS depth FROM t GROUP BY url"""


def should_crawl(pages: DataFrame) -> DataFrame:
    """Scheme, excluded and required paths, and whether a host is inside the allowed domains."""
    u = F.col("url")
    host, path = F.lower(F.parse_url(u, F.lit("HOST"))), F.parse_url(u, F.lit("PATH"))
    scheme = F.regexp_like(u, F.lit("^(?i)https?://"))
    inside = F.regexp_like(host, F.lit(r"(^|\.)example\.(com|org)$"))
    left_out = F.regexp_like(path, F.lit(r"/(login|logout|admin)(/|$)|\.(png|jpg|zip)$"))
    return pages.select("page_id", (scheme & inside & ~left_out).alias("crawl"), F.when(~scheme, "scheme").when(~inside, "external").when(left_out, "excluded").alias("reason"))


_CRAWL_SQL = r"""SELECT page_id, s AND i AND NOT x AS crawl, CASE WHEN NOT s THEN 'scheme' WHEN NOT i THEN 'external' WHEN x THEN 'excluded' END AS reason FROM (SELECT page_id, regexp_matches(url, '^(?i)https?://') AS s, regexp_matches(lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)), '(^|\.)example\.(com|org)$') AS i,
  regexp_matches(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/(login|logout|admin)(/|$)|\.(png|jpg|zip)$') AS x FROM pages)"""

#: Rules that choose a backend: pattern, backend, priority; the highest priority wins, then the name.
BACKENDS = [(r"^https://", "http", 1), (r"/(en|de)/", "browser", 5), (r"\?", "query", 7), (r"#", "browser", 3)]


def backend_for(spark: SparkSession, pages: DataFrame) -> DataFrame:
    best = F.lit(None).cast("struct<p:int,b:string>")
    for pattern, backend, priority in BACKENDS:
        rule = F.when(F.regexp_like("url", F.lit(pattern)), F.struct(F.lit(priority).alias("p"), F.lit(backend).alias("b")))
        best = F.greatest(best, rule)
    return pages.select("page_id", F.coalesce(best["b"], F.lit("fallback")).alias("backend"))


_BACKEND_SQL = "SELECT page_id, coalesce(max_by(b, row(p, b)) FILTER (regexp_matches(url, r)), 'fallback') AS backend FROM pages, (VALUES " + ", ".join(f"('{r}', '{b}', {p})" for r, b, p in BACKENDS) + ") AS k(r, b, p) GROUP BY page_id"


def task_status(events: DataFrame) -> DataFrame:
    """The last event of each user as its task's status, counted; and users silent for a week before the end."""
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("seen"))
    end = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return last.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("seen") < end - F.expr("interval 3 days")).alias("n_silent"))


def retry_delays(calls: DataFrame) -> DataFrame:
    """Rows with the delays of their ``attempt`` (from 0): doubled, and grown by a step, both bounded."""
    n = F.col("attempt")
    return calls.withColumns({"exponential": F.least(F.pow(F.lit(2.0), n), F.lit(60.0)), "linear": F.least(1.0 + n * 2.0, F.lit(15.0))})


QUERIES = {
    "dg_requirements": lambda s, d: parse_requirements(projects(table(s, d, "lineitem"))),
    "dg_compatibility": lambda s, d: compatibility(projects(table(s, d, "lineitem"))),
    "dg_project_types": lambda s, d: project_types(projects(table(s, d, "lineitem"))),
    "dg_file_map": lambda s, d: file_map(projects(table(s, d, "lineitem"))),
    "dg_depths": lambda s, d: depths(order_chain(table(s, d, "orders"))),
    "dg_tree_metrics": lambda s, d: tree_metrics(table(s, d, "orders")),
    "dg_diagram": lambda s, d: rendered_edges(table(s, d, "nation"), table(s, d, "region")),
    "dg_matrix": lambda s, d: pair_matrix(table(s, d, "nation")),
    "cr_frontier": lambda s, d: page_frontier(table(s, d, "pages")),
    "cr_should_crawl": lambda s, d: should_crawl(table(s, d, "pages")),
    "cr_backend": lambda s, d: backend_for(s, table(s, d, "pages")),
    "cr_task_status": lambda s, d: task_status(table(s, d, "events")),
    "st_retry_delays": lambda s, d: retry_delays(failed_calls(table(s, d, "events"))),
}
ORACLE = {
    "dg_requirements": f"SELECT * FROM {_REQ_SQL}",
    "dg_compatibility": _COMPAT_SQL,
    "dg_project_types": _TYPES_SQL,
    "dg_file_map": _FILES_SQL,
    "dg_depths": _DEPTH_SQL,
    "dg_tree_metrics": f"SELECT max_depth, count(*) AS n_trees, sum(n_nodes)::BIGINT AS n_nodes FROM (SELECT root, count(*) AS n_nodes, max(depth) AS max_depth FROM ({_DEPTH_SQL}) GROUP BY root) GROUP BY max_depth",
    "dg_diagram": "SELECT r_name, string_agg('  ' || r_name || ' --> ' || n_name, chr(10) ORDER BY n_name) AS lines, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "dg_matrix": "SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_name = b.n_name THEN 'same' WHEN a.n_regionkey = b.n_regionkey THEN 'compatible' ELSE 'different' END AS kind FROM nation a, nation b",
    "cr_frontier": _FRONTIER_SQL,
    "cr_should_crawl": _CRAWL_SQL,
    "cr_backend": _BACKEND_SQL,
    "cr_task_status": "SELECT status, count(*) AS n, count(*) FILTER (seen < TIMESTAMP '2024-01-28 00:00:00') AS n_silent FROM (SELECT user_id, max_by(event_type, row(ts, event_id)) AS status, max(ts) AS seen FROM events GROUP BY user_id) GROUP BY status",
    "st_retry_delays": "SELECT user_id, event_id, i AS attempt, least(pow(2.0, i), 60.0)::DOUBLE AS exponential, least(1.0 + i * 2.0, 15.0)::DOUBLE AS linear FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)",
}
