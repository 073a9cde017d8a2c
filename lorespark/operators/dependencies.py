"""Dependencies of many projects at once: issues and what resolves them, cycles, trees as text.

Tables hold (project, node, ecosystem, name, version, parent): ``node`` numbers a project's
entries and ``parent`` is the node that brings an entry in, null at the top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept, table
from .graph import CONFLICTS, FAMILIES

# Members of either side whose meeting is worth a note.
BACKENDS = ["django", "flask", "fastapi"]
FRONTENDS = ["react", "vue", "angular"]
#: Names that the tables' parts stand for in queries.
LIBRARIES = [("python", n) for n in ("django", "flask", "fastapi", "requests", "urllib3", "starlette", "numpy", "pytest")] + [("javascript", n) for n in ("react", "vue", "angular", "webpack", "vite", "express", "lodash")]


def order_dependencies(lineitem: DataFrame) -> DataFrame:
    """Orders as projects: a line is a dependency named by its part, brought in by the line of half its number."""
    lines = lineitem.groupBy(F.col("l_orderkey").alias("project"), F.col("l_linenumber").cast("long").alias("node")).agg(F.max("l_partkey").alias("part"))
    at = F.col("part") % len(LIBRARIES)
    own = Window.partitionBy("project")
    up = F.floor(F.col("node") / 2)
    known = F.array_contains(F.collect_set("node").over(own), up)
    return lines.select("project", "node", *[F.element_at(F.array(*[F.lit(x[k]) for x in LIBRARIES]), (at + 1).cast("int")).alias(c) for k, c in ((0, "ecosystem"), (1, "name"))], F.concat(F.lit(">="), (F.col("part") % 3).cast("string")).alias("version"), F.when(known, up).alias("parent"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_DEPS = f"""d0 AS (SELECT l_orderkey AS project, l_linenumber::BIGINT AS node, max(l_partkey) AS part FROM lineitem GROUP BY ALL),
d AS MATERIALIZED (SELECT a.project, a.node, {_sql_list([e for e, _ in LIBRARIES])}[a.part % {len(LIBRARIES)} + 1] AS ecosystem, {_sql_list([n for _, n in LIBRARIES])}[a.part % {len(LIBRARIES)} + 1] AS name, '>=' || (a.part % 3) AS version, b.node AS parent FROM d0 a LEFT JOIN d0 b ON a.project = b.project AND b.node = a.node // 2)"""


def issues(deps: DataFrame) -> DataFrame:
    """(project, issue_type, subject, libraries): known conflicts, names with several versions, families with several members, both ends of a web application."""
    by = deps.groupBy("project").agg(F.collect_set(F.concat_ws("/", "ecosystem", "name")).alias("full"), F.collect_set("name").alias("names"))
    found = []
    for e, a, b, kind in CONFLICTS:
        both = F.array_contains("full", f"{e}/{a}") & F.array_contains("full", f"{e}/{b}")
        found.append(F.when(both, F.struct(F.lit(kind).alias("issue_type"), F.lit(f"{a}/{b}").alias("subject"), F.lit(f"{a}, {b}").alias("libraries"))))
    for family, members in FAMILIES.items():
        met = F.filter(F.array(*[F.lit(m) for m in members]), lambda m: F.array_contains(F.col("names"), m))
        found.append(F.when(F.size(met) > 1, F.struct(F.lit("multiple_frameworks").alias("issue_type"), F.lit(family).alias("subject"), F.array_join(met, ", ").alias("libraries"))))
    ends = [F.arrays_overlap("full", F.array(*[F.lit(f"{e}/{n}") for n in ns])) for e, ns in (("python", BACKENDS), ("javascript", FRONTENDS))]
    found.append(F.when(ends[0] & ends[1], F.struct(F.lit("integration_opportunity").alias("issue_type"), F.lit("python/javascript").alias("subject"), F.lit("").alias("libraries"))))
    named = by.select("project", F.explode(F.array_compact(F.array(*found))).alias("x")).select("project", "x.*")
    several = deps.groupBy("project", "name").agg(F.sort_array(F.collect_set("version")).alias("v")).where(F.size("v") > 1)
    return named.unionByName(several.select("project", F.lit("version_conflict").alias("issue_type"), F.col("name").alias("subject"), F.array_join("v", ", ").alias("libraries")))


def _issues_sql() -> str:
    parts = [f"SELECT project, '{k}' AS issue_type, '{a}/{b}' AS subject, '{a}, {b}' AS libraries FROM n WHERE list_contains(f, '{e}/{a}') AND list_contains(f, '{e}/{b}')" for e, a, b, k in CONFLICTS]
    parts += [f"SELECT project, 'multiple_frameworks', '{k}', array_to_string([x FOR x IN {_sql_list(m)} IF list_contains(names, x)], ', ') FROM n WHERE len(list_intersect(names, {_sql_list(m)})) > 1" for k, m in FAMILIES.items()]
    parts.append(f"SELECT project, 'integration_opportunity', 'python/javascript', '' FROM n WHERE list_has_any(f, {_sql_list(['python/' + x for x in BACKENDS])}) AND list_has_any(f, {_sql_list(['javascript/' + x for x in FRONTENDS])})")
    parts.append("SELECT project, 'version_conflict', name, string_agg(DISTINCT version, ', ' ORDER BY version) FROM d GROUP BY project, name HAVING count(DISTINCT version) > 1")
    return f"WITH {_DEPS}, n AS (SELECT project, list(DISTINCT ecosystem || '/' || name) AS f, list(DISTINCT name) AS names FROM d GROUP BY project), i AS ({' UNION ALL '.join(parts)})"


def resolutions(found: DataFrame) -> DataFrame:
    """What to do about versions that differ and families with several members; other issues have no suggestion."""
    version = F.col("issue_type") == "version_conflict"
    some = found.where(version | (F.col("issue_type") == "multiple_frameworks"))
    said = F.when(version, F.concat(F.lit("Unify version specification for "), "subject")).otherwise(F.concat(F.lit("Consider using only one "), "subject"))
    action = F.when(version, "Choose a single version specification that satisfies all requirements").otherwise(F.concat(F.lit("Choose between: "), "libraries"))
    return some.select("project", "issue_type", "subject", said.alias("suggestion"), action.alias("action"))


_RESOLUTIONS_SQL = _issues_sql() + """ SELECT project, issue_type, subject, CASE issue_type WHEN 'version_conflict' THEN 'Unify version specification for ' ELSE 'Consider using only one ' END || subject AS suggestion,
  CASE issue_type WHEN 'version_conflict' THEN 'Choose a single version specification that satisfies all requirements' ELSE 'Choose between: ' || libraries END AS action FROM i WHERE issue_type IN ('version_conflict', 'multiple_frameworks')"""


def circular(deps: DataFrame) -> DataFrame:
    """(project, circular): whether names bring each other in, in a circle (a name that brings itself in is one).

    Edges whose source nothing brings in are peeled off, a table each round, until nothing
    changes; what stays then lies on or below a circle.  The rounds grow with the longest chain.
    """
    above = deps.select("project", F.col("node").alias("parent"), F.col("name").alias("src"))
    left = kept(deps.join(above, ["project", "parent"]).select("project", "src", F.col("name").alias("dst")).distinct(), "cycles")
    n, before = left.count(), -1
    while n and n != before:
        left = kept(left.join(left.select("project", F.col("dst").alias("src")).distinct(), ["project", "src"], "left_semi"), "cycles")
        n, before = left.count(), n
    bad = left.select("project").distinct().withColumn("__circle", F.lit(True))
    return deps.select("project").distinct().join(bad, "project", "left").select("project", F.coalesce("__circle", F.lit(False)).alias("circular"))


_CIRCULAR_SQL = f"WITH RECURSIVE {_DEPS}, e AS MATERIALIZED (SELECT DISTINCT d.project, p.name AS a, d.name AS b FROM d JOIN d p ON p.project = d.project AND p.node = d.parent), r AS (SELECT * FROM e UNION SELECT r.project, r.a, e.b FROM r JOIN e ON e.project = r.project AND e.a = r.b) SELECT project, bool_or(coalesce(r.a = r.b, false)) AS circular FROM (SELECT DISTINCT project FROM d) LEFT JOIN r USING (project) GROUP BY project"


def tree_text(deps: DataFrame) -> DataFrame:
    """(project, n_lines, tree): a project's tree drawn with branches, siblings by node; a level at a time, a table each."""
    line = Window.partitionBy("project", "parent").orderBy("node")
    ranked = kept(deps.select("project", "node", "parent", F.concat_ws(" ", "name", "version").alias("label"), F.row_number().over(line).alias("ord"), F.lead("node").over(line).isNull().alias("last")), "tree")

    def drawn(at: DataFrame, path, prefix) -> DataFrame:
        mark, below = F.when(F.col("last"), "└── ").otherwise("├── "), F.when(F.col("last"), "    ").otherwise("│   ")
        return at.select("project", "node", path.alias("path"), F.concat(prefix, mark, "label", F.lit("\n")).alias("line"), F.concat(prefix, below).alias("prefix"))

    level = kept(drawn(ranked.where("parent is null"), F.array("ord"), F.lit("")), "tree")
    lines = level
    while not level.isEmpty():
        above = level.select("project", F.col("node").alias("parent"), F.col("path").alias("up"), F.col("prefix").alias("before"))
        level = kept(drawn(ranked.join(above, ["project", "parent"]), F.concat("up", F.array("ord")), F.col("before")), "tree")
        lines = lines.unionByName(level)
    sorted_lines = F.array_sort(F.collect_list(F.struct("path", "line")))
    return lines.groupBy("project").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(sorted_lines, lambda x: x["line"]), "").alias("tree"))


_TREE_SQL = f"""WITH RECURSIVE {_DEPS}, k AS MATERIALIZED (SELECT project, node, parent, name || ' ' || version AS label, row_number() OVER w AS ord, lead(node) OVER w IS NULL AS last FROM d WINDOW w AS (PARTITION BY project, parent ORDER BY node)),
t AS (SELECT project, node, [ord] AS path, (CASE WHEN last THEN '└── ' ELSE '├── ' END) || label || chr(10) AS line, CASE WHEN last THEN '    ' ELSE '│   ' END AS prefix FROM k WHERE parent IS NULL
  UNION ALL SELECT k.project, k.node, list_append(t.path, k.ord), t.prefix || (CASE WHEN last THEN '└── ' ELSE '├── ' END) || label || chr(10), t.prefix || CASE WHEN last THEN '    ' ELSE '│   ' END FROM t JOIN k ON k.project = t.project AND k.parent = t.node)
SELECT project, count(*) AS n_lines, string_agg(line, '' ORDER BY path) AS tree FROM t GROUP BY project"""


def _deps(s, d: str) -> DataFrame:
    return order_dependencies(table(s, d, "lineitem"))


QUERIES = {
    "dg_issues": lambda s, d: issues(_deps(s, d)),
    "dg_resolutions": lambda s, d: resolutions(issues(_deps(s, d))),
    "dg_circular": lambda s, d: circular(_deps(s, d)),
    "dg_tree_text": lambda s, d: tree_text(_deps(s, d)),
}
ORACLE = {
    "dg_issues": _issues_sql() + " SELECT * FROM i",
    "dg_resolutions": _RESOLUTIONS_SQL,
    "dg_circular": _CIRCULAR_SQL,
    "dg_tree_text": _TREE_SQL,
}
