"""Tables rendered as what parsers read: orders as projects with requirement lines, files and manifests, documents as markup.

Every order, part of it or document becomes one, so that queries that parse them read whole tables; the SQL
beside each function says the same, or what the parser must give back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import quote

#: Names of libraries and paths of files that an order's lines stand for.
LIBRARIES = ["requests", "urllib3", "fastapi", "starlette", "django", "flask", "tornado", "numpy", "pandas", "pytest", "react", "vue", "axios", "uvicorn", "httpx", "redis", "my.lib_x", "a-b"]
PATHS = ["README.md", "requirements.txt", "docs/api/index.md", "docs/guide/start.md", "setup.py", "LICENSE", "examples/demo.py", "docs/a/b/c.md", "package.json", "src/app.js", "CHANGELOG.md", "docs/logo.png", "Makefile", "config/settings.ini", "Cargo.toml", "go.mod", "pom.xml"]
#: Forms of a requirement line: {n} is the library, {v} a number.
LINES = ["{n}>=1.{v}", "{n}==2.{v}", "{n}[extra]~=1.{v}", "{n} # pinned later", "git+https://example.com/{n}.git#egg={n}", "# only {n}", "  {n}!=0.{v}  ", "{n}"]


def _pick(options: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(at, F.lit(len(options))) + 1).cast("int"))


def _sql_pick(options: list[str], at: str) -> str:
    return f"[{', '.join(map(quote, options))}][(({at}) % {len(options)} + 1)::INT]"


def projects(lineitem: DataFrame) -> DataFrame:
    """(project, requirements, files): a project for each order, a requirement line and a file for each of its lines."""
    line = F.replace(F.replace(_pick(LINES, F.col("l_suppkey")), F.lit("{n}"), _pick(LIBRARIES, F.col("l_partkey"))), F.lit("{v}"), F.col("l_linenumber").cast("string"))
    rows = lineitem.where("l_orderkey is not null").select("l_orderkey", F.struct("l_linenumber", line.alias("line"), _pick(PATHS, F.col("l_partkey") + F.col("l_suppkey")).alias("file")).alias("x"))
    each = rows.groupBy(F.col("l_orderkey").alias("project")).agg(F.sort_array(F.collect_list("x")).alias("xs"))  # an order has a few lines
    return each.select("project", F.array_join("xs.line", "\n").alias("requirements"), F.array_join("xs.file", ",").alias("files"))


_LINE_SQL = f"replace(replace({_sql_pick(LINES, 'l_suppkey')}, '{{n}}', {_sql_pick(LIBRARIES, 'l_partkey')}), '{{v}}', l_linenumber::VARCHAR)"
PROJECTS_SQL = f"(SELECT l_orderkey AS project, string_agg(line, chr(10) ORDER BY l_linenumber, line, file) AS requirements, string_agg(file, ',' ORDER BY l_linenumber, line, file) AS files FROM (SELECT l_orderkey, l_linenumber, {_LINE_SQL} AS line, {_sql_pick(PATHS, 'l_partkey + l_suppkey')} AS file FROM lineitem) GROUP BY l_orderkey) AS p"


def dependencies(lineitem: DataFrame) -> DataFrame:
    """(id, name, version, dev): each library of an order once."""
    name = F.concat(_pick(LIBRARIES, F.col("l_partkey")), F.lit("-"), (F.col("l_suppkey") % 7).cast("string"))
    return lineitem.where("l_orderkey is not null").groupBy(F.col("l_orderkey").alias("id"), name.alias("name")).agg(F.concat(F.lit("1."), F.min("l_linenumber").cast("string")).alias("version")).withColumn("dev", F.endswith("name", F.lit("3")))


DEPENDENCIES_SQL = f"(SELECT l_orderkey AS id, {_sql_pick(LIBRARIES, 'l_partkey')} || '-' || (l_suppkey % 7) AS name, '1.' || min(l_linenumber) AS version, ends_with(name, '3') AS dev FROM lineitem GROUP BY l_orderkey, name)"


def _sides(lineitem: DataFrame, text: Column) -> DataFrame:
    """(id, run, dev): the entries of both sides of each order, in order of name."""
    by = dependencies(lineitem).withColumn("t", text)
    entries = lambda dev: F.transform(F.array_sort(F.collect_list(F.when(F.col("dev") == dev, F.struct("name", "t")))), lambda x: x["t"])
    return by.groupBy("id").agg(entries(False).alias("run"), entries(True).alias("dev"))


def package_manifests(lineitem: DataFrame) -> DataFrame:
    """(id, content): a package manifest for each order; one of eleven is broken."""
    sides = _sides(lineitem, F.concat(F.lit('"'), F.col("name"), F.lit('": "'), F.col("version"), F.lit('"')))
    made = F.concat(F.lit('{"name": "p", "dependencies": {'), F.array_join("run", ", "), F.lit('}, "devDependencies": {'), F.array_join("dev", ", "), F.lit("}}"))
    return sides.select("id", F.when(F.col("id") % 11 == 0, F.lit("{broken")).otherwise(made).alias("content"))


def toml_manifests(lineitem: DataFrame) -> DataFrame:
    """(id, content): Cargo manifests of even orders, project files of odd ones; one of eleven is broken."""
    name, version = F.regexp_replace("name", r"\.", "_"), F.col("version")
    cargo = F.when(F.col("id") % 4 == 0, F.concat(name, F.lit(' = "'), version, F.lit('"'))).otherwise(F.concat(name, F.lit(' = {version = "'), version, F.lit('", optional = true}')))
    project = F.concat(F.lit('"'), name, F.when(F.col("dev"), F.lit("")).otherwise(F.concat(F.lit("[all] >= "), version)), F.lit('"'))
    sides = _sides(lineitem, F.when(F.col("id") % 2 == 0, cargo).otherwise(project))
    made = F.when(F.col("id") % 2 == 0, F.concat(F.lit("[dependencies]\n"), F.array_join("run", "\n"), F.lit("\n[dev-dependencies]\n"), F.array_join("dev", "\n"))).otherwise(F.concat(F.lit('[project]\nname = "p"\ndependencies = ['), F.array_join("run", ", "), F.lit("]\n[build-system]\nrequires = ["), F.array_join("dev", ", "), F.lit("]")))
    return sides.select("id", F.when(F.col("id") % 11 == 0, F.lit("broken [")).otherwise(made).alias("content"))


TOML_SQL = f"SELECT id, replace(name, '.', '_') AS name, CASE WHEN id % 2 = 0 THEN version WHEN dev THEN '' ELSE '>= ' || version END AS version, CASE WHEN NOT dev THEN 'runtime' WHEN id % 2 = 0 THEN 'dev' ELSE 'build' END AS kind FROM {DEPENDENCIES_SQL} WHERE id % 11 <> 0"
PACKAGE_SQL = f"SELECT id, name, version, dev FROM {DEPENDENCIES_SQL} WHERE id % 11 <> 0"


def failed_calls(events: DataFrame) -> DataFrame:
    """(user_id, event_id, attempt): each user's errors as attempts of one call, counted from 0."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.where("event_type = 'error' and user_id is not null").select("user_id", "event_id", (F.row_number().over(line) - 1).cast("long").alias("attempt"))
