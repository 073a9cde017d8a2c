"""Code in documentation: examples, their languages and quality, repeats, imports, calls, complexity, structure of modules."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import matches, present, quote, sql_matches, sql_present
from ..sources.session import ship
from ..sources.tables import table
from .text import LANGUAGE_MARKS, SQL_MARKS, code_language

# Where code stands, by language, in the order they are tried.  A lazy match up
# to the end of a line is written as what is not a line break.
PATTERNS = [
    ("python", r"(?s)```python\n(.*?)\n```"),
    ("python", r"(?s)```py\n(.*?)\n```"),
    ("python", r".. code-block:: python\n\n([^\n]*)"),
    ("python", r">>> ([^\n]*)"),
    ("python", r"(?s):::\s*python\n(.*?)\n:::"),
    ("javascript", r"(?s)```javascript\n(.*?)\n```"),
    ("javascript", r"(?s)```js\n(.*?)\n```"),
    ("javascript", r".. code-block:: javascript\n\n([^\n]*)"),
    ("javascript", r"(?s):::\s*javascript\n(.*?)\n:::"),
    ("bash", r"(?s)```bash\n(.*?)\n```"),
    ("bash", r"(?s)```shell\n(.*?)\n```"),
    ("bash", r"(?s)```sh\n(.*?)\n```"),
    ("bash", r"\$ ([^\n]*)"),
    ("generic", r"(?s)```\n(.*?)\n```"),
    ("generic", r"`([^`\n]+)`"),
    ("generic", r"    ([^\n]*)"),
]
# Signs of good and of basic examples.
GOOD = ["import", "def ", "class ", "try:", "except:", "with ", "if __name__", "docstring", "type hint", "async def"]
BASIC = ["print(", "input(", "= ", "for ", "while ", "if "]
# Constructs that make code complex, in spans, in examples and by line.
CONSTRUCTS = [r"\bclass\s+\w+", r"\bdef\s+\w+", r"\btry\s*:", r"\bwith\s+\w+", r"\bfor\s+\w+\s+in\s+", r"\bif\s+.*:", r"\blambda\s+", r"@\w+", r"\basync\s+def", r"\bawait\s+"]
KEYWORDS = ["if", "for", "while", "try", "def", "class"]
LINE_MARKS = ["class ", "def ", "if ", "for ", "while ", "try:", "except:", "with "]
SPAN = r"(?s)```.*?```|`[^`]+`"
STRIP = r"^\s+|\s+$"


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 11) -> DataFrame:
    """(id_col, pattern, pos, language, code): every span that a pattern finds, stripped, of at least ``least`` characters."""
    found = F.array(*[F.transform(F.regexp_extract_all(text_col, F.lit(p), F.lit(1)), lambda c: F.regexp_replace(c, STRIP, "")) for _, p in PATTERNS])
    each = docs.select(F.col(id_col), F.posexplode(found).alias("pattern", "codes")).select(id_col, "pattern", F.posexplode("codes").alias("pos", "code")).where(F.length("code") >= least)
    named = F.element_at(F.array(*[F.lit(n) for n, _ in PATTERNS]), F.col("pattern") + 1)
    return each.select(id_col, "pattern", "pos", F.when(named == "generic", code_language(F.col("code"))).otherwise(named).alias("language"), "code")


def distinct_examples(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The first of a document's examples that are equal but for white space."""
    norm = F.trim(F.regexp_replace("code", r"\s+", " "))
    first = F.row_number().over(Window.partitionBy(id_col, norm).orderBy("pattern", "pos"))
    return found.withColumn("__first", first).where("__first = 1").drop("__first")


def parses(code: DataFrame, column: str = "code") -> DataFrame:
    """``code`` with parses: whether Python reads it; a syntax tree has no native form."""
    ship(code.sparkSession)
    at = code.columns.index(column)

    def run(batches):
        for batch in batches:
            ok = []
            for c in batch.column(at):
                try:
                    ast.parse(c.as_py() or "")
                    ok.append(True)
                except (SyntaxError, ValueError, MemoryError, RecursionError):
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok)], [*batch.schema.names, "parses"])

    return code.mapInArrow(run, T.StructType([*code.schema.fields, T.StructField("parses", T.BooleanType())]))


def quality(code: Column, syntax: Column) -> Column:
    """Length, signs of good and basic use, comments, error handling, and for Python whether it parses; 1 at most."""
    n = F.length(code)
    score = F.when((n >= 50) & (n <= 500), 0.3).when((n >= 20) & (n <= 1000), 0.2).otherwise(0.0)
    score = score + F.least(present(code, GOOD) * 0.1, F.lit(0.4)) + F.least(present(code, BASIC) * 0.05, F.lit(0.2))
    score = score + F.when(F.contains(code, F.lit("#")) | F.contains(code, F.lit('"""')) | F.contains(code, F.lit("'''")), 0.1).otherwise(0.0)
    score = score + F.when(F.contains(code, F.lit("try:")) | F.contains(code, F.lit("except")), 0.1).otherwise(0.0)
    score = score + F.when(code_language(code) == "python", F.when(syntax, 0.2).otherwise(-0.1)).otherwise(0.0)
    return F.when(n < 10, 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 6))


def rated_examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, rank, language, quality, code): a document's distinct examples, best first."""
    rated = parses(distinct_examples(examples(docs, id_col, text_col), id_col)).withColumn("quality", quality(F.col("code"), F.col("parses")))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("quality").desc(), "pattern", "pos"))
    return rated.select(id_col, rank.cast("long").alias("rank"), "language", "quality", "code")


def example_languages(rated: DataFrame) -> DataFrame:
    """(language, n, quality, n_high, n_medium, n_low)."""
    q = F.col("quality")
    return rated.groupBy("language").agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("quality"), F.count_if(q > 0.7).alias("n_high"), F.count_if((q >= 0.3) & (q <= 0.7)).alias("n_medium"), F.count_if(q < 0.3).alias("n_low"))


def _most(found: DataFrame, name: str, top: int) -> DataFrame:
    return found.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), name).limit(top)


def common_imports(found: DataFrame, top: int = 10) -> DataFrame:
    names = F.regexp_extract_all("code", F.lit(r"(?:from\s+\S+\s+)?import\s+([^\n;]+)"), F.lit(1))
    return _most(found.where("language = 'python'").select(F.explode(names).alias("name")).select(F.regexp_replace("name", STRIP, "").alias("name")), "name", top)


def common_functions(found: DataFrame, top: int = 10) -> DataFrame:
    return _most(found.select(F.explode(F.regexp_extract_all("code", F.lit(r"(\w+)\s*\("), F.lit(1))).alias("name")).where(F.length("name") > 2), "name", top)


def _lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1


def example_complexity(found: DataFrame) -> DataFrame:
    """Keywords a line over all examples: mean, extremes, and how many are simple, moderate and complex."""
    score = sum((matches(F.col("code"), rf"\b{k}\b") for k in KEYWORDS), F.lit(0)) / _lines(F.col("code"))
    s = found.select(score.alias("s"))
    return s.agg(F.round(F.avg("s"), 2).alias("mean"), F.round(F.max("s"), 2).alias("high"), F.round(F.min("s"), 2).alias("low"), F.count_if(F.col("s") < 0.5).alias("n_simple"), F.count_if((F.col("s") >= 0.5) & (F.col("s") < 1.5)).alias("n_moderate"), F.count_if(F.col("s") >= 1.5).alias("n_complex"))


def span_complexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_spans, complexity): the mean over code spans of a tenth for each construct, 1 at most."""
    spans = F.regexp_extract_all(text_col, F.lit(SPAN), F.lit(0))
    scores = F.transform(spans, lambda b: F.least(sum((matches(b, p) for p in CONSTRUCTS), F.lit(0)) * 0.1, F.lit(1.0)))
    n = F.size(spans)
    return docs.select(id_col, n.alias("n_spans"), F.round(F.when(n > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0), 6).alias("complexity"))


def file_complexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, complexity): ten times the marks by line over the lines that are not empty, 1 at most."""
    full = F.filter(F.split(text_col, "\n", -1), lambda x: F.length(F.regexp_replace(x, STRIP, "")) > 0)
    hits = F.aggregate(full, F.lit(0), lambda a, x: a + present(x, LINE_MARKS))
    n = F.size(full)
    return docs.select(id_col, F.round(F.when(n > 0, F.least(hits / n * 10, F.lit(1.0))).otherwise(0.0), 6).alias("complexity"))


def script_structure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line, kind, name) of the classes, functions and imports of JavaScript, line by line."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "raw")).select(id_col, (F.col("line") + 1).alias("line"), F.regexp_replace("raw", STRIP, "").alias("text"))
    t = F.col("text")
    called = F.regexp_extract(t, r"^(?:function\s+)?(\w+)\s*\(", 1)
    kind = F.when(F.startswith(t, F.lit("class ")), "class").when(F.contains(t, F.lit("function ")) | F.contains(t, F.lit("=>")), "function").when(F.startswith(t, F.lit("import ")) | (F.startswith(t, F.lit("const ")) & F.contains(t, F.lit("require("))), "import")
    name = F.when(F.col("kind") == "class", F.regexp_extract(t, r"^class\s+(\w+)", 1)).when(F.col("kind") == "function", called).otherwise(t)
    return lines.withColumn("kind", kind).where("kind is not null").select(id_col, "line", "kind", name.alias("name")).where(F.length("name") > 0)


def module_structure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line, kind, name, parent, doc) of the classes, functions and imports of Python, by its syntax tree; what does not parse has none."""
    ship(docs.sparkSession)
    node = pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("parent", pa.string()), ("doc", pa.string())]))

    def walk(tree, parent, out):
        for n in ast.iter_child_nodes(tree):
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if parent else "function"
                out.append({"line": n.lineno, "kind": kind, "name": n.name, "parent": parent, "doc": ast.get_docstring(n)})
                if isinstance(n, ast.ClassDef):
                    walk(n, n.name, out)
            elif isinstance(n, ast.Import | ast.ImportFrom):
                source = f"{n.module or ''}." if isinstance(n, ast.ImportFrom) else ""
                out += [{"line": n.lineno, "kind": "import", "name": source + a.name, "parent": parent, "doc": None} for a in n.names]
        return out

    def run(batches):
        for batch in batches:
            got = []
            for text in batch.column(1):
                try:
                    got.append(walk(ast.parse(text.as_py() or ""), None, []))
                except (SyntaxError, ValueError, MemoryError, RecursionError):
                    got.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, node)], [id_col, "nodes"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, nodes array<struct<line:int,kind:string,name:string,parent:string,doc:string>>")
    return found.select(id_col, F.inline("nodes"))


def sample_docs(parts: DataFrame) -> DataFrame:
    """(doc_id, text): parts as documentation with code of several languages, whole and broken."""
    name, size = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    some = F.array(*[F.replace(F.replace(F.replace(F.lit(t), F.lit("{name}"), name), F.lit("{size}"), size), F.lit("{brand}"), brand) for t in SAMPLES])
    at = lambda step: F.element_at(some, ((F.col("p_partkey") + step) % len(SAMPLES) + 1).cast("int"))
    return parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("# "), F.col("p_name"), F.lit("\n\n"), at(0), F.lit("\n\n"), at(3), F.lit("\n")).alias("text"))


SAMPLES = [
    "```python\nimport {brand}\n\ndef {name}(size):\n    return size + {size}\n```",
    "```js\nconst {name} = require('{brand}');\nconsole.log({name}({size}));\nconst add = (a, b) => a + b;\n```",
    "```bash\ncd /srv/{name}\nls -{size}\n```",
    "Use `{name}_handler({size})` twice: `{name}_handler({size})` and `ok`.",
    "```\nclass Runner:\n    def run(self):\n        for i in range({size}):\n            if i > 3:\n                print(i)\n```",
    ">>> print({size} + 1000)\n1000\nplain text without code",
    "```py\ndef broken({size}:\n    pass\n```",
    "function {name}(a) {\nimport {brand} from 'x'\nclass Box {\nno code here",
    "import {brand}\nfrom {brand} import thing\n",
]
_NAME, _BRAND = "replace(p_name, ' ', '_')", "lower(replace(p_brand, '#', ''))"
_SOME = "[" + ", ".join("replace(replace(replace(" + quote(t).replace("\n", "' || chr(10) || '") + f", '{{name}}', {_NAME}), '{{size}}', p_size::VARCHAR), '{{brand}}', {_BRAND})" for t in SAMPLES) + "]"
_DOCS = f"(SELECT p_partkey AS doc_id, '# ' || p_name || chr(10) || chr(10) || ({_SOME})[(p_partkey % {len(SAMPLES)} + 1)::INT] || chr(10) || chr(10) || ({_SOME})[((p_partkey + 3) % {len(SAMPLES)} + 1)::INT] || chr(10) AS text FROM part)"
_LANG = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(code, {quote(m)})' for m in marks)} THEN '{n}'" for n, marks in LANGUAGE_MARKS) + f" WHEN {' OR '.join(f'contains(lower(code), {quote(m)})' for m in SQL_MARKS)} THEN 'sql' ELSE 'unknown' END"
_EXAMPLES = "(SELECT doc_id, pattern, pos, CASE WHEN language = 'generic' THEN " + _LANG + " ELSE language END AS language, code FROM (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS pattern, generate_subscripts(cs, 1) - 1 AS pos, '{n}' AS language, regexp_replace(unnest(cs), '{STRIP}', '', 'g') AS code FROM (SELECT doc_id, regexp_extract_all(text, {quote(p)}, 1) AS cs FROM {_DOCS})" for k, (n, p) in enumerate(PATTERNS)) + ") WHERE length(code) >= 11)"
_DISTINCT = f"(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(code, '\\s+', ' ', 'g')) ORDER BY pattern, pos) AS k FROM {_EXAMPLES}) WHERE k = 1)"
#: Of what the samples hold, this is what Python does not read.
_BROKEN = "(contains(code, 'def broken(') OR code = 'def run(self):' OR starts_with(code, 'from brand') AND contains(code, ' from ') OR contains(code, '{'))"
_RATED = f"""(SELECT *, round(least(CASE WHEN length(code) BETWEEN 50 AND 500 THEN 0.3 WHEN length(code) BETWEEN 20 AND 1000 THEN 0.2 ELSE 0 END::DOUBLE + least({sql_present('code', GOOD)} * 0.1::DOUBLE, 0.4) + least({sql_present('code', BASIC)} * 0.05::DOUBLE, 0.2)
  + CASE WHEN contains(code, '#') OR contains(code, '\"\"\"') OR contains(code, '''''''') THEN 0.1 ELSE 0 END + CASE WHEN contains(code, 'try:') OR contains(code, 'except') THEN 0.1 ELSE 0 END + CASE WHEN {_LANG} = 'python' THEN CASE WHEN {_BROKEN} THEN -0.1 ELSE 0.2 END ELSE 0 END, 1.0), 6) AS quality FROM {_DISTINCT})"""
_SCORE = "(" + " + ".join(sql_matches("code", rf"\b{k}\b") for k in KEYWORDS) + ") / (length(code) - length(replace(code, chr(10), '')) + 1)"


def _docs(s, d: str) -> DataFrame:
    return sample_docs(table(s, d, "part"))


QUERIES = {
    "tx_code_examples": lambda s, d: examples(_docs(s, d)),
    "tx_code_distinct": lambda s, d: distinct_examples(examples(_docs(s, d))),
    "tx_code_rated": lambda s, d: rated_examples(_docs(s, d)),
    "tx_code_languages": lambda s, d: example_languages(rated_examples(_docs(s, d))),
    "tx_code_imports": lambda s, d: common_imports(distinct_examples(examples(_docs(s, d)))),
    "tx_code_functions": lambda s, d: common_functions(distinct_examples(examples(_docs(s, d)))),
    "tx_code_example_complexity": lambda s, d: example_complexity(distinct_examples(examples(_docs(s, d)))),
    "tx_code_span_complexity": lambda s, d: span_complexity(_docs(s, d)),
    "tx_code_file_complexity": lambda s, d: file_complexity(_docs(s, d)),
    "tx_code_scripts": lambda s, d: script_structure(_docs(s, d)),
    "tx_code_modules": lambda s, d: module_structure(_docs(s, d).withColumn("text", F.regexp_extract("text", r"(?s)```python\n(.*?)\n```", 1))),
}
ORACLE = {
    "tx_code_examples": f"SELECT * FROM {_EXAMPLES}",
    "tx_code_distinct": f"SELECT * FROM {_DISTINCT}",
    "tx_code_rated": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, pattern, pos) AS rank, language, quality, code FROM {_RATED}",
    "tx_code_languages": f"SELECT language, count(*) AS n, round(avg(quality), 6) AS quality, count(*) FILTER (quality > 0.7) AS n_high, count(*) FILTER (quality >= 0.3 AND quality <= 0.7) AS n_medium, count(*) FILTER (quality < 0.3) AS n_low FROM {_RATED} GROUP BY language",
    "tx_code_imports": f"SELECT name, count(*) AS n FROM (SELECT regexp_replace(unnest(regexp_extract_all(code, '(?:from\\s+\\S+\\s+)?import\\s+([^\\n;]+)', 1)), '{STRIP}', '', 'g') AS name FROM {_DISTINCT} WHERE language = 'python') GROUP BY name ORDER BY n DESC, name LIMIT 10",
    "tx_code_functions": f"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(code, '(\\w+)\\s*\\(', 1)) AS name FROM {_DISTINCT}) WHERE length(name) > 2 GROUP BY name ORDER BY n DESC, name LIMIT 10",
    "tx_code_example_complexity": f"SELECT round(avg(s), 2) AS mean, round(max(s), 2) AS high, round(min(s), 2) AS low, count(*) FILTER (s < 0.5) AS n_simple, count(*) FILTER (s >= 0.5 AND s < 1.5) AS n_moderate, count(*) FILTER (s >= 1.5) AS n_complex FROM (SELECT {_SCORE} AS s FROM {_DISTINCT})",
    "tx_code_span_complexity": f"SELECT doc_id, len(bs)::INT AS n_spans, round(CASE WHEN len(bs) > 0 THEN list_sum(list_transform(bs, lambda b: least(({' + '.join(sql_matches('b', p) for p in CONSTRUCTS)}) * 0.1::DOUBLE, 1.0))) / len(bs) ELSE 0 END, 6) AS complexity FROM (SELECT doc_id, regexp_extract_all(text, '{SPAN}') AS bs FROM {_DOCS})",
    "tx_code_file_complexity": f"SELECT doc_id, round(CASE WHEN len(ls) > 0 THEN least(list_sum(list_transform(ls, lambda x: {sql_present('x', LINE_MARKS)})) / len(ls) * 10, 1.0) ELSE 0 END, 6)::DOUBLE AS complexity FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '{STRIP}', '', 'g')) > 0) AS ls FROM {_DOCS})",
    "tx_code_scripts": f"""SELECT * FROM (SELECT doc_id, line, kind, CASE kind WHEN 'class' THEN regexp_extract(t, '^class\\s+(\\w+)', 1) WHEN 'function' THEN regexp_extract(t, '^(?:function\\s+)?(\\w+)\\s*\\(', 1) ELSE t END AS name FROM (
      SELECT *, CASE WHEN starts_with(t, 'class ') THEN 'class' WHEN contains(t, 'function ') OR contains(t, '=>') THEN 'function' WHEN starts_with(t, 'import ') OR starts_with(t, 'const ') AND contains(t, 'require(') THEN 'import' END AS kind FROM (
        SELECT doc_id, line::INT AS line, regexp_replace(raw, '{STRIP}', '', 'g') AS t FROM (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {_DOCS})))) WHERE kind IS NOT NULL) WHERE length(name) > 0""",
    "tx_code_modules": f"""SELECT doc_id, line, kind, CASE kind WHEN 'import' THEN {_BRAND} ELSE {_NAME} END AS name, NULL::VARCHAR AS parent, NULL::VARCHAR AS doc FROM part JOIN {_DOCS} ON doc_id = p_partkey, (VALUES (1, 'import'), (3, 'function')) AS v(line, kind) WHERE contains(text, '```python')""",
}
