"""Small fixtures with values worked out by hand."""

from pyspark.sql import functions as F

from lorespark.operators import dependencies, graph, history, models, operations, text, web


def test_similarity_of_kitten_and_sitting(spark):
    row = spark.createDataFrame([("kitten", "sitting")], "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert abs(row["s"] - (1 - 3 / 7)) < 1e-12


def test_requirement_lines(spark):
    df = spark.createDataFrame([(1, "requests>=2.28.0\nnumpy # fast\nhttps://x.org/y\n\nuvicorn[standard]>=0.1")], "project long, requirements string")
    assert sorted(map(tuple, graph.parse_requirements(df).collect())) == [(1, "numpy", ""), (1, "requests", ">=2.28.0"), (1, "uvicorn", ">=0.1")]


def test_depths_of_a_chain_and_of_a_cycle(spark):
    edges = spark.createDataFrame([(i, i - 1 if i else None) for i in range(50)] + [(100, 101), (101, 100)], "child long, parent long")
    got = {r["child"]: (r["root"], r["depth"]) for r in graph.depths(edges).collect()}
    assert got == {i: (0, i) for i in range(50)}


def test_depths_of_a_chain_of_any_length_beside_a_cycle(spark):
    edges = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)], "child long, parent long")
    assert {r["child"]: (r["root"], r["depth"]) for r in graph.depths(edges).collect()} == {i: (0, i) for i in range(300)}


def test_urls_normalise_once(spark):
    urls = ["HTTP://Example.com:80/a//b?z=1&a=2#f", "https://x.org", "https://x.org:8443/p?q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(web.normalize(F.col("url")).alias("url"))
    once = [r["url"] for r in df.collect()]
    assert once == ["http://example.com/a/b?a=2&z=1", "https://x.org/", "https://x.org:8443/p?q"]
    assert [r["url"] for r in df.select(web.normalize(F.col("url")).alias("url")).collect()] == once


def test_versions_compare_by_number(spark):
    df = spark.createDataFrame([("v1.10.0", "1.9"), ("2", "2.0.0"), ("x", "0")], "a string, b string")
    got = df.select((history.version_key(F.col("a")) > history.version_key(F.col("b"))).alias("g")).collect()
    assert [r["g"] for r in got] == [True, False, False]


def test_page_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "url string, body string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "url string, body string")
    assert dict(map(tuple, history.page_diff(old, new, "url", "body").collect())) == {"a": "removed", "b": "same", "c": "modified", "d": "added"}


def test_structure_of_a_page(spark):
    page = "<html><body><script>x</script><h1>T</h1><p>a <a href='/x'>l</a> b</p></body></html>"
    rows = models.structure(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(r["type"], r["text"], r["href"]) for r in sorted(rows, key=lambda r: r["seq"])] == [("h1", "T", None), ("p", "a", None), ("a", "l b", "/x")]


def test_unified_diff(spark):
    row = models.unified_diffs(spark.createDataFrame([(1, "a\nb", "a\nc\nd")], "id long, old string, new string")).first()
    assert (row["added"], row["removed"]) == (2, 1)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_crawl_takes_every_page_once_whatever_the_circles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    assert sorted(map(tuple, graph.frontier(links, seeds).collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    assert sorted(map(tuple, graph.frontier(links, seeds, budget=1).collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert graph.frontier(links, seeds.limit(0)).count() == 0


def test_links_of_every_form_become_urls(spark):
    html = '<a href="/x#top"></a><a href="y"></a><a href="https://b.org/z"></a><a href="mailto:q@b.org"></a>'
    pages = spark.createDataFrame([(1, "https://a.org/d/e?q#f", html)], "page_id long, url string, html string")
    assert sorted(r["dst"] for r in graph.url_links(pages).collect()) == ["https://a.org/d/y", "https://a.org/x", "https://b.org/z"]


def _deps(spark, rows):
    return spark.createDataFrame(rows, "project long, node long, ecosystem string, name string, version string, parent long")


def test_issues_circles_and_trees_of_dependencies(spark):
    rows = [(1, 1, "python", "django", ">=4", None), (1, 2, "javascript", "react", ">=18", 1), (1, 3, "python", "django", ">=5", 2), (2, 1, "python", "numpy", "", None), (2, 2, "python", "pytest", ">=8", 1), (2, 3, "python", "flask", ">=3", None)]
    deps = _deps(spark, rows)
    found = {(r["project"], r["issue_type"], r["subject"], r["libraries"]) for r in dependencies.issues(deps).collect()}
    assert found == {(1, "integration_opportunity", "python/javascript", ""), (1, "version_conflict", "django", ">=4, >=5")}
    assert [r["suggestion"] for r in dependencies.resolutions(dependencies.issues(deps)).collect()] == ["Unify version specification for django"]
    assert {r["project"]: r["circular"] for r in dependencies.circular(deps).collect()} == {1: True, 2: False}
    trees = {r["project"]: r["tree"] for r in dependencies.tree_text(deps).collect()}
    assert trees[1] == "└── django >=4\n    └── react >=18\n        └── django >=5\n"
    assert trees[2] == "├── numpy \n│   └── pytest >=8\n└── flask >=3\n"
    none = _deps(spark, [])
    assert [f(none).count() for f in (dependencies.issues, dependencies.circular, dependencies.tree_text)] == [0, 0, 0]


def test_a_breaker_opens_waits_and_closes(spark):
    calls = [(1, 0, 0, True), (1, 1, 10, True), (1, 2, 20, False), (1, 3, 120, False), (1, 4, 130, True), (1, 5, 140, True), (1, 6, 150, False), (2, 7, 0, True), (2, 8, 1, False), (2, 9, 2, True)]
    df = spark.createDataFrame(calls, "user_id long, event_id long, us long, failed boolean")
    got = {r["event_id"]: (r["allowed"], r["state"]) for r in operations.circuit_breaker(df, failures=2, reset_us=100).collect()}
    assert got == {0: (True, "closed"), 1: (True, "open"), 2: (False, "open"), 3: (True, "closed"), 4: (True, "closed"), 5: (True, "open"), 6: (False, "open"), 7: (True, "closed"), 8: (True, "closed"), 9: (True, "closed")}
    waits = {r["event_id"]: r["waited"] for r in operations.rate_limit(df.where("user_id = 1"), most=2, period_us=200).collect()}
    assert waits == {0: False, 1: False, 2: True, 3: True, 4: True, 5: True, 6: True}
