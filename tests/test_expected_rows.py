"""Rows stated by hand, so that a wrong constant cannot hide behind SQL made from it."""

import ast

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import code, discovery, markup, models, repos, search, text, urls, web
from lorespark.sources import tables


def test_links_resolve_as_rfc_3986_says(spark):
    base = "http://a/b/c/d;p?q"
    want = {
        "g": "http://a/b/c/g",
        "./g": "http://a/b/c/g",
        "g/": "http://a/b/c/g/",
        "/g": "http://a/g",
        "//g": "http://g",
        "?y": "http://a/b/c/d;p?y",
        "g?y": "http://a/b/c/g?y",
        "#s": "http://a/b/c/d;p?q#s",
        "g#s": "http://a/b/c/g#s",
        ";x": "http://a/b/c/;x",
        "": "http://a/b/c/d;p?q",
        ".": "http://a/b/c/",
        "./": "http://a/b/c/",
        "..": "http://a/b/",
        "../g": "http://a/b/g",
        "../..": "http://a/",
        "../../g": "http://a/g",
        "../../../g": "http://a/g",
        "/./g": "http://a/g",
        "/../g": "http://a/g",
        "./g/.": "http://a/b/c/g/",
        "g/./h": "http://a/b/c/g/h",
        "g/../h": "http://a/b/c/h",
    }
    df = spark.createDataFrame([(k, v) for k, v in want.items()], "link string, want string")
    got = {r["link"]: r["got"] for r in df.select("link", urls.resolve(F.lit(base), F.col("link"), keep_fragment=True).alias("got")).collect()}
    assert got == want


def test_hosts_that_must_not_be_asked(spark):
    rows = [(1, "https://example.org/", k, link) for k, link in enumerate(["http://localhost/", "http://169.254.169.254/", "http://10.1.2.3/", "http://172.32.0.1/", "http://a:b@c.example/", "http://single/", "http://bad-.example/", "http://x.y/", "http://fine.example:99999/", "/own"])]
    got = [r["error"] for r in urls.hosts_checked(spark.createDataFrame(rows, "page_id long, url string, pos int, link string")).orderBy("pos").collect()]
    assert got == ["forbidden", "forbidden", "private", None, "credentials", "single label", "label", "top level", "port", None]


def test_a_page_is_taken_apart():
    page = """<html><head><meta property="og:title" content="T"><meta http-equiv="refresh" content="0; url='/next'"></head><body><h2>two</h2><h1> one <b>more</b></h1>
    <table><tr><td>a</td><td>b</td></tr><tr><th>c</th><td>d<br>e</td></tr></table><pre class="lang-java"><code>int x;</code></pre><p>x<p>y <code>z</code></p><script>var a = "<p>no</p>";</script></body></html>"""
    got = markup.extract_page(page)
    meta = {m["name"]: m["value"] for m in got["metadata"]}
    assert meta == {"og:title": "T", "meta_redirects": "/next", "title": "one more"}
    assert got["headings"] == [{"level": 1, "text": "one more"}, {"level": 2, "text": "two"}]
    assert got["tables"] == [{"headers": ["a", "b"], "rows": [["c", "de"]]}]
    assert got["code"] == [{"language": "java", "code": "int x;"}]
    assert got["markdown"].endswith("```java\nint x;\n```\n\nx\n\ny `z`") and "no" not in got["text"]
    assert markup.extract_page(None)["markdown"] == "" and markup.extract_page("")["text"] == ""
    deep = markup.extract_page("<div>" * 400 + "x" + "</div>" * 400)
    assert deep["text"] == "x"


def test_what_python_reads(spark):
    some = ["x = 1", "def f(:", "print('a')", "", "if x:\n  y"]
    got = [r["parses"] for r in code.parses(spark.createDataFrame([(c,) for c in some], "code string")).collect()]
    want = []
    for c in some:
        try:
            ast.parse(c)
            want.append(True)
        except SyntaxError:
            want.append(False)
    assert got == want


def test_examples_and_their_quality(spark):
    doc = "```python\nimport os\ndef f():\n    return os\n```\nthen `os.getcwd() now`\n$ ls -la /srv/data\n"
    rated = {r["code"]: (r["language"], r["quality"]) for r in code.rated_examples(spark.createDataFrame([(1, doc)], "doc_id long, text string")).collect()}
    assert rated["import os\ndef f():\n    return os"] == ("python", 0.6)  # 20 to 1000 characters 0.2, two good signs 0.2, parses 0.2
    assert rated["ls -la /srv/data"][0] == "bash" and rated["os.getcwd() now"][0] == "unknown"


def test_types_of_projects(spark):
    files = [("a", p, 10) for p in ("setup.py", "src/x.py", "app.csproj", "README.md")] + [("b", "Gemfile", 10), ("b", "composer.json", 10)]
    got = {(r["repo"], r["type"]): r["score"] for r in repos.type_scores(spark.createDataFrame(files, "repo string, path string, size long")).collect()}
    assert got == {("a", "python"): 9, ("a", "rust"): 2, ("a", "csharp"): 3, ("b", "ruby"): 5, ("b", "php"): 5}


def test_sections_by_title_and_content(spark):
    doc = "before\n# Installation\nx\n## License\nfree\n## Other\nusage of the api\n"
    got = [(r["section"], r["level"], r["title"], r["is_relevant"]) for r in discovery.markdown_sections(spark.createDataFrame([(1, doc)], "doc_id long, text string")).orderBy("section").collect()]
    assert got == [(0, 0, "Introduction", True), (1, 1, "Installation", True), (2, 2, "License", False), (3, 2, "Other", True)]


def test_words_and_categories_are_the_published_ones(spark):
    assert len(text.STOP) == 39 and {"but", "their", "would"} <= set(text.STOP)
    assert len(tables.MIME) == 28 and tables.MIME["ps1"] == "text/x-powershell"
    assert "Page Not Found" in web.ERROR_TITLES and "502 Bad Gateway" not in web.ERROR_TITLES
    assert search.CATEGORIES["api"] == ["api", "endpoint", "rest", "graphql"]


@pytest.mark.parametrize(("kind", "message", "want"), [(1, 0, "parsing"), (0, 0, "network")])
def test_errors(spark, kind, message, want):
    event = next(k for k in range(45) if k % 9 == kind and k % 5 == message)
    got = discovery.error_categories(spark.createDataFrame([(event,)], "event_id long")).collect()
    assert [(r["category"], r["n"]) for r in got] == [(want, 1)]


def test_tags_that_occur_together(spark):
    docs = spark.createDataFrame([(1, "a", "spark license table"), (2, "b", "license table index"), (3, "c", "table licensed"), (4, None, "license nothing")], "doc_id int, source string, text string")
    got = [(r["tag"], r["together"], r["total_usage"], r["score"]) for r in search.related_tags(docs, "license").collect()]
    assert got == [("table", 2, 3, 1.0), ("index", 1, 1, 0.5), ("spark", 1, 1, 0.5)]
    assert [r["tag"] for r in search.tag_suggestions(docs, "LIC").collect()] == ["license", "licensed"]


def test_latent_directions_are_singular_vectors(spark):
    rng = np.random.default_rng(3)
    dense = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 30)) + 1e-3 * rng.standard_normal((60, 30))
    rows = spark.createDataFrame([(list(range(30)), [float(x) for x in r]) for r in dense], "ids array<int>, weights array<double>").repartition(3)
    got = models.latent_directions(rows, 30, rank=4)
    want = np.linalg.svd(dense)[2][:4].T
    assert np.allclose(np.abs((got * want).sum(axis=0)), 1, atol=1e-6)


def test_clusters_and_topics_name_their_words(spark):
    kinds = [["river", "water", "boat", "shore", "stream"], ["engine", "wheel", "brake", "gear", "motor"]]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 12))) for i in range(40)] + [(40, None), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for got in (models.clusters(docs, k=2, rank=5).collect(), models.topics(docs, k=2).collect()):
        assert sorted(r["doc_id"] for r in got) == list(range(42))
        at = {r["doc_id"]: r[1] for r in got}
        assert len({at[i] for i in range(0, 40, 2)}) == len({at[i] for i in range(1, 40, 2)}) == 1 and at[0] != at[1]
        for r in got:
            if r["doc_id"] < 40:
                assert {w for t in r["keywords"][:5] for w in t.split()} <= set(kinds[r["doc_id"] % 2])
