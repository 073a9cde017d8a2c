"""Deep crawls against plain breadth-first search."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lorespark.operators import crawl


def plain(links, seeds):
    at, line = {s: 0 for s in seeds}, deque(sorted(seeds))
    while line:
        u = line.popleft()
        for a, b in links:
            if a == u and b not in at and b is not None:
                at[b] = at[u] + 1
                line.append(b)
    return at


def depths_of(df):
    rows = df.collect()
    assert len(rows) == len({r["url"] for r in rows})
    return {r["url"]: r["depth"] for r in rows}


def test_a_chain_of_many_pages(spark):
    links = spark.createDataFrame([(f"p{i:04}", f"p{i + 1:04}") for i in range(600)], "src string, dst string")
    seeds = spark.createDataFrame([("p0000",)], "url string")
    assert depths_of(crawl.deep_crawl(links, seeds)) == {f"p{i:04}": i for i in range(601)}


@pytest.mark.parametrize("seed", range(2))
def test_equals_breadth_first_search(spark, seed):
    r = random.Random(seed)
    links = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(45)]
    for c in range(6):  # chains that join and leave the rest, and shortcuts
        path = [f"n{r.randrange(40)}", *(f"c{c}-{i}" for i in range(r.randrange(1, 12))), f"n{r.randrange(40)}"]
        links += list(zip(path, path[1:], strict=False))
    links += links[:5] + [("n1", "n1"), (None, "n2"), ("n2", None)]
    seeds = {"n0", "c0-0", "alone"}
    got = depths_of(crawl.deep_crawl(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(s,) for s in sorted(seeds)] + [("n0",), (None,)], "url string")))
    assert got == plain(links, seeds)


def test_circles_without_an_entry(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("x", "y"), ("y", "x"), ("z", "z")]
    pages = spark.createDataFrame([(u, "") for u in "abcdefxyz"], "url string, html string")
    frame = spark.createDataFrame(links, "src string, dst string")
    assert depths_of(crawl.crawl_all(pages, frame)) == {"e": 0, "f": 1, "a": 0, "b": 1, "c": 2, "d": 3, "x": 0, "y": 1, "z": 0}
    assert crawl.crawl_all(pages.limit(0), frame.limit(0)).count() == 0


def test_log_has_a_row_for_each_url(spark):
    pages = [("http://h.example/a#x", '<title>A</title><a href="/b">b</a><a href="/gone">g</a>'), ("http://h.example/b", '<a href="/a">a</a>'), ("http://h.example/c", None), (None, "x"), ("http://k.example/", "  ")]
    rows = {r["url"]: r for r in crawl.crawl_log(spark.createDataFrame(pages, "url string, html string")).collect()}
    short = {u.split("//")[1]: (r["depth"], r["status"], r["error"], r["is_success"], r["is_valid"], r["title"], r["n_links"]) for u, r in rows.items()}
    assert short == {"h.example/a": (0, 200, None, True, True, "A", 2), "h.example/b": (1, 200, None, True, True, None, 1), "h.example/gone": (1, 404, "not found", False, False, None, 0), "h.example/c": (0, 204, None, True, False, None, 0), "k.example/": (0, 204, None, True, False, None, 0)}
    by = {r["host"]: (r["n_urls"], r["n_failed"], r["max_depth"], r["outcome"]) for r in crawl.crawl_by_host(crawl.crawl_log(spark.createDataFrame(pages, "url string, html string"))).collect()}
    assert by == {"h.example": (4, 1, 1, "partial"), "k.example": (1, 0, 0, "success")}


def test_outcomes_of_what_was_fetched(spark):
    rows = [(200, None, "x"), (None, "Timeout after 30 s", None), (None, "Connection refused", None), (None, "bad", None), (204, None, ""), (404, None, "x"), (200, "cut off", "x"), (None, None, "x"), (None, None, None)]
    got = crawl.outcomes(spark.createDataFrame(rows, "code int, why string, html string"), F.col("code"), F.col("why"), F.col("html")).collect()
    assert [(r["status"], r["is_success"], r["is_valid"]) for r in got] == [(200, True, True), (504, False, False), (503, False, False), (500, False, False), (204, True, False), (404, False, False), (200, False, True), (200, True, True), (None, False, False)]
