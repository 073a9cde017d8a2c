"""Crawls of any depth over a table of links, with a row of status and error for each URL.

Most pages of a deep site lie on chains: one link leads to them and one away.  Such pages are
taken out first: pointer doubling gives each the page its chain begins at and its place in the
chain, in rounds that grow with the logarithm of the chain's length.  What is left is crawled by
its weighted links, and every round looks only at pages whose depth the last one improved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept, table
from .graph import depths, entry_pages, url_links
from .web import HREF


def _chains(links: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, head, steps) of all pages, a page that no chain runs through being its own head; and links (src, dst, w) between heads."""
    into = links.groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("n_in"), F.first("src").alias("before"))
    out = links.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("n_out"))
    begun = seeds.select("url", F.lit(True).alias("begun"))
    nodes = into.join(out, "url", "full").join(begun, "url", "full")
    inner = (F.col("n_in") == 1) & (F.col("n_out") == 1) & F.col("begun").isNull()
    forest = kept(nodes.select(F.col("url").alias("child"), F.when(inner, F.col("before")).alias("parent")), "crawl-forest")
    chained = kept(depths(forest).select(F.col("child").alias("url"), F.col("root").alias("head"), F.col("depth").alias("steps")), "crawl-chains")
    # A link out of a chain (or of a head itself) to a head: as long as the chain up to it, and one.
    heads = chained.where(F.col("url") == F.col("head")).select(F.col("url").alias("dst"))
    short = links.join(chained, F.col("src") == F.col("url")).select(F.col("head").alias("src"), "dst", (F.col("steps") + 1).alias("w")).join(heads, "dst")
    return chained, short.groupBy("src", "dst").agg(F.min("w").alias("w"))


def deep_crawl(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(url, depth): the fewest links from a seed to each page that is reached, along (src, dst).

    Repeated links and links of a page to itself change nothing; null URLs are left out; a seed
    that no link has is reached all the same.
    """
    links = kept(links.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "crawl-links")
    seeds = kept(seeds.select("url").where("url is not null").distinct(), "crawl-seeds")
    chained, short = _chains(links, seeds)
    short = kept(short, "crawl-short")
    edge = kept(seeds.select("url", F.lit(0).cast("long").alias("depth")), "crawl-edge")
    best = edge
    while not edge.isEmpty():
        found = edge.join(short, F.col("url") == F.col("src")).groupBy(F.col("dst").alias("url")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        known = best.groupBy("url").agg(F.min("depth").alias("known"))
        edge = kept(found.join(known, "url", "left").where("known is null or depth < known").select("url", "depth"), "crawl-edge")
        best = best.unionByName(edge)
    heads = best.groupBy(F.col("url").alias("head")).agg(F.min("depth").alias("at"))
    return heads.join(chained, "head").select("url", (F.col("at") + F.col("steps")).alias("depth"))


def first_of_circles(links: DataFrame, left: DataFrame) -> DataFrame:
    """(url,): of pages (url) those that none of the others with a smaller name links to; all of the others can be reached from these."""
    a, b = left.select(F.col("url").alias("src")), left.select(F.col("url").alias("dst"))
    led = links.where("src < dst").join(a, "src").join(b, "dst").select(F.col("dst").alias("url"))
    return left.select("url").join(led, "url", "left_anti")


def crawl_all(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(url, depth) of all pages and whatever they lead to: from the pages that nothing leads to, then from the first ones of circles without such a page."""
    links = kept(links, "crawl-all")
    reached = kept(deep_crawl(links, entry_pages(pages, links)), "crawl-reached")
    own = pages.select(F.substring_index("url", "#", 1).alias("url")).where("url is not null").distinct()
    left = kept(own.join(reached, "url", "left_anti"), "crawl-left")
    if left.isEmpty():
        return reached
    more = deep_crawl(links, first_of_circles(links, left))
    return reached.unionByName(more).groupBy("url").agg(F.min("depth").alias("depth"))


def outcomes(pages: DataFrame, status: Column, error: Column, html: Column) -> DataFrame:
    """Rows with ``status``, ``error``, ``is_success`` (2xx and no error) and ``is_valid`` (200 with a text) from columns that say what was fetched.

    Without a status a timeout is 504, a refused connection 503, any other error 500 and a fetched text 200.
    """
    low = F.lower(error)
    by_error = F.when(F.contains(low, F.lit("timeout")), 504).when(F.contains(low, F.lit("connection")), 503).when(error.isNotNull(), 500).when(html.isNotNull(), 200)
    s = F.coalesce(status.cast("int"), by_error)
    fine = F.coalesce((s >= 200) & (s < 300) & error.isNull(), F.lit(False))
    return pages.withColumns({"status": s, "error": error, "is_success": fine, "is_valid": F.coalesce((s == 200) & (F.length(html) > 0), F.lit(False))})


def crawl_log(pages: DataFrame) -> DataFrame:
    """(url, depth, status, error, is_success, is_valid, title, n_links): a row for each URL that a crawl of all pages meets; those that are not in the table were not found."""
    links = kept(url_links(pages), "crawl-log")
    reached = crawl_all(pages, links)
    # Of several rows of one URL the first by text; a row without a text counts as an empty answer.
    own = pages.select(F.substring_index("url", "#", 1).alias("url"), "html").where("url is not null").groupBy("url").agg(F.min("html").alias("html"), F.lit(True).alias("known"))
    met = reached.join(own, "url", "left").join(links.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("n_links")), "url", "left")
    status = F.when(F.col("known").isNull(), 404).when(F.length(F.trim(F.coalesce("html", F.lit("")))) == 0, 204)
    error = F.when(F.col("known").isNull(), F.lit("not found"))
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    return outcomes(met, status, error, F.col("html")).select("url", "depth", "status", "error", "is_success", "is_valid", F.when(F.length(title) > 0, title).alias("title"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def crawl_by_host(log: DataFrame) -> DataFrame:
    """(host, n_urls, n_failed, max_depth, outcome): each host's crawl, an error where nothing of it could be read."""
    host = F.lower(F.regexp_extract("url", "^[^:/?#]+://([^/?#:]*)", 1))
    by = log.groupBy(host.alias("host")).agg(F.count("*").alias("n_urls"), F.count_if(~F.col("is_success")).alias("n_failed"), F.max("depth").alias("max_depth"))
    return by.withColumn("outcome", F.when(F.col("n_failed") == F.col("n_urls"), "error").when(F.col("n_failed") > 0, "partial").otherwise("success"))


QUERIES = {
    "cr_crawl_log": lambda s, d: crawl_log(table(s, d, "pages")),
    "cr_hosts": lambda s, d: crawl_by_host(crawl_log(table(s, d, "pages"))),
}
_LOG_SQL = r"""WITH RECURSIVE l AS MATERIALIZED (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS src, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') AS dst FROM (SELECT url, unnest(regexp_extract_all(html, 'HREF', 1)) AS href FROM pages) WHERE starts_with(href, '/')),
o AS MATERIALIZED (SELECT regexp_replace(url, '#.*$', '') AS url, min(html) AS html FROM pages GROUP BY 1),
t AS (SELECT url, 0 AS depth FROM o WHERE url NOT IN (SELECT dst FROM l) UNION SELECT l.dst, t.depth + 1 FROM t JOIN l ON l.src = t.url WHERE t.depth < 50),
u AS MATERIALIZED (SELECT url FROM o WHERE url NOT IN (SELECT url FROM t)),
v AS (SELECT url, 0 AS depth FROM u WHERE url NOT IN (SELECT dst FROM l WHERE src < dst AND src IN (FROM u) AND dst IN (FROM u)) UNION SELECT l.dst, v.depth + 1 FROM v JOIN l ON l.src = v.url WHERE v.depth < 50),
r AS (SELECT url, min(depth)::BIGINT AS depth FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY url),
m AS (SELECT r.*, html, o.url IS NOT NULL AS known, CASE WHEN o.url IS NULL THEN 404 WHEN length(trim(coalesce(html, ''))) = 0 THEN 204 ELSE 200 END AS status FROM r LEFT JOIN o USING (url))
SELECT url, depth, status, CASE WHEN NOT known THEN 'not found' END AS error, known AS is_success, status = 200 AS is_valid, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, (SELECT count(*) FROM l WHERE l.src = m.url) AS n_links FROM m""".replace("'HREF'", f"'{HREF}'")
ORACLE = {
    "cr_crawl_log": _LOG_SQL,
    "cr_hosts": f"SELECT host, n_urls, n_failed, max_depth, CASE WHEN n_failed = n_urls THEN 'error' WHEN n_failed > 0 THEN 'partial' ELSE 'success' END AS outcome FROM (SELECT lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)) AS host, count(*) AS n_urls, count(*) FILTER (NOT is_success) AS n_failed, max(depth) AS max_depth FROM ({_LOG_SQL}) GROUP BY 1)",
}
