"""Pages and their URLs: extraction, validation, normalisation, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import MIME, table

# Error titles, path marks of pages that are no documentation, default ports, schemes.
ERROR_TITLES = ["404 Not Found", "403 Forbidden", "500 Internal Server Error", "Service Unavailable", "Page Not Found", "Access Denied"]
NOT_DOCS = [r"/issues?/", r"/pull/", r"/merge_requests?/", r"/commits?/", r"/branches?/", r"/releases?/", r"/tags?/", r"/actions?/", r"/workflows?/", r"/settings", r"/contributors?", r"/graphs?", r"/network", r"/pulse", r"/security", r"/insights"]
DEFAULT_PORTS = {"http": "80", "https": "443"}
TRAVERSAL = r"(?:^|/)\.\.(?:/|$)|%2e%2e"
XSS = r"(?i)<script|onerror=|onload=|javascript:"
SQLI = r"(?i)(--|;|'|\"|xp_)|(union\s+select)"
COMMAND = r"[;|`$(){}]"
HREF = r'<a\s[^>]*href="([^"]*)"'


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def validate_pages(pages: DataFrame) -> DataFrame:
    """Long enough, markup, and no error page by its title."""
    title = title_of(F.col("html"))
    bad = F.lit(False)
    for t in ERROR_TITLES:
        bad = bad | F.contains(title, F.lit(t))
    likely = F.regexp_like("html", F.lit(r"(?is)<!doctype\s+html|<html.*</html>|<[a-z]+[^>]*>.*</[a-z]+>"))
    return pages.select("page_id", title.alias("title"), likely.alias("is_html"), ((F.length("html") >= 100) & ~bad).alias("is_valid"))


_VALIDATE_SQL = r"""SELECT page_id, title, regexp_matches(html, '(?is)<!doctype\s+html|<html.*</html>|<[a-z]+[^>]*>.*</[a-z]+>') AS is_html, length(html) >= 100 AND NOT (""" + " OR ".join(f"contains(title, '{t}')" for t in ERROR_TITLES) + r""") AS is_valid FROM (SELECT *, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)"""


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, level, seq, text) of the non-empty headings, by level and then order."""
    found = []
    for level in range(1, 7):
        each = F.regexp_extract_all("html", F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), F.lit(1))
        found.append(pages.select("page_id", F.lit(level).alias("level"), F.posexplode(each).alias("seq", "raw")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", ""), r"\s+", " "))
    return out.select("page_id", "level", "seq", text.alias("text")).where(F.length("text") > 0)


_HEADINGS_SQL = " UNION ALL ".join(rf"""SELECT * FROM (SELECT page_id, {n} AS level, (generate_subscripts(hs, 1) - 1)::INT AS seq, trim(regexp_replace(regexp_replace(unnest(hs), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h{n}[^>]*>(.*?)</h{n}>', 1) AS hs FROM pages)) WHERE length(text) > 0""" for n in range(1, 7))


def visible_text(pages: DataFrame) -> DataFrame:
    """Length of the visible text, and the text: scripts, styles, comments and tags gone, five entities decoded."""
    text = F.col("html")
    for pattern in (r"(?is)<(script|style|noscript|iframe)[^>]*>.*?</(script|style|noscript|iframe)>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return pages.select("page_id", F.length(text).alias("n_chars"), text.alias("text"))


_TEXT_SQL = r"""SELECT page_id, length(t)::INT AS n_chars, t AS text FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|iframe)[^>]*>.*?</(script|style|noscript|iframe)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)"""


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, kind): every link of a page; root-relative ones are internal."""
    each = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    kind = F.when(F.startswith(F.col("href"), F.lit("/")), "internal").when(F.startswith(F.col("href"), F.lit("#")), "anchor").when(F.regexp_like("href", F.lit("^(?i)https?://")), "absolute").otherwise("other")
    return pages.select("page_id", F.posexplode(each).alias("pos", "href")).select("page_id", "pos", "href", kind.alias("kind"))


_LINKS_SQL = rf"""SELECT page_id, pos, href, CASE WHEN starts_with(href, '/') THEN 'internal' WHEN starts_with(href, '#') THEN 'anchor' WHEN regexp_matches(href, '^(?i)https?://') THEN 'absolute' ELSE 'other' END AS kind
FROM (SELECT page_id, (generate_subscripts(hs, 1) - 1)::INT AS pos, unnest(hs) AS href FROM (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS hs FROM pages))"""


def page_quality(pages: DataFrame) -> DataFrame:
    """1 less 0.2 for each error (short, no heading, no title, no description) and 0.1 for each warning (long, few internal links)."""
    n_headings = F.regexp_count("html", F.lit(r"(?i)<h[1-6][\s>]"))
    n_links = F.regexp_count("html", F.lit(r'<a\s[^>]*href="/'))
    length = F.length(F.regexp_replace("html", "<[^>]*>", ""))
    errors = sum((c.cast("int") for c in (length < 100, n_headings < 1, F.length(title_of(F.col("html"))) == 0, ~F.regexp_like("html", F.lit(r'(?i)<meta\s[^>]*name="description"')))), F.lit(0))
    warnings = (length > 100000).cast("int") + (n_links < 2).cast("int")
    return pages.select("page_id", n_headings.alias("n_headings"), n_links.alias("n_links"), errors.alias("errors"), warnings.alias("warnings")).withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - 0.2 * F.col("errors") - 0.1 * F.col("warnings")), 6))


_QUALITY_SQL = r"""SELECT *, round(greatest(0.0, 1 - 0.2::DOUBLE * errors - 0.1::DOUBLE * warnings), 6) AS score FROM (SELECT page_id, len(regexp_extract_all(html, '(?i)<h[1-6][\s>]'))::INT AS n_headings, len(regexp_extract_all(html, '<a\s[^>]*href="/'))::INT AS n_links,
  (n < 100)::INT + (n_headings < 1)::INT + (length(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) = 0)::INT + (NOT regexp_matches(html, '(?i)<meta\s[^>]*name="description"'))::INT AS errors,
  (n > 100000)::INT + (n_links < 2)::INT AS warnings FROM (SELECT *, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n FROM pages))"""


def url_parts(pages: DataFrame) -> DataFrame:
    """Scheme, host, path, query, fragment and domain parts; the last two labels are the registered domain."""
    u = F.col("url")
    labels = F.split("host", r"\.")
    p = pages.select("page_id", F.lower(F.parse_url(u, F.lit("PROTOCOL"))).alias("scheme"), F.lower(F.parse_url(u, F.lit("HOST"))).alias("host"), F.parse_url(u, F.lit("PATH")).alias("path"), F.parse_url(u, F.lit("QUERY")).alias("query"), F.parse_url(u, F.lit("REF")).alias("fragment"))
    n = F.size(labels)
    return p.select("*", F.array_join(F.slice(labels, -2, 2), ".").alias("registered_domain"), F.when(n > 2, F.array_join(F.slice(labels, F.lit(1), n - 2), ".")).alias("subdomain"), F.regexp_like("host", F.lit(r"^\d+\.\d+\.\d+\.\d+$")).alias("is_ip"))


_PARTS = r"""SELECT page_id, url, lower(regexp_extract(url, '^([^:/?#]+):', 1)) AS scheme, lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
  CASE WHEN contains(regexp_replace(url, '#.*', ''), '?') THEN regexp_extract(url, '\?([^#]*)', 1) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)', 1) END AS fragment FROM pages"""
_PARTS_SQL = rf"""SELECT page_id, scheme, host, path, query, fragment, array_to_string(ls[-2:], '.') AS registered_domain, CASE WHEN len(ls) > 2 THEN array_to_string(ls[:-3], '.') END AS subdomain, regexp_matches(host, '^\d+\.\d+\.\d+\.\d+$') AS is_ip
FROM (SELECT *, string_split(host, '.') AS ls FROM ({_PARTS}))"""


def normalize(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, single slashes, sorted query."""
    scheme, host = F.lower(F.parse_url(url, F.lit("PROTOCOL"))), F.lower(F.parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(url, r"^[^:/?#]+://[^/?#:]*:(\d+)", 1)
    keep = F.when((port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443")), F.concat(F.lit(":"), port)).otherwise("")
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+", "/")
    path = F.when(path == "", "/").otherwise(path)
    query = F.array_join(F.array_sort(F.split(F.parse_url(url, F.lit("QUERY")), "&")), "&")
    return F.concat(scheme, F.lit("://"), host, keep, path, F.when(query.isNotNull() & (query != ""), F.concat(F.lit("?"), query)).otherwise(""))


def normalized_urls(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", normalize(F.col("url")).alias("normalized"))


_NORMALIZED_SQL = rf"""SELECT page_id, scheme || '://' || host || CASE WHEN port <> '' AND NOT (scheme = 'http' AND port = '80') AND NOT (scheme = 'https' AND port = '443') THEN ':' || port ELSE '' END
  || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '/+', '/', 'g') END || CASE WHEN query <> '' THEN '?' || array_to_string(list_sort(string_split(query, '&')), '&') ELSE '' END AS normalized
FROM (SELECT *, regexp_extract(url, '^[^:/?#]+://[^/?#:]*:(\d+)', 1) AS port FROM ({_PARTS}))"""


def url_checks(pages: DataFrame) -> DataFrame:
    """The first rule that a URL breaks, whether its path is documentation, and what kind of link it is from an https site."""
    u, scheme = F.col("url"), F.lower(F.regexp_extract("url", r"^([^:/?#]+):", 1))
    path = F.coalesce(F.parse_url(u, F.lit("PATH")), F.lit(""))
    query = F.coalesce(F.parse_url(u, F.lit("QUERY")), F.lit(""))
    error = F.when(F.length(u) > 2083, "length").when(F.regexp_like(u, F.lit(r"[\x00-\x1f\x7f]")), "control").when(~scheme.isin("http", "https", "file"), "scheme").when(F.length(path) > 2048, "path").when(F.regexp_like(F.lower(path), F.lit(TRAVERSAL)), "traversal").when(F.length(query) > 2048, "query").when(F.regexp_like(u, F.lit(XSS)), "xss").when(F.regexp_like(query, F.lit(SQLI)), "sqli").when(F.regexp_like(F.concat(path, query), F.lit(COMMAND)), "command")
    relevant = ~F.regexp_like(F.lower(u), F.lit("|".join(NOT_DOCS)))
    return pages.select("page_id", error.alias("error"), error.isNull().alias("is_valid"), relevant.alias("is_documentation"), F.regexp_like(u, F.lit(r"^(?i)(javascript|data|vbscript):")).alias("is_unsafe"))


_CHECKS_SQL = rf"""SELECT page_id, error, error IS NULL AS is_valid, NOT regexp_matches(lower(url), '{"|".join(NOT_DOCS)}') AS is_documentation, regexp_matches(url, '^(?i)(javascript|data|vbscript):') AS is_unsafe FROM (
  SELECT page_id, url, CASE WHEN length(url) > 2083 THEN 'length' WHEN regexp_matches(url, '[\x00-\x1f\x7f]') THEN 'control' WHEN scheme NOT IN ('http', 'https', 'file') THEN 'scheme' WHEN length(path) > 2048 THEN 'path'
    WHEN regexp_matches(lower(path), '{TRAVERSAL}') THEN 'traversal' WHEN length(query) > 2048 THEN 'query' WHEN regexp_matches(url, '{XSS}') THEN 'xss' WHEN regexp_matches(coalesce(query, ''), '{SQLI.replace(chr(39), chr(39) * 2)}') THEN 'sqli'
    WHEN regexp_matches(path || coalesce(query, ''), '{COMMAND}') THEN 'command' END AS error FROM ({_PARTS}))"""


def query_params(pages: DataFrame) -> DataFrame:
    """(page_id, name, value) of every parameter; the last wins where one repeats."""
    pairs = F.filter(F.split(F.parse_url("url", F.lit("QUERY")), "&"), lambda p: F.length(p) > 0)
    each = pages.select("page_id", F.posexplode(pairs).alias("pos", "pair")).select("page_id", "pos", F.substring_index("pair", "=", 1).alias("name"), F.regexp_extract("pair", "=(.*)", 1).alias("value"))
    return each.groupBy("page_id", "name").agg(F.max_by("value", "pos").alias("value"))


_PARAMS_SQL = rf"""SELECT page_id, name, max_by(value, pos) AS value FROM (SELECT page_id, pos, string_split(pair, '=')[1] AS name, regexp_extract(pair, '=(.*)', 1) AS value FROM (
  SELECT page_id, unnest(ps) AS pair, generate_subscripts(ps, 1) AS pos FROM (SELECT page_id, string_split(query, '&') AS ps FROM ({_PARTS}))) WHERE length(pair) > 0) GROUP BY ALL"""


def link_graph(pages: DataFrame) -> DataFrame:
    """Hosts by pages, internal links and distinct targets."""
    host = pages.select("page_id", F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"))
    met = links(pages).where("kind = 'internal'").join(host, "page_id")
    out = met.groupBy("host").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets"), F.countDistinct("page_id").alias("n_pages"))
    return out


def mime_types(pages: DataFrame) -> DataFrame:
    """Type by the extension of a link's target."""
    names = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    ext = F.lower(F.regexp_extract("href", r"\.([A-Za-z0-9]+)$", 1))
    return links(pages).groupBy(ext.alias("extension")).agg(F.count("*").alias("n")).withColumn("mime", F.try_element_at(names, F.col("extension")))


# Line patterns of Markdown.
MARKDOWN = [r"^#{1,6}\s+.+", r"^\s*[-*+]\s+.+", r"^\s*\d+\.\s+.+", r"^>\s+.+", r"^```", r"\[.+\]\(.+\)", r"\*\*.+\*\*", r"^\|.+\|$"]


def format_detection(docs: DataFrame) -> DataFrame:
    """Share of lines that look like Markdown (doubled, at most 0.9), and the format of the whole by ordered rules."""
    split = F.split("text", "\n")
    hit = F.filter(split, lambda x: F.regexp_like(x, F.lit("|".join(MARKDOWN))))
    kind = F.when(F.regexp_like("text", F.lit(r"(?i)<!doctype html|<html")), "html").when(F.regexp_like("text", F.lit(r"(?m)^(={3,}|-{3,}|~{3,})$")), "rst").when(F.regexp_like("text", F.lit(r"(?m)^#{1,6}\s")), "markdown").when(F.regexp_like("text", F.lit(r"(?m)^={1,5}\s")), "asciidoc").when(F.regexp_like("text", F.lit(r"(?s)^\s*[\[{].*[\]}]\s*$")), "json").otherwise("plain")
    return docs.select("doc_id", F.round(F.least(F.lit(0.9), 2 * F.size(hit) / F.size(split)), 6).alias("markdown"), kind.alias("format"))


_FORMAT_SQL = rf"""SELECT doc_id, round(least(0.9::DOUBLE, 2 * len(list_filter(ls, lambda x: regexp_matches(x, '{"|".join(MARKDOWN)}'))) / len(ls)), 6) AS markdown,
  CASE WHEN regexp_matches(text, '(?i)<!doctype html|<html') THEN 'html' WHEN regexp_matches(text, '(?m)^(={{3,}}|-{{3,}}|~{{3,}})$') THEN 'rst' WHEN regexp_matches(text, '(?m)^#{{1,6}}\s') THEN 'markdown' WHEN regexp_matches(text, '(?m)^={{1,5}}\s') THEN 'asciidoc' WHEN regexp_matches(text, '(?s)^\s*[\[{{].*[\]}}]\s*$') THEN 'json' ELSE 'plain' END AS format
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)"""


QUERIES = {
    "hx_validate": lambda s, d: validate_pages(table(s, d, "pages")),
    "hx_headings": lambda s, d: headings(table(s, d, "pages")),
    "hx_text": lambda s, d: visible_text(table(s, d, "pages")),
    "hx_links": lambda s, d: links(table(s, d, "pages")),
    "hx_quality": lambda s, d: page_quality(table(s, d, "pages")),
    "hx_format": lambda s, d: format_detection(table(s, d, "documents")),
    "io_mime": lambda s, d: mime_types(table(s, d, "pages")),
    "ur_parts": lambda s, d: url_parts(table(s, d, "pages")),
    "ur_normalize": lambda s, d: normalized_urls(table(s, d, "pages")),
    "ur_checks": lambda s, d: url_checks(table(s, d, "pages")),
    "ur_query_params": lambda s, d: query_params(table(s, d, "pages")),
    "ur_link_graph": lambda s, d: link_graph(table(s, d, "pages")),
}
ORACLE = {
    "hx_validate": _VALIDATE_SQL,
    "hx_headings": _HEADINGS_SQL,
    "hx_text": _TEXT_SQL,
    "hx_links": _LINKS_SQL,
    "hx_quality": _QUALITY_SQL,
    "hx_format": _FORMAT_SQL,
    "io_mime": rf"SELECT extension, count(*) AS n, any_value(mime) AS mime FROM (SELECT lower(regexp_extract(href, '\.([A-Za-z0-9]+)$', 1)) AS extension FROM ({_LINKS_SQL})) LEFT JOIN (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in MIME.items())}) AS m(ext, mime) ON ext = extension GROUP BY extension",
    "ur_parts": _PARTS_SQL,
    "ur_normalize": _NORMALIZED_SQL,
    "ur_checks": _CHECKS_SQL,
    "ur_query_params": _PARAMS_SQL,
    "ur_link_graph": f"SELECT host, count(*) AS n_links, count(DISTINCT href) AS n_targets, count(DISTINCT page_id) AS n_pages FROM ({_LINKS_SQL}) JOIN (SELECT page_id, host FROM ({_PARTS})) USING (page_id) WHERE kind = 'internal' GROUP BY host",
}
