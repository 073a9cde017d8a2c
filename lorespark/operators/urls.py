"""URLs as columns: resolution, rewriting, hosts, relations between pages and links, links in plain text, known sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import quote
from ..sources.tables import table

# Hosts that requests must not be sent to, schemes of links that lead nowhere, schemes that joined links may have.
FORBIDDEN_HOSTS = ["localhost", "127.0.0.1", "169.254.169.254", "metadata.google.internal"]
SKIPPED = ["javascript:", "mailto:", "tel:", "data:", "vbscript:", "about:", "blob:", "file:", "ftp:"]
JOINABLE = ["http", "https", "ftp", "mailto", "file"]
#: Private, loopback, link-local, reserved and multicast addresses.
PRIVATE = r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.|0\.|(22[4-9]|2[3-5][0-9])\.)"
ADDRESS = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"
LABEL = r"^[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?$"
# Documentation sites by URL, by content, and where their versions stand.
SITES = [
    ("django", ["docs.djangoproject.com"], ["Django documentation", "Django Documentation"], r"(\d+\.\d+)"),
    ("flask", ["flask.palletsprojects.com"], ["Flask Documentation", "Welcome to Flask"], r"(\d+\.\d+\.\d+)"),
    ("react", ["reactjs.org/docs", "react.dev"], ["React Documentation", "React Docs"], r"(\d+\.\d+\.\d+)"),
    ("vue", ["vuejs.org/guide", "vuejs.org/api"], ["Vue.js Documentation", "Vue.js Guide"], r"v(\d+)"),
    ("angular", ["angular.io/docs", "angular.io/guide", "angular.io/api"], ["Angular Documentation", "Angular Docs"], r"(\d+)"),
    ("node", ["nodejs.org/docs", "nodejs.org/api", "nodejs.dev"], ["Node.js Documentation", "Node.js API"], r"(\d+\.\d+\.\d+)"),
    ("express", ["expressjs.com"], ["Express Documentation", "Express API"], r"(\d+\.\d+\.\d+)"),
    ("tensorflow", ["tensorflow.org/api_docs", "tensorflow.org/guide"], ["TensorFlow Documentation", "TensorFlow API"], r"(\d+\.\d+)"),
    ("pytorch", ["pytorch.org/docs", "pytorch.org/tutorials"], ["PyTorch Documentation", "PyTorch Tutorials"], r"(\d+\.\d+\.\d+)"),
]
#: What a URL is made of (RFC 3986, appendix B).
PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def split(url: Column) -> dict[str, Column]:
    part = lambda k: F.regexp_extract(url, PARTS, k)
    return {"scheme": F.lower(part(2)), "has_host": part(3) != "", "netloc": part(4), "path": part(5), "has_query": part(6) != "", "query": part(7), "has_fragment": part(8) != "", "fragment": part(9)}


def host_of(netloc: Column) -> Column:
    """Without user and port, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^[^@]*@", ""), r":[0-9]*$", ""))


def without_dots(path: Column) -> Column:
    """``.`` and ``..`` taken out of a path; what leads above its root is dropped."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(F.slice(parts, F.lit(1), F.size(parts)), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolve(base: Column, link: Column, keep_fragment: bool = False) -> Column:
    """A link as seen from a page (RFC 3986, section 5.2)."""
    b, r = split(base), split(F.trim(link))
    folder = F.regexp_extract(b["path"], r"^(.*/)", 1)
    merged = F.when((b["path"] == "") | (folder == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
    path = F.when(r["scheme"] != "", r["path"]).when(r["has_host"], without_dots(r["path"])).when(r["path"] == "", b["path"]).when(F.startswith(r["path"], F.lit("/")), without_dots(r["path"])).otherwise(without_dots(merged))
    scheme = F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"])
    netloc = F.when((r["scheme"] != "") | r["has_host"], r["netloc"]).otherwise(b["netloc"])
    own = (r["scheme"] != "") | r["has_host"] | (r["path"] != "") | r["has_query"]
    query = F.when(own, F.when(r["has_query"], F.concat(F.lit("?"), r["query"])).otherwise("")).otherwise(F.when(b["has_query"], F.concat(F.lit("?"), b["query"])).otherwise(""))
    slashes = F.when((r["scheme"] != "") & ~r["has_host"], "").otherwise("//")
    fragment = F.when(r["has_fragment"], F.concat(F.lit("#"), r["fragment"])).otherwise("") if keep_fragment else F.lit("")
    return F.concat(scheme, F.lit(":"), slashes, netloc, path, query, fragment)


def registered(host: Column) -> Column:
    """The last two labels; a single one, or an address, whole."""
    return F.when(F.regexp_like(host, F.lit(ADDRESS)), host).otherwise(F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), F.lit(2)), "."))


#: A link of each kind for every page.
LINKS = ["../up/{id}", "./here?x={id}#top", "/root/./a/../b", "//other.example.net/x", "https://www.Example.org:443/a?b=c", "?only=query", "#part", "http://user@127.0.0.1:8080/", "mailto:someone@example.org", "JavaScript:alert(1)", "deep/../../../far/..", "https://docs.{id}.example.com/v1.{id}.2/", ""]


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, link): links of many kinds seen from each page."""
    each = F.array(*[F.replace(F.lit(x), F.lit("{id}"), F.col("page_id").cast("string")) for x in LINKS])
    return pages.select("page_id", "url", F.posexplode(each).alias("pos", "link"))


_LINKS = f"(SELECT page_id, url, unnest(generate_series(0, {len(LINKS) - 1}))::INT AS pos, replace(unnest([{', '.join(map(quote, LINKS))}]), '{{id}}', page_id::VARCHAR) AS link FROM pages)"


def resolved(links: DataFrame) -> DataFrame:
    return links.select("page_id", "pos", resolve(F.col("url"), F.col("link"), keep_fragment=True).alias("target"))


#: What each kind of link comes to, seen from https://host/lang/number?query.
_TARGET = r"""CASE pos WHEN 0 THEN root || regexp_replace(folder, '[^/]+/$', '') || 'up/' || page_id WHEN 1 THEN root || folder || 'here?x=' || page_id || '#top' WHEN 2 THEN root || '/root/b' WHEN 3 THEN scheme || '://other.example.net/x' WHEN 4 THEN 'https://www.Example.org:443/a?b=c'
  WHEN 5 THEN root || path || '?only=query' WHEN 6 THEN root || path || query || '#part' WHEN 7 THEN 'http://user@127.0.0.1:8080/' WHEN 8 THEN 'mailto:someone@example.org' WHEN 9 THEN 'javascript:alert(1)' WHEN 10 THEN root || '/' WHEN 11 THEN link ELSE root || path || query END"""
_RESOLVED = rf"(SELECT page_id, url, pos, link, scheme, root, {_TARGET} AS target FROM (SELECT *, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[a-z]+://[^/?#]*(/([^/?#]*/)*)', 1) AS folder, regexp_extract(url, '(\?[^#]*)', 1) AS query FROM {_LINKS}))"


def relations(links: DataFrame) -> DataFrame:
    """(page_id, pos, host, registered, kind): a valid link is internal where the registered domain is the page's and the scheme too, or better."""
    target = links.withColumn("target", resolve(F.col("url"), F.col("link")))
    b, t = split(F.col("url")), split(F.col("target"))
    host = host_of(t["netloc"])
    same = registered(host) == registered(host_of(b["netloc"]))
    scheme = (t["scheme"] == b["scheme"]) | ((b["scheme"] == "http") & (t["scheme"] == "https"))
    kind = F.when(~t["scheme"].isin("http", "https") | (host == ""), "unknown").when(same & scheme, "internal").otherwise("external")
    return target.select("page_id", "pos", host.alias("host"), registered(host).alias("registered"), kind.alias("kind"))


_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', ''))"
_REG = r"CASE WHEN regexp_matches(@@, '" + ADDRESS + r"') THEN @@ ELSE array_to_string(string_split(@@, '.')[-2:], '.') END"
_RELATIONS_SQL = f"""SELECT page_id, pos, host, registered, CASE WHEN ts NOT IN ('http', 'https') OR host = '' THEN 'unknown' WHEN registered = base AND (ts = scheme OR scheme = 'http' AND ts = 'https') THEN 'internal' ELSE 'external' END AS kind
FROM (SELECT page_id, pos, scheme, ts, host, {_REG.replace('@@', 'host')} AS registered, {_REG.replace('@@', 'bh')} AS base FROM (SELECT *, lower(regexp_extract(target, '^([^:/?#]+):', 1)) AS ts, {_HOST.format('target')} AS host, {_HOST.format('url')} AS bh FROM {_RESOLVED}))"""


def hosts_checked(links: DataFrame) -> DataFrame:
    """(page_id, pos, error): why a resolved link's host and port are no good, if so."""
    t = split(F.col("target"))
    host = host_of(t["netloc"])
    port = F.regexp_extract(t["netloc"], r":([0-9]+)$", 1)
    labels = F.split(host, r"\.")
    address = F.regexp_like(host, F.lit(ADDRESS))
    error = F.when(~t["scheme"].isin("http", "https"), "scheme").when(F.contains(t["netloc"], F.lit("@")), "credentials").when(host == "", "no host").when(host.isin(FORBIDDEN_HOSTS), "forbidden").when(address & F.regexp_like(host, F.lit(PRIVATE)), "private")
    error = error.when(~address & ~F.contains(host, F.lit(".")), "single label").when(F.length(host) > 253, "too long").when(~address & (F.length(F.element_at(labels, -1)) < 2), "top level").when(~address & F.exists(labels, lambda x: ~F.regexp_like(x, F.lit(LABEL))), "label").when(F.coalesce(port.try_cast("int"), F.lit(0)) > 65535, "port")
    return links.select("page_id", "url", "pos", resolve(F.col("url"), F.col("link")).alias("target")).select("page_id", "pos", error.alias("error"))


_CHECKED_SQL = f"""SELECT page_id, pos, CASE WHEN ts NOT IN ('http', 'https') THEN 'scheme' WHEN contains(netloc, '@') THEN 'credentials' WHEN host = '' THEN 'no host' WHEN host IN ({', '.join(map(quote, FORBIDDEN_HOSTS))}) THEN 'forbidden' WHEN ip AND regexp_matches(host, '{PRIVATE}') THEN 'private' WHEN NOT ip AND NOT contains(host, '.') THEN 'single label'
  WHEN length(host) > 253 THEN 'too long' WHEN NOT ip AND length(string_split(host, '.')[-1]) < 2 THEN 'top level' WHEN NOT ip AND len(list_filter(string_split(host, '.'), lambda x: NOT regexp_matches(x, '{LABEL}'))) > 0 THEN 'label' WHEN coalesce(try_cast(nullif(regexp_extract(netloc, ':([0-9]+)$', 1), '') AS INT), 0) > 65535 THEN 'port' END AS error
FROM (SELECT *, regexp_matches(host, '{ADDRESS}') AS ip FROM (SELECT *, lower(regexp_extract(target, '^([^:/?#]+):', 1)) AS ts, regexp_extract(target, '^[a-z]+://([^/?#]*)', 1) AS netloc, {_HOST.format('target')} AS host FROM {_RESOLVED}))"""


def joined(links: DataFrame) -> DataFrame:
    """(page_id, pos, target): safe links joined to their page; no row for what is empty, dangerous or of an odd scheme."""
    low = F.lower(F.trim("link"))
    fine = (low != "") & ~F.regexp_like(low, F.lit("^(javascript|vbscript|data):"))
    met = links.where(fine).select("page_id", "pos", resolve(F.col("url"), F.col("link"), keep_fragment=True).alias("target"))
    return met.where(split(F.col("target"))["scheme"].isin(JOINABLE))


def outlinks(links: DataFrame) -> DataFrame:
    """(page_id, target, pos): a page's distinct targets with the place of the first; links within the page and of odd schemes are left out."""
    low = F.lower(F.trim("link"))
    fine = (low != "") & ~F.startswith(low, F.lit("#")) & ~F.regexp_like(low, F.lit("^(" + "|".join(SKIPPED) + ")"))
    return links.where(fine).select("page_id", "pos", resolve(F.col("url"), F.col("link")).alias("target")).groupBy("page_id", "target").agg(F.min("pos").alias("pos"))


def rewritten(pages: DataFrame) -> DataFrame:
    """Parameters added or replaced, parameters dropped, the scheme changed."""
    u = F.col("url")
    p = split(u)
    pairs = F.filter(F.split(p["query"], "&", -1), lambda x: F.length(x) > 0)
    head = F.regexp_extract(u, r"^([^?#]*)", 1)
    mark = lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")
    tail = F.when(p["has_fragment"], F.concat(F.lit("#"), p["fragment"])).otherwise("")
    name = lambda x: F.substring_index(x, "=", 1)
    added = F.concat(F.filter(pairs, lambda x: ~name(x).isin("page", "lang")), F.array(F.concat(F.lit("page="), F.col("page_id").cast("string")), F.lit("lang=en")))
    dropped = F.filter(pairs, lambda x: ~F.startswith(name(x), F.lit("utm_")))
    return pages.select("page_id", F.concat(head, mark(F.array_join(added, "&")), tail).alias("with_parameters"), F.concat(head, mark(F.array_join(dropped, "&")), tail).alias("without_tracking"), F.regexp_replace(u, "^[^:/?#]+:", "https:").alias("secure"))


_REWRITTEN_SQL = r"""SELECT page_id, head || '?' || array_to_string(list_filter(ps, lambda x: string_split(x, '=')[1] NOT IN ('page', 'lang')) || ['page=' || page_id, 'lang=en'], '&') || tail AS with_parameters,
  head || CASE WHEN len(list_filter(ps, lambda x: NOT starts_with(x, 'utm_'))) > 0 THEN '?' || array_to_string(list_filter(ps, lambda x: NOT starts_with(x, 'utm_')), '&') ELSE '' END || tail AS without_tracking, regexp_replace(url, '^[^:/?#]+:', 'https:') AS secure
FROM (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS head, regexp_extract(url, '(#.*)$', 1) AS tail, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: length(x) > 0) AS ps FROM pages)"""


def cleaned_paths(links: DataFrame) -> DataFrame:
    """(page_id, pos, path): back slashes turned, slashes squeezed, dots taken out, a final slash kept; nothing leads above where a path begins."""
    path = F.regexp_replace(F.regexp_replace(split(F.col("link"))["path"], r"\\", "/"), "/+", "/")
    relative = ~F.startswith(path, F.lit("/"))
    out = without_dots(F.when(relative, F.concat(F.lit("/"), path)).otherwise(path))
    out = F.when(relative, F.substring(out, 2, 1 << 30)).otherwise(out)
    return links.select("page_id", "pos", F.when(out == "", "/").otherwise(out).alias("path"))


def urls_in_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, url) in plain text; a full stop or the like at the end is not part of one."""
    found = F.regexp_extract_all(text_col, F.lit(r"https?://[A-Za-z0-9.-]+(?:/[A-Za-z0-9._~:/?#@!$&*+,;=%-]*)?"), F.lit(0))
    return docs.select(id_col, F.posexplode(found).alias("pos", "url")).select(id_col, "pos", F.regexp_replace("url", r"[.,;:!?]+$", "").alias("url"))


_MENTIONS = "'See ' || url || ', or ' || url || '/x. (http://a.example.org)' || ' and ftp://no.example.org'"


def known_sites(pages: DataFrame) -> DataFrame:
    """(page_id, library, version, by): the first site whose URL is in a page's, else whose words are in its content."""
    by_url, by_content, version = (F.when(F.lit(False), "") for _ in range(3))
    for name, urls, words, pattern in SITES:
        at = F.lit(False)
        for u in urls:
            at = at | F.contains("url", F.lit(u))
        told = F.lit(False)
        for w in words:
            told = told | F.contains("content", F.lit(w))
        by_url, by_content = by_url.when(at, name), by_content.when(told, name)
        version = version.when(at, F.nullif(F.regexp_extract("url", pattern, 1), F.lit("")))
    return pages.select("page_id", F.coalesce(by_url, by_content).alias("library"), version.alias("version"), F.when(by_url.isNotNull(), "url").when(by_content.isNotNull(), "content").alias("by"))


_SITE_URLS = ["https://docs.djangoproject.com/en/4.{id}/intro/", "https://react.dev/18.{id}.1/learn", "https://example.org/vuejs.org/guide/v{id}", "https://example.org/{id}", "https://expressjs.com/en/"]
_SITE_WORDS = ["", "Welcome to Flask", "about Node.js API use", "nothing known"]


def _site_pages(s, d: str) -> DataFrame:
    k = F.col("page_id")
    pick = lambda values: F.replace(F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int")), F.lit("{id}"), k.cast("string"))
    return table(s, d, "pages").select("page_id", pick(_SITE_URLS).alias("url"), pick(_SITE_WORDS).alias("content"))


def _sites_sql() -> str:
    at = lambda col, some: "(" + " OR ".join(f"contains({col}, {quote(x)})" for x in some) + ")"
    by_url = "CASE " + " ".join(f"WHEN {at('url', u)} THEN '{n}'" for n, u, _, _ in SITES) + " END"
    by_content = "CASE " + " ".join(f"WHEN {at('content', w)} THEN '{n}'" for n, _, w, _ in SITES) + " END"
    version = "CASE " + " ".join(f"WHEN {at('url', u)} THEN nullif(regexp_extract(url, '{v}', 1), '')" for _, u, _, v in SITES) + " END"
    pick = lambda values: f"replace([{', '.join(map(quote, values))}][(page_id % {len(values)} + 1)::INT], '{{id}}', page_id::VARCHAR)"
    return f"SELECT page_id, coalesce(u, c) AS library, version, CASE WHEN u IS NOT NULL THEN 'url' WHEN c IS NOT NULL THEN 'content' END AS by FROM (SELECT page_id, {by_url} AS u, {by_content} AS c, {version} AS version FROM (SELECT page_id, {pick(_SITE_URLS)} AS url, {pick(_SITE_WORDS)} AS content FROM pages))"


def page_graph(pages: DataFrame) -> DataFrame:
    """(page_id, target_id): a page's links to pages of the table, by resolved and normalised URL."""
    from .web import links, normalize

    hrefs = links(pages).join(pages.select("page_id", "url"), "page_id").select("page_id", resolve(F.col("url"), F.col("href")).alias("target")).where("target like 'http%'")
    known = pages.groupBy(normalize(F.col("url")).alias("u")).agg(F.min("page_id").alias("target_id"))
    return hrefs.select("page_id", normalize(F.col("target")).alias("u")).distinct().join(known, "u").where("page_id <> target_id").select("page_id", "target_id").distinct()


def _links(s, d: str) -> DataFrame:
    return page_links(table(s, d, "pages"))


QUERIES = {
    "ur_resolve": lambda s, d: resolved(_links(s, d)),
    "ur_relations": lambda s, d: relations(_links(s, d)),
    "ur_hosts": lambda s, d: hosts_checked(_links(s, d)),
    "ur_joined": lambda s, d: joined(_links(s, d)),
    "ur_outlinks": lambda s, d: outlinks(_links(s, d)),
    "ur_rewritten": lambda s, d: rewritten(table(s, d, "pages")),
    "ur_paths": lambda s, d: cleaned_paths(_links(s, d)),
    "ur_in_text": lambda s, d: urls_in_text(table(s, d, "pages").select("page_id", F.concat(F.lit("See "), "url", F.lit(", or "), "url", F.lit("/x. (http://a.example.org) and ftp://no.example.org")).alias("text")), "page_id"),
    "ur_known_sites": lambda s, d: known_sites(_site_pages(s, d)),
}
ORACLE = {
    "ur_resolve": f"SELECT page_id, pos, target FROM {_RESOLVED}",
    "ur_relations": _RELATIONS_SQL,
    "ur_hosts": _CHECKED_SQL,
    "ur_joined": f"SELECT page_id, pos, target FROM {_RESOLVED} WHERE pos NOT IN (9, 12)",
    "ur_outlinks": f"SELECT page_id, target, min(pos) AS pos FROM (SELECT page_id, pos, regexp_replace(target, '#.*', '') AS target FROM {_RESOLVED} WHERE pos NOT IN (6, 8, 9, 12)) GROUP BY ALL",
    "ur_rewritten": _REWRITTEN_SQL,
    "ur_paths": f"SELECT page_id, pos, CASE pos WHEN 0 THEN 'up/' || page_id WHEN 1 THEN 'here' WHEN 2 THEN '/root/b' WHEN 3 THEN '/x' WHEN 4 THEN '/a' WHEN 8 THEN 'someone@example.org' WHEN 9 THEN 'alert(1)' WHEN 11 THEN '/v1.' || page_id || '.2/' ELSE '/' END AS path FROM {_LINKS}",
    "ur_in_text": r"SELECT page_id, pos, regexp_replace(url, '[.,;:!?]+$', '') AS url FROM (SELECT page_id, (generate_subscripts(us, 1) - 1)::INT AS pos, unnest(us) AS url FROM (SELECT page_id, regexp_extract_all(" + _MENTIONS + r", 'https?://[A-Za-z0-9.-]+(?:/[A-Za-z0-9._~:/?#@!$&*+,;=%-]*)?') AS us FROM pages))",
    "ur_known_sites": _sites_sql(),
}
