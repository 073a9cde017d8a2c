"""Host names: internationalised labels both ways, addresses, and public suffixes.

Labels beyond ASCII are brought to their canonical Unicode form and to Punycode (RFC 3492) over
Arrow batches; hosts that are plain ASCII pass through unchanged.  The public suffix of a host is the
longest rule that its last labels match, by an equi-join of all its endings with the rules:
``*`` stands for one label, ``!`` marks an exception, and a host that no rule matches ends in its
last label.
"""

from __future__ import annotations

import ipaddress
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import quote
from ..sources.session import ship
from ..sources.tables import spread, table
from .search import tokens

# Parameters of Punycode.
BASE, T_MIN, T_MAX, SKEW, DAMP, INITIAL_BIAS, INITIAL_N = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"

# Well-known public suffixes, for where no list is given; ``*`` is any label, ``!`` an exception.
SUFFIXES = ["com", "org", "net", "edu", "gov", "io", "dev", "info", "de", "fr", "es", "it", "nl", "eu", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "jp", "co.jp", "ac.jp", "ne.jp", "or.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "au", "com.au", "net.au", "org.au", "br", "com.br", "in", "co.in", "nz", "co.nz", "za", "co.za", "*.ck", "!www.ck", "cn", "com.cn", "kr", "co.kr", "mx", "com.mx", "github.io", "readthedocs.io", "blogspot.com"]


def _adapted(delta: int, n: int, first: bool) -> int:
    delta = delta // DAMP if first else delta // 2
    delta += delta // n
    k = 0
    while delta > (BASE - T_MIN) * T_MAX // 2:
        delta //= BASE - T_MIN
        k += BASE
    return k + (BASE - T_MIN + 1) * delta // (delta + SKEW)


def _threshold(k: int, bias: int) -> int:
    return max(T_MIN, min(T_MAX, k - bias))


def punycode(label: str) -> str:
    """A label's Punycode, without prefix."""
    out = [c for c in label if ord(c) < 128]
    done = basic = len(out)
    if basic:
        out.append("-")
    n, delta, bias = INITIAL_N, 0, INITIAL_BIAS
    while done < len(label):
        nxt = min(ord(c) for c in label if ord(c) >= n)
        delta += (nxt - n) * (done + 1)
        n = nxt
        for c in label:
            if ord(c) < n:
                delta += 1
            elif ord(c) == n:
                q, k = delta, BASE
                while q >= (t := _threshold(k, bias)):
                    out.append(_DIGITS[t + (q - t) % (BASE - t)])
                    q, k = (q - t) // (BASE - t), k + BASE
                out.append(_DIGITS[q])
                bias = _adapted(delta, done + 1, done == basic)
                delta, done = 0, done + 1
        delta, n = delta + 1, n + 1
    return "".join(out)


def from_punycode(code: str) -> str:
    """The label of a Punycode; ValueError where it is none."""
    head, _, tail = code.rpartition("-")
    out, n, i, bias, at = list(head), INITIAL_N, 0, INITIAL_BIAS, 0
    while at < len(tail):
        before, weight, k = i, 1, BASE
        while True:
            if at == len(tail):
                raise ValueError("cut off")
            digit = _DIGITS.index(tail[at].lower())
            at, i = at + 1, i + digit * weight
            t = _threshold(k, bias)
            if digit < t:
                break
            weight, k = weight * (BASE - t), k + BASE
        bias = _adapted(i - before, len(out) + 1, before == 0)
        n, i = n + i // (len(out) + 1), i % (len(out) + 1)
        if n > 0x10FFFF or 0xD800 <= n < 0xE000:
            raise ValueError("no character")
        out.insert(i, chr(n))
        i += 1
    return "".join(out)


def normal_host(host: str | None) -> tuple[str | None, str | None, str | None]:
    """(ascii, unicode, error) of a host name or address."""
    if not host:
        return None, None, "empty"
    try:
        address = ipaddress.ip_address(host.strip("[]").rstrip("."))
        return str(address), str(address), None
    except ValueError:
        pass
    labels = unicodedata.normalize("NFKC", host.replace("ß", "\0").casefold().replace("\0", "ß")).replace("。", ".").removesuffix(".").split(".")
    coded, plain = [], []
    for label in labels:
        if not label:
            return None, None, "empty label"
        if len(label) > 63:
            return None, None, "label too long"
        if label[0] == "-" or label[-1] == "-":
            return None, None, "hyphen at an end"
        if any(c.isspace() or unicodedata.category(c) in ("Cc", "Cs") or (ord(c) < 128 and not (c.isalnum() or c in "-_")) for c in label):
            return None, None, "invalid character"
        try:
            shown = from_punycode(label[4:]) if label.startswith("xn--") else label
        except ValueError:
            return None, None, "invalid punycode"
        code = label if label.isascii() else "xn--" + punycode(label)
        if label.startswith("xn--") and ("xn--" + punycode(shown) != label or shown.isascii()):
            return None, None, "invalid punycode"
        if len(code) > 63:
            return None, None, "label too long"
        coded.append(code)
        plain.append(shown)
    return ".".join(coded), ".".join(plain), None


def normal_hosts(rows: DataFrame, host_col: str = "host") -> DataFrame:
    """``rows`` with ``ascii``, ``unicode`` and ``error`` of the host; the first two are null where there is an error."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            seen: dict = {}
            for h in batch.column(host_col).to_pylist():
                if h not in seen:
                    seen[h] = normal_host(h)
            made = [seen[h] for h in batch.column(host_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in made], pa.string()) for i in range(3))], [*batch.schema.names, "ascii", "unicode", "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "ascii string", "unicode string", "error string"])
    return rows.mapInArrow(run, schema)


def address_kind(host: Column) -> Column:
    """``ipv4``, ``ipv6``, or null for a name; brackets around an address are left out of account."""
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    four = r"((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    groups = F.size(F.filter(F.split(bare, ":"), lambda x: x != "")) + F.regexp_like(bare, F.lit(rf":{four}$")).cast("int")
    halves = F.size(F.split(bare, "::", -1))
    shape = F.regexp_like(bare, F.lit(rf"^[0-9A-Fa-f]{{0,4}}(:[0-9A-Fa-f]{{0,4}}){{1,8}}(:{four})?$|^([0-9A-Fa-f]{{0,4}}:){{1,6}}{four}$")) & ~F.regexp_like(bare, F.lit(r":::|^:[^:]|[^:]:$"))
    six = shape & (((halves == 1) & (groups == 8)) | ((halves == 2) & (groups <= 7)))
    return F.when(F.regexp_like(bare, F.lit(f"^{four}$")), "ipv4").when(six, "ipv6")


def suffix_rules(spark: SparkSession, rules: list[str] = SUFFIXES) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rules], "rule string")


def domain_parts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, subdomain, domain, suffix, registered_domain) of each distinct host, for rows (rule) of public suffixes.

    An address and ``localhost`` are their own domain and registered domain; so is a host of one label; a host that is
    itself a public suffix has no domain; null and empty hosts are left out.
    """
    own = hosts.select(F.lower(F.regexp_replace("host", r"\.$", "")).alias("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    named = own.where(address_kind(F.col("host")).isNull() & (F.size(labels) > 1))
    # All endings of a host, each as itself, as an exception, and with its first label as any.
    ends = named.select("host", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("n"), labels.alias("l"))
    text = F.array_join(F.slice("l", F.size("l") - F.col("n") + 1, F.col("n")), ".")
    any_first = F.concat(F.lit("*."), F.array_join(F.slice("l", F.size("l") - F.col("n") + 2, F.col("n") - 1), "."))
    kinds = F.array(F.struct(text.alias("rule"), F.col("n").alias("m"), F.lit(0).alias("first")), F.struct(F.concat(F.lit("!"), text).alias("rule"), (F.col("n") - 1).alias("m"), F.lit(1).alias("first")), F.when(F.col("n") > 1, F.struct(any_first.alias("rule"), F.col("n").alias("m"), F.lit(0).alias("first"))))
    asked = ends.select("host", F.inline(F.array_compact(kinds)))
    best = asked.join(rules.select("rule").distinct(), "rule").groupBy("host").agg(F.max(F.struct("first", "m"))["m"].alias("m"))
    met = own.join(best, "host", "left").withColumn("l", labels).withColumn("k", F.coalesce("m", F.lit(1)))
    whole = address_kind(F.col("host")).isNotNull() | (F.size("l") == 1)
    at = lambda start, n: F.array_join(F.slice("l", start, n), ".")
    n = F.size("l")
    suffix = F.when(~whole, at(n - F.col("k") + 1, F.col("k")))
    domain = F.when(whole, F.col("host")).when(n > F.col("k"), F.element_at("l", n - F.col("k")))
    sub = F.when(~whole & (n > F.col("k") + 1), at(F.lit(1), n - F.col("k") - 1))
    return met.select("host", sub.alias("subdomain"), domain.alias("domain"), suffix.alias("suffix"), F.when(whole, F.col("host")).when(n > F.col("k"), F.concat_ws(".", domain, suffix)).alias("registered_domain"))


#: Endings that pages' hosts are given, so that every kind of rule is met.
ENDINGS = ["example.co.uk", "example.com", "city.kawasaki.jp", "any.kawasaki.jp", "www.ck", "shop.ck", "project.readthedocs.io", "nowhere.zz", "co.jp"]
_HOST = "^[a-z]+://([^/?#:]*)"


def rendered_hosts(pages: DataFrame) -> DataFrame:
    """(host): the hosts of pages, and the first label of each with one of ``ENDINGS``."""
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    other = F.concat_ws(".", F.substring_index(host, ".", 1), F.element_at(F.array(*map(F.lit, ENDINGS)), (F.pmod("page_id", F.lit(len(ENDINGS))) + 1).cast("int")))
    return pages.select(F.explode(F.array(host, other)).alias("host"))


def word_hosts(docs: DataFrame) -> DataFrame:
    """(host): each word with a letter beyond ASCII as a label."""
    return docs.select(F.explode(tokens(F.col("text"))).alias("w")).where(F.regexp_like("w", F.lit("[^ -~]"))).select(F.concat("w", F.lit(".example")).alias("host")).distinct()


def round_trips(docs: DataFrame) -> DataFrame:
    """(host, back, is_ascii): hosts of words to ASCII, and back from there."""
    coded = normal_hosts(word_hosts(docs)).select(F.col("host").alias("from"), F.col("ascii").alias("host"))
    return normal_hosts(coded).select(F.col("from").alias("host"), F.col("unicode").alias("back"), F.regexp_like("ascii", F.lit(r"^xn--[a-z0-9-]+\.example$")).alias("is_ascii"))


QUERIES = {
    "ur_domains": lambda s, d: domain_parts(rendered_hosts(table(s, d, "pages")), suffix_rules(s)),
    "ur_international": lambda s, d: round_trips(spread(table(s, d, "documents"))),
}
_ENDS = ", ".join(map(quote, ENDINGS))
ORACLE = {
    "ur_domains": f"""WITH h AS (SELECT DISTINCT unnest([host, string_split(host, '.')[1] || '.' || [{_ENDS}][page_id % {len(ENDINGS)} + 1]]) AS host FROM (SELECT page_id, lower(regexp_extract(url, '{_HOST}', 1)) AS host FROM pages)),
r AS (SELECT unnest([{', '.join(map(quote, SUFFIXES))}]) AS rule),
e AS (SELECT host, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS n FROM h),
m AS (SELECT host, n - (starts_with(rule, '!'))::INT AS k, starts_with(rule, '!') AS x FROM e JOIN r ON rule = array_to_string(l[-n:], '.') OR rule = '!' || array_to_string(l[-n:], '.') OR n > 1 AND rule = '*.' || array_to_string(l[-n + 1:], '.')),
b AS (SELECT host, coalesce(max(k) FILTER (x), max(k)) AS k FROM m GROUP BY host),
p AS (SELECT host, string_split(host, '.') AS l, coalesce(k, 1) AS k FROM h LEFT JOIN b USING (host))
SELECT host, CASE WHEN len(l) > k + 1 THEN array_to_string(l[1 : len(l) - k - 1], '.') END AS subdomain, CASE WHEN len(l) > k THEN l[len(l) - k] END AS domain, array_to_string(l[len(l) - k + 1 :], '.') AS suffix, CASE WHEN len(l) > k THEN array_to_string(l[len(l) - k :], '.') END AS registered_domain FROM p""",
    "ur_international": r"SELECT DISTINCT w || '.example' AS host, w || '.example' AS back, true AS is_ascii FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) WHERE regexp_matches(w, '[^ -~]')",
}
