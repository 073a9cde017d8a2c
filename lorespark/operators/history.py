"""Versions and diffs, interaction analytics, and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept, table
from .setjoin import most_alike

#: Interactions weigh by kind (fixed values): looked up, seen, taken.
KIND_WEIGHT = {"view": 1.0, "click": 2.0, "purchase": 5.0}
#: The moment that windows are relative to; callers give their own.
AS_OF = "2024-01-31 00:00:00"


def status_versions(orders: DataFrame, keep: int = 10) -> DataFrame:
    """A new version wherever the status differs from the last; the newest ``keep`` of each customer, numbered from the first."""
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    changed = orders.withColumn("last", F.lag("o_orderstatus").over(line)).where(F.col("last").isNull() | (F.col("last") != F.col("o_orderstatus")))
    numbered = changed.withColumn("version", F.row_number().over(line)).withColumn("age", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())))
    return numbered.where(F.col("age") <= keep).select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"), F.substring(F.sha2("o_orderstatus", 256), 1, 16).alias("hash"))


def latest_versions(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count("*").alias("n_versions"))


def page_diff(old: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """(key, change): added, removed, modified or same, by a full outer join."""
    a, b = old.select(F.col(key), F.md5(body).alias("x")), new.select(F.col(key), F.md5(body).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "modified").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def source_diff(docs: DataFrame) -> DataFrame:
    """Two sources as versions of one library: their first lines as pages, compared by body."""
    page = F.substring_index("text", "\n", 1)
    side = lambda name: docs.where(F.col("source") == name).groupBy(page.alias("page")).agg(F.min("text").alias("text"))
    return page_diff(side("src0"), side("src1"), "page", "text").groupBy("change").agg(F.count("*").alias("n"))


def version_key(version: Column) -> Column:
    """Three numbers of a version, missing ones 0, a leading v ignored."""
    parts = F.split(F.regexp_replace(version, "^[vV]", ""), r"\.")
    return F.transform(F.slice(F.concat(parts, F.array(F.lit("0"), F.lit("0"))), 1, 3), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def version_order(parts: DataFrame) -> DataFrame:
    """Sizes and keys as versions: which of neighbours is newer."""
    v = parts.select("p_partkey", F.concat_ws(".", F.lit("v1"), F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")).alias("version"))
    line = Window.partitionBy(F.col("p_partkey") % 50).orderBy("p_partkey")
    return v.withColumn("before", F.lag("version").over(line)).select("p_partkey", "version", (version_key(F.col("version")) > version_key(F.col("before"))).alias("newer"))


def trending(events: DataFrame, as_of: str = AS_OF, days: int = 7, top: int = 10) -> DataFrame:
    """Kinds' weights decayed to nothing over 24 hours; counts over the period; users with a score, best first."""
    now = F.lit(as_of).cast("timestamp_ntz")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000
    weight = F.create_map(*[F.lit(x) for kv in KIND_WEIGHT.items() for x in kv])
    recent = events.where((age >= 0) & (age <= 24 * days)).select("user_id", "event_type", (F.coalesce(F.try_element_at(weight, "event_type"), F.lit(0.0)) * F.greatest(F.lit(0.0), 1 - age / 24)).alias("s"))
    by = recent.groupBy("user_id").agg(F.round(F.sum("s"), 6).alias("score"), *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in KIND_WEIGHT])
    return by.where("score > 0").orderBy(F.col("score").desc(), "user_id").limit(top)


_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3600000000"
_TRENDING_SQL = f"""SELECT * FROM (SELECT user_id, round(sum(w * greatest(0.0, 1 - age / 24)), 6) AS score, {", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in KIND_WEIGHT)} FROM (
  SELECT *, {_AGE} AS age, (CASE event_type {" ".join(f"WHEN '{k}' THEN {w}" for k, w in KIND_WEIGHT.items())} ELSE 0 END)::DOUBLE AS w FROM events) WHERE age >= 0 AND age <= 168 GROUP BY user_id) WHERE score > 0 ORDER BY score DESC, user_id LIMIT 10"""


def popular(events: DataFrame) -> DataFrame:
    """Counts, means and shares by kind; the total is a window over few rows."""
    by = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))
    return by.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def daily_trend(events: DataFrame) -> DataFrame:
    """Days of the first and of the second half: mean counts, change in percent, the busiest day."""
    days = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    d = days.withColumn("k", F.row_number().over(Window.orderBy("day"))).withColumn("half", F.floor(F.count("*").over(whole) / 2))
    first, second = F.avg(F.when(F.col("k") <= F.col("half"), F.col("n"))), F.avg(F.when(F.col("k") > F.col("half"), F.col("n")))
    return d.agg(F.count("*").alias("n_days"), F.round(first, 6).alias("first_half"), F.round(second, 6).alias("second_half"), F.round(100 * (second - first) / first, 6).alias("change"), F.date_format(F.max_by("day", F.struct("n", -F.datediff("day", F.lit("2000-01-01").cast("date")))), "yyyy-MM-dd").alias("peak"))


def temporal(events: DataFrame) -> DataFrame:
    """Counts by weekday (Monday 0) and hour."""
    return events.groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def zero_results(events: DataFrame) -> DataFrame:
    """Searches whose number of results (the value, rounded down) is 0: count and rate by kind."""
    empty = F.floor("value") <= 0
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(empty).alias("n_zero"), F.round(F.avg(empty.cast("int")) * 100, 4).alias("rate"))


def user_performance(events: DataFrame) -> DataFrame:
    """One row for each user: times, extremes, frequency by day, clicks for views."""
    by = events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"), F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    return by.select("user_id", "n", "avg_value", "min_value", "max_value", F.round(F.col("clicks") / F.col("views"), 6).alias("ctr"), F.round(F.col("n") / F.greatest(F.datediff("b", "a"), F.lit(1)), 6).alias("per_day"))


def backend_scores(events: DataFrame) -> DataFrame:
    """Kinds as backends, users as domains: the score of the mean time, and the best backend of at least three samples."""
    by = events.groupBy("user_id", "event_type").agg(F.avg("value").alias("t"), F.count("*").alias("n"))
    score = F.round(0.4 * F.greatest(F.lit(0.0), 1 - F.col("t") / 500) + 0.1, 9)
    best = by.where("n >= 3").withColumn("score", score).groupBy("user_id").agg(F.max_by("event_type", F.struct("score", "event_type")).alias("backend"), F.round(F.max("score"), 6).alias("score"))
    return by.select("user_id").distinct().join(best, "user_id", "left").select("user_id", F.coalesce("backend", F.lit("http")).alias("backend"), "score")


def kind_report(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.stddev_samp("value"), 4).alias("std"), F.countDistinct("user_id").alias("n_users"))


def growth(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Last day's count against the week's daily mean, in percent, by user; the strongest five."""
    now = F.lit(as_of).cast("timestamp_ntz")
    by = events.where(F.col("ts") >= now - F.expr("interval 7 days")).groupBy("user_id").agg(F.count_if(F.col("ts") >= now - F.expr("interval 2 days")).alias("day"), F.count("*").alias("week"))
    return by.select("user_id", "day", "week", F.round((F.col("day") - F.col("week") / 7) / (F.col("week") / 7) * 100, 6).alias("growth")).orderBy(F.col("growth").desc(), "user_id").limit(5)


def sessions(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"))


def event_sessions(events: DataFrame, gap_minutes: int = 360) -> DataFrame:
    """Sessions of each user, cut where nothing happens for the gap."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(line).cast("timestamp"))) > gap_minutes * 60_000_000, F.lit(True))
    return events.withColumn("new", new).groupBy("user_id").agg(F.count_if("new").alias("n_sessions"), F.count("*").alias("n_events"))


def similar_users(events: DataFrame, top: int = 5, least: float = 0.2) -> DataFrame:
    """Users alike by the days they are active on: more than ``least``, the best ``top`` of each user."""
    days = events.where((F.col("event_type") == "purchase") & F.col("user_id").isNotNull()).groupBy(F.col("user_id").alias("id")).agg(F.collect_set(F.unix_date(F.col("ts").cast("date"))).alias("terms"))
    best = most_alike(days, top, least)
    return best.select(F.col("id").alias("a"), F.col("other").alias("b"), "similarity", F.col("rank").cast("long").alias("rank"))


def recommendations(orders: DataFrame, lineitem: DataFrame, parts: DataFrame, top: int = 3) -> DataFrame:
    """Brands a customer has bought point to others of the same type: 0.8 of what was bought, of brands not bought yet."""
    bought = orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey", "p_type", "p_brand").agg(F.count("*").alias("w"))
    dim = parts.select("p_type", F.col("p_brand").alias("other")).distinct()
    offers = bought.groupBy("o_custkey", "p_type").agg(F.sum("w").alias("w")).join(dim, "p_type").groupBy("o_custkey", "other").agg(F.sum("w").alias("w"))
    seen = bought.select("o_custkey", F.col("p_brand").alias("other")).distinct()
    fresh = offers.join(seen, ["o_custkey", "other"], "left_anti")
    ranked = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("w").desc(), "other"))).where(F.col("rank") <= top)
    return ranked.select("o_custkey", "other", F.round(F.col("w") * 0.8, 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_E = lambda f: lambda s, d: f(table(s, d, "events"))
QUERIES = {
    "ve_status_versions": lambda s, d: status_versions(table(s, d, "orders")),
    "ve_latest": lambda s, d: latest_versions(table(s, d, "orders")),
    "ve_source_diff": lambda s, d: source_diff(table(s, d, "documents")),
    "ve_order": lambda s, d: version_order(table(s, d, "part")),
    "an_trending": _E(trending),
    "an_popular": _E(popular),
    "an_daily_trend": _E(daily_trend),
    "an_temporal": _E(temporal),
    "an_zero_results": _E(zero_results),
    "an_user_performance": _E(user_performance),
    "an_backend_scores": _E(backend_scores),
    "an_kind_report": _E(kind_report),
    "an_growth": _E(growth),
    "an_sessions": lambda s, d: sessions(table(s, d, "conversations")),
    "an_event_sessions": _E(event_sessions),
    "re_similar_users": _E(similar_users),
    "re_recommendations": lambda s, d: recommendations(table(s, d, "orders"), table(s, d, "lineitem"), table(s, d, "part")),
}
_V3 = "[coalesce(try_cast(x AS INT), 0) for x in (string_split(regexp_replace({0}, '^[vV]', ''), '.') || ['0', '0'])[1:3]]"
ORACLE = {
    "ve_status_versions": "WITH c AS (SELECT * FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last FROM orders) WHERE last IS NULL OR last <> o_orderstatus), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM c) SELECT o_custkey, o_orderkey, version, substr(sha256(o_orderstatus), 1, 16) AS hash FROM n WHERE age <= 10",
    "ve_latest": "SELECT o_custkey, max_by(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey, count(*) AS n_versions FROM orders GROUP BY o_custkey",
    "ve_source_diff": "WITH p AS (SELECT source, string_split(text, chr(10))[1] AS page, min(text) AS text FROM documents WHERE source IN ('src0', 'src1') GROUP BY ALL), a AS (SELECT * FROM p WHERE source = 'src0'), b AS (SELECT * FROM p WHERE source = 'src1') SELECT CASE WHEN a.page IS NULL THEN 'added' WHEN b.page IS NULL THEN 'removed' WHEN a.text <> b.text THEN 'modified' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN b ON a.page = b.page GROUP BY 1",
    "ve_order": f"SELECT p_partkey, version, {_V3.format('version')} > {_V3.format('before')} AS newer FROM (SELECT *, lag(version) OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS before FROM (SELECT p_partkey, 'v1.' || p_size || '.' || (p_partkey % 7) AS version FROM part))",
    "an_trending": _TRENDING_SQL,
    "an_popular": "SELECT *, round(100 * n / sum(n) OVER (), 4) AS share FROM (SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY event_type)",
    "an_daily_trend": "WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY day) AS k, (count(*) OVER ()) // 2 AS half FROM d), h AS (SELECT count(*) AS n_days, avg(n) FILTER (k <= half) AS f, avg(n) FILTER (k > half) AS s FROM k) SELECT n_days, round(f, 6) AS first_half, round(s, 6) AS second_half, round(100 * (s - f) / f, 6) AS change, (SELECT strftime(day, '%Y-%m-%d') FROM d ORDER BY n DESC, day LIMIT 1) AS peak FROM h",
    "an_temporal": "SELECT (isodow(ts) - 1)::INT AS weekday, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2",
    "an_zero_results": "SELECT event_type, count(*) AS n, count(*) FILTER (floor(value) <= 0) AS n_zero, round(avg((floor(value) <= 0)::INT) * 100, 4) AS rate FROM events GROUP BY event_type",
    "an_user_performance": "SELECT user_id, n, avg_value, min_value, max_value, round(clicks / views, 6) AS ctr, round(n / greatest(b - a, 1), 6) AS per_day FROM (SELECT user_id, count(*) AS n, round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) FILTER (event_type = 'click') AS clicks, nullif(count(*) FILTER (event_type = 'view'), 0) AS views, min(ts)::DATE AS a, max(ts)::DATE AS b FROM events GROUP BY user_id)",
    "an_backend_scores": "WITH b AS (SELECT user_id, event_type, count(*) AS n, round(0.4::DOUBLE * greatest(0.0, 1 - avg(value) / 500) + 0.1::DOUBLE, 9) AS score FROM events GROUP BY ALL), m AS (SELECT user_id, max_by(event_type, row(score, event_type)) AS backend, round(max(score), 6) AS score FROM b WHERE n >= 3 GROUP BY user_id) SELECT user_id, coalesce(backend, 'http') AS backend, score FROM (SELECT DISTINCT user_id FROM b) LEFT JOIN m USING (user_id)",
    "an_kind_report": "SELECT event_type, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, round(stddev_samp(value), 4) AS std, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
    "an_growth": f"SELECT user_id, day, week, round((day - week / 7) / (week / 7) * 100, 6) AS growth FROM (SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY) AS day, count(*) AS week FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY user_id) ORDER BY growth DESC, user_id LIMIT 5",
    "an_sessions": "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id",
    "an_event_sessions": "SELECT user_id, count(*) FILTER (fresh) AS n_sessions, count(*) AS n_events FROM (SELECT user_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000, true) AS fresh FROM events) GROUP BY user_id",
    "re_similar_users": "WITH p AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, count(*) AS n FROM p GROUP BY user_id), b AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS shared FROM p x JOIN p y ON x.day = y.day AND x.user_id <> y.user_id GROUP BY ALL), j AS (SELECT a, b, round(shared / (m.n + n.n - shared), 6) AS similarity FROM b JOIN s m ON m.user_id = a JOIN s n ON n.user_id = b) SELECT a, b, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM j WHERE similarity > 0.2) WHERE rank <= 5",
    "re_recommendations": "WITH b AS (SELECT o_custkey, p_type, p_brand, count(*) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), o AS (SELECT o_custkey, other, sum(w) AS w FROM (SELECT o_custkey, p_type, sum(w) AS w FROM b GROUP BY ALL) JOIN (SELECT DISTINCT p_type, p_brand AS other FROM part) USING (p_type) GROUP BY ALL), f AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_custkey = o.o_custkey AND b.p_brand = o.other)) SELECT o_custkey, other, round(w * 0.8::DOUBLE, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, other) AS rank FROM f) WHERE rank <= 3",
}
