"""Guards of calls (circuit breaker, rate limit), counters, suggestions from past queries, payloads for charts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import ship
from ..sources.tables import table

# What is offered when the history is short.
COMMON_QUERIES = ["web development", "data science", "machine learning", "api", "testing", "database", "authentication", "visualization", "http client", "web framework", "async programming"]


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """``step(state, row)`` over each key's rows in order, giving (state, row out) for each.

    Rows stream through in batches with one state carried over, so a key of any size needs
    one state's memory; the rows of a key are taken one after the other, as a fold must.
    """
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                name = getattr(row, key)
                if name != at:
                    at, state = name, start(row)
                state, made = step(state, row)
                out.append(made)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _calls(events: DataFrame) -> DataFrame:
    """Events with a user as calls: who, which, when in microseconds, and whether it failed."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.where("user_id is not null and ts is not null").select("user_id", "event_id", us.alias("us"), (F.col("event_type") == "error").alias("failed"))


def circuit_breaker(calls: DataFrame, failures: int = 5, reset_us: int = 60_000_000, half_open_calls: int = 1) -> DataFrame:
    """(user_id, event_id, allowed, state after): closed until ``failures`` in a row, open for ``reset_us``, then half open until enough calls succeed or one fails."""

    def step(s, row):
        state, count, last, tried = s
        if state == "open" and row.us - last >= reset_us:
            state, tried = "half_open", 0
        allowed = state != "open"
        if allowed and row.failed:
            last = row.us
            if state == "half_open":
                state = "open"
            else:
                count += 1
                state = "open" if count >= failures else state
        elif allowed and state == "half_open":
            tried += 1
            if tried >= half_open_calls:
                state, count = "closed", 0
        elif allowed:
            count = 0
        return (state, count, last, tried), (row.user_id, row.event_id, allowed, state)

    return ordered_fold(calls, "user_id", ["us", "event_id"], lambda row: ("closed", 0, 0, 0), step, "user_id long, event_id long, allowed boolean, state string")


_CALLS_SQL = "e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"


def _breaker_sql(failures: int, reset_us: int, half_open_calls: int) -> str:
    return f"""WITH RECURSIVE {_CALLS_SQL}, s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, 'closed' AS state, 0 AS n, 0::BIGINT AS last, 0 AS tried FROM e
UNION ALL SELECT user_id, k, event_id, st <> 'open', CASE WHEN st = 'open' THEN st WHEN failed AND (st = 'half_open' OR n + 1 >= {failures}) THEN 'open' WHEN NOT failed AND st = 'half_open' AND tr + 1 >= {half_open_calls} THEN 'closed' ELSE st END,
  CASE WHEN st = 'closed' AND failed THEN n + 1 WHEN st = 'closed' OR (st = 'half_open' AND NOT failed AND tr + 1 >= {half_open_calls}) THEN 0 ELSE n END, CASE WHEN st <> 'open' AND failed THEN us ELSE last END, CASE WHEN st = 'half_open' AND NOT failed THEN tr + 1 ELSE tr END
  FROM (SELECT e.*, s.n, s.last, CASE WHEN s.state = 'open' AND e.us - s.last >= {reset_us} THEN 'half_open' ELSE s.state END AS st, CASE WHEN s.state = 'open' AND e.us - s.last >= {reset_us} THEN 0 ELSE s.tried END AS tr FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
SELECT user_id, event_id, allowed, state FROM s WHERE k > 0"""


def rate_limit(calls: DataFrame, most: int = 10, period_us: int = 60_000_000) -> DataFrame:
    """(user_id, event_id, waited, tokens left): whole tokens come back with time; a call that finds none waits for one."""

    def refill(tokens, last, now):
        new = (now - last) * most // period_us
        return (min(tokens + new, most), now) if new > 0 else (tokens, last)

    def step(s, row):
        tokens, last = refill(*s, row.us)
        waited = tokens < 1
        if waited:
            tokens, last = refill(tokens, last, row.us + period_us // most)
        return (tokens - 1, last), (row.user_id, row.event_id, waited, tokens - 1)

    return ordered_fold(calls, "user_id", ["us", "event_id"], lambda row: (most, row.us), step, "user_id long, event_id long, waited boolean, tokens long")


def _rate_sql(most: int, period_us: int) -> str:
    new = f"greatest(0, (us - last) * {most} // {period_us})"
    later = f"greatest(0, (us + {period_us // most} - l1) * {most} // {period_us})"
    return f"""WITH RECURSIVE {_CALLS_SQL}, s AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BOOLEAN AS waited, {most}::BIGINT AS tokens, us AS last FROM e WHERE k = 1
UNION ALL SELECT user_id, k, event_id, t1 < 1, CASE WHEN t1 < 1 AND n2 > 0 THEN least(t1 + n2, {most}) ELSE t1 END - 1, CASE WHEN t1 < 1 AND n2 > 0 THEN us + {period_us // most} ELSE l1 END
  FROM (SELECT *, {later} AS n2 FROM (SELECT user_id, k, event_id, us, CASE WHEN n1 > 0 THEN least(tokens + n1, {most}) ELSE tokens END AS t1, CASE WHEN n1 > 0 THEN us ELSE last END AS l1 FROM (SELECT e.user_id, e.k, e.event_id, e.us, s.tokens, s.last, {new} AS n1 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))))
SELECT user_id, event_id, waited, tokens FROM s WHERE k > 0"""


def running_metrics(events: DataFrame) -> DataFrame:
    """Per user what a backend counts as it runs: calls, their total, mean, least and most, and the share that succeeded."""
    ok = (F.col("event_type") != "error").cast("int")
    return events.groupBy("user_id").agg(F.count("*").alias("n_calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg(ok), 6).alias("success_rate"))


def manager_status(events: DataFrame) -> DataFrame:
    """Tasks by state, tasks done a day between the first event and the last, and the mean time of those done."""
    kind = F.col("event_type")
    done = kind.isin("purchase", "signup")
    counts = [F.count_if(c).alias(n) for n, c in (("pending", kind == "view"), ("running", kind == "click"), ("completed", done), ("failed", kind == "error"))]
    days = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(86_400_000_000)
    return events.agg(*counts, F.count("*").alias("total"), F.round(F.count_if(done) / days, 6).alias("throughput"), F.round(F.avg(F.when(done, F.col("value"))), 4).alias("mean_time"))


def query_suggestions(queries: DataFrame, partial: str, limit: int = 10) -> DataFrame:
    """(query, n): past queries that hold ``partial``, those that begin with it first, then by count."""
    low = F.lower("query")
    met = queries.where(F.contains(low, F.lit(partial.lower()))).groupBy("query").agg(F.count("*").alias("n"))
    return met.orderBy(F.startswith(low, F.lit(partial.lower())).desc(), F.desc("n"), "query").limit(limit)


def related_suggestions(history: DataFrame, libraries: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(term, kind): past terms that share a word with ``query``, in the order first seen, then libraries whose name holds one."""
    words = sorted(set(query.lower().split()))
    shares: Column = F.arrays_overlap(F.split("term", r"\s+"), F.array(*[F.lit(w) for w in words]))
    past = history.where(shares & (F.col("term") != query.lower())).groupBy("term").agg(F.min("seen").alias("seen")).withColumn("kind", F.lit(0))
    holds = F.lit(False)
    for w in words:
        holds = holds | F.contains("term", F.lit(w))
    named = libraries.where(holds).groupBy("term").agg(F.min("seen").alias("seen")).withColumn("kind", F.lit(1))
    each = past.unionByName(named).groupBy("term").agg(F.min(F.struct("kind", "seen")).alias("x"))
    return each.orderBy("x.kind", "x.seen", "term").limit(limit).select("term", "x.kind")


def trending_searches(history: DataFrame, limit: int = 10) -> DataFrame:
    """(place, term): the five words most searched for, then common queries that are not among them."""
    words = history.select(F.explode(F.split("term", r"\s+")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))
    top = words.orderBy(F.desc("n"), "term").limit(5).select("term", F.struct(F.lit(0).alias("kind"), (-F.col("n")).alias("at")).alias("x"))
    common = history.sparkSession.createDataFrame([(q, i) for i, q in enumerate(COMMON_QUERIES)], "term string, at long").select("term", F.struct(F.lit(1).alias("kind"), "at").alias("x"))
    each = top.unionByName(common).groupBy("term").agg(F.min("x").alias("x"))
    return each.orderBy("x.kind", "x.at", "term").limit(limit).select("term", "x.kind")


def chart(df: DataFrame, kind: str, label: str, value: str) -> DataFrame:
    """One row: a chart's payload as JSON; ``df`` is what the chart shows, so no more than it can hold."""
    points = F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col(value).alias("v"))))
    made = df.agg(points.alias("p"))
    data = F.struct(F.transform("p", lambda x: x["l"]).alias("labels"), F.transform("p", lambda x: x["v"]).alias("values"))
    return made.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(f"{kind.capitalize()} Chart").alias("title"), data.alias("data"))).alias("payload"))


def table_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, cells): each row's cells as a table's body holds them; a null is the text ``None``."""
    cells = F.array(*[F.struct(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("text")) for c in df.columns])
    return df.select(key, F.to_json(cells).alias("cells"))


def _history(s, d: str) -> DataFrame:
    return table(s, d, "part").select(F.lower("p_name").alias("term"), F.col("p_partkey").alias("seen"))


def _libraries(s, d: str) -> DataFrame:
    return table(s, d, "part").select(F.lower("p_type").alias("term"), F.col("p_partkey").alias("seen"))


BREAKER, RATE = (2, 86_400_000_000, 1), (3, 4 * 86_400_000_000)
QUERIES = {
    "st_circuit_breaker": lambda s, d: circuit_breaker(_calls(table(s, d, "events")), *BREAKER),
    "st_rate_limit": lambda s, d: rate_limit(_calls(table(s, d, "events")), *RATE),
    "an_running_metrics": lambda s, d: running_metrics(table(s, d, "events")),
    "cr_manager_status": lambda s, d: manager_status(table(s, d, "events")),
    "an_query_suggestions": lambda s, d: query_suggestions(table(s, d, "part").select(F.col("p_name").alias("query")), "r"),
    "se_related_suggestions": lambda s, d: related_suggestions(_history(s, d), _libraries(s, d), "Small ring"),
    "se_trending_searches": lambda s, d: trending_searches(_history(s, d)),
    "io_chart": lambda s, d: chart(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "bar", "event_type", "n"),
    "io_table_rows": lambda s, d: table_rows(table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey"),
}
_LIST = "[" + ", ".join(f"'{q}'" for q in COMMON_QUERIES) + "]"
ORACLE = {
    "st_circuit_breaker": _breaker_sql(*BREAKER),
    "st_rate_limit": _rate_sql(*RATE),
    "an_running_metrics": "SELECT user_id, count(*) AS n_calls, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, round(avg((event_type <> 'error')::INT), 6) AS success_rate FROM events GROUP BY user_id",
    "cr_manager_status": "SELECT count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'click') AS running, count(*) FILTER (event_type IN ('purchase', 'signup')) AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total, round(count(*) FILTER (event_type IN ('purchase', 'signup')) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000), 6) AS throughput, round(avg(value) FILTER (event_type IN ('purchase', 'signup')), 4) AS mean_time FROM events",
    "an_query_suggestions": "SELECT p_name AS query, count(*) AS n FROM part WHERE contains(lower(p_name), 'r') GROUP BY p_name ORDER BY starts_with(lower(p_name), 'r') DESC, n DESC, query LIMIT 10",
    "se_related_suggestions": """SELECT term, kind FROM (SELECT term, min(row(kind, seen)) AS x, min(kind) AS kind FROM (SELECT lower(p_name) AS term, 0 AS kind, p_partkey AS seen FROM part WHERE list_has_any(regexp_split_to_array(lower(p_name), '\\s+'), ['ring', 'small']) AND lower(p_name) <> 'small ring'
  UNION ALL SELECT lower(p_type), 1, p_partkey FROM part WHERE contains(lower(p_type), 'ring') OR contains(lower(p_type), 'small')) GROUP BY term) ORDER BY x, term LIMIT 5""",
    "se_trending_searches": f"""WITH w AS (SELECT term, 0 AS kind, -count(*) AS pos FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '\\s+')) AS term FROM part) WHERE term <> '' GROUP BY term ORDER BY count(*) DESC, term LIMIT 5)
SELECT term, min(kind) AS kind FROM (SELECT * FROM w UNION ALL SELECT q, 1, i FROM (SELECT unnest({_LIST}) AS q, generate_subscripts({_LIST}, 1) AS i)) GROUP BY term ORDER BY min(row(kind, pos)), term LIMIT 10""",
    "io_chart": "SELECT to_json({'type': 'bar', 'title': 'Bar Chart', 'data': {'labels': list(event_type ORDER BY event_type), 'values': list(n ORDER BY event_type)}})::VARCHAR AS payload FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)",
    "io_table_rows": "SELECT p_partkey, to_json([{'text': coalesce(p_partkey::VARCHAR, 'None')}, {'text': coalesce(p_name, 'None')}, {'text': coalesce(p_brand, 'None')}, {'text': coalesce(p_type, 'None')}, {'text': coalesce(p_size::VARCHAR, 'None')}])::VARCHAR AS cells FROM part",
}
