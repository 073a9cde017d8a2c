"""Streams over the tables' schemas: windows and sessions, and what runs a stream once into files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import folder
from . import stateful


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files; times become instants, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern, the path may name a file or a folder of files.
    raw = spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def sliding_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "total")


def user_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, through the stream, as a table of files in the shared folder.

    Appended rows go to Spark's own file sink; a mode that gives changed rows again writes each batch as a folder of
    its own, over what an attempt before it left: ``complete`` is the last batch, ``update`` all of them, by ``batch``.
    """
    spark = stream.sparkSession
    home = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{home}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{home}/out")
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")
        done.append(number)

    writer.foreachBatch(write).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{home}/out/batch={max(done)}")
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{home}/out")


def bucket_totals(events: DataFrame) -> DataFrame:
    """(user_id, allowed, refused): what a user's token bucket let through."""
    each = run_once(stateful.token_bucket(events), "append")
    return each.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def latest_counts(events: DataFrame) -> DataFrame:
    """(user_id, n, n_over): the last of each user's running counts."""
    each = run_once(stateful.running_counts(events), "update")
    return each.groupBy("user_id").agg(F.max_by(F.struct("n", "n_over"), "batch").alias("last")).select("user_id", "last.*")


QUERIES = {
    "st_daily_counts": lambda s, d: run_once(daily_counts(event_stream(s, d)), "complete"),
    "st_sliding_counts": lambda s, d: run_once(sliding_counts(event_stream(s, d)), "complete"),
    "st_user_sessions": lambda s, d: run_once(user_sessions(event_stream(s, d)), "complete"),
    "st_token_bucket": lambda s, d: bucket_totals(event_stream(s, d)),
    "st_bucket_events": lambda s, d: run_once(stateful.token_bucket(event_stream(s, d), 2, 12 * stateful.HOUR_US), "append"),
    "st_silences": lambda s, d: run_once(stateful.silences(event_stream(s, d)), "append"),
    "st_running_counts": lambda s, d: latest_counts(event_stream(s, d)),
}
_HOUR = stateful.HOUR_US


def _bucket_sql(capacity: int, every: int) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
t AS (SELECT user_id, event_id, k, us, {(capacity - 1) * every}::BIGINT AS units, true AS allowed FROM e WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, us, units - CASE WHEN units >= {every} THEN {every}::BIGINT ELSE 0 END, units >= {every} FROM (SELECT e.*, least({capacity * every}::BIGINT, t.units + e.us - t.us) AS units FROM t JOIN e ON e.user_id = t.user_id AND e.k = t.k + 1))
SELECT user_id, event_id, allowed FROM t"""


ORACLE = {
    "st_token_bucket": f"SELECT user_id, count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS refused FROM ({_bucket_sql(5, _HOUR)}) GROUP BY user_id",
    "st_bucket_events": _bucket_sql(2, 12 * _HOUR),
    "st_silences": f"WITH e AS (SELECT user_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), s AS (SELECT * FROM e WHERE coalesce(nxt - us >= 12 * {_HOUR}, us + 12 * {_HOUR} <= (SELECT max(epoch_us(ts)) FROM events) - {_HOUR})) SELECT user_id, us AS last_us, k - coalesce(lag(k) OVER (PARTITION BY user_id ORDER BY k), 0) AS beats FROM s",
    "st_running_counts": "SELECT user_id, count(*) AS n, count(*) FILTER (value > 50) AS n_over FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id",
    "st_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "st_sliding_counts": "SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([ts::DATE, ts::DATE - 1]) AS day FROM events) GROUP BY day",
    "st_user_sessions": "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 21600000000, true) AS fresh FROM events)) GROUP BY user_id, k",
}
