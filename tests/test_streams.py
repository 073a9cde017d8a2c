"""State over several batches, against plain folds."""

import random
import uuid

from pyspark.sql import functions as F

from lorespark.sources import tables
from lorespark.streaming import events, stateful

HOUR = stateful.HOUR_US
START = 1_704_067_200_000_000


def rows_of(seed, n=300):
    r = random.Random(seed)
    at, out = START, []
    for i in range(n):
        at += r.choice([0, HOUR // 3, HOUR, 3 * HOUR])
        out.append((i, r.choice([1, 2, 3, 4]) if r.random() < 0.97 else None, at, float(r.randrange(100))))
    return out


def stream_of(spark, rows, n_files):
    path = f"{tables.folder(spark)}/events-{uuid.uuid4().hex}"
    size = -(-len(rows) // n_files)
    for k in range(n_files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], "event_id long, user_id long, us long, value double").select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), "value").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("event_id long, user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(path)


def test_bucket_over_batches(spark):
    rows = rows_of(1)
    got = {r["event_id"]: r["allowed"] for r in events.run_once(stateful.token_bucket(stream_of(spark, rows, 4), 2, 6 * HOUR), "append").collect()}
    want, state = {}, {}
    for i, user, us, _ in rows:
        if user is not None:
            units, last = state.get(user, (12 * HOUR, us))
            units = min(12 * HOUR, units + us - last)
            want[i] = units >= 6 * HOUR
            state[user] = (units - 6 * HOUR * want[i], us)
    assert got == want and 0 < sum(got.values()) < len(got)


def test_silences_by_timer(spark):
    rows = rows_of(2, 120) + [(1000, 9, START + 200 * 24 * HOUR, 0.0)]
    got = sorted((r["user_id"], r["last_us"], r["beats"]) for r in events.run_once(stateful.silences(stream_of(spark, rows, 3), 10 * HOUR), "append").collect())
    want, seen = [], {}
    for _, user, us, _ in rows:
        if user is not None:
            last, beats = seen.get(user, (None, 0))
            if last is not None and us - last >= 10 * HOUR:
                want.append((user, last, beats))
                beats = 0
            seen[user] = (us, beats + 1)
    want += [(u, last, beats) for u, (last, beats) in seen.items() if u != 9]
    assert got == sorted(want)


def test_running_counts_by_batch(spark):
    rows = rows_of(3)
    each = events.run_once(stateful.running_counts(stream_of(spark, rows, 3)), "update")
    assert each.select("batch").distinct().count() == 3
    got = {r["user_id"]: (r["n"], r["n_over"]) for r in events.latest_counts(stream_of(spark, rows, 2)).collect()}
    assert got == {u: (sum(x[1] == u for x in rows), sum(x[1] == u and x[3] > 50 for x in rows)) for u in (1, 2, 3, 4)}


def test_no_events(spark):
    none = stream_of(spark, rows_of(4)[:1], 1).where("event_id < 0")
    assert events.run_once(stateful.token_bucket(none), "append").count() == 0
