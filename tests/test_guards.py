"""Patterns guarded by plain strings count what they count without."""

import random
import re

from pyspark.sql import functions as F

from lorespark.functions import expressions
from lorespark.operators import text


def patterns():
    both = [p for group in (text.DOCUMENTATION, text.OTHER) for ps in group.values() for p in ps]
    return both + [p for _, _, ps in text.LEVELS.values() for p in ps]


def test_any_match_holds_a_plain_string():
    words = sorted({w for p in patterns() for w in re.findall(r"[a-z#:/`]+", p)} | {"docs", "import x", "```a```", "step 3", "configured", "api\nreference", ""})
    r = random.Random(2)
    for p in patterns():
        plain = expressions.literals(p)
        assert plain
        for _ in range(300):
            t = r.choice(["", " ", "x"]).join(r.choice(words) for _ in range(8))
            assert not re.search(p, t) or any(x in t for x in plain), (p, t)


def test_patterns_without_a_plain_string():
    assert expressions.literals(r"\d+") is None and expressions.literals(r"(a|b)c") is None and expressions.literals(r"a|\w") is None
    assert expressions.literals(r"\bab?c|de*") == ["a", "d"]


def test_counts_on_spark(spark):
    r = random.Random(5)
    words = ["api", "docs", "documentation", "install", "how to", "import os", "```x```", "pull request", "step 1", "first time", "xapi", "licensed", "license", None]
    rows = [(i, " ".join(r.choice(words[:-1]) for _ in range(20))) for i in range(40)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    low = F.lower("t")
    pairs = [(expressions.guarded_matches(low, p), expressions.matches(low, p)) for p in patterns()]
    pairs += [(expressions.guarded_occurrences(low, w), expressions.occurrences(low, w)) for w in ("api", "how to", "zzz")]
    for row in df.select(*[F.coalesce(b, F.lit(0)).eqNullSafe(a).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).collect():
        assert all(row)


def test_finished_nodes_do_not_meet_in_one_task(spark):
    from lorespark.operators import graph

    chains = [(10 * c + k, 10 * c + k - 1 if k else None) for c in range(800) for k in range(5)]
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("false", "-1"), strict=True):
        spark.conf.set(n, v)
    try:
        got = graph.depths(spark.createDataFrame(chains, "child long, parent long").repartition(8))
        # Joined rows come out by their key: nodes without one would be in one file.
        files = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
        rows = {tuple(r) for r in got.collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert rows == {(10 * c + k, 10 * c, k) for c in range(800) for k in range(5)}
    assert max(files) < len(chains) / 2


def test_batches_to_python_are_bounded(spark):
    from lorespark.sources.session import BATCHES, ship

    for name, own in zip(BATCHES, ("10000", "67108864b"), strict=True):
        spark.conf.set(name, own)
    ship(spark)
    assert {n: spark.conf.get(n) for n in BATCHES} == BATCHES


def test_lower_case_is_made_once(spark):
    from lorespark.operators import discovery

    docs = spark.createDataFrame([(1, "API docs"), (2, None)], "doc_id long, text string")
    for query in (text.matched_patterns, discovery.use_cases, discovery.detected_use_cases):
        plan = query(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(") == 1, query.__name__
