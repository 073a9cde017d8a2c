"""Mixing sources to target weights by Sainte-Lague apportionment.  DataFrame functions only.

Every source gets a target (its weight's share of ``share`` times all words, at most
``most`` times its own words, what that leaves reshared by weight).  Targets are cut in
blocks of ``block`` words, which go to sources by the highest quotients
target / (2 k - 1), then from each source to its shards the same way.  A shard is its
documents one after another in seeded order, read round and round in blocks from a
seeded place; its quota of blocks is what it gives.  What a document gives follows from
where it lies, so no block is ever a row.

Defined results: a null text has size 0; the null source is a source, last in order;
ties of quotients go to the earlier source or shard; repeated rows, ids and null ids are
documents of their own; with no words at all every target and every quantity is 0; a text
may have any length; columns named like the results only clash if they are the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    """60 bits of md5: any engine computes them."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``sizes`` (source, source_size, rows) with position, weight and target; one row for each source."""
    num, den = share
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("position", order).withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("position") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "position").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("all_words", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    w = w.withColumn("words_before", F.coalesce(F.sum("source_size").over(by_fill), F.lit(0))).withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(by_fill), F.lit(0)))
    # In order of size for weight, a source is full if what is left would give it more than it may get.
    level = (num * F.col("all_words") - den * most * F.col("words_before")).cast("double") / (den * F.col("weight_left"))
    w = w.withColumn("full", (most * F.col("source_size")).cast("double") <= level * F.col("weight"))
    full_words = F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    rest = (num * F.col("all_words") - den * most * full_words).cast("double") * F.col("weight") / (den * open_weight)
    return w.select("source", "source_size", "rows", "position", "weight", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(rest).alias("target"))


def sainte_lague(items: DataFrame, group: list[str], order: list[str], amount: str, seats: str, most: str, out: str) -> DataFrame:
    """``items`` with ``out``: how many of the group's ``seats`` an item gets by highest quotients amount / (2 k - 1), at most ``most``.

    An item's seats differ from its exact share by no more than half the number of items
    times that share, and one: only quotients in that reach are made and compared.
    """
    own = Window.partitionBy(*group)
    total, n = F.sum(amount).over(own), F.count("*").over(own)
    part = F.when(total > 0, F.col(amount) / total).otherwise(0.0)
    reach = part * n / 2 + 1
    w = items.withColumn("__low", F.least(F.greatest(F.floor(part * F.col(seats) - reach), F.lit(0)), F.col(most)).cast("long"))
    w = w.withColumn("__high", F.least(F.ceil(part * F.col(seats) + reach), F.col(most)).cast("long")).withColumn("__open", F.col(seats) - F.sum("__low").over(own))
    ks = F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low") + 1, F.col("__high"))).otherwise(F.array().cast("array<bigint>"))
    quotients = w.select(*group, *order, amount, "__open", F.explode(ks).alias("__k"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy((F.col(amount) / (2 * F.col("__k") - 1)).desc(), *order))
    won = quotients.withColumn("__place", place).where("__place <= __open").groupBy(*group, *order).agg(F.count("*").alias("__won"))
    return w.join(won, [*group, *order], "left").select(*items.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).alias(out))


def _source_key(source_col: str) -> Column:
    """Never null, so that it joins and groups like any other key."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_keys: bool = False, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, block: int = 8, shard_words: int = 4_000_000, shard_rows: int = 200_000, seed: int = 17) -> DataFrame:
    """(id_col, size, source_size, target, taken, runs) of each document.

    ``runs`` are the stretches of its words that are taken: first word, and how many.  With
    ``keep_keys``, __sk and __text too: source key and a hash of the text, which tell rows of one id apart.
    """
    keys = ["__sk", "__text"] if keep_keys else []
    # Texts are read once; everything after works on this narrow table.
    sized = Table(docs.select(F.col(id_col), F.col(source_col).alias("__source"), _source_key(source_col).alias("__sk"), word_count(F.col(text_col)).alias("size"), *([F.xxhash64(text_col).alias("__text")] if keep_keys else [])), "mix-sizes").df
    sizes = sized.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    t = targets(sizes, weights, share, most)
    t = t.withColumn("__all", F.lit(0)).withColumn("__blocks", F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5)).withColumn("__most", F.floor(most * F.col("source_size") / block))
    t = sainte_lague(t, ["__all"], ["position"], "target", "__blocks", "__most", "source_blocks")
    t = t.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__sk"), "source_size", "target", "source_blocks", F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("rows") / shard_rows), F.lit(1)).alias("__shards"))
    shards_of = t.select("__sk", "__shards")
    placed = sized.join(shards_of, "__sk").withColumn("__shard", F.pmod(_hash(F.lit(f"shard{seed}"), F.col(id_col).cast("string")), F.col("__shards")))
    shards = placed.groupBy("__sk", "__shard").agg(F.sum("size").alias("shard_size")).join(t, "__sk").withColumn("__most", F.floor(most * F.col("shard_size") / block))
    shards = sainte_lague(shards, ["__sk"], ["__shard"], "shard_size", "source_blocks", "__most", "quota")
    shards = shards.withColumn("__from", F.when(F.col("shard_size") > 0, F.pmod(_hash(F.lit(f"start{seed}"), F.col("__sk"), F.col("__shard").cast("string")), F.col("shard_size"))).otherwise(F.lit(0)))
    # A table of its own: its rows meet the documents by source and shard, not by the source alone that their quotas were made by.
    shards = Table(shards.select("__sk", "__shard", "source_size", "target", "shard_size", "quota", "__from"), "mix-shards").df
    line = Window.partitionBy("__sk", "__shard").orderBy(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.col(id_col).cast("string"))), id_col, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.select(id_col, "__sk", "__shard", "size", *keys[1:]).withColumn("__end", F.sum("size").over(line))
    met = lined.join(shards, ["__sk", "__shard"])
    low, high, start, stop = F.col("__end") - F.col("size"), F.col("__end"), F.col("__from"), F.col("__from") + F.col("quota") * block
    # From a place in the first round, at most ``most`` rounds are read: no later round than this is reached.
    rounds = [(F.greatest(low + r * F.col("shard_size"), start), F.least(high + r * F.col("shard_size"), stop), low + r * F.col("shard_size")) for r in range(most + 1)]
    runs = F.filter(F.array(*[F.struct((a - zero).cast("long").alias("first"), (b - a).cast("long").alias("words")) for a, b, zero in rounds]), lambda s: s["words"] > 0)
    taken = F.aggregate(runs, F.lit(0).cast("long"), lambda acc, s: acc + s["words"])
    return met.select(id_col, "size", "source_size", "target", taken.alias("taken"), runs.alias("runs"), *keys)


def draw(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: a row of ``docs`` for each run of words taken; a run that isn't the whole text is its words joined by blanks.

    A row meets its runs by id, text and source; rows equal in all three are numbered, so
    that each meets its own.
    """
    alike = Window.partitionBy("__mix_id", "__mix_text", "__mix_sk").orderBy("__mix_id")
    runs = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, keep_keys=True, **how)
    runs = runs.select(F.col(id_col).alias("__mix_id"), F.col("__text").alias("__mix_text"), F.col("__sk").alias("__mix_sk"), F.col("size").alias("__mix_size"), F.col("runs").alias("__mix_runs")).withColumn("__mix_k", F.row_number().over(alike))
    runs = runs.where(F.size("__mix_runs") > 0).select("__mix_id", "__mix_text", "__mix_sk", "__mix_k", "__mix_size", F.explode("__mix_runs").alias("__mix_run"))
    keyed = docs.select("*", F.col(id_col).alias("__mix_id"), F.xxhash64(text_col).alias("__mix_text"), _source_key(source_col).alias("__mix_sk")).withColumn("__mix_k", F.row_number().over(alike))
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    some = F.array_join(F.slice(words, (F.col("__mix_run.first") + 1).cast("int"), F.col("__mix_run.words").cast("int")), " ")
    text = F.when(F.col("__mix_run.words") == F.col("__mix_size"), F.col(text_col)).otherwise(some)
    d, r = keyed.alias("d"), runs.alias("r")
    same = [F.col(f"d.{c}") == F.col(f"r.{c}") for c in ("__mix_text", "__mix_sk", "__mix_k")]
    met = d.join(r, F.col("d.__mix_id").eqNullSafe(F.col("r.__mix_id")) & same[0] & same[1] & same[2])
    return met.select(*[text.alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS sk, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, any_value(sk) AS sk, sum(size)::BIGINT AS source_size, count(*)::BIGINT AS n FROM sized GROUP BY source
), w1 AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS pos FROM sizes
), w2 AS (
  SELECT *, [3, 1, 2][(pos % 3 + 1)::INT] AS weight FROM w1
), w3 AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS tot, (sum(weight) OVER ())::BIGINT AS totw,
    coalesce(sum(source_size) OVER f, 0)::BIGINT AS bef, coalesce(sum(weight) OVER f, 0)::BIGINT AS befw
  FROM w2 WINDOW f AS (ORDER BY source_size::DOUBLE / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), w4 AS (
  SELECT *, (2 * source_size)::DOUBLE <= (3 * tot - 4 * bef)::DOUBLE / (2 * (totw - befw)) * weight AS is_full FROM w3
), w5 AS (
  SELECT *, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE
    (3 * tot - 4 * coalesce(sum(source_size) FILTER (is_full) OVER (), 0)::BIGINT)::DOUBLE * weight / (2 * (sum(weight) FILTER (NOT is_full) OVER ())::BIGINT) END AS target FROM w4
), s1 AS (
  SELECT *, floor(sum(target) OVER () / 8 + 0.5)::BIGINT AS seats, floor(2 * source_size / 8.0)::BIGINT AS most,
    CASE WHEN sum(target) OVER () > 0 THEN target / sum(target) OVER () ELSE 0 END AS part, count(*) OVER () AS m FROM w5
), s2 AS (
  SELECT *, least(greatest(floor(part * seats - (part * m / 2 + 1)), 0), most)::BIGINT AS lo, least(ceil(part * seats + part * m / 2 + 1), most)::BIGINT AS hi FROM s1
), s3 AS (
  SELECT *, seats - (sum(lo) OVER ())::BIGINT AS open FROM s2
), s4 AS (
  SELECT pos, target, open, unnest(generate_series(lo + 1, hi)) AS k FROM s3
), s5 AS (
  SELECT pos, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, pos) AS place FROM s4) WHERE place <= open GROUP BY pos
), src AS (
  SELECT sk, source_size, target, lo + coalesce(won, 0) AS blocks, greatest(ceil(source_size / 4000000.0), ceil(n / 200000.0), 1)::BIGINT AS shards FROM s3 LEFT JOIN s5 USING (pos)
), placed AS (
  SELECT doc_id, sk, size, ('0x' || substr(md5('shard17:' || doc_id), 1, 15))::BIGINT % shards AS shard FROM sized JOIN src USING (sk)
), h0 AS (
  SELECT sk, shard, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL
), h1 AS (
  SELECT *, floor(2 * shard_size / 8.0)::BIGINT AS most, CASE WHEN sum(shard_size) OVER g > 0 THEN shard_size / (sum(shard_size) OVER g) ELSE 0 END AS part, count(*) OVER g AS m
  FROM h0 JOIN src USING (sk) WINDOW g AS (PARTITION BY sk)
), h2 AS (
  SELECT *, least(greatest(floor(part * blocks - (part * m / 2 + 1)), 0), most)::BIGINT AS lo, least(ceil(part * blocks + part * m / 2 + 1), most)::BIGINT AS hi FROM h1
), h3 AS (
  SELECT *, blocks - (sum(lo) OVER (PARTITION BY sk))::BIGINT AS open FROM h2
), h4 AS (
  SELECT sk, shard, shard_size, open, unnest(generate_series(lo + 1, hi)) AS k FROM h3
), h5 AS (
  SELECT sk, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY shard_size / (2 * k - 1) DESC, shard) AS place FROM h4) WHERE place <= open GROUP BY ALL
), h AS (
  SELECT sk, shard, shard_size, source_size, target, (lo + coalesce(won, 0))::BIGINT AS quota,
    CASE WHEN shard_size > 0 THEN ('0x' || substr(md5('start17:' || sk || ':' || shard), 1, 15))::BIGINT % shard_size ELSE 0 END AS start
  FROM h3 LEFT JOIN h5 USING (sk, shard)
), lined AS (
  SELECT *, (sum(size) OVER (PARTITION BY sk, shard ORDER BY md5('order17:' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS fin FROM placed
)
SELECT doc_id, size, source_size, target,
  (SELECT sum(greatest(0, least(fin + r * shard_size, start + quota * 8) - greatest(fin - size + r * shard_size, start))) FROM (VALUES (0), (1), (2)) AS v(r))::BIGINT AS taken
FROM lined JOIN h USING (sk, shard)
"""
