"""Connected components of links between ids, without the links ever leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links``; the component is its smallest id.

    Alternates hooking each id's neighbours to the smallest id around it with pointer
    jumping, so that the rounds grow with the logarithm of the longest chain.  Every round
    ends in a table in the shared folder; losing an executor costs at most one round.
    Nulls and self-links are ignored.  Smallest neighbours are found by an aggregation
    that combines before it shuffles, so a hub's links never meet in one task.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = Table(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    names = Table(both.df.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "cc-names")
    for _ in range(most_rounds):
        # The smallest name among an id's neighbours, offered to the id and to the id that names it.
        near = both.df.join(names.df.select(F.col("u").alias("v"), F.col("c").alias("vc")), "v").groupBy("u").agg(F.min("vc").alias("vc"))
        seen = names.df.join(near, "u").select("u", "c", F.least("c", "vc").alias("m"))
        offers = seen.select(F.col("c").alias("u"), "m").unionByName(seen.select("u", "m")).groupBy("u").agg(F.min("m").alias("m"))
        hooked = names.df.join(offers, "u").select("u", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        # One jump: the name of one's name.
        jumped = hooked.join(hooked.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c").select("u", F.least("c", "cc").alias("c"), "old")
        step = Table(jumped, "cc-names")
        changed = step.df.where("c <> old").limit(1).count()
        names.drop()
        names = step
        if not changed:
            both.drop()
            return names.df.select(F.col("u").alias("id"), F.col("c").alias("component"))
    raise RuntimeError("components did not settle")
