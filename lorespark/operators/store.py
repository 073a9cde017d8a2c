"""A store of document versions that grows batch by batch, and a registry of library versions.

A batch adds a version of a document only where its text differs from the version before it, which
may be one of an earlier batch.  Texts are kept once, by their digest.  Each batch is a
generation: its files are written first and named in the manifest last, so that a batch that was cut off
leaves no trace and can be applied again.  One document's rows of a batch are put in order in one task.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import folder, kept, table

VERSIONS = "key string, version long, at timestamp, tie long, digest string"
MANIFEST = "generation long, n_versions long, n_contents long, applied_at timestamp"


def next_versions(stored: DataFrame, batch: DataFrame, keep: int = 10) -> DataFrame:
    """``VERSIONS`` after a batch (key, at, tie, digest): of each document the newest ``keep``, numbered from its first."""
    last = stored.groupBy("key").agg(F.max_by(F.struct("version", "digest"), "version").alias("last"))
    line = Window.partitionBy("key").orderBy("at", "tie")
    before = F.coalesce(F.lag("digest").over(line), F.col("last.digest"))
    changed = batch.join(last, "key", "left").withColumn("before", before).where(~F.col("digest").eqNullSafe(F.col("before")))
    added = changed.select("key", (F.coalesce("last.version", F.lit(0)) + F.row_number().over(line)).cast("long").alias("version"), "at", "tie", "digest")
    every = stored.unionByName(added)
    age = F.row_number().over(Window.partitionBy("key").orderBy(F.col("version").desc()))
    return every.withColumn("age", age).where(F.col("age") <= keep).drop("age")


class VersionStore:
    """Versions and texts under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 10):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def manifest(self) -> DataFrame:
        """A row for each batch that was applied."""
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")

    def generation(self) -> int:
        return self.manifest().agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]

    def versions(self) -> DataFrame:
        n = self.generation()
        return self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions/{n}") if n else self.spark.createDataFrame([], VERSIONS)

    def contents(self) -> DataFrame:
        """(digest, text) of all versions there ever were."""
        n = self.generation()
        return self.spark.read.schema("digest string, text string").parquet(*(f"{self.path}/contents/{k}" for k in range(1, n + 1))) if n else self.spark.createDataFrame([], "digest string, text string")

    def apply(self, batch: DataFrame) -> int:
        """Add rows (key, at, tie, text), and give the number of the generation.

        Rows without a key or a time are left out, a null text counts as empty; rows of one key and time go by ``tie``.
        """
        n = self.generation() + 1
        text = F.coalesce("text", F.lit(""))
        rows = batch.where("key is not null and at is not null").select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("tie").cast("long").alias("tie"), F.sha2(text, 256).alias("digest"), text.alias("text"))
        versions = f"{self.path}/versions/{n}"
        next_versions(self.versions(), rows.drop("text"), self.keep).write.mode("overwrite").parquet(versions)
        fresh = rows.groupBy("digest").agg(F.first("text").alias("text")).join(self.contents().select("digest"), "digest", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.path}/contents/{n}")
        counts = [self.spark.read.parquet(f"{self.path}/{name}/{n}").count() for name in ("versions", "contents")]
        self.spark.createDataFrame([(n, *counts, datetime.now())], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return n

    def texts(self) -> DataFrame:
        """(key, version, at, text) of the versions that are kept."""
        return self.versions().join(self.contents(), "digest").select("key", "version", "at", "text")


def as_of(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, asked_at, version, digest) for rows (key, asked_at): the newest version not after that time; null where none is kept from so early."""
    v = versions.select(F.col("key").alias("v_key"), "version", "at", "digest")
    met = asked.select("key", "asked_at").distinct().join(v, (F.col("key").eqNullSafe(F.col("v_key"))) & (F.col("at") <= F.col("asked_at")), "left")
    best = met.groupBy("key", "asked_at").agg(F.max_by(F.struct("version", "digest"), "version").alias("v"))
    return best.select("key", "asked_at", "v.version", "v.digest")


def registered(rows: DataFrame, order: Column) -> DataFrame:
    """(library, version, url, is_latest) of registrations (library, version, url, is_latest): the last one of a version holds, and one version of a library at most is the latest, the one that was last said to be."""
    line = Window.partitionBy("library", "version").orderBy(order.desc())
    last = rows.withColumn("__order", order).withColumn("k", F.row_number().over(line)).where("k = 1")
    # Saying that a version is the latest takes that from all others of the library, and a later row of the same version may take it back.
    said = rows.where("is_latest").groupBy("library").agg(F.max(order).alias("__latest"))
    met = last.join(said, "library", "left")
    return met.select("library", "version", "url", (F.col("is_latest") & (F.col("__order") == F.col("__latest"))).alias("is_latest")).withColumn("is_latest", F.coalesce("is_latest", F.lit(False)))


def doc_urls(asked: DataFrame, registry: DataFrame, bases: DataFrame) -> DataFrame:
    """``asked`` (id, library, version) with the version's URL, else the library's base URL, else null, and whether the version is registered."""
    r = registry.select("library", "version", F.col("url").alias("own"), "is_latest")
    met = asked.join(r, ["library", "version"], "left").join(bases.select("library", "base_url"), "library", "left")
    return met.select("id", F.coalesce("own", "base_url").alias("url"), F.col("own").isNotNull().alias("is_registered"), F.coalesce("is_latest", F.lit(False)).alias("is_latest"))


#: Where the orders are cut into two batches, and the time that is looked up.
CUT, ASKED = "1998-04-01 00:00:00", "2000-01-01 00:00:00"


def order_store(orders: DataFrame) -> VersionStore:
    """Orders as versions of their customers' status, applied in two batches."""
    spark = orders.sparkSession
    rows = orders.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("tie"), F.col("o_orderstatus").alias("text"))
    store = VersionStore(spark, f"{folder(spark)}/versions-{uuid.uuid4().hex}")
    store.apply(rows.where(F.col("at") < F.lit(CUT).cast("timestamp")))
    store.apply(rows.where(F.col("at") >= F.lit(CUT).cast("timestamp")))
    return store


def stored_orders(orders: DataFrame) -> DataFrame:
    store = order_store(orders)
    return store.versions().join(store.contents(), "digest").select(F.col("key").cast("long").alias("o_custkey"), F.col("tie").alias("o_orderkey"), "version", F.col("text").alias("status"))


def orders_as_of(orders: DataFrame) -> DataFrame:
    asked = orders.select(F.col("o_custkey").cast("string").alias("key"), F.lit(ASKED).cast("timestamp").alias("asked_at"))
    return as_of(order_store(orders).versions(), asked).select(F.col("key").cast("long").alias("o_custkey"), "version")


def part_urls(parts: DataFrame) -> DataFrame:
    """A registry of parts: brands as libraries, sizes as versions; each part asks for a version of its brand that may not be there."""
    url = F.concat(F.lit("https://"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit(".example/"))
    rows = parts.select(F.col("p_brand").alias("library"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version"), F.concat(url, F.col("p_partkey").cast("string")).alias("url"), (F.col("p_partkey") % 7 == 0).alias("is_latest"), F.col("p_partkey").alias("seq"))
    registry = kept(registered(rows, F.col("seq")), "registry")
    bases = parts.select(F.col("p_brand").alias("library"), url.alias("base_url")).distinct()
    asked = parts.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("library"), F.concat(F.lit("1."), (F.col("p_partkey") % 60).cast("string")).alias("version"))
    return doc_urls(asked, registry, bases)


QUERIES = {
    "ve_store": lambda s, d: stored_orders(table(s, d, "orders")),
    "ve_as_of": lambda s, d: orders_as_of(table(s, d, "orders")),
    "ve_doc_urls": lambda s, d: part_urls(table(s, d, "part")),
}
_STORED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last FROM orders) WHERE last IS NULL OR last <> o_orderstatus) WHERE age <= 10"
_URL = "'https://' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '.example/'"
ORACLE = {
    "ve_store": f"SELECT o_custkey, o_orderkey, version, o_orderstatus AS status FROM ({_STORED})",
    "ve_as_of": f"SELECT o_custkey, (SELECT max(version) FROM ({_STORED}) s WHERE s.o_custkey = o.o_custkey AND o_orderdate <= TIMESTAMP '{ASKED}') AS version FROM (SELECT DISTINCT o_custkey FROM orders) o",
    "ve_doc_urls": f"WITH r AS (SELECT p_brand, p_size, max(p_partkey) AS k FROM part GROUP BY ALL), l AS (SELECT p_brand, max(p_partkey) AS k FROM part WHERE p_partkey % 7 = 0 GROUP BY p_brand) SELECT p_partkey AS id, {_URL} || coalesce(r.k::VARCHAR, '') AS url, r.k IS NOT NULL AS is_registered, coalesce(r.k = l.k, false) AS is_latest FROM part p LEFT JOIN r ON r.p_brand = p.p_brand AND r.p_size = p.p_partkey % 60 LEFT JOIN l ON l.p_brand = p.p_brand".replace("p_brand, '[^", "p.p_brand, '[^"),
}
