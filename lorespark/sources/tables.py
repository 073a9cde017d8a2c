"""Readers and writers of the engine's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The session's shared folder; one under /tmp where none is set, which only a local session may use."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not home and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (home or "/tmp/lorespark").rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the session's shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer splits than there are cores; a large table stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over four tasks to a core, for narrow rows that become much more than they are: by the size of its files a table of a million parts is one split."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html, status): whole files as fetched pages."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"), F.lit(200).alias("status"))


def write_json(df: DataFrame, path: str, compression: str | None = "gzip") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append(df: DataFrame, path: str, *keys: str) -> None:
    """Logs and version bodies: appended Parquet, in folders by key where keys are given."""
    writer = df.write.mode("append")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


#: Extensions and the types they stand for.
MIME = {
    "html": "text/html",
    "htm": "text/html",
    "xhtml": "application/xhtml+xml",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "rst": "text/x-rst",
    "rest": "text/x-rst",
    "adoc": "text/asciidoc",
    "asciidoc": "text/asciidoc",
    "txt": "text/plain",
    "json": "application/json",
    "xml": "application/xml",
    "yaml": "application/yaml",
    "yml": "application/yaml",
    "css": "text/css",
    "js": "application/javascript",
    "py": "text/x-python",
    "java": "text/x-java",
    "c": "text/x-c",
    "cpp": "text/x-c++",
    "cs": "text/x-csharp",
    "go": "text/x-go",
    "rb": "text/x-ruby",
    "php": "text/x-php",
    "pl": "text/x-perl",
    "sh": "text/x-shellscript",
    "bat": "text/x-bat",
    "ps1": "text/x-powershell",
}
