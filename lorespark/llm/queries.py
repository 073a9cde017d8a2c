"""The operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filters, hardneg, jaccard, langid, licences, media, mixing, neardup, packing, pii, tokentree, toxicity
from .common import crc_bucket, documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_bucket("doc_id", 3) == 1
    model = langid.fit(docs, where=~held)
    named = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return named.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc_bucket("doc_id", 5) == 0
    model = toxicity.fit(docs, labels, where=~held)
    scored = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(documents(spark, sf_dir))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = neardup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return linked.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = media.read(media.store(documents(spark, sf_dir)))
    tail = F.crc32(F.expr("substring(samples, -16, 16)"))
    return seen.select("doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), media.feature(F.col("frames")).alias("feature"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of each document: some words replaced at a quarter, some put in at the middle, the last third of what is left removed."""
    docs = documents(spark, sf_dir)
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")

    def edit(at, remove, insert):
        return F.struct(F.floor(at).alias("at"), F.floor(remove).alias("remove"), F.lit(insert).alias("insert"))

    edits = F.array(edit(n * 0.25, F.least(n * 0.1, F.lit(24.0)), "a corrected passage"), edit(n * 0.5, F.lit(0.0), " and what an editor adds, it's said,"), edit(n * 0.67, n, ""))
    return tokentree.count_edited(docs.select("doc_id", "text", edits.alias("edits")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard.cluster(documents(spark, sf_dir), jaccard.Rule(words=4, num=85))
    return groups.select("doc_id", "n_shingles", "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.find(documents(spark, sf_dir))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return spans.select("doc_id", *counts, F.sha2(pii.ordered(F.col("base")), 256).alias("base_sha256"), pii.ordered(F.concat("base", "found")).alias("spans"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(documents(spark, sf_dir))
    return found.withColumn("notices", F.array_join("notices", ","))


def op11_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.expr("if(vec_id % 7 = 0, (cast(label as bigint) + 1) % 10, label)"))
    return hardneg.mine(vectors, F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_embedding_neardup, op4_source_mix, op5_gif_media, op6_token_counts, op7_ngram_jaccard, op8_pii, op9_toxicity, op10_licence_scan, op11_suffix_decontamination, op12_filter_audit, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mix": mixing.ORACLE, "op10_licence_scan": licences.oracle_sql(), "op11_suffix_decontamination": decontaminate.ORACLE, "op12_filter_audit": filters.ORACLE, "op13_hard_negatives": hardneg.ORACLE}
