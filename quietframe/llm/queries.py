"""The queries of the operators, over whole tables, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm import decontaminate, exact_dedup, line_dedup, packing, pii, quality, simhash, token_store, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), spark, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), spark)
    return found.select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), F.round("key", 6).alias("key"), "selected")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.trained())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spark)
    return found.drop("uid").withColumn("similarity", F.round("similarity", 6))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_filter.labelled_urls(), "url string, label double")
    judged = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(spark, labelled))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"), spark, least=0)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), spark, public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50257, end_id=2)


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), spark)
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    out = exact_dedup.keep_one(table(spark, sf_dir, "documents"), spark, index)
    index.drop()  # the query starts from an empty index each time; the verdicts that it read from the index are written
    return out


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), spark, short=True)
    return found.select("doc_id", "lines_removed", F.length("text").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_importance_resampling, op3_personal_data, op4_decontaminate, op5_url_filter, op6_warc_archive, op7_token_store, op8_simhash_golay, op9_exact_dedup, op10_line_dedup)}

ORACLE_SQL = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
