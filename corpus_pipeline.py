"""A training-data pipeline of five stages: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared folder and reads
them again as the next one's documents. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm import decontaminate, line_dedup, packing, quality, simhash
from quietframe.llm.common import Scratch, row_uid, unique_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(spark: SparkSession, docs: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """The rows of docs that agree (left_semi) or don't (left_anti) with a row of some (doc_id, uid) in doc_id and text."""
    name = unique_rows(spark, ["some_doc", "some_uid", "own_uid"], docs.columns)
    some = some.select(F.col("doc_id").alias(name["some_doc"]), F.col("uid").alias(name["some_uid"]))
    own = docs.withColumn(name["own_uid"], row_uid())
    same = (F.col(name["own_uid"]) == F.col(name["some_uid"])) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(name["some_doc"]))
    return own.join(some, same, how).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the others go.

    Null and empty texts weigh nothing (log weight 0). Rows that agree in doc_id and text share their verdict and stay if one of them was
    selected. An empty table stays empty; columns besides doc_id and text pass through, whatever their names.
    """
    judged = quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), spark)
    return rows_of(spark, docs, judged.filter("selected").select("doc_id", "uid").distinct(), "left_semi")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line. A document that lost lines and of which nothing is left goes; n_chars, where
    it is a column, follows the text of those that lost some.

    Null and empty texts have no lines and stay. Rows that agree in doc_id and text lose the same lines. Ties don't occur: every line has its
    place. An empty table stays empty; other columns pass through, whatever their names.
    """
    count = unique_rows(spark, ["lines_removed"], docs.columns)["lines_removed"]
    out = line_dedup.dedup_lines(docs, spark, count, short=True)
    lost = F.col(count) > 0
    out = out.filter(~lost | (F.length(F.regexp_replace("text", r"\s", "")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length("text")).otherwise(F.col("n_chars")).cast("bigint"))
    return out.drop(count)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity of five-word shingles 0.8 or more): that with the smallest doc_id.

    Documents without words, null ones too, are one group. A null doc_id loses to any other. Of rows that agree in doc_id and text one stays. An
    empty table stays empty; other columns pass through, whatever their names.
    """
    kept = simhash.near_documents(docs, spark)
    out = rows_of(spark, docs, kept.filter("copies = 1"), "left_semi")
    many = kept.filter("copies > 1")
    if many.isEmpty():
        return out
    name = unique_rows(spark, ["own_id", "own_uid"], docs.columns)
    again = rows_of(spark, docs, many, "left_semi").withColumn(name["own_id"], F.col("doc_id").cast("bigint")).withColumn(name["own_uid"], row_uid())
    return out.unionByName(again.dropDuplicates([name["own_id"], name["own_uid"]]).select(docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none and stay. Each row is judged by its own text, whatever other rows have its doc_id. An empty table, or an
    empty benchmark, changes nothing; other columns pass through, whatever their names.
    """
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark)
    leaks = Scratch(spark, "leaks").table(leaks.select("doc_id", "uid").distinct(), "leaks")
    return rows_of(spark, docs, leaks, "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens; null texts are empty, and every row has its own pieces."""
    return packing.pack(docs, spark, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the n-gram models, the tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
