"""Exact dedup (operator 9): a persistent digest index, bucketed and sorted by hash.

The index is a table of (digest, keep_id, keep_row, batch) with one row for each distinct text ever seen, written with ``bucketBy`` and
``sortBy`` on the digest. New data is hashed inside the JVM, reduced to one row for each digest (with a partial aggregate before the
shuffle, so a text that fills a third of the rows sends one row from each task), and deduplicated by a sort-merge anti-join with the
index: the buckets are read as they lie, so the index isn't shuffled. What is new is appended, and the verdict on every row is then
read from the index: the digests of the call are joined with its buckets, and the row that the index names is the one that stays.

An index with a `path` outlives the session: files lie there, with their number of buckets beside them, and a later session that names
the path goes on with it. compact() leaves one sorted file for each bucket after many appends.

Defined results. Null text counts as empty. Among equal texts the row with the largest doc_id stays; of rows that share that
doc_id as well one stays; a null doc_id loses to every other. Against an index that already holds a text, every new row with it
is a duplicate of the row that the index names. An empty table gives no rows. Other columns of the input aren't looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietframe.llm.common import Scratch, shuffle_partitions, text_or_empty

SCHEMA = "digest STRING, keep_id BIGINT, keep_row BIGINT, batch STRING"


class DigestIndex:
    """A persistent index of text digests, kept as a bucketed table of the session's catalog; with `path`, in files that outlive it."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.table, self.path = spark, table, path
        self.buckets = (self._kept_buckets() if path else None) or buckets or max(8, shuffle_partitions(spark))
        self._create(table, path)

    def _note(self):
        """Where the number of buckets is kept, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}.buckets")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _kept_buckets(self) -> int | None:
        path, fs = self._note()
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return stream.readInt()
        finally:
            stream.close()

    def _create(self, table: str, path: str | None) -> None:
        where = f"LOCATION '{path}'" if path else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({SCHEMA}) USING parquet {where} CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")
        if path:
            note, fs = self._note()
            stream = fs.create(note, True)
            stream.writeInt(self.buckets)
            stream.close()

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame, table: str | None = None) -> None:
        """rows: digest, keep_id, keep_row, batch of texts that the index doesn't hold."""
        out = (rows.select("digest", "keep_id", "keep_row", "batch").repartition(self.buckets, "digest")
               .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest"))
        if self.path:
            out = out.option("path", self.path)
        out.saveAsTable(table or self.table)

    def compact(self) -> None:
        """One sorted file for each bucket. The rows are first written beside the index, so a run that fails leaves one whole copy."""
        scratch = Scratch(self.spark, "compact")
        rows = scratch.table(self.read(), "rows")
        self.spark.sql(f"TRUNCATE TABLE {self.table}") if not self.path else self._empty()
        self.append(rows)
        scratch.drop("rows")

    def _empty(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._create(self.table, self.path)

    def drop(self) -> None:
        """Forgets the table; files at a path stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Those rows of groups (one for each digest) whose digest the index doesn't hold: a sort-merge anti-join by bucket."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def verdicts(self, groups: DataFrame) -> DataFrame:
        """What the index says of the digests of groups: keep_id, keep_row and batch of the row that stays."""
        return groups.join(self.read().hint("merge"), "digest")

    def dedup(self, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. What is new joins the index.

        group_size counts the rows of this call. A row of an earlier call stays the one that is kept.
        """
        batch = uuid.uuid4().hex
        thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(text_or_empty(), 256).alias("digest")).withColumn("row", F.monotonically_increasing_id())
        thin = scratch.table(thin, "digests")
        groups = thin.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
        groups = scratch.table(groups, "groups")
        new = self.unseen(groups.select("digest", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), F.lit(batch).alias("batch")))
        self.append(scratch.table(new, "new"))  # written first: the index is read and appended to in separate steps
        judged = scratch.table(self.verdicts(groups.select("digest", "group_size")), "judged")
        # A plain join of two shuffled sides: where one text fills a third of the rows, adaptive execution splits its partition.
        out = thin.join(judged.hint("merge"), "digest")
        mine = (F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))
        return out.select("doc_id", "keep_id", "group_size", mine.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, spark: SparkSession, index: DigestIndex) -> DataFrame:
    """The verdicts of docs against the index, in a scratch folder of their own."""
    return index.dedup(docs, Scratch(spark, "exact"))
