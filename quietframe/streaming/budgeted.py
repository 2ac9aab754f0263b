"""Private aggregates of a stream: every micro-batch is one release with its own share of a capped budget."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from quietframe.plans.private import PrivateSession


ACCOUNT = "batch long, epsilon double, delta double"


def release_each_batch(stream: DataFrame, session: PrivateSession, table: str, query: str, sink: str, **options):
    """Starts a query that appends each batch's release, with its number, to Parquet at `sink`. A batch that would go over the session's cap
    stops the query before anything of it is released. A batch that is run again is charged again, since its noise is new. What is spent is
    written beside the stream's checkpoint before the release, and a query that starts again goes on from there."""
    spark = stream.sparkSession
    account = f"{options.get('checkpointLocation', sink).rstrip('/')}_account"
    path = spark._jvm.org.apache.hadoop.fs.Path(account)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spent = spark.read.schema(ACCOUNT).parquet(account).collect()  # a few rows for each batch
        session.odometer.steps += (Counter((r["epsilon"], r["delta"]) for r in spent) - Counter(session.odometer.steps)).elements()

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        steps = session.plan(query).steps(session.privacy)
        session.odometer.check(steps)
        spark.createDataFrame([(number, float(e), float(d)) for e, d in steps], ACCOUNT).coalesce(1).write.mode("append").parquet(account)
        session.sources.add(table, batch)
        session.execute(query).selectExpr(f"{number}L AS batch", "*").write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(one).options(**options).start()
