"""Tables by name: DataFrames, pandas frames, files, catalog tables and JDBC."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

JDBC = {"postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "presto": "io.prestosql.jdbc.PrestoDriver", "sqlite": "org.sqlite.JDBC"}
FILES = {"parquet", "csv", "orc", "json"}


class Sources:
    """Resolves one- to three-part names to DataFrames; the last part alone is enough where it is unique."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | pd.DataFrame] | None = None):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        for name, t in (tables or {}).items():
            self.add(name, t)

    def add(self, name: str, table: DataFrame | pd.DataFrame) -> None:
        self.tables[name.lower()] = self.spark.createDataFrame(table) if isinstance(table, pd.DataFrame) else table

    def file(self, name: str, path: str, kind: str = "parquet", **options) -> None:
        if kind not in FILES:
            raise ValueError(f"unknown kind of file {kind}")
        self.add(name, self.spark.read.format(kind).options(**options).load(path))

    def jdbc(self, name: str, url: str, table: str, engine: str, **options) -> None:
        """Partitioned reads take partitionColumn, lowerBound, upperBound and numPartitions. The driver's jar must be on the class path."""
        if engine not in JDBC:
            raise ValueError(f"unknown engine {engine}")
        self.add(name, self.spark.read.format("jdbc").options(url=url, dbtable=table, driver=JDBC[engine], **options).load())

    def frame(self, parts: tuple[str, ...]) -> DataFrame:
        for k in range(len(parts)):
            if (found := self.tables.get(".".join(parts[k:]).lower())) is not None:
                return found
        ends = [n for n in self.tables if n.split(".")[-1] == parts[-1].lower()]
        if len(ends) == 1:
            return self.tables[ends[0]]
        return self.spark.table(".".join(f"`{p}`" for p in parts))
