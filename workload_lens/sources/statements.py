"""Snapshots of statement statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ("queryid", "calls", "query", "total_exec_time", "mean_exec_time", "stddev_exec_time", "rows")


def read_statements(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """A snapshot table: COLUMNS, and dbid where the snapshot has it. The scan reads no other columns."""
    table = spark.read.format(format).options(**options).load(path)
    return table.select(*COLUMNS, *(c for c in ("dbid",) if c in table.columns))


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A live statistics view or catalog table by JDBC; needs a driver on Spark's class path.

    Spark pushes the filters, sort and limit of ``capture`` into the database.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=table, pushDownLimit="true", **options).load()
