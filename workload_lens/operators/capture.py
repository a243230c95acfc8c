"""From a snapshot of statement statistics to the statements worth clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_meta


def order_key(total: str = "total_exec_time_ms", tie: str = "queryid") -> Column:
    """Sorts ascending as capture orders its rows: longest total first, unknown ones before all.

    The key is a value of the row, so the order of members needs neither a sort
    nor a running number.
    """
    return F.struct(F.col(total).isNotNull().alias("known"), (-F.coalesce(F.col(total), F.lit(0.0))).alias("time"), F.col(tie).alias("tie"))


def capture(statements: DataFrame, databases: DataFrame | None = None, *, database: str = "", min_calls: int = 0, limit: int = 0) -> DataFrame:
    """Statements called more than ``min_calls`` times, meta commands left out.

    ``database`` keeps the statements of one database (``databases``: oid,
    datname). ``limit`` keeps the ones with the longest total time, before any
    clustering. A null query is dropped, as its filter is null.
    """
    rows = statements
    if database:
        one = databases.where(F.col("datname") == database).select("oid")
        rows = rows.join(one, rows["dbid"] == one["oid"], "inner").drop("oid")
    rows = rows.where((F.col("calls") > min_calls) & ~is_meta(F.col("query")))
    rows = rows.select(
        F.col("query").alias("raw"),
        F.col("queryid").cast("long").alias("queryid"),
        F.col("calls").cast("long").alias("calls"),
        F.col("total_exec_time").alias("total_exec_time_ms"),
        F.col("mean_exec_time").alias("mean_exec_time_ms"),
        F.col("stddev_exec_time").alias("stddev_exec_time_ms"),
        F.col("rows").cast("long").alias("rows"),
    )
    rows = rows.withColumn("ord", order_key())
    return rows.orderBy("ord").limit(limit) if limit > 0 else rows
