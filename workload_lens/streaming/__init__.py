"""Cluster totals over snapshots that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import analyzed


def running_totals(statements: DataFrame) -> DataFrame:
    """Totals of each readable shape over a stream of captured statements.

    State is one row a shape. Unreadable statements have no shape and are left out.
    """
    rows = analyzed(statements).where("parse_ok")
    return rows.groupBy("fingerprint").agg(
        F.min("canonical").alias("canonical"),
        F.sum("calls").alias("total_calls"),
        F.sum("total_exec_time_ms").alias("total_exec_time_ms"),
        F.sum("rows").alias("rows"),
    )
