"""Schemas of statements, clusters and documents; their field order is the wire format's."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1"
STATEMENT = T.StructType(
    [
        T.StructField("raw", T.StringType()),
        T.StructField("queryid", T.LongType()),
        T.StructField("calls", T.LongType()),
        T.StructField("total_exec_time_ms", T.DoubleType()),
        T.StructField("mean_exec_time_ms", T.DoubleType()),
        T.StructField("stddev_exec_time_ms", T.DoubleType()),
        T.StructField("rows", T.LongType()),
    ]
)
PARAM = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("schema", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)
CLUSTER = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("canonical", T.StringType()),
        T.StructField("members", T.ArrayType(STATEMENT)),
        T.StructField("total_calls", T.LongType()),
        T.StructField("total_exec_time_ms", T.DoubleType()),
        T.StructField("mean_exec_time_ms", T.DoubleType()),
        T.StructField("rows", T.LongType()),
        T.StructField("params", T.ArrayType(PARAM)),
    ]
)
DOCUMENT = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("clusters", T.ArrayType(CLUSTER))])

#: Fields that a document must give; the others default to zero, "" or an empty list.
REQUIRED = {
    "statement": ("raw",),
    "cluster": ("fingerprint", "canonical", "members", "total_calls"),
    "param": ("position", "confidence"),
}
