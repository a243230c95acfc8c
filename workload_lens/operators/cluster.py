"""Clusters of statements by fingerprint.

Texts are read where they lie; the only shuffle of ``clusters`` is that of its
partial sums, one row a shape and task. The members of a cluster are a relation of
their own (``analyzed``), and gathered into arrays only for a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import analysis
from ..functions.text import fingerprint_of
from ..sources.schemas import STATEMENT


def analyzed(statements: DataFrame) -> DataFrame:
    """Statements with canonical, fingerprint ("" if unreadable), parse_ok and error."""
    out = statements.withColumn("__a", analysis(F.col("raw")))
    ok = F.col("__a.parse_ok")
    found = {
        "parse_ok": ok,
        "canonical": F.coalesce("__a.canonical", F.lit("")),
        "fingerprint": F.when(ok, fingerprint_of(F.col("__a.shape"))).otherwise(""),
        "error": F.col("__a.error"),
    }
    return out.withColumns(found).drop("__a")


def clusters(rows: DataFrame, *, members: bool = False) -> DataFrame:
    """One row a shape of ``rows`` (from ``analyzed``, with an ``ord`` to sort by).

    The canonical text is the first member's. An unreadable statement is a cluster
    of its own, with an empty fingerprint and its own mean; a readable cluster's
    mean is total over calls, 0 without calls. ``members`` adds the statements of
    each cluster in their order.
    """
    # Unreadable rows get a key each, whatever their values, and so spread over all tasks.
    keyed = rows.withColumn("__own", F.when(~F.col("parse_ok"), F.monotonically_increasing_id()))
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    aggs = [
        F.min_by("canonical", "ord").alias("canonical"),
        F.sum(zero("calls", 0)).alias("total_calls"),
        F.sum(zero("total_exec_time_ms", 0.0)).alias("total_exec_time_ms"),
        F.sum(zero("rows", 0)).alias("rows"),
        F.sum(F.when(~F.col("parse_ok"), zero("mean_exec_time_ms", 0.0))).alias("__mean"),
        F.count(F.lit(1)).alias("n_members"),
        F.min("ord").alias("first_ord"),
    ]
    if members:
        record = F.struct(*(F.coalesce(F.col(f.name), F.lit("" if f.name == "raw" else 0)).cast(f.dataType).alias(f.name) for f in STATEMENT))
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct("ord", record.alias("q")))), lambda x: x["q"]).alias("members"))
    grouped = keyed.groupBy("fingerprint", "__own").agg(*aggs)
    mean = F.when(F.col("fingerprint") == "", F.col("__mean")).when(F.col("total_calls") > 0, F.col("total_exec_time_ms") / F.when(F.col("total_calls") > 0, F.col("total_calls"))).otherwise(0.0)
    names = ["fingerprint", "canonical", *["members"] * members, "total_calls", "total_exec_time_ms", "mean_exec_time_ms", "rows", "n_members", "first_ord"]
    return grouped.withColumn("mean_exec_time_ms", mean).select(names)


def has_timing(found: DataFrame) -> DataFrame:
    """One row: whether any cluster has execution time."""
    return found.agg(F.coalesce(F.max(F.col("total_exec_time_ms") > 0), F.lit(False)).alias("has_timing"))


def ranked(found: DataFrame, *, limit: int = 0) -> DataFrame:
    """Clusters by total time, calls and fingerprint.

    Without any timing all times are zero and tie, so the flag of ``has_timing``
    needs no pass of its own. ``limit`` > 0 takes the first ones by a top-k.
    """
    time = F.greatest(F.col("total_exec_time_ms"), F.lit(0.0))
    out = found.orderBy(time.desc(), F.col("total_calls").desc(), F.col("fingerprint").asc(), F.col("first_ord").asc(), F.col("canonical").asc())
    return out.limit(limit) if limit > 0 else out


def reduction(rows: DataFrame) -> DataFrame:
    """One row: distinct texts and shapes, unreadable rows, and 1 - shapes / texts.

    An unreadable text counts as a shape.
    """
    shapes = F.struct("fingerprint", F.when(~F.col("parse_ok"), F.col("raw")))
    out = rows.agg(F.count_distinct("raw").alias("texts"), F.count_distinct(shapes).alias("shapes"), F.count(F.when(~F.col("parse_ok"), 1)).alias("unreadable"))
    return out.withColumn("reduction", F.when(F.col("texts") > 0, 1 - F.col("shapes") / F.when(F.col("texts") > 0, F.col("texts"))).otherwise(0.0))
