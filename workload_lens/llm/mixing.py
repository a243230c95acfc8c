"""Mixing sources to target weights by Poisson replication, in native operations.

Every source gets a mean repetition rate, its share of the target divided by its
share of what there is. A document's count is the Poisson quantile of a hash of
its id at that rate; the document is repeated that often, and all copies are
dealt out and sorted by a hash of (id, copy), which shuffles them globally.

Rates come from one row a source. They are broadcast only when there are at most
``broadcast_sources`` of them; beyond that each source is spread over ``salts``
join keys, so a source with a third of all rows is no task's burden.

Defined results: a null source is a source of its own; a null text weighs
nothing and is repeated at its source's rate; rows with equal ids share their
count; a source without weight in ``targets`` disappears; an empty table stays
empty; a long text only counts with its length. Documents keep their columns; the
added ones are ``copy`` (from 0), ``n_copies`` and ``shuffle_key``, and an input
column with such a name is replaced unless ``prefix`` sets their names apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

_BITS = 52


def _hash52(*parts: Column) -> Column:
    """The first 52 bits of an MD5, as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def _text_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null"))


def rates(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", targets: dict[str, float] | None = None, exponent: float = 0.5, total: float = 1.0) -> DataFrame:
    """One row a source: __key, rate.

    The size of a source is its characters. Without ``targets`` a source's weight
    is its size to the power ``exponent``. The mix has ``total`` times the size of
    the input.
    """
    sizes = docs.groupBy(F.struct(F.col(source_col).cast("string").alias("s")).alias("__key")).agg(F.sum(F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0))).alias("size"))
    if targets is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(exponent))
    else:
        table = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]) if targets else F.create_map().cast("map<string,double>")
        weight = F.coalesce(table[F.col("__key.s")].cast("double"), F.lit(0.0))
    weighed = sizes.withColumn("weight", weight)
    sums = weighed.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight")).otherwise(0.0)).alias("all_weight"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.when(F.col("all_weight") > 0, F.col("all_weight"))).otherwise(0.0)
    rate = F.when(F.col("size") > 0, share * F.col("all_size") * F.lit(total) / F.when(F.col("size") > 0, F.col("size"))).otherwise(F.lit(1.0))
    return weighed.join(F.broadcast(sums)).select("__key", rate.alias("rate"))  # one row of sums


def poisson_cdf(rate: Column, most: int) -> Column:
    """The Poisson distribution function at 0, 1, ..., most, as an array."""
    start = F.struct(F.exp(-rate).alias("term"), F.array().cast("array<double>").alias("out"))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("out")),
        lambda acc, k: F.struct((acc["term"] * rate / k).alias("term"), F.concat(acc["out"], F.array(F.element_at(acc["out"], -1) + acc["term"] * rate / k)).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(start["term"] > 0, terms)


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", targets: dict[str, float] | None = None, exponent: float = 0.5, total: float = 1.0, max_rate: float = 64.0, seed: int = 5, broadcast_sources: int = 10_000, salts: int = 64, prefix: str = "") -> DataFrame:
    """Documents repeated to the target mix, in a global random order.

    The whole part of a rate above ``max_rate`` is repeated outright and the rest
    drawn, so the distribution function never needs more than a few hundred terms.
    """
    table = rates(docs, source_col=source_col, text_col=text_col, targets=targets, exponent=exponent, total=total)
    sure = F.when(F.col("rate") > max_rate, F.floor(F.col("rate") - max_rate)).otherwise(F.lit(0)).cast("long")
    table = table.withColumn("__sure", sure)
    largest = table.agg(F.max(F.col("rate") - F.col("__sure")), F.count(F.lit(1))).first()
    top, sources = largest[0] or 0.0, largest[1]
    most = math.ceil(top + 10 * math.sqrt(top) + 12)
    table = table.select("__key", "__sure", poisson_cdf(F.col("rate") - F.col("__sure"), most).alias("__cdf"))
    own = spare(docs, "mix")  # internal columns are its fields, apart from all others
    named = lambda x: f"{own}{x}"
    table = table.select(F.col("__key").alias(named("key")), F.col("__sure").alias(named("sure")), F.col("__cdf").alias(named("cdf")))
    keyed = docs.withColumns({named("key"): F.struct(F.col(source_col).cast("string").alias("s")), named("id"): _text_of(id_col)})
    if sources <= broadcast_sources:
        joined = keyed.join(F.broadcast(table), named("key"))
    else:
        spread = table.withColumn(named("salt"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = keyed.withColumn(named("salt"), F.pmod(F.xxhash64(named("id")), F.lit(salts)).cast("int")).join(spread, [named("key"), named("salt")]).drop(named("salt"))
    u = (_hash52(F.lit(f"count{seed}"), F.col(named("id"))).cast("double") + 0.5) / float(1 << _BITS)
    drawn = F.size(F.filter(named("cdf"), lambda c: c < F.col(named("u")))).cast("long")
    n, copy, place = (prefix + x for x in ("n_copies", "copy", "shuffle_key"))
    counted = joined.withColumn(named("u"), u).withColumn(n, F.col(named("sure")) + drawn).drop(*map(named, ("u", "cdf", "sure", "key")))
    copies = counted.where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    keyed = copies.withColumn(place, _hash52(F.lit(f"place{seed}"), F.col(named("id")), F.col(copy))).drop(named("id"))
    return keyed.repartition(place).sortWithinPartitions(place)


def oracle(exponent: float = 0.5, total: float = 1.0, seed: int = 5) -> str:
    """The same counts and order in DuckDB, for rates below ``max_rate``."""
    bits = float(1 << _BITS)
    return f"""
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source
), sums AS (
  SELECT sum(size) AS all_size, sum(CASE WHEN size > 0 THEN pow(size::DOUBLE, {exponent}) ELSE 0 END) AS all_weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN pow(size::DOUBLE, {exponent}) / all_weight * all_size * {total} / size ELSE 1.0 END AS rate FROM sizes, sums
), terms AS (
  SELECT source, k, sum(exp(-rate) * pow(rate, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, range(0, 120) r(k)
), drawn AS (
  SELECT doc_id, source, (('0x' || substr(md5('count{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / {bits} AS u FROM documents
), counted AS (
  SELECT d.doc_id, d.source, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.cdf < d.u) AS n_copies FROM drawn d
)
SELECT doc_id, source, copy, n_copies,
  ('0x' || substr(md5('place{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 13))::BIGINT AS shuffle_key
FROM (SELECT doc_id, source, n_copies, unnest(range(0, n_copies)) AS copy FROM counted)
"""
