"""Argument types of functions, from catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most overload keys that ``lookup`` takes to the driver; more is an error.
MAX_KEYS = 200_000


def argument_types(proc: DataFrame, namespace: DataFrame, type_: DataFrame) -> DataFrame:
    """One row a function with arguments: oid, schema, name, arity, types.

    ``proc``: oid, proname, pronamespace, pronargs, proargtypes (array of type
    oids). A type outside pg_catalog carries its schema's name.
    """
    args = proc.select("oid", "proname", "pronamespace", "pronargs", F.posexplode("proargtypes").alias("ord", "argtype"))
    schemas = namespace.select(F.col("oid").alias("pronamespace"), F.col("nspname").alias("schema"))
    type_schemas = namespace.select(F.col("oid").alias("typnamespace"), F.col("nspname").alias("typschema"))
    types = type_.select(F.col("oid").alias("argtype"), "typname", "typnamespace").join(type_schemas, "typnamespace")
    named = F.when(F.col("typschema") == "pg_catalog", F.col("typname")).otherwise(F.concat_ws(".", "typschema", "typname"))
    rows = args.join(schemas, "pronamespace").join(types, "argtype").withColumn("type", named)
    grouped = rows.groupBy("oid", "schema", F.col("proname").alias("name"), F.col("pronargs").cast("int").alias("arity"))
    return grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "type"))), lambda x: x["type"]).alias("types"))


def overloads(functions: DataFrame) -> DataFrame:
    """(schema, name, arity) -> types, null where several functions answer.

    The empty schema stands for any.
    """
    both = functions.withColumn("schema", F.explode(F.array("schema", F.lit(""))))
    one = both.groupBy("schema", "name", "arity").agg(F.count(F.lit(1)).alias("n"), F.first("types").alias("types"))
    return one.withColumn("types", F.when(F.col("n") == 1, F.col("types")))


def lookup(found: DataFrame) -> dict[tuple[str, str, int], list[str] | None]:
    """``overloads`` as a dictionary for the cast rules; its size is checked."""
    rows = found.select("schema", "name", "arity", "types").limit(MAX_KEYS + 1).collect()
    if len(rows) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} functions in the catalog")
    return {(r["schema"], r["name"], r["arity"]): r["types"] for r in rows}
