"""Queries over the derived workload, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import max_param_number, rewrite_params, stub_slug
from ..operators import attribute, capture, catalog, cluster, stubs
from ..sources.document import cluster_json
from ..sources.schemas import CLUSTER
from . import workload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_META = r"(?i)^\s*(discard|begin|start|commit|rollback|savepoint|release|set|reset|show|listen|unlisten|notify|checkpoint|vacuum|analyze|reindex|cluster|explain|prepare|deallocate|execute|close|fetch|move|lock)\b"
_WITH = f"""
WITH statements AS ({workload.statements_sql()}), captured AS (
  SELECT *, CASE WHEN shape IS NULL THEN '' ELSE 'sha1:' || substr(sha1(shape), 1, 16) END AS fingerprint
  FROM statements WHERE calls > 0 AND NOT regexp_matches(query, '{_META}')
), clusters AS (
  SELECT fingerprint, first(canonical ORDER BY total_exec_time DESC, queryid) AS canonical, sum(calls)::BIGINT AS total_calls,
    sum(total_exec_time) AS total_exec_time_ms, sum(rows)::BIGINT AS rows, count(*) AS n_members,
    CASE WHEN fingerprint = '' THEN max(mean_exec_time) WHEN sum(calls) > 0 THEN sum(total_exec_time) / sum(calls) ELSE 0 END AS mean_exec_time_ms,
    max(total_exec_time) AS first_time, first(queryid ORDER BY total_exec_time DESC, queryid) AS first_id
  FROM captured GROUP BY fingerprint, CASE WHEN fingerprint = '' THEN row_key END
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY total_exec_time_ms DESC, total_calls DESC, fingerprint, first_time DESC, first_id) - 1 AS pos FROM clusters
)
"""
_STATEMENT_COLUMNS = "raw, queryid, calls, total_exec_time_ms, mean_exec_time_ms, stddev_exec_time_ms, rows"
_CAPTURED = "query AS raw, queryid, calls, total_exec_time AS total_exec_time_ms, mean_exec_time AS mean_exec_time_ms, stddev_exec_time AS stddev_exec_time_ms, rows"
_CLUSTER_COLUMNS = ("fingerprint", "canonical", "total_calls", "total_exec_time_ms", "mean_exec_time_ms", "rows", "n_members")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _captured(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return capture.capture(workload.statements(spark, sf_dir), workload.databases(spark, sf_dir), **options)


def _clusters(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return cluster.clusters(cluster.analyzed(_captured(spark, sf_dir)), **options)


def _positioned(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` clusters with their places; a window over ``limit`` rows at most."""
    rows = cluster.ranked(found, limit=limit)
    order = Window.orderBy(F.col("total_exec_time_ms").desc(), F.col("total_calls").desc(), "fingerprint", "first_ord")
    return rows.withColumn("pos", F.row_number().over(order).cast("long") - 1)


# -- capture -----------------------------------------------------------------


@query(f"{_WITH} SELECT {_CAPTURED} FROM statements WHERE calls > 20 AND NOT regexp_matches(query, '{_META}')")
def capture_min_calls(spark, sf_dir):
    return _captured(spark, sf_dir, min_calls=20).drop("ord")


@query(f"{_WITH} SELECT {_CAPTURED} FROM captured")
def capture_skip_meta(spark, sf_dir):
    return _captured(spark, sf_dir).drop("ord")


@query(f"{_WITH} SELECT {_CAPTURED} FROM captured JOIN nation ON n_nationkey = dbid WHERE n_name = 'NATION_7'")
def capture_database_join(spark, sf_dir):
    return _captured(spark, sf_dir, database="NATION_7").drop("ord")


@query(f"{_WITH} SELECT {_CAPTURED} FROM captured ORDER BY total_exec_time DESC, queryid LIMIT 100")
def capture_topn(spark, sf_dir):
    return _captured(spark, sf_dir, limit=100).drop("ord")


# -- texts -------------------------------------------------------------------


@query("WITH s AS (" + workload.statements_sql() + ") SELECT queryid, query IS NOT NULL AND shape IS NOT NULL AS parse_ok, CASE WHEN query IS NULL THEN '' ELSE canonical END AS canonical FROM s")
def normalize_corpus(spark, sf_dir):
    rows = workload.statements(spark, sf_dir).select("queryid", F.col("query").alias("raw"))
    return cluster.analyzed(rows).select("queryid", "parse_ok", "canonical")


@query("WITH s AS (" + workload.statements_sql() + ") SELECT queryid, CASE WHEN query IS NULL OR shape IS NULL THEN '' ELSE 'sha1:' || substr(sha1(shape), 1, 16) END AS fingerprint FROM s")
def fingerprint_corpus(spark, sf_dir):
    rows = workload.statements(spark, sf_dir).select("queryid", F.col("query").alias("raw"))
    return cluster.analyzed(rows).select("queryid", "fingerprint")


@query(
    "WITH s AS (" + workload.statements_sql() + ") SELECT queryid, coalesce(list_max(list_transform(regexp_extract_all(regexp_replace(query, '''[^'']*''', ' ', 'g'), '\\$(\\d+)', 1), lambda x: x::INT)), 0)::INT AS n_params FROM s WHERE query IS NOT NULL"
)
def max_param(spark, sf_dir):
    rows = workload.statements(spark, sf_dir).where("query is not null")
    return rows.select("queryid", max_param_number(F.col("query")).alias("n_params"))


@query("WITH s AS (" + workload.statements_sql() + ") SELECT queryid, regexp_replace(query, '\\$(\\d+)', ':param\\1', 'g') AS sql FROM s")
def rewrite_parameters(spark, sf_dir):
    return workload.statements(spark, sf_dir).select("queryid", rewrite_params(F.col("query")).alias("sql"))


# -- clusters ----------------------------------------------------------------


@query(f"{_WITH} SELECT {', '.join(_CLUSTER_COLUMNS)} FROM clusters WHERE fingerprint <> ''")
def cluster_totals(spark, sf_dir):
    return _clusters(spark, sf_dir).where("fingerprint <> ''").select(*_CLUSTER_COLUMNS)


@query(f"{_WITH} SELECT {', '.join(_CLUSTER_COLUMNS)} FROM clusters WHERE fingerprint = ''")
def cluster_unparseable(spark, sf_dir):
    return _clusters(spark, sf_dir).where("fingerprint = ''").select(*_CLUSTER_COLUMNS)


@query(f"{_WITH} SELECT {', '.join(_CLUSTER_COLUMNS)} FROM ranked")
def cluster_ranked(spark, sf_dir):
    return cluster.ranked(_clusters(spark, sf_dir)).select(*_CLUSTER_COLUMNS)


@query(f"{_WITH} SELECT pos, {', '.join(_CLUSTER_COLUMNS)} FROM ranked WHERE pos < 20")
def cluster_top(spark, sf_dir):
    return _positioned(_clusters(spark, sf_dir), 20).select("pos", *_CLUSTER_COLUMNS)


@query(
    f"""{_WITH} SELECT fingerprint, coalesce(queryid, 0) AS queryid, query AS raw, calls,
  CASE WHEN fingerprint = '' THEN 0 ELSE row_number() OVER (PARTITION BY fingerprint ORDER BY total_exec_time DESC, queryid) - 1 END::INT AS place FROM captured"""
)
def cluster_members(spark, sf_dir):
    found = _clusters(spark, sf_dir, members=True).select("fingerprint", F.posexplode("members").alias("place", "m"))
    return found.select("fingerprint", "m.queryid", "m.raw", "m.calls", "place")


@query(f"{_WITH} SELECT bool_or(total_exec_time_ms > 0) AS has_timing FROM clusters")
def cluster_has_timing(spark, sf_dir):
    return cluster.has_timing(_clusters(spark, sf_dir))


@query(
    f"""{_WITH}, counted AS (
  SELECT count(DISTINCT query) AS texts, count(DISTINCT CASE WHEN fingerprint = '' THEN query ELSE fingerprint END) AS shapes, count(*) FILTER (fingerprint = '') AS unreadable FROM captured
) SELECT *, 1 - shapes / texts AS reduction FROM counted"""
)
def corpus_reduction(spark, sf_dir):
    return cluster.reduction(cluster.analyzed(_captured(spark, sf_dir)))


@query(f"{_WITH} SELECT fingerprint, total_calls, total_exec_time_ms, rows, n_members, n_members AS n_written FROM clusters WHERE fingerprint <> ''")
def document_roundtrip(spark, sf_dir):
    found = _clusters(spark, sf_dir, members=True).where("fingerprint <> ''")
    back = found.select("n_members", F.from_json(cluster_json(found), CLUSTER, {"mode": "FAILFAST"}).alias("c"))
    return back.select("c.fingerprint", "c.total_calls", F.coalesce("c.total_exec_time_ms", F.lit(0.0)).alias("total_exec_time_ms"), F.coalesce("c.rows", F.lit(0)).alias("rows"), "n_members", F.size("c.members").cast("long").alias("n_written"))


# -- stubs -------------------------------------------------------------------

_STUB = """'-- name: ' || slug || chr(10) || '-- Generated from workload_lens cluster ' || fingerprint || chr(10) || '-- Total calls (prod): ' || total_calls::VARCHAR || ' across ' || n_members::VARCHAR
    || ' member variants' || chr(10) || '-- TODO: rename this slug, review canonical SQL, replace :paramN with meaningful names' || chr(10) || regexp_replace(canonical, '\\$(\\d+)', ':param\\1', 'g') || chr(10)"""


@query(
    f"""{_WITH}, first_ones AS (
  SELECT *, row_number() OVER (ORDER BY pos) AS rank FROM ranked WHERE fingerprint <> '' AND total_calls > 10 ORDER BY pos LIMIT 10
), slugs AS (
  SELECT *, 'q' || lpad(rank::VARCHAR, 2, '0') || '-' || substr(fingerprint, 6, 8) AS slug FROM first_ones
) SELECT rank::INT AS rank, slug, 'sql/' || slug || '.sql' AS path, {_STUB} AS content FROM slugs"""
)
def stub_files(spark, sf_dir):
    found = _clusters(spark, sf_dir).where("fingerprint <> '' and total_calls > 10")
    return stubs.stubs(_positioned(found, 10), top=10, min_calls=10)


@query("WITH s AS (SELECT o_orderkey AS k FROM orders) SELECT k, CASE WHEN k % 120 < 100 THEN lpad((k % 120)::VARCHAR, 2, '0') ELSE (k % 120)::VARCHAR END AS r, 'q' || CASE WHEN k % 120 < 100 THEN lpad((k % 120)::VARCHAR, 2, '0') ELSE (k % 120)::VARCHAR END || '-' || substr(md5(k::VARCHAR), 1, 8) AS slug FROM s")
def stub_slugs(spark, sf_dir):
    rows = workload.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    rank = (F.col("k") % 120).cast("int")
    return rows.select("k", F.format_string("%02d", rank).alias("r"), stub_slug(rank, F.concat(F.when(F.col("k") % 2 == 0, "sha1:").otherwise(""), F.md5(F.col("k").cast("string").cast("binary")))).alias("slug"))


# -- catalog and casts -------------------------------------------------------


@query(f"WITH {workload.catalog_sql()} SELECT oid, schema, name, arity, types FROM functions")
def catalog_arg_types(spark, sf_dir):
    return catalog.argument_types(*workload.catalog(spark, sf_dir)).withColumn("types", F.array_join("types", ","))


@query(
    f"""WITH {workload.catalog_sql()}, both_ AS (SELECT * FROM functions UNION ALL SELECT * REPLACE ('' AS schema) FROM functions)
SELECT schema, name, arity, count(*) AS n, CASE WHEN count(*) = 1 THEN any_value(types) END AS types FROM both_ GROUP BY schema, name, arity"""
)
def overload_resolution(spark, sf_dir):
    found = catalog.overloads(catalog.argument_types(*workload.catalog(spark, sf_dir)))
    return found.withColumn("types", F.array_join("types", ","))


@query(
    f"""WITH {workload.catalog_sql()}, both_ AS (SELECT * FROM functions UNION ALL SELECT * REPLACE ('' AS schema) FROM functions),
overloads AS (SELECT schema, name, arity, CASE WHEN count(*) = 1 THEN any_value(types) END AS types FROM both_ GROUP BY schema, name, arity),
calls AS (SELECT schema, name, arity, types, CASE WHEN schema = '' THEN '' ELSE schema || '.' END || name AS called FROM overloads)
SELECT 'SELECT ' || called || '(' || list_aggregate(list_transform(range(1, arity + 1), lambda i: '$' || i::VARCHAR), 'string_agg', ', ') || ') FROM t WHERE $' || (arity + 1)::VARCHAR AS canonical,
  'SELECT ' || called || '(' || CASE WHEN types IS NULL THEN list_aggregate(list_transform(range(1, arity + 1), lambda i: '$' || i::VARCHAR), 'string_agg', ', ')
    ELSE list_aggregate(list_transform(range(1, arity + 1), lambda i: '$' || i::VARCHAR || '::' || split_part(types, ',', i::INT)), 'string_agg', ', ') END
    || ') FROM t WHERE $' || (arity + 1)::VARCHAR || '::bool' AS sql, (arity + 1)::INT AS n_params FROM calls"""
)
def cast_params(spark, sf_dir):
    found = catalog.overloads(catalog.argument_types(*workload.catalog(spark, sf_dir)))
    called = F.concat(F.when(F.col("schema") == "", "").otherwise(F.concat("schema", F.lit("."))), F.col("name"))
    params = F.array_join(F.transform(F.sequence(F.lit(1), F.col("arity")), lambda i: F.concat(F.lit("$"), i.cast("string"))), ", ")
    text = F.concat(F.lit("SELECT "), called, F.lit("("), params, F.lit(") FROM t WHERE $"), (F.col("arity") + 1).cast("string"))
    rows = found.select(text.alias("canonical")).withColumn("fingerprint", F.col("canonical"))
    return attribute.explain_scripts(rows, catalog.lookup(found)).select(F.col("fingerprint").alias("canonical"), "sql", "n_params")


@query(
    f"""{_WITH} SELECT fingerprint, 'BEGIN;' || chr(10) || 'SET LOCAL plan_cache_mode = force_generic_plan;' || chr(10) || 'PREPARE _workload_lens_plan AS ' || canonical || ';' || chr(10) ||
  'EXPLAIN (FORMAT JSON) EXECUTE _workload_lens_plan' || CASE WHEN canonical LIKE '%$2%' THEN '(NULL, NULL)' ELSE '' END || ';' || chr(10) || 'DEALLOCATE _workload_lens_plan;' || chr(10) || 'COMMIT;' AS script
FROM clusters WHERE fingerprint <> ''"""
)
def explain_scripts(spark, sf_dir):
    found = _clusters(spark, sf_dir).where("fingerprint <> ''")
    return attribute.explain_scripts(found, {}).select("fingerprint", "script")


# -- attribution -------------------------------------------------------------


def _attributed(spark: SparkSession, sf_dir: str, *, top: int) -> DataFrame:
    """Outcomes of the clusters whose ``pos`` is below ``top``; 0 looks at all."""
    plans = workload.plans(spark, sf_dir)
    rows = workload.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("pos"), F.concat(F.lit("sha1:"), F.col("o_orderkey").cast("string")).alias("fingerprint"), F.lit("SELECT 1").alias("canonical"))
    found = attribute.attribute(rows, plans, top=top)
    return found.select("fingerprint", "outcome", F.size("params").alias("n_params"), F.coalesce(F.get("params", F.lit(0))["note"], F.lit("")).alias("note"))


@query(workload.parameters_sql())
def attribute_params(spark, sf_dir):
    return attribute.parameters(workload.plans(spark, sf_dir)).select("fingerprint", "param.*")


@query(
    f"""WITH found AS ({workload.parameters_sql()}), per AS (SELECT fingerprint, count(*) AS n FROM found GROUP BY fingerprint)
SELECT 'sha1:' || o_orderkey::VARCHAR AS fingerprint,
  CASE WHEN o_orderkey >= 5000 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN n > 0 THEN 'attributed' ELSE 'skipped' END AS outcome,
  CASE WHEN o_orderkey >= 5000 THEN 0 WHEN o_orderkey % 11 = 0 THEN 1 ELSE coalesce(n, 0) END::INT AS n_params,
  CASE WHEN o_orderkey < 5000 AND o_orderkey % 11 = 0 THEN 'connection lost' ELSE '' END AS note
FROM orders LEFT JOIN per ON per.fingerprint = 'sha1:' || o_orderkey::VARCHAR"""
)
def attribute_clusters(spark, sf_dir):
    return _attributed(spark, sf_dir, top=5000)


@query(
    f"""WITH found AS ({workload.parameters_sql()}), per AS (SELECT fingerprint, count(*) AS n FROM found GROUP BY fingerprint)
SELECT 'sha1:' || o_orderkey::VARCHAR AS fingerprint,
  CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN n > 0 THEN 'attributed' ELSE 'skipped' END AS outcome,
  CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE coalesce(n, 0) END::INT AS n_params,
  CASE WHEN o_orderkey % 11 = 0 THEN 'connection lost' ELSE '' END AS note
FROM orders LEFT JOIN per ON per.fingerprint = 'sha1:' || o_orderkey::VARCHAR"""
)
def attribute_all_clusters(spark, sf_dir):
    return _attributed(spark, sf_dir, top=0)


@query(
    f"""WITH found AS ({workload.parameters_sql()}), per AS (
  SELECT fingerprint, string_agg(position::VARCHAR || ' ' || "table" || '.' || "column", ', ' ORDER BY position) AS params FROM found GROUP BY fingerprint
), looked AS (
  SELECT o_orderkey, o_orderkey % 5 > 1 AS look, CASE WHEN o_orderkey % 11 <> 0 THEN params END AS params FROM orders LEFT JOIN per ON per.fingerprint = 'sha1:' || o_orderkey::VARCHAR
)
SELECT o_orderkey AS pos, CASE WHEN look THEN CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN params IS NOT NULL THEN 'attributed' ELSE 'skipped' END END AS outcome,
  CASE WHEN NOT look THEN '' WHEN o_orderkey % 11 = 0 THEN '0 .' ELSE coalesce(params, '') END AS params FROM looked"""
)
def attribute_listing(spark, sf_dir):
    """Clusters without fingerprint or text are left alone; parameters come by position."""
    key = F.col("o_orderkey").cast("long")
    rows = workload.table(spark, sf_dir, "orders").select(
        key.alias("pos"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("sha1:"), key.cast("string"))).alias("fingerprint"),
        F.when(key % 5 == 1, "").otherwise("SELECT 1").alias("canonical"),
    )
    said = F.transform("params", lambda p: F.concat(p["position"].cast("string"), F.lit(" "), p["table"], F.lit("."), p["column"]))
    return attribute.attribute(rows, workload.plans(spark, sf_dir)).select("pos", "outcome", F.array_join(said, ", ").alias("params"))


@query(f"SELECT o_orderkey AS k, {workload.case_sql(f'o_orderkey % {len(workload.CASTS)}', [b for _, b in workload.CASTS])} AS sql FROM orders")
def cast_rules(spark, sf_dir):
    """Each rule for bare parameters, without a catalog."""
    key = F.col("o_orderkey")
    rows = workload.table(spark, sf_dir, "orders").select(key.cast("string").alias("fingerprint"), workload.case(key % len(workload.CASTS), [a for a, _ in workload.CASTS], {}).alias("canonical"))
    return attribute.explain_scripts(rows, {}).select(F.col("fingerprint").cast("long").alias("k"), "sql")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture, canonical form, clusters, ranking."""
    return QUERIES["cluster_ranked"](spark, sf_dir)
