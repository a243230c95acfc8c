"""Which column each ``$N`` of a cluster is compared with, from query plans.

A plan is a tree of any depth, so its nodes are listed by an Arrow-batched UDF;
all that follows (conditions, patterns, confidence, the choice between several
findings) is native, one pass and one aggregation by (fingerprint, position).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import analysis, with_casts
from ..functions.text import max_param_number
from ..sources.schemas import PARAM

# Names in plan JSON; conditions in the order they are read.
CONDITIONS = ("Index Cond", "Hash Cond", "Filter", "Recheck Cond", "Join Filter", "Merge Cond")
_NAMES = ("Schema", "Relation Name", "Alias")
CONDITION = "array<struct<node:int,slot:int,schema:string,relation:string,alias:string,condition:string>>"

# A column compared with a parameter, and a list that begins with one. Names are read whole, from their
# first letter (or from where the last match ended), so that the time is linear in a condition's length.
_NAME_BEGINS = r"(?:(?<!\w)|\G)(?:\(?\w++\.)?\w++"
_OPERATOR = r"\s*+(?:[<>]=?|<>|!?=)\s*+"
_COMPARED = rf"(?U){_NAME_BEGINS}{_OPERATOR}\$\d++|\$\d++{_OPERATOR}(?:\(?\w++\.)?\w++"
_LISTED = rf"(?U){_NAME_BEGINS}\s++(?:=\s*ANY\s*\()?IN\s*\(\s*\$\d++"
_PREPARED = "_workload_lens_plan"


def plan_nodes(text: str) -> list[dict]:
    """Nodes of an EXPLAIN (FORMAT JSON) text, parents first; a malformed node goes with its subtree."""
    doc = json.loads(text)
    if not isinstance(doc, list) or any(not isinstance(x, dict) or "Plan" not in x for x in doc):
        raise ValueError("parse EXPLAIN JSON: a list of plans expected")
    out, stack = [], [x["Plan"] for x in doc[:1]]
    while stack:
        node = stack.pop()
        if not isinstance(node, dict) or not isinstance(node.get("Plans", []), list):
            continue
        fields = [node.get(k, "") for k in (*_NAMES, *CONDITIONS)]
        if not all(isinstance(x, str) for x in fields):
            continue
        schema, relation, alias, *conditions = fields
        out.append({"schema": schema, "relation": relation, "alias": alias, "conditions": conditions})
        stack.extend(reversed(node.get("Plans", [])))
    return out


def plan_conditions(text: str | None) -> dict:
    """The conditions of a plan that name a parameter, in reading order; or why there are none."""
    if text is None:
        return {"conditions": [], "error": "EXPLAIN returned no rows"}
    try:
        nodes = plan_nodes(text)
    except (ValueError, RecursionError) as e:
        return {"conditions": [], "error": str(e) or "parse EXPLAIN JSON"}
    found = []
    for k, node in enumerate(nodes):
        of = {x: node[x] for x in ("schema", "relation", "alias")}
        found += [{"node": k, "slot": i, **of, "condition": c} for i, c in enumerate(node["conditions"]) if "$" in c]
    return {"conditions": found, "error": None}


def _listed(plan_json: Column) -> Column:
    kinds = {"node": pa.int32(), "slot": pa.int32(), "schema": pa.string(), "relation": pa.string(), "alias": pa.string(), "condition": pa.string()}
    answer = pa.struct({"conditions": pa.list_(pa.struct(kinds)), "error": pa.string()})

    @F.arrow_udf(f"conditions {CONDITION}, error string")
    def walk(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            # equal texts of a batch are read once
            told = batch.dictionary_encode(null_encoding="encode")
            yield pa.array([plan_conditions(x) for x in told.dictionary.to_pylist()], answer).take(told.indices)

    return walk(plan_json)


def _matches(condition: Column) -> Column:
    """Texts of the matches: comparisons first, then lists."""
    whole = lambda pattern: F.regexp_extract_all(condition, F.lit(pattern), F.lit(0))
    return F.concat(whole(_COMPARED), F.when(condition.contains("IN"), whole(_LISTED)).otherwise(F.array().cast("array<string>")))


def findings(plans: DataFrame) -> DataFrame:
    """Every comparison of a parameter: fingerprint, error, at (its order), position, schema, table, column, confidence.

    ``plans``: fingerprint, ``conditions`` and ``error`` (see ``listed``). A plan without
    a comparison gives a row without position, so that one pass serves both.
    """
    conditions = plans.select("fingerprint", "error", F.inline_outer("conditions"))
    found = conditions.select("*", F.posexplode_outer(_matches(F.col("condition"))).alias("match", "m"))
    # A match has one parameter, and a name before or after it: what neither blanks nor operators are.
    m = F.col("m")
    after = m.startswith("$")
    found = found.withColumns(
        {
            "name": F.when(after, F.regexp_extract(m, r"(?U)[^\s=<>!]+\z", 0)).otherwise(F.regexp_extract(m, r"(?U)^[^\s=<>!]+", 0)),
            "number": F.when(after, F.regexp_extract(m, r"(?U)^\$(\d+)", 1)).otherwise(F.substring_index(m, "$", -1)),
            "table": F.when(F.col("relation") != "", F.col("relation")).otherwise(F.col("alias")),
        }
    )
    found = found.withColumn("qualifier", F.when(F.col("name").contains("."), F.ltrim(F.substring_index("name", ".", 1), F.lit("("))).otherwise(""))
    qualifier = F.col("qualifier")
    # A qualifier is known if it is the relation or its alias; an empty one never is.
    known = (qualifier != "") & ((qualifier == F.col("relation")) | (qualifier == F.col("alias")))
    there = F.col("table") != ""
    confidence = F.when(known | (there & (qualifier == "")), "exact").when(there, "heuristic").otherwise("none")
    return found.select(
        "fingerprint",
        "error",
        F.struct("node", "slot", "match").alias("at"),
        F.col("number").try_cast("int").alias("position"),
        F.when(known | there, F.col("schema")).otherwise("").alias("schema"),
        F.when(known | there, F.col("table")).otherwise("").alias("table"),
        F.substring_index("name", ".", -1).alias("column"),
        confidence.alias("confidence"),
    )


def listed(plans: DataFrame) -> DataFrame:
    """``plans`` (fingerprint, plan_json, optional error) with conditions and error."""
    given = F.col("error") if "error" in plans.columns else F.lit(None).cast("string")
    out = plans.withColumn("__p", _listed(F.when(given.isNull(), F.col("plan_json"))))
    return out.select("fingerprint", F.col("__p.conditions").alias("conditions"), F.coalesce(given, F.col("__p.error")).alias("error"))


def _reduced(plans: DataFrame) -> DataFrame:
    """fingerprint, position, param, error, ok; a row without position tells of the other plans."""
    late = (F.col("confidence") != "exact").cast("int")
    sign = 1 - 2 * late
    # The least record is the first exact one, or else the last one.
    place = (late.alias("late"), *((sign * F.col(f"at.{k}")).alias(k) for k in ("node", "slot", "match")))
    record = F.struct(*place, "schema", "table", "column", "confidence")
    rows = findings(listed(plans)).select("fingerprint", "error", "position", F.when(F.col("position").isNotNull(), record).alias("r"))
    best = rows.groupBy("fingerprint", "position").agg(F.min("r").alias("r"), F.max("error").alias("error"), F.bool_or(F.col("error").isNull()).alias("ok"))
    param = F.struct("position", "r.schema", "r.table", "r.column", "r.confidence", F.lit("").alias("note"))
    return best.select("fingerprint", "position", F.when(F.col("position").isNotNull(), param).alias("param"), "error", "ok")


def parameters(plans: DataFrame) -> DataFrame:
    """One row a parameter: the first exact finding, or else the last one."""
    return _reduced(plans).where("position is not null").select("fingerprint", "position", "param")


def attribute(clusters: DataFrame, plans: DataFrame, *, top: int = 0) -> DataFrame:
    """Clusters with ``params`` from their plans, and ``outcome``.

    ``outcome``: attributed, skipped (nothing found, params stay), failed (params
    become one note), or null (not looked at: beyond the first ``top`` clusters by
    ``pos``, without fingerprint or canonical text). ``top`` 0 looks at all.
    A cluster without a plan row failed, and one all of whose plan rows did.
    """
    look = (F.col("fingerprint") != "") & (F.col("canonical") != "")
    if top > 0:
        look = look & (F.col("pos") < top)
    found = _reduced(plans).groupBy(F.col("fingerprint").alias("__f")).agg(
        F.array_sort(F.collect_list("param")).cast(f"array<{PARAM.simpleString()}>").alias("__params"), F.when(~F.bool_or("ok"), F.max("error")).alias("__error")
    )
    rows = clusters if "params" in clusters.columns else clusters.withColumn("params", F.array().cast(f"array<{PARAM.simpleString()}>"))
    rows = rows.withColumn("__look", look)
    rows = rows.join(found, rows["fingerprint"] == found["__f"], "left")
    note = F.coalesce(F.col("__error"), F.when(F.col("__f").isNull(), F.lit("EXPLAIN returned no rows")))
    outcome = F.when(F.col("__look"), F.when(note.isNotNull(), "failed").when(F.size("__params") > 0, "attributed").otherwise("skipped"))
    rows = rows.withColumn("outcome", outcome).withColumn("__note", note)
    failure = F.array(F.struct(F.lit(0).alias("position"), *(F.lit("").alias(k) for k in ("schema", "table", "column")), F.lit("none").alias("confidence"), F.col("__note").alias("note"))).cast(f"array<{PARAM.simpleString()}>")
    params = F.when(F.col("outcome") == "attributed", F.col("__params")).when(F.col("outcome") == "failed", failure).otherwise(F.col("params"))
    return rows.withColumn("params", params).drop("__look", "__f", "__params", "__note", "__error")


def explain_scripts(clusters: DataFrame, functions: dict[tuple[str, str, int], list[str] | None]) -> DataFrame:
    """One EXPLAIN script a cluster: fingerprint, sql (with casts), n_params, script."""
    again = clusters.select("fingerprint", F.coalesce(analysis(F.col("canonical"))["canonical"], F.col("canonical")).alias("canonical"))
    cast = again.select("fingerprint", with_casts(F.col("canonical"), functions).alias("sql")).withColumn("n_params", max_param_number(F.col("sql")))
    nulls = F.when(F.col("n_params") > 0, F.concat(F.lit("("), F.array_join(F.array_repeat(F.lit("NULL"), F.col("n_params")), ", "), F.lit(")"))).otherwise("")
    script = F.concat(
        F.lit(f"BEGIN;\nSET LOCAL plan_cache_mode = force_generic_plan;\nPREPARE {_PREPARED} AS "),
        F.col("sql"),
        F.lit(f";\nEXPLAIN (FORMAT JSON) EXECUTE {_PREPARED}"),
        nulls,
        F.lit(f";\nDEALLOCATE {_PREPARED};\nCOMMIT;"),
    )
    return cast.withColumn("script", script)
