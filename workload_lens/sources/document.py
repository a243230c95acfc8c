"""Cluster documents: one JSON object with a schema version and a list of clusters.

Inside Spark clusters are rows; a document exists at the edges only. It is written
cluster by cluster from an ordered iterator, so the driver holds one partition of
clusters at a time.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import CLUSTER, REQUIRED, SCHEMA_VERSION

_ZERO = {T.StringType(): "", T.LongType(): 0, T.IntegerType(): 0, T.DoubleType(): 0.0}
_KINDS = {T.StringType(): str, T.LongType(): int, T.IntegerType(): int, T.DoubleType(): (int, float)}


class DocumentError(ValueError):
    """The document is not valid JSON of the expected form."""


class MissingSchemaVersion(DocumentError):
    pass


class UnsupportedSchemaVersion(DocumentError):
    pass


def _record(value: object, schema: T.StructType, kind: str) -> dict:
    if not isinstance(value, dict):
        raise DocumentError(f"{kind}: an object expected")
    out = {}
    for field in schema:
        x, name = value.get(field.name), f"{kind}.{field.name}"
        if field.name not in value:
            if field.name in REQUIRED[kind]:
                raise DocumentError(f"missing field {name}")
            x = [] if isinstance(field.dataType, T.ArrayType) else _ZERO[field.dataType]
        if isinstance(field.dataType, T.ArrayType):
            if not isinstance(x, list):
                raise DocumentError(f"{name}: a list expected")
            inner = "statement" if field.name == "members" else "param"
            x = [_record(y, field.dataType.elementType, inner) for y in x]
        elif not isinstance(x, _KINDS[field.dataType]) or isinstance(x, bool):
            raise DocumentError(f"{name}: wrong type")
        out[field.name] = float(x) if field.dataType == T.DoubleType() else x
    return out


def parse_document(text: str) -> list[dict]:
    """Clusters of a document. Decoding comes first, then the version; unknown keys are ignored."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise DocumentError(f"not JSON: {e}") from e
    if not isinstance(doc, dict):
        raise DocumentError("an object expected")
    version, clusters = doc.get("schema_version", ""), doc.get("clusters", [])
    if not isinstance(version, str) or not isinstance(clusters, list):
        raise DocumentError("wrong type of schema_version or clusters")
    found = [_record(x, CLUSTER, "cluster") for x in clusters]
    if version == "":
        raise MissingSchemaVersion("the document has no schema_version")
    if version != SCHEMA_VERSION:
        raise UnsupportedSchemaVersion(f"schema_version {version!r} is not supported")
    return found


def clusters_frame(spark: SparkSession, clusters: list[dict]) -> DataFrame:
    """Clusters as rows; ``pos`` is their place in the document."""
    schema = T.StructType([T.StructField("pos", T.LongType()), *CLUSTER.fields])
    return spark.createDataFrame([(i, *(c[f] for f in CLUSTER.names)) for i, c in enumerate(clusters)], schema)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Clusters of the document at ``path`` (any that Spark reads), or of standard input for ``-``."""
    if path == "-":
        return clusters_frame(spark, parse_document(sys.stdin.read()))
    rows = spark.read.text(path, wholetext=True).collect()  # one file, one value
    if len(rows) != 1:
        raise DocumentError(f"one document expected at {path}, found {len(rows)}")
    return clusters_frame(spark, parse_document(rows[0]["value"]))


# -- writing -----------------------------------------------------------------


def _fields(value: Column, schema: T.StructType, kind: str) -> Column:
    """A struct without its zero and empty optional fields (null fields are not written)."""
    out = []
    for field in schema:
        x = value[field.name]
        if isinstance(field.dataType, T.ArrayType):
            x = _items(F.coalesce(x, F.array().cast(field.dataType)), field.dataType.elementType, "statement" if field.name == "members" else "param")
            x = x if field.name in REQUIRED[kind] else F.when(F.size(x) > 0, x)
        elif field.name in REQUIRED[kind]:
            x = F.coalesce(x, F.lit(_ZERO[field.dataType]))
        else:
            x = F.nullif(x, F.lit(_ZERO[field.dataType]))
        out.append(x.alias(field.name))
    return F.struct(*out)


def _items(values: Column, schema: T.StructType, kind: str) -> Column:
    return F.transform(values, lambda x: _fields(x, schema, kind))


def cluster_json(clusters: DataFrame) -> Column:
    """One cluster as JSON, by the omission rules of the format. Missing columns are empty."""
    given = [F.col(f.name) if f.name in clusters.columns else F.lit(None) for f in CLUSTER]
    whole = F.struct(*(x.cast(f.dataType).alias(f.name) for x, f in zip(given, CLUSTER)))
    return F.to_json(_fields(whole, CLUSTER, "cluster"))


def document_chunks(ordered: DataFrame) -> Iterator[str]:
    """The document's text in pieces; the clusters come in the order of ``ordered``."""
    yield f'{{\n  "schema_version": "{SCHEMA_VERSION}",\n  "clusters": ['
    n = 0
    for row in ordered.select(cluster_json(ordered).alias("j")).toLocalIterator():
        body = json.dumps(json.loads(row["j"]), indent=2, ensure_ascii=False).replace("\n", "\n    ")
        yield f"{',' if n else ''}\n    {body}"
        n += 1
    yield ("\n  " if n else "") + "]\n}\n"


def write_document(ordered: DataFrame, to: TextIO) -> None:
    for chunk in document_chunks(ordered):
        to.write(chunk)


