"""Command line: ``python -m workload_lens COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__
from .sqltext import SqlError, fingerprint, normalize


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("workload_lens").getOrCreate()


def _sql(args) -> str:
    return (sys.stdin.read() if args.sql in (None, "-") else args.sql).strip()


def _capture(args) -> None:
    from pyspark.sql import functions as F

    from .operators.capture import capture
    from .operators.cluster import analyzed, clusters, ranked
    from .sources import read_statements, write_document

    spark = session()
    databases = spark.read.format(args.format).load(args.databases) if args.databases else None
    if args.database and databases is None:
        raise SystemExit("--database needs --databases")
    rows = capture(read_statements(spark, args.snapshot, args.format), databases, database=args.database or "", min_calls=args.min_calls, limit=args.limit)
    found = clusters(analyzed(rows), members=True).persist()
    counts = found.agg(F.coalesce(F.sum("n_members"), F.lit(0)), F.count(F.lit(1))).first()
    print(f"captured {counts[0]} queries → {counts[1]} clusters", file=sys.stderr)
    write_document(ranked(found), sys.stdout)


def _attribute(args) -> None:
    from pyspark.sql import functions as F

    from .operators.attribute import attribute
    from .sources import read_document, write_document

    spark = session()
    rows = read_document(spark, args.in_)
    plans = spark.read.schema("fingerprint string, plan_json string, error string").format(args.format).load(args.plans)
    found = attribute(rows, plans, top=args.top).persist()
    done = {r["outcome"]: r["n"] for r in found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    print(f"attributed {done.get('attributed', 0)} clusters, {done.get('skipped', 0) + done.get('failed', 0)} skipped", file=sys.stderr)
    write_document(found.orderBy("pos"), sys.stdout)


def _scripts(args) -> None:
    from .operators.attribute import explain_scripts
    from .operators.catalog import argument_types, lookup, overloads
    from .sources import read_document

    spark = session()
    rows = read_document(spark, args.in_).where("fingerprint <> '' and canonical <> ''")
    rows = rows.where(f"pos < {args.top}") if args.top > 0 else rows
    functions = {}
    if args.catalog:
        functions = lookup(overloads(argument_types(*(spark.read.parquet(f"{args.catalog}/{t}.parquet") for t in ("pg_proc", "pg_namespace", "pg_type")))))
    for r in explain_scripts(rows, functions).toLocalIterator():
        print(json.dumps({"fingerprint": r["fingerprint"], "script": r["script"]}, ensure_ascii=False))


def _stub(args) -> None:
    from .operators.stubs import stubs, write_stubs
    from .sources import read_document

    n = write_stubs(stubs(read_document(session(), args.in_), top=args.top, min_calls=args.min_calls), args.out)
    print(f"wrote {n} stubs to {args.out}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="workload_lens", description="Database workload analytics")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    for name in ("fingerprint", "normalize"):
        c = commands.add_parser(name, help=f"{name} one SQL text")
        c.add_argument("sql", nargs="?", help="the text; - or nothing reads standard input")
    c = commands.add_parser("capture", help="cluster a snapshot of statement statistics")
    c.add_argument("snapshot", help="path of the snapshot table")
    c.add_argument("--format", default="parquet")
    c.add_argument("--min-calls", type=int, default=0, help="leave out queries with this many calls or fewer")
    c.add_argument("--limit", type=int, default=0, help="only the first by total time (0: all)")
    c.add_argument("--database", help="only this database")
    c.add_argument("--databases", help="path of the databases table (oid, datname)")
    c = commands.add_parser("explain-scripts", help="EXPLAIN scripts of clusters, as JSON lines")
    c.add_argument("--in", dest="in_", default="-")
    c.add_argument("--top", type=int, default=0)
    c.add_argument("--catalog", help="folder with pg_proc, pg_namespace and pg_type as Parquet")
    c = commands.add_parser("attribute", help="map $N to columns by query plans")
    c.add_argument("--in", dest="in_", default="-")
    c.add_argument("--plans", required=True, help="table of fingerprint, plan_json, error")
    c.add_argument("--format", default="json")
    c.add_argument("--top", type=int, default=0, help="only the first clusters (0: all)")
    c = commands.add_parser("stub", help="write SQL stubs of the first clusters")
    c.add_argument("--in", dest="in_", default="-")
    c.add_argument("--out", default="sql-stubs")
    c.add_argument("--top", type=int, default=10)
    c.add_argument("--min-calls", type=int, default=0)
    args = parser.parse_args(argv)
    try:
        if args.command == "version":
            print(__version__)
        elif args.command in ("fingerprint", "normalize"):
            print({"fingerprint": fingerprint, "normalize": normalize}[args.command](_sql(args)))
        else:
            {"capture": _capture, "attribute": _attribute, "explain-scripts": _scripts, "stub": _stub}[args.command](args)
    except (SqlError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
