"""Cluster documents and the command line."""

import io
import json

import pytest

from workload_lens import __version__, cli
from workload_lens.operators import cluster
from workload_lens.sources import MissingSchemaVersion, UnsupportedSchemaVersion, read_document, write_document
from workload_lens.sources.document import DocumentError, parse_document
from workload_lens.sources.statements import read_statements

from .test_operators import SNAPSHOT, rows

CLUSTER = {"fingerprint": "sha1:1", "canonical": "SELECT 1", "members": [{"raw": "SELECT 1"}], "total_calls": 0}


def document(*clusters, version="1", **more):
    return json.dumps({"schema_version": version, "clusters": list(clusters)} | more)


def test_parse():
    found = parse_document(document(CLUSTER | {"extra": 1, "params": [{"position": 1, "confidence": "exact"}]}, more=2))
    assert found[0]["params"][0]["note"] == "" and found[0]["members"][0]["calls"] == 0 and found[0]["rows"] == 0
    assert parse_document(document()) == []


@pytest.mark.parametrize("text", ["", "[]", "{", document({"fingerprint": "x"}), document(CLUSTER | {"total_calls": "1"}), document(CLUSTER | {"members": [{}]}), document(CLUSTER | {"params": [{"position": 1}]}), document(CLUSTER | {"members": None})])
def test_malformed(text):
    with pytest.raises(DocumentError):
        parse_document(text)


def test_versions():
    for text in ("{}", document(version="")):
        with pytest.raises(MissingSchemaVersion):
            parse_document(text)
    with pytest.raises(UnsupportedSchemaVersion):
        parse_document(document(version="2"))
    with pytest.raises(DocumentError, match="missing field"):  # decoding comes first
        parse_document(document({}, version="2"))


def test_roundtrip(spark, tmp_path):
    found = cluster.ranked(cluster.clusters(cluster.analyzed(rows(spark, ("SELECT 'ä'", 1, 2.5, 3), ("SELECT 2", 0), ("SELEC", 0))), members=True))
    out = io.StringIO()
    write_document(found, out)
    doc = json.loads(out.getvalue())
    assert out.getvalue().endswith("}\n") and "'ä'" in out.getvalue()
    first, bad = doc["clusters"]
    assert list(first) == ["fingerprint", "canonical", "members", "total_calls", "total_exec_time_ms", "mean_exec_time_ms", "rows"]
    assert list(first["members"][1]) == ["raw", "queryid", "mean_exec_time_ms", "stddev_exec_time_ms"]
    assert bad["fingerprint"] == "" and bad["total_calls"] == 0 and "rows" not in bad
    (tmp_path / "doc.json").write_text(out.getvalue())
    again = read_document(spark, str(tmp_path / "doc.json"))
    second = io.StringIO()
    write_document(again.orderBy("pos"), second)
    assert second.getvalue() == out.getvalue()
    assert [r["pos"] for r in again.orderBy("pos").collect()] == [0, 1]


def test_write_empty(spark, tmp_path):
    out = io.StringIO()
    write_document(cluster.clusters(cluster.analyzed(rows(spark)), members=True), out)
    assert json.loads(out.getvalue()) == {"schema_version": "1", "clusters": []}


def test_cli(spark, tmp_path, capsys, monkeypatch):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == __version__
    assert cli.main(["normalize", " SELECT u.id FROM users u\n"]) == 0 and capsys.readouterr().out == "SELECT id FROM users\n"
    monkeypatch.setattr("sys.stdin", io.StringIO("SELECT 1\n"))
    assert cli.main(["fingerprint", "-"]) == 0 and capsys.readouterr().out.startswith("sha1:")
    assert cli.main(["fingerprint", "SELECT FROM WHERE"]) == 1
    assert "error" in capsys.readouterr().err

    snapshot, databases = str(tmp_path / "snapshot"), str(tmp_path / "databases")
    spark.createDataFrame([(1, 1, 5, "SELECT id FROM t WHERE id = $1", 10.0, 2.0, 0.0, 1), (2, 2, 5, "SELECT x.id FROM t x WHERE x.id = $1", 1.0, 1.0, 0.0, 1)], SNAPSHOT).write.parquet(snapshot)
    spark.createDataFrame([(1, "one")], "oid long, datname string").write.parquet(databases)
    assert set(read_statements(spark, snapshot).columns) == {"queryid", "dbid", "calls", "query", "total_exec_time", "mean_exec_time", "stddev_exec_time", "rows"}
    capsys.readouterr()
    assert cli.main(["capture", snapshot]) == 0
    out, err = capsys.readouterr()
    assert "captured 2 queries → 1 clusters" in err
    doc = json.loads(out)
    assert len(doc["clusters"]) == 1 and doc["clusters"][0]["total_calls"] == 10
    (tmp_path / "doc.json").write_text(out)
    assert cli.main(["capture", snapshot, "--database", "one", "--databases", databases]) == 0
    assert "captured 1 queries" in capsys.readouterr().err

    assert cli.main(["explain-scripts", "--in", str(tmp_path / "doc.json")]) == 0
    script = json.loads(capsys.readouterr().out.splitlines()[-1])
    plan = json.dumps([{"Plan": {"Relation Name": "t", "Filter": "(id = $1)"}}])
    (tmp_path / "plans.json").write_text(json.dumps({"fingerprint": script["fingerprint"], "plan_json": plan}))
    assert cli.main(["attribute", "--in", str(tmp_path / "doc.json"), "--plans", str(tmp_path / "plans.json")]) == 0
    out, err = capsys.readouterr()
    assert "attributed 1 clusters, 0 skipped" in err and json.loads(out)["clusters"][0]["params"][0]["table"] == "t"
    assert cli.main(["stub", "--in", str(tmp_path / "doc.json"), "--out", str(tmp_path / "stubs")]) == 0
    assert "wrote 1 stubs" in capsys.readouterr().err
    assert len(list((tmp_path / "stubs" / "sql").iterdir())) == 1
    (tmp_path / "doc.json").write_text("{}")
    assert cli.main(["stub", "--in", str(tmp_path / "doc.json")]) == 1
