"""Stubs are taken from all clusters that qualify."""

from workload_lens.plans import queries


def test_stubs_beyond_the_first_places(spark, monkeypatch):
    rows = [("" if i < 55 else f"sha1:{i:016x}", "SELECT 1", 20, 1000.0 - i, 1, i) for i in range(70)]
    found = spark.createDataFrame(rows, "fingerprint string, canonical string, total_calls long, total_exec_time_ms double, n_members long, first_ord long")
    monkeypatch.setattr(queries, "_clusters", lambda *a, **b: found)
    got = queries.stub_files(spark, "").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11)) and all(f"sha1:{i:016x}" in r["content"] for i, r in zip(range(55, 65), got))
