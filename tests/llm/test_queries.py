"""The registered queries: SQL where there is some, shapes of results, the pipeline."""

import pytest
from pyspark.sql import functions as F

from compare_oracle import connect, difference
from workload_lens.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op10": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    kinds = dict(found.dtypes)
    assert COLUMNS.get(name.split("_")[0], {}).items() <= kinds.items()
    if name in ORACLES:
        assert difference(found, connect(sf_dir), ORACLES[name]) == ""
    elif not name.startswith(("op3", "op9", "op5")):
        assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), f"t-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] > 0 and sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    want = docs.groupBy("doc_id").count().agg(F.sum("count")).first()[0]
    assert packed.where("piece = 0").count() == want
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
