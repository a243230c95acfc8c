"""From raw documents to packed training sequences, in five stages.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.

Every stage keeps the columns it is given, whatever their names, and the rows'
values; what it adds for itself has a name that none of them begins with. Null
texts have no language and go in the first stage, as do texts without a letter; an
empty table stays empty through all stages; repeated rows share a decision until
near_dedup, which keeps one row of a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload_lens.llm import langid, mixing, packing, probminhash, resample
from workload_lens.llm.common import materialize, read_table, spare
from workload_lens.llm.queries import tokenizer_path

#: The last stages depend on compression, models and sketches that SQL can't express.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a clear language."""
    own = spare(docs, "langid")
    found = langid.classify(docs, langid.fit(docs), prefix=own)
    return found.where(~F.col(f"{own}lang_rejected")).select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the sample that looks like the documents labelled good."""
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    own = spare(docs, "resample")
    return resample.resample(docs, resample.fit(docs, good), prefix=own).where(F.col(f"{own}kept")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, that with the smallest id."""
    return probminhash.keep_one(docs).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to weights between the sources' own sizes and equal ones."""
    return mixing.mix(docs, prefix=spare(docs, "mixing")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens; ``row`` tells repeated documents apart."""
    placed = packing.pack(docs, tokenizer_path(), capacity=2048)
    return placed.select("sequence_id", "offset", "doc_id", "row", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
