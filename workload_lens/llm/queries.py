"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jpeg, langid, mixing, outliers, packing, probminhash, repair, resample, warc
from .common import fresh_path, read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_repair_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "repair-archive")
    repair.write_archive(read_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return repair.read_archive(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = langid.fit(docs, usable=~held_out)
    found = langid.classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "lang_rejected")


def op3_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "row")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return resample.resample(docs, resample.fit(docs, good)).select("doc_id", "log_weight", "log_ratio", "n_ngrams", "gumbel_key", "kept")


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "n_copies", "shuffle_key")


def op6_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(read_table(spark, sf_dir, "conversations"))


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probminhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"), "n_links")


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.outliers(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source")


def op9_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(read_table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return warc.read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = jpeg.store(read_table(spark, sf_dir, "documents"))
    found = jpeg.describe(stored, with_payload=True)
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumb_hash").alias("feature"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_repair_archive, op2_compression_langid, op3_best_two_fit_packing, op4_importance_resampling, op5_poisson_mixing, op6_snapshot_collapse, op7_probminhash, op8_robust_outliers, op9_splittable_warc, op10_baseline_jpeg)}

ORACLES: dict[str, str] = {"op5_poisson_mixing": mixing.oracle(), "op6_snapshot_collapse": chat.oracle()}
