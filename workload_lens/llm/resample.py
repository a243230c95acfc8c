"""Importance resampling: keep the documents that look like a target corpus.

Two generative models over hashed word unigrams and bigrams, one of the target
(documents labelled good) and one of all raw text, give each document the log
importance ratio ``sum(count * (log p_target - log p_raw))`` over its n-grams
(``log_ratio``). A sum over independent n-grams overstates what a long text shows,
so a text of more than ``full_ngrams`` n-grams is weighed by its ratio to the power
``full_ngrams / n`` (``log_weight``): it is ranked by how it is written, not by its
length. ``full_ngrams=None`` weighs by the plain ratio.
Documents are sampled without replacement in proportion to their weights by
Gumbel top-k: ``log weight + Gumbel noise`` is the key and the ``k`` largest
keys stay. The noise is a hash of the document id, so a rerun samples alike.

The raw model counts every document. The target model may be fit on a bounded
sample of labelled rows (``max_labels``, lowest id hashes first). Both are
arrays of ``buckets`` counts, whatever the corpus holds.

``k`` is the number of documents whose log weight is ``least`` or more, or a given
share of all. The k-th key is found exactly by counting keys in ever finer
ranges; no task or driver sees all keys.

Defined results: null and empty texts have no n-gram and weight 1 (log 0);
repeated rows and null ids share their noise; documents tied with the k-th key
all stay; without a target every weight is 1; an empty table stays empty; a long
text is weighed whole, in segments. Documents keep all their columns; the added
ones are ``ADDED``, and an input column with such a name is replaced unless
``prefix`` sets their names apart.

The weights are computed twice, once for the k-th key and once for the result:
writing all texts again would cost more than reading them again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, buffers, hash_unit, materialize, mix64, spare, text_batches

BUCKETS = 10_000
ADDED = ("log_weight", "log_ratio", "n_ngrams", "gumbel_key", "kept")


def ngram_buckets(hashes: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of the unigrams and bigrams of texts laid end to end."""
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    inside = text[1:] == text[:-1]
    pair = mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[inside]
    grams = np.concatenate((hashes, pair)) % np.uint64(buckets)
    return grams.astype(np.int64), np.concatenate((text, text[1:][inside]))


def lowered(column):
    """Lower-cased texts; the columns are Arrow strings."""
    return pa.array([x.lower() if x else None for x in column.to_pylist()], pa.string())


def fit(docs: DataFrame, good: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_labels: int = 20_000, smoothing: float = 20.0) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket.

    ``good`` has an ``id`` column: the documents of the target. At most
    ``max_labels`` of them are used; that bound makes their broadcast safe.
    """
    target = good.select("id").where("id is not null").distinct().orderBy(F.xxhash64(F.col("id").cast("string"))).limit(max_labels).withColumn("target", F.lit(True))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(target), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches):
        hasher, raw, hit = WordHasher(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in text_batches(batches, "text"):
            hashes, ends = hasher(*buffers(lowered(batch.column(0))))
            grams, text = ngram_buckets(hashes, ends, buckets)
            raw += np.bincount(grams, minlength=buckets)
            good_text = batch.column(1).to_numpy(zero_copy_only=False)
            if good_text.any():
                hit += np.bincount(grams[good_text[text]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(hit[at])], names=["bucket", "n_raw", "n_target"])

    counts = rows.mapInArrow(count, "bucket long, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))
    raw, hit = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():  # one row a bucket
        raw[r["bucket"]], hit[r["bucket"]] = r["n_raw"], r["n_target"]
    if not hit.any():
        return np.zeros(buckets)
    # The raw model as the target's prior: a bucket the target never saw needs evidence.
    p_raw = (raw + smoothing / 16) / (raw + smoothing / 16).sum()
    p_target = (hit + smoothing * buckets * p_raw) / (hit.sum() + smoothing * buckets)
    return np.log(p_target) - np.log(p_raw)


def log_weight(ratio: np.ndarray, text: Column, full_ngrams: int | None = 64) -> Column:
    """Struct of the log importance weight, the plain log ratio and the number of n-grams of a text."""
    buckets, names = len(ratio), ["log_weight", "log_ratio", "n_ngrams"]
    fixed_ratio = np.round(ratio * (1 << 20)).astype(np.int64)  # fixed-point sums: the same whatever else is in the batch

    @F.arrow_udf("log_weight double, log_ratio double, n_ngrams long")
    def weigh(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for column in texts:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            out = []
            for part in text_batches([batch], "text"):
                grams, number = ngram_buckets(*hasher(*buffers(lowered(part.column(0)))), buckets)
                fixed = np.zeros(part.num_rows, np.int64)
                np.add.at(fixed, number, fixed_ratio[grams])
                n = np.bincount(number, minlength=part.num_rows)
                log_ratio = fixed / (1 << 20)
                weight = log_ratio if full_ngrams is None else log_ratio * (full_ngrams / np.maximum(n, full_ngrams))
                out.append(pa.StructArray.from_arrays([pa.array(weight), pa.array(log_ratio), pa.array(n)], names=names))
            yield pa.concat_arrays(out) if out else pa.StructArray.from_arrays([pa.array([], t) for t in (pa.float64(), pa.float64(), pa.int64())], names=names)

    return weigh(text.cast("string"))


def _sortable(key: Column) -> Column:
    """A key's place among all keys, as a whole number of 1/2^20 steps."""
    return F.round(key * F.lit(float(1 << 20))).cast("long")


def kth_largest(values: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a long column, exactly, by counting ranges.

    Each pass counts at most 4,096 ranges of what the passes before left over.
    """
    if k <= 0:
        return None
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return None
    while lo < hi:
        width = -(-(hi - lo + 1) // 4096)
        part = F.floor((F.col(column) - F.lit(lo)) / F.lit(width)) if width > 1 else F.col(column) - F.lit(lo)
        counts = values.where(F.col(column).between(lo, hi)).groupBy(part.cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r["part"]):
            if k <= r["n"]:
                lo, hi = lo + r["part"] * width, min(hi, lo + (r["part"] + 1) * width - 1)
                break
            k -= r["n"]
        else:
            return lo  # fewer than k values: all stay
    return lo


def resample(docs: DataFrame, ratio: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", least: float = -3.0, share: float | None = None, full_ngrams: int | None = 64, seed: int = 4, prefix: str = "") -> DataFrame:
    """``docs`` with the columns ``ADDED``, named with ``prefix``; ``kept`` is boolean."""
    held, key, keep = spare(docs, "weight"), prefix + ADDED[3], prefix + ADDED[4]
    noise = -F.log(-F.log(hash_unit(F.col(id_col).cast("string"), seed=seed)))
    weight = F.col(f"{held}.log_weight")
    out = docs.withColumn(held, log_weight(ratio, F.col(text_col), full_ngrams)).withColumn(f"{held}k", _sortable(weight + noise))
    keys = materialize(out.select(weight.alias("w"), F.col(f"{held}k").alias("k")), "gumbel-keys")
    n, fit_well = keys.agg(F.count(F.lit(1)), F.count(F.when(F.col("w") >= least, 1))).first()
    k = fit_well if share is None else round(share * n)
    lowest = kth_largest(keys, "k", k)
    kept = F.lit(False) if lowest is None else F.col(f"{held}k") >= F.lit(lowest)
    found = {prefix + x: F.col(f"{held}.{x}") for x in ADDED[:3]} | {key: F.col(f"{held}k"), keep: kept}
    return out.withColumns(found).drop(held, f"{held}k")
