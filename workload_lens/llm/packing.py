"""Best-two-fit packing of documents into token sequences.

Lengths are whole numbers up to the capacity, so the histogram of lengths is all
the packer has to see: ``plan`` packs the histogram on the driver (its size is
bounded by the capacity, never by the corpus) and says which sequence the k-th
piece of each length goes to. A piece's rank within its length is its rank in its
shard, plus what earlier shards have of the length. A shard's ``capacity + 1`` such
sums are one row, so ids are not shuffled, and no task ever holds all pieces of a
common length.

A bin is filled greedily, longest piece that fits first. If a gap is left, the
bin's smallest piece is put back and two unpacked pieces whose lengths fill the
expanded gap better take its place. As many equal bins as the counts allow are
closed at once.

Defined results: null and empty texts are a single end id; repeated rows are all
packed, and told apart by ``row``, a number of each input row; an empty table gives
no pieces; null ids are kept. Other columns are ignored. Longer documents are
encoded whole, and cut so that the first piece takes the remainder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_batches

PIECES = "shard int, rank long, row long, doc_id long, piece int, start long, length long, ids binary"


def _fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The next bin: {length: pieces}, by greedy fill and best-two-fit."""
    have = np.flatnonzero(counts)
    use: dict[int, int] = {}
    gap = capacity
    at = np.searchsorted(have, gap, side="right") - 1
    while at >= 0:
        length = int(have[at])
        n = min(int(counts[length]), gap // length)
        use[length] = n
        gap -= n * length
        at = min(at - 1, np.searchsorted(have, gap, side="right") - 1)
    if gap == 0 or sum(use.values()) < 2:
        return use
    small = min(use)
    room = gap + small
    left = counts[: room + 1].copy()
    for length, n in use.items():
        if length <= room:
            left[length] -= n
    usable = left > 0
    largest = np.maximum.accumulate(np.where(usable, np.arange(room + 1), 0))  # largest usable length up to here
    a = np.flatnonzero(usable[: room // 2 + 1])
    b = largest[room - a]
    twice = (b == a) & (left[a] < 2)
    b = np.where(twice, 0, b)
    ok = b >= a
    if not ok.any():
        return use
    a, b = a[ok], b[ok]
    best = int(np.argmax(a + b))
    if a[best] + b[best] > small:
        use[small] -= 1
        if not use[small]:
            del use[small]
        for x in (int(a[best]), int(b[best])):
            use[x] = use.get(x, 0) + 1
    return use


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(slots, sequences): slots are rows (length, first rank, pieces a sequence, first sequence, offset)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    rank = np.zeros(capacity + 1, dtype=np.int64)
    slots, sequence = [], 0
    while counts.any():
        use = _fill(counts, capacity)
        times = min(int(counts[length]) // n for length, n in use.items())
        offset = 0
        for length in sorted(use, reverse=True):
            n = use[length]
            slots.append((length, int(rank[length]), n, sequence, offset))
            rank[length] += n * times
            counts[length] -= n * times
            offset += n * length
        sequence += times
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 5), sequence


def place(slots: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and ranks."""
    key = (slots[:, 0].astype(np.uint64) << np.uint64(48)) | slots[:, 1].astype(np.uint64)
    wanted = (length.astype(np.uint64) << np.uint64(48)) | rank.astype(np.uint64)
    row = slots[np.searchsorted(key, wanted, side="right") - 1]
    step = rank - row[:, 1]
    return row[:, 3] + step // row[:, 2], row[:, 4] + step % row[:, 2] * length


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encoded pieces of at most ``capacity`` ids, ranked by length within each shard."""

    def cut(batches):
        from pyspark import TaskContext

        from .tokens import encoder

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        seen: dict[int, int] = {}
        row = shard << 40  # shards hold fewer rows than that
        for batch in text_batches(batches, "text"):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = enc.encode(text) + end
                total = len(raw) // 4
                start, piece, row = 0, 0, row + 1
                while start < total:
                    n = capacity if piece or total <= capacity else total % capacity or capacity
                    n = min(n, total - start)
                    rank = seen.get(n, 0)
                    seen[n] = rank + 1
                    rows.append((shard, rank, row, i, piece, start, n, raw[4 * start : 4 * (start + n)]))
                    start, piece = start + n, piece + 1
            cols = zip(*rows)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["shard", "rank", "row", "doc_id", "piece", "start", "length", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, broadcast_shards: int = 2048, **options) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids, sequence_id, offset, row.

    The encoded pieces are written once. Each shard's row of sums is broadcast if
    there are at most ``broadcast_shards``, or else joined by shard; a shard is one
    split of the input, so none is larger than the others.
    """
    table = materialize(pieces(docs, tokenizer, capacity=capacity, **options), "pieces")
    counts = materialize(table.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("shard", F.struct("length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n")).alias("sum"))
    base = materialize(sums.groupBy("shard").agg(F.map_from_entries(F.collect_list("sum")).alias("sums")), "piece-sums")
    few = base.limit(broadcast_shards + 1).count() <= broadcast_shards

    @F.arrow_udf("sequence_id long, offset long")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = place(slots, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, rank)))
        return pa.StructArray.from_arrays([pa.array(x) for x in found], names=["sequence_id", "offset"])

    joined = table.join(F.broadcast(base) if few else base, "shard")
    at = joined.withColumn("at", placed("length", F.col("sums")[F.col("length")] + F.col("rank")))
    return at.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset", "row")
