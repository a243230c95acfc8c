"""Helpers shared by the training-data operators.

Intermediate results that are read more than once go to Parquet tables below
``spark.checkpoint.dir`` (the folder all executors share); lost executors then
cost a re-read, never a recomputation of the whole lineage. Results may read such
tables, so they stay until ``clean`` is called, or the folder's owner removes the
application's folder.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Without one, a local session gets a temporary folder; a cluster is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="workload_lens-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/workload_lens/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them fail."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Arrow batches of about ``limit`` bytes at most, unless the session has a smaller bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > limit:
        spark.conf.set(key, str(limit))


def spare(df: DataFrame, name: str) -> str:
    """``__name``, with underscores added until no column of ``df`` begins so."""
    taken = [c.lower() for c in df.columns]
    out = f"__{name}"
    while any(c.startswith(out.lower()) for c in taken):
        out += "_"
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_unit(*cols: Column, seed: int) -> Column:
    """A number in (0, 1), the same wherever and whenever it is computed."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


# -- vectorised word hashing -------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 buffers.

    Buffers are hashed in segments of about ``segment`` bytes, cut after white space,
    so what a long text needs besides its word hashes is bounded. Only a longer word
    makes a longer segment.
    """

    def __init__(self, segment: int = 1 << 18) -> None:
        self.segment = segment
        self._pow, self._inv = _powers(_BASE, segment + 1), _powers(_INV, segment + 1)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, words before each text's end) of texts laid end to end.

        ``data`` holds the bytes of all texts, ``ends`` where each text ends.
        """
        hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        i, n = 0, len(data)
        while i < n:
            j = self._cut(data, i)
            inner = ends[np.searchsorted(ends, i, side="right") : np.searchsorted(ends, j)] - i
            h, at = self._segment(data[i:j], inner)
            hashes.append(h)
            starts.append(at + i)
            i = j
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)

    def _cut(self, data: np.ndarray, i: int) -> int:
        """The end of the segment that starts at ``i``."""
        j = i + self.segment
        if j >= len(data):
            return len(data)
        space = np.flatnonzero(_SPACE[data[i:j]])
        if len(space):
            return i + int(space[-1]) + 1
        while j < len(data):
            space = np.flatnonzero(_SPACE[data[j : j + self.segment]])
            if len(space):
                return j + int(space[0]) + 1
            j += self.segment
        return len(data)

    def _segment(self, data: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, where they start); texts also end at ``inner``, and end words there."""
        n = len(data)
        power, inverse = (self._pow, self._inv) if n < len(self._pow) else (_powers(_BASE, n + 1), _powers(_INV, n + 1))
        word = ~_SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64, out=sums[1:])
        h = (sums[stops] - sums[starts]) * inverse[starts]
        return mix64(h ^ (stops - starts).astype(np.uint64)), starts


def text_batches(batches, text: str, limit: int = 1 << 20):
    """Slices of record batches whose texts hold about ``limit`` bytes at most.

    A single longer text is a slice of its own, whole.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        sizes = pc.fill_null(pc.binary_length(table[text]), 0).to_numpy()
        total, at = np.cumsum(sizes), 0
        while at < len(sizes):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each text) of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at[1:] - at[0]
