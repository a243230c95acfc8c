"""Token archives compressed with Re-Pair grammars.

Every block of an archive is one grammar: frequent pairs of ids are replaced by
nonterminals, round after round, until no pair is frequent. A block is
``block_tokens`` ids of a shard, or one longer document, so that neither a worker
nor a reader of slices needs a whole shard in memory. It stores its rules, the
expansion length of each rule and, per document, its symbols; a slice of a
document is decoded from the symbols that cover it alone.

A round replaces many pairs at once. Pairs are taken by descending count as long
as no id is the left part of one and the right part of another, so occurrences
of the chosen pairs never overlap; a pair of equal ids is replaced from left to
right. No pair crosses the end of a document.

Defined results: null and empty texts are a single end id; a null document id
comes first; rows with equal ids are all kept, by a hash of their texts, and may
spread over shards, as null ids may; a long text is one document of its block,
whole; an empty table gives an archive without blocks. Other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches

_MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIIQ")

ARCHIVE = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("first_token", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_rules", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs as whole numbers; narrow ones while all ids are below 2^16."""
    if left.dtype == np.uint16:
        return (left.astype(np.uint32) << np.uint32(16)) | right
    return (left.astype(np.uint64) << np.uint64(32)) | right


def _parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right ids of pairs."""
    bits, low = (16, 0xFFFF) if key.dtype == np.uint32 else (32, 0xFFFFFFFF)
    return (key >> key.dtype.type(bits)).astype(np.int64), (key & key.dtype.type(low)).astype(np.int64)


def _frequent(key: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs found ``min_count`` times or more, and how often; sorts ``key``."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    key.sort()
    edge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    count = np.diff(np.append(edge, len(key)))
    often = count >= min_count
    return key[edge[often]], count[often]


def _choose(key: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Which pairs a round takes: by descending count, never overlapping, as a mask."""
    chosen, n = [], 0
    order = np.lexsort((key, -count))
    a, b = _parts(key[order])
    part = bytearray(int(max(a.max(), b.max())) + 1)  # of an id that is taken: 1 left, 2 right, 3 both
    for i, x, y in zip(order.tolist(), a.tolist(), b.tolist()):
        if part[x] > 1 or part[y] & 1 or (x == y and part[x]):
            continue
        part[x] |= 1
        part[y] |= 2
        chosen.append(i)
        n += 1
        if n == most:
            break
    out = np.zeros(len(key), dtype=bool)
    out[chosen] = True
    return out


def _slots(key: np.ndarray, bits: int = 18) -> np.ndarray:
    """Multiplicative hash of pairs."""
    if key.dtype == np.uint32:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _occurrences(seq: np.ndarray, last: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number of the pair) of all occurrences of ``pairs`` within documents.

    Pairs are found in a small hash table; those that share a slot are searched for.
    """
    key, own = _keys(seq[:-1], seq[1:]), _slots(pairs)
    number, shared = np.arange(1, len(pairs) + 1), 0xFFFF
    table = np.zeros(1 << 18, np.uint16)
    table[own] = number
    table[own[table[own] != number]] = shared
    found = table.take(_slots(key))
    at = np.flatnonzero((found > 0) & ~last[:-1])
    key, new = key.take(at), found.take(at).astype(np.int64) - 1
    order = np.flatnonzero(table[own] == shared)
    order = order[np.argsort(pairs[order])]
    if len(order):
        odd = new == shared - 1
        new[odd] = order[np.minimum(np.searchsorted(pairs[order], key[odd]), len(order) - 1)]
    hit = np.flatnonzero(pairs.take(new) == key)
    return at.take(hit), new.take(hit)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, *, min_count: int = 12, round_pairs: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, end of each document in the symbols) of ids below ``base``.

    Nonterminal ``base + i`` stands for the pair ``rules[i]``. All pairs are counted
    once. Later only those with a nonterminal of the last round can have become
    frequent, so only they are counted anew; of a pair that waited, the occurrences
    are counted when it is taken. ``round_pairs`` bounds the work of one round, not
    their number: rounds go on until no pair is found ``min_count`` times.
    """
    if not 1 <= round_pairs < 0xFFFF:
        raise ValueError("round_pairs must be between 1 and 65,534")
    seq = ids.astype(np.uint16 if base <= 1 << 16 else np.uint32)
    last = np.zeros(len(seq), dtype=bool)
    last[ends - 1] = True
    rules, size = [np.zeros((0, 2), dtype=np.uint32)], base
    key, count = _frequent(_keys(seq[:-1], seq[1:])[~last[:-1]], min_count)
    while len(key):
        if seq.dtype == np.uint16 and size + min(round_pairs, len(key)) > 1 << 16:
            seq, key = seq.astype(np.uint32), _keys(*(x.astype(np.uint32) for x in _parts(key)))
        chosen = _choose(key, count, round_pairs)
        at, new = _occurrences(seq, last, key[chosen])
        a, b = _parts(key[chosen])
        key, count = key[~chosen], count[~chosen]
        still = np.bincount(new, minlength=len(a)) >= min_count
        hit = still[new]
        at, new, a, b = at[hit], (np.cumsum(still) - 1)[new[hit]], a[still], b[still]
        if not len(at):
            continue
        # runs of one id: every other position from the run's start
        run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
        begin = np.repeat(at[run], np.diff(np.append(run, len(at))))
        even = (at - begin) % 2 == 0
        at, new = at[even], new[even]
        seq[at] = size + new
        last[at] = last[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack((a, b), axis=1).astype(np.uint32))
        fresh = seq >= size
        size += len(a)
        at = np.flatnonzero((fresh[:-1] | fresh[1:]) & ~last[:-1])
        more = _frequent(_keys(seq[at], seq[at + 1]), min_count)
        key, count = np.concatenate((key, more[0])), np.concatenate((count, more[1]))
    return np.concatenate(rules), seq.astype(np.uint32), np.flatnonzero(last) + 1


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    lens: list[int] = []
    for a, b in rules.tolist():
        lens.append((lens[a - base] if a >= base else 1) + (lens[b - base] if b >= base else 1))
    return np.array(lens, dtype=np.int64)


def pack_block(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, base: int, **options) -> tuple[bytes, int, int]:
    """(payload, rules, symbols) of one block."""
    rules, symbols, cuts = compress(ids, ends, base, **options)
    wide = base + len(rules) > 0xFFFF
    head = _HEAD.pack(_MAGIC, base, len(doc_ids), len(rules), int(wide), len(symbols))
    nulls = np.array([x is None for x in doc_ids], dtype=np.uint8)
    parts = [
        head,
        np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(),
        nulls.tobytes(),
        cuts.astype("<i8").tobytes(),
        ends.astype("<i8").tobytes(),
        rules.astype("<u4").tobytes(),
        _lengths(rules, base).astype("<i8").tobytes(),
        symbols.astype("<u4" if wide else "<u2").tobytes(),
    ]
    return b"".join(parts), len(rules), len(symbols)


class Block:
    """A packed block: its documents, whole or in slices."""

    def __init__(self, payload: bytes) -> None:
        magic, self.base, n, r, wide, m = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a token block")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        doc_ids, nulls = take("<i8", n).tolist(), take("u1", n)
        self.doc_ids = [None if x else i for i, x in zip(doc_ids, nulls)]
        self.cuts, self.ends = take("<i8", n), take("<i8", n)
        self.rules, self.lens = take("<u4", 2 * r).reshape(-1, 2), take("<i8", r)
        self.symbols = take("<u4" if wide else "<u2", m)

    def _length_of(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), dtype=np.int64)
        rule = np.flatnonzero(symbols >= self.base)
        out[rule] = self.lens.take(symbols.take(rule).astype(np.int64) - self.base)
        return out

    def _expand(self, symbol: int) -> list[int]:
        out, stack = [], [symbol]
        while stack:
            x = stack.pop()
            if x < self.base:
                out.append(x)
            else:
                a, b = self.rules[x - self.base].tolist()
                stack += [b, a]
        return out

    def ids(self) -> np.ndarray:
        """The ids of all documents, end to end."""
        # expansions of rules as bytes: joining them is cheaper than joining arrays
        done: list[bytes] = []
        for a, b in self.rules.tolist():
            done.append((done[a - self.base] if a >= self.base else a.to_bytes(4, "little")) + (done[b - self.base] if b >= self.base else b.to_bytes(4, "little")))
        table = np.concatenate((np.arange(self.base, dtype="<u4"), np.frombuffer(b"".join(done), dtype="<u4")))
        begin = np.concatenate((np.arange(self.base), self.base + np.cumsum(self.lens) - self.lens))
        lens = self._length_of(self.symbols)
        to = np.cumsum(lens)
        total, kind = int(to[-1]), np.int32 if max(int(to[-1]), len(table)) < 1 << 31 else np.int64
        shift = (begin.take(self.symbols) - (to - lens)).astype(kind)
        return table.take(np.repeat(shift, lens) + np.arange(total, dtype=kind))

    def slice(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop`` of the block's ``doc``-th document, decoded alone."""
        symbols = self.symbols[self.cuts[doc - 1] if doc else 0 : self.cuts[doc]]
        to = np.cumsum(self._length_of(symbols))
        total = int(to[-1]) if len(to) else 0
        start, stop = max(0, start), min(stop, total)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        i, j = np.searchsorted(to, start, side="right"), np.searchsorted(to, stop, side="left")
        ids = [x for s in symbols[i : j + 1].tolist() for x in self._expand(s)]
        skip = start - (int(to[i - 1]) if i else 0)
        return np.array(ids[skip : skip + stop - start], dtype=np.uint32)


def archive_blocks(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_tokens: int = 1 << 20, chunk_memory: int = 1_600_000, **options) -> DataFrame:
    """Blocks of ``docs`` in ascending id order; shards are ranges of ids, and of hashes of texts where ids are equal."""

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        enc, shard, block, first = encoder(tokenizer, chunk_memory), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        base = max(enc.vocab_size, end_id + 1)
        doc_ids, parts, size = [], [], 0

        def flush():
            nonlocal block, first, doc_ids, parts, size
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            ends = np.cumsum([len(x) // 4 for x in parts], dtype=np.int64)
            payload, rules, symbols = pack_block(doc_ids, ids, ends, base, **options)
            row = [shard, block, first, len(doc_ids), len(ids), rules, symbols, doc_ids, payload]
            block, first, doc_ids, parts, size = block + 1, first + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], names=ARCHIVE.names)

        for batch in text_batches(batches, "text"):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                doc_ids.append(i)
                parts.append(ids)
                size += len(ids) // 4
                if size >= block_tokens:
                    yield flush()
        if parts:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = ("id", F.xxhash64("text"))
    return slim.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(blocks, ARCHIVE)


def write_archive(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write ``docs`` as a token archive: a Parquet table of blocks.

    Spark commits the blocks of finished tasks only, so a lost executor's shard is
    written again by another.
    """
    archive_blocks(docs, tokenizer, **options).write.option("compression", "zstd").parquet(path)


def read_archive(spark: SparkSession, path: str, *, broadcast_shards: int = 100_000) -> DataFrame:
    """Documents of an archive: doc_id, start (ids before it), n_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit integers. Shard offsets come from
    one row a shard, broadcast if there are at most ``broadcast_shards``.
    """
    table = spark.read.schema(ARCHIVE).parquet(path)
    shards = table.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    few = shards.limit(broadcast_shards + 1).count() <= broadcast_shards
    blocks = table.select("shard", "first_token", "payload").join(F.broadcast(shards) if few else shards, "shard")
    blocks = blocks.select((F.col("shard_start") + F.col("first_token")).alias("start"), "payload")

    def documents(batches):
        import pyarrow as pa

        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = Block(payload.as_py())
                ids, begins = b.ids(), np.concatenate(([0], b.ends[:-1]))
                raw = ids.astype("<u4").tobytes()
                cut = [raw[4 * i : 4 * j] for i, j in zip(begins.tolist(), b.ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(b.doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(b.ends - begins, pa.int64()), pa.array(cut, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def read_slices(spark: SparkSession, path: str, wanted: DataFrame, *, lanes: int = 8) -> DataFrame:
    """Slices of documents: ``wanted`` has doc_id, start, stop within the document.

    A slice's block is found by the archive's ids alone. The wanted slices of a block
    are gathered, in ``lanes`` rows at most, so that only wanted blocks are read, and
    each of them about once; only the symbols that cover a slice are decoded.
    """
    table = spark.read.schema(ARCHIVE).parquet(path)
    places = table.select("shard", "block", F.posexplode("doc_ids").alias("at", "doc_id"))
    asked = wanted.select("doc_id", F.col("start").cast("long").alias("from"), F.col("stop").cast("long").alias("to")).distinct()
    lane = F.pmod(F.xxhash64("doc_id", "from", "to"), F.lit(lanes))
    slices = places.join(asked, "doc_id").groupBy("shard", "block", lane.alias("lane")).agg(F.collect_list(F.struct("doc_id", "from", "to", "at")).alias("slices"))
    joined = slices.join(table.select("shard", "block", "payload"), ["shard", "block"]).select("slices", "payload")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for slices, payload in zip(batch.column(0), batch.column(1)):
                block = Block(payload.as_py())
                rows = [(x["doc_id"], x["from"], x["to"], block.slice(x["at"], x["from"], x["to"]).astype("<u4").tobytes()) for x in slices.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "stop", "ids"])

    return joined.mapInArrow(cut, "doc_id long, start long, stop long, ids binary")
