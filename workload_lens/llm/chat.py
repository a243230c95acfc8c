"""Cumulative-snapshot collapse of logged conversations, and their rendering.

A chat log often holds a conversation many times, once after each exchange. Every
turn gets the rolling hash of the conversation up to it; a conversation whose
last hash is a proper prefix hash of another one is a snapshot of it, and an
anti-join drops it. Of equal conversations the one with the smallest id stays.

A prefix hash is the exclusive-or of two 64-bit hashes of (position, role, text)
over the turns so far. It composes: turns are dealt out by ranges of (conversation,
turn, role, text), so a conversation of any size is in chunks of a task's size each,
whatever its turns' numbers are, and the chunks' counts and totals are rolled up
afterwards. Both sides of the anti-join are grouped by hash first, so a
conversation logged a million times is one row there.

Defined results: exactly repeated rows are one turn; turns are ordered by
(turn, role, text's SHA-256), nulls first; a null text or role differs from an empty
one; all rows with a null conversation id are one conversation; an empty table gives
no rows; other columns are ignored. Rendered conversations longer than
``part_turns`` turns come in parts of that many; a part, with its texts, is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("n")), 256)


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, key (what turns are ordered by), text. Both are structs, in which nulls are equal."""
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.unhex(_digest(text)).alias("digest"))
    return turns.select(F.struct(F.col(conv_col).alias("id")).alias("conv"), key.alias("key"), text.alias("text"))


def prefix_hashes(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """One row a turn: conv, key, pos (from 1), h1, h2 (hashes of the prefix it ends); written.

    ``chunks``: how many ranges the turns are dealt to; the session's shuffle partitions by default.
    """
    rows = _rows(turns, conv_col, turn_col, role_col, text_col).select("conv", "key").distinct()
    ranged = rows.repartitionByRange("conv", "key") if chunks is None else rows.repartitionByRange(chunks, "conv", "key")
    # the ranges come from a sample, so they are fixed by writing them
    rows = materialize(ranged.withColumn("chunk", F.spark_partition_id()), "turns")
    order = Window.partitionBy("conv", "chunk").orderBy("key")
    sizes = rows.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("conv", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("at", F.row_number().over(order)).join(bases, ["conv", "chunk"]).withColumn("pos", F.col("base") + F.col("at"))
    for k in ("1", "2"):
        rows = rows.withColumn(f"e{k}", F.xxhash64(F.lit(int(k)), "pos", F.coalesce(F.concat(F.lit("r"), "key.role"), F.lit("n")), "key.digest"))
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = materialize(rows.select("conv", "chunk", "key", "pos", F.bit_xor("e1").over(rolling).alias("x1"), F.bit_xor("e2").over(rolling).alias("x2")), "turn-hashes")
    last = rows.groupBy("conv", "chunk").agg(F.max(F.struct("pos", "x1", "x2")).alias("end"))
    carried = last.select("conv", "chunk", *(F.coalesce(F.bit_xor(f"end.x{k}").over(before), F.lit(0)).alias(f"c{k}") for k in (1, 2)))
    out = rows.join(carried, ["conv", "chunk"])
    return materialize(out.select("conv", "key", "pos", F.col("x1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("c2")).alias("h2")), "prefix-hashes")


def collapse(hashes: DataFrame) -> DataFrame:
    """One row a conversation of ``prefix_hashes``: conv, n_turns, h1, h2, kept; written."""
    whole = hashes.groupBy("conv").agg(F.max(F.struct("pos", "h1", "h2")).alias("end"))
    whole = materialize(whole.select("conv", F.col("end.pos").alias("n_turns"), F.col("end.h1").alias("h1"), F.col("end.h2").alias("h2")), "conversations")
    classes = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv").alias("conv"))
    inner = hashes.join(whole.select("conv", "n_turns"), "conv").where("pos < n_turns").groupBy(F.col("pos").alias("n_turns"), "h1", "h2").agg(F.lit(True).alias("longer"))
    maximal = classes.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv", F.lit(True).alias("kept"))
    return materialize(whole.join(maximal, "conv", "left").select("conv", "n_turns", "h1", "h2", F.coalesce("kept", F.lit(False)).alias("kept")), "collapsed")


def render_turn(role: Column, text: Column) -> Column:
    a, b, c = (F.lit(x) for x in _TEMPLATE)
    return F.concat(a, F.coalesce(role, F.lit("")), b, F.coalesce(text, F.lit("")), c)


def render(turns: DataFrame, places: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = 4096) -> DataFrame:
    """Rendered conversations: conv, part, rendered. ``places`` has the conv, key and pos of the turns to render."""
    rows = _rows(turns, conv_col, turn_col, role_col, text_col).dropDuplicates(["conv", "key"])
    part = F.floor((F.col("pos") - 1) / F.lit(part_turns)).alias("part")
    placed = rows.join(places.select("conv", "key", "pos"), ["conv", "key"]).select("conv", part, "pos", render_turn(F.col("key.role"), F.col("text")).alias("said"))
    grouped = placed.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "said"))).alias("turns"))
    return grouped.select("conv", "part", F.concat_ws("", F.col("turns.said")).alias("rendered"))


def collapse_and_render(turns: DataFrame, *, part_turns: int = 4096, chunks: int | None = None, **columns) -> DataFrame:
    """One row a conversation (a part): conv_id, n_turns, kept, part, rendered (null unless kept)."""
    hashes = prefix_hashes(turns, chunks=chunks, **columns)
    found = collapse(hashes)
    places = hashes.join(found.where("kept").select("conv"), "conv", "left_semi")
    out = found.join(render(turns, places, part_turns=part_turns, **columns), "conv", "left")
    return out.select(F.col("conv.id").alias("conv_id"), "n_turns", "kept", F.coalesce("part", F.lit(0)).cast("long").alias("part"), "rendered")


def oracle() -> str:
    a, b, c = ("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _TEMPLATE)
    return f"""
WITH rows AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, sha256('t' || text)) AS pos,
    {a} || role || {b} || text || {c} AS said FROM rows
), prefixes AS (
  SELECT conv_id, pos, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM turns
), whole AS (
  SELECT conv_id, max(pos) AS n_turns, max_by(prefix, pos) AS prefix FROM prefixes GROUP BY conv_id
), inner_prefixes AS (
  SELECT DISTINCT p.prefix FROM prefixes p JOIN whole w USING (conv_id) WHERE p.pos < w.n_turns
), firsts AS (
  SELECT min(conv_id) AS conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM inner_prefixes) GROUP BY prefix
)
SELECT conv_id, n_turns, conv_id IN (SELECT conv_id FROM firsts) AS kept, 0::BIGINT AS part,
  CASE WHEN conv_id IN (SELECT conv_id FROM firsts) THEN prefix END AS rendered
FROM whole
"""
