"""Language identification by compression.

For each language a bounded sample of labelled texts becomes a raw-content
zstandard dictionary. The letters of a text (lower case, everything else a space)
are cut into blocks, every block is compressed with every dictionary, and the
language with the fewest bytes in all wins. Small blocks keep a long text from
becoming its own dictionary. A text is rejected when the runner-up needs hardly
more bytes, or when it has no letter.

``fit`` reads ids and labels first: of each language it keeps, for each of
``per_language`` hash buckets, the row whose id hashes lowest, so the sample is
spread over the corpus and bounded by ``per_language`` texts a language. Each
sampled text is read whole and measured in bytes of its letters. If all of them
exceed ``dictionary_bytes``, each gives an equal share, and what shorter texts
leave of theirs goes to the longer ones; a longer text gives distinct blocks of
``EXCERPT`` bytes, chosen by a hash over the whole text and kept in their order.
So every sampled text is in its dictionary, and the driver gets at most
``dictionary_bytes`` a language.

Defined results: null texts and texts without a letter get ``und``, score 0, and
are rejected; equal sizes go to the language with more labelled rows, then to
the first by name; repeated rows get equal results; without a labelled row all
texts are ``und``; an empty table gives no dictionary and stays empty; a long text
is read whole. Letters are those of Unicode's category L. Documents keep all their
columns; the added ones are ``ADDED``, and an input column with such a name is
replaced unless ``prefix`` sets their names apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spare

#: Most languages a model may have; more is an error, as the driver holds a dictionary for each.
MAX_LANGUAGES = 512
UNKNOWN = "und"
ADDED = ("lang_pred", "score", "margin", "lang_rejected")
#: Bytes of the blocks that a long text gives to a dictionary.
EXCERPT = 128
_NO_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str) -> bytes:
    """The text's letters in lower case, words apart by a space."""
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def equal_share(sizes: list[int], total: int) -> int:
    """The largest share whose sum of min(size, share) is within ``total``."""
    left = total
    for k, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if size > share:
            return share
        left -= size
    return max(sizes, default=0)


def excerpt(data: bytes, share: int, seed: int) -> bytes:
    """``data``, or ``share`` bytes at most of its distinct blocks, picked by hash and in their order."""
    if len(data) <= share:
        return data
    first: dict[bytes, int] = {}
    for i in range(0, len(data), EXCERPT):
        first.setdefault(data[i : i + EXCERPT], i)
    key = seed.to_bytes(8, "little", signed=True)
    # one more than fill the share, as the last block of the text may be short
    picked = nsmallest(-(-share // EXCERPT) + 1, first, key=lambda x: blake2b(x, digest_size=8, key=key).digest())
    out, left = [], share
    for x in picked:
        out.append((first[x], x[:left]))
        left -= len(out[-1][1])
    return b"".join(x for _, x in sorted(out))


def fit(docs: DataFrame, *, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 64, dictionary_bytes: int = 1 << 16) -> dict[str, bytes]:
    """{language: dictionary}, most frequent language first.

    ``usable`` restricts the rows that may be learned from. Every sampled text
    gives an equal share of its language's dictionary, or all it has.
    """
    if dictionary_bytes < 2 * per_language:
        raise ValueError("dictionary_bytes must hold a byte and a separator of each sampled text")

    @F.arrow_udf("binary")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([letters(x.as_py()) for x in texts], pa.binary())

    @F.arrow_udf("binary")
    def pick(data: pa.Array, share: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([excerpt(x.as_py(), n, k) for x, n, k in zip(data, share.to_pylist(), h.to_pylist())], pa.binary())

    rows = docs if usable is None else docs.where(usable)
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    bucket = F.pmod(F.shiftright("h", 7), F.lit(per_language))
    lowest = rows.groupBy("lang", bucket.alias("bucket")).agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n"))
    picked = lowest.limit(MAX_LANGUAGES * per_language + 1).collect()
    totals: dict[str, int] = {}
    for r in picked:
        totals[r["lang"]] = totals.get(r["lang"], 0) + r["n"]
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    keys = docs.sparkSession.createDataFrame([(r["lang"], r["h"]) for r in picked], "lang string, h long")
    sample = rows.join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = materialize(sample.select("lang", "h", read("text").alias("data")), "langid-sample")
    sizes: dict[str, list[int]] = {}
    for r in sample.select("lang", F.length("data").alias("n")).collect():
        sizes.setdefault(r["lang"], []).append(r["n"])
    shares = docs.sparkSession.createDataFrame([(x, equal_share(n, dictionary_bytes - len(n) + 1)) for x, n in sizes.items()], "lang string, share long")
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in sample.join(F.broadcast(shares), "lang").select("lang", "h", pick("data", "share", "h").alias("part")).collect():
        parts.setdefault(r["lang"], []).append((r["h"], bytes(r["part"])))
    return {lang: b"\n".join(x for _, x in sorted(parts[lang])) for lang in sorted(parts, key=lambda x: (-totals[x], x))}


class Classifier:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, block: int) -> None:
        import zstandard

        self.languages, self.block = list(dictionaries), block
        self.compressors = []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, data: bytes) -> np.ndarray:
        parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.compressors], dtype=np.int64)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the margin is the runner-up's excess over the best."""
        data = letters(text) if text and self.languages else b""
        if not data.strip():
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(data)
        best = int(np.argmin(sizes))
        rest = np.delete(sizes, best)
        if not len(rest):
            return self.languages[0], 1.0, 1.0
        excess = int(rest.min() - sizes[best])
        score = 1.0 / float(np.exp(-(sizes - sizes[best]) / 2.0).sum())
        return self.languages[best], score, excess / float(sizes[best])


def classify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", level: int = 9, block: int = 2048, min_margin: float = 0.002, prefix: str = "") -> DataFrame:
    """``docs`` with the columns ``ADDED``, named with ``prefix``.

    ``lang_rejected``: no language, or a margin below ``min_margin``.
    """

    @F.arrow_udf("lang_pred string, score double, margin double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = Classifier(dictionaries, level, block)
        for batch in texts:
            rows = [one(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))], names=list(ADDED[:3]))

    held = spare(docs, "lang")
    out = docs.withColumn(held, predict(F.col(text_col).cast("string")))
    found = {k: F.col(held)[k] for k in ADDED[:3]}
    found["lang_rejected"] = (found["lang_pred"] == UNKNOWN) | (found["margin"] < min_margin)
    return out.withColumns({prefix + k: v for k, v in found.items()}).drop(held)
