"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is the multiset of its shingles of ``shingle`` words (a shorter text is one
shingle). ProbMinHash gives every shingle a Poisson process whose rate is its
count; arrivals go to random registers, each register keeps its first arrival,
and a text's processes stop as soon as no later arrival can be the first of any
register. Two texts agree in a register with their probability Jaccard
similarity. Registers are banded, texts that share a band are compared exactly,
and classes are the connected components of pairs at ``threshold`` or more.

Equal texts are one node from the start. In a bucket of a band every node is
compared with the smallest one (a star, not all pairs). Buckets whose nodes are
then still in several components get ``star_rounds`` further stars around their
smallest node outside the first component. The texts of buckets that are mixed
even then go through an exact filter (``prefixes``): they are compared at their
rare elements, with two hubs first and then completely, as far as the bound on
their similarity allows. So no pair that shares a bucket is left untested unless
it can't be similar or its nodes are already in one class.

Texts are signed where they lie and copies left out afterwards: that costs their
signatures, but no shuffle of all texts.

Defined results: a null text or id is a class of its own (its class id is the
id); equal texts, empty ones included, are one class; texts without words are
only ever equal, never near; rows with equal ids are one class, whatever their
texts; an empty table gives no rows; other columns are ignored. The class id is the
smallest id of the class. A long text is compared whole, with some arrays of its
words in memory. ``keep_one`` keeps one row of each class, and the docs' columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, buffers, materialize, mix64, spare, text_batches

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_STEP = np.uint64(0xD1342543DE82EF95)


def shingles(hashes: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, its count, text number) of texts laid end to end, sorted by text and shingle."""
    n = len(hashes)
    begins = np.concatenate(([0], ends[:-1]))
    words = ends - begins
    text = np.repeat(np.arange(len(ends)), words)
    h = mix64(hashes + np.uint64(1))
    rolled = h.copy()
    whole = words < size  # one shingle of all words
    for j in range(1, size):
        m = n - j
        if m <= 0:
            break
        fits = text[:m] == text[j:]
        rolled[:m][fits] = mix64(rolled[:m][fits] * _GOLDEN + h[j:][fits])
    start = np.arange(n) - begins[text] if n else np.zeros(0, np.int64)
    keep = np.where(whole[text], start == 0, start <= words[text] - size)
    rolled, text = rolled[keep], text[keep]
    order = np.lexsort((rolled, text))
    rolled, text = rolled[order], text[order]
    if not len(rolled):
        return rolled, np.zeros(0, np.int64), text
    edge = np.flatnonzero(np.concatenate(([True], (rolled[1:] != rolled[:-1]) | (text[1:] != text[:-1]))))
    return rolled[edge], np.diff(np.append(edge, len(rolled))), text[edge]


def signatures(elements: np.ndarray, weights: np.ndarray, text: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """First arrivals: the winning element of each register, one row a text."""
    best = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, dtype=np.uint64)
    sizes = np.bincount(text, minlength=texts)
    single = sizes[text] == 1  # one element wins everywhere
    winner.reshape(texts, registers)[text[single]] = elements[single][:, None]
    best.reshape(texts, registers)[text[single]] = 0.0
    e, w, t = elements[~single], weights[~single].astype(np.float64), text[~single]
    at = np.zeros(len(e))
    r = 0
    while len(e):
        r += 1
        bits = mix64(e + np.uint64(r * int(_GOLDEN) & _MASK))
        at = at - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / w
        cell = t * registers + (mix64(e ^ np.uint64(r * int(_STEP) & _MASK)) % np.uint64(registers)).astype(np.int64)
        first = np.flatnonzero(at < best[cell])
        first = first[np.lexsort((e[first], -at[first]))]  # the earliest is written last
        best[cell[first]] = at[first]
        winner[cell[first]] = e[first]
        live = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        latest = best.reshape(texts, registers)[t[live]].max(axis=1)
        going = at < np.repeat(latest, np.diff(np.append(live, len(t))))
        e, w, t, at = e[going], w[going], t[going], at[going]
    return winner.reshape(texts, registers)


def band_keys(winners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each text and band."""
    parts = winners[:, : bands * rows].reshape(len(winners), bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix64(key * _GOLDEN + parts[:, :, j])
    return key


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets with sorted elements."""
    if not len(a) or not len(b):
        return 0.0
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = x.astype(np.float64), y.astype(np.float64)
    cx, cy = x[i], y[j]
    ratio = cy / cx
    order = np.argsort(ratio, kind="stable")
    cx, cy, ratio = cx[order], cy[order], ratio[order]
    only_x, only_y = x.sum() - cx.sum(), y.sum() - cy.sum()  # ratios 0 and infinite
    upto = np.searchsorted(ratio, ratio, side="right")
    low = np.concatenate(([0.0], np.cumsum(cx)))[upto] + only_x
    high = cy.sum() - np.concatenate(([0.0], np.cumsum(cy)))[upto] + only_y
    return float((1.0 / (low / cx + high / cy)).sum())


def signature_table(docs: DataFrame, *, shingle: int, bands: int, rows: int) -> DataFrame:
    """One row a document with words: id, digest, keys (one a band)."""

    def sign(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in text_batches(batches, "text"):
            hashes, ends = hasher(*buffers(batch.column(1)))
            elements, counts, text = shingles(hashes, ends, shingle)
            has = np.flatnonzero(np.bincount(text, minlength=len(ends)))
            if not len(has):
                continue
            number = np.searchsorted(has, text)
            keys = band_keys(signatures(elements, counts, number, len(has), bands * rows), bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(has)) for i in (0, 2)), lists], names=["id", "digest", "keys"])

    return docs.select("id", "text", "digest").mapInArrow(sign, "id long, digest binary, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, *, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, with their similarity."""

    def compare(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for whole in batches:
            for batch in text_batches([whole], "ta", 1 << 20):
                sets = []
                for column in (batch.column(2), batch.column(3)):
                    hashes, ends = hasher(*buffers(column))
                    elements, counts, text = shingles(hashes, ends, shingle)
                    cut = np.searchsorted(text, np.arange(len(ends) + 1))
                    sets.append([(elements[i:j], counts[i:j]) for i, j in zip(cut[:-1], cut[1:])])
                score = np.array([probability_jaccard(*p, *q) for p, q in zip(*sets)])
                at = pa.array(np.flatnonzero(score >= threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(score).take(at)], names=["a", "b", "similarity"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of linked nodes: the smallest node each one is connected to.

    Labels spread along links and are then shortened by one jump a round; every
    round's table is written, so a lost executor costs one round at most.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = materialize(met.join(jump, "label").select("node", "was", F.least("label", "far").alias("label")), "labels")
        changed = moved.where("was <> label").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def element_counts(texts: DataFrame, shingle: int, size: int = 1 << 18) -> np.ndarray:
    """Roughly how many texts have an element, by its hash modulo ``size``; never too few.

    Every task gives a row a cell it met, and cells are summed in all tasks, so what
    reaches the driver is bounded by ``size``.
    """

    def count(batches):
        import pyarrow as pa

        hasher, total = WordHasher(), np.zeros(size, np.int64)
        for batch in text_batches(batches, "text"):
            elements, _, _ = shingles(*hasher(*buffers(batch.column(1))), shingle)
            total += np.bincount((elements % np.uint64(size)).astype(np.int64), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(size, np.int64)
    for batch in texts.select("id", "text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def prefixes(texts: DataFrame, *, shingle: int, slack: float) -> DataFrame:
    """Rows (element, id, excess) that every similar pair meets in; an exact filter.

    A text's elements are ordered, rare ones first by ``element_counts``. Let z be
    the first element that two texts share, and A and B the shares of their weight
    before it. Their probability Jaccard similarity is then at most
    ``1 / (1 / (1 - A) + 1 / (1 - B) - 1)``, so at ``threshold`` or more the excesses
    ``A / (1 - A)`` and ``B / (1 - B)`` add up to at most ``slack = 1 / threshold - 1``.
    A text gives the elements whose own excess allows that and that another text
    may have.
    """
    counts = element_counts(texts, shingle)

    def give(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in text_batches(batches, "text"):
            elements, weights, text = shingles(*hasher(*buffers(batch.column(1))), shingle)
            if not len(elements):
                continue
            often = counts[(elements % np.uint64(len(counts))).astype(np.int64)]
            order = np.lexsort((elements, often, text))
            elements, weights, text, often = elements[order], weights[order], text[order], often[order]
            before = np.cumsum(weights) - weights
            first = np.searchsorted(text, text)
            share = (before - before[first]) / np.bincount(text, weights)[text]
            excess = share / (1.0 - share)
            keep = (excess <= slack + 1e-9) & (often > 1)
            yield pa.RecordBatch.from_arrays([pa.array(elements[keep].view(np.int64)), batch.column(0).take(pa.array(text[keep])), pa.array(excess[keep])], names=["element", "id", "excess"])

    return texts.select("id", "text").mapInArrow(give, "element long, id long, excess double")


def bitmaps(texts: DataFrame, *, shingle: int, words: int = 32) -> DataFrame:
    """(id, weight, bits): a text's weight and the hash cells its elements are in.

    Every cell of one text that another has not holds an element they don't share.
    """

    def give(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in text_batches(batches, "text"):
            elements, weights, text = shingles(*hasher(*buffers(batch.column(1))), shingle)
            n = batch.num_rows
            bits = np.zeros((n, words * 64), dtype=np.uint8)
            bits[text, (mix64(elements) % np.uint64(words * 64)).astype(np.int64)] = 1
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words), pa.array(np.packbits(bits, axis=1).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(text, weights, n)), lists], names=["id", "weight", "bits"])

    return texts.select("id", "text").mapInArrow(give, "id long, weight double, bits array<long>")


def _shared(bits: str, other: str, weight: str) -> Column:
    """At most this share of a text's weight is on elements that the other has too."""
    cells = F.zip_with(bits, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.greatest(1 - F.aggregate(cells, F.lit(0), lambda x, y: x + y) / F.col(weight), F.lit(1e-9))


def linkable(rows: DataFrame, slack: float) -> DataFrame:
    """Rows (element, id, excess, label) with a possible partner in another component.

    Adds the element's two best hubs, ``first`` and ``second``: the row of least
    excess, and that outside its component. A row without a partner at the nearest
    hub of another component has none at all.
    """
    best = F.min(F.struct("excess", "id", "label"))
    near = rows.join(rows.groupBy("element").agg(best.alias("first"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("element", "first"), "element")
    second = near.where(F.col("label") != F.col("first.label")).groupBy("element").agg(best.alias("second"))
    near = near.join(second, "element")
    partner = F.when(F.col("label") == F.col("first.label"), F.col("second.excess")).otherwise(F.col("first.excess"))
    return near.where(F.col("excess") + partner <= slack + 1e-9)


def _nodes(digests: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(one row a text: digest, first (its smallest id), node; links between texts that share an id, if there are any).

    A text is named after its smallest id, or after a hash of its digest if that id
    has other texts too.
    """
    nodes = digests.groupBy("digest").agg(F.min("id").alias("first"))
    shared = materialize(digests.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id"), "shared-ids")
    if shared.limit(1).count() == 0:
        return materialize(nodes.withColumn("node", F.col("first")), "nodes"), None
    marked = nodes.join(shared.select(F.col("id").alias("first"), F.lit(True).alias("shared")), "first", "left")
    nodes = materialize(marked.select("digest", "first", F.when(F.col("shared"), F.xxhash64("digest")).otherwise(F.col("first")).alias("node")), "nodes")
    named = digests.join(shared, "id").distinct().join(nodes, "digest").select("id", "node")
    hubs = named.groupBy("id").agg(F.min("node").alias("a"))
    return nodes, materialize(named.join(hubs, "id").where("a <> node").select("a", F.col("node").alias("b"), F.lit(None).cast("double").alias("similarity")), "same-ids")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bands: int = 25, rows: int = 5, threshold: float = 0.8, star_rounds: int = 1) -> DataFrame:
    """One row a document: id, node (smallest id with an equal text), class_id, n_links.

    ``n_links`` counts the pairs found similar that the text is in. They hold the
    class together; pairs that were in one class already are not compared.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    usable = slim.where("id is not null and text is not null").withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    digests = materialize(usable.select("id", "digest"), "digests")
    nodes, same_ids = _nodes(digests)
    named = nodes.select(F.col("first").alias("id"), "digest", "node")

    signed = signature_table(usable, shingle=shingle, bands=bands, rows=rows).join(named, ["id", "digest"])
    keys = materialize(signed.select(F.col("node").alias("id"), F.explode("keys").alias("key")).distinct(), "band-keys")
    stars = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    members = materialize(keys.join(stars, "key"), "buckets")

    asked = materialize(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    wanted = named.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    texts = materialize(usable.join(wanted, ["id", "digest"]).dropDuplicates(["id", "digest"]).select(F.col("node").alias("id"), "text"), "texts")
    links = verified(asked, texts, shingle=shingle, threshold=threshold)
    links = materialize(links if same_ids is None else links.union(same_ids), "verified")
    labels = components(links)

    def ask(more: DataFrame) -> bool:
        """Compare the pairs that were not compared yet; whether there were any."""
        nonlocal asked, links, labels
        more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = materialize(more.join(asked, ["a", "b"], "left_anti"), "pairs")
        if more.limit(1).count() == 0:
            return False
        asked = materialize(asked.union(more), "pairs")
        found = materialize(verified(more, texts, shingle=shingle, threshold=threshold), "verified")
        if found.limit(1).count():
            links = materialize(links.union(found), "verified")
            labels = components(links)
        return True

    def labelled(rows: DataFrame) -> DataFrame:
        named = rows.join(labels.withColumnRenamed("node", "id"), "id", "left")
        return named.select(*rows.columns, F.coalesce("label", "id").alias("label"))

    def mixed_buckets() -> DataFrame:
        """The rows of buckets whose nodes are in several components still."""
        rows = labelled(members.select("key", "id"))
        mixed = rows.groupBy("key").agg(F.min("label").alias("lowest"), F.max("label").alias("highest")).where("lowest <> highest").select("key", "lowest")
        return materialize(rows.join(mixed, "key"), "open")

    open_ = mixed_buckets()
    for _ in range(star_rounds):
        hubs = open_.where("label <> lowest").groupBy("key").agg(F.min(F.struct("id", "label")).alias("hub")).select("key", F.col("hub.id").alias("hub"), F.col("hub.label").alias("hub_label"))
        if not ask(open_.join(hubs, "key").where("label <> hub_label").select(F.col("hub").alias("a"), F.col("id").alias("b"))):
            break
        open_ = mixed_buckets()
    rest = texts.join(open_.select("id").distinct(), "id", "left_semi")
    if rest.limit(1).count():
        slack = 1.0 / threshold - 1.0
        parts = materialize(prefixes(rest, shingle=shingle, slack=slack), "prefixes")
        for turn in ("first", "second", "all"):
            near = linkable(labelled(parts), slack)
            if turn == "all":
                near = materialize(near.select("element", "id", "excess", "label"), "linkable")
                near = materialize(near.join(bitmaps(rest.join(near.select("id").distinct(), "id", "left_semi"), shingle=shingle), "id"), "linkable")
                other = near.select("element", F.col("id").alias("b"), F.col("label").alias("other"), F.col("excess").alias("more"), F.col("bits").alias("other_bits"), F.col("weight").alias("other_weight"))
                # the same bound as that of the prefixes, by all elements
                least = 1 / _shared("bits", "other_bits", "weight") + 1 / _shared("other_bits", "bits", "other_weight") - 1
                possible = (F.col("label") < F.col("other")) & (F.col("excess") + F.col("more") <= slack + 1e-9) & (least <= 1 + slack + 1e-9)
                pairs = near.join(other, "element").where(possible).select(F.col("id").alias("a"), "b")
            else:
                pairs = near.where(F.col("label") != F.col(f"{turn}.label")).where(F.col("excess") + F.col(f"{turn}.excess") <= slack + 1e-9).select(F.col(f"{turn}.id").alias("a"), F.col("id").alias("b"))
            if not ask(pairs) and turn == "all":
                break

    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = nodes.join(labels, "node", "left").join(degrees, "node", "left").select("digest", F.col("first").alias("node"), F.coalesce("label", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    if same_ids is not None:  # labels may be names that are no ids
        smallest = classes.groupBy("class_id").agg(F.min("node").alias("smallest"))
        classes = classes.join(smallest, "class_id").select("digest", "node", F.col("smallest").alias("class_id"), "n_links")
    named = digests.join(classes, "digest").select("id", "node", "class_id", "n_links")
    alone = slim.where("id is null or text is null").select("id", F.col("id").alias("node"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return named.union(alone)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row of ``docs`` for each class, that with the smallest id; rows without id or text all stay."""
    own = spare(docs, "class")
    found = materialize(near_duplicates(docs, id_col=id_col, **options).where("id is not null").select("id", "class_id"), "classes")
    gone = found.where("id <> class_id").select(F.col("id").alias(own)).distinct()
    key = F.col(id_col).cast("long")
    kept = docs.join(gone, key == F.col(own), "left_anti")
    again = materialize(found.where("id = class_id").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias(own)), "repeated")
    if again.limit(1).count() == 0:
        return kept
    return kept.join(again, key == F.col(own), "left_anti").union(kept.join(again, key == F.col(own), "left_semi").dropDuplicates([id_col]))
