"""The training-data operators on small inputs: brute force, round trips, edge cases."""

import collections
import hashlib
import io
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from workload_lens.llm import chat, common, jpeg, langid, mixing, outliers, packing, probminhash, repair, resample, tokens, warc
from workload_lens.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (0, None, None, None, 0),
    (1, "", "aa", "s", 0),
    (2, "  \n\n\t ", "aa", "s", 6),
    (3, "one", "aa", "s", 3),
    (4, "one two  three\nfour — ünï x y 😀", "aa", "s", 30),
    (5, "same text here for everyone", "aa", "t", 27),
    (6, "same text here for everyone", "aa", "t", 27),
    (6, "same text here for everyone", "aa", "t", 27),
    (None, "no id at all", None, "t", 12),
    (8, "<|endoftext|> and \r\n tabs\t\there 12345,67", "bb", "t", 30),
    (9, "word " * 30_000, "bb", "t", 150_000),
    (10, "x" * 40_000, "bb", "t", 40_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Edge cases, with extra columns whose names clash with internal ones."""
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(1) for c in ("id", "key", "label", "n", "shard", "rank", "payload", "g", "node", "__key", "u")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizer_path()


@pytest.fixture(scope="module")
def reference(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_of(raw):
    return np.frombuffer(bytes(raw), dtype="<u4").tolist()


# -- 1: Re-Pair archives -------------------------------------------------------


def test_encoder(tokenizer, reference, documents):
    enc = tokens.Encoder(tokenizer, capacity=64)  # forgets often
    texts = [r["text"] for r in documents.collect()] + [x[1] for x in ODD if x[1]]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|><|endof", "a\n\nb", " lead", "trail ", "\nx", "x\n", "a  b", "it's don't", "x.y,z!", "1 2 33", "é́", "　x", "a b c", "\x00 \x1c y"]
    for x in texts:
        assert ids_of(enc.encode(x)) == reference(x)[:-1], x


def test_repair_random():
    rng = np.random.default_rng(1)
    for n, vocab in ((1, 2), (2, 1), (50, 2), (3000, 3), (3000, 40), (200, 70_000)):
        ids = rng.integers(0, vocab, n).astype(np.uint32)
        ends = np.unique(np.append(rng.integers(1, n + 1, 5), n))
        payload, rules, symbols = repair.pack_block(list(range(len(ends))), ids, ends, max(vocab, 2), min_count=2)
        block = repair.Block(payload)
        assert block.ids().tolist() == ids.tolist() and symbols <= n
        begins = [0, *ends[:-1].tolist()]
        for doc, (i, j) in enumerate(zip(begins, ends.tolist())):
            for a, b in ((0, j - i), (1, 3), (j - i - 1, j - i + 5), (2, 2)):
                assert block.slice(doc, a, b).tolist() == ids[i:j][a:b].tolist()
        for k, (x, y) in enumerate(block.rules.tolist()):
            assert max(x, y) < block.base + k  # rules only use earlier ones
    payload, rules, symbols = repair.pack_block([1], np.tile(np.array([5, 6, 7], np.uint32), 500), np.array([1500]), 10, min_count=2)
    assert rules > 3 and symbols < 150


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_archive(spark, request, table, tokenizer, reference):
    docs = request.getfixturevalue(table)
    path = common.fresh_path(spark, "t")
    repair.write_archive(docs, path, tokenizer, block_tokens=5000)
    found = sorted(repair.read_archive(spark, path).collect(), key=lambda r: r["start"])
    given = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    at = 0
    assert len(found) == len(given)
    for r, (known, i, text) in zip(found, given):
        ids = reference(text)
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i if known else None, at, len(ids)) and ids_of(r["ids"]) == ids
        at += len(ids)


def test_slices(spark, documents, tokenizer, reference):
    path = common.fresh_path(spark, "t")
    repair.write_archive(documents, path, tokenizer, block_tokens=20_000)
    wanted = spark.createDataFrame([(0, 0, 5), (3, 2, 9), (7, 0, 10**9), (10**12, 0, 1)], "doc_id long, start long, stop long")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = repair.read_slices(spark, path, wanted).collect()
    assert {r["doc_id"] for r in found} == {0, 3, 7}
    for r in found:
        assert ids_of(r["ids"]) == reference(texts[r["doc_id"]])[r["start"] : r["stop"]]


def test_archive_empty(spark, empty, tokenizer):
    path = common.fresh_path(spark, "t")
    repair.write_archive(empty, path, tokenizer)
    assert repair.read_archive(spark, path).count() == 0


# -- 2: language identification -----------------------------------------------


def test_langid_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    found = langid.classify(docs, langid.fit(docs, usable=~held)).where(held & F.col("lang").isNotNull())
    n, right, rejected = found.agg(F.count(F.lit(1)), F.count(F.when(F.col("lang") == F.col("lang_pred"), 1)), F.count(F.when(F.col("lang_rejected"), 1))).first()
    assert n > 100 and right / n > 0.95 and rejected / n < 0.05
    assert found.where("score < 0 or score > 1").count() == 0


def test_langid_edges(spark, odd, empty):
    model = langid.fit(odd)
    assert set(model) == {"aa", "bb"}
    found = langid.classify(odd, model).collect()
    assert len(found) == len(ODD)
    by = {r["doc_id"]: r for r in found}
    for i in (0, 1, 2):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 and by[i]["lang_rejected"]
    assert langid.fit(empty) == {}
    assert {r["lang_pred"] for r in langid.classify(odd, {}).collect()} == {"und"}
    assert langid.classify(empty, model).count() == 0


def test_langid_learns_from_whole_texts(spark):
    name = lambda i: "qz" + chr(97 + i % 26) + chr(97 + i // 26) + "qz"
    header = "same header of all texts " * 200
    docs = spark.createDataFrame([(i, header + " ".join(f"{name(i)} {hashlib.md5(b'%d %d' % (i, k)).hexdigest()}" for k in range(1000)), "aa") for i in range(40)], "doc_id long, text string, lang string")
    sampled = docs.select(F.pmod(F.shiftright(F.xxhash64(F.col("doc_id").cast("string")), 7), F.lit(8))).distinct().count()
    data = langid.fit(docs, per_language=8, dictionary_bytes=8192)["aa"]
    # each sampled text's own words are there, though 5,000 characters of header come before them
    assert len(data) <= 8192 and sum(name(i).encode() in data for i in range(40)) == sampled > 4


def test_langid_shares():
    assert langid.equal_share([10, 500, 900], 400) == 195 and langid.equal_share([10, 20], 400) == 20
    data = bytes(np.random.default_rng(1).integers(97, 123, 100_000, dtype=np.uint8))
    part = langid.excerpt(data, 1024, 7)
    assert len(part) == 1024 and part == langid.excerpt(data, 1024, 7) != langid.excerpt(data, 1024, 8)
    assert len(langid.excerpt(data, 1000, 7)) == 1000
    assert langid.excerpt(data, 100_000, 7) == data and langid.excerpt(data[:90], 1000, 7) == data[:90]
    # blocks come from all over the text
    at = [data.find(part[i : i + langid.EXCERPT]) for i in range(0, 1024, langid.EXCERPT)]
    assert at == sorted(at) and at[0] >= 0 and at[-1] > 50_000


def test_langid_margin():
    one = langid.Classifier({"a": b"the cat sat on the mat", "b": b"der hund und die katze"}, 9, 2048)
    assert one("the cat sat on the mat")[0] == "a" and one("der hund und die katze")[0] == "b"
    same = langid.Classifier({"a": b"the cat", "b": b"the cat"}, 9, 2048)("the cat")
    assert same[0] == "a" and same[2] == 0.0  # a tie: the first, no margin


# -- 3: packing ----------------------------------------------------------------


def test_plan():
    rng = np.random.default_rng(2)
    for capacity in (7, 50, 2048):
        lengths = rng.integers(1, capacity + 1, 300)
        slots, sequences = packing.plan(dict(collections.Counter(lengths.tolist())), capacity)
        rank = collections.defaultdict(int)
        ranks = []
        for x in lengths.tolist():
            ranks.append(rank[x])
            rank[x] += 1
        sequence, offset = packing.place(slots, lengths, np.array(ranks))
        ends = collections.defaultdict(list)
        for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist()):
            ends[s].append((o, o + n))
        assert set(ends) == set(range(sequences))
        for spans in ends.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert sequences <= 1.1 * math.ceil(lengths.sum() / capacity) + 1


def test_best_two():
    # greedy takes 6 and leaves 4 for the 3; two pieces of 2 fill it better
    slots, sequences = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert sequences == 2 and {int(s[0]) for s in slots if s[3] == 0} == {6, 2}


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_pack(request, table, tokenizer, reference):
    docs = request.getfixturevalue(table)
    found = packing.pack(docs, tokenizer, capacity=2048).collect()
    want = collections.Counter()
    for r in docs.collect():
        want[(r["doc_id"], tuple(reference(r["text"])))] += 1
    parts = collections.defaultdict(list)
    spans = collections.defaultdict(list)
    for r in found:
        assert len(ids_of(r["ids"])) == r["length"] <= 2048
        parts[r["doc_id"]].append((r["piece"], r["start"], ids_of(r["ids"])))
        spans[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    for (i, ids), n in want.items():
        if n == 1:
            own = sorted(parts[i])
            assert [p[0] for p in own] == list(range(len(own))) and [x for p in own for x in p[2]] == list(ids)
            assert all(len(p[2]) == 2048 for p in own[1:]) and [p[1] for p in own] == [0, *np.cumsum([len(p[2]) for p in own])[:-1].tolist()]
    assert sum(r["length"] for r in found) == sum(len(i) * n for (_, i), n in want.items())


def test_pack_empty(empty, tokenizer):
    assert packing.pack(empty, tokenizer).count() == 0


# -- 4: importance resampling ----------------------------------------------------


def test_weights_against_brute_force(spark, documents):
    good = documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    ratio = resample.fit(documents, good)
    found = {r["doc_id"]: r for r in resample.resample(documents, ratio).collect()}
    hasher = common.WordHasher()
    for r in documents.limit(40).collect():
        words = [x for x in (r["text"] or "").lower().translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if x]
        if not words:
            continue
        h = [int(hasher(np.frombuffer(w.encode(), np.uint8), np.array([len(w.encode())]))[0][0]) for w in words]
        pair = [int(common.mix64(np.array([(a * 0x9E3779B97F4A7C15 + b) % (1 << 64)], dtype=np.uint64))[0]) for a, b in zip(h, h[1:])]
        grams = [x % len(ratio) for x in h + pair]
        want = sum(ratio[g] for g in grams) * min(1, 64 / len(grams))
        assert found[r["doc_id"]]["n_ngrams"] == len(grams) and abs(found[r["doc_id"]]["log_weight"] - want) < 1e-3


def test_gumbel_top_k(spark, documents):
    ratio = resample.fit(documents, documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))
    rows = resample.resample(documents, ratio, share=0.3).collect()
    k = round(0.3 * len(rows))
    keys = sorted((r["gumbel_key"] for r in rows), reverse=True)
    assert {r["gumbel_key"] for r in rows if r["kept"]} == {x for x in keys if x >= keys[k - 1]}


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(-(10**12), 10**12, 500)] + [5, 5, 5]
    df = spark.createDataFrame([(x,) for x in values], "v long")
    for k in (1, 2, 250, 503):
        assert resample.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert resample.kth_largest(df, "v", 0) is None and resample.kth_largest(df.where("false"), "v", 3) is None
    assert resample.kth_largest(df, "v", 1000) == min(values)


def test_resample_edges(spark, odd, empty):
    rows = resample.resample(odd, resample.fit(odd, odd.select(F.lit(3).alias("id"))))
    assert rows.count() == len(ODD) and rows.where("log_weight is null or kept is null").count() == 0
    assert rows.where("doc_id in (0, 1, 2)").agg(F.max("n_ngrams")).first()[0] == 0
    none = resample.fit(odd, empty.select(F.col("doc_id").alias("id")))
    assert not none.any() and resample.resample(odd, none).where("kept").count() == len(ODD)
    assert resample.resample(empty, none).count() == 0


# -- 5: mixing -----------------------------------------------------------------


def test_mix_rates(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    found = {r["source"]: r["n"] for r in mixing.mix(docs, targets={"a": 0.5, "b": 0.5}).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(found["a"] - 1500) < 150 and abs(found["b"] - 1500) < 150
    gone = mixing.mix(docs, targets={"a": 1.0})
    assert {r["source"] for r in gone.select("source").distinct().collect()} == {"a"}
    many = mixing.mix(docs.where("doc_id < 20"), targets={"a": 1.0}, total=200.0)  # beyond max_rate
    assert abs(many.count() - 4000) < 400 and many.agg(F.min("n_copies")).first()[0] > 100
    copies = many.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_copies").alias("want"), F.max("copy").alias("last")).collect()
    assert all(r["n"] == r["want"] == r["last"] + 1 for r in copies)


def test_mix_salted_join_is_the_same(documents):
    a, b = (sorted(map(tuple, mixing.mix(documents, broadcast_sources=n).select("doc_id", "copy", "shuffle_key").collect()), key=repr) for n in (10_000, 0))
    assert a == b and a


def test_poisson_distribution(spark):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(2.5), 12).alias("c")).first()["c"]
    want = np.cumsum([math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(13)])
    assert np.allclose(cdf, want)


def test_mix_edges(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len({(r["doc_id"], r["n_copies"]) for r in rows}) == len({r["doc_id"] for r in rows})
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd.where("text is null or text = ''")).count() >= 0


# -- 6: conversations ------------------------------------------------------------


def brute_collapse(rows):
    turns = collections.defaultdict(set)
    for c, t, role, text in rows:
        turns[c].add((t is not None, t or 0, role is not None, role or "", text is not None, text or "", hashlib.sha256((text or "").encode()).hexdigest()))
    seq = {c: tuple(x[2:6] for x in sorted(v, key=lambda x: (x[0], x[1], x[2], x[3], x[4], x[6]))) for c, v in turns.items()}
    prefixes = {s[:i] for s in seq.values() for i in range(1, len(s))}
    kept, seen = set(), set()
    for c in sorted(seq, key=lambda c: (c is not None, c or 0)):
        if seq[c] not in prefixes and seq[c] not in seen:
            kept.add(c)
            seen.add(seq[c])
    return kept


def test_collapse(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        n = int(rng.integers(1, 8))
        base = int(rng.integers(0, 4))
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"text {base} {t}") for t in range(n)]
    rows += [(100, 0, None, None), (101, 0, None, ""), (102, None, "user", "x"), (None, 0, "user", "text 0 0"), (None, 1, "a", "b"), (5, 0, "user", rows[0][3])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).repartition(5)
    for chunks in (1, 3, 40):
        found = chat.collapse_and_render(turns, chunks=chunks).collect()
        assert {r["conv_id"] for r in found if r["kept"]} == brute_collapse(rows)
        assert all((r["rendered"] is not None) == r["kept"] for r in found)
    parts = chat.collapse_and_render(turns, part_turns=3).where("kept")
    whole = {r["conv_id"]: r["rendered"] for r in chat.collapse_and_render(turns).where("kept").collect()}
    again = collections.defaultdict(str)
    for r in parts.orderBy("part").collect():
        again[r["conv_id"]] += r["rendered"]
    assert again == whole and parts.where("part > 0").count() > 0
    assert chat.collapse_and_render(turns.where("false")).count() == 0


# -- 7: near duplicates --------------------------------------------------------


def brute_classes(texts, threshold=0.8):
    hasher = common.WordHasher()
    sets = []
    for x in texts:
        raw = np.frombuffer((x or "").encode(), np.uint8)
        e, c, _ = probminhash.shingles(*hasher(raw, np.array([len(raw)])), 5)
        sets.append((e, c))
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j]
            if same or (texts[i] is not None and texts[j] is not None and probminhash.probability_jaccard(*sets[i], *sets[j]) >= threshold):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


def test_probability_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = (np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(2))
        x, y = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b))
        p, q = dict(zip(a.tolist(), x / x.sum())), dict(zip(b.tolist(), y / y.sum()))
        want = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in {*p, *q}) for i in p if i in q)
        assert abs(probminhash.probability_jaccard(a, x, b, y) - want) < 1e-9


def test_signatures_estimate():
    rng = np.random.default_rng(6)
    a = np.sort(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    b = np.sort(np.concatenate((a[:160], rng.integers(0, 1 << 60, 40).astype(np.uint64))))
    w = np.concatenate((rng.integers(1, 3, 200), rng.integers(1, 3, 200)))
    s = probminhash.signatures(np.concatenate((a, b)), w, np.repeat([0, 1], 200), 2, 2000)
    want = probminhash.probability_jaccard(a, w[:200], b, w[200:])
    assert abs((s[0] == s[1]).mean() - want) < 0.05


def near_texts(seed, line=""):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [list(rng.choice(words, 60)) for _ in range(12)]
    out = []
    for i in range(150):
        text = list(bases[i % 12])
        for _ in range(int(rng.integers(0, 5))):
            text[int(rng.integers(0, 60))] = str(rng.integers(0, 10**6))
        out.append(line + " ".join(text))
    return out


@pytest.mark.parametrize("line", ["", "a line that all of these texts begin with and that is long enough to matter to them all "])
def test_near_duplicates(spark, line):
    texts = near_texts(7, line) + [None, "", "", " \n", "one two", "one two", "one  two"]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, node int").repartition(7)
    want = brute_classes(texts)
    got = {r["id"]: r["class_id"] for r in probminhash.near_duplicates(docs).collect()}
    empty_like = {i for i, x in enumerate(texts) if x is not None and not x.strip()}
    for i in range(len(texts)):
        if i not in empty_like:
            assert got[i] == want[i], (i, got[i], want[i])
    kept = {r["doc_id"] for r in probminhash.keep_one(docs).collect()}
    assert kept == {i for i in got if got[i] == i}


def test_prefix_filter_loses_nothing(spark):
    """All pairs at the threshold share a prefix element within the slack."""
    texts = near_texts(8)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    parts = collections.defaultdict(dict)
    for r in probminhash.prefixes(rows, shingle=5, slack=0.25).collect():
        parts[r["id"]][r["element"]] = r["excess"]
    hasher = common.WordHasher()
    sets = [probminhash.shingles(*hasher(np.frombuffer(x.encode(), np.uint8), np.array([len(x)])), 5)[:2] for x in texts]
    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] != texts[j] and probminhash.probability_jaccard(*sets[i], *sets[j]) >= 0.8:
                pairs += 1
                assert any(parts[i][e] + parts[j][e] <= 0.25 + 1e-9 for e in parts[i].keys() & parts[j].keys())
    assert pairs > 50


def test_near_duplicates_edges(odd, empty):
    found = probminhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD) and probminhash.near_duplicates(empty).count() == 0
    by = {r["id"]: r["class_id"] for r in found}
    assert by[None] is None and by[5] == by[6] == 5 and by[0] == 0
    kept = probminhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0)] + [(True, i) for i in (0, 1, 2, 3, 4, 5, 8, 9, 10)]


def test_rows_that_share_an_id(spark):
    """Such rows are one class, and each of their texts is compared."""
    words = [" ".join(f"{k}{i}" for i in range(60)) for k in "abc"]
    rows = [(1, words[0]), (1, words[1]), (2, words[0] + " x"), (3, words[1] + " y"), (4, words[2]), (4, words[2]), (9, "one"), (8, words[2]), (-5, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = probminhash.near_duplicates(docs)
    assert sorted((r["id"], r["class_id"]) for r in found.collect()) == [(-5, -5), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (8, 4), (9, 9)]
    links = {(r["id"], r["n_links"]) for r in found.collect()}
    assert {(2, 1), (3, 1), (1, 2), (4, 0), (9, 0)} <= links
    assert sorted(r["doc_id"] for r in probminhash.keep_one(docs).collect()) == [-5, 1, 4, 9]


# -- 8: outliers ---------------------------------------------------------------

SPACES = " \t\n\x0b\f\r"


def brute_statistics(text):
    import regex

    text = text or ""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_statistics(request, table):
    docs = request.getfixturevalue(table)
    want = collections.Counter((r["doc_id"], *brute_statistics(r["text"])) for r in docs.collect())
    found = outliers.outliers(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found) == want
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] is not None and not (r["kept"] and r["base_failed"])


def test_outliers_found(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        words = ["".join(rng.choice(list("abcdefg"), int(rng.integers(3, 7)))) for _ in range(int(rng.integers(80, 200)))]
        if i % 40 == 0:
            words = [w + "#$%&" for w in words]
        rows.append((i, " ".join(words), "aa", "s" if i % 3 else None, 0))
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    bad = {r["doc_id"] for r in outliers.outliers(docs).where("not kept").collect()}
    assert bad == {i for i in range(400) if i % 40 == 0}
    salted = {r["doc_id"] for r in outliers.judge(outliers.statistics(docs), broadcast_groups=0).where("not kept").collect()}
    assert salted == bad


def test_outliers_empty(empty):
    assert outliers.outliers(empty).count() == 0


def test_native_plans(documents):
    for df in (outliers.statistics(documents), mixing.mix(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- 9: WARC -------------------------------------------------------------------


def test_warc(spark):
    tricky = "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 50
    rows = [(0, "http://a", None), (1, "http://b", ""), (2, "u", "<p>x</p>"), (5, "u\r\nInjected: 1", "<p>x</p>"), (4, None, "ünï"), (None, "n", "<p>x</p>"), (7, "u", tricky), (8, "u", "y" * 300_000), (9, "v", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    for split in (1000, 1 << 20):
        files = warc.write(pages, common.fresh_path(spark, "warc"))
        found = {r["page_id"]: r for r in warc.read(files, split_bytes=split).collect()}
        assert len(found) == len(rows)
        import base64

        for i, _, html in rows:
            raw = (html or "").encode()
            r = found[i]
            assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert (r["record_type"] == "revisit") == (r["refers_to"] is not None)
            if r["record_type"] == "response":
                assert bytes(r["payload"]) == raw
        assert {i: r["refers_to"] for i, r in found.items() if r["refers_to"] is not None} == {1: 0, 5: 2, None: 2, 9: 8}
    listed = warc.list_archives(spark, files.first()["path"].rsplit("/", 1)[0])
    assert listed.count() == files.count()
    high = warc.write(pages, common.fresh_path(spark, "warc"), min_bytes=1000)
    assert warc.read(high).where("record_type = 'revisit'").count() == 1


def test_warc_ranges_own_records_once():
    import random

    rng = random.Random(1)
    members = [warc.gzip_member(warc.record(i, "u", rng.randbytes(rng.randrange(0, 4000)), None, "response")) for i in range(60)]
    members.insert(10, b"junk \x1f\x8b\x08 not a member")
    members.insert(20, warc.gzip_member(b"not a record"))
    data = b"".join(members)
    for step in (1, 37, 1000, 10**9):
        got = [r[0] for s in range(0, len(data), step if step > 36 else 5000) for r in warc.records_in(io.BytesIO(data), "p", s, min(len(data), s + (step if step > 36 else 5000)), 64)]
        assert got == list(range(60))
    assert [r[0] for r in warc.records_in(io.BytesIO(data[:-5]), "p", 0, len(data))] == list(range(59))


def test_warc_empty(spark):
    files = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), common.fresh_path(spark, "warc"))
    assert warc.read(files).count() == 0


# -- 10: JPEG ------------------------------------------------------------------


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_jpeg(request, table):
    docs = request.getfixturevalue(table)
    found = jpeg.describe(jpeg.store(docs), with_payload=True).collect()
    want = collections.Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        padded = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        want[(r["doc_id"], len(raw), hashlib.sha256(padded).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], hashlib.sha256(bytes(r["payload"])).hexdigest()) for r in found) == want
    same = collections.defaultdict(set)
    for r in found:
        assert bytes(r["media"])[:2] == b"\xff\xd8" and bytes(r["media"])[-2:] == b"\xff\xd9"
        same[bytes(r["payload"])].add((bytes(r["media"]), r["width"], r["height"], r["thumb_hash"]))
    assert all(len(v) == 1 for v in same.values())


def test_jpeg_empty(empty):
    assert jpeg.describe(jpeg.store(empty), with_payload=True).count() == 0


def test_crc_of_ids():
    assert zlib.crc32(np.array([0], "<u4").tobytes()) == zlib.crc32(bytes(4))
