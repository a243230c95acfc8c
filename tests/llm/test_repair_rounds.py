"""Re-Pair goes on until no pair is frequent."""

import collections

import numpy as np
import pytest

from workload_lens.llm import repair


def most_frequent(symbols, cuts):
    """The count of the most frequent pair within documents, by brute force."""
    ends = set(cuts.tolist())
    pairs = collections.Counter((a, b) for i, (a, b) in enumerate(zip(symbols.tolist(), symbols[1:].tolist())) if i + 1 not in ends)
    return max(pairs.values(), default=0)


@pytest.mark.parametrize("base", [300, 1 << 16, 70_000])
@pytest.mark.parametrize("round_pairs", [1, 7, 4096])
def test_no_frequent_pair_is_left(base, round_pairs):
    rng = np.random.default_rng(round_pairs)
    words = [rng.integers(0, 300, int(rng.integers(1, 9))) for _ in range(60)]
    ids = np.concatenate([words[int(k)] for k in rng.zipf(1.3, 3000) % 60]).astype(np.uint32)
    ends = np.unique(np.append(rng.integers(1, len(ids), 40), len(ids)))
    rules, symbols, cuts = repair.compress(ids, ends, base, min_count=4, round_pairs=round_pairs)
    assert len(rules) and most_frequent(symbols, cuts) < 4
    payload, _, _ = repair.pack_block(list(range(len(ends))), ids, ends, base, min_count=4, round_pairs=round_pairs)
    assert repair.Block(payload).ids().tolist() == ids.tolist()


def test_ids_beyond_sixteen_bits():
    ids = np.tile(np.arange(65_530, 65_536, dtype=np.uint32), 300)
    rules, symbols, cuts = repair.compress(ids, np.array([len(ids)]), 65_536)
    assert len(symbols) < 14 and most_frequent(symbols, cuts) < 12
    payload, _, _ = repair.pack_block([1], ids, np.array([len(ids)]), 65_536)
    assert repair.Block(payload).ids().tolist() == ids.tolist()


def test_long_run_of_one_id():
    ids = np.full(1 << 16, 7, dtype=np.uint32)
    rules, symbols, cuts = repair.compress(ids, np.array([len(ids)]), 100)
    # ten rounds would leave 64 equal symbols
    assert len(symbols) < 64 and cuts.tolist() == [len(symbols)]
    assert most_frequent(symbols, cuts) < 12
    lengths = repair._lengths(rules, 100)
    assert sum(int(lengths[s - 100]) if s >= 100 else 1 for s in symbols.tolist()) == len(ids)
