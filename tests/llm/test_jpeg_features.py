"""The thumbnail hash counts every pixel."""

import numpy as np

from workload_lens.llm import jpeg


def test_hash_of_every_pixel():
    rng = np.random.default_rng(3)
    one, two = (rng.integers(0, 256, (61, 67)).astype(np.uint8) for _ in range(2))
    at = np.ix_(np.arange(8) * 61 // 8, np.arange(8) * 67 // 8)
    two[at] = one[at]  # equal where one pixel a cell was read
    assert jpeg.thumbnail_hash(one) != jpeg.thumbnail_hash(two)


def test_hash_by_hand():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (3, 5), (8, 8), (9, 20), (61, 67)):
        thumb = rng.integers(0, 256, shape).astype(np.uint8)
        edge = lambda n, i: slice(i * n // 8, max(i * n // 8 + 1, (i + 1) * n // 8))
        cells = np.array([[thumb[edge(shape[0], i), edge(shape[1], k)].mean() for k in range(8)] for i in range(8)])
        assert jpeg.thumbnail_hash(thumb) == np.packbits((cells > cells.mean() + 1e-9).ravel()).tobytes().hex()
