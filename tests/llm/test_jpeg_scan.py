"""Huffman scans: both decoders against each other and against files made by hand."""

import itertools
import struct

import numpy as np
import pytest

from workload_lens.llm import jpeg

DC = (bytes([0, 2, 3, 1, 1, 1, 1, 1] + [0] * 8), bytes([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]))


def ac_table():
    """A code for the end of a block, sixteen zeros, and runs and sizes up to 5 and 6."""
    symbols = [0x00, 0xF0, *(run << 4 | size for size in range(1, 7) for run in range(6))]
    counts = [0, 0, 1, 2, 4, 8, 16, 7] + [0] * 8
    return bytes(counts), bytes(symbols)


def encoded(blocks, layout_slots, restart, tables):
    """Entropy-coded data of blocks in scan order, symbol by symbol."""
    codes = [{s: (c, n) for c, n, s in jpeg._codes(*t)} for t in tables]
    parts, bits, last = [], "", {}
    put = lambda table, symbol: format(codes[table][symbol][0], f"0{codes[table][symbol][1]}b")
    value_bits = lambda v, n: format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def flush():
        nonlocal bits
        whole = bits + "1" * (-len(bits) % 8)
        parts.append(bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)).replace(b"\xff", b"\xff\x00"))
        bits = ""

    per = restart * len(layout_slots) if restart else len(blocks)
    for i, block in enumerate(blocks):
        if i and i % per == 0:
            flush()
            last = {}
        k = layout_slots[i % len(layout_slots)]
        diff = int(block[0]) - last.get(k, 0)
        last[k] = int(block[0])
        bits += put(0, abs(diff).bit_length()) + value_bits(diff, abs(diff).bit_length())
        at = 1
        while at < 64 and block[at:].any():
            run = int(np.flatnonzero(block[at:])[0])
            while run > 15:
                bits, run, at = bits + put(1, 0xF0), run - 16, at + 16
            while run > 5:  # the table has no longer run
                raise AssertionError("not in the table")
            v = int(block[at + run])
            bits += put(1, run << 4 | abs(v).bit_length()) + value_bits(v, abs(v).bit_length())
            at += run + 1
        if at < 64:
            bits += put(1, 0x00)
    flush()
    return b"".join(p + (b"\xff" + bytes([0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))


def hand_made(width, height, sampling, restart, rng):
    """(file, blocks of each component) of a random image."""
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    if len(sampling) == 1:
        across, down, slots, shape = -(-width // 8), -(-height // 8), [0], [(1, 1)]
    else:
        across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        slots, shape = [k for k, (h, v) in enumerate(sampling) for _ in range(h * v)], sampling
    want = [np.zeros((down * v, across * h, 64), int) for h, v in shape]
    order = []
    for y, x in itertools.product(range(down), range(across)):
        for k, (h, v) in enumerate(shape):
            for dy, dx in itertools.product(range(v), range(h)):
                block = want[k][y * v + dy, x * h + dx]
                block[0] = rng.integers(-250, 250)
                at = 1
                while at < 64 and rng.random() < 0.8:
                    at += int(rng.choice([0, 1, 5, 16]))
                    if at < 64:
                        block[at] = int(rng.integers(1, 64)) * int(rng.choice([-1, 1]))
                    at += 1
                order.append(block)
    tables = (DC, ac_table())
    seg = jpeg._segment
    frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    head = bytes([len(sampling)]) + b"".join(bytes([k + 1, 0]) for k in range(len(sampling))) + b"\x00\x3f\x00"
    raw = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes(range(1, 65))) + seg(0xC0, frame) + seg(0xC4, b"\x00" + DC[0] + DC[1]) + seg(0xC4, b"\x10" + tables[1][0] + tables[1][1])
    raw += (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, head) + encoded(order, slots, restart, tables) + b"\xff\xd9"
    return raw, want


CASES = [(8, 8, [(1, 1)], 0), (50, 21, [(1, 1)], 0), (50, 21, [(2, 2)], 3), (40, 40, [(1, 1)] * 3, 0), (45, 37, [(2, 2), (1, 1), (1, 1)], 2), (33, 17, [(2, 1), (1, 2), (1, 1)], 1)]


@pytest.mark.parametrize("limit", [1, 10**9])
def test_hand_made_files(monkeypatch, limit):
    monkeypatch.setattr(jpeg, "_SIDE_BY_SIDE", limit)
    rng = np.random.default_rng(1)
    made = [hand_made(*case, rng) for case in CASES]
    images = [jpeg.parse(raw) for raw, _ in made]
    for found, (_, want), image in zip(jpeg.scan_all(images), made, images):
        assert all(np.array_equal(a, b) for a, b in zip(found, want, strict=True))
        thumb = jpeg.thumbnail(image, found)
        c = image.components[0]
        assert thumb[0, 0] == min(255, max(0, (want[0][0, 0, 0] + 4) // 8 + 128)) and c.quant == 0


@pytest.mark.parametrize("limit", [1, 10**9])
def test_malformed_files(monkeypatch, limit):
    monkeypatch.setattr(jpeg, "_SIDE_BY_SIDE", limit)
    rng = np.random.default_rng(2)
    whole = [hand_made(*case, rng) for case in CASES]
    for raw, _ in whole:
        for _ in range(60):
            bad = bytearray(raw)
            for _ in range(int(rng.integers(1, 4))):
                bad[int(rng.integers(2, len(bad)))] = int(rng.integers(0, 256))
            cut = bytes(bad[: int(rng.integers(2, len(bad) + 1))])
            for data in (bytes(bad), cut):
                try:
                    image = jpeg.parse(data)
                    if image.width * image.height < 10**6:
                        jpeg.scan(image)
                except jpeg.JpegError:
                    pass
    # a broken image harms no other
    raw, want = whole[2]
    short = jpeg.parse(raw)
    short.data = short.data[:10]
    found = jpeg.scan_all([jpeg.parse(raw), short, jpeg.Image(), jpeg.parse(raw)])
    assert isinstance(found[1], jpeg.JpegError) and isinstance(found[2], jpeg.JpegError)
    assert np.array_equal(found[0][0], want[0]) and np.array_equal(found[3][0], want[0])


@pytest.mark.parametrize("limit", [1, 10**9])
@pytest.mark.parametrize("blocks", [1, 2, 7, 15, 16, 17, 50, 1000])
def test_payloads(monkeypatch, limit, blocks):
    monkeypatch.setattr(jpeg, "_SIDE_BY_SIDE", limit)
    payload = np.random.default_rng(blocks).integers(0, 256, 64 * blocks, dtype=np.uint8).tobytes()
    image = jpeg.parse(jpeg.encode_payload(payload))
    assert image.restart == jpeg.RESTART and jpeg.read_payload(image, jpeg.scan(image)) == payload


def test_clashing_columns(spark):
    media = spark.createDataFrame([(1, bytearray(jpeg.encode_payload(bytes(64))), 5, "x"), (2, bytearray(b"no jpeg"), 6, "y"), (3, None, 7, "z")], "id long, media binary, width int, Error string")
    rows = {r["id"]: r for r in jpeg.describe(media).collect()}
    assert rows[1]["width"] == 8 and rows[1]["error"] is None and rows[2]["error"] == "no start of image" and rows[3]["thumb"] is None and rows[3]["error"] is None
    assert jpeg.describe(media).columns == ["id", "media", "width", "height", "thumb", "thumb_hash", "error"]
