"""Baseline JPEG columns: parsing, Huffman decoding, DC thumbnails, lossless payloads.

``parse`` reads the markers of a baseline (SOF0, 8-bit, Huffman) JPEG, ``scan``
decodes the quantised coefficients of its scan, and ``thumbnail`` rebuilds the
luminance from the DC coefficients alone: one pixel for each 8x8 block.

``encode_payload`` stores bytes in a grey JPEG without loss, in the format's own
unit: each byte is one quantised coefficient. Byte ``b`` becomes coefficient
``b`` if ``b >= 128`` and ``b - 255`` otherwise; all these have eight magnitude
bits, and the magnitude bits of byte ``b`` are ``b`` itself. Quantisers are 1.
The Huffman table of the DC differences gives a category of ``s`` bits a code of
``11 - s`` bits, so every block has the same number of bits and is encoded as an
array. Restart markers stand after every ``RESTART`` blocks.

A scan is Huffman-decoded symbol by symbol. The restart intervals of all images of
a batch are decoded side by side, one symbol of each at a time, as arrays; that
reads any baseline JPEG. With few intervals a plain loop is faster (``_scan_plain``).

Defined results: null media give null columns; bytes that are no baseline JPEG
give a row whose ``error`` says why; null texts are stored as 64 zero bytes;
equal texts give equal media; an empty table stays empty; a long text is one
image, held whole with its coefficients. Columns of the media table stay, but for
those named like the added ones (``ADDED``), which are replaced.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches

ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
_DC_CATEGORIES = 10
_DC_TOTAL = 11
_AC_SYMBOL = 0x08
_BLOCK_BITS = _DC_TOTAL + 63 * 9
_MAX_SIDE = 65535 // 8
#: Blocks between restart markers of stored payloads; 16 of them end on a byte.
RESTART = 16
#: Intervals from which on they are decoded side by side.
_SIDE_BY_SIDE = 48
ADDED = ("width", "height", "thumb", "thumb_hash", "error", "payload")


class JpegError(ValueError):
    """Not a baseline JPEG this module reads."""


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    restart: int = 0
    comments: list[bytes] = field(default_factory=list)
    data: bytes = b""


def parse(raw: bytes) -> Image:
    """Markers and entropy-coded data of a baseline JPEG."""
    if raw[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    out, at = Image(), 2
    try:
        while True:
            if raw[at] != 0xFF:
                raise JpegError("marker expected")
            while raw[at] == 0xFF:
                at += 1
            marker, at = raw[at], at + 1
            if marker == 0xD9:
                raise JpegError("no scan")
            size = struct.unpack_from(">H", raw, at)[0]
            body, at = raw[at + 2 : at + size], at + size
            if len(body) != size - 2:
                raise JpegError("truncated segment")
            if marker == 0xDB:
                _quantisers(body, out)
            elif marker == 0xC4:
                _tables(body, out)
            elif marker == 0xC0:
                bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not out.width or not out.height:
                    raise JpegError("not 8-bit or empty")
                out.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
                if not 1 <= n <= 4 or any(not 1 <= x <= 4 for c in out.components for x in (c.h, c.v)):
                    raise JpegError("bad components or sampling factors")
            elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                raise JpegError("not baseline")
            elif marker == 0xDD:
                out.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                out.comments.append(body)
            elif marker == 0xDA:
                if body[0] != len(out.components):
                    raise JpegError("several scans")
                for i in range(body[0]):
                    c = next((c for c in out.components if c.ident == body[1 + 2 * i]), None)
                    if c is None:
                        raise JpegError("unknown component")
                    c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                end = raw.rfind(b"\xff\xd9")
                out.data = raw[at : end if end >= at else len(raw)]
                return out
    except (IndexError, struct.error) as e:
        raise JpegError("truncated") from e


def _quantisers(body: bytes, out: Image) -> None:
    at = 0
    while at < len(body):
        wide, ident = body[at] >> 4, body[at] & 15
        kind, size = (">u2", 128) if wide else ("u1", 64)
        if len(body) < at + 1 + size:
            raise JpegError("truncated segment")
        out.quant[ident] = np.frombuffer(body, kind, 64, at + 1).astype(np.int64)
        at += 1 + size


def _tables(body: bytes, out: Image) -> None:
    at = 0
    while at < len(body):
        counts = body[at + 1 : at + 17]
        n = sum(counts)
        if len(counts) < 16 or len(body) < at + 17 + n or sum(k << (15 - i) for i, k in enumerate(counts)) > 1 << 16:
            raise JpegError("bad table")
        out.huffman[body[at] >> 4, body[at] & 15] = (counts, body[at + 17 : at + 17 + n])
        at += 17 + n


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(code, its length, symbol), canonical."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(table: tuple[bytes, bytes]) -> list[int]:
    """For each 16-bit prefix: length << 8 | symbol, 0 if there is no such code."""
    out = [0] * (1 << 16)
    for code, length, symbol in _codes(*table):
        first = code << (16 - length)
        out[first : first + (1 << (16 - length))] = [length << 8 | symbol] * (1 << (16 - length))
    return out


def _intervals(image: Image) -> list[bytes]:
    """Entropy-coded data without stuffing, cut at restart markers."""
    data = image.data
    if not image.restart:
        return [data.replace(b"\xff\x00", b"\xff")]
    parts, begin, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            break
        if 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[begin:at])
            begin = at + 2
        at += 2 if data[at + 1] != 0xFF else 1  # fill bytes may stand before a marker
    parts.append(data[begin:])
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


@dataclass
class _Layout:
    """Where a scan's blocks go: ``slots`` has the component of each block of a unit."""

    across: int
    down: int
    sampling: list[tuple[int, int]]
    slots: list[int]

    @property
    def units(self) -> int:
        return self.across * self.down

    def split(self, blocks: np.ndarray) -> list[np.ndarray]:
        """Blocks in the scan's order as one array a component: (block rows, block columns, 64)."""
        out, at = [], 0
        blocks = blocks.reshape(self.down, self.across, len(self.slots), 64)
        for h, v in self.sampling:
            part = blocks[:, :, at : at + h * v].reshape(self.down, self.across, v, h, 64)
            out.append(part.transpose(0, 2, 1, 3, 4).reshape(self.down * v, self.across * h, 64))
            at += h * v
        return out


def _layout(image: Image) -> _Layout:
    if not image.components:
        raise JpegError("no frame")
    for c in image.components:
        if (0, c.dc) not in image.huffman or (1, c.ac) not in image.huffman:
            raise JpegError("missing table")
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    if len(image.components) == 1:  # not interleaved: a unit is one block
        return _Layout(-(-image.width // 8), -(-image.height // 8), [(1, 1)], [0])
    sampling = [(c.h, c.v) for c in image.components]
    return _Layout(-(-image.width // (8 * hmax)), -(-image.height // (8 * vmax)), sampling, [k for k, (h, v) in enumerate(sampling) for _ in range(h * v)])


def scan(image: Image) -> list[np.ndarray]:
    """Quantised coefficients of each component: (block rows, block columns, 64), in zigzag order."""
    found = scan_all([image])[0]
    if isinstance(found, JpegError):
        raise found
    return found


def scan_all(images: list[Image]) -> list[list[np.ndarray] | JpegError]:
    """``scan`` of many images; an image that can't be decoded gives its error."""
    out: list[list[np.ndarray] | JpegError] = []
    layouts: list[_Layout | None] = []
    intervals: list[list[bytes]] = []
    for image in images:
        try:
            layouts.append(_layout(image))
            intervals.append(_intervals(image))
            per = image.restart or layouts[-1].units
            if len(intervals[-1]) * per < layouts[-1].units:
                raise JpegError("truncated scan")
            out.append([])
        except JpegError as e:
            layouts[len(out) :], intervals[len(out) :] = [None], [[]]
            out.append(e)
    many = sum(map(len, intervals)) >= _SIDE_BY_SIDE
    good = [i for i, x in enumerate(layouts) if x is not None]
    if many:
        found = _scan_side_by_side([images[i] for i in good], [layouts[i] for i in good], [intervals[i] for i in good])
    else:
        found = [_scan_plain(images[i], layouts[i], intervals[i]) for i in good]
    for i, blocks in zip(good, found):
        out[i] = blocks if isinstance(blocks, JpegError) else layouts[i].split(blocks)
    return out


def _scan_plain(image: Image, layout: _Layout, intervals: list[bytes]) -> np.ndarray | JpegError:
    """The blocks of one scan, in its order."""
    tables = {key: _lookup(image.huffman[key]) for c in image.components for key in ((0, c.dc), (1, c.ac))}
    out = np.zeros((layout.units * len(layout.slots), 64), np.int32)
    n = 0
    for part in intervals:
        last = [0] * len(image.components)
        bits = int.from_bytes(part + b"\xff\xff\xff\xff", "big")
        total, at = 8 * len(part), 0
        size = total + 32
        for _ in range(len(layout.slots) * (image.restart or layout.units)):
            if n == len(out):
                break
            k = layout.slots[n % len(layout.slots)]
            dc, ac = tables[0, image.components[k].dc], tables[1, image.components[k].ac]
            pos = 0
            while pos < 64:
                found = (ac if pos else dc)[bits >> (size - at - 16) & 0xFFFF] if at < total else 0
                if not found:
                    return JpegError("truncated scan" if at >= total else "bad code")
                at += found >> 8
                symbol = found & 0xFF
                run, width = (symbol >> 4, symbol & 15) if pos else (0, symbol)
                if pos and not width:
                    if run != 15:
                        break
                    pos += 16
                    continue
                pos += run
                if pos > 63 or width > 15:
                    return JpegError("bad run")
                value = 0
                if width:
                    at += width
                    if at > total:
                        return JpegError("truncated scan")
                    value = bits >> (size - at) & ((1 << width) - 1)
                    if value < 1 << (width - 1):
                        value -= (1 << width) - 1
                if pos == 0:
                    value += last[k]
                    last[k] = value
                out[n, pos] = value
                pos += 1
            if at > total:
                return JpegError("truncated scan")
            n += 1
    return out


def _scan_side_by_side(images: list[Image], layouts: list[_Layout], intervals: list[list[bytes]]) -> list[np.ndarray | JpegError]:
    """The blocks of many scans: a step decodes a symbol of each interval that isn't done."""
    numbers: dict[tuple[bytes, bytes], int] = {}
    number = lambda table: numbers.setdefault(table, len(numbers))
    dc_of, ac_of, part_of = [], [], []  # by image and slot, one image after the other
    owner, todo, slots_at, first_block, data = [], [], [], [], []
    total, errors = 0, {}
    for i, (image, layout, parts) in enumerate(zip(images, layouts, intervals)):
        at, n, per = len(dc_of), len(layout.slots), image.restart or layout.units
        for k in layout.slots:
            dc_of.append(number(image.huffman[0, image.components[k].dc]))
            ac_of.append(number(image.huffman[1, image.components[k].ac]))
            part_of.append(k)
        for j, part in enumerate(parts[: -(-layout.units // per)]):
            owner.append(i)
            todo.append(n * min(per, layout.units - j * per))
            slots_at.append(at)
            first_block.append(total + n * per * j)
            data.append(part)
        total += n * layout.units
    lookup = np.concatenate([np.array(_lookup(t), np.int32) for t in numbers])
    dc_of, ac_of, part_of = (np.array(x, np.int64) << s for x, s in ((dc_of, 16), (ac_of, 16), (part_of, 0)))
    width_of = np.array([len(x.slots) for x in layouts], np.int64)
    # the 32 bits from each byte on; ones follow the data
    raw = np.frombuffer(b"".join(data) + b"\xff" * 8, np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    sizes = np.array([len(x) for x in data], np.int64)
    stop = 8 * np.cumsum(sizes)
    pos = stop - 8 * sizes
    owner, todo, slots_at = (np.array(x, np.int64) for x in (owner, todo, slots_at))
    out = np.zeros(64 * total, np.int32)
    base = 64 * np.array(first_block, np.int64)  # where the interval's present block is
    slot = np.zeros(len(owner), np.int64)
    place = np.zeros(len(owner), np.int64)
    last = np.zeros((len(owner), 4), np.int64)
    dc, ac, part = dc_of[slots_at], ac_of[slots_at], part_of[slots_at]
    width = width_of[owner]

    def fail(which: np.ndarray, why: str) -> None:
        for i in np.unique(owner[which]).tolist():
            errors.setdefault(i, why)

    while len(pos):
        is_dc = place == 0
        code = words.take(pos >> 3) >> (16 - (pos & 7)).astype(np.uint32) & np.uint32(0xFFFF)
        found = lookup.take(np.where(is_dc, dc, ac) + code)
        pos += found >> 8
        symbol = found & 0xFF
        size = np.where(is_dc, symbol, symbol & 15)
        run = np.where(is_dc, 0, symbol >> 4)
        void = ~is_dc & (size == 0)
        place += np.where(void, np.where(run == 15, 16, 64), run)  # sixteen zeros, or the end of the block
        wrong = (found == 0) | (size > 15) | (~void & (place > 63)) | (pos + size > stop)
        if wrong.any():
            ended = pos + size > stop
            fail(wrong & ended, "truncated scan")
            fail(wrong & ~ended & (found == 0), "bad code")
            fail(wrong & ~ended & (found != 0), "bad run")
            size, void = np.where(wrong, 0, size), void | wrong
        bits = (words.take(pos >> 3) >> (32 - (pos & 7) - size).clip(0, 31).astype(np.uint32)).astype(np.int64) & ((1 << size) - 1)
        pos += size
        value = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
        if is_dc.any():
            at = np.flatnonzero(is_dc & ~void)
            value[at] += last[at, part[at]]
            last[at, part[at]] = value[at]
        at = np.flatnonzero(~void) if void.any() else slice(None)
        out[base[at] + place[at]] = value[at]
        place += ~void
        done = place >= 64
        if wrong.any():
            done |= wrong
        if done.any():
            at = np.flatnonzero(done)
            todo[at] -= 1
            base[at] += 64
            place[at] = 0
            slot[at] = (slot[at] + 1) % width[at]
            now = slots_at[at] + slot[at]
            dc[at], ac[at], part[at] = dc_of[now], ac_of[now], part_of[now]
            if wrong.any() or (todo[at] == 0).any():
                going = np.flatnonzero((todo > 0) & ~wrong)
                pos, stop, owner, todo, slots_at, base, slot, place, last, dc, ac, part, width = (x[going] for x in (pos, stop, owner, todo, slots_at, base, slot, place, last, dc, ac, part, width))
    blocks, results, at = out.reshape(-1, 64), [], 0
    for i, layout in enumerate(layouts):
        n = layout.units * len(layout.slots)
        results.append(JpegError(errors[i]) if i in errors else blocks[at : at + n])
        at += n
    return results


def thumbnail(image: Image, coefficients: list[np.ndarray]) -> np.ndarray:
    """Luminance of each 8x8 block from its DC coefficient, as bytes."""
    c = image.components[0]
    q = image.quant.get(c.quant)
    if q is None:
        raise JpegError("missing quantiser")
    dc = coefficients[0][:, :, 0] * q[0]
    hmax, vmax = max(x.h for x in image.components), max(x.v for x in image.components)
    down, across = -(-image.height * c.v // (8 * vmax)), -(-image.width * c.h // (8 * hmax))
    return np.clip(np.floor_divide(dc + 4, 8) + 128, 0, 255).astype(np.uint8)[:down, :across]


def thumbnail_hash(thumb: np.ndarray, side: int = 8) -> str:
    """Average hash of the thumbnail, averaged over ``side`` x ``side`` cells, as hex."""
    rows = np.arange(side) * thumb.shape[0] // side
    cols = np.arange(side) * thumb.shape[1] // side
    # a thumbnail of fewer pixels repeats them: reduceat takes one where a cell begins no later than the next
    high, wide = (np.add.reduceat(np.ones(n, np.int64), at) for n, at in zip(thumb.shape, (rows, cols)))
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, axis=0), cols, axis=1)
    small = sums * (np.lcm.reduce(high) // high)[:, None] * (np.lcm.reduce(wide) // wide)  # means, as whole numbers
    bits = (small * small.size > small.sum()).ravel()
    return np.packbits(bits).tobytes().hex()


# -- lossless payloads -------------------------------------------------------


def _payload_tables() -> tuple[tuple[bytes, bytes], tuple[bytes, bytes], np.ndarray]:
    counts = [0] * 16
    symbols = []
    for size in range(_DC_CATEGORIES - 1, -1, -1):  # short codes for large categories
        counts[_DC_TOTAL - size - 1] += 1
        symbols.append(size)
    dc = (bytes(counts), bytes(symbols))
    ac = (bytes([1] + [0] * 15), bytes([_AC_SYMBOL]))
    codes = np.zeros(1024, np.int64)
    for code, length, size in _codes(*dc):
        for n in range(1 << size):
            v = n if size == 0 or n >= 1 << (size - 1) else n - (1 << size) + 1
            codes[v + 511] = code << size | n
    return dc, ac, codes


_DC_TABLE, _AC_TABLE, _DC_CODES = _payload_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_QUANT = _segment(0xDB, bytes([0]) + b"\x01" * 64)
_HUFF = _segment(0xC4, bytes([0x00]) + _DC_TABLE[0] + _DC_TABLE[1]) + _segment(0xC4, bytes([0x10]) + _AC_TABLE[0] + _AC_TABLE[1])
_START = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
_NOTE = b"payload blocks "


def encode_payload(payload: bytes) -> bytes:
    """A grey baseline JPEG that holds ``payload``, whose size is a multiple of 64, byte for coefficient."""
    blocks = len(payload) // 64
    if not blocks or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    across = max(1, int(np.ceil(np.sqrt(blocks))))
    if across > _MAX_SIDE:
        raise ValueError("the payload is too large for one JPEG")
    down = -(-blocks // across)
    data = np.zeros((across * down, 64), np.uint8)
    data[:blocks] = np.frombuffer(payload, np.uint8).reshape(blocks, 64)
    dc = data[:, 0].astype(np.int64)
    dc = np.where(dc >= 128, dc, dc - 255)
    before = np.concatenate(([0], dc[:-1]))
    before[::RESTART] = 0
    code = _DC_CODES[dc - before + 511]
    parts, step = [], 64 * RESTART
    for i in range(0, len(data), step):
        n = min(step, len(data) - i)
        bits = np.ones((-(-n // RESTART) * RESTART, _BLOCK_BITS), np.uint8)
        c = code[i : i + n]
        bits[:n, :_DC_TOTAL] = np.unpackbits(np.stack((c >> 8, c & 255), axis=1).astype(np.uint8), axis=1)[:, 16 - _DC_TOTAL :]
        rest = bits[:n, _DC_TOTAL:].reshape(n, 63, 9)
        rest[:, :, 0] = 0
        rest[:, :, 1:] = np.unpackbits(data[i : i + n, 1:, None], axis=2)
        bits[:n, _DC_TOTAL:] = rest.reshape(n, -1)
        packed = np.packbits(bits.reshape(-1, RESTART * _BLOCK_BITS), axis=1)
        parts += [x.tobytes() for x in packed]
    short = len(data) % RESTART
    if short:
        parts[-1] = parts[-1][: -(-short * _BLOCK_BITS // 8)]
    body = parts[0].replace(b"\xff", b"\xff\x00") + b"".join(b"\xff" + bytes([0xD0 + i % 8]) + x.replace(b"\xff", b"\xff\x00") for i, x in enumerate(parts[1:]))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + bytes([1, 0x11, 0]))
    note = _segment(0xFE, _NOTE + str(blocks).encode())
    restart = _segment(0xDD, struct.pack(">H", RESTART))
    return b"\xff\xd8" + note + _QUANT + frame + _HUFF + restart + _START + body + b"\xff\xd9"


def read_payload(image: Image, coefficients: list[np.ndarray]) -> bytes:
    """The bytes of ``encode_payload``."""
    note = next((c for c in image.comments if c.startswith(_NOTE)), None)
    if note is None:
        raise JpegError("no payload")
    c = coefficients[0].reshape(-1, 64)[: int(note[len(_NOTE) :])]
    return np.where(c >= 128, c, c + 255).astype(np.uint8).tobytes()


def pad(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text with zero bytes up to a positive multiple of 64, and its own size."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw)), len(raw)


# -- DataFrame operators -----------------------------------------------------


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a JPEG."""

    def encode(batches):
        import pyarrow as pa

        for batch in text_batches(batches, "text"):
            pairs = [pad(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in pairs], pa.int64()), pa.array([encode_payload(p) for p, _ in pairs], pa.binary())], names=["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame, *, media_col: str = "media", with_payload: bool = False) -> DataFrame:
    """``media`` with width, height, thumb, thumb_hash, error (and payload).

    ``thumb`` holds the rows of the DC thumbnail; its sides are the image's, divided by 8.
    """
    added = ADDED if with_payload else ADDED[:5]
    if media_col.lower() in added:
        raise ValueError(f"the media column may not be named {media_col}")
    media = media.select([f"`{c}`" for c in media.columns if c.lower() not in added])
    names = media.columns
    kinds = (T.IntegerType(), T.IntegerType(), T.BinaryType(), T.StringType(), T.StringType(), T.BinaryType())
    schema = T.StructType([*media.schema.fields, *(T.StructField(k, t) for k, t in zip(added, kinds))])

    def decode(batches):
        import pyarrow as pa

        arrow = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.binary())
        for whole in batches:
            for batch in text_batches([whole], media_col, 4 << 20):
                rows: list[list] = [[None] * 6 for _ in range(batch.num_rows)]
                images, owners = [], []
                for row, raw in zip(rows, batch.column(names.index(media_col))):
                    if raw.is_valid:
                        try:
                            images.append(parse(raw.as_py()))
                            owners.append(row)
                        except JpegError as e:
                            row[4] = str(e)
                for row, image, found in zip(owners, images, scan_all(images)):
                    try:
                        if isinstance(found, JpegError):
                            raise found
                        thumb = thumbnail(image, found)
                        row[:4] = image.width, image.height, thumb.tobytes(), thumbnail_hash(thumb)
                        if with_payload:
                            row[5] = read_payload(image, found)
                    except ValueError as e:
                        row[4] = str(e)
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols[: len(added)]], names=[*names, *added])

    return media.mapInArrow(decode, schema)
