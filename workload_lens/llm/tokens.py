"""Byte-level BPE encoding with the tokenizers library, word by word.

Under the tokenizer's own splitting rule a word never spans a single space
between two non-spaces, nor a single line feed between two non-spaces. Texts
are cut there, each distinct chunk is encoded once by the library and its ids
are remembered. Chunks of letters with simple punctuation go straight to the
library's BPE model, other chunks through its whole tokenizer, and a text with
any white space that the rule doesn't cover, or with the string of an added
token (which the library reads as that token), is encoded in one call.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

import numpy as np

_TAIL = ".,;:!?*%&$#|)(-\""
_FAST = array("I").itemsize == 4 and sys.byteorder == "little"
_ENCODERS: dict[tuple[str, int], "Encoder"] = {}


def _byte_map() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    spare = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


class _Chunks(dict):
    """Chunk -> its ids as bytes (little-endian uint32), in two generations."""

    def __init__(self, encoder: "Encoder", capacity: int) -> None:
        self.encoder, self.half, self.old = encoder, capacity // 2, {}

    def __missing__(self, chunk: str) -> bytes | None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encoder.word(" " + chunk) if chunk.isalpha() else self.encoder.chunk(chunk)
        self[chunk] = ids
        return ids


class Encoder:
    """Whole texts to ids; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, capacity: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.table = _byte_map()
        self.parts: dict[str, bytes] = {}
        self.chunks = _Chunks(self, capacity)

    def _pack(self, ids) -> bytes:
        return array("I", ids).tobytes() if _FAST else np.array(ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of letters, with the space before them if they follow one."""
        shown = self.table[0x20] + word[1:] if word[:1] == " " and word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return self._pack([t.id for t in self.tokenize(shown)])

    def chunk(self, chunk: str) -> bytes | None:
        """Ids of one chunk; None if its edges are white space.

        A chunk that starts with a line feed follows that line feed; any other
        follows a space.
        """
        led = chunk[:1] == "\n"
        body = chunk[1:] if led else chunk
        core = body.rstrip(_TAIL)
        if core.isalpha():
            tail = self._part(body[len(core) :]) if len(core) < len(body) else b""
            if led:
                return self._line_feed() + self.word(core) + tail
            return (self.chunks.get(core) or self.chunks.old.get(core) or self.word(" " + core)) + tail
        if not body or body != body.strip():
            return None
        if led:
            return self._line_feed() + self._pack(self.tokenizer.encode(body, add_special_tokens=False).ids)
        return self._pack(self.tokenizer.encode(" " + body, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        if part not in self.parts:
            if len(self.parts) > 4096:
                self.parts.clear()
            self.parts[part] = self._pack(self.tokenizer.encode(part, add_special_tokens=False).ids)
        return self.parts[part]

    def _line_feed(self) -> bytes:
        return self._part("\n")

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian uint32; null and empty give none."""
        if not text:
            return b""
        if self.by_chunk and not any(map(text.__contains__, self.added)):
            chunks = ("\n" + text).replace("\n", " \n").split(" ")[1:]
            try:
                return b"".join(map(self.chunks.__getitem__, chunks))[len(self._line_feed()) :]
            except TypeError:  # a chunk without ids of its own
                pass
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)


def encoder(path: str, capacity: int = 400_000) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between tasks.

    Remembered chunks take about 0.2 KB each, in every worker that a task was in.
    """
    if (path, capacity) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, capacity] = Encoder(path, capacity)
    return _ENCODERS[path, capacity]
