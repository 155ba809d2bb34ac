"""Token ids exactly as the tokenizers library gives them, fast on text that
repeats its words.

The byte-level BPE files first cut a text into pieces and then merge within
each piece. Between a character that isn't white space and a lone space or
newline before another such character there is always a cut, so the units
between such places can be encoded one by one by the library, and each
distinct unit once. Files that drop white space have a cut at any of it.
Runs of white space stay inside their unit; a text with white space beyond
ASCII's is a unit of its own.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textblocks import Block, text_blocks

#: Distinct units remembered, about 200 bytes each; beyond it the memory starts anew.
MEMORY = 600_000
LONGEST = 48
#: Bytes of text whose distinct units are looked up together.
BLOCK_BYTES = 6 << 20
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_STOPS = (".", ",")
#: How byte-level files write bytes that aren't printable: as letters from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Memory(dict):
    """Units and their ids; a unit seen for the first time is encoded.

    A run of Latin letters is one piece, a space before it or not, and so are
    a newline before it and a point or comma after it: such a piece goes to the
    library's model straight away, which is what the library does after
    cutting."""

    def __init__(self, owner: Encoder):
        self.owner = owner

    def __missing__(self, unit: str) -> bytes:
        owner, head = self.owner, unit[:1]
        body = unit[1:] if head in (" ", "\n") else unit
        stem = body[:-1] if body[-1:] in _STOPS else body
        if not _LETTERS(stem):
            found = owner.encode(unit)
        elif head == "\n":
            found = self["\n"] + self[body]
        elif stem is not body:
            found = self[unit[:-1]] + self[unit[-1]]
        elif owner.folds and not unit.islower():
            found = self[unit.lower()]
        else:
            found = owner.merge(unit)
        if len(unit) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[unit] = found
        return found


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        a, b, c = [self._library.encode(x, add_special_tokens=False).ids for x in ("a b", "a  \n b", "A B")]
        self.drops, self.folds = a == b, a == c
        self._memory = _Memory(self)

    def encode(self, text: str) -> bytes:
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def merge(self, piece: str) -> bytes:
        """Ids of one piece of Latin letters, a space before it or not."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        tokens = self._model.tokenize(piece.replace(" ", _BYTE_LETTERS[32]))
        return array("I", [t.id for t in tokens]).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        found = [ids.tobytes() for _, _, ids, _ in self.blocks(pa.array([text]))]
        return found[0]

    def blocks(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, bounds): ids of row k of a block are
        ids[bounds[k] : bounds[k + 1]]. A null is an empty text."""
        for i, j, block in text_blocks(texts, BLOCK_BYTES):
            values, index, bounds = self._units(block)
            known = [self._memory[u] for u in values]
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            flat = np.frombuffer(b"".join(known), "<u4")
            size = sizes[index]
            ends = np.concatenate(([0], np.cumsum(size)))
            at = np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], size) + np.arange(ends[-1])
            yield i, j, flat[at], ends[bounds]

    def _units(self, block: Block) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units, the one at each place, and each text's bounds among the places."""
        data = block.data
        if self.drops:
            offsets = np.concatenate(([0], np.cumsum(block.ends - block.starts)))
            data, bounds = data[block.solid], block.bounds
        else:
            cut = np.zeros(len(data) + 1, bool)
            lone = (data[1:-1] == 32) | (data[1:-1] == 10)
            cut[1:-2] = lone & block.solid[:-2] & block.solid[2:]
            for k in _with_rare_spaces(block):
                cut[block.offsets[k] : block.offsets[k + 1]] = False
            cut[block.offsets] = True
            offsets = np.flatnonzero(cut)
            bounds = np.searchsorted(offsets, block.offsets)
        if len(offsets) < 2:
            return [], np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64)
        kind, width = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
        buffers = [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(data))]
        units = pa.Array.from_buffers(kind, len(offsets) - 1, buffers).dictionary_encode()
        return units.dictionary.to_pylist(), units.indices.to_numpy(), bounds


def _with_rare_spaces(block: Block) -> np.ndarray:
    """Texts with white space, or what may be, other than ASCII's blanks."""
    d = block.data
    hit = (d >= 0x1C) & (d <= 0x1F)
    two = (d[:-1] == 0xC2) & ((d[1:] == 0x85) | (d[1:] == 0xA0))
    hit[:-1] |= two | (d[:-1] == 0xE1) & (d[1:] == 0x9A) | (d[:-1] == 0xE3) & (d[1:] == 0x80)
    hit[:-1] |= (d[:-1] == 0xE2) & ((d[1:] == 0x80) | (d[1:] == 0x81))
    return np.unique(np.searchsorted(block.offsets, np.flatnonzero(hit), "right") - 1)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    return Encoder(path)


@lru_cache(maxsize=16)
def version_digest(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
