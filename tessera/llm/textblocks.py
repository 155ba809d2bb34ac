"""Vectorised views of text columns: words, lines, runs of words.

Arrow string arrays are cut into blocks of whole texts with a bounded number
of bytes, and each block is handled as one byte array with numpy. White space
is ASCII only, so bytes suffice to find words and lines in UTF-8. Within a block
words and lines are told apart as strings, through Arrow's dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

BLOCK_BYTES = 2 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


#: The lowest 0 to 8 bytes of a little-endian word.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 256
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def encode_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct byte strings among the ranges [start, end), and which of them
    each range is. Ranges are in order, don't overlap, and are where `inside` is true."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    kind, width = (pa.binary(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    buffers = [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    found = pa.Array.from_buffers(kind, len(starts), buffers).dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): eight bytes at a time are
    taken in and mixed; ranges above LONG bytes go to xxhash."""
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    out = mix(size.astype(np.uint64) + np.uint64(1))
    own = np.flatnonzero(size <= LONG)
    at, left = starts[own], size[own]
    with np.errstate(over="ignore"):
        while len(own):
            lane = lanes[at] & _LOW_BYTES[np.minimum(left, 8)]
            out[own] = mix((out[own] ^ lane) * _ODD)
            more = np.flatnonzero(left > 8)
            own, at, left = own[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG):
        out[k] = xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


class Block:
    """Some texts as one byte array. `offsets` bounds them: text k is
    data[offsets[k] : offsets[k + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.solid = ~_BLANK[data]
        left = self.solid.copy()
        left[1:] &= ~self.solid[:-1]
        right = self.solid.copy()
        right[:-1] &= ~self.solid[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        left[edges] = self.solid[edges]
        right[edges - 1] = self.solid[edges - 1]
        self.starts = np.flatnonzero(left)
        self.ends = np.flatnonzero(right) + 1
        #: Words of text k are words[bounds[k] : bounds[k + 1]].
        self.bounds = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.bounds)

    def words(self, fold_case: bool = False) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, A-Z lower-cased if asked, and the one at each place."""
        return encode_spans(_FOLD[self.data] if fold_case else self.data, self.starts, self.ends, self.solid)

    def word_hashes(self, fold_case: bool = False) -> np.ndarray:
        return span_hashes(_FOLD[self.data] if fold_case else self.data, self.starts, self.ends)

    def normal_digests(self) -> list[bytes | None]:
        """SHA-256 of each text's words, A-Z lower-cased, one space between
        them; none for a text without words."""
        kept = self.solid.copy()
        last = np.zeros(len(self.starts), bool)
        last[self.bounds[1:][self.n_words > 0] - 1] = True
        kept[self.ends[~last]] = True
        data = np.where(self.solid, _FOLD[self.data], np.uint8(32))[kept].tobytes()
        at = np.concatenate(([0], np.cumsum(kept)))[self.offsets].tolist()
        return [sha256(data[a:b]).digest() if b > a else None for a, b in zip(at[:-1], at[1:])]

    def line_ids(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal numbers for equal lines, given as ranges in order."""
        edges = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, ends, -1)
        return encode_spans(self.data, starts, ends, np.cumsum(edges[:-1]) > 0)[1]

    def of_word(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(self.n), self.n_words)

    def count(self, where: np.ndarray) -> np.ndarray:
        """How many bytes of each text are true in `where`."""
        return np.diff(np.searchsorted(np.flatnonzero(where), self.offsets))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each line, and the text it belongs to; a text with
        k newlines has k + 1 lines."""
        breaks = np.flatnonzero(self.data == 10)
        of_break = np.searchsorted(self.offsets, breaks, "right") - 1
        of = np.concatenate((np.arange(self.n), of_break))
        starts = np.concatenate((self.offsets[:-1], breaks + 1))
        order = np.lexsort((starts, of))
        of, starts = of[order], starts[order]
        ends = np.append(starts[1:] - 1, self.offsets[-1])
        last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
        ends[last] = self.offsets[1:][of[last]]
        return starts, ends, of


def exact_runs(ids: np.ndarray, of: np.ndarray, size: int, apart: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of `size` ids within one text, and a number that
    equal runs share with no other run; `apart` keeps runs of different texts apart."""
    total = max(len(ids) - size + 1, 0)
    first = np.flatnonzero(of[:total] == of[size - 1 : size - 1 + total])
    key, bound = of[first] * apart, int(of[-1]) * apart + 1 if len(of) else 1
    wide = int(ids.max()) + 1 if len(ids) else 1
    for k in range(size):
        if bound * wide >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1]
            bound = len(key) + 1
        key, bound = key * wide + ids[first + k], bound * wide
    return first, key


def windows(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words within each text, and bounds of each
    text's runs."""
    runs = np.maximum(np.diff(bounds) - size + 1, 0)
    out_bounds = np.concatenate(([0], np.cumsum(runs)))
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    total = len(words) - size + 1
    first = np.repeat(bounds[:-1] - out_bounds[:-1], runs) + np.arange(out_bounds[-1])
    return _chain([words[k : k + total] for k in range(size)])[first], out_bounds


def _chain(parts: list) -> np.ndarray:
    """Hash of a sequence of hashes, mixed anew at every step."""
    with np.errstate(over="ignore"):
        h = mix(np.asarray(parts[0], np.uint64) + np.uint64(len(parts)))
        for part in parts[1:]:
            h = mix(h * _ODD + part)
    return h


def shingles(block: Block, size: int, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All runs of `size` words of each text, with a text of fewer words (one
    at least) giving its whole sequence, and their bounds."""
    words = block.word_hashes(fold_case)
    runs, bounds = windows(words, block.bounds, size)
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < size))
    if not len(short):
        return runs, bounds
    extra = np.empty(len(short), np.uint64)
    for n in range(1, size):
        own = block.n_words[short] == n
        if own.any():
            extra[own] = _chain([words[block.bounds[short[own]] + k] for k in range(n)])
    return np.insert(runs, bounds[short], extra), bounds + np.concatenate(([0], np.cumsum(np.isin(np.arange(block.n), short))))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys stand there more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, block) for runs of rows of a string column; a text
    larger than the limit is a block of its own, a null is an empty text."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if part.null_count:
            part = part.fill_null("")
        yield from _array_blocks(part.cast(pa.large_string()), limit)


def _array_blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, int, Block]]:
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, j, Block(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j
