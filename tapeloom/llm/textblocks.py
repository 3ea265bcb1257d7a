"""Vectorised words, hashes and windows over Arrow string columns.

A task sees its rows as Arrow batches; `blocks` cuts them into runs of whole rows of about BLOCK_BYTES of text, so that the
numpy frames of a task stay bounded whatever the batch holds (one longer text is a block of its own). Texts are handled as
UTF-8 bytes and are never cut.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000
U64 = np.uint64

# Word separators: \x20 and \x09-\x0D, or everything in ASCII but digits and lower-case letters.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE_VALUES = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256).astype(np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = U64(0xD6E8FEB86659FD93)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return x.view(np.int64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(max(n, BLOCK_BYTES), base, dtype=np.uint64)
            table[0] = 1
            _POWERS[i] = np.multiply.accumulate(table)
    return _POWERS[0][:n], _POWERS[1][:n]


class Block:
    """Rows lo..hi of a batch: their bytes end to end, and where each row starts and ends."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.lo, self.hi, self.data, self.starts, self.ends = lo, hi, data, starts, ends

    @property
    def rows(self) -> int:
        return self.hi - self.lo


class Words:
    """Words of a block in order: byte ranges, row of each, and words before each row."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, row: np.ndarray, first: np.ndarray):
        self.begin, self.end, self.row, self.first = begin, end, row, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(column: pa.ChunkedArray | pa.Array) -> Iterator[Block]:
    """Cut a string column (nulls count as empty) into blocks of whole rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, side="right")) - 1)
        hi = min(hi, n)
        base = offsets[lo]
        yield Block(lo, hi, data[base:offsets[hi]], offsets[lo:hi] - base, offsets[lo + 1:hi + 1] - base)
        lo = hi


def row_of(block: Block) -> np.ndarray:
    """Row number of every byte."""
    return np.repeat(np.arange(block.rows, dtype=np.int32), block.ends - block.starts)


def find_words(block: Block, data: np.ndarray, separators: np.ndarray) -> Words:
    """Maximal runs of non-separator bytes, never across rows. `data` are the block's bytes, possibly lower-cased."""
    inside = ~separators[data]
    begin, end = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    begin[:-1] = inside
    begin[1:-1] &= ~inside[:-1]
    end[1:] = inside
    end[1:-1] &= ~inside[1:]
    full = block.starts[block.starts < block.ends]
    begin[full] = inside[full]
    cut = full[full > 0]
    end[cut] |= inside[cut - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    first = np.searchsorted(begin, np.append(block.starts, len(data)))
    row = np.repeat(np.arange(block.rows, dtype=np.int32), np.diff(first))
    return Words(begin, end, row, first)


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range [begin, end); equal bytes give equal hashes wherever they stand."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[:len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * _STEP)


def shingles(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every `width` consecutive words, and the index of its first word; rows with fewer words have none here."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * _BASE + hashes[k:k + n]
    at = np.flatnonzero(words.row[:n] == words.row[width - 1:])
    return mix(out[at] + U64(width)), at


def whole_sequence(hashes: np.ndarray) -> np.uint64:
    """Hash of a short text's words as one shingle."""
    total = U64(0)
    with np.errstate(over="ignore"):
        for h in hashes:
            total = total * _BASE + h
    return mix(np.array([total + U64(len(hashes))], dtype=np.uint64))[0]
