"""Counts over whole texts that the quality operators judge by."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeloom.llm.frames import add_columns, row_totals
from tapeloom.llm.textblocks import SPACES, U64, Block, blocks, find_words, mix, range_hashes, row_of, shingles

WINDOW = 5
# name -> what it counts in a text
STATS = {
    "n_words": "maximal runs of characters other than space and \\t-\\r",
    "word_chars": "code points in words",
    "n_symbols": "characters of [#*$%&|<>]",
    "n_lines": "\\n-split lines that have a word",
    "n_dup_lines": "such lines that equal an earlier line",
    "n_repeat_words": "words in 5-word windows that the text has twice or more",
    "n_upper": "A-Z",
    "n_digits": "0-9",
    "n_shouts": "! characters",
    "n_pipes": "| characters",
    "n_stops": "characters of [.?!]",
    "n_commas": "commas",
    "n_distinct_words": "different words",
}


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in characters]] = True
    return table


_CLASSES = {"n_symbols": _table("#*$%&|<>"), "n_upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_digits": _table("0123456789"),
            "n_shouts": _table("!"), "n_pipes": _table("|"), "n_stops": _table(".?!"), "n_commas": _table(",")}


def _per_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def _in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that tell equal values of different rows apart."""
    return mix(hashes + (rows.astype(np.uint64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F))


def block_stats(block: Block) -> dict[str, np.ndarray]:
    """All counts for the rows of a block."""
    data, n = block.data, block.rows
    words = find_words(block, data, SPACES)
    hashes = range_hashes(data, words.begin, words.end)
    out = {"n_words": words.counts.astype(np.int64)}
    out["word_chars"] = row_totals(~SPACES[data] & ((data & 0xC0) != 0x80), block.starts, block.ends)
    for name, table in _CLASSES.items():
        out[name] = row_totals(table[data], block.starts, block.ends)

    # Lines: from a row's start or after a newline, to the next newline or the row's end.
    filled = block.starts < block.ends
    row = row_of(block)
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.concatenate([block.starts[filled], breaks + 1])
    end = np.concatenate([block.ends[filled], breaks])
    begin.sort()
    end.sort()
    # A newline that ends its row opens one more, empty line there; it has no word, and it sorts as an empty range.
    worded = np.searchsorted(words.begin, end) > np.searchsorted(words.begin, begin)
    begin, end = begin[worded], end[worded]
    rows = row[begin]
    lines = _in_row(range_hashes(data, begin, end), rows)
    _, first = np.unique(lines, return_index=True)
    again = np.ones(len(lines), dtype=bool)
    again[first] = False
    out["n_lines"], out["n_dup_lines"] = _per_row(rows, n), _per_row(rows[again], n)

    found, at = shingles(words, hashes, WINDOW)
    _, inverse, times = np.unique(_in_row(found, words.row[at]), return_inverse=True, return_counts=True)
    at = at[times[inverse] > 1]
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    out["n_repeat_words"] = _per_row(words.row[np.cumsum(edge[:-1]) > 0], n)
    _, first = np.unique(_in_row(hashes, words.row), return_index=True)
    out["n_distinct_words"] = _per_row(words.row[first], n)
    return out


def with_text_stats(docs: DataFrame, text: str = "text", names=tuple(STATS)) -> DataFrame:
    """Append the named counts (long) of whole texts; a null text counts as empty, all its counts are 0."""
    position = docs.columns.index(text)
    names = list(names)

    def compute(batch: pa.RecordBatch) -> list:
        parts = [block_stats(block) for block in blocks(batch.column(position))]
        return [np.concatenate([part[name] for part in parts]) if parts else np.zeros(0, dtype=np.int64) for name in names]

    clash = {name.lower() for name in names}
    position = [c for c in docs.columns if c.lower() not in clash].index(text)
    return add_columns(docs, [(name, T.LongType()) for name in names], compute)
