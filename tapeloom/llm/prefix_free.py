"""Byte-level removal of repeated passages over a prefix-free parse of the corpus.

Every 100-byte string (window) of a text has a trigger: the smallest rolling hash of the `GRAM`-byte strings inside it. Maximal
runs of windows with one trigger are the phrases of the parse: equal windows have equal triggers wherever they stand, so a
repeated window lies in phrases of one trigger. The dictionary holds each distinct phrase once, with its first place.

* A phrase that is not at its first place repeats as a whole. Each block of text sends a phrase to the shuffle once, however
  often it has it, so a passage that a third of all documents share costs one row a block.
* Distinct phrases that share a trigger may still share windows. Their suffixes of at least a window are put in order over all
  of them, by the hash of the suffix's first 100 bytes and then by place in the corpus: the first of equal ones stays.
  Phrases alone on their trigger, most of the corpus, never get that far.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import small_batches, staged
from tapeloom.llm.textblocks import _BYTE_VALUES, U64, Block, blocks, mix

LENGTH = 100                # bytes of a window
GRAM = 24                   # bytes of the rolling hash that triggers
PIECE = 64                  # windows of a phrase at most: a longer run (periodic text) is cut


def _rolling(values: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Hashes of the strings of each power-of-two size that start at each byte (too short at the end of the block)."""
    out, size, h = {}, 1, values
    while True:
        if size in sizes:
            out[size] = h
        if size >= max(sizes):
            return out
        nxt = h.copy()
        nxt *= U64(0x9E3779B97F4A7C15) + U64(2 * size)
        nxt[:-size] += h[size:]
        nxt ^= nxt >> U64(29)
        h, size = nxt, 2 * size


def _sum_of_powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length()) if n >> k & 1][::-1]


def _string_hashes(rolled: dict[int, np.ndarray], length: int, n: int) -> np.ndarray:
    """Hash of the `length` bytes at each of the first n places."""
    out, at = np.zeros(n, dtype=np.uint64), 0
    for size in _sum_of_powers(length):
        out = (out * U64(0xC2B2AE3D27D4EB4F)) + rolled[size][at:at + n]
        out ^= out >> U64(32)
        at += size
    return mix(out)


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    out, size = x, 1
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class Parse:
    """Windows and phrases of a block: phrase i covers the windows first[i]..last[i] of row[i]."""

    def __init__(self, block: Block):
        n = len(block.data) - LENGTH + 1
        self.windows = np.zeros(0, dtype=np.uint64)
        self.first = self.last = self.row = np.zeros(0, dtype=np.int64)
        self.trigger = self.name = np.zeros(0, dtype=np.uint64)
        self.inner = np.zeros(0, dtype=bool)
        lengths = block.ends - block.starts
        if n <= 0 or not (lengths >= LENGTH).any():
            return
        rolled = _rolling(_BYTE_VALUES[block.data], sorted({*_sum_of_powers(LENGTH), *_sum_of_powers(GRAM)}))
        grams = _string_hashes(rolled, GRAM, len(block.data) - GRAM + 1)
        self.windows = _string_hashes(rolled, LENGTH, n)
        least = _sliding_minimum(grams, LENGTH - GRAM + 1)
        # Windows that start in one row and end in it.
        valid = np.zeros(n + 1, dtype=np.int8)
        opens, closes = block.starts[lengths >= LENGTH], block.ends[lengths >= LENGTH] - LENGTH + 1
        np.add.at(valid, opens, 1)
        np.add.at(valid, closes, -1)
        valid = np.cumsum(valid[:-1]) > 0
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        begins[opens] = True
        first = np.flatnonzero(begins)
        last = np.append(first[1:], n) - 1
        row = np.searchsorted(block.starts, first, side="right") - 1
        # Empty rows share their start with the next row: the window belongs to the row that ends after it.
        last = np.minimum(last, block.ends[row] - LENGTH)
        pieces = (last - first) // PIECE + 1
        if pieces.max() > 1:
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            row, end, first = np.repeat(row, pieces), np.repeat(last, pieces), np.repeat(first, pieces) + nth * PIECE
            last = np.minimum(first + PIECE - 1, end)
        self.first, self.last, self.row = first, last, row
        self.trigger = least[first]
        self.inner = self._inner_repeats(grams, least, n)
        # The first and the last window cover the phrase.
        self.name = mix(self.windows[first] * U64(0x9FB21C651E98DF25) + self.windows[last] + (last - first).astype(np.uint64))

    def _inner_repeats(self, grams: np.ndarray, least: np.ndarray, n: int) -> np.ndarray:
        """Phrases that may hold a window twice: their trigger stands in them twice, as in periodic text."""
        width = LENGTH - GRAM + 1
        # A gram triggers a window around it where the largest of those windows' minima is its own hash.
        around = ~_sliding_minimum(~np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
        at = np.flatnonzero(grams == around[:len(grams)])
        order = np.argsort(grams[at], kind="stable")
        near = at[order]
        pair = np.flatnonzero((grams[near[1:]] == grams[near[:-1]]) & (near[1:] - near[:-1] <= width))
        marked = np.zeros(n + 1, dtype=np.int32)
        begin, end = near[pair + 1] - width + 1, near[pair]
        low, high = np.maximum(np.minimum(begin, end), 0), np.minimum(np.maximum(begin, end) + 1, n)
        np.add.at(marked, np.minimum(low, n), 1)
        np.add.at(marked, np.maximum(high, np.minimum(low, n)), -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(marked[:-1]) > 0)])
        return total[self.last + 1] > total[self.first]


NULL_ID = -2**63            # a null doc_id comes before every other
HOT = 50_000                # phrases of a trigger that one task compares window by window in memory
REPEAT, OPEN, CROWDED = 0, 1, 2
_PLACE = "doc_id long, part int"


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _first_in_block(place: np.ndarray, start: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come first (by place, then start) with their keys, and rows with the keys of an earlier place."""
    order = np.lexsort((start, place, *keys[::-1]))
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for key in keys:
        same &= key[order][1:] == key[order][:-1]
    new = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, dtype=bool)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = ~new & ((place[order] != place[head]) | (start[order] != start[head]))
    return order[new], order[later]


def _place_ranks(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    order = np.lexsort((parts, ids))
    new = np.ones(len(order), dtype=np.int64)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (parts[order][1:] != parts[order][:-1])
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


# Marks of a phrase: first of its block; holds a window twice, perhaps; an earlier one of its block is equal.
PLAIN, INNER, KNOWN = 0, 1, 2
# code: 48 bits of the name, 14 bits of last - first, 2 bits of the mark; spot: part and first. Few bytes to shuffle.
PHRASES = "trigger long, code long, doc_id long, spot long"


def _phrase_batch(trigger, name, ids, parts, first, last, mark) -> pa.RecordBatch:
    code = (name & ~U64(0xFFFF)) | ((last - first).astype(np.uint64) << U64(2)) | mark.astype(np.uint64)
    spot = (parts.astype(np.int64) << 32) | first.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (trigger.view(np.int64), code.view(np.int64), ids, spot)], names=["trigger", "code", "doc_id", "spot"])


def _sent(trigger, name, ids, parts, place, first, last, inner) -> Iterator[pa.RecordBatch]:
    """A block's phrases: the first of equal ones, and the others as known repeats."""
    heads, later = _first_in_block(place, first, trigger, name)
    for rows, marks in ((heads, np.where(inner, INNER, PLAIN)), (later, np.full(len(inner), KNOWN))):
        for lo in range(0, len(rows), 50_000):
            r = rows[lo:lo + 50_000]
            yield _phrase_batch(trigger[r], name[r], ids[r], parts[r], first[r], last[r], marks[r])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of every text, block by block."""
    for batch in batches:
        ids, parts = _numpy(batch, "doc_id"), _numpy(batch, "part")
        for block in blocks(batch.column("text")):
            parse = Parse(block)
            if len(parse.first):
                own_ids, own_parts = ids[block.lo:block.hi][parse.row], parts[block.lo:block.hi][parse.row]
                at = block.starts[parse.row]
                ranks = _place_ranks(ids[block.lo:block.hi], parts[block.lo:block.hi])[parse.row]
                yield from _sent(parse.trigger, parse.name, own_ids, own_parts, ranks, parse.first - at, parse.last - at, parse.inner)


class _Order:
    """State of a pass over phrases in the order of (trigger, name, place), across batches."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.trigger = self.name = self.place = self.held = None
        self.names = 0

    def step(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        trigger, code, ids, spot = [_numpy(batch, c) for c in ("trigger", "code", "doc_id", "spot")]
        parts, first, mark = spot >> 32, spot & 0x7FFFFFFF, code & 3
        name, last = code >> 16, first + ((code & 0xFFFF) >> 2)
        known = mark == KNOWN
        if known.any():
            yield _found(REPEAT, *[x[known] for x in (ids, parts, first, last)])
            trigger, name, ids, parts, first, last, mark = [x[~known] for x in (trigger, name, ids, parts, first, last, mark)]
        if not len(trigger):
            return
        inner = mark == INNER
        n = len(trigger)
        new_trigger, new_name = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        new_trigger[1:] = trigger[1:] != trigger[:-1]
        new_trigger[0] = self.trigger is None or trigger[0] != self.trigger
        new_name[1:] = name[1:] != name[:-1]
        new_name[0] = self.name is None or name[0] != self.name
        new_name |= new_trigger
        head = np.maximum.accumulate(np.where(new_name, np.arange(n), -1))
        # Rows with the place of the first are that row again, from a repeated input row.
        same = (ids == ids[head]) & (parts == parts[head]) & (first == first[head])
        if self.place is not None:
            carried = head < 0
            same[carried] = (ids[carried] == self.place[0]) & (parts[carried] == self.place[1]) & (first[carried] == self.place[2])
        later = ~new_name & ~same
        yield _found(REPEAT, ids[later], parts[later], first[later], last[later])

        # Distinct phrases by trigger; group 0 goes on from the last batch unless the first row opens a trigger.
        heads = np.flatnonzero(new_name)
        group = np.cumsum(new_trigger)[heads]
        counts = np.bincount(group, minlength=int(new_trigger.sum()) + 1)
        counts[0] += self.names
        if self.held is not None and counts[0] > 1:
            yield _found(OPEN, *self.held)
            self.held = None
        ends = np.flatnonzero(counts[:-1] > self.most)
        if len(ends):
            starts = np.flatnonzero(new_trigger)
            names = np.array([self.trigger if g == 0 else trigger[starts[g - 1]] for g in ends], dtype=np.int64)
            zero = np.zeros(len(names), dtype=np.int64)
            yield _found(CROWDED, zero, zero, zero, zero, names)
        final = len(counts) - 1
        several = heads[(counts[group] > 1) | inner[heads]]
        yield _found(OPEN, ids[several], parts[several], first[several], last[several])
        if counts[final] == 1 and len(heads) and group[-1] == final:
            i = heads[-1:]
            self.held = None if inner[i[0]] else [c[i] for c in (ids, parts, first, last)]
        elif counts[final] != 1:
            self.held = None
        self.names = int(counts[final])
        if len(heads):
            i = heads[-1]
            self.place = (ids[i], parts[i], first[i])
        self.trigger, self.name = trigger[-1], name[-1]

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.names > self.most:
            zero = np.zeros(1, dtype=np.int64)
            yield _found(CROWDED, zero, zero, zero, zero, np.array([self.trigger], dtype=np.int64))


FOUND = f"kind int, {_PLACE}, first int, last int, trigger long"


def _found(kind: int, ids, parts, first, last, trigger=None) -> pa.RecordBatch:
    """Places of one kind; the trigger is named only where it is crowded."""
    named = pa.nulls(len(ids), pa.int64()) if trigger is None else pa.array(trigger)
    columns = [np.full(len(ids), kind, dtype=np.int32), ids, parts.astype(np.int32), first.astype(np.int32), last.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), named], names=["kind", "doc_id", "part", "first", "last", "trigger"])


def _resolve(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    state = _Order(most)
    for batch in batches:
        yield from (out for out in state.step(batch) if out.num_rows)
    yield from state.close()


def _in_order(phrases: DataFrame, most: int) -> DataFrame:
    """First places and repeats of phrases. Known repeats only pass through; they are dealt out by place, not by trigger."""
    route = F.when(F.col("code").bitwiseAND(3) == KNOWN, F.xxhash64("doc_id", "spot")).otherwise(F.col("trigger"))
    dealt = phrases.repartition(route)
    return dealt.sortWithinPartitions("trigger", F.shiftright("code", 16), "doc_id", "spot").mapInArrow(lambda batches: _resolve(batches, most), FOUND)


def _open_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the open phrases of each text."""
    for batch in batches:
        ids, parts, lists = _numpy(batch, "doc_id"), _numpy(batch, "part"), batch.column("open")
        for block in blocks(batch.column("text")):
            own = lists.slice(block.lo, block.rows)
            starts = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts += np.repeat(block.starts, np.array([len(x) for x in own], dtype=np.int64))
            parse = Parse(block)
            at = np.flatnonzero(np.isin(parse.first, starts))
            row, first, last = parse.row[at], parse.first[at], parse.last[at]
            spot = (parts[block.lo:block.hi][row].astype(np.int64) << 32) | (first - block.starts[row])
            data = block.data.tobytes()
            for lo in range(0, len(at), 20_000):
                s = slice(lo, lo + 20_000)
                texts = [data[a:b + LENGTH] for a, b in zip(first[s].tolist(), last[s].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(parse.trigger[at[s]].view(np.int64)), pa.array(ids[block.lo:block.hi][row[s]]), pa.array(spot[s]), pa.array(texts, pa.binary())],
                                                 names=["trigger", "doc_id", "spot", "bytes"])


class _Windows:
    """Windows of phrases given by their bytes: the phrase of each, its offset in it, and its hash."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        counts = sizes - LENGTH + 1
        self.row = np.repeat(np.arange(len(sizes)), counts)
        self.offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes = _string_hashes(_rolling(_BYTE_VALUES[data], _sum_of_powers(LENGTH)), LENGTH, len(data) - LENGTH + 1)
        self.hashes = hashes[(np.cumsum(sizes) - sizes)[self.row] + self.offset]


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the phrases as a phrase of its own."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 20_000):
            part = batch.slice(lo, 20_000)
            ids, spot = _numpy(part, "doc_id"), _numpy(part, "spot")
            w = _Windows(part.column("bytes").to_pylist())
            ids, parts, first = ids[w.row], spot[w.row] >> 32, (spot[w.row] & 0x7FFFFFFF) + w.offset
            yield from _sent(w.hashes, w.hashes, ids, parts, _place_ranks(ids, parts), first, first, np.zeros(len(ids), dtype=bool))


def _maybe_repeated(keys: np.ndarray) -> np.ndarray:
    """Rows whose key another row may have: those that share their key's leading bits. The others need no sorting."""
    bits = (4 * len(keys)).bit_length()
    slot = (keys >> U64(64 - bits)).astype(np.int64) if len(keys) else np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.bincount(slot, minlength=1)[slot] > 1)


def _window_repeats(rows: pa.Table) -> pa.RecordBatch:
    """Whole trigger groups of phrases in the order of (trigger, place): runs of windows that an earlier phrase of the group has."""
    trigger, ids, spot = [rows.column(c).to_numpy() for c in ("trigger", "doc_id", "spot")]
    parts, first = spot >> 32, spot & 0x7FFFFFFF
    w = _Windows(rows.column("bytes").to_pylist())
    row, place = w.row, first[w.row] + w.offset
    keys = mix(w.hashes + trigger.view(np.uint64)[row] * U64(0x9FB21C651E98DF25))
    several = _maybe_repeated(keys)
    _, index, inverse = np.unique(keys[several], return_index=True, return_inverse=True)
    head, own = several[index[inverse]], row[several]
    at = several[(ids[own] != ids[row[head]]) | (parts[own] != parts[row[head]]) | (place[several] != place[head])]
    breaks = np.ones(len(at), dtype=bool)
    breaks[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    opens = at[breaks]
    closes = at[np.append(np.flatnonzero(breaks)[1:], len(at)) - 1] if len(at) else at
    r = row[opens]
    return _found(REPEAT, ids[r], parts[r], place[opens], place[closes])


def _compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        trigger = _numpy(batch, "trigger")
        change = np.flatnonzero(trigger[1:] != trigger[:-1]) + 1
        if held and trigger[0] != held[-1].column("trigger")[-1].as_py():
            change = np.append(change, 0)
        if not len(change):
            held.append(batch)
            continue
        cut = int(change.max())
        yield _window_repeats(pa.Table.from_batches([*held, batch.slice(0, cut)]))
        held = [batch.slice(cut)]
    if held and sum(b.num_rows for b in held):
        yield _window_repeats(pa.Table.from_batches(held))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the repeated windows of each text and cut what they cover."""
    for batch in batches:
        texts, runs = batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("runs").to_pylist()
        size, removed, spans, kept, ranges = [], [], [], [], []
        for text, own in zip(texts, runs, strict=True):
            text = text or b""
            merged: list[list[int]] = []
            for first, last in sorted((run["first"], run["last"]) for run in own or ()):
                if merged and first <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], last + LENGTH)
                else:
                    merged.append([first, last + LENGTH])
            parts, at = [], 0
            for begin, end in merged:
                parts.append(text[at:begin])
                at = end
            left = b"".join([*parts, text[at:]])
            size.append(len(text))
            removed.append(len(text) - len(left))
            spans.append(len(merged))
            kept.append(left)
            ranges.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                                          pa.array(kept, pa.binary()), pa.array(ranges, pa.list_(pa.list_(pa.int32())))],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes", "removed_ranges"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = HOT) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans (long), kept_bytes (binary), removed_ranges ([begin, end) bytes).

    Removed is each byte that a 100-byte string covers which also starts earlier: in a smaller doc_id, or in the same text
    before. Texts are whole and are judged as they came in. `key` is an integer; a null key comes before all others. A null
    text counts as empty. A repeated row (equal key and text) is the same place again: it gets the same answer, and neither
    removes the other; rows that share a key but not the text are ordered by the hash of the text. No rows, no result.
    """
    spark = small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.hash(text).alias("part"), F.col(text).alias("text"))
    found = staged(_in_order(rows.mapInArrow(_parse, PHRASES), most))
    crowded = staged(found.filter(F.col("kind") == CROWDED).select("trigger").distinct())
    lists = found.filter(F.col("kind") == OPEN).groupBy("doc_id", "part").agg(F.collect_list("first").alias("open"))
    marked = rows.join(lists, ["doc_id", "part"]).select("doc_id", "part", "text", "open")
    phrases = marked.mapInArrow(_open_phrases, "trigger long, doc_id long, spot long, bytes binary").repartition("trigger")
    calm = phrases
    if not crowded.isEmpty():
        phrases = staged(phrases)
        calm = phrases.join(crowded, "trigger", "left_anti").repartition("trigger")
    runs = found.filter(F.col("kind") == REPEAT).unionByName(staged(calm.sortWithinPartitions("trigger", "doc_id", "spot").mapInArrow(_compare_windows, FOUND)))
    if not crowded.isEmpty():
        windows = phrases.join(crowded, "trigger", "left_semi").mapInArrow(_single_windows, PHRASES)
        runs = runs.unionByName(staged(_in_order(windows, most).filter(F.col("kind") == REPEAT)))
    by_text = runs.groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = rows.join(by_text, ["doc_id", "part"], "left").select("doc_id", "text", "runs")
    cut = joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary, removed_ranges array<array<int>>")
    original = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).cast(kind).alias(key)
    return cut.select(original, "n_bytes", "n_removed", "n_spans", "kept_bytes", "removed_ranges")
