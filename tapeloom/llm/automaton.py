"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of all items (one start state, items added one after another) accepts every run of consecutive words of any item.
Documents are streamed through it word by word: it always knows the longest run ending at the current word that some item
contains. Where that run reaches an item window (`WINDOW` words, or a whole shorter item), its words are hit.

A word that no item has resets the automaton, so only stretches of item words are walked; finding these is vectorised. The items
travel to the tasks as automata of at most `max_words` words each: a larger benchmark is cut into several, each a pass of its own
over the documents, and the passes' hits are united per document.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.frames import small_batches, staged, without
from tapeloom.llm.textblocks import LOWER, NON_ALNUM, U64, Block, Words, blocks, find_words, range_hashes

WINDOW = 10
MAX_WORDS = 100_000
OWN = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_bytes")


class SuffixAutomaton:
    """States are sets of word runs that end at the same places of the items; `length` is a state's longest run."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[int]] = [set()]      # items with an occurrence that ends here
        self.whole: list[set[tuple[int, int]]] = [set()]   # items shorter than a window that end here in full, with their words

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        self.whole.append(set())
        return len(self.length) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """Give the part of `child` reached from `parent` in one word a state of its own."""
        copy = self._state(self.length[parent] + 1, dict(self.step[child]), self.link[child])
        self.link[child] = copy
        while parent >= 0 and self.step[parent].get(word) == child:
            self.step[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        found = self.step[last].get(word)
        if found is not None:
            return found if self.length[found] == self.length[last] + 1 else self._split(last, word, found)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            child = self.step[at][word]
            self.link[new] = child if self.length[child] == self.length[at] + 1 else self._split(at, word, child)
        return new

    def finish(self, items: list[tuple[int, list[int]]], window: int) -> None:
        """Add the items, then note for each state the items that its runs occur in."""
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        for item, words in items:
            at = 0
            for word in words:
                at = self.step[at][word]
                self.ends[at].add(item)
            if 0 < len(words) < window:
                self.whole[at].add((item, len(words)))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]


class Matcher:
    """An automaton over the word numbers of a vocabulary, and the sizes that windows have."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int = WINDOW):
        hashes = [h for _, h in items]
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, dtype=np.uint64)
        self.window, self.automaton = window, SuffixAutomaton()
        numbered = [(item, np.searchsorted(self.vocabulary, h).tolist()) for item, h in items]
        self.automaton.finish(numbered, window)
        self.least = min((min(len(words), window) for _, words in numbered if words), default=window)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; -1 for a word that no item has."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def walk(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges and the items found in a stretch of item words."""
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        ends, whole, window = self.automaton.ends, self.automaton.whole, self.window
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        at = run = 0
        for i, word in enumerate(words):
            while at and word not in step[at]:
                at = link[at]
                run = length[at]
            at = step[at].get(word, 0)
            run = run + 1 if at else 0
            if run < self.least:
                continue
            up, reach = at, 0
            while up > 0:
                if run >= window and length[link[up]] < window:
                    # The window that ends here has this state's ends: runs longer than the link's are all of this state.
                    if min(run, length[up]) >= window:
                        items |= ends[up]
                        reach = window
                for item, size in whole[up]:
                    if size <= run:
                        items.add(item)
                        reach = max(reach, size)
                up = link[up]
            if reach:
                hits.append((i + 1 - reach, i + 1))
        return hits, items


def _word_hashes(block: Block) -> tuple[Words, np.ndarray]:
    data = LOWER[block.data]
    words = find_words(block, data, NON_ALNUM)
    return words, range_hashes(data, words.begin, words.end)


def matchers(items: DataFrame, item: str, text: str, max_words: int, window: int) -> Iterator[Matcher]:
    """Automata of the items, each of at most `max_words` words (one longer item is an automaton of its own).

    The items come to the driver one partition at a time; only one automaton's items are held. Items whose id or text is null,
    or without words, have no window.
    """
    held: list[tuple[int, np.ndarray]] = []
    total = 0
    rows = items.select(item, text).filter(F.col(item).isNotNull() & F.col(text).isNotNull()).toLocalIterator()
    for key, value in rows:
        for block in blocks(pa.array([value])):
            hashes = _word_hashes(block)[1]
            if held and total + len(hashes) > max_words:
                yield Matcher(held, window)
                held, total = [], 0
            held.append((key, hashes))
            total += len(hashes)
    yield Matcher(held, window)


def _merge(ranges: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def scan_block(block: Block, matcher: Matcher) -> tuple[list[int], list[list[list[int]]], list[list[int]], list[list[list[int]]]]:
    """Per row: its words, hit word ranges, items found (sorted), and the byte ranges of the hits."""
    words, hashes = _word_hashes(block)
    numbers = matcher.numbers(hashes)
    known = numbers >= 0
    opens, closes = known.copy(), known.copy()
    opens[1:] &= ~known[:-1] | (words.row[1:] != words.row[:-1])
    closes[:-1] &= ~known[1:] | (words.row[1:] != words.row[:-1])
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = closes - opens >= matcher.least
    hits: dict[int, list[tuple[int, int]]] = {}
    found: dict[int, set[int]] = {}
    for begin, end in zip(opens[long].tolist(), closes[long].tolist(), strict=True):
        ranges, items = matcher.walk(numbers[begin:end].tolist())
        if ranges:
            row = int(words.row[begin])
            hits.setdefault(row, []).extend((begin + a, begin + b) for a, b in ranges)
            found.setdefault(row, set()).update(items)
    word_ranges, byte_ranges, items = [], [], []
    for row in range(block.rows):
        merged = _merge(hits.get(row, ()))
        first, start = int(words.first[row]), int(block.starts[row])
        word_ranges.append([[a - first, b - first] for a, b in merged])
        byte_ranges.append([[int(words.begin[a]) - start, int(words.end[b - 1]) - start] for a, b in merged])
        items.append(sorted(found.get(row, ())))
    return words.counts.tolist(), word_ranges, items, byte_ranges


RANGES = T.ArrayType(T.ArrayType(T.IntegerType()))
STATE = (("__words", T.LongType(), pa.int64()), ("__ranges", RANGES, pa.list_(pa.list_(pa.int32()))),
         ("__items", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("__bytes", RANGES, pa.list_(pa.list_(pa.int32()))))


def _scan(frame: DataFrame, text: str, sent) -> DataFrame:
    """One automaton over all texts; what earlier automata found is united with its hits."""
    names = [name for name, _, _ in STATE]
    base = without(frame, names)
    earlier = "__words" in frame.columns
    columns, position = base.columns, base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in STATE]
            for block in blocks(batch.column(position)):
                for column, values in zip(out, scan_block(block, sent.value), strict=True):
                    column.extend(values)
            if earlier:
                old = [batch.column(name).to_pylist() for name in names]
                for k in (1, 3):
                    out[k] = [_merge(map(tuple, a + b)) for a, b in zip(old[k], out[k], strict=True)]
                out[2] = [sorted({*a, *map(str, b)}) for a, b in zip(old[2], out[2], strict=True)]
            out[2] = [[str(name) for name in found] for found in out[2]]
            new = [pa.array(values, type=kind) for values, (_, _, kind) in zip(out, STATE, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *new], names=[*columns, *names])

    return frame.mapInArrow(run, T.StructType([*base.schema.fields, *[T.StructField(n, k) for n, k, _ in STATE]]))


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """Append n_words, n_hit, n_items (long), items_sha256, contaminated and hit_bytes ([begin, end) UTF-8 ranges) to every row.

    A null or empty text has no words and no hit; an empty benchmark hits nothing; equal rows get equal answers; items that
    repeat an id count as one item; an empty table gives an empty result; columns that carry one of the names are replaced.
    """
    spark = small_batches(docs.sparkSession)
    frame = without(docs, OWN)
    columns = frame.columns
    for k, matcher in enumerate(matchers(items, item, item_text, max_words, window)):
        # What is broadcast is bounded by max_words. A further automaton is a further pass over the staged rows.
        frame = _scan(staged(frame) if k else frame, text, spark.sparkContext.broadcast(matcher))
    hit = F.aggregate("__ranges", F.lit(0).cast("long"), lambda total, r: total + (r[1] - r[0]).cast("long"))
    return frame.select(*[F.col(f"`{c}`") for c in columns], F.col("__words").alias("n_words"), hit.alias("n_hit"),
                        F.size("__items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.sort_array("__items")), 256).alias("items_sha256"),
                        (F.size("__ranges") > 0).alias("contaminated"), F.col("__bytes").alias("hit_bytes"))


def remove_contamination(docs: DataFrame, items: DataFrame, text: str = "text", most_coverage: float = 0.5) -> DataFrame:
    """Cut the hit spans (each at least an item window) out of the texts; drop documents hit beyond `most_coverage` of their words.

    The columns of the input stay; a text without hits, also a null one, stays as it is. What surrounds a cut closes up. Rows that
    repeat are cut alike and all stay; where items overlap, what any of them hits is cut; an empty table gives an empty result.
    """
    # The marks are internal here: columns of the input that have their names are set aside.
    columns = [f"__in_{c}" if c.lower() in OWN else c for c in docs.columns]
    position = columns.index(text)
    marked = find_contamination(docs.toDF(*columns), items, text)
    names = docs.columns
    kept = marked.filter(F.col("n_hit") <= most_coverage * F.col("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(position).to_pylist(), batch.column("hit_bytes").to_pylist()
            for i, cuts in enumerate(ranges):
                if cuts:
                    raw, at, parts = texts[i].encode(), 0, []
                    for begin, end in cuts:
                        parts.append(raw[at:begin])
                        at = end
                    texts[i] = b"".join([*parts, raw[at:]]).decode()
            arrays = [batch.column(c) for c in columns]
            arrays[position] = pa.array(texts, type=arrays[position].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return kept.mapInArrow(run, docs.schema)
