"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by dense prefix-suffix tiling.

In a pair whose longer word has `size` code points, the edit stands at some position e: the first e code points agree, and the
last size - 1 - e do too. A tile holds the words that can be such a pair's with e in a range [lo, hi): they agree in their first
lo and their last size - hi code points. Tiles start as the two halves of every word and one that is too full is halved again, so
a tile ends at the latest as a single position, where only the letters of an alphabet differ. Inside a tile, padded code-point
matrices compare block pairs: the common prefix plus the common suffix reaches size - 1 just for single edits. The common prefix
also names the one tile that counts the pair, so no pair is counted twice.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import small_batches, staged
from tapeloom.llm.textblocks import LOWER

LEAST_LENGTH, LEAST_COUNT, RATIO, TYPO_DIVISOR = 6, 5, 5, 199
TILE = 256                  # words of a tile that are compared without another halving
MOST_SENT_TILES = 50_000    # with more full tiles than this, they are joined by a shuffle
CELLS = 4_000_000           # code points of one comparison matrix
HELD_WORDS = 200_000        # different words a task adds up before it passes them on
PIECE = 1_000_000           # code points of a text that are taken apart at once; pieces end between runs

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(LOWER)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = at + PIECE
        run = _RUN.match(text, end) if end < len(text) else None
        end = run.end() if run else end
        yield text[at:end]
        at = end


def typed_runs(name: str, text: str, least: int, divisor: int) -> Counter:
    """Runs of letters of a text with their counts, A-Z lower-cased; if `divisor` divides the crc32 of `<name>:<run>`, the run
    loses the code point at that number modulo its length. Runs and results with fewer than `least` code points are left out."""
    found, out = Counter(), Counter()
    pattern = re.compile("[a-zÀ-ÿ]{%d,}" % max(least, 1))
    for piece in _pieces(text):
        found.update(pattern.findall(piece.encode().translate(_LOWER).decode()))
    start = zlib.crc32(f"{name}:".encode())
    for run, times in found.items():
        h = zlib.crc32(run.encode(), start)
        if divisor and h % divisor == 0:
            cut = h % len(run)
            run = run[:cut] + run[cut + 1:]
            if len(run) < least:
                continue
        out[run] += times
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, divisor: int = TYPO_DIVISOR) -> DataFrame:
    """Words of at least `least_length` code points of whole texts, and how often they occur overall: word string, n long.

    Null or empty texts have no words; a null key is written as nothing; rows that repeat count again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value:
                    held.update(typed_runs(name or "", value, least_length, divisor))
                if len(held) > HELD_WORDS:
                    yield passed_on()
                    held = Counter()
        if held:
            yield passed_on()
    small_batches(docs.sparkSession)
    pairs = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return pairs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _tile(size: Column, lo: Column, hi: Column) -> Column:
    """Name of the tile a word belongs to: its first lo and its last size - hi code points."""
    word = F.col("word")
    return F.xxhash64(size, lo, hi, F.substr(word, F.lit(1), lo), F.substr(word, F.char_length(word) - (size - hi) + 1, size - hi))


def _ranged(rows: DataFrame, ranges: list[tuple[Column, Column]]) -> DataFrame:
    """Every row once for each [lo, hi) that is not empty, with its tile."""
    spans = F.explode(F.array(*[F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")) for lo, hi in ranges]))
    out = rows.withColumn("span", spans).filter("span.lo < span.hi")
    out = out.select("word", "n", "size", F.col("span.lo").alias("lo"), F.col("span.hi").alias("hi"))
    return out.withColumn("tile", _tile(F.col("size"), F.col("lo"), F.col("hi")))


def _tiles(words: DataFrame, tile: int) -> DataFrame:
    """Rows (word, n, size, lo, hi, tile), in tiles of at most `tile` words or a single position."""
    sized = words.withColumn("size", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)))
    rows = staged(_ranged(sized, [(F.lit(0), F.floor(F.col("size") / 2)), (F.floor(F.col("size") / 2), F.col("size"))]))
    done = []
    while True:
        full = rows.filter("hi - lo > 1").groupBy("tile").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > tile).select("tile", F.lit(True).alias("full"))
        full = staged(full)
        tiles = full.count()
        if not tiles:
            return _union([*done, rows])
        marked = rows.join(F.broadcast(full) if tiles <= MOST_SENT_TILES else full, "tile", "left")
        marked = marked.withColumn("full", F.coalesce("full", F.lit(False)) & (F.col("hi") - F.col("lo") > 1))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        done.append(marked.filter(~F.col("full")).drop("full").select(*rows.columns))
        rows = staged(_ranged(marked.filter("full"), [(F.col("lo"), middle), (middle, F.col("hi"))]))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _matrices(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, and of the words reversed, padded with zeros."""
    def matrix(items):
        return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in items), dtype=np.uint8).reshape(len(words), width)
    return matrix(words), matrix([w[::-1] for w in words])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of padded rows; at a difference in padding the shorter word ends."""
    differs = a != b
    at = differs.argmax(axis=1)
    return np.where(differs[np.arange(len(at)), at], at, a.shape[1])


def compare_tiles(words: list[bytes], n: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, tile: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one tile that are a single edit apart; rows come by tile, longer words first."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    width = int(length.max())
    codes, turned = _matrices(words, width)
    at = np.flatnonzero(length == size)          # the longer word of a pair, or one of two equally long
    slab = max(CELLS // width, 1)
    for step in range(1, len(words)):
        at = at[at + step < len(words)]
        at = at[tile[at] == tile[at + step]]
        if not len(at):
            return
        for part in np.split(at, range(slab, len(at), slab)):
            other = part + step
            prefix = _common(codes[part], codes[other])
            near = (prefix >= lo[part]) & (prefix < hi[part])
            part, other, prefix = part[near], other[near], prefix[near]
            near = prefix + _common(turned[part], turned[other]) >= size[part] - 1
            yield part[near], other[near]


def _best(words: list[bytes], n: np.ndarray, row: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """For every word: how many near words were found here, and the one of largest n, least in code-point order."""
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], rank[row]))
    row, near = row[order], near[order]
    # Rows of one word in several tiles each bring their own line; Spark adds them up.
    first = np.flatnonzero(np.r_[True, rank[row][1:] != rank[row][:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(row)))
    text = [w.decode("latin-1") for w in words]
    return pa.RecordBatch.from_arrays([pa.array([text[i] for i in row[first]], pa.string()), pa.array(counts, pa.int64()), pa.array(n[near[first]], pa.int64()),
                                       pa.array([text[i] for i in near[first]], pa.string())], names=["word", "n_near", "near_n", "near"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare whole tiles; a tile that is cut by a batch waits for the rest."""
    held: pa.Table | None = None

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        n, size, lo, hi, tile = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "size", "lo", "hi", "tile"))
        # A run of tiles is taken at once as long as its matrix is small.
        cells = np.cumsum(size)
        starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        cuts = [0]
        for begin, end in zip(starts, np.append(starts[1:], len(words))):
            if begin > cuts[-1] and int(size[cuts[-1]:end].max()) * (end - cuts[-1]) > CELLS:
                cuts.append(int(begin))
        del cells
        for begin, end in zip(cuts, [*cuts[1:], len(words)]):
            s = slice(begin, end)
            found = list(compare_tiles(words[s], n[s], size[s], lo[s], hi[s], tile[s]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                if len(a):
                    yield _best(words[s], n[s], np.concatenate([a, b]), np.concatenate([b, a]))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        tile = table.column("tile").to_numpy()
        edge = int(np.flatnonzero(tile != tile[-1])[-1]) + 1 if len(tile) and (tile != tile[-1]).any() else 0
        held = table.slice(edge)
        if edge:
            yield from compared(table.slice(0, edge))
    if held is not None and held.num_rows:
        yield from compared(held)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """For every word with near words: n_near, and the near word of largest n (`near`, `near_n`; ties: least in code-point order).

    `words` are distinct, of letters up to \\u00FF: word string, n long. Pairs that differ only in tiles' hashes never count:
    every pair is compared in full.
    """
    small_batches(words.sparkSession)
    rows = _tiles(words, tile)
    ready = rows.repartition("tile").sortWithinPartitions("size", "tile", F.char_length("word").desc(), "word")
    found = ready.mapInArrow(_search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n"))


def _hops(most: int, least: int, ratio: int) -> int:
    """How many forms can follow one another, when each has `ratio` times the count of the last."""
    hops, n = 0, max(least, 1) * ratio
    while n <= most:
        hops, n = hops + 1, n * ratio
    return hops


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """The last form of every word that has one, by doubling: word, root. `forms`: word, form."""
    far = forms.select("word", F.col("form").alias("root"))
    reached = 1
    while reached < hops:
        further = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = staged(far.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        reached *= 2
    return far


def spelling_variants(words: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """One row per word: form (its near word of largest n, if that is at least `ratio` times its own), root (the last form; the
    word itself without one), n, n_near and form_n.

    `words`: distinct words with their counts (word string, n long); an empty table gives an empty result. Of near words with equal n
    the least in code-point order is the form.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    words = staged(words.select("word", "n"))
    near = near_words(words, tile).select("word", "n_near", "near", "near_n")
    has_form = F.col("near_n") >= ratio * F.col("n")
    judged = staged(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                            F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n")))
    most, least = judged.agg(F.max("n"), F.min("n")).first()
    last = roots(judged.filter("form IS NOT NULL"), _hops(most or 0, least or 0, ratio))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                    ratio: int = RATIO, divisor: int = TYPO_DIVISOR) -> DataFrame:
    """Spelling variants among the words of whole documents that occur `least_count` times or more."""
    return spelling_variants(word_counts(docs, key, text, least_length, divisor).filter(F.col("n") >= least_count), ratio)
