"""Near-duplicate components with an LSH forest.

Every document's set of word shingles gets `TREES` signatures of `LABELS` minhash labels. A tree of the forest is one sorted
order of all signatures; neighbours in it that share a prefix of `SHALLOW` labels form a region. A dense region is descended to
its full label depth, and one that stays dense (thousands of almost equal texts) is dealt into blocks whose representatives meet
again: by region, by full depth where they are many, and in pairs of parts where that is still dense, so that no task gets an
unbounded region. Inside a region, a search along estimated similarity (all labels of all trees)
keeps at most one candidate link per member; the candidates' connected clusters are then searched with the exact sets: a pair
counts only if its full sets are similar enough.

Equal sets are one class from the start: copies are never compared. Two sets at a threshold of 0.85 share no region with
probability (1 - 0.85 ** 2) ** 16 = 1e-9 (0.8: 8e-8), no region of full depth with 7e-6 (0.8: 2e-4), and the estimate of 64 labels
falls below `least_estimate` with at most `MISSED`.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.components import connected_components
from tapeloom.llm.frames import set_aside, small_batches, staged
from tapeloom.llm.textblocks import LOWER, SPACES, U64, Block, blocks, find_words, mix, range_hashes, shingles, signed, whole_sequence

WIDTH = 5
TREES, LABELS, SHALLOW = 16, 4, 2
PERCENT = 85                # linked: 100 * intersection >= PERCENT * union
MISSED = 3e-6               # how often two sets at the threshold may be estimated too low
DENSE = 2048                # a region with more members is descended or dealt out
BLOCK = 1024                # sets that an exact search holds at once
PIVOTS = 4
HOT_SHARE = 1024            # a class with more than 1 / HOT_SHARE of all rows is hot: there are fewer than HOT_SHARE of them

_RANDOM = np.random.RandomState(515)
_FACTORS = _RANDOM.randint(1, 2**62, TREES * LABELS).astype(np.uint64) * U64(2) + U64(1)
_SALTS = _RANDOM.randint(1, 2**62, TREES * LABELS).astype(np.uint64)


def shingle_sets(block: Block) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row: of five words, or of the whole text with fewer; none without words."""
    data = LOWER[block.data]
    words = find_words(block, data, SPACES)
    hashes = range_hashes(data, words.begin, words.end)
    found, at = shingles(words, hashes, WIDTH)
    cuts = np.searchsorted(words.row[at], np.arange(block.rows + 1))
    out = []
    for row in range(block.rows):
        if cuts[row] < cuts[row + 1]:
            out.append(np.unique(found[cuts[row]:cuts[row + 1]]))
        elif words.first[row] < words.first[row + 1]:
            out.append(np.array([whole_sequence(hashes[words.first[row]:words.first[row + 1]])], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_names(sets: list[np.ndarray]) -> list[bytes | None]:
    """16 bytes that name each non-empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    starts = np.cumsum([0, *[len(s) for s in full[:-1]]])
    joined = np.concatenate(full)
    sizes = np.array([len(s) for s in full], dtype=np.uint64)
    high = mix(np.add.reduceat(mix(joined ^ U64(0x51ED270B)), starts) + sizes)
    low = mix(np.add.reduceat(mix(joined * U64(0x9FB21C651E98DF25)), starts) ^ sizes)
    names = iter(np.stack([high, low], axis=1).tobytes()[16 * i:16 * i + 16] for i in range(len(full)))
    return [next(names) if len(s) else None for s in sets]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: hash of each tree's first labels, and all labels cut to 16 bits."""
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    joined = np.concatenate(sets)
    labels = np.empty((len(sets), TREES * LABELS), dtype=np.uint64)
    for k in range(TREES * LABELS):
        v = joined * _FACTORS[k]
        v ^= v >> U64(32)
        v *= _SALTS[k] | U64(1)
        labels[:, k] = np.minimum.reduceat(v, starts)
    trees = labels.reshape(len(sets), TREES, LABELS)
    keys = np.zeros((len(sets), TREES), dtype=np.uint64)
    for depth in range(SHALLOW):
        keys = mix(keys + trees[:, :, depth] + U64(depth + 1))
    return keys, (mix(labels) >> U64(48)).astype(">u2")


def least_estimate(percent: int) -> float:
    """The largest share of equal labels that two sets with a similarity of `percent` fall below with at most `MISSED`."""
    n, p = TREES * LABELS, percent / 100
    below, k = 0.0, 0
    while k < n:
        below += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
        if below > MISSED:
            break
        k += 1
    return k / n


def _text_hashes(text: str) -> tuple[Column, Column]:
    content = F.col(text).cast("string")
    return F.xxhash64(content).alias("__high"), F.xxhash64(F.lit(1), content).alias("__low")


def _features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, high and low (hashes of the text, which name a row beside its doc_id), n_shingles, class (name of the set), keys, signature (both null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = shingle_sets(block)
                full = [s for s in sets if len(s)]
                keys, labels = signatures(full) if full else (np.zeros((0, TREES), np.uint64), np.zeros((0, 1), ">u2"))
                rows = iter(zip(signed(keys).tolist(), [x.tobytes() for x in labels], strict=True))
                pairs = [next(rows) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(block.lo, block.rows) for k in (0, 2, 3)], pa.array([len(s) for s in sets], pa.int64()), pa.array(set_names(sets), pa.binary()),
                     pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([p[1] for p in pairs], pa.binary())],
                    names=["doc_id", "high", "low", "n_shingles", "class", "keys", "signature"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text, *_text_hashes(text)).mapInArrow(run, f"doc_id {kind}, high long, low long, n_shingles long, class binary, keys array<long>, signature binary")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, one list for each value of the first `width` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if held and row[:width] != held[0][:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def spanning_links(n: int, similar: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """The components of a similarity graph as stars: links from each one's first member to its others. Each member is compared with those not yet reached."""
    links, rest = [], np.arange(n)
    while len(rest):
        first, rest = int(rest[0]), rest[1:]
        queue = [first]
        while queue and len(rest):
            at = queue.pop()
            hit = similar(at, rest)
            links.extend((first, int(x)) for x in rest[hit])
            queue.extend(int(x) for x in rest[hit])
            rest = rest[~hit]
    return links


def _region_links(percent: int):
    """Candidate links of each region block, to the least class of what hangs together; blocks of a dealt region also name these representatives (v null)."""
    estimate = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 4):
            labels = np.frombuffer(b"".join(row[6] for row in rows), dtype=">u2").reshape(len(rows), -1).astype(np.uint16)
            sizes = np.array([row[5] for row in rows], dtype=np.int64)
            dealt = rows[0][3]

            def similar(at: int, rest: np.ndarray) -> np.ndarray:
                near = 100 * np.minimum(sizes[rest], sizes[at]) >= percent * np.maximum(sizes[rest], sizes[at])
                near[near] = (labels[rest[near]] == labels[at]).mean(axis=1) >= estimate
                return near

            links = spanning_links(len(rows), similar)
            out = [(rows[a][4], rows[b][4], None, None) for a, b in links]
            if dealt:
                reached = {b for _, b in links}
                out += [(rows[i][4], None, rows[i][0], rows[i][1]) for i in range(len(rows)) if i not in reached]
            if out:
                u, v, tree, key = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(tree, pa.int32()), pa.array(key, pa.int64())],
                                                 names=["u", "v", "tree", "key"])
    return run


def _search_regions(members: DataFrame, percent: int) -> DataFrame:
    order = ["tree", "key", "block", "dealt"]
    ready = members.select(*order, "class", "n_shingles", "signature")
    return ready.repartition("tree", "key", "block").sortWithinPartitions(*order, "class").mapInArrow(_region_links(percent), "u binary, v binary, tree int, key long")


def _deeper() -> Column:
    """Deeper labels of the same tree, as bytes of the signature."""
    return F.xxhash64(F.expr(f"substring(signature, tree * {2 * LABELS} + {2 * SHALLOW + 1}, {2 * (LABELS - SHALLOW)})"))


def _meeting(heads: DataFrame, dense: int) -> DataFrame:
    """Blocks in which the representatives of dealt regions meet.

    Up to `dense` of a region meet at once, more of them where they share the full depth; where more than `dense` do, they are dealt
    into parts, and every pair of parts is a block.
    """
    heads = heads.withColumn("deeper", _deeper())
    counts = heads.groupBy("tree", "key", "deeper").agg(F.count(F.lit(1)).alias("deep"))
    counts = staged(counts.join(counts.groupBy("tree", "key").agg(F.sum("deep").alias("all")), ["tree", "key"]))
    parts = F.when((F.col("all") > dense) & (F.col("deep") > dense), F.ceil(2 * F.col("deep") / dense)).otherwise(1)
    counted = heads.join(counts, ["tree", "key", "deeper"]).withColumn("parts", parts)
    own = F.pmod(F.xxhash64("class", F.lit(2)), F.col("parts"))
    met = counted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    block = F.when(F.col("all") <= dense, F.lit(0).cast("long")).otherwise(F.xxhash64("deeper", F.least("own", "other"), F.greatest("own", "other")))
    return met.withColumns({"block": block, "dealt": F.lit(False)})


def candidate_links(classes: DataFrame, dense: int = DENSE, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between classes whose signatures look similar, at most one per member of a region block of the forest."""
    entries = classes.select("class", F.posexplode("keys").alias("tree", "key"))
    counts = entries.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    regions = entries.join(counts, ["tree", "key"]).join(classes.select("class", "n_shingles", "signature"), "class")
    regions = staged(regions.withColumn("deeper", _deeper()))
    sparse = regions.filter(F.col("members") <= dense).withColumns({"block": F.lit(0).cast("long"), "dealt": F.lit(False)})
    crowded = regions.filter(F.col("members") > dense)
    deep = crowded.groupBy("tree", "key", "deeper").agg(F.count(F.lit(1)).alias("deep_members"))
    deals = F.ceil(F.col("deep_members") / dense)
    # A deep prefix that is crowded itself is dealt by class; others stay whole.
    block = F.xxhash64("deeper", F.when(deals > 1, F.pmod(F.xxhash64("class"), deals)).otherwise(0))
    descended = crowded.join(deep, ["tree", "key", "deeper"]).withColumns({"block": block, "dealt": F.lit(True)})
    found = staged(_search_regions(sparse.unionByName(descended.select(*sparse.columns)), percent))
    heads = found.filter("v IS NULL").select("tree", "key", F.col("u").alias("class"))
    heads = staged(heads.join(classes.select("class", "n_shingles", "signature"), "class"))
    return found.filter("v IS NOT NULL").select("u", "v").unionByName(_search_regions(_meeting(heads, dense), percent).select("u", "v"))


def exact_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning stars of the graph in which two sets are linked if 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(codes) and int(codes.max()) + 1, dtype=bool)

    def similar(at: int, rest: np.ndarray) -> np.ndarray:
        near = 100 * np.minimum(sizes[rest], sizes[at]) >= percent * np.maximum(sizes[rest], sizes[at])
        marked[codes[starts[at]:starts[at + 1]]] = True
        for i in np.flatnonzero(near):
            x = rest[i]
            common = np.count_nonzero(marked[codes[starts[x]:starts[x + 1]]])
            near[i] = 100 * common >= percent * (sizes[at] + sizes[x] - common)
        marked[codes[starts[at]:starts[at + 1]]] = False
        return near

    return spanning_links(len(sets), similar)


def _set_links(percent: int):
    """Exact links inside each (cluster, part) of texts; a text whose set is not the class's is another row of that doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            members: dict[bytes, np.ndarray] = {}
            wanted = {row[2] for row in rows}
            for block in blocks(pa.array([row[3] for row in rows], pa.large_string())):
                sets = shingle_sets(block)
                members |= {name: s for name, s in zip(set_names(sets), sets, strict=True) if name in wanted}
            names = sorted(members)
            links = exact_links([members[name] for name in names], percent) if len(names) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([names[a] for a, _ in links], pa.binary()), pa.array([names[b] for _, b in links], pa.binary())], names=["u", "v"])
    return run


def _search_sets(members: DataFrame, percent: int) -> DataFrame:
    ready = members.select("cluster", "part", "class", "text").repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return ready.mapInArrow(_set_links(percent), "u binary, v binary")


def confirmed_links(members: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """Links that have the components of every cluster's exact similarity graph. `members`: cluster, class, text.

    A cluster of more than `block` classes is dealt into parts, each with the cluster's few pivots, so that nearly all of a
    group of near copies is linked through them. What is then outside the cluster's largest component is searched against
    every part: no pair of different components stays untested.
    """
    sizes = members.groupBy("cluster").agg(F.countDistinct("class").alias("size"))
    members = staged(members.join(sizes, "cluster").withColumn("parts", F.ceil(2 * F.col("size") / block)))
    small = members.filter(F.col("size") <= block).withColumn("part", F.lit(0).cast("string"))
    large = members.filter(F.col("size") > block).withColumn("own", F.pmod(F.xxhash64("class"), F.col("parts")))
    if large.isEmpty():
        return _search_sets(small, percent)
    # A few classes of each large cluster, by a bounded aggregate; they go to every part.
    picks = [F.max_by("class", F.struct(F.xxhash64("class", F.lit(i)), "class")) for i in range(PIVOTS)]
    pivots = large.groupBy("cluster").agg(F.array(*picks).alias("pivots")).select("cluster", F.explode("pivots").alias("class"))
    spread = large.join(pivots, ["cluster", "class"], "left_semi").withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    first = small.unionByName(large.unionByName(spread).withColumn("part", F.col("own").cast("string")).drop("own"))
    reached = staged(connected_components(_search_sets(first, percent)))
    inside = large.select("cluster", "class", "parts").distinct().join(reached.withColumnRenamed("node", "class"), "class", "left")
    inside = staged(inside.withColumn("component", F.coalesce("component", "class")))
    main = inside.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    outside = inside.join(main, "cluster").filter("component <> main")
    turns = outside.groupBy("cluster").agg(F.ceil(2 * F.count(F.lit(1)) / block).alias("turns"))
    # Each part of the cluster meets each part of what is outside.
    queries = large.join(outside.select("cluster", "class"), ["cluster", "class"], "left_semi").join(turns, "cluster")
    queries = queries.withColumn("turn", F.pmod(F.xxhash64("class", F.lit(1)), F.col("turns"))).withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    others = large.join(turns, "cluster").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    meet = queries.unionByName(others).withColumn("part", F.concat_ws("/", "turn", "own"))
    # Only what joins two components is new; the others stay stars.
    joined = staged(_search_sets(meet, percent))
    for end in ("u", "v"):
        joined = joined.join(reached.select(F.col("node").alias(end), F.col("component").alias("__at")), end, "left").withColumn(end, F.coalesce("__at", end)).drop("__at")
    return reached.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(joined.filter("u <> v"))


def _judged(docs: DataFrame, key: str, text: str, percent: int, dense: int, block: int) -> DataFrame:
    """The features of every row but keys and signature, and `head`: the row (none, doc_id, high, low) that its component keeps, null without words.

    A component keeps its least (doc_id, hashes of the text), null doc_ids last.
    """
    features = staged(_features(docs.select(F.col(key), F.col(text).cast("string").alias(text)), key, text))
    named = features.filter("class IS NOT NULL")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "high", "low")
    classes = staged(named.groupBy("class").agg(F.min(row).alias("least"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("rows"),
                                                F.first("keys").alias("keys"), F.first("signature").alias("signature")))
    clusters = connected_components(candidate_links(classes, dense, percent)).select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    wanted = clusters.join(classes.select("class", "least"), "class").select("cluster", "class", F.col("least.doc_id").alias("__id"), F.col("least.high").alias("__h"), F.col("least.low").alias("__l"))
    texts = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text"), *_text_hashes(text))
    same = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__high") == F.col("__h")) & (F.col("__low") == F.col("__l"))
    # Rows that repeat a key and text are one member.
    members = texts.join(wanted, same).select("cluster", "class", "text").dropDuplicates(["cluster", "class"])
    links = confirmed_links(members, block, percent)
    reached = connected_components(links).select(F.col("node").alias("class"), "component")
    heads = classes.select("class", "least").join(reached, "class").groupBy("component").agg(F.min("least").alias("linked"))
    by_class = classes.select("class", "rows", "least").join(reached.join(heads, "component"), "class", "left")
    by_class = staged(by_class.select("class", "rows", F.coalesce("linked", "least").alias("head")))
    # The rows of a hot class stay where they are; only the others are shuffled by class.
    total = classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = F.col("rows") * HOT_SHARE > total
    sent = F.broadcast(by_class.filter(hot).select("class", F.col("head").alias("__hot")))
    placed = features.select("doc_id", "high", "low", "n_shingles", "class").join(sent, "class", "left")
    settled = placed.filter("__hot IS NOT NULL OR class IS NULL").withColumnRenamed("__hot", "head")
    return settled.unionByName(placed.filter("__hot IS NULL AND class IS NOT NULL").drop("__hot").join(by_class.filter(~hot).select("class", "head"), "class", "left"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, dense: int = DENSE,
                    block: int = BLOCK) -> DataFrame:
    """Links of 100 * intersection >= percent * union. One row per document: its key, n_shingles, component_id and kept, and the name of its set (`class`, null without words).

    Shingles are five lower-cased words, or the whole text with fewer. A null or empty text has no set and is linked with
    nothing; rows that repeat a key each get a row; a null key is linked by its text, but names no component where another key
    does; an empty table gives an empty result. kept: the key is its component's.
    """
    small_batches(docs.sparkSession)
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    out = _judged(docs, key, text, percent, dense, block).select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), "class")
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents without near duplicates: one row of each component stays, with all its columns; all texts without words stay.

    The row that stays has the component's least key, null keys last; of several texts under that key, one.
    """
    small_batches(docs.sparkSession)
    docs, columns = set_aside(docs, [key, text])
    judged = _judged(docs, key, text, percent, DENSE, BLOCK)
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("high") == F.col("head.high")) & (F.col("low") == F.col("head.low"))
    stay = judged.filter(F.col("class").isNull() | is_head).select(F.col("doc_id").alias("__id"), F.col("high").alias("__h"), F.col("low").alias("__l"), F.col("class").isNull().alias("__wordless")).distinct()
    same = F.col(f"`{key}`").eqNullSafe(F.col("__id")) & (F.col("__high") == F.col("__h")) & (F.col("__low") == F.col("__l"))
    kept = docs.select("*", *_text_hashes(text)).join(stay, same)
    # Copies of a head under its own key and text are one row; rows without words are told apart.
    kept = kept.withColumn("__row", F.when(F.col("__wordless"), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return kept.dropDuplicates([key, "__high", "__low", "__row"]).select(*columns)
