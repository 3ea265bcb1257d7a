"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Its name is two 64-bit sums (exclusive or) of hashes of its turns, each hashed with
its place; so the parent's name is the node's without its last turn, and the trie needs no walk along the turns.

Totals over subtrees come from contracting the trie in join rounds. Every round first rakes the leaves: their totals are final and
are added to their parents. Then it compresses unary chains: a node with a single child left is spliced out if its coin of the
round says heads and its child's tails; the child takes over the edge and what hung on it. All leaves and a quarter to a half of the
chain nodes go in a round whatever the trie's shape, so rounds grow with the logarithm of its size. Going back through the rounds,
each spliced node's total is its child's plus what lay between them.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.frames import small_batches, staged

STRIDE = 5                  # a conversation starts like the one with this multiple below it
BORROWED = 9                # and takes crc32 % 9 turns from there
BLOCK = 1024                # turns of a conversation that one window handles
HOT_SHARE = 1024            # a parent with over 1/1024 of all children is sent to them
LINE_BITS = 12               # ids of one range of 4,096 numbers are joined in one line
DEPTH_COINS = 6
HEAD = 64                   # code points of role and text that order turns of the same number; then their hash does

_NAME = ("k1", "k2")
_PARENT = ("p1", "p2")


def _hashed(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(role, 1, HEAD).alias("role_head"), F.substring(text, 1, HEAD).alias("text_head"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role, F.octet_length(role)).alias("h2"), F.octet_length(text).cast("long").alias("bytes"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, bytes): turns numbered from 1 by turn (null first), role and text.

    Slices of the order, not conversations, are what a task sorts; a conversation may fill many slices.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), "role_head", "text_head", "h1", "h2"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _hashed(turns).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "tie")
    sliced = staged(dealt.withColumn("slice", F.spark_partition_id()))
    sizes = sliced.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("members"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "slice", F.coalesce(F.sum("members").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order[1:], "tie"))
    return sliced.withColumn("local", local).join(offsets, ["conv_id", "slice"]).select("conv_id", (F.col("offset") + F.col("local")).alias("place"), "h1", "h2", "bytes")


def _borrowed(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(BORROWED))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, place, h1, h2, bytes, last) and conversations (conv_id, size), both after the borrowed beginnings.

    last: the conversation ends with this turn.
    """
    placed = staged(ordered_turns(turns))
    own = placed.groupBy("conv_id").agg(F.max("place").alias("own"))
    lenders = own.select(F.col("conv_id").alias("lender"), F.col("own").alias("lent"))
    named = own.withColumns({"taken": _borrowed(F.col("conv_id")), "lender": F.col("conv_id") - F.col("conv_id") % STRIDE})
    taken = F.least("taken", F.coalesce("lent", F.lit(0)))
    convs = staged(named.join(lenders, "lender", "left").select("conv_id", "lender", "own", "taken", taken.alias("front"),
                                                                (taken + F.greatest(F.col("own") - F.col("taken"), F.lit(0))).alias("size")))
    lent = placed.filter(F.col("place") < BORROWED).select(F.col("conv_id").alias("lender"), "place", "h1", "h2", "bytes")
    front = convs.join(lent, "lender").filter(F.col("place") <= F.col("front")).select("conv_id", "place", "h1", "h2", "bytes", "size")
    # A conversation meets its own turns in blocks, so that a long one is spread over tasks.
    block = F.floor(F.col("place") / BLOCK)
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / BLOCK))))
    back = placed.withColumn("block", block).join(blocks, ["conv_id", "block"]).filter(F.col("place") > F.col("taken"))
    back = back.select("conv_id", (F.col("front") + F.col("place") - F.col("taken")).alias("place"), "h1", "h2", "bytes", "size")
    out = front.unionByName(back).withColumn("last", F.col("place") == F.col("size")).drop("size")
    return out, convs.select("conv_id", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with the name of the sequence that ends with it (k1, k2) and of the one before (p1, p2).

    Names are running sums, within blocks of a conversation and then over its blocks.
    """
    placed = turns.withColumns({"h1": F.xxhash64("place", "h1", "h2"), "h2": F.xxhash64("h2", "h1", "place"), "block": F.floor(F.col("place") / BLOCK)})
    placed = staged(placed)
    sums = placed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0).cast("long")).alias(b) for s, b in (("s1", "b1"), ("s2", "b2"))])
    inside = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({"r1": F.bit_xor("h1").over(inside), "r2": F.bit_xor("h2").over(inside)}).join(earlier, ["conv_id", "block"])
    run = run.withColumns({"k1": F.col("r1").bitwiseXOR(F.col("b1")), "k2": F.col("r2").bitwiseXOR(F.col("b2"))})
    return run.select("conv_id", "place", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "bytes", "last")


def trie_nodes(ends: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: name, parent's name (root: null), smallest member, depth, members and the bytes of its last text."""
    nodes = ends.groupBy("k1", "k2").agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.min("place").cast("long").alias("depth"),
                                         F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes"))
    return nodes.unionByName(root)


def _with_family(nodes: DataFrame) -> DataFrame:
    """Add the number of children and the parent's smallest member; the parents of very many children are sent to them."""
    kids = nodes.filter("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = staged(nodes.join(kids, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    total = counted.count()
    parents = counted.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") * HOT_SHARE > total     # fewer than HOT_SHARE of them
    sent = F.broadcast(parents.filter(hot).drop("n_children").withColumn("sent", F.lit(True)))
    met = counted.join(sent, ["p1", "p2"], "left")
    settled = met.filter("sent OR p1 IS NULL").drop("sent")
    rest = met.filter("sent IS NULL AND p1 IS NOT NULL").drop("sent", "parent_conv_id").join(parents.filter(~hot).drop("n_children"), ["p1", "p2"])
    return staged(settled.unionByName(rest))


def _heads(a: Column, b: Column, depth: Column, turn: int) -> Column:
    """The coin of a round. At first it is a bit of the depth, which alternates along a chain that was thinned so far; then a hash."""
    if turn < DEPTH_COINS:
        return F.shiftright(depth, turn).bitwiseAND(F.lit(1)) == 1
    return F.xxhash64(F.lit(turn), a, b).bitwiseAND(F.lit(1)) == 1


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(k1, k2, values): sums of each value over every node's subtree, itself included.

    `nodes`: name (k1, k2), parent's name (p1, p2; null at the roots), depth, n_children and the values (long). Rounds of raking and
    compressing, each a few joins with one row per node on both sides.
    """
    edge = {v: f"edge_{v}" for v in values}       # what was spliced out between a node and its present parent
    active = staged(nodes.select(*_NAME, *_PARENT, F.col("depth").cast("long").alias("depth"), F.col("n_children").alias("kids"), *values,
                                 *[F.lit(0).cast("long").alias(e) for e in edge.values()]))
    final, spliced, turn = [], [], 0
    while True:
        # Rake. What a parent hears of its children: the leaves' sums and number, and, where one other child is left, that child.
        leaf = F.col("kids") == 0
        heir = F.struct(*_NAME, *edge.values(), _heads(F.col("k1"), F.col("k2"), F.col("depth"), turn).alias("heads"))
        heard = active.filter("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.count_if(leaf).alias("gone"), *[F.sum(F.when(leaf, F.col(v) + F.col(edge[v])).otherwise(0)).alias(f"raked_{v}") for v in values],
            F.max(F.when(~leaf, heir)).alias("heir"))
        met = active.join(heard, ["k1", "k2"], "left").withColumns({"leaf": leaf, "kids": F.col("kids") - F.coalesce("gone", F.lit(0))})
        met = met.withColumns({v: F.col(v) + F.coalesce(f"raked_{v}", F.lit(0)) for v in values})
        # Compress. The coins keep a node and its child from going in the same round.
        goes = (F.col("kids") == 1) & F.col("p1").isNotNull() & _heads(F.col("k1"), F.col("k2"), F.col("depth"), turn) & ~F.col("heir.heads")
        met = staged(met.select(*_NAME, *_PARENT, "depth", "kids", *values, *edge.values(), "heir", "leaf", F.coalesce(goes, F.lit(False)).alias("goes")))
        final.append(met.filter("leaf").select(*_NAME, *values))
        rest, gone = met.filter("NOT leaf AND NOT goes"), met.filter("goes")
        if met.filter("NOT leaf").isEmpty():
            break
        spliced.append(gone.select(*_NAME, F.col("heir.k1").alias("h1"), F.col("heir.k2").alias("h2"), *[(F.col(v) + F.col(f"heir.{edge[v]}")).alias(v) for v in values]))
        moved = gone.select(F.col("heir.k1").alias("k1"), F.col("heir.k2").alias("k2"), F.col("p1").alias("to1"), F.col("p2").alias("to2"),
                            *[(F.col(v) + F.col(edge[v])).alias(f"more_{v}") for v in values])
        active = rest.join(moved, ["k1", "k2"], "left").select(
            *_NAME, F.coalesce("to1", "p1").alias("p1"), F.when(F.col("to1").isNull(), F.col("p2")).otherwise(F.col("to2")).alias("p2"), "depth", "kids", *values,
            *[(F.col(edge[v]) + F.coalesce(f"more_{v}", F.lit(0))).alias(edge[v]) for v in values])
        turn += 1
    # Re-expand, last round first: a spliced node's child is known by then.
    known = final
    for gone in reversed(spliced):
        if gone.isEmpty():
            continue
        child = _union(known).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), *[F.col(v).alias(f"child_{v}") for v in values])
        known = [*known, staged(gone.join(child, ["h1", "h2"]).select(*_NAME, *[(F.col(v) + F.col(f"child_{v}")).alias(v) for v in values]))]
    return _union(known)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every node's lines, comma-joined; rows come by node and line."""
    name, digest = None, hashlib.sha256()

    def line(rows: list) -> pa.RecordBatch:
        k1, k2, hexes = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(hexes, pa.string())], names=["k1", "k2", "ends_sha256"])
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if name == (k1, k2):
                digest.update(b",")
            else:
                if name:
                    done.append((*name, digest.hexdigest()))
                name, digest = (k1, k2), hashlib.sha256()
            digest.update(ids.encode())
        yield line(done)
    if name:
        yield line([(*name, digest.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the conversations (conv_id) that end at each node, numerically ascending.

    Ids are joined in lines of one 4,096 numbers' range; only lines are sorted by node, and the digest streams over them.
    """
    small_batches(ends.sparkSession)
    lines = ends.withColumn("line", F.shiftright("conv_id", LINE_BITS)).groupBy("k1", "k2", "line").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    lines = lines.select("k1", "k2", "line", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))
    return lines.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "line").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    `turns`: conv_id, turn, role, text; other columns do not matter. Turns go by number, null first, turns of one number by role
    and text (their first 64 code points, then a hash); rows that repeat are turns of their own. Null roles and texts are empty;
    rows without a conv_id belong to no conversation. Without any conversation there is no node, not even a root.
    """
    rows, convs = rebuilt(turns)
    ends = staged(prefixes(rows))
    nodes = _with_family(trie_nodes(ends, convs))
    valued = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    totals = subtree_totals(valued, ["n_leaves", "saved_tokens"])
    zero = F.lit(0).cast("long")
    stops = ends.filter("last").select("k1", "k2", "conv_id").unionByName(convs.filter("size = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    out = nodes.join(totals, ["k1", "k2"]).join(end_digests(stops), ["k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
