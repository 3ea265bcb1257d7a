"""The trie of conversations against brute force, and contraction on odd shapes."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import conversation_trie as ct
from tapeloom.llm.conversation_trie import conversation_trie, subtree_totals

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 int, n_children string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    ordered = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, turns in ordered.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        built[c] = ordered.get(lender, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for seq in members:
        if seq:
            kids[seq[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for seq, held in members.items():
        worth = (len(held) - 1) * len(seq[-1][1].encode()) if seq else 0
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += seq not in kids
            saved[seq[:d]] += worth
    out = set()
    for seq, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(built[c]) == len(seq))
        out.add((min(held), len(seq), min(members[seq[:-1]]) if seq else None, len(held), kids.get(seq, 0), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk(seed=1):
    rng = random.Random(seed)
    lines = ["", "Hello", "Hëllo 日本", "Yes", "No", "x" * 400, None]
    rows = []
    for c in [*range(0, 90), *range(-7, 0), 10**17, 10**17 + 3, 2**62]:
        for turn in range(rng.choice([1, 1, 2, 3, 8, 14])):
            rows.append((c, turn if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]), rng.choice(lines), "d", 1, "n"))
    rows += [(c, turn, "user", "same", "d", 1, "n") for c in range(200, 260) for turn in range(12)]          # a group of copies
    rows += [(300, turn, "user", f"line {turn // 2}", "d", 1, "n") for turn in range(400)]                    # a long one
    rows += [(5, 1, "user", "Yes", "d", 1, "n")] * 3 + [(None, 0, "user", "lost", "d", 1, "n"), (301, None, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ct, "BLOCK", block)
    rows = talk()
    got = [tuple(r) for r in conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_digests_stream_over_many_lines(spark, monkeypatch):
    monkeypatch.setattr(ct, "LINE_BITS", 2)
    rows = [(c, 0, "user", "same", "d", 1, "n") for c in [*range(-30, 300, 3)]]
    got = {tuple(r) for r in conversation_trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()}
    assert got == brute(rows)


def _tree(spark, parents):
    """Totals by contraction and by walking up, over a forest given as child -> parent."""
    kids = defaultdict(int)
    for p in parents.values():
        kids[p] += 1
    depth = {}
    for v, p in parents.items():
        depth[v] = 0 if p is None else depth[p] + 1
    rows = [(v, v, p, p, depth[v], kids[v], v, 1) for v, p in parents.items()]
    nodes = spark.createDataFrame(rows, "k1 long, k2 long, p1 long, p2 long, depth long, n_children long, a long, b long").repartition(3)
    want = {v: [0, 0] for v in parents}
    for v in parents:
        up = v
        while up is not None:
            want[up][0] += v
            want[up][1] += 1
            up = parents[up]
    got = {r.k1: [r.a, r.b] for r in subtree_totals(nodes, ["a", "b"]).collect()}
    assert got == want


def test_contraction_of_chains_stars_and_combs(spark):
    _tree(spark, {0: None} | {i: i - 1 for i in range(1, 120)})
    _tree(spark, {0: None, 500: None} | {i: 0 for i in range(1, 200)})
    _tree(spark, {0: None} | {i: i - 1 if i < 40 else i - 40 for i in range(1, 80)})
    rng = random.Random(4)
    _tree(spark, {0: None} | {i: rng.randrange(max(0, i - 4), i) for i in range(1, 300)})


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(empty).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x", "d", 1, "n")], SCHEMA)).collect() == []
    assert conversation_trie(empty.withColumn("turn", F.col("turn").cast("int"))).columns == list(COLUMNS)
