"""Spelling variants against brute force."""
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import spelling
from tapeloom.llm.spelling import group_spellings, near_words, roots, spelling_variants, typed_runs, word_counts

LOWER = {i: i + 32 for i in range(65, 91)}


def single_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if single_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= ratio * n else None, n, len(near))
    rows = {}
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, n_near, counts[form] if form else None)
    return rows


def brute_counts(rows, divisor=199, least=6):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % divisor == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                total[run] += 1
    return dict(total)


def vocabulary(seed=5, n=700):
    """Words with many single edits, repeated letters, long words, and words that share a beginning, an end or both."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(n)}
    words |= {"prefix" + "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(150)}
    words |= {"".join(rng.choice("abcdefgh") for _ in range(3)) + "suffix" for _ in range(150)}
    words |= {"a" * k for k in range(1, 30)} | {"é" * k for k in range(5, 9)} | {"x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499}
    return {w: rng.choice([1, 1, 2, 5, 5, 10, 25, 30, 125, 625, 4000]) for w in words}


@pytest.mark.parametrize("tile", [4, 256, 100_000])
def test_variants_equal_brute_force_whatever_the_tile(spark, tile):
    counts = vocabulary()
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(words, tile=tile).collect()}
    assert got == brute_variants(counts)


def test_a_crowded_tile_is_halved_until_single_positions(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    counts = {f"common{a}{b}ending": 5 for a in letters for b in letters}
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.near, r.near_n) for r in near_words(words, tile=16).collect()}
    assert len(got) == 676 and all(n == 50 for n, _, _ in got.values())
    assert got["commonzzending"][1] == "commonazending"


def test_counts_and_typing_errors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 64)
    rng = random.Random(2)
    words = ["Straße", "ÉCOLE", "école", "naïveté", "Wonder", "wonder", "short", "x", "×÷×÷×÷", "mixed×case", "underscore_word", "日本語abcdefg"]
    rows = [(i if i % 7 else None, " ".join(rng.choices(words, k=rng.choice([1, 9, 80]))) + rng.choice(["", ".", "1two33", "\nEnd"])) for i in range(300)]
    rows += [(1, None), (2, ""), (3, "   "), (4, "a" * 500), (4, "a" * 500), (5, "Verylongword" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
    got = {r.word: r.n for r in word_counts(df, divisor=5).collect()}
    assert got == brute_counts(rows, divisor=5)
    least = {w: n for w, n in got.items() if n >= 5}
    kept = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in group_spellings(df, divisor=5).collect()}
    assert kept == brute_variants(least) and any(row[0] for row in kept.values())


def test_a_deleted_letter_is_the_hash_modulo_the_length():
    name, run = next((str(i), "wonderful") for i in range(10_000) if zlib.crc32(f"{i}:wonderful".encode()) % 199 == 0)
    h = zlib.crc32(f"{name}:wonderful".encode())
    assert typed_runs(name, "Wonderful", 6, 199) == Counter({run[:h % 9] + run[h % 9 + 1:]: 1})


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)], "word string, form string")
    assert {r.root for r in roots(chain, 13).collect()} == {"w13"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert group_spellings(docs).collect() == []
    assert group_spellings(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).columns == ["word", "form", "root", "n", "n_near", "form_n"]
