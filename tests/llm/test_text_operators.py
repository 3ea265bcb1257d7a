"""Operators on documents against brute force, on small tables with nulls, empty texts, repeated rows and clashing columns."""
import hashlib
import random
import re
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import prefix_free, site_bayes
from tapeloom.llm.automaton import find_contamination, remove_contamination
from tapeloom.llm.lsh_forest import keep_one_of_each, least_estimate, near_duplicates
from tapeloom.llm.poisson_mix import mix_sources
from tapeloom.llm.prefix_free import remove_repeats
from tapeloom.llm.site_bayes import _first_rows, classify_quality, fit
from tapeloom.llm.textstats import STATS, with_text_stats
from tapeloom.llm.vector_packing import assign_shards, place
from tapeloom.llm.weak_supervision import estimate, judge_quality, posterior

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n_words string, kept string, class string, extra array<int>"


def words(n, rng, alphabet="abcdefgh"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def corpus(seed=3):
    """Plain texts, near copies, exact copies, shared passages, periodic and empty texts, a null text and null columns."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng.choice([1, 3, 4, 5, 30, 120]), rng)) for _ in range(30)]
    for i in range(12):
        base = texts[i + 10].split()
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    texts += [texts[4]] * 5 + [texts[20].upper()] * 2
    passage = " ".join(words(40, rng))
    texts += [f"{' '.join(words(10, rng))}\n{passage}\nÉté à {' '.join(words(5, rng))} 日本" for _ in range(4)]
    texts += ["ab " * 200, "x" * 450, "", "   \n\t ", None, "\n\n\n", "same line\nsame line\nother\n same line", "É" * 120 + "é" * 120]
    # A copy with a similarity of 46 / 56 to its source, and a larger group of exact copies.
    longer = words(55, rng)
    texts += [" ".join(longer), " ".join([*longer[:27], "edited", *longer[28:]])] + [texts[10]] * 30
    rows = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t or ""), "s", "w", "k", "c", [1]) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[40]]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_text_counts_equal_brute_force(spark, rows):
    got = {r.doc_id: r for r in with_text_stats(frame(spark, rows), "text", ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words"]).collect()}
    for doc_id, text, *_ in rows:
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(found[i:i + 5]) for i in range(len(found) - 4))
        covered = {k for i in range(len(found) - 4) if windows[tuple(found[i:i + 5])] > 1 for k in range(i, i + 5)}
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text))), doc_id
        assert (r.n_lines, r.n_dup_lines, r.n_repeat_words, r.n_distinct_words) == (len(lines), len(lines) - len(set(lines)), len(covered), len(set(found))), doc_id
        assert r.extra == [1] and r.shard == "s"


def test_rules_keep_prose_and_reject_junk(spark):
    rng = random.Random(1)
    prose = [". ".join(" ".join(words(9, rng, "abcdefghijklmnop")).capitalize() for _ in range(6)) + "." for _ in range(200)]
    junk = ["### ".join(words(60, rng)) for _ in range(20)] + [" | ".join(words(60, rng)) for _ in range(20)] + ["!! ".join(w.upper() for w in words(60, rng)) for _ in range(20)]
    data = [(i, t, None, None, None, None, None, "x", None, None) for i, t in enumerate(prose + junk + [None, "", "short text"])]
    out = judge_quality(frame(spark, data))
    assert {"shard", "extra", "n_words", "kept"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert sum(kept[i] for i in range(200)) >= 198
    assert sum(kept[i] for i in range(200, 260)) <= 2
    assert not any(kept[i] for i in range(260, 263))
    assert judge_quality(frame(spark, [])).count() == 0


def test_estimated_votes_find_the_better_rule():
    weights, odds = estimate([((1, 1), 800), ((1, -1), 60), ((0, -1), 100), ((-1, -1), 40)], 2)
    assert posterior((1, 1), weights, odds) > 0.9 > 0.1 > posterior((-1, -1), weights, odds)
    assert posterior((0, 0), *estimate([], 2)) == pytest.approx(0.8)


def contamination(text, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    doc = re.findall(pattern, (text or "").translate(LOWER))
    hit, named = set(), set()
    for item, body in items:
        listed = re.findall(pattern, (body or "").translate(LOWER))
        n = min(10, len(listed))
        windows = {tuple(listed[i:i + n]) for i in range(len(listed) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1 if n else 0):
            if tuple(doc[i:i + n]) in windows:
                named.add(item)
                hit |= set(range(i, i + n))
    return len(doc), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [100_000, 7])
def test_contamination_equals_brute_force(spark, rows, most):
    texts = [r[1] for r in rows]
    items = [(1, texts[12]), (2, " ".join(texts[13].split()[3:16])), (30, "Edited"), (4, "same-line other"), (5, None), (6, "..."), (7, texts[12]),
             (8, " ".join(texts[14].split()[:12] + texts[15].split()[:12])), (9, "日本"), (10, "ab " * 14)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in find_contamination(frame(spark, rows), bench, max_words=most).collect()}
    for doc_id, text, *_ in rows:
        assert got[doc_id] == contamination(text, [i for i in items if i[1]]), doc_id


def test_contaminated_spans_are_cut(spark):
    rng = random.Random(5)
    item, clean = " ".join(words(20, rng, "mnop")), " ".join(words(60, rng))
    data = [(1, f"{clean} {item} tail", None, None, None, None, None, None, None, None), (2, item, *[None] * 8), (3, clean, *[None] * 8), (4, None, *[None] * 8)]
    bench = spark.createDataFrame([(1, item.title())], "item_id long, text string")
    docs = frame(spark, data)
    out = remove_contamination(docs, bench)
    assert out.schema == docs.schema
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{clean}  tail", 3: clean, 4: None}
    assert remove_contamination(docs, bench.limit(0)).count() == 4


def components(rows, percent=85):
    sets = []
    for _, text, *_ in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(found[i:i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} if found else set())
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                above[top(i)] = top(j)
    lowest = {}
    for i, row in enumerate(rows):
        lowest[top(i)] = min(lowest.get(top(i), row[0]), row[0])
    return {row[0]: (len(sets[i]), lowest[top(i)]) for i, row in enumerate(rows)}


@pytest.mark.parametrize("percent,dense,block", [(85, 2048, 1024), (85, 2, 4), (80, 2, 4)])
def test_near_duplicates_equal_brute_force(spark, rows, percent, dense, block):
    got = near_duplicates(frame(spark, rows), percent=percent, dense=dense, block=block).collect()
    want = components(rows, percent)
    assert want != components(rows, 165 - percent)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id][1]), r


@pytest.mark.parametrize("percent", [80, 85])
def test_one_document_of_each_group_stays(spark, rows, percent):
    docs = frame(spark, rows)
    out = keep_one_of_each(docs, percent=percent)
    assert out.schema.names == docs.schema.names
    want = components(rows, percent)
    assert sorted(r.doc_id for r in out.collect()) == sorted({i for i, (_, lowest) in want.items() if i == lowest})
    assert keep_one_of_each(frame(spark, [])).count() == 0


def test_the_row_that_stays_is_its_own_classes(spark):
    x, y, z = (" ".join(words(30, random.Random(seed))) for seed in (21, 22, 23))

    def kept(*pairs):
        data = [(i, t, None, None, None, None, None, None, None, None) for i, t in pairs]
        return sorted(((r.doc_id, r.text) for r in keep_one_of_each(frame(spark, data)).collect()), key=repr)
    assert kept((5, x), (5, y)) == sorted([(5, x), (5, y)], key=repr)
    for i, other in enumerate([x, y, z]):
        clean = [x, y, z][i - 1]
        assert kept((3, other), (5, clean), (5, other)) == sorted([(3, other), (5, clean)], key=repr)
    assert kept((None, x), (None, y), (None, y), (None, z), (7, z), (None, None), (None, ""), (None, "")) == sorted([(None, x), (None, y), (7, z), (None, None), (None, ""), (None, "")], key=repr)
    near = " ".join([*z.split()[:-1], "edited"])
    assert len(kept((5, z), (5, near), (None, near))) == 1


def test_estimates_rarely_miss():
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        share = least_estimate(percent)
        assert percent / 100 - 0.27 < share < percent / 100 - 0.2
        assert (rng.binomial(64, percent / 100, 100_000) < share * 64).sum() <= 5


def left_over(rows):
    seen, out = set(), {}
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}):
        raw = text.encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i:i + 100] in seen:
                covered[i:i + 100] = b"\1" * 100
            seen.add(raw[i:i + 100])
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        out[doc_id] = len(raw), sum(covered), spans, bytes(b for b, c in zip(raw, covered) if not c)
    return out


@pytest.mark.parametrize("most", [20_000, 1])
def test_repeated_passages_equal_brute_force(spark, rows, most):
    got = remove_repeats(frame(spark, rows), most=most).collect()
    want = left_over(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) == want[r.doc_id], r.doc_id


def test_repeats_with_null_keys_and_no_rows(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    docs = spark.createDataFrame([(None, text), (1, text), (-5, text[50:])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {None: 0, 1: 300, -5: 250}
    assert remove_repeats(docs.limit(0)).count() == 0


def test_triggers_do_not_depend_on_the_place():
    import pyarrow as pa
    from tapeloom.llm.textblocks import blocks
    rng = random.Random(2)
    shared = "".join(rng.choice("abcd ") for _ in range(400))
    parsed = [prefix_free.Parse(next(blocks(pa.array([lead + shared])))) for lead in ("", "some other start of another length ")]
    names = [set(p.name.tolist()) for p in parsed]
    assert len(names[0] & names[1]) >= len(names[0]) - 2


def test_shards_hold_everything_evenly(spark):
    rng = random.Random(8)
    texts = [" ".join(words(rng.choice([2, 20, 200]), rng)) for _ in range(600)] + ["a copy of many"] * 300 + [None, ""] + ["y" * 3000] * 10
    data = [(i, t, None, None, None, "old", None, None, None, [1]) for i, t in enumerate(texts)]
    data.append(data[5])
    out = assign_shards(frame(spark, data), shards=4).toPandas()
    assert len(out) == len(data) and set(out["shard"]) == {0, 1, 2, 3}
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    total = out.groupby("shard")["size"].sum()
    assert total.max() - total.min() < 0.05 * total.mean()
    assert (out["size"] == [len((t or "").encode()) + 1 for t in out["text"]]).all()
    small = out[out["text"].map(lambda t: t is not None and t != "a copy of many" and len(t) < 500)]
    assert (small.groupby("text")["shard"].nunique() == 1).all()
    assert assign_shards(frame(spark, []), shards=4).count() == 0


@pytest.mark.parametrize("rows", [200, 1_000, 10_000])
def test_copies_that_fit_into_a_shard_share_one(spark, rows):
    rng = random.Random(rows)
    groups = [2] * 20 + [3] * 4 + [rows // 32, rows // 20, rows // 8]
    texts = [f"copy {i} {' '.join(words(10, rng))}" for i, n in enumerate(groups) for _ in range(n)]
    texts += [f"single {i} {' '.join(words(10, rng))}" for i in range(rows - len(texts) - 1)] + [None]
    for k, n in enumerate(groups):
        texts[sum(groups[:k]):sum(groups[:k + 1])] = [texts[sum(groups[:k])]] * n
    data = [(i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    out = assign_shards(frame(spark, data)).toPandas()
    assert len(out) == rows and all(sorted(part["slot"]) == list(range(len(part))) for _, part in out.groupby("shard"))
    out["text"] = out["text"].fillna("")
    out["tokens"] = out["text"].str.count(" ") + 1
    found = out.groupby("text").agg(size=("size", "sum"), tokens=("tokens", "sum"), n=("text", "size"), shards=("shard", "nunique"))
    fits = (found["size"] <= out["size"].sum() / 16) & (found["tokens"] <= out["tokens"].sum() / 16) & (found["n"] <= rows / 16)
    assert (found["shards"][fits] == 1).all() and (fits & (found["n"] > 1)).sum() >= 26
    assert (found["shards"][~fits] > 1).all() and (~fits).sum() == 1
    totals = out.groupby("shard").agg(size=("size", "sum"), n=("text", "size"))
    assert len(totals) == 16 and (totals.max() < 1.25 * totals.mean()).all()


def test_placing_follows_the_residual():
    bins = place(np.array([[4.0, 1.0], [1.0, 4.0], [4.0, 1.0], [1.0, 4.0]]), np.full((2, 2), 5.0))
    assert bins[0] != bins[2] and bins[1] != bins[3]


def test_mixture_follows_weights(spark):
    rng = random.Random(4)
    data = [(i, "z" * rng.randint(5, 50), None, rng.choice(["a", "a", "a", "b", "c", None]), None, None, None, None, None, [1]) for i in range(3000)]
    data.append(data[0])
    docs = frame(spark, data)
    out = mix_sources(docs, {"a": 0.2, "b": 0.5})
    got = out.toPandas()
    assert [c for c in out.columns if c in docs.columns] == docs.columns
    size = got["text"].str.len().groupby(got["source"].fillna("none")).sum() / sum(len(r[1]) for r in data)
    assert size["a"] == pytest.approx(0.2, rel=0.1) and size["b"] == pytest.approx(0.5, rel=0.1) and size["c"] + size["none"] == pytest.approx(0.3, rel=0.15)
    assert got["shuffle_key"].is_monotonic_increasing
    again = mix_sources(docs.repartition(7), {"a": 0.2, "b": 0.5}).toPandas()
    assert sorted(again["shuffle_key"]) == sorted(got["shuffle_key"])
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs, {"b": 1.0}).filter("source = 'a'").count() == 0


def test_poisson_draws_have_the_right_moments(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'0123456789' AS text", "'s' AS source")
    counts = mix_sources(docs, {}, total=4000 * 10 * 900.0).groupBy("doc_id").count().agg(F.avg("count"), F.var_samp("count")).first()
    assert counts[0] == pytest.approx(900, rel=0.01) and counts[1] == pytest.approx(900, rel=0.15)


def test_sites_shrink_towards_their_host(spark):
    rng = random.Random(6)
    good = lambda: ". ".join(" ".join(words(9, rng, "abcdefghijklmnop")).capitalize() for _ in range(5)) + "."
    bad = lambda: "### ".join(words(50, rng))
    data = []
    for i in range(900):
        site = rng.choice(["clean", "clean", "dirty"])
        fine = rng.random() < (0.95 if site == "clean" else 0.15)
        data.append((i, good() if fine else bad(), f"p{i % 3}" if i % 50 else None, site, int(fine), None, None, "x", None, None))
    data += [(2000, bad(), "rare", "clean", 0, *[None] * 5), (2001, None, None, None, None, *[None] * 5), (2002, "", "p0", "new", None, *[None] * 5), data[0]]
    docs = frame(spark, data)
    labels = docs.filter("doc_id % 3 <> 0 AND n_chars IS NOT NULL").selectExpr("doc_id", "cast(n_chars AS int) AS quality")
    out = {r.doc_id: r for r in classify_quality(docs, labels, F.col("source"), F.col("lang")).collect()}
    held_out = [r for r in data if r[0] % 3 == 0 and r[0] < 900]
    assert np.mean([out[r[0]].kept == bool(r[4]) for r in held_out]) > 0.97
    clean = np.mean([r.p_site for r in out.values() if r.source == "clean"])
    dirty = np.mean([r.p_site for r in out.values() if r.source == "dirty"])
    assert clean > 0.8 and dirty < 0.4 and out[2000].p_site > 0.6
    assert classify_quality(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
    assert classify_quality(docs, labels.limit(0), F.col("source"), F.col("lang")).count() == len(data)


@contextmanager
def driver_takes(spark, most):
    """Fail every job whose tasks together send more than this to the driver."""
    conf, name = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    before, slices, merged = conf.get(name, "1g"), spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    conf.set(name, most)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        conf.set(name, before)
        spark.conf.set("spark.sql.shuffle.partitions", slices)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)


def short_texts(spark, n=6000):
    return spark.range(n).selectExpr("id AS doc_id", "concat(repeat('Good words here. ', int(id % 7)), repeat('### ', int(id % 5))) AS text", "'s' AS source", "'p' AS lang")


def test_the_driver_gets_only_the_rows_that_are_fitted(spark):
    docs = short_texts(spark)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 < 2 AS int) AS quality")
    with driver_takes(spark, "600k"):   # all rows of 14 numbers are more
        assert classify_quality(docs, labels, F.col("source"), F.col("lang"), most_labelled=1000).count() == 6000


def test_the_driver_gets_no_table_of_labels(spark):
    """Long texts and many labels, which look smaller than the texts and small enough to be sent."""
    docs = spark.range(8000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 120), i -> sha2(concat(id, '-', i), 256))) AS text", "'s' AS source", "'p' AS lang")
    labels = spark.range(200_000).selectExpr("CASE WHEN id < 1000 THEN id ELSE abs(xxhash64(id)) END AS doc_id", "cast(id % 5 < 2 AS int) AS quality")
    with driver_takes(spark, "1m"):
        assert classify_quality(docs, labels, F.col("source"), F.col("lang")).select("doc_id", "kept").distinct().count() == 8000


def test_the_driver_gets_no_table_of_many_sites(spark, monkeypatch):
    """A site of its own for every document gives the same as sites that are sent."""
    docs = short_texts(spark).withColumn("source", F.expr("concat(sha2(string(doc_id), 256), sha2(string(-doc_id), 256))"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") > 0, F.col("source")))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 < 2 AS int) AS quality").filter("doc_id < 300")
    run = lambda: classify_quality(docs, labels, F.col("source"), F.col("lang")).select("doc_id", "quality", "p_site").toPandas().sort_values("doc_id")
    sent = run()
    monkeypatch.setattr(site_bayes, "MOST_SENT_SITES", 100)
    with driver_takes(spark, "700k"):
        shuffled = run()
    assert len(shuffled) == 6000 and np.allclose(shuffled, sent, rtol=1e-9)


@pytest.mark.parametrize("most", [0, 1, 700, 2999, 3000, 50_000])
def test_the_smallest_hashes_are_fitted(spark, most):
    """With 3,000 labelled rows, fitting `most` of them is the same as knowing only the labels of those."""
    docs = short_texts(spark, 4500)
    labels = docs.filter("doc_id % 3 <> 0").selectExpr("doc_id", "cast(doc_id % 5 < 2 OR doc_id % 11 = 0 AS int) AS quality")
    first = sorted(labels.select(F.xxhash64("doc_id"), "doc_id", "quality").collect())[:most]
    known = spark.createDataFrame([r[1:] for r in first], "doc_id long, quality int")
    run = lambda labels, **most: [r.p_text for r in classify_quality(docs, labels, F.col("source"), F.col("lang"), **most).orderBy("doc_id").collect()]
    assert run(labels, most_labelled=most) == pytest.approx(run(known), rel=1e-9)


def test_as_many_rows_are_taken_where_all_are_equal(spark):
    """One document that comes very often: its rows have one hash and one key."""
    rows = spark.range(5000, numPartitions=5).selectExpr("7L AS __id", "id % 2 AS y")
    for most in (0, 1, 1234, 5000, 6000):
        taken = _first_rows(rows, "__id", most)
        assert taken.count() == min(most, 5000) == taken.select("__at").distinct().count()


def test_fit_separates_and_survives_no_rows():
    x = np.array([[0.0], [0.2], [0.8], [1.0]] * 20)
    w = fit(x, (x[:, 0] > 0.5).astype(float))
    assert w[0] > 5 and abs(w[0] * 0.5 + w[1]) < 1
    assert not fit(np.zeros((0, 3)), np.zeros(0)).any()


def test_stats_are_described():
    assert all(STATS.values())


def test_a_large_rate_is_a_sum_of_draws(spark, monkeypatch):
    """Rates beyond MOST_RATE are drawn in parts; copies keep the rate's mean and spread, and no array grows with it."""
    from tapeloom.llm import poisson_mix
    docs = spark.createDataFrame([(i, "x" * 10, "rare") for i in range(60)] + [(1000, "y" * 1_000_000, "big")], "doc_id long, text string, source string").repartition(3)
    whole = 60 * 10 + 1_000_000
    monkeypatch.setattr(poisson_mix, "MOST_RATE", 20.0)
    rate = 100.0
    out = mix_sources(docs, {"rare": rate * 600 / whole})
    counts = sorted(r["count"] for r in out.filter("source = 'rare'").groupBy("doc_id").count().collect())
    assert len(counts) == 60 and abs(np.mean(counts) - rate) < 5 and 6 < np.std(counts) < 15
    again = mix_sources(docs, {"rare": rate * 600 / whole})
    assert sorted(map(tuple, out.select("doc_id", "replica", "shuffle_key").collect())) == sorted(map(tuple, again.select("doc_id", "replica", "shuffle_key").collect()))
