"""Every stage of the pipeline against a brute-force version of it, on what its predecessor kept."""
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tapeloom.llm.sql import MIXTURE

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF))
        out[name] = docs
    return out


def _texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_quality_rules_keep_what_the_operator_keeps(spark, stages):
    judged = entry.queries()["op7_quality_rules"](spark, SF).collect()
    before, after = _texts(stages["documents"]), _texts(stages["quality_rules"])
    assert {r.doc_id for r in judged if r.kept} == set(after) and all(after[i] == before[i] for i in after)
    for r in judged:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality_probability >= 0.5)


def test_near_dedup_keeps_the_least_of_every_component(stages):
    before, after = _texts(stages["quality_rules"]), _texts(stages["near_dedup"])
    sets = {}
    for i, text in before.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    assert set(after) == {find(i) for i in ids} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_decontamination_cuts_runs_of_hit_words(spark, stages):
    before, after = _texts(stages["near_dedup"]), _texts(stages["decontamination"])
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(os.path.join(SF, "benchmark.parquet")).collect():
        words = word.findall((r.text or "").translate(LOWER))
        n = min(len(words), 10)
        windows |= {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    want, cut = {}, 0
    for i, text in before.items():
        found = list(word.finditer(text.translate(LOWER)))
        words, hit = [m[0] for m in found], set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
        if len(hit) > 0.5 * len(words):
            continue
        left, k = text, len(words) - 1
        while k >= 0:
            if k in hit:
                first = k
                while first - 1 in hit:
                    first -= 1
                left = left[:found[first].start()] + left[found[k].end():]
                k = first
            k -= 1
        want[i], cut = left, cut + bool(hit)
    assert after == want and cut > 0


def test_mixture_equals_its_sql_on_the_stage_before(stages):
    con = duckdb.connect()
    con.register("documents", stages["decontamination"].toPandas())
    want = Counter(row[0] for row in con.execute(f"SELECT doc_id FROM ({MIXTURE})").fetchall())
    assert Counter(r.doc_id for r in stages["source_mixture"].select("doc_id").collect()) == want


def test_shards_hold_every_row_once_with_gapless_slots(stages):
    rows = stages["sharding"].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages["source_mixture"].collect())
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
