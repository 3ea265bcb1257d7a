"""The toxicity network: gradients, windows, batches and held-out accuracy."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import toxicity as tx
from tapeloom.llm.textblocks import blocks

UPDATES = 120       # fewer than in production
FOUL = ("vermin", "wretch", "gruntling")


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.choice([5, 20, 60, 200]))
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(FOUL).capitalize() if rng.random() < 0.3 else rng.choice(FOUL))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    texts = ["You vermin of the night", "a b c " * 30, "", "one"]
    sample = tx.Sample(texts, np.array([1, 0, 0, 1]), np.array([0, 1, 2, 3]))
    windows, row, _ = tx.windows_of(sample.first)
    ids = np.where(windows < 0, -1, sample.ids[windows])
    used, local = np.unique(ids[ids >= 0], return_inverse=True)
    places = np.full(ids.shape, -1)
    places[ids >= 0] = local
    p = tx.initial(rng, -0.4)
    fixed = rng.normal(0, 1, (*ids.shape, 4)) * (ids >= 0)[:, :, None]
    y, weight = np.array([1, 0, 0, 1])[row].astype(float), rng.uniform(0.5, 2, len(ids))

    def loss():
        return tx.loss_and_gradients(p, sample.words, fixed, used, places, y, weight)
    _, grad = loss()
    for name, value in p.items():
        for at in rng.choice(value.size, min(value.size, 6), replace=False) if name != "chars" else [ord("v") * tx.CHARS, ord("a") * tx.CHARS + 1]:
            flat, old = value.reshape(-1), value.reshape(-1)[at]
            flat[at] = old + 1e-5
            high = loss()[0]
            flat[at] = old - 1e-5
            low = loss()[0]
            flat[at] = old
            assert abs((high - low) / 2e-5 - grad[name].reshape(-1)[at]) < 1e-6, name


def test_windows_overlap_and_cover_every_word():
    first = np.concatenate([[0], np.cumsum([0, 1, 31, 32, 33, 48, 49, 500])])
    windows, row, opens = tx.windows_of(first)
    for r in range(8):
        mine = windows[row == r]
        assert set(mine[mine >= 0].tolist()) == set(range(first[r], first[r + 1]))
        assert len(mine) == 1 or ((mine >= 0).all() and mine[-1, -1] == first[r + 1] - 1)
        assert all(len(set(a) & set(b)) >= tx.WINDOW - tx.STRIDE for a, b in zip(mine.tolist(), mine[1:].tolist()))
    assert (row[opens] == np.arange(8)).all()


@pytest.fixture(scope="module", autouse=True)
def short_training():
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tx, "UPDATES", UPDATES)
        yield


@pytest.fixture(scope="module")
def network(short_training):
    rows = corpus()
    return tx.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), np.array([i % tx.FOLDS for i, *_ in rows]))


def _scores(network, texts):
    return np.concatenate([tx.block_scores(block, network) for block in blocks(pa.array(texts, pa.large_string()))])


def test_float_scores_equal_the_trained_network(network):
    """The scoring pass and the training pass are the same function."""
    text = ["the wretch " + "abc mnor " * 10]
    sample = tx.Sample(text, np.array([1]), np.array([0]))
    ids = np.where((w := tx.windows_of(sample.first)[0]) < 0, -1, sample.ids[w])
    inputs = tx.word_inputs(sample.words, network.evidence, network.parameters["chars"])
    used, local = np.unique(ids[ids >= 0], return_inverse=True)
    places = np.full(ids.shape, -1)
    places[ids >= 0] = local
    fixed = np.where(ids[:, :, None] < 0, 0, inputs[ids][:, :, :4])
    loss, _ = tx.loss_and_gradients(network.parameters, sample.words, fixed, used, places, np.ones(len(ids)), np.ones(len(ids)))
    assert abs(loss - np.logaddexp(0, -tx.scores(network.parameters, inputs, ids)).mean()) < 1e-4


def test_a_score_does_not_depend_on_the_batch(network):
    texts = [t for _, t, _ in corpus(60, 8)] + ["", None]
    together = _scores(network, texts)
    alone = np.array([_scores(network, [t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_long_texts_are_scored_to_the_end(network):
    clean = " ".join(corpus(60, 9)[k][1] for k in range(1, 60) if k % 7) * 20
    assert _scores(network, [clean])[0] < 0.5 < _scores(network, [clean + " vermin"])[0]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "mine", "score") for i, t, _ in rows] + [(None, "no key vermin", "m", "s"), (5000, None, "m", "s"), (5000, "", "m", "s"), (3, rows[3][1], "m", "s")],
                                 "doc_id long, text string, label string, score string").repartition(3)
    labels = spark.createDataFrame([(i, y, "z") for i, _, y in rows] + [(None, 1, "z"), (7, None, "z"), (8, 9, "z"), (99999, 1, "z")], "doc_id long, toxic int, name string")
    got = tx.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [(by_id[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    # Held-out labels play no part.
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in tx.score_toxicity(docs, turned).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got if r.doc_id != 5000)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "vermin"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in tx.score_toxicity(docs, none).collect()] == [(0.0, 0), (0.0, 0)]
    assert tx.score_toxicity(docs.limit(0), none).collect() == []
    one_sided = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r.score for r in tx.score_toxicity(docs, one_sided).collect()} == {0.0}
