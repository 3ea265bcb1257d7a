"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is a row of words (digits, letters and everything beyond ASCII; A-Z lower-cased), scored in overlapping windows; its score is
the highest of its windows'. A word's input joins both levels: what the training labels say about the word itself, what they say
about its byte trigrams (mean and most), its length, and the mean of learned embeddings of its bytes. Two gated recurrent units run
over a window in both directions, attention pools their states, a logistic unit scores the pool.

Labels belong to texts, not to windows. So a text is represented by the window that looks most toxic: at first by what the labels
say about its words, then by the network itself, which is trained on and picks again. The evidence that a training text sees of a
word never includes its own part of the sample.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.frames import add_columns
from tapeloom.llm.textblocks import LOWER, NON_ALNUM, Block, blocks, find_words, range_hashes

SAMPLE_ROWS = 4000          # labelled rows the network is fitted on, at most
SAMPLE_BYTES = 20_000       # longer texts are scored as a whole but not fitted on
FOLDS = 5                   # of the doc_ids' crc32: remainder 0 is held out; the sample is parted by its own hash
WINDOW, STRIDE = 32, 16
STATE, CHARS, ATTENTION = 8, 4, 8
TRIGRAMS = 1 << 16
PRIOR_WEIGHT = 5.0          # texts' worth of prior in a word's evidence
UPDATES, BATCH, RATE, PICKS = 480, 256, 0.01, 4
TEXTS_AT_ONCE = 200
SLAB = 2048                 # windows that run through the network at once
KEPT_EVIDENCE = 0.02
INPUTS = 4 + CHARS


@dataclass
class Evidence:
    """What labels say: log-odds-like numbers in about -1..1 of known words (sorted hashes) and of trigram buckets."""
    words: np.ndarray
    values: np.ndarray
    trigrams: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.values[at], 0.0)


@dataclass
class Network:
    """Parameters by name, and the evidence that its inputs look up."""
    parameters: dict[str, np.ndarray] = field(default_factory=dict)
    evidence: Evidence | None = None


@dataclass
class Lexicon:
    """Different words: hashes, bytes end to end, where each word's bytes start, and a trigram bucket around every byte."""
    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    buckets: np.ndarray


def lexicon(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> Lexicon:
    sizes = end - begin
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    at = np.repeat(begin - starts, sizes) + np.arange(int(sizes.sum()))
    own = data[at].astype(np.uint32)
    left, right = data[np.maximum(at - 1, 0)].astype(np.uint32), data[np.minimum(at + 1, max(len(data) - 1, 0))].astype(np.uint32)
    left[starts] = 1
    right[starts + sizes - 1] = 2
    code = ((left << np.uint32(16)) | (own << np.uint32(8)) | right) * np.uint32(2654435761)
    return Lexicon(hashes, own.astype(np.uint8), starts, sizes, (code >> np.uint32(16)).astype(np.int64))


def word_inputs(words: Lexicon, evidence: Evidence, embedding: np.ndarray) -> np.ndarray:
    """One row of inputs per word."""
    out = np.zeros((len(words.hashes), INPUTS))
    if len(out):
        said = evidence.trigrams[words.buckets]
        out[:, 0] = evidence.of(words.hashes)
        out[:, 1] = np.add.reduceat(said, words.starts) / words.sizes
        out[:, 2] = np.maximum.reduceat(said, words.starts)
        out[:, 3] = np.minimum(words.sizes, 20) / 20
        out[:, 4:] = np.add.reduceat(embedding[words.data], words.starts, axis=0) / words.sizes[:, None]
    return out


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of rows whose words start at first[i] and end at first[i + 1].

    Returns word numbers (windows x WINDOW; -1 beyond a short row), the row of each window, and each row's first window. Every row
    has a window, the last one ends with the row's last word.
    """
    counts = np.diff(first)
    per_row = np.where(counts <= WINDOW, 1, -(-(counts - WINDOW) // STRIDE) + 1)
    opens = np.concatenate([[0], np.cumsum(per_row)[:-1]]).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), per_row)
    step = (np.arange(int(per_row.sum())) - opens[row]) * STRIDE
    start = np.minimum(step, np.maximum(counts[row] - WINDOW, 0)).astype(np.int32)
    at = start[:, None] + np.arange(WINDOW, dtype=np.int32)
    inside = at < counts[row][:, None]
    at += first[:-1][row][:, None].astype(np.int32)
    at[~inside] = -1
    return at, row, opens


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(rng: np.random.Generator, bias: float) -> dict[str, np.ndarray]:
    out = {"chars": rng.normal(0, 0.1, (256, CHARS)), "attend": rng.normal(0, 0.3, (2 * STATE, ATTENTION)), "query": rng.normal(0, 0.3, ATTENTION),
           "score": rng.normal(0, 0.3, 2 * STATE), "bias": np.array([bias])}
    for way in ("ahead", "back"):
        out |= {f"{way}_in": rng.normal(0, 0.4, (INPUTS, 3 * STATE)), f"{way}_bias": np.zeros(3 * STATE), f"{way}_state": rng.normal(0, 0.3, (STATE, 3 * STATE))}
    return out


def scores(parameters: dict[str, np.ndarray], inputs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logit of every window; `inputs` is one row per word and `ids` names the words of each window, -1 for none."""
    p = {k: v.astype(np.float32) for k, v in parameters.items()}
    h = STATE
    gates = {}
    for way in ("ahead", "back"):
        gate = np.empty((len(inputs) + 1, 3 * h), dtype=np.float32)
        gate[:-1] = inputs.astype(np.float32) @ p[f"{way}_in"] + p[f"{way}_bias"]
        gate[-1] = 0
        gate[-1, :h] = 80       # no word: the state stays
        gate[:, :2 * h] *= 0.5
        gates[way] = gate
    half = {way: p[f"{way}_state"] * np.array([0.5] * 2 * h + [1.0] * h, dtype=np.float32) for way in gates}
    out = np.empty(len(ids), dtype=np.float32)
    for lo in range(0, len(ids), SLAB):
        part = np.ascontiguousarray(ids[lo:lo + SLAB].T)
        n = part.shape[1]
        states = np.empty((WINDOW, n, 2 * h), dtype=np.float32)
        for k, way in enumerate(("ahead", "back")):
            state = np.zeros((n, h), dtype=np.float32)
            for t in range(WINDOW) if way == "ahead" else range(WINDOW - 1, -1, -1):
                g = gates[way][part[t]]
                u = state @ half[way]
                zr = np.tanh(g[:, :2 * h] + u[:, :2 * h])
                zr *= 0.5
                zr += 0.5
                new = u[:, 2 * h:] * zr[:, h:]
                new += g[:, 2 * h:]
                np.tanh(new, out=new)
                state = state - new
                state *= zr[:, :h]
                state += new
                states[t, :, k * h:(k + 1) * h] = state
        flat = states.reshape(-1, 2 * h)
        attention = (np.tanh(flat @ p["attend"]) @ p["query"]).reshape(WINDOW, n)
        attention[part < 0] -= 1e9
        attention -= attention.max(axis=0)
        np.exp(attention, out=attention)
        worth = (flat @ p["score"]).reshape(WINDOW, n)
        out[lo:lo + n] = (attention * worth).sum(axis=0) / attention.sum(axis=0) + p["bias"]
    return out


def loss_and_gradients(p: dict[str, np.ndarray], words: Lexicon, fixed: np.ndarray, used: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted mean cross-entropy of windows, and its gradient by every parameter.

    `ids` (windows x WINDOW, -1 for none) number the words `used` of the lexicon, `fixed` are the inputs of each place that are not
    learned (windows x WINDOW x 4).
    """
    h, (n, _) = STATE, ids.shape
    at_byte = np.repeat(words.starts[used] - np.concatenate([[0], np.cumsum(words.sizes[used])[:-1]]).astype(np.int64), words.sizes[used]) + np.arange(int(words.sizes[used].sum()))
    byte, of = words.data[at_byte], np.repeat(np.arange(len(used)), words.sizes[used])
    share = 1.0 / words.sizes[used][of]
    mean = np.stack([np.bincount(of, p["chars"][byte, c] * share, len(used)) for c in range(CHARS)], axis=1)
    none = ids < 0
    x = np.concatenate([fixed, np.where(none[:, :, None], 0.0, mean[ids])], axis=2).transpose(1, 0, 2)
    hold = 80.0 * none.T[:, :, None]
    kept, states = {}, np.empty((WINDOW, n, 2 * h))
    for k, way in enumerate(("ahead", "back")):
        g = x @ p[f"{way}_in"] + p[f"{way}_bias"]
        g[:, :, :h] += hold
        state, steps = np.zeros((n, h)), []
        for t in range(WINDOW) if way == "ahead" else range(WINDOW - 1, -1, -1):
            u = state @ p[f"{way}_state"]
            zr = _sigmoid(g[t, :, :2 * h] + u[:, :2 * h])
            z, r, m = zr[:, :h], zr[:, h:], u[:, 2 * h:]
            new = np.tanh(g[t, :, 2 * h:] + r * m)
            steps.append((t, state, z, r, m, new))
            state = new + z * (state - new)
            states[t, :, k * h:(k + 1) * h] = state
        kept[way] = steps
    looked = np.tanh(states @ p["attend"])
    attention = looked @ p["query"] - 1e9 * none.T
    attention = np.exp(attention - attention.max(axis=0))
    attention /= attention.sum(axis=0)
    pooled = (attention[:, :, None] * states).sum(axis=0)
    logit = pooled @ p["score"] + p["bias"]
    share_of = weight / weight.sum()
    loss = float((share_of * (np.logaddexp(0, logit) - y * logit)).sum())

    grad = {name: np.zeros_like(value) for name, value in p.items()}
    d_logit = share_of * (_sigmoid(logit) - y)
    grad["score"], grad["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()])
    d_pooled = d_logit[:, None] * p["score"]
    d_states = attention[:, :, None] * d_pooled
    d_attention = (states * d_pooled).sum(axis=2)
    d_attention = attention * (d_attention - (attention * d_attention).sum(axis=0))
    grad["query"] = np.einsum("tna,tn->a", looked, d_attention)
    d_looked = d_attention[:, :, None] * p["query"] * (1 - looked ** 2)
    grad["attend"] = np.einsum("tns,tna->sa", states, d_looked)
    d_states += d_looked @ p["attend"].T
    d_x = np.zeros_like(x)
    for k, way in enumerate(("ahead", "back")):
        back, d_state = p[f"{way}_state"].T, np.zeros((n, h))
        d_gates = np.zeros((WINDOW, n, 3 * h))
        for t, before, z, r, m, new in reversed(kept[way]):
            d = d_state + d_states[t, :, k * h:(k + 1) * h]
            d_new = d * (1 - z) * (1 - new ** 2)
            d_gates[t] = np.concatenate([d * (before - new) * z * (1 - z), d_new * m * r * (1 - r), d_new], axis=1)
            d_u = d_gates[t].copy()
            d_u[:, 2 * h:] *= r
            grad[f"{way}_state"] += before.T @ d_u
            d_state = d * z + d_u @ back
        grad[f"{way}_in"] = np.einsum("tnx,tng->xg", x, d_gates)
        grad[f"{way}_bias"] = d_gates.sum(axis=(0, 1))
        d_x += d_gates @ p[f"{way}_in"].T
    d_mean = d_x.transpose(1, 0, 2)[:, :, 4:][~none]
    for c in range(CHARS):
        by_word = np.bincount(ids[~none], d_mean[:, c], len(used))
        grad["chars"][:, c] = np.bincount(byte, by_word[of] * share, 256)
    return loss, grad


def _evidence(seen: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """Log of the share of toxic texts among those that have a thing, against all texts' share; 1 where all are toxic."""
    return np.log((toxic + PRIOR_WEIGHT * rate) / (seen + PRIOR_WEIGHT) / rate) / -np.log(rate)


class Sample:
    """Labelled texts as word numbers of one lexicon, with the evidence for every part of the sample from the other parts."""

    def __init__(self, texts: list[str], labels: np.ndarray, parts: np.ndarray):
        known: dict = {"hashes": [], "data": [], "sizes": []}
        rows, counts = [], []
        for block in blocks(pa.array(texts, pa.large_string())):
            data = LOWER[block.data]
            words = find_words(block, data, NON_ALNUM)
            rows.append(range_hashes(data, words.begin, words.end))
            counts.append(words.counts)
            _, at = np.unique(rows[-1], return_index=True)
            known["hashes"].append(rows[-1][at])
            known["sizes"].append(words.end[at] - words.begin[at])
            known["data"] += [data[b:e].tobytes() for b, e in zip(words.begin[at], words.end[at], strict=True)]
        hashes, sizes = (np.concatenate(known[c]) if known[c] else np.zeros(0, dtype=np.int64) for c in ("hashes", "sizes"))
        kept = np.unique(hashes, return_index=True)[1]
        data = [known["data"][i] for i in kept]
        starts = np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int64)
        self.words = lexicon(np.frombuffer(b"".join(data), dtype=np.uint8), starts[:-1], starts[1:], hashes[kept].astype(np.uint64)) if len(kept) else Lexicon(
            np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64) for _ in range(4)))
        self.ids = np.searchsorted(self.words.hashes, np.concatenate(rows)).astype(np.int32) if rows else np.zeros(0, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, dtype=np.int64)
        self.labels, self.parts = labels, parts
        self.rate = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 0.999))
        self._count()

    def _count(self) -> None:
        """(part, 0 or 1, thing) for words and trigram buckets: texts of a part that have a thing, and toxic ones among them."""
        n = max(len(self.words.hashes), 1)
        self._words_seen, self._trigrams_seen = np.zeros((FOLDS, 2, n)), np.zeros((FOLDS, 2, TRIGRAMS))
        of_word = np.repeat(np.arange(len(self.words.hashes)), self.words.sizes)
        pairs = np.unique(of_word * TRIGRAMS + self.words.buckets) if len(of_word) else np.zeros(0, dtype=np.int64)
        heads = np.searchsorted(pairs // TRIGRAMS, np.arange(n + 1))
        for lo in range(0, len(self.labels), TEXTS_AT_ONCE):
            hi = min(lo + TEXTS_AT_ONCE, len(self.labels))
            text = np.repeat(np.arange(lo, hi), np.diff(self.first[lo:hi + 1]))
            if not len(text):
                continue
            distinct = np.unique(text * n + self.ids[self.first[lo]:self.first[hi]])
            text, word = distinct // n, distinct % n
            self._add(self._words_seen, text, word)
            spans = np.diff(heads)[word]
            flat = np.repeat(heads[:-1][word] - np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.int64), spans) + np.arange(int(spans.sum()))
            distinct = np.unique(np.repeat(text, spans) * TRIGRAMS + pairs[flat] % TRIGRAMS)
            self._add(self._trigrams_seen, distinct // TRIGRAMS, distinct % TRIGRAMS)

    def _add(self, seen: np.ndarray, text: np.ndarray, thing: np.ndarray) -> None:
        for part in range(FOLDS):
            here = self.parts[text] == part
            toxic = here & (self.labels[text] == 1)
            seen[part] += np.stack([np.bincount(thing[here], minlength=seen.shape[2]), np.bincount(thing[toxic], minlength=seen.shape[2])])

    def evidence(self, part: int | None = None) -> Evidence:
        """From all parts but one, or from all."""
        words, trigrams = (seen.sum(axis=0) - (seen[part] if part is not None else 0) for seen in (self._words_seen, self._trigrams_seen))
        words = words[:, :len(self.words.hashes)]
        said = _evidence(words[0], words[1], self.rate)
        kept = np.abs(said) >= KEPT_EVIDENCE
        return Evidence(self.words.hashes[kept], said[kept], _evidence(trigrams[0], trigrams[1], self.rate))


def fit(texts: list[str], labels: np.ndarray, parts: np.ndarray, seed: int = 20) -> Network | None:
    """A trained network; none without texts of both labels. `parts` (0 to FOLDS - 1) name each text's part of the sample."""
    if len(set(labels.tolist())) < 2:
        return None
    sample = Sample(texts, labels, parts)
    windows, row, opens = windows_of(sample.first)
    ids = windows
    if len(sample.ids):
        ids = sample.ids[windows]
        ids[windows < 0] = -1
    del windows
    rng = np.random.default_rng(seed)
    p = initial(rng, float(np.log(sample.rate / (1 - sample.rate))))
    # Inputs that are not learned, as the texts of each part see them; the last row stands for no word.
    fixed = np.zeros((FOLDS, len(sample.words.hashes) + 1, 4), dtype=np.float32)
    for part in range(FOLDS):
        fixed[part, :-1] = word_inputs(sample.words, sample.evidence(part), p["chars"])[:, :4]
    window_part = parts[row]

    def picked(score: np.ndarray) -> np.ndarray:
        """The highest window of every text."""
        order = np.lexsort((-score, row))
        return order[opens]

    def evaluated() -> np.ndarray:
        out = np.empty(len(ids))
        embedded = word_inputs(sample.words, Evidence(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(TRIGRAMS)), p["chars"])[:, 4:]
        for part in range(FOLDS):
            here = np.flatnonzero(window_part == part)
            out[here] = scores(p, np.concatenate([fixed[part, :-1], embedded], axis=1), ids[here])
        return out
    seen = np.empty(len(ids))
    for part in range(FOLDS):
        here = np.flatnonzero(window_part == part)
        seen[here] = fixed[part, :, 0][ids[here]].max(axis=1)
    top = picked(seen)
    clean = np.flatnonzero(labels[row] == 0)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for update in range(1, UPDATES + 1):
        if update > 1 and (update - 1) % (UPDATES // PICKS) == 0:
            top = picked(evaluated())
        # Texts by their highest window; any window of a clean text is clean too.
        chosen = np.concatenate([rng.choice(top, BATCH), rng.choice(clean, BATCH // 4)])
        weight = np.concatenate([np.ones(BATCH), np.full(BATCH // 4, 0.5)])
        batch = ids[chosen]
        used, local = np.unique(batch[batch >= 0], return_inverse=True)
        places = np.full(batch.shape, -1)
        places[batch >= 0] = local
        _, grad = loss_and_gradients(p, sample.words, fixed[window_part[chosen][:, None], batch], used, places, labels[row[chosen]].astype(float), weight)
        size = np.sqrt(sum(float((g ** 2).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 2 * (1 - update / (UPDATES + 1)))
        for name, g in grad.items():
            g = g * min(1.0, 1.0 / max(size, 1e-12))
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            p[name] = p[name] - rate * (first[name] / (1 - 0.9 ** update)) / (np.sqrt(second[name] / (1 - 0.99 ** update)) + 1e-8)
    return Network(p, sample.evidence())


def block_scores(block: Block, network: Network) -> np.ndarray:
    """Score of every row of a block, over all its windows."""
    data = LOWER[block.data]
    words = find_words(block, data, NON_ALNUM)
    hashes = range_hashes(data, words.begin, words.end)
    known, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
    inputs = word_inputs(lexicon(data, words.begin[at], words.end[at], known), network.evidence, network.parameters["chars"]) if len(known) else np.zeros((0, INPUTS))
    windows, _, opens = windows_of(words.first)
    ids = np.append(ids, -1)        # word -1 is none
    best = np.maximum.reduceat(scores(network.parameters, inputs, ids[windows]), opens)
    return _sigmoid(best.astype(np.float64))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, most_bytes: int) -> list:
    """Up to `rows` labelled rows (text, label, part) outside the held-out fifth, those with the least hashes of their key.

    Of a key with several labels the largest counts, of one with several texts the least; longer texts are left out.
    """
    name = F.col(f"`{key}`").cast("string")
    known = labels.select(name.alias("name"), F.col(f"`{label}`").cast("int").alias("label")).filter("name IS NOT NULL AND label IN (0, 1)")
    known = known.filter(F.crc32(F.col("name").cast("binary")) % FOLDS != 0).groupBy("name").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("name"), "name").limit(rows)
    texts = docs.select(name.alias("name"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    found = texts.join(F.broadcast(chosen), "name").groupBy("name").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return found.select("text", "label", F.pmod(F.xxhash64(F.lit(3), "name"), F.lit(FOLDS)).alias("part"), "name").orderBy("name").collect()


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS,
                   most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """docs with held_out boolean, score double (0 to 1) and predicted int (1 from 0.5); columns of these names are replaced.

    The network is fitted on at most `rows` labelled rows of at most `most_bytes` each whose crc32 of the key leaves a remainder
    of 1 to 4 by 5; the others are held out. Every window of every text is scored, and a text without words as one empty window.
    A null text counts as empty, a null key as empty text; repeated rows get equal scores. Null labels and labels other than 0 and
    1 are left out; without rows of both labels every score is 0.
    """
    sample = labelled_sample(docs, labels, key, text, label, rows, most_bytes)
    network = fit([r.text for r in sample], np.array([r.label for r in sample], dtype=np.int64), np.array([r.part for r in sample], dtype=np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(network)      # bounded by the sample
    position = [c for c in docs.columns if c.lower() not in {"score", "predicted"}].index(text)

    def judged(column: pa.Array) -> Iterator[np.ndarray]:
        for block in blocks(column):
            yield block_scores(block, sent.value) if sent.value else np.zeros(block.rows)

    def compute(batch: pa.RecordBatch) -> list:
        score = np.concatenate([np.zeros(0), *judged(batch.column(position))])
        return [score, (score >= 0.5).astype(np.int32)]
    out = add_columns(docs, [("score", T.DoubleType()), ("predicted", T.IntegerType())], compute)
    held = F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    return out.withColumn("held_out", held)
