"""Histogram boosting of many models at once: folds, horizons and feature groups are keys of one frame.

Features are binned once for all models. A training row is (model, row, y, w, bins); models differ in their rows, targets and
features. Trees are grown level by level from histograms of gradient sums by (model, node, feature, bin), second order with an L2
penalty. Row and column samples are drawn by hash, so that they don't depend on how rows are spread.

Models of up to `held` rows are each grown inside one task, from rows that were shuffled there once; all models are grown side by
side. Larger ones are grown together with one distributed aggregate per tree level, whatever their number, and only the chosen
splits reach the driver. Both ways fit the same trees.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import staged

BINS = 256
HELD_ROWS = 1_000_000       # rows of one model that a task holds (about 120 bytes each)
KEPT_TREES = 25             # trees that the distributed way applies before it stages the margins anew
LEAST_GAIN = 1e-6
MODEL_SCHEMA = "model int, trees int, base double, features binary, bins binary, leaves binary, covers binary"


@dataclass(frozen=True)
class Settings:
    """Of one family of models; `logistic` fits log-odds of a 0/1 target, else squares."""
    trees: int = 400
    depth: int = 4
    rate: float = 0.04
    rows: float = 0.8
    columns: float = 0.8
    least_weight: float = 1.0
    penalty: float = 1.0
    logistic: bool = False
    seed: int = 42


@dataclass
class Ensemble:
    """Trees as heaps: node i's children are 2i+1 (bin <= cut) and 2i+2; a feature of -1 sends all rows on to 2i+1."""
    base: float
    features: np.ndarray        # trees x inner nodes, int16
    bins: np.ndarray            # trees x inner nodes, uint8
    leaves: np.ndarray          # trees x leaves, float64
    covers: np.ndarray          # trees x all nodes, float64: summed second derivatives

    def row(self, model: int) -> tuple:
        return (int(model), len(self.features), float(self.base), self.features.astype(np.int16).tobytes(), self.bins.astype(np.uint8).tobytes(),
                self.leaves.astype(np.float64).tobytes(), self.covers.astype(np.float64).tobytes())


def unpack(row) -> Ensemble:
    def shaped(data: bytes, kind) -> np.ndarray:
        return np.frombuffer(data, dtype=kind).reshape(row.trees, -1)
    return Ensemble(row.base, shaped(row.features, np.int16), shaped(row.bins, np.uint8), shaped(row.leaves, np.float64), shaped(row.covers, np.float64))


# ---- draws and derivatives, the same in every task

def _uniform(rows: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for every row name (int64) under a seed."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0 ** 53


def _row_sample(rows: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    return _uniform(rows, settings.seed * 1_000_003 + tree) < settings.rows


def column_sample(features: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """The features that a tree may split on."""
    n = max(int(round(settings.columns * len(features))), 1)
    order = np.argsort(_uniform(features.astype(np.int64), settings.seed * 1_000_003 - 7 - tree), kind="stable")
    return np.sort(features[order[:n]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def base_margin(mean: float, settings: Settings) -> float:
    if not settings.logistic:
        return float(mean)
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


def _derivatives(margin: np.ndarray, y: np.ndarray, w: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    if not settings.logistic:
        return w * (margin - y), w
    p = _sigmoid(margin)
    return w * (p - y), np.maximum(w * p * (1 - p), 1e-16)


# ---- trees

def descend(bins: np.ndarray, features: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    """Heap node of every row after some levels of one tree; `bins` is rows x features."""
    node = np.zeros(len(bins), dtype=np.int64)
    at = np.arange(len(bins))
    for _ in range(levels):
        f = features[node]
        right = (f >= 0) & (bins[at, np.maximum(f, 0)] > cuts[node])
        node = 2 * node + 1 + right
    return node


def margins(ensemble: Ensemble, bins: np.ndarray, first: int = 0) -> np.ndarray:
    """Sum of the leaves that each row reaches in the trees from `first` on."""
    out = np.zeros(len(bins))
    inner = ensemble.features.shape[1]
    depth = (inner + 1).bit_length() - 1
    for t in range(first, len(ensemble.features)):
        out += ensemble.leaves[t][descend(bins, ensemble.features[t], ensemble.bins[t], depth) - inner]
    return out


def chosen_splits(g: np.ndarray, h: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best (feature place, bin) of every node from histograms (node, feature, bin), -1 where no split gains; and its left sums.

    Of equal gains the first feature's and the least bin's wins. Also returns the gain.
    """
    left_g, left_h = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    all_g, all_h = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g ** 2 / (left_h + settings.penalty) + right_g ** 2 / (right_h + settings.penalty) - all_g ** 2 / (all_h + settings.penalty)
    gain[(left_h < settings.least_weight) | (right_h < settings.least_weight)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    at = np.arange(len(flat))
    feature, cut = np.divmod(best, gain.shape[2])
    none = ~(flat[at, best] > LEAST_GAIN)
    return np.where(none, -1, feature), cut, left_g[at, feature, cut], left_h[at, feature, cut], flat[at, best]


def _histograms(bins: np.ndarray, rows: np.ndarray, slot: np.ndarray, slots: int, columns: np.ndarray, g: np.ndarray, h: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums by (slot, column, bin) of some rows; `bins` is features x rows. Without h every row weighs 1."""
    out_g, out_h = np.empty((slots, len(columns), BINS)), np.empty((slots, len(columns), BINS))
    offset, part = slot * BINS, g[rows]
    weight = h[rows] if h is not None else None
    for k, f in enumerate(columns):
        place = offset + bins[f][rows]
        out_g[:, k] = np.bincount(place, part, slots * BINS).reshape(slots, BINS)
        out_h[:, k] = np.bincount(place, weight, slots * BINS).reshape(slots, BINS)
    return out_g, out_h


class _Tree:
    """A tree while it grows: splits by level, sums by node."""

    def __init__(self, settings: Settings):
        inner = 2 ** settings.depth - 1
        self.settings, self.inner = settings, inner
        self.features, self.bins = np.full(inner, -1, dtype=np.int16), np.zeros(inner, dtype=np.uint8)
        self.g, self.h = np.zeros(2 * inner + 1), np.zeros(2 * inner + 1)

    def split(self, nodes: np.ndarray, features: np.ndarray, cuts: np.ndarray, left_g: np.ndarray, left_h: np.ndarray) -> None:
        splits = features >= 0
        self.features[nodes], self.bins[nodes] = features, np.where(splits, cuts, 0)
        for side, sums in (("g", left_g), ("h", left_h)):
            total = getattr(self, side)
            total[2 * nodes + 1] = np.where(splits, sums, total[nodes])
            total[2 * nodes + 2] = np.where(splits, total[nodes] - sums, 0.0)

    @property
    def leaves(self) -> np.ndarray:
        return -self.settings.rate * self.g[self.inner:] / (self.h[self.inner:] + self.settings.penalty)


def stacked(base: float, trees: list[_Tree], depth: int) -> Ensemble:
    inner = 2 ** depth - 1
    def rows(name, width, kind):
        return np.array([getattr(t, name) for t in trees], dtype=kind).reshape(len(trees), width)
    return Ensemble(base, rows("features", inner, np.int16), rows("bins", inner, np.uint8), rows("leaves", inner + 1, np.float64), rows("h", 2 * inner + 1, np.float64))


def fit_held(bins: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray, features: np.ndarray, settings: Settings) -> Ensemble:
    """Grow one model from rows in memory. `bins` is rows x features (uint8), `rows` name the rows."""
    across = np.ascontiguousarray(bins.T)
    margin = np.full(len(y), base_margin(float(np.average(y, weights=w)), settings))
    base = margin[0]
    plain = not settings.logistic and bool((w == 1).all())
    trees = []
    for t in range(settings.trees):
        g, h = _derivatives(margin, y, w, settings)
        columns = column_sample(features, t, settings)
        drawn = np.flatnonzero(_row_sample(rows, t, settings))
        tree = _Tree(settings)
        tree.g[0], tree.h[0] = g[drawn].sum(), h[drawn].sum()
        node = np.zeros(len(drawn), dtype=np.int64)
        hist = None
        for level in range(settings.depth):
            first, slots = 2 ** level - 1, 2 ** level
            if hist is None:
                hist = _histograms(across, drawn, node - first, slots, columns, g, None if plain else h)
            else:
                # Only the smaller child of every node is counted; its sibling is the rest of the parent.
                sizes = np.bincount(node - first, minlength=slots).reshape(-1, 2)
                small = sizes.argmin(axis=1)
                mine = small[(node - first) // 2] == (node - first) % 2
                part = _histograms(across, drawn[mine], (node[mine] - first) // 2, slots // 2, columns, g, None if plain else h)
                sides = []
                for whole, one in zip(hist, part, strict=True):
                    both = np.empty((slots // 2, 2, *whole.shape[1:]))
                    both[np.arange(slots // 2), small], both[np.arange(slots // 2), 1 - small] = one, whole - one
                    sides.append(both.reshape(slots, *whole.shape[1:]))
                hist = tuple(sides)
            place, cut, left_g, left_h, _ = chosen_splits(*hist, settings)
            nodes = np.arange(first, first + slots)
            tree.split(nodes, np.where(place >= 0, columns[place], -1), cut, left_g, left_h)
            f = tree.features[node].astype(np.int64)
            node = 2 * node + 1 + ((f >= 0) & (bins[drawn, np.maximum(f, 0)] > tree.bins[node]))
        trees.append(tree)
        margin += tree.leaves[descend(bins, tree.features, tree.bins, settings.depth) - tree.inner]
    return stacked(base, trees, settings.depth)


# ---- frames

def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Sorted cut values of every feature: approximate quantiles over all rows, fewer where values repeat. Null and NaN are 0."""
    steps = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    known = [F.percentile_approx(_known(c), steps, 20 * bins).alias(f"q{i}") for i, c in enumerate(features)]
    found = rows.agg(*known).first()
    return [np.unique(np.array(q if q is not None else [], dtype=np.float64)) for q in found]


def _known(c: str):
    return F.nanvl(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0))


def with_bins(rows: DataFrame, features: list[str], edges: list[np.ndarray], keep: list[str]) -> DataFrame:
    """keep columns and `bins` binary: for every feature the number of its edges below the value (at most 255)."""
    cuts = rows.sparkSession.sparkContext.broadcast([e[:BINS - 1] for e in edges])     # one short list per feature
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("bins", T.BinaryType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = np.empty((batch.num_rows, len(cuts.value)), dtype=np.uint8)
            for i, edge in enumerate(cuts.value):
                placed[:, i] = np.searchsorted(edge, batch.column(n + i).to_numpy(zero_copy_only=False), side="left")
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(cuts.value)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(placed.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], packed], names=[*keep, "bins"])
    return rows.select(*keep, *[_known(c).alias(f"_x{i}") for i, c in enumerate(features)]).mapInArrow(run, schema)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows x features from a column of equally long binaries."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if len(column) else np.zeros(0, dtype=np.uint8)
    return data.reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype=np.uint8)


def fit_models(training: DataFrame, features: dict[int, list[int]], settings: dict[int, Settings], held: int = HELD_ROWS) -> DataFrame:
    """One row per model (MODEL_SCHEMA, staged). `training`: model int, row long, y double, w double, bins binary, staged.

    `features` and `settings` say for every model which places of `bins` it may use and how it grows. Models without rows
    get no row. Rows of a name that repeats within a model are drawn together.
    """
    spark = training.sparkSession
    counts = {r.model: r for r in training.groupBy("model").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean")).collect()}   # one row per model
    small = sorted(m for m, r in counts.items() if r.n <= held)
    large = sorted(m for m, r in counts.items() if r.n > held)
    out = []
    if small:
        out.append(_fit_side_by_side(training.filter(F.col("model").isin(small)) if large else training, features, settings, {m: counts[m].n for m in small}))
    def family(m: int) -> tuple:
        return settings[m].trees, settings[m].depth, settings[m].penalty, settings[m].least_weight
    for kind in sorted({family(m) for m in large}):
        group = [m for m in large if family(m) == kind]
        fitted = _fit_level_by_level(training.filter(F.col("model").isin(group)), features, settings, {m: counts[m].mean for m in group})
        out.append(spark.createDataFrame([e.row(m) for m, e in fitted.items()], MODEL_SCHEMA))
    models = out[0] if out else spark.createDataFrame([], MODEL_SCHEMA)
    for more in out[1:]:
        models = models.unionByName(more)
    return staged(models)


def dealt_by_size(training: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Rows with a `place`, one partition per model, the largest models first: tasks start in this order, and no two fits wait in one task."""
    order = sorted(sizes, key=lambda m: (-sizes[m], m))
    place = F.create_map(*[x for i, m in enumerate(order) for x in (F.lit(m), F.lit(i))])
    return training.withColumn("place", place[F.col("model")]).repartitionById(len(order), "place")


def _fit_side_by_side(training: DataFrame, features: dict[int, list[int]], settings: dict[int, Settings], sizes: dict[int, int]) -> DataFrame:
    def grow(table: pa.Table) -> pa.Table:
        model = table.column("model")[0].as_py()
        y, w, rows = (table.column(c).to_numpy() for c in ("y", "w", "row"))
        ensemble = fit_held(_matrix(table.column("bins")), y, w, rows, np.array(sorted(features[model]), dtype=np.int64), settings[model])
        return pa.Table.from_pylist([dict(zip(("model", "trees", "base", "features", "bins", "leaves", "covers"), ensemble.row(model), strict=True))],
                                    schema=pa.schema([("model", pa.int32()), ("trees", pa.int32()), ("base", pa.float64()), *[(c, pa.binary()) for c in ("features", "bins", "leaves", "covers")]]))
    return dealt_by_size(training.select("model", "row", "y", "w", "bins"), sizes).groupBy("place").applyInArrow(grow, MODEL_SCHEMA)


def _level_sums(margin_from: dict, growing: dict, columns: dict, settings: dict, tree: int, level: int):
    """Per batch of rows: gradient sums by (model, node, column, bin) of the tree that grows, bins without rows left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            models = batch.column("model").to_numpy()
            for m in np.unique(models).tolist():
                mine = batch.filter(pa.array(models == m))
                s, bins = settings[m], _matrix(mine.column("bins"))
                rows = mine.column("row").to_numpy()
                margin = mine.column("margin").to_numpy() + margins(margin_from.value[m], bins)
                g, h = _derivatives(margin, mine.column("y").to_numpy(), mine.column("w").to_numpy(), s)
                drawn = np.flatnonzero(_row_sample(rows, tree, s))
                node = descend(bins[drawn], growing[m].features, growing[m].bins, level) - (2 ** level - 1)
                sums = _histograms(np.ascontiguousarray(bins.T), drawn, node, 2 ** level, columns[m], g, h)
                held[m] = tuple(a + b for a, b in zip(held[m], sums)) if m in held else sums
        for m, (g, h) in held.items():
            node, place, at = np.nonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), m), pa.int32()), pa.array(node, pa.int32()), pa.array(place, pa.int32()), pa.array(at, pa.int32()),
                                              pa.array(g[node, place, at]), pa.array(h[node, place, at])], names=["model", "node", "place", "bin", "g", "h"])
    return run


def _best_by_node(sums: DataFrame, penalty: float, least_weight: float) -> DataFrame:
    """The split of largest gain per (model, node): place, bin, gain, left sums and the node's own."""
    by_bin = sums.groupBy("model", "node", "place", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    column = Window.partitionBy("model", "node", "place")
    run = column.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    lined = by_bin.select("model", "node", "place", "bin", F.sum("g").over(run).alias("left_g"), F.sum("h").over(run).alias("left_h"),
                          F.sum("g").over(column).alias("all_g"), F.sum("h").over(column).alias("all_h"))
    gl, hl, ga, ha = (F.col(c) for c in ("left_g", "left_h", "all_g", "all_h"))
    gain = gl * gl / (hl + penalty) + (ga - gl) * (ga - gl) / (ha - hl + penalty) - ga * ga / (ha + penalty)
    fits = (hl >= least_weight) & (ha - hl >= least_weight)
    best = F.max(F.struct(F.when(fits, gain).alias("gain"), (-F.col("place")).alias("place"), (-F.col("bin")).alias("bin"), "left_g", "left_h")).alias("best")
    return lined.groupBy("model", "node").agg(best, F.max(F.struct((-F.col("place")).alias("p"), "all_g", "all_h")).alias("whole"))


def _fit_level_by_level(training: DataFrame, features: dict, settings: dict, means: dict[int, float]) -> dict[int, Ensemble]:
    """All models' trees of one number together; a job per tree level, and the driver sees one row per (model, node)."""
    spark = training.sparkSession
    base = {m: base_margin(mean, settings[m]) for m, mean in means.items()}
    grown: dict[int, list[_Tree]] = {m: [] for m in means}
    some = settings[next(iter(means))]
    start = F.create_map(*[x for m, b in base.items() for x in (F.lit(m), F.lit(b))])
    state = training.select("model", "row", "y", "w", "bins", start[F.col("model")].alias("margin"))
    fixed = 0       # trees that are in the staged margins
    for t in range(some.trees):
        if t - fixed >= KEPT_TREES:
            state, fixed = _with_margins(state, {m: stacked(0.0, trees[fixed:], some.depth) for m, trees in grown.items()}), t
        recent = spark.sparkContext.broadcast({m: stacked(0.0, trees[fixed:], some.depth) for m, trees in grown.items()})   # at most KEPT_TREES trees a model
        growing = {m: _Tree(settings[m]) for m in means}
        columns = {m: column_sample(np.array(sorted(features[m]), dtype=np.int64), t, settings[m]) for m in means}
        for level in range(some.depth):
            sums = state.mapInArrow(_level_sums(recent, growing, columns, settings, t, level), "model int, node int, place int, bin int, g double, h double")
            for r in _best_by_node(sums, some.penalty, some.least_weight).collect():       # one row per model and node of the level
                tree, node = growing[r.model], 2 ** level - 1 + r.node
                if level == 0:
                    tree.g[0], tree.h[0] = r.whole.all_g, r.whole.all_h
                splits = r.best.gain is not None and r.best.gain > LEAST_GAIN
                feature = columns[r.model][-r.best.place] if splits else -1
                tree.split(np.array([node]), np.array([feature]), np.array([-r.best.bin]), np.array([r.best.left_g]), np.array([r.best.left_h]))
        for m, tree in growing.items():
            grown[m].append(tree)
        recent.unpersist()
    return {m: stacked(base[m], trees, some.depth) for m, trees in grown.items()}


def _with_margins(state: DataFrame, recent: dict[int, Ensemble]) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast(recent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, bins, out = batch.column("model").to_numpy(), _matrix(batch.column("bins")), batch.column("margin").to_numpy().copy()
            for m in np.unique(models).tolist():
                out[models == m] += margins(sent.value[m], bins[models == m])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=batch.schema.names)
    return staged(state.mapInArrow(run, state.schema))


def ensembles(models: DataFrame) -> dict[int, Ensemble]:
    """The fitted models by number: some hundred bytes a tree, as many as there are folds and settings."""
    return {r.model: unpack(r) for r in models.collect()}


def predict(rows: DataFrame, models: DataFrame, out: str = "margin") -> DataFrame:
    """rows (model int, bins binary, any others) with the model's margin instead of `bins`; rows of models that were not fitted go."""
    sent = rows.sparkSession.sparkContext.broadcast(ensembles(models))
    keep = [c for c in rows.columns if c != "bins"]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, bins = batch.column("model").to_numpy(), _matrix(batch.column("bins"))
            margin, known = np.zeros(len(models)), np.zeros(len(models), dtype=bool)
            for m in np.unique(models).tolist():
                if m in sent.value:
                    mine = models == m
                    known |= mine
                    margin[mine] = sent.value[m].base + margins(sent.value[m], bins[mine])
            done = pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(margin)], names=[*keep, out])
            yield done.filter(pa.array(known))
    return rows.mapInArrow(run, schema)


# ---- attributions

def _paths(ensemble: Ensemble, t: int) -> Iterator[tuple[float, dict[int, list[tuple[int, bool]]], dict[int, float]]]:
    """Leaves of a tree: value, the conditions (node, right) of the path by feature, and by feature the share of rows that go this way."""
    inner = ensemble.features.shape[1]
    for leaf in range(inner, 2 * inner + 1):
        node, conditions, shares = leaf, {}, {}
        while node:
            parent, right = (node - 1) // 2, node % 2 == 0
            f = int(ensemble.features[t, parent])
            if f >= 0:
                conditions.setdefault(f, []).append((parent, right))
                whole = ensemble.covers[t, parent]
                shares[f] = shares.get(f, 1.0) * (ensemble.covers[t, node] / whole if whole > 0 else 0.0)
            elif right:
                break       # nothing is sent to the right of a node without a split
            node = parent
        else:
            yield ensemble.leaves[t, leaf - inner], conditions, shares


def attributions(ensemble: Ensemble, bins: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Path-dependent Shapley values of every row (rows x features), and the margin they start from.

    A feature that is left out sends a row down both branches, in the shares of the rows the tree was grown on. Each leaf's part is
    worked out over the subsets of its path's features, all rows at once.
    """
    from_subsets: dict[int, np.ndarray] = {}
    out, start = np.zeros((len(bins), n_features)), ensemble.base
    for t in range(len(ensemble.features)):
        for value, conditions, shares in _paths(ensemble, t):
            names = list(conditions)
            k = len(names)
            start += value * float(np.prod([shares[f] for f in names])) if k else value
            if not k or value == 0:
                continue
            met = np.array([np.logical_and.reduce([(bins[:, f] > ensemble.bins[t, node]) == right for node, right in conditions[f]]) for f in names])
            code = (met * (1 << np.arange(k))[:, None]).sum(axis=0)
            gains = value * _leaf_gains(tuple(shares[f] for f in names), from_subsets)
            for i, f in enumerate(names):
                out[:, f] += gains[code, i]
    return out, start


def _leaf_gains(shares: tuple[float, ...], weights: dict[int, np.ndarray]) -> np.ndarray:
    """(which conditions hold as bits, feature): the Shapley value of each feature in a product of conditions and shares."""
    k = len(shares)
    subsets = np.arange(1 << k)
    member = (subsets[:, None] >> np.arange(k)) & 1
    if k not in weights:
        size = member.sum(axis=1)
        fact = np.cumprod([1.0, *range(1, k + 1)])
        weights[k] = np.array([fact[s] * fact[k - s - 1] / fact[k] if s < k else 0.0 for s in size])
    # worth[held, subset]: features in the subset count as held or not, the others by their share.
    held = (subsets[:, None] >> np.arange(k)) & 1
    worth = np.prod(np.where(member[None, :, :] == 1, held[:, None, :], np.array(shares)[None, None, :]), axis=2)
    out = np.zeros((1 << k, k))
    for i in range(k):
        without = subsets[member[:, i] == 0]
        out[:, i] = ((worth[:, without | (1 << i)] - worth[:, without]) * weights[k][without]).sum(axis=1)
    return out


def mean_attributions(rows: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """model, feature, importance: mean absolute attribution over the rows (model int, bins binary). One pass, summed by task."""
    sent = rows.sparkSession.sparkContext.broadcast(ensembles(models))
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for m, part in batch.groupby("model"):
                if m in sent.value:
                    bins = np.frombuffer(b"".join(part["bins"]), dtype=np.uint8).reshape(len(part), -1)
                    total[m] = total.get(m, 0) + np.abs(attributions(sent.value[m], bins, len(names))[0]).sum(axis=0)
                    count[m] = count.get(m, 0) + len(part)
        for m, sums in total.items():
            yield pd.DataFrame({"model": np.int32(m), "feature": names, "total": sums, "n": count[m]})
    parts = rows.select("model", "bins").mapInPandas(run, "model int, feature string, total double, n long")
    return parts.groupBy("model", "feature").agg((F.sum("total") / F.sum("n")).alias("importance"))
