"""Boosted regression trees by histograms, with patience.

Columns are cut once into at most ``BINS`` ranges (by approximate quantiles of the training rows) and kept as blocks of one byte
a value. A level of a tree is one pass: each task adds up gradients and counts by (node, feature, bin) of its blocks, of the
smaller child of each split only; tasks that are dealt groups of features add those up, take the other child as parent less
sibling, and find each node's best split. The driver sees one row for each node and group of features. The level's sums stay with
the executors, cached with their lineage, for the next level.

Predictions so far are kept with the blocks: the trees of the last ``PENDING`` rounds are applied anew in each pass, then the blocks are
written again to the shared folder. Row samples are drawn by a hash of a row's index and the tree, so they don't depend on partitions.

The loss is half the squared error. A split's gain and a leaf's value are those of a second-order step with penalty ``PENALTY``; both
sides of a split hold ``LEAST`` rows at least. The loss of the validation rows comes with the next tree's first pass; after ``patience``
trees without a better one, growing ends, and the trees up to the best are kept. No row, column, or tree is left out otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cluster import dropped, new_folder
from ..functions.scalar import vector

BINS = 256
PENALTY = 1.0
LEAST = 1.0
PENDING = 16
#: Bytes of a block's bins, about, and of the bins of all blocks that a task reads.
BLOCK_BYTES = 128 << 10
TASK_BYTES = 512 << 10
#: Features whose sums one task adds up, about.
GROUP = 16

BEST = np.dtype([("tree", np.int32), ("node", np.int32), ("feature", np.int32), ("bin", np.int32), ("gain", np.float64), ("g_left", np.float64), ("h_left", np.float64), ("g", np.float64), ("h", np.float64)])


@dataclass
class Tree:
    """Arrays by node; the root is 0, a leaf has feature -1. A row goes left where its value is at most the threshold (its bin at most ``bin``)."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaf_of(self, columns: np.ndarray, by: str = "bin") -> np.ndarray:
        """Each row's leaf; ``columns`` has a row for each feature (bins, or values with ``by`` threshold)."""
        at = np.zeros(columns.shape[1], np.int32)
        cuts, rows = getattr(self, by), np.arange(columns.shape[1])
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            goes = columns[np.maximum(f, 0), rows] <= cuts[at]
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)


@dataclass
class Growing:
    """A tree in the making, as lists; ``open`` are the nodes of the present level."""

    nodes: list[dict] = field(default_factory=list)
    open: list[int] = field(default_factory=list)

    def add(self, g: float, h: float, rate: float) -> int:
        self.nodes.append({"feature": -1, "bin": -1, "threshold": np.nan, "left": -1, "right": -1, "value": -rate * g / (h + PENALTY), "cover": h, "gain": 0.0})
        return len(self.nodes) - 1

    def tree(self) -> Tree:
        kind = {"feature": np.int32, "bin": np.int32, "left": np.int32, "right": np.int32}
        return Tree(**{k: np.array([n[k] for n in self.nodes], kind.get(k, np.float64)) for k in self.nodes[0]})


def chosen_rows(index: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Rows in a tree's sample: a hash of index and seed is below the share."""
    x = index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1342543DE82EF95 + 1) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def edges_of(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending thresholds of each column, bins - 1 at most: quantiles of its values."""
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    renamed = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items()])
    found = renamed.approxQuantile(list(names.values()), (np.arange(1, bins) / bins).tolist(), 0.25 / bins)
    return [np.unique(q) for q in found]


_SCHEMA = "val boolean, n int, bins binary, y binary, idx binary, f binary"
_ARROW = pa.schema([("val", pa.bool_()), ("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("idx", pa.binary()), ("f", pa.binary())])


def blocks_of(train: DataFrame, val: DataFrame, columns: Sequence[str], edges: list[np.ndarray], base: float, index: str) -> DataFrame:
    """Rows as blocks: val, n, bins (a byte for each feature and row), y, row index and prediction so far."""
    p = len(columns)
    most = max(256, BLOCK_BYTES // max(1, p))
    part = lambda d, v: d.select(F.lit(v).alias("val"), F.col(index).cast("bigint").alias("i"), vector([*columns, "y"]).alias("z"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                s = b.slice(at, most)
                is_val, idx = s.column(0).to_numpy(zero_copy_only=False), s.column(1).to_numpy()
                z = s.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1)
                for v in np.unique(is_val):
                    own = is_val == v
                    x, y = z[own, :-1], np.ascontiguousarray(z[own, -1])
                    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(np.uint8)
                    row = [bool(v), int(own.sum()), bins.tobytes(), y.tobytes(), idx[own].tobytes(), np.full(len(y), base).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

    return part(train, False).unionByName(part(val, True)).mapInArrow(work, _SCHEMA)


def unpacked(b: pa.RecordBatch, p: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(b.num_rows):
        val, n, *data = (c[i] for c in b.columns)
        bins, y, idx, f = (d.as_buffer() for d in data)
        yield val.as_py(), np.frombuffer(bins, np.uint8).reshape(p, n.as_py()), np.frombuffer(y), np.frombuffer(idx, np.int64), np.frombuffer(f)


def advanced(blocks: DataFrame, trees: Sequence[Tree], p: int) -> DataFrame:
    """The blocks with these trees' values added to the predictions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for _, bins, _, _, f in unpacked(b, p):
                f = f.copy()
                for t in trees:
                    f += t.value[t.leaf_of(bins)]
                new.append(f.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, pa.binary())], schema=_ARROW)

    return blocks.mapInArrow(work, _SCHEMA)


def best_splits(hist: np.ndarray, nodes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Of sums (node, feature, bin, gradient and count): each node's best split; ties to the lower feature, then the lower bin."""
    left = hist.cumsum(2)
    total = left[:, :, -1:, :]
    gl, hl, g, h = left[..., 0], left[..., 1], total[..., 0], total[..., 1]
    gr, hr = g - gl, h - hl
    gain = gl * gl / (hl + PENALTY) + gr * gr / (hr + PENALTY) - g * g / (h + PENALTY)
    gain[(hl < LEAST) | (hr < LEAST)] = -np.inf
    flat = gain.reshape(len(nodes), -1)
    at = flat.argmax(1)
    j, k = np.unravel_index(at, gain.shape[1:])
    i = np.arange(len(nodes))
    made = np.zeros(len(nodes), BEST)
    for name, v in (("tree", nodes[:, 0]), ("node", nodes[:, 1]), ("feature", features[j]), ("bin", k), ("gain", flat[i, at]), ("g_left", gl[i, j, k]), ("h_left", hl[i, j, k]), ("g", g[i, 0, 0]), ("h", h[i, 0, 0])):
        made[name] = v
    return made


_SUMS = pa.schema([("grp", pa.int32()), ("merged", pa.bool_()), ("data", pa.binary()), ("best", pa.binary())])
_SUMS_SQL = "grp int, merged boolean, data binary, best binary"


def level_sums(blocks: DataFrame, p: int, trees: Sequence[Tree], growing: Sequence[Tree | None], counted: Sequence[tuple[int, int]], groups: Sequence[np.ndarray], seeds: Sequence[int], share: float) -> DataFrame:
    """Each task's sums by (counted node, feature, bin) of its blocks, a row for each group of features; group -1 has the losses.

    growing: the trees of this round so far (None: a root only); counted: (tree, node).
    """
    m = len(counted)
    places = [{node: i for i, (k, node) in enumerate(counted) if k == tree} for tree in range(len(growing))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss = [np.zeros((m, len(g), BINS, 2)) for g in groups], np.zeros((2, 2))
        for b in batches:
            for val, bins, y, idx, f in unpacked(b, p):
                f = f.copy()
                for t in trees:
                    f += t.value[t.leaf_of(bins)]
                loss[int(val)] += ((f - y) ** 2).sum(), len(y)
                if val:
                    continue
                for tree, place, seed in zip(growing, places, seeds, strict=True):
                    if not place:
                        continue
                    slot = np.full(len(y), place.get(0, -1), np.int64)
                    if tree is not None:
                        of = np.full(len(tree.feature), -1)
                        of[list(place)] = list(place.values())
                        slot = of[tree.leaf_of(bins)]
                    kept = slot >= 0
                    if share < 1:
                        kept &= chosen_rows(idx, seed, share)
                    kept = np.flatnonzero(kept)
                    g, slot = (f - y)[kept], slot[kept] * BINS
                    for s, own in zip(sums, groups, strict=True):
                        for j, c in enumerate(own):
                            at = slot + bins[c][kept]
                            s[:, j, :, 0] += np.bincount(at, g, m * BINS).reshape(m, BINS)
                            s[:, j, :, 1] += np.bincount(at, minlength=m * BINS).reshape(m, BINS)
        rows = [(k, s) for k, s in enumerate(sums)] + [(-1, loss)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([False] * len(rows)), pa.array([s.tobytes() for _, s in rows], pa.binary()), pa.array([b""] * len(rows), pa.binary())], schema=_SUMS)

    return blocks.mapInArrow(work, _SUMS_SQL)


def merged_sums(parts: DataFrame, above: DataFrame | None, counted: Sequence[tuple[int, int]], others: Sequence[tuple[tuple[int, int], tuple[int, int], int]], groups: Sequence[np.ndarray], lone: bool) -> DataFrame:
    """Added-up sums of the level's nodes, and each node's best split, by group of features; ``lone`` blocks, of one partition, need no exchange.

    others: (node, its sibling among the counted ones, their parent's place in the level above); its sums are the parent's less the sibling's.
    """
    nodes = np.array([*counted, *[n for n, _, _ in others]], np.int32)
    sibling = [list(counted).index(s) for _, s, _ in others]
    parent = [a for _, _, a in others]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        old: dict[int, np.ndarray] = {}
        for b in batches:
            for k, merged, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                v = np.frombuffer(data.as_buffer())
                if merged:
                    old[k] = v
                else:
                    own[k] = own[k] + v if k in own else v.copy()
        for k, v in own.items():
            if k < 0:
                data, best = b"", v.tobytes()
            else:
                hist = v.reshape(len(counted), len(groups[k]), BINS, 2)
                if others:
                    hist = np.concatenate((hist, old[k].reshape(-1, len(groups[k]), BINS, 2)[parent] - hist[sibling]))
                data, best = hist.tobytes(), best_splits(hist, nodes, groups[k]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([True]), pa.array([data], pa.binary()), pa.array([best], pa.binary())], schema=_SUMS)

    rows = parts if above is None else parts.unionByName(above.where("grp >= 0"))
    return (rows.coalesce(1) if lone else rows.repartition(len(groups), "grp")).mapInArrow(work, _SUMS_SQL)


@dataclass
class Ensemble:
    columns: list[str]
    base: float
    trees: list[Tree]
    history: list[tuple[int, float, float]]
    best: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Rows of values to predictions."""
        c, made = np.ascontiguousarray(x.T), np.full(len(x), self.base)
        for t in self.trees:
            made += t.value[t.leaf_of(c, "threshold")]
        return made

    def gains(self) -> np.ndarray:
        """Mean gain of each feature's splits, in shares."""
        total, n = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
            np.add.at(n, t.feature[inner], 1)
        mean = total / np.maximum(1, n)
        return mean / mean.sum() if mean.sum() else mean


def boost(train: DataFrame, val: DataFrame, columns: Sequence[str], n_trees: int, depth: int, rate: float, subsample: float = 1.0, colsample: float = 1.0, seed: int = 42, patience: int | None = 30, leaves: Sequence[int] | None = None, parallel: int = 1, index: str = "split_row_idx", stop: Callable[[], bool] = lambda: False) -> Ensemble:
    """Grow n_trees trees, fewer where ``patience`` runs out; ``leaves`` bounds each tree's leaves (the best splits of a level go first).

    ``parallel`` trees are grown from the same predictions in one round, each on its own sample. ``stop`` is asked before each
    round; where it says so, the trees so far count.
    """
    spark, p = train.sparkSession, len(columns)
    row = train.agg(F.avg("y").alias("base"), F.count("*").alias("n")).first()
    if not row["n"]:
        raise ValueError("boosting needs training rows")
    base, edges = float(row["base"]), edges_of(train, columns)
    folder, least = new_folder(spark, "boosting"), max(1, -(-row["n"] * p // TASK_BYTES))

    def kept(df: DataFrame, version: int) -> DataFrame:
        # Rows may all lie in one partition, so the first blocks are dealt; later ones stay as they are.
        (df if version else df.repartition(least)).write.parquet(f"{folder}/{version}")
        read = spark.read.parquet(f"{folder}/{version}")
        return read.coalesce(least).persist()  # few tasks where there is little to do

    blocks, version = kept(blocks_of(train, val, columns, edges, base, index), 0), 0
    trees: list[Tree] = []
    pending: list[Tree] = []
    history: list[tuple[int, float, float]] = []
    best_at, best_loss = 0, np.inf
    width = max(1, min(p, round(colsample * p)))
    rounds = -(-n_trees // parallel)
    try:
        for t in range(rounds + 1):
            features = np.sort(np.random.default_rng((seed, t)).choice(p, width, replace=False)) if width < p else np.arange(p)
            groups = np.array_split(features, max(1, -(-width // GROUP)))
            some = max(1, min(parallel, n_trees - len(trees)))
            growing, seeds = [Growing() for _ in range(some)], [seed * 1_000_003 + len(trees) + k for k in range(some)]
            room = [leaves[len(trees) + k] - 1 if leaves is not None and t < rounds else 2**depth for k in range(some)]
            counted, others, above = [(k, 0) for k in range(some)], [], None
            for level in range(depth):
                parts = level_sums(blocks, p, pending, [g.tree() if level else None for g in growing], counted, groups, seeds, subsample)
                sums = merged_sums(parts, above, counted, others, groups, least == 1).persist()
                found = sums.select("grp", "best").collect()  # a row for each group of features
                if above is not None:
                    above.unpersist()
                above = sums
                if level == 0:
                    (l_train, n_train), (l_val, n_val) = np.frombuffer(next(r["best"] for r in found if r["grp"] < 0)).reshape(2, 2)
                    if t:
                        history.append((t, float(l_train / n_train), float(l_val / n_val) if n_val else float("nan")))
                        if n_val and l_val / n_val < best_loss:
                            best_at, best_loss = t, l_val / n_val
                    if t == rounds or stop() or (patience and n_val and t - best_at >= patience):
                        break
                each: dict[tuple[int, int], np.void] = {}
                for r in sorted((r for r in found if r["grp"] >= 0), key=lambda r: r["grp"]):
                    for b in np.frombuffer(r["best"], BEST):
                        key = (int(b["tree"]), int(b["node"]))
                        if key not in each or b["gain"] > each[key]["gain"]:
                            each[key] = b
                if level == 0:
                    for k, g in enumerate(growing):
                        g.add(float(each[k, 0]["g"]), float(each[k, 0]["h"]), rate)
                order = [*counted, *[n for n, _, _ in others]]
                counted, others = [], []
                for n in sorted(order, key=lambda n: (-each[n]["gain"], n)):
                    b, (k, node) = each[n], n
                    if not b["gain"] > 1e-12 or room[k] < 1:
                        continue
                    room[k] -= 1
                    f, cut = int(b["feature"]), int(b["bin"])
                    sides = [(float(b["g_left"]), float(b["h_left"])), (float(b["g"] - b["g_left"]), float(b["h"] - b["h_left"]))]
                    left, right = ((k, growing[k].add(g, h, rate)) for g, h in sides)
                    growing[k].nodes[node] |= {"feature": f, "bin": cut, "threshold": float(edges[f][cut]), "left": left[1], "right": right[1], "gain": float(b["gain"])}
                    if room[k] > 0:
                        small, large = (left, right) if sides[0][1] <= sides[1][1] else (right, left)
                        counted.append(small)
                        others.append((large, small, order.index(n)))
                if not counted:
                    break
            if above is not None:
                above.unpersist()
            if not growing[0].nodes or (all(len(g.nodes) == 1 for g in growing) and subsample >= 1 and width == p):  # the end, or no split is left to find
                break
            made = [g.tree() for g in growing]
            trees, pending = trees + made, pending + made
            if len(pending) >= PENDING:
                version += 1
                new = kept(advanced(blocks, pending, p), version)
                new.count()  # read before the blocks that it replaces go
                blocks.unpersist()
                dropped(spark, f"{folder}/{version - 1}")
                blocks, pending = new, []
    finally:
        blocks.unpersist()
        dropped(spark, folder)
    best = best_at if patience and best_at else len(history)
    return Ensemble(list(columns), base, trees[: best * parallel], history, best)
