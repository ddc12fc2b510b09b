"""Interactions of boosted trees: Shapley interaction values of each leaf's path, averaged over rows.

A leaf is a product game over the features on its path: a known feature gives 1 or 0 (the row satisfies its tests or not), an
unknown one the share of training rows that its tests let through. A product's interaction values follow from the
coefficients of a polynomial, so leaves are independent of each other, are handled as arrays, and rows in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import vector
from .boosting import Ensemble

#: (value, [(feature, lower bound, upper bound, share)]): a row passes where lower < x <= upper.
Leaf = tuple[float, list[tuple[int, float, float, float]]]


def leaves(model: Ensemble) -> list[Leaf]:
    """All leaves of a fitted ensemble that have a path."""
    found: list[Leaf] = []
    for t in model.trees:
        todo: list[tuple[int, dict]] = [(0, {})]
        while todo:
            at, path = todo.pop()
            f, cut = int(t.feature[at]), float(t.threshold[at])
            if f < 0:
                if path:
                    found.append((float(t.value[at]), [(k, *bounds) for k, bounds in path.items()]))
                continue
            lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, a, b in ((int(t.left[at]), lo, min(hi, cut)), (int(t.right[at]), max(lo, cut), hi)):
                todo.append((child, path | {f: (a, b, share * t.cover[child] / max(1, t.cover[at]))}))
    return found


class Paths:
    """Leaves as arrays, by the number of features on their path; only those with two or more interact."""

    def __init__(self, found: Sequence[Leaf]) -> None:
        by: dict[int, list[Leaf]] = {}
        for leaf in found:
            if len(leaf[1]) > 1:
                by.setdefault(len(leaf[1]), []).append(leaf)
        pairs: dict[tuple[int, int], int] = {}
        self.groups = []
        for m, own in sorted(by.items()):
            value = np.array([v for v, _ in own])
            f, lo, hi, share = (np.array([[t[k] for t in path] for _, path in own]) for k in range(4))
            f = f.astype(np.int64)
            number = lambda a, b: pairs.setdefault((min(a, b), max(a, b)), len(pairs))
            at = {(i, j): np.array([number(a, b) for a, b in zip(f[:, i].tolist(), f[:, j].tolist(), strict=True)]) for i in range(m) for j in range(i + 1, m)}
            self.groups.append((m, value, f, lo, hi, share, at))
        self.pairs = list(pairs)

    def values(self, x: np.ndarray, numbers: int = 1 << 21) -> np.ndarray:
        """(pairs, rows): interaction values summed over all leaves.

        A leaf's polynomial in the number of known features is built once by extending it feature by feature; two features are taken
        out of it again by division. A share is never 0, as every node has rows.
        """
        sums = np.zeros((len(self.pairs), len(x)))
        for m, value, f, lo, hi, share, at in self.groups:
            weight = np.array([factorial(s) * factorial(m - s - 2) / (2 * factorial(m - 1)) for s in range(m - 1)])
            step = max(1, numbers // ((m + 1) * max(1, len(x))))
            for c in range(0, len(value), step):
                cut = slice(c, c + step)
                cells = x.T[f[cut]]  # leaves, features, rows
                known = (cells > lo[cut, :, None]) & (cells <= hi[cut, :, None])
                part = share[cut, :, None]
                whole = np.zeros((m + 1, *known.shape[::2]))
                whole[0] = 1
                for k in range(m):
                    whole[1:] = whole[1:] * part[:, k] + whole[:-1] * known[:, k]
                    whole[0] *= part[:, k]
                for i in range(m):
                    less = taken_out(whole, part[:, i], known[:, i])
                    for j in range(i + 1, m):
                        rest = taken_out(less, part[:, j], known[:, j])
                        made = value[cut, None] * (known[:, i] - part[:, i]) * (known[:, j] - part[:, j]) * np.tensordot(weight, rest, 1)
                        np.add.at(sums, at[i, j][cut], made)
        return sums


def taken_out(polynomial: np.ndarray, share: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A polynomial (coefficients along the first axis) divided by its factor share + known t: from the top where t is in it, else by the share."""
    n = len(polynomial) - 1
    made = np.empty((n, *polynomial.shape[1:]))
    above = polynomial[n]
    for k in range(n - 1, -1, -1):
        made[k] = above
        above = polynomial[k] - share * above
    return np.where(known, made, polynomial[:n] / share)


def interactions(rows: DataFrame, columns: Sequence[str], found: Sequence[Leaf], step: int = 64) -> DataFrame:
    """(feature_i, feature_j, weight): mean absolute interaction over the rows, both ways round; pairs without any are left out.

    Rows are dealt to tasks in parts of about ``step``; a task holds one number for each pair of features that share a path, and row of a part.
    """
    names, paths = list(columns), Paths(found)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for at in range(0, len(x), step):
                totals = np.abs(paths.values(x[at : at + step])).sum(1)
                pairs = [(-1, -1), *paths.pairs]  # the first one carries the number of rows
                n = len(x[at : at + step])
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32()), pa.array([0.0, *totals.tolist()], pa.float64()), pa.array([n] + [0] * len(totals), pa.int64())], schema=schema)

    dealt = rows.select(vector(names).alias("x")).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    sums = dealt.mapInArrow(work, "i int, j int, total double, n bigint").groupBy("i", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # one row a pair of features
    n = sum(r["n"] for r in sums)
    made = [(names[a], names[b], r["total"] / n) for r in sums if r["i"] >= 0 for a, b in ((r["i"], r["j"]), (r["j"], r["i"]))]
    return rows.sparkSession.createDataFrame(made, "feature_i string, feature_j string, weight double")
