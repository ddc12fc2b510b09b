"""Error metrics, column scores and the Gram matrix of each fold."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EPSILON, finite_or_zero, vector
from .moments import moments


def metric_columns(y: Column, p: Column) -> list[Column]:
    """smape, mape (per cent), rmse, mae and r2; r2 of a constant y is 1 without error and else 0."""
    e = F.abs(y - p)
    sse, sst = F.sum(e * e), F.count(y) * F.var_pop(y)
    return [
        (F.avg(2 * e / (F.abs(y) + F.abs(p) + EPSILON)) * 100).alias("smape"),
        (F.avg(e / (F.abs(y) + EPSILON)) * 100).alias("mape"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("mae"),
        F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / sst).alias("r2"),
    ]


def metrics(df: DataFrame, y: str = "y", prediction: str = "prediction", by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(F.col(y), F.col(prediction)))


def column_scores(df: DataFrame, columns: Sequence[str], score: str, y: str = "y") -> DataFrame:
    """(feature, ordinal, score) for score pearson (absolute), f (univariate regression) or variance, from one pass over all columns.

    A constant column, or a constant y, has no correlation and scores 0. A feature that is the target up to scale has no rest to
    divide by: its f is the greatest number.
    """
    wanted = [*columns] if score == "variance" else [*columns, y]
    found = moments(df, wanted, None if score == "variance" else y)
    std = lambda m2, n: F.sqrt(F.try_divide(m2, n))
    if score == "variance":
        made = found.withColumn("score", F.try_divide(F.col("m2"), F.col("n")))
    else:
        # The target is the last column of the table; its row goes along with the others (one row).
        of_y = found.where(F.col("ordinal") == len(columns)).select(F.col("m2").alias("y_m2"), F.col("n").alias("y_n"))
        both = found.where(F.col("ordinal") < len(columns)).crossJoin(F.broadcast(of_y))
        r = F.abs(F.try_divide(F.try_divide(F.col("co"), F.col("n_both")), std(F.col("m2"), F.col("n")) * std(F.col("y_m2"), F.col("y_n"))))
        made = both.withColumn("score", F.when(r > 1, F.lit(1.0)).otherwise(r))  # rounding may not take it beyond 1
        if score == "f":
            s, rows = F.pow("score", 2), F.col("n") + F.col("n_null")
            made = made.withColumn("score", F.when(1 - s <= 0, F.lit(sys.float_info.max)).otherwise(F.try_divide(s, 1 - s) * (rows - 2)))
    return made.select("feature", "ordinal", finite_or_zero(F.col("score")).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(rank, feature, score), best first; ties by the columns' order."""
    best = scores.orderBy(F.desc("score"), "ordinal").limit(k)
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ordinal", "feature", "score"))).alias("x"))  # k rows
    return rows.select(F.posexplode("x").alias("i", "r")).select((F.col("i") + 1).alias("rank"), F.col("r.feature").alias("feature"), F.col("r.score").alias("score"))


@dataclass
class Gram:
    """Sums over rows: n, of z = (features, y), and of the products of z with itself."""

    n: float
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.sums + other.sums, self.products + other.products)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.n - other.n, self.sums - other.sums, self.products - other.products)

    def only(self, features: np.ndarray) -> Gram:
        """Of these features and y."""
        at = np.append(features, len(self.sums) - 1)
        return Gram(self.n, self.sums[at], self.products[np.ix_(at, at)])

    @property
    def centred(self) -> tuple[np.ndarray, np.ndarray, float]:
        """X'X, X'y and y'y over n, all centred."""
        mean = self.sums / self.n
        c = self.products / self.n - np.outer(mean, mean)
        return c[:-1, :-1], c[:-1, -1], float(c[-1, -1])

    def raw(self) -> tuple[np.ndarray, np.ndarray, float]:
        c = self.products / self.n
        return c[:-1, :-1], c[:-1, -1], float(c[-1, -1])

    def loss(self, w: np.ndarray, intercept: float) -> float:
        """Sum of squared errors of predictions X w + intercept."""
        v = np.concatenate((-w, [1.0]))
        s = float(v @ self.sums)
        return float(v @ self.products @ v) - 2 * intercept * s + self.n * intercept**2


def fold_of(index: Column, n: int | Column, folds: int) -> Column:
    """Contiguous folds; the first n mod folds have one row more. n may be a column: the count of the row's own group."""
    if isinstance(n, Column):
        size, more = F.floor(n / folds), n % folds
    else:
        size, more = map(F.lit, divmod(n, folds))
    return F.when(index < more * (size + 1), F.floor(index / (size + 1))).otherwise(F.floor((index - more) / F.greatest(F.lit(1), size))).cast("int")


def fold_grams(df: DataFrame, columns: Sequence[str], y: str = "y", fold: Column | None = None) -> dict[int, Gram]:
    """The Gram of each fold in one pass: partial sums by NumPy in each partition, dealt by (fold, row of the matrix) and added up.

    A partition sends one vector of (p + 1)(p + 2) numbers for each fold; they are added up on the executors. Beyond TILE columns, no task
    holds a fold's matrix (see gram_tiles); the driver, whose solvers need all of it, holds one for each fold.
    """
    if len(columns) + 2 > TILE:
        return tiled_grams(df, columns, y, fold)
    p = len(columns)
    packed = df.select((fold if fold is not None else F.lit(0)).cast("int").alias("fold"), vector([*columns, y]).alias("z"))
    schema = pa.schema([("fold", pa.int32()), ("row", pa.int32()), ("v", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            z = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1)
            z = np.hstack((z, np.ones((len(z), 1))))
            which = b.column(0).to_numpy()
            for k in np.unique(which):
                part = z[which == k]
                sums[int(k)] = sums.get(int(k), 0) + part.T @ part
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * (p + 2), pa.int32()), pa.array(range(p + 2), pa.int32()), pa.array(list(s), pa.list_(pa.float64()))], schema=schema)

    return added_grams(packed.mapInArrow(work, PARTS), p)


def gram_tiles(df: DataFrame, columns: Sequence[str], y: str = "y", fold: Column | None = None, width: int | None = None, shares: int = 4) -> DataFrame:
    """vector_tiles of z = (columns, y, ones)."""
    packed = df.select((fold if fold is not None else F.lit(0)).cast("int").alias("fold"), vector([*columns, y], "1.0D").alias("z"))
    return vector_tiles(packed, len(columns) + 2, width, shares)


def vector_tiles(packed: DataFrame, size: int, width: int | None = None, shares: int = 4) -> DataFrame:
    """(fold, i, j, tile): the products of vectors (fold, z: ``size`` doubles) as square tiles of ``width`` columns (binary doubles, row by row), i <= j.

    Each block of rows goes, cut to its two groups of columns, to the task of each pair of groups, so data are sent once for each group and
    not once for each column; a pair's rows are dealt over ``shares`` tasks. A task holds one tile (8 MB at 1,024) at a time.
    """
    width = width or TILE
    groups = [range(a, min(a + width, size)) for a in range(0, size, width)]
    cut = pa.schema([("fold", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("share", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                z = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                which, turn = part.column(0).to_numpy(), turn + 1
                for k in np.unique(which):
                    own = z[which == k]
                    cells = [np.ascontiguousarray(own[:, g.start : g.stop]).tobytes() for g in groups]
                    for i in range(len(groups)):
                        for j in range(i, len(groups)):
                            row = [int(k), i, j, turn % shares, cells[i], cells[j] if j > i else b""]
                            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, cut, strict=True)], schema=cut)

    tile = pa.schema([("fold", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("tile", pa.binary())])

    def summed(of: Callable[[list], np.ndarray], keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Rows in order of their keys: one sum for each, one at a time."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, None
            told = lambda: pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in now[:3]], pa.array([total.tobytes()], pa.binary())], schema=tile)
            for b in batches:
                for n in range(b.num_rows):
                    row = [c[n] for c in b.columns]
                    key = tuple(c.as_py() for c in row[:keys])
                    if key != now:
                        if now is not None:
                            yield told()
                        now, total = key, 0
                    total = total + of(row)
            if now is not None:
                yield told()

        return work

    def product(row: list) -> np.ndarray:
        i, j = row[1].as_py(), row[2].as_py()
        left = np.frombuffer(row[4].as_buffer()).reshape(-1, len(groups[i]))
        right = np.frombuffer(row[5].as_buffer()).reshape(-1, len(groups[j])) if j > i else left
        return left.T @ right

    kind = "fold int, i int, j int, tile binary"
    parts = packed.mapInArrow(dealt, "fold int, i int, j int, share int, left binary, right binary").repartition("fold", "i", "j", "share").sortWithinPartitions("fold", "i", "j", "share").mapInArrow(summed(product, 4), kind)
    return parts.repartition("fold", "i", "j").sortWithinPartitions("fold", "i", "j").mapInArrow(summed(lambda row: np.frombuffer(row[3].as_buffer()), 3), kind)


def tiled_grams(df: DataFrame, columns: Sequence[str], y: str = "y", fold: Column | None = None, width: int | None = None) -> dict[int, Gram]:
    """The Gram of each fold from tiles, which come to the driver one by one."""
    p, width, found = len(columns), width or TILE, {}
    for r in gram_tiles(df, columns, y, fold, width).toLocalIterator():
        m = found.setdefault(r["fold"], np.zeros((p + 2, p + 2)))
        a, b = r["i"] * width, r["j"] * width
        t = np.frombuffer(r["tile"]).reshape(min(width, p + 2 - a), -1)
        m[a : a + t.shape[0], b : b + t.shape[1]] = t
        m[b : b + t.shape[1], a : a + t.shape[0]] = t.T
    return {k: Gram(float(m[-1, -1]), m[:-1, -1].copy(), m[:-1, :-1]) for k, m in sorted(found.items())}


#: Columns beyond which a Gram is made of tiles, and a tile's width.
TILE = 1024
PARTS = "fold int, row int, v array<double>"


def added_grams(partial: DataFrame, p: int) -> dict[int, Gram]:
    """The Gram of each fold from parts of it: rows of its matrix (p features, y, ones), added up on the executors."""
    schema = pa.schema([("fold", pa.int32()), ("row", pa.int32()), ("v", pa.list_(pa.float64()))])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    sums[key] = sums[key] + v[i] if key in sums else v[i].copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int32()), pa.array([r for _, r in sums], pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], schema=schema)

    rows = partial.repartition("fold", "row").mapInArrow(added, PARTS).collect()  # p + 2 vectors of p + 2 numbers a fold
    found: dict[int, np.ndarray] = {}
    for r in rows:
        found.setdefault(r[0], np.zeros((p + 2, p + 2)))[r[1]] = r["v"]
    return {k: Gram(float(m[-1, -1]), m[-1, :-1].copy(), m[:-1, :-1].copy()) for k, m in sorted(found.items())}
