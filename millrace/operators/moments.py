"""One mergeable table of moments for all columns: what scalers, audits, constants and scores are read from."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.scalar import vector

#: Columns whose moments one task adds up.
GROUP = 512
#: Of a column: values that aren't null, their mean and sum of squared deviations; the same for rows where y isn't null either (n_both,
#: mean_both, of y: mean_y), and the sum of products of deviations from those; the target's own n and squares; extremes; odd values.
STATS = ("n", "mean", "m2", "n_both", "mean_both", "mean_y", "co", "min", "max", "n_nan", "n_inf", "n_null")


def of_block(x: np.ndarray, null: np.ndarray, y: np.ndarray, y_null: np.ndarray) -> np.ndarray:
    """(STATS, columns) of a block of rows; x and y have zeros where they are null."""
    made = np.zeros((len(STATS), x.shape[1]))
    with np.errstate(all="ignore"):
        n = (~null).sum(0)
        mean = x.sum(0) / np.maximum(1, n)
        both = ~null & ~y_null[:, None]
        n_both = both.sum(0)
        mean_both = np.where(both, x, 0).sum(0) / np.maximum(1, n_both)
        mean_y = np.where(both, y[:, None], 0).sum(0) / np.maximum(1, n_both)
        nan = np.isnan(x)
        made[0], made[1], made[3], made[4], made[5] = n, mean, n_both, mean_both, mean_y
        made[2] = np.where(null, 0, (x - mean) ** 2).sum(0)
        made[6] = np.where(both, (x - mean_both) * (y[:, None] - mean_y), 0).sum(0)
        made[7] = np.where(null | nan, np.inf, x).min(0, initial=np.inf)
        made[8] = np.where(null | nan, -np.inf, x).max(0, initial=-np.inf)
        made[9], made[10], made[11] = nan.sum(0), np.isinf(x).sum(0), null.sum(0)
    return made


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows together (Chan, Golub and LeVeque's update)."""
    made = a + b
    with np.errstate(all="ignore"):
        for n, mean, square in ((0, 1, 2), (3, 4, None)):
            both = np.maximum(1, made[n])
            d = np.where((a[n] > 0) & (b[n] > 0), b[mean] - a[mean], 0)
            made[mean] = np.where(a[n] == 0, b[mean], a[mean] + d * (b[n] / both))
            if square is not None:
                made[square] += d * d * a[n] * b[n] / both
            else:
                dy = np.where((a[n] > 0) & (b[n] > 0), b[5] - a[5], 0)
                made[5] = np.where(a[n] == 0, b[5], a[5] + dy * (b[n] / both))
                made[6] += d * dy * a[n] * b[n] / both
    made[7], made[8] = np.minimum(a[7], b[7]), np.maximum(a[8], b[8])
    return made


def moments(df: DataFrame, columns: Sequence[str], y: str | None = None) -> DataFrame:
    """(feature, ordinal, STATS), one row a column, in one pass; y's products are 0 without y. Tables without rows give n = 0.

    A task keeps 12 numbers a column and sends them as one row for each GROUP columns; groups are added up on the executors.
    """
    p = len(columns)
    if not p:
        return df.sparkSession.createDataFrame([], "feature string, ordinal int, " + ", ".join(f"{s} double" for s in STATS))
    schema = pa.schema([("grp", pa.int32()), ("data", pa.binary())])
    names = list(columns)

    def parts_of(sums: np.ndarray) -> list[bytes]:
        return [np.ascontiguousarray(sums[:, i : i + GROUP]).tobytes() for i in range(0, p, GROUP)]

    def sent(sums: np.ndarray) -> pa.RecordBatch:
        parts = parts_of(sums)
        return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            flat = b.column(0).flatten()
            z = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, p + 1)
            null = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, p + 1)
            step = max(1, (1 << 20) // (p + 1))
            for i in range(0, len(z), step):
                s = slice(i, i + step)
                made = of_block(z[s, :-1], null[s, :-1], z[s, -1], null[s, -1])
                sums = made if sums is None else joined(sums, made)
        if sums is not None:
            yield sent(sums)

    out = pa.schema([("feature", pa.string()), ("ordinal", pa.int32()), *[(s, pa.float64()) for s in STATS]])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(data.as_buffer()).reshape(len(STATS), -1)
                held[k] = joined(held[k], v) if k in held else v
        for k, v in held.items():
            at = range(k * GROUP, k * GROUP + v.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at]), pa.array(at, pa.int32()), *[pa.array(s) for s in v]], schema=out)

    sums = df.select((vector([*columns, y]) if y else vector(columns, "cast(null as double)")).alias("z")).mapInArrow(part, "grp int, data binary")
    none = parts_of(of_block(np.zeros((0, p)), np.zeros((0, p), bool), np.zeros(0), np.zeros(0, bool)))  # so that a table without rows has its rows of zeros
    sums = sums.unionByName(df.sparkSession.createDataFrame(list(enumerate(none)), "grp int, data binary"))
    return sums.repartition(-(-p // GROUP), "grp").mapInArrow(whole, "feature string, ordinal int, " + ", ".join(f"{s} double" for s in STATS))
