"""Row-ordered tables: pairing of files, row index, seeded split, windows, scaling, checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import checkpointed
from ..functions.scalar import guarded, is_finite
from .moments import moments


def with_row_index(df: DataFrame, group: str, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Number each group's rows from 0 in the given total order, without putting a group in one task.

    Rows are range-partitioned by (group, order); a row's place is its place in its partition plus the group's rows in
    the partitions before, which a table of one row for each partition and group tells.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed.withColumn("_part", F.shiftright("_at", 33)))
    parts = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = placed.join(parts.drop("_n"), (F.col(group).eqNullSafe(F.col("_group"))) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, name)


# ---------------------------------------------------------------- pairing of files


def pair_stems(x: DataFrame, y: DataFrame) -> DataFrame:
    """Inner join of x and y files by stem."""
    return x.join(y, "stem")


def stems_without(left: DataFrame, right: DataFrame) -> DataFrame:
    """Stems of left that right lacks."""
    return left.select("stem").distinct().join(right.select("stem").distinct(), "stem", "left_anti")


def stems_in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("stem").intersect(right.select("stem"))


def repeated_stems(files: DataFrame) -> DataFrame:
    return files.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")


def align_rows(x: DataFrame, y: DataFrame, group: str = "benchmark") -> DataFrame:
    """Join features and labels by place; groups of unequal length are an error. Rows without a group are a group of their own."""
    of = lambda d, n: d.groupBy(F.col(group).alias(f"_{n}")).agg(F.count("*").alias(n))
    counts = of(x, "nx").join(of(y, "ny"), F.col("_nx").eqNullSafe(F.col("_ny")), "full")
    if bad := counts.where("coalesce(nx, 0) <> coalesce(ny, 0)").select(F.coalesce("_nx", "_ny"), "nx", "ny").limit(5).collect():
        raise ValueError(f"row counts differ: {[tuple(r) for r in bad]}")
    right = y.withColumnsRenamed({group: "_group", "row_idx": "_row"})
    return x.join(right, F.col(group).eqNullSafe(F.col("_group")) & (F.col("row_idx") == F.col("_row"))).drop("_group", "_row")


def check_same_columns(frames: dict[str, list[str]]) -> None:
    """All tables must have the same columns in the same order."""
    first = next(iter(frames.values()), [])
    for name, columns in frames.items():
        if columns != first:
            raise ValueError(f"columns of {name} differ: missing {sorted(set(first) - set(columns))}, extra {sorted(set(columns) - set(first))}, or another order")


# ---------------------------------------------------------------- split


def split_plan(counts: dict[str, int], ratios: Sequence[float], seed: int, external_test: bool = False) -> list[tuple[str, int, int, int, int]]:
    """(benchmark, rows, start, end of block, end of its val part) for each benchmark, drawn in their sorted order."""
    val, test = ratios[1], ratios[2]
    cut, rng, plan = val + test, np.random.default_rng(seed), []
    for name in sorted(counts, key=lambda g: (g is not None, g)):  # rows without a benchmark come first
        n = counts[name]
        block = int(round(n * cut))
        if block >= n:
            raise ValueError(f"{name}: a block of {block} of {n} rows leaves no training rows")
        start = int(rng.integers(0, n - block + 1)) if block else 0
        part = block if external_test else (int(round(block * val / cut)) if cut else 0)
        plan.append((name, n, start, start + block, start + part))
    return plan


def split(df: DataFrame, ratios: Sequence[float], seed: int, group: str = "benchmark", external_test: bool = False, counts: dict[str, int] | None = None) -> DataFrame:
    """Add split and split_row_idx (the row's place in its split, over the benchmarks in sorted order)."""
    counts = counts or {r[0]: r[1] for r in df.groupBy(group).count().collect()}  # one row a benchmark
    offsets, rows = {"train": 0, "val": 0, "test": 0}, []
    for name, n, start, end, middle in split_plan(counts, ratios, seed, external_test):
        rows.append((name, start, end, middle, offsets["train"], offsets["val"], offsets["test"]))
        offsets = {"train": offsets["train"] + n - (end - start), "val": offsets["val"] + middle - start, "test": offsets["test"] + end - middle}
    plan = df.sparkSession.createDataFrame(rows, "_group string, _start bigint, _end bigint, _mid bigint, _train bigint, _val bigint, _test bigint")
    i = F.col("row_idx")
    which = F.when((i < F.col("_start")) | (i >= F.col("_end")), "train").when(i < F.col("_mid"), "val").otherwise("test")
    place = F.when(i < F.col("_start"), F.col("_train") + i).when(i >= F.col("_end"), F.col("_train") + i - (F.col("_end") - F.col("_start"))).when(i < F.col("_mid"), F.col("_val") + i - F.col("_start")).otherwise(F.col("_test") + i - F.col("_mid"))
    return df.join(F.broadcast(plan), F.col(group).eqNullSafe(F.col("_group"))).withColumn("split", which).withColumn("split_row_idx", place).select(*df.columns, "split", "split_row_idx")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"))


def sampled(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """n rows, or all where there are fewer: those whose keys have the least hash with the seed. Each task keeps n rows at most."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


# ---------------------------------------------------------------- windows and scaling


def window_mean(df: DataFrame, columns: Sequence[str], size: int, keys: Sequence[str] = ("split",), index: str = "split_row_idx") -> DataFrame:
    """Means of full windows of ``size`` rows; what doesn't fill the last window is left out.

    A group (split) that has rows but not one full window is an error when the windows are read: it would be lost as a whole.
    """
    if size < 1:
        raise ValueError("a window has one row at least")
    bins = df.groupBy(*keys, F.floor(F.col(index) / size).cast("bigint").alias("bin")).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("_n"))
    # A group's window 0 is full if any is: rows are numbered from 0.
    short = (F.col("bin") == 0) & (F.col("_n") < size)
    told = F.raise_error(F.concat(F.lit(f"a window of {size} rows is wider than "), F.to_json(F.struct(*[F.col(k) for k in keys])), F.lit(", which has "), F.col("_n").cast("string"))).cast("boolean")
    return bins.where(F.when(short, told).otherwise(F.col("_n") == size)).drop("_n")


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std): population deviation, 0 counted as 1; null without values."""
    some = lambda c: F.when(F.col("n") > 0, c)
    return moments(df, columns).select("feature", some(F.col("mean")).alias("mean"), guarded(some(F.sqrt(F.try_divide("m2", "n")))).alias("std"))


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str], inverse: bool = False) -> DataFrame:
    """Apply a scaler; it has one row a column and is read by the driver."""
    fitted = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}
    of = lambda c: F.col(c) * fitted[c][1] + fitted[c][0] if inverse else (F.col(c) - fitted[c][0]) / fitted[c][1]
    return df.withColumns({c: of(c) for c in columns})


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, is_constant), in one pass; nulls aside, NaN is a value of its own, and a column without values is neither."""
    same = F.when(F.col("n_nan") > 0, F.col("n_nan") == F.col("n")).otherwise(F.col("min") == F.col("max"))
    return moments(df, columns).select("feature", F.when(F.col("n") > 0, same).alias("is_constant"))


def drop_constant(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    kept = [r["feature"] for r in constant_columns(df.where("split = 'train'"), columns).collect() if not r["is_constant"]]
    if not kept:
        raise ValueError("all columns are constant")
    return df.select(*[c for c in df.columns if c not in columns or c in kept]), [c for c in columns if c in kept]


def finite_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_nan, n_inf, n_null) in one pass."""
    return moments(df, columns).select("feature", *[F.col(c).cast("bigint").alias(c) for c in ("n_nan", "n_inf", "n_null")])


def check_finite(df: DataFrame, columns: Sequence[str]) -> None:
    bad = df.where(~F.forall(F.array(*[is_finite(F.col(c).cast("double")) for c in columns]), lambda x: x)).limit(1).count()
    if bad:
        raise ValueError(f"not finite: {[tuple(r) for r in finite_audit(df, columns).where('n_nan + n_inf + n_null > 0').collect()]}")
