"""The eight feature selectors: (rank, feature, score), best first, at most k rows."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import information, solvers
from .stats import Gram, column_scores, fold_grams, fold_of, top_k


log = logging.getLogger("pipeline")


def _table(df: DataFrame, columns: Sequence[str], found: Sequence[tuple[int, float]]) -> DataFrame:
    rows = [(i + 1, columns[j], float(s)) for i, (j, s) in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, score double")


def _folds(df: DataFrame, columns: Sequence[str], y: str, index: str, folds: int) -> dict[int, Gram]:
    return fold_grams(df, columns, y, fold_of(F.col(index), df.count(), folds))


def pearson(df, columns, y, index, k, **_):
    return top_k(column_scores(df, columns, "pearson", y), k)


def variance(df, columns, y, index, k, threshold: float = 0.0, **_):
    """Columns whose variance is above the threshold; none left is an error. On z-scored columns, all of variance one, it says little."""
    scores = sorted(((r["score"], r["ordinal"]) for r in column_scores(df, columns, "variance", y).collect()), key=lambda s: (-s[0], s[1]))  # a number a column
    if len(scores) > 1 and all(abs(s - 1) < 1e-6 for s, _ in scores):
        log.warning("all %d columns have a variance of one: z-scored columns can't be told apart by it", len(scores))
    found = [(j, s) for s, j in scores if s > threshold]
    if not found:
        raise ValueError(f"no column has a variance above {threshold}")
    return _table(df, columns, found[:k])


def univariate(df, columns, y, index, k, score_func: str = "f_regression", **_):
    if score_func == "f_regression":
        return top_k(column_scores(df, columns, "f", y), k)
    return top_k(information.scores(df, columns, y, index), k)


def rfe(df, columns, y, index, k, step: float = 0.1, **_):
    gram = fold_grams(df, columns, y)[0]
    kept = solvers.eliminate(gram, k, step)
    return _table(df, columns, list(zip(kept, np.abs(solvers.ridge(gram, kept)), strict=True)))


def from_model(df, columns, y, index, k, estimator: str = "lasso", positive: bool = False, trees: int = 200, seed: int = 42, **_):
    if estimator == "lasso":
        w, *_rest = solvers.elastic_net_cv(_folds(df, columns, y, index, 3), [1.0], 20, positive, max_iter=5000)
        size = np.abs(w)
    else:
        rows = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df.select(*columns, F.col(y).alias("_y")))
        size = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed).fit(rows).featureImportances.toArray()
    order = np.argsort(-size, kind="stable")
    some = [j for j in order if size[j] > 0]
    return _table(df, columns, [(int(j), size[j]) for j in (some if len(some) >= k else order)[:k]])


def sequential(df, columns, y, index, k, **_):
    if k >= len(columns):
        raise ValueError("sequential selection needs fewer columns than there are")
    folds = _folds(df, columns, y, index, 3)
    kept = solvers.forward(folds, k)
    return _table(df, columns, list(zip(kept, np.abs(solvers.ridge(sum(folds.values(), Gram(0.0, 0.0, 0.0)), kept)), strict=True)))


def mcp(df, columns, y, index, k, gamma: float = 5.0, positive: bool = False, **_):
    G, b, _yy = fold_grams(df, columns, y)[0].centred
    w = solvers.mcp_path(G, b, k, gamma, positive)
    if not w.any():
        raise ValueError("no column is selected")
    order = [j for j in np.argsort(-np.abs(w), kind="stable") if w[j]][:k]
    return _table(df, columns, [(int(j), abs(w[j])) for j in order])


def deep(df, columns, y, index, k, multiplier: int = 3, passes: int = 20, gamma: float = 5.0, **_):
    return _table(df, columns, solvers.deep(*fold_grams(df, columns, y)[0].centred, k, multiplier, passes, gamma))


SELECTORS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (pearson, variance, univariate, rfe, from_model, sequential, mcp, deep)}


def select(df: DataFrame, columns: Sequence[str], method: str | None, k: int, y: str = "y", index: str = "split_row_idx", hyperparams: dict | None = None) -> DataFrame:
    """Rank columns that are z-scored already; ``hyperparams`` holds a mapping for each method. No method: all columns."""
    if method is None:
        return _table(df, columns, [(i, 0.0) for i in range(len(columns))])
    return SELECTORS[method](df, columns, y, index, min(k, len(columns)), **((hyperparams or {}).get(method) or {}))
