"""The whole fit: split, prune, windows, z-scores, selection, search, metrics in the target's own units."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cluster import checkpointed
from ..operators import frame, select, stats, tune
from ..operators.models import Regressor


@dataclass
class Settings:
    algorithm: str = "ElasticNetCV"
    hyperparams: dict = field(default_factory=dict)
    selector: str | None = None
    selector_hyperparams: dict = field(default_factory=dict)
    top_k: int = 20
    ratios: Sequence[float] = (0.8, 0.2, 0.0)
    seed: int = 42
    window: int = 128
    drop_constant: bool = True
    intercept: bool = False
    non_negative: bool = True
    n_trials: int = 5
    timeout: float = 300
    at_once: int = 1


@dataclass
class Result:
    model: Regressor
    params: dict
    trials: DataFrame
    metrics: DataFrame
    predictions: DataFrame
    selected: list[str]
    importance: DataFrame
    interaction: DataFrame | None
    counts: list[dict]
    windows: DataFrame
    columns: list[str]
    scaler: DataFrame


def scaled(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """z-scores of the columns and y by the training rows; the target's own values stay in ``truth``."""
    scaler = frame.fit_scaler(rows.where("split = 'train'"), [*columns, "y"])
    return frame.scale(rows.withColumn("truth", F.col("y")), scaler, [*columns, "y"]), scaler


def stage(name: str, rows: DataFrame, columns: Sequence[str]) -> dict:
    """A stage's rows in each split and its number of features."""
    return {"stage": name, "features": len(columns)} | {r["split"]: r["n_rows"] for r in frame.split_counts(rows).collect()}  # three rows


def fit_windows(rows: DataFrame, columns: Sequence[str], settings: Settings, counts: list[dict] | None = None) -> Result:
    """From windows (split, bin, columns, y) to a fitted model and its report."""
    rows = checkpointed(rows)  # windows are read by every step from here on; what made them isn't run again
    frame.check_finite(rows, [*columns, "y"])
    z, scaler = scaled(rows, columns)
    z = checkpointed(z.withColumnRenamed("bin", "split_row_idx"))
    train, val = z.where("split = 'train'"), z.where("split = 'val'")
    ranked = select.select(train, columns, settings.selector, settings.top_k, hyperparams=settings.selector_hyperparams)
    kept = [r["feature"] for r in ranked.orderBy("rank").collect()]
    after = stage("after_preprocess", z, columns)
    counts = [*(counts or []), after, after | {"stage": "after_feature_selection", "features": len(kept)}]
    model, params, trials = tune.study(settings.algorithm, train, val, kept, settings.hyperparams, settings.n_trials, settings.seed, settings.timeout, settings.at_once, intercept=settings.intercept, non_negative=settings.non_negative)
    y = scaler.where("feature = 'y'").first()
    found = model.predict(z).select("split", "split_row_idx", F.col("truth").alias("y"), (F.col("prediction") * y["std"] + y["mean"]).alias("prediction"))
    return Result(model, params, trials, stats.metrics(found), found, kept, model.importance(z), model.interaction(z), counts, rows.withColumnRenamed("bin", "split_row_idx"), list(columns), scaler)


def fit(rows: DataFrame, columns: Sequence[str], settings: Settings, external_test: DataFrame | None = None) -> Result:
    """rows: benchmark, row_idx, columns and y. With ``external_test``, its rows are the test split."""
    parts = frame.split(rows, settings.ratios, settings.seed, external_test=external_test is not None)
    if external_test is not None:
        test = frame.split(external_test, (1.0, 0.0, 0.0), settings.seed).withColumn("split", F.lit("test"))
        parts = parts.unionByName(test)
    counts = [stage("loaded", parts, columns)]
    if settings.drop_constant:
        parts, columns = frame.drop_constant(parts, columns)
    windows = frame.window_mean(parts, [*columns, "y"], settings.window)
    return fit_windows(windows, columns, settings, counts)
