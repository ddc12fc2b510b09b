"""A configuration from start to report."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import tune
from ..sources import config as C
from ..sources import sinks, tables
from .fit import Result, Settings, fit

log = logging.getLogger("pipeline")


def settings_of(c: C.Config) -> Settings:
    f, r, p = c.feature_selection, c.regression, c.preprocessing
    return Settings(
        algorithm=r["algorithm"], hyperparams=(r.get("hyperparams") or {}).get(r["algorithm"]) or {}, selector=f["algorithm"], selector_hyperparams=f.get("hyperparams") or {}, top_k=f.get("top_k", 20),
        ratios=p["train_val_test_ratio"], seed=c.general["seed"], window=p["avg_wsize"], drop_constant=p["drop_zero_var"], intercept=r["intercept_on"], non_negative=r["non_negative_coef_only"], timeout=r["hpo_timeout"],
    )


@contextmanager
def logged(run_dir: str) -> Iterator[None]:
    """The run's messages in its fit.log; the line that names the report says that the run is finished."""
    handler, level = logging.FileHandler(os.path.join(run_dir, "fit.log"), mode="w", encoding="utf-8"), log.level
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s :: %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        yield
    finally:
        log.removeHandler(handler)
        log.setLevel(level)
        handler.close()


def trials_of(result: Result) -> str:
    """How the search went, one line a trial."""
    return "\n".join(f"- {r['trial']}: {r['status']}, R2 {r['score']:.4f}" for r in result.trials.orderBy("trial").collect())


def run(spark: SparkSession, config_path: str, output_root: str, base: str = ".", n_trials: int = 5, at_once: int = 1) -> tuple[C.Config, Result]:
    """Fit what a configuration says; its folder gets tables, report.md, and a log line that names the report."""
    c = C.load(config_path, output_root)
    g, settings = c.general, settings_of(c)
    settings.n_trials, settings.at_once = n_trials, at_once
    paths = {k: [C.resolved(p, base) for p in g[k]] for k in ("trainset_x_path", "testset_x_path", "y_path")}
    rows, test, columns = tables.load_train_test(spark, paths["trainset_x_path"], paths["testset_x_path"], paths["y_path"], g["y_label"])
    with logged(c.run_dir):
        result = fit(rows, columns, settings, test)
        sinks.save_split_tables(result.windows, result.columns, f"{c.run_dir}/splits")
        sinks.save_scaler(result.scaler, f"{c.run_dir}/standardizer")
        sinks.save_splits(result.predictions, f"{c.run_dir}/predictions")
        sinks.save_importance(result.importance, f"{c.run_dir}/importance")
        sinks.save_table(result.trials, f"{c.run_dir}/trials")
        sinks.save_table(tune.importances(result.trials.withColumn("study", F.lit(settings.algorithm))).orderBy(F.desc("importance")), f"{c.run_dir}/param_importances")
        sinks.save_table(result.model.convergence(rows), f"{c.run_dir}/convergence")
        notes = []
        if result.interaction is None:
            notes.append("this model gives no interactions")
        else:
            top = [r["feature"] for r in sinks.top_features(result.importance).collect()]
            sinks.save_table(sinks.interaction_matrix(result.interaction, top), f"{c.run_dir}/interaction")
        if hasattr(result.model, "table"):
            sinks.save_table(result.model.table(rows).orderBy(F.desc(F.abs("coef") * F.col("support"))), f"{c.run_dir}/rules")
        report = os.path.join(c.run_dir, "report.md")
        sinks.write_atomically(report, sinks.report(c.path, settings.algorithm, settings.selector, result.counts, result.metrics, result.params, notes, settings.seed, settings.top_k if settings.selector else None, {"Trials": trials_of(result)}))
        log.info("done: %s", report)
    return c, result
