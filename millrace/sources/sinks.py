"""What a run leaves: splits, scaler, tables as CSV, a report, a manifest."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import SPLITS


def save_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def save_split_tables(df: DataFrame, columns: list[str], path: str) -> None:
    """Six tables, x and y of each split (x_train to y_test), with their columns' types even where a split has no rows."""
    for s in SPLITS:
        own = df.where(F.col("split") == s)
        own.select("split_row_idx", *[f"`{c}`" for c in columns]).write.mode("overwrite").parquet(f"{path}/x_{s}")
        own.select("split_row_idx", "y").write.mode("overwrite").parquet(f"{path}/y_{s}")


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def save_importance(importance: DataFrame, path: str) -> None:
    importance.orderBy(F.desc("importance"), "feature").write.mode("overwrite").csv(path, header=True)


def interaction_matrix(pairs: DataFrame, top: list[str]) -> DataFrame:
    """Pairs of the top features as a square table with zeros where there is none."""
    return pairs.where(F.col("feature_i").isin(top) & F.col("feature_j").isin(top)).groupBy("feature_i").pivot("feature_j", top).agg(F.sum("weight")).fillna(0.0)


def save_table(df: DataFrame, path: str) -> None:
    """A table as CSV; maps become JSON."""
    df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name) for f in df.schema]).write.mode("overwrite").csv(path, header=True)


# The headings, key lines and cell formats that the run analytics parse.
KEYS = ("- Config: `{}`", "- Algorithm: **{}**", "- Feature selection: **{}**")
COUNTS = ("## Row counts", "| Stage | Train | Val | Test | Features |")
METRICS = ("## Metrics (in original y units)", "| Split | sMAPE (%) | MAPE (%) | RMSE | MAE | R^2 |")
CELLS = (("smape", ".3f"), ("mape", ".3f"), ("rmse", ".5f"), ("mae", ".5f"), ("r2", ".4f"))


def markdown(heading: str, header: str, rows: list[list[object]]) -> list[str]:
    """A section with a table, numbers to the right."""
    columns = header.count("|") - 1
    return [heading, "", header, "|---|" + "---:|" * (columns - 1), *["| " + " | ".join(map(str, r)) + " |" for r in rows], ""]


def report(config_path: str, algorithm: str, selector: str | None, counts: list[dict], metrics: DataFrame, params: dict, notes: list[str], seed: int | None = None, top_k: int | None = None, extras: dict[str, str] | None = None) -> str:
    """A run's Markdown report, in the form that the run analytics parse: its setting, rows by stage, metrics, parameters, notes and further sections."""
    found = {r["split"]: r for r in metrics.collect()}  # three rows
    lines = ["# Fit report", "", *[line.format(v) for line, v in zip(KEYS, (config_path, algorithm, selector or "none"), strict=True)]]
    lines += [f"- {name}: {v}" for name, v in (("Top features", top_k), ("Seed", seed)) if v is not None] + [""]
    lines += markdown(*COUNTS, [[c["stage"], *[c.get(s, 0) for s in SPLITS], c["features"]] for c in counts])
    lines += markdown(*METRICS, [[s, *[format(found[s][name], form) for name, form in CELLS]] for s in SPLITS if s in found])
    lines += ["## Best hyper-parameters", "", *[f"- {k}: {v}" for k, v in params.items()], "", "## Notes", "", *[f"- {n}" for n in notes], ""]
    for title, body in (extras or {}).items():
        lines += [f"## {title}", "", body, ""]
    return "\n".join(lines)


def write_atomically(path: str, content: str | dict) -> None:
    """Write beside the target, then rename, so that readers see all or nothing."""
    text = content if isinstance(content, str) else json.dumps(content, indent=2, sort_keys=True)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, other = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(other, path)


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
