"""Run configurations: YAML with four sections, checked by hand-written rules; nothing is filled in."""

from __future__ import annotations

import datetime
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that a configuration may use.
SELECTORS = ("pearson", "variance", "univariate", "rfe", "from_model", "sequential", "mcp", "deep")
ALGORITHMS = ("ElasticNetCV", "GBDT", "RuleFit", "MLP", "FTTransformer")
SECTIONS = ("general", "preprocessing", "feature_selection", "regression")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    general: dict
    preprocessing: dict
    feature_selection: dict
    regression: dict
    path: str
    run_dir: str
    meta: dict = field(default_factory=dict)


def _need(d: dict, key: str, where: str, kinds: type | tuple, rule: Callable[[object], bool] = lambda _: True, what: str = "") -> object:
    if key not in d:
        raise ConfigError(f"{where}.{key} is missing")
    if not isinstance(d[key], kinds) or not rule(d[key]):
        raise ConfigError(f"{where}.{key}: {d[key]!r} {what or 'is of the wrong kind'}")
    return d[key]


def _texts(x: object) -> bool:
    return all(isinstance(v, str) for v in x)


def check(raw: dict) -> None:
    """Raise ConfigError at the first rule that a configuration breaks."""
    if not isinstance(raw, dict):
        raise ConfigError("the root must be a mapping")
    for s in SECTIONS:
        _need(raw, s, "config", dict)
    g, p, f, r = (raw[s] for s in SECTIONS)
    for key in ("trainset_x_path", "testset_x_path", "y_path"):
        _need(g, key, "general", list, lambda x, k=key: _texts(x) and (bool(x) or k == "testset_x_path"), "must be a list of paths, not empty")
    _need(g, "y_label", "general", str)
    _need(g, "seed", "general", int)
    _need(p, "drop_zero_var", "preprocessing", bool)
    ratio = _need(p, "train_val_test_ratio", "preprocessing", list, lambda x: len(x) == 3 and all(isinstance(v, (int, float)) and 0 <= v <= 1 for v in x), "must be three numbers from 0 to 1")
    if abs(sum(ratio) - 1) > 1e-6 or ratio[0] <= 0:
        raise ConfigError("preprocessing.train_val_test_ratio must sum to 1 and train on something")
    _need(p, "avg_wsize", "preprocessing", int, lambda x: x >= 1, "must be 1 or more")
    if _need(f, "algorithm", "feature_selection", (str, type(None)), lambda x: x is None or x in SELECTORS, f"must be one of {SELECTORS} or null") is not None:
        _need(f, "top_k", "feature_selection", int, lambda x: x >= 1, "must be 1 or more")
    _need(f, "hyperparams", "feature_selection", (dict, type(None)))
    _need(r, "algorithm", "regression", str, lambda x: x in ALGORITHMS, f"must be one of {ALGORITHMS}")
    for key in ("intercept_on", "non_negative_coef_only"):
        _need(r, key, "regression", bool)
    _need(r, "hpo_timeout", "regression", int, lambda x: x >= 1, "must be 1 or more")


#: A line of printable ASCII without escapes, short enough for any key of YAML, that may be JSON.
_PLAIN = re.compile(r"\{[ !-\[\]-~]{0,1000}").fullmatch
_FLOAT = re.compile(r"-?\d+\.\d+(?:[eE][-+]\d+)?").fullmatch


def _number(text: str) -> float:
    if not _FLOAT(text):  # a string in YAML
        raise ValueError(text)
    return float(text)


def _other(text: str) -> None:
    raise ValueError(text)


_JSON = json.JSONDecoder(parse_float=_number, parse_constant=_other)


def parsed(text: str | None) -> object:
    """What a text is in YAML. One that is JSON with the same meaning is read as such, at a small part of the cost."""
    if text and _PLAIN(text):
        try:
            return _JSON.decode(text)
        except (ValueError, RecursionError):
            pass
    return yaml.load(text or "", getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def place_of_error(text: str | None) -> str | None:
    """The place that the first broken rule of a configuration's YAML names (root where there is no mapping); None if it passes."""
    try:
        raw = parsed(text)
    except yaml.YAMLError:
        return "root"
    try:
        check(raw)
    except ConfigError as e:
        place = str(e).split()[0].rstrip(":")
        return place if "." in place else "root"
    return None


def audited(configs: DataFrame, text: str = "config") -> DataFrame:
    """A table of configurations' texts with the ``place`` of each one's first error, null where it passes. Null and empty texts have no root."""

    @F.pandas_udf("string")
    def places(texts: pd.Series) -> pd.Series:
        return texts.map(place_of_error).astype(object)

    return configs.withColumn("place", places(text))


def resolved(path: str, base: str) -> str:
    return path if os.path.isabs(path) or "://" in path else os.path.join(base, path)


def run_name(path: str, now: datetime.datetime) -> str:
    return f"{os.path.splitext(os.path.basename(path))[0]}_{now.strftime('%Y%m%d_%H%M%S')}"


def is_config(name: str) -> bool:
    return name.endswith((".yaml", ".yml"))


def load(path: str, output_root: str, now: datetime.datetime | None = None) -> Config:
    """Read and check a configuration, and make its run folder <stem>_<YYYYmmdd_HHMMSS> with what was resolved."""
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    check(raw)
    run_dir = os.path.join(output_root, run_name(path, now or datetime.datetime.now()))
    os.makedirs(run_dir, exist_ok=True)
    with open(os.path.join(run_dir, "config.yaml"), "w", encoding="utf-8") as f:
        yaml.safe_dump(raw | {"_meta": {"config_path": os.path.abspath(path), "run_dir": run_dir}}, f, sort_keys=False)
    return Config(*(raw[s] for s in SECTIONS), path=path, run_dir=run_dir)


def discover(folder: str) -> list[str]:
    """Configurations in a folder, sorted, each once."""
    return sorted({os.path.join(folder, n) for n in os.listdir(folder) if is_config(n)})
