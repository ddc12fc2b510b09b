import copy

import pytest
import yaml

from millrace.sources import config

VALID = {
    "general": {"trainset_x_path": ["a_func"], "testset_x_path": [], "y_path": ["a_pwr"], "y_label": "p", "seed": 1},
    "preprocessing": {"drop_zero_var": True, "train_val_test_ratio": [0.7, 0.2, 0.1], "avg_wsize": 4},
    "feature_selection": {"algorithm": "mcp", "top_k": 20, "hyperparams": {}},
    "regression": {"algorithm": "GBDT", "intercept_on": True, "non_negative_coef_only": False, "hpo_timeout": 60},
}
_GONE = object()
#: What is put in place of a value, and the place that has to be named (none: it stays valid).
CASES = [
    ("general", "seed", "x", "general.seed"), ("general", "seed", _GONE, "general.seed"), ("general", "y_label", 3, "general.y_label"), ("general", "trainset_x_path", [], "general.trainset_x_path"),
    ("general", "testset_x_path", [], None), ("general", "y_path", [1], "general.y_path"), ("preprocessing", "drop_zero_var", "yes", "preprocessing.drop_zero_var"),
    ("preprocessing", "train_val_test_ratio", [0.5, 0.2, 0.1], "preprocessing.train_val_test_ratio"), ("preprocessing", "train_val_test_ratio", [0, 0.5, 0.5], "preprocessing.train_val_test_ratio"),
    ("preprocessing", "train_val_test_ratio", [0.7, 0.3], "preprocessing.train_val_test_ratio"), ("preprocessing", "train_val_test_ratio", [1.0, 0.0, 0.0], None), ("preprocessing", "avg_wsize", 0, "preprocessing.avg_wsize"),
    ("feature_selection", "algorithm", "best", "feature_selection.algorithm"), ("feature_selection", "algorithm", None, None), ("feature_selection", "top_k", 0, "feature_selection.top_k"),
    ("feature_selection", "hyperparams", [], "feature_selection.hyperparams"), ("regression", "algorithm", None, "regression.algorithm"), ("regression", "algorithm", "MLP", None),
    ("regression", "intercept_on", 1, "regression.intercept_on"), ("regression", "non_negative_coef_only", _GONE, "regression.non_negative_coef_only"), ("regression", "hpo_timeout", 0, "regression.hpo_timeout"),
    ("general", None, _GONE, "config.general"), ("regression", None, [], "config.regression"), (None, None, [], "root"), ("preprocessing", "avg_wsize", 1, None),
]


def text_of(section, key, value):
    raw = copy.deepcopy(VALID)
    if section is None:
        raw = value
    elif key is None:
        raw.pop(section) if value is _GONE else raw.update({section: value})
    else:
        raw[section].pop(key) if value is _GONE else raw[section].update({key: value})
    return yaml.safe_dump(raw)


@pytest.mark.parametrize("case", CASES, ids=[f"{c[0]}.{c[1]}-{i}" for i, c in enumerate(CASES)])
def test_first_error_of_a_configuration(case):
    assert config.place_of_error(text_of(*case[:3])) == case[3]


def test_configurations_of_a_table(spark):
    texts = [yaml.safe_dump(VALID), "", None, "a: [", "- 1", text_of("general", "seed", "x")]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, config string")
    assert [r.place for r in config.audited(df).orderBy("k").collect()] == [None, "root", "root", "root", "root", "general.seed"]
