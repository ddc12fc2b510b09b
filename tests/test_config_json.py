"""Configurations that are JSON are read without the YAML parser, with the same meaning."""

import json

import yaml

from millrace.sources import config as C

ODD = ["{}", "", "null", "{", '{"a":1e5}', '{"a":1.5e3}', '{"a":1.5e+3}', '{"a":-0}', '{"a":-0.5}', '{"a":NaN}', '{"a":Infinity}', '{"a":"\\u00e9"}', '{"a":"\\ud800"}', '{"a":"b\\/c"}', '{"a":"\u00e9"}', '{"a":1,"a":2}',
       '{"<<":{"a":1}}', '{"=":1}', '{"a":"2020-01-01","b":"yes","c":"~","d":"1:30"}', '{"a":[0.1,0.20,0.7],"b":null,"c":true}', '{"a" : 1 , "b":[ ]}', '{"a":yes}', '{a: 1}', '{"a":1} # c', '{"a":"# x: y, - ?"}', "[1,2]", '"a"', "a: 1", '{"a":\t1}',
       '{"a":12345678901234567890}', '{"a":"' + "x" * 2000 + '"}', '{"' + "k" * 2000 + '":1}', '{"":""}', '{"a":{"b":{"c":[[],{}]}}}', "{" + '"a":[' + "[" * 50 + "]" * 50 + "]}"]


def _whole(read, text):
    try:
        return repr(read(text))
    except yaml.YAMLError:
        return "error"


def test_json_means_what_yaml_says():
    for text in ODD:
        assert _whole(C.parsed, text) == _whole(lambda t: yaml.load(t, getattr(yaml, "CSafeLoader", yaml.SafeLoader)), text), text[:40]


def test_json_is_not_given_to_the_yaml_parser(monkeypatch):
    good = {"general": {"trainset_x_path": ["a"], "testset_x_path": [], "y_path": ["b"], "y_label": "p", "seed": 1}, "preprocessing": {"drop_zero_var": True, "train_val_test_ratio": [0.7, 0.2, 0.1], "avg_wsize": 4},
            "feature_selection": {"algorithm": None, "hyperparams": None}, "regression": {"algorithm": "MLP", "intercept_on": True, "non_negative_coef_only": False, "hpo_timeout": 3}}
    monkeypatch.setattr(yaml, "load", lambda *_: 1 / 0)
    assert C.place_of_error(json.dumps(good)) is None
    assert C.place_of_error(json.dumps(good | {"general": {}})) == "general.trainset_x_path"
