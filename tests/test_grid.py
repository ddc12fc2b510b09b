import json
import time

import pytest
import yaml
from pyspark.sql import functions as F

from millrace.operators import experiments, models, select, tune
from millrace.plans import grid

from .test_runs_and_models import write_benchmarks


def configuration(algorithm, **hp):
    return {
        "general": {"trainset_x_path": ["alpha_func", "beta_func"], "testset_x_path": ["gamma_func"], "y_path": ["alpha_pwr", "beta_pwr", "gamma_pwr"], "y_label": "p/Pc(top)", "seed": 1},
        "preprocessing": {"drop_zero_var": True, "train_val_test_ratio": [0.8, 0.2, 0.0], "avg_wsize": 4},
        "feature_selection": {"algorithm": "pearson", "top_k": 3, "hyperparams": {}},
        "regression": {"algorithm": algorithm, "intercept_on": True, "non_negative_coef_only": False, "hpo_timeout": 60, "hyperparams": {algorithm: hp}},
    }


def test_grid_skips_finished_runs(spark, tmp_path):
    write_benchmarks(spark, tmp_path)
    (tmp_path / "configs").mkdir()
    for name, c in (("cp0_input_pearson_elasticnet", configuration("ElasticNetCV", n_alphas=5)), ("cp0_input_pearson_mlp", configuration("MLP", epochs=2)), ("cp0_input_pearson_bad", configuration("ElasticNetCV") | {"general": {}})):
        (tmp_path / "configs" / f"{name}.yaml").write_text(yaml.safe_dump(c))
    (tmp_path / "configs" / "notes.txt").write_text("not a configuration")
    folder, out = str(tmp_path / "configs"), str(tmp_path / "out")
    first = grid.run_grid(spark, folder, out, str(tmp_path), 2, 1)
    status = {k: r["status"] for k, r in first["runs"].items()}
    assert status == {"cp0_input_pearson_bad": "failed", "cp0_input_pearson_elasticnet": "completed", "cp0_input_pearson_mlp": "completed"}
    assert json.loads((tmp_path / "out" / "manifest.json").read_text()) == first and first["runs"]["cp0_input_pearson_elasticnet"]["r2"]["test"] > 0.99
    report = open(first["runs"]["cp0_input_pearson_elasticnet"]["run_dir"] + "/report.md").read()
    rows = {x.split(" | ")[0].strip("| "): [c.strip() for c in x.strip("|").split("|")][1:] for x in report.splitlines() if x.startswith(("| loaded", "| after"))}
    assert rows == {"loaded": ["960", "240", "600", "7"], "after_preprocess": ["240", "60", "150", "6"], "after_feature_selection": ["240", "60", "150", "3"]}
    assert "- Seed: 1" in report and "- Top features: 3" in report and "## Trials" in report
    again = grid.run_grid(spark, folder, out, str(tmp_path), 2, 1)
    assert {k: r["status"] for k, r in again["runs"].items()} == {"cp0_input_pearson_bad": "failed", "cp0_input_pearson_elasticnet": "skipped", "cp0_input_pearson_mlp": "skipped"}


def rows_of(spark):
    rows = spark.createDataFrame([("train" if i % 3 else "val", i, float(i), 2.0 * i) for i in range(90)], "split string, split_row_idx bigint, a double, y double")
    return rows.where("split = 'train'"), rows.where("split = 'val'")


def test_trials_side_by_side(spark, monkeypatch):
    """Four at once, with proposals that depend on the seed only."""
    train, val = rows_of(spark)
    kind, spans = models.REGISTRY["ElasticNetCV"], []
    fit = kind.fit

    def timed(self, *a, **k):
        began = time.monotonic()
        time.sleep(0.5)
        made = fit(self, *a, **k)
        spans.append((began, time.monotonic()))
        return made

    monkeypatch.setattr(kind, "fit", timed)
    one, two = (tune.study("ElasticNetCV", train, val, ["a"], n_trials=4, at_once=4)[2].orderBy("trial").collect() for _ in range(2))
    assert [r.params for r in one] == [r.params for r in two] and {r.status for r in one} == {"complete"}
    assert max(b for b, _ in spans[:4]) < min(e for _, e in spans[:4])


def test_a_trial_is_cancelled_at_the_timeout(spark, monkeypatch):
    train, val = rows_of(spark)
    kind, calls = models.REGISTRY["ElasticNetCV"], []
    fit = kind.fit

    def slow(self, *a, **k):
        calls.append(1)
        if len(calls) == 2:
            spark.range(200).repartition(200).select(F.expr("reflect('java.lang.Thread', 'sleep', 2000L)")).write.format("noop").mode("overwrite").save()
        return fit(self, *a, **k)

    monkeypatch.setattr(kind, "fit", slow)
    began = time.monotonic()
    _, _, trials = tune.study("ElasticNetCV", train, val, ["a"], n_trials=5, timeout=6)
    assert [r.status.split(":")[0] for r in trials.orderBy("trial").collect()] == ["complete", "failed"] and time.monotonic() - began < 40


def test_variance_with_nothing_left(spark, caplog):
    rows = spark.createDataFrame([(i, float(i % 2), 1.0, float(i)) for i in range(10)], "i bigint, a double, b double, y double")
    assert [r.feature for r in select.variance(rows, ["a", "b"], "y", "i", 2).collect()] == ["a"]
    with pytest.raises(ValueError, match="no column"):
        select.variance(rows, ["a", "b"], "y", "i", 2, threshold=3.0)
    with caplog.at_level("WARNING", "pipeline"):
        select.variance(rows.withColumns({"a": F.col("a") * 2, "b": F.col("a") * -2}), ["a", "b"], "y", "i", 2)
    assert "z-scored" in caplog.text


def test_runs_filter_lets_none_pass(spark):
    runs = spark.createDataFrame([("cp0", "input"), ("lsu", "output"), (None, "input")], "module string, kind string")
    count = lambda **w: experiments.only(runs, **w).count()
    assert (count(module=None), count(module=["cp0"]), count(module=["cp0", "lsu"], kind=["input"]), count(kind=[])) == (3, 1, 1, 0)
