import datetime

import duckdb
import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

import __spark_entry__
from millrace.operators import attention, boosting, experiments, information, jobs, models, select, stats, tune
from millrace.plans import registry, run
from millrace.sources import config, sinks, tables
from millrace.streaming.windows import stream_window_mean

SF = "/root/testdata/sf0.001"


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["ols_metrics", "split_assign", "window_mean", "runs_latest", "parse_metrics_row", "int8_mlp", "int8_layer_norm", "rule_importance", "last_report", "hpo_running_best",
                                  *(n for n, f in registry.QUERIES.items() if f.__module__.endswith("artifacts"))])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "embeddings", "lineitem", "nation", "region", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda rows, order: sorted(str(tuple(round(x, 5) if isinstance(x, float) else x for x in (r[i] for i in order))) for r in rows)
    assert norm(got.collect(), range(len(got.columns))) == norm(want.fetchall(), [want.columns.index(c) for c in got.columns])


def write_benchmarks(spark, folder):
    rng = np.random.default_rng(0)
    for b in ("alpha", "beta", "gamma"):
        x = rng.normal(size=(600, 6))
        y = 2 * x[:, 0] + x[:, 2] + 5
        spark.createDataFrame([(i, *map(float, r), 1.0) for i, r in enumerate(x)], "row_idx bigint, " + ", ".join(f"f{j} double" for j in range(6)) + ", same double").write.parquet(f"{folder}/{b}_func")
        spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row_idx bigint, `p/Pc(top)` double").write.parquet(f"{folder}/{b}_pwr")


@pytest.mark.parametrize(("algorithm", "selector"), [("ElasticNetCV", "mcp"), ("RuleFit", None), ("MLP", "pearson")])
def test_run_end_to_end(spark, tmp_path, algorithm, selector):
    write_benchmarks(spark, tmp_path)
    raw = {
        "general": {"trainset_x_path": ["alpha_func", "beta_func"], "testset_x_path": ["gamma_func"], "y_path": ["alpha_pwr", "beta_pwr", "gamma_pwr"], "y_label": "p/Pc(top)", "seed": 1},
        "preprocessing": {"drop_zero_var": True, "train_val_test_ratio": [0.8, 0.2, 0.0], "avg_wsize": 4},
        "feature_selection": {"algorithm": selector, "top_k": 3, "hyperparams": {}},
        "regression": {"algorithm": algorithm, "intercept_on": True, "non_negative_coef_only": False, "hpo_timeout": 60, "hyperparams": {algorithm: {"max_rules": 50} if algorithm == "RuleFit" else {"epochs": 80, "lr": 3e-3} if algorithm == "MLP" else {}}},
    }
    (tmp_path / "cp0_input_mcp_elasticnet.yaml").write_text(yaml.safe_dump(raw))
    c, result = run.run(spark, str(tmp_path / "cp0_input_mcp_elasticnet.yaml"), str(tmp_path / "out"), str(tmp_path), n_trials=1)
    scores = {r.split: r.r2 for r in result.metrics.collect()}
    assert set(scores) == {"train", "val", "test"} and scores["test"] > 0.9
    assert "same" not in result.selected and (selector is None or {"f0", "f2"} <= set(result.selected))
    found = experiments.parsed_reports(experiments.parsed_dirs(tables.reports(spark, str(tmp_path / "out")))).first()
    assert found.skip_reason is None and abs(found.test_r2 - scores["test"]) < 1e-3 and found.module == "cp0" and found.algorithm == algorithm
    # The run finds itself finished, and has left its splits and its scaler.
    logs = spark.createDataFrame([("cp0_input_mcp_elasticnet", c.run_dir, open(f"{c.run_dir}/fit.log").read())], "stem string, run_dir string, log string")
    done = experiments.finished(logs, spark.createDataFrame([(f"{c.run_dir}/report.md",)], "path string")).first()
    assert done.run_dir == c.run_dir and experiments.unfinished(logs, experiments.finished(logs, logs.select(F.concat("run_dir", F.lit("/report.md")).alias("path"))), "stem").count() == 0
    assert spark.read.parquet(f"{c.run_dir}/splits/x_test").count() == 150 and spark.read.parquet(f"{c.run_dir}/standardizer").where("feature = 'y'").count() == 1
    with pytest.raises(ValueError):
        tables.load_pairs(spark, [f"{tmp_path}/alpha_func"], [f"{tmp_path}/beta_pwr"], "p/Pc(top)")


def test_config_rules(tmp_path):
    good = {"general": {"trainset_x_path": ["a"], "testset_x_path": [], "y_path": ["b"], "y_label": "y", "seed": 1}, "preprocessing": {"drop_zero_var": True, "train_val_test_ratio": [0.8, 0.1, 0.1], "avg_wsize": 1}, "feature_selection": {"algorithm": None, "hyperparams": None}, "regression": {"algorithm": "MLP", "intercept_on": False, "non_negative_coef_only": True, "hpo_timeout": 1}}
    config.check(good)
    for section, key, value in (("general", "y_path", []), ("general", "seed", "x"), ("preprocessing", "avg_wsize", 0), ("preprocessing", "train_val_test_ratio", [0.5, 0.1, 0.1]), ("feature_selection", "algorithm", "best"), ("regression", "hpo_timeout", 0), ("regression", "algorithm", "SVM")):
        with pytest.raises(config.ConfigError):
            config.check(good | {section: good[section] | {key: value}})
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(good))
    assert config.load(str(tmp_path / "a.yaml"), str(tmp_path), datetime.datetime(2024, 5, 6, 7, 8, 9)).run_dir.endswith("a_20240506_070809")
    sinks.write_atomically(str(tmp_path / "m" / "manifest.json"), {"a": 1})
    assert (tmp_path / "m" / "manifest.json").read_text() == '{\n  "a": 1\n}'


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = models.Layers(4, 5, 3, 0.0, 1e-3, 0.0, 1)
    x, y = rng.normal(size=(7, 4)), rng.normal(size=7)
    grads, loss = net.gradients(x, y)
    for i, w in enumerate(net.w):
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-6
        assert np.isclose((net.gradients(x, y)[1] - loss) / 1e-6, grads[i][at], atol=1e-4)
        w[at] -= 1e-6


def test_tree_rules():
    z = np.zeros(5)
    tree = boosting.Tree(np.array([0, -1, 1, -1, -1]), z.astype(int), np.array([0.5, 0, -2.0, 0, 0]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), z, z, z)
    assert models.tree_rules([tree, tree], ["a", "b"]) == ["a <= 0.5", "a > 0.5", "a > 0.5 & b <= -2.0", "a > 0.5 & b > -2.0"]


def test_mutual_information_ranks():
    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=800), rng.normal(size=800)
    near = information.neighbours_information(x, x**2 + 0.1 * noise)
    assert near > 0.5 > 0.1 > information.neighbours_information(noise, x)
    r = 0.9
    assert abs(information.neighbours_information(x, r * x + np.sqrt(1 - r * r) * noise) + 0.5 * np.log(1 - r * r)) < 0.12


def plain_information(x, y, k=3, seed=42):
    """Kraskov's estimate from the whole matrix of distances."""
    n, rng = len(x), np.random.default_rng(seed)
    x, y = x / x.std(), y / y.std()
    x, y = (v + 1e-10 * max(1, np.abs(v).mean()) * rng.standard_normal(n) for v in (x, y))
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    r = np.nextafter(np.partition(np.maximum(dx, dy), k, axis=1)[:, k], 0)
    psi = lambda m: np.concatenate(([0.0], np.cumsum(1 / np.arange(1, n + 1))))[m - 1] - np.euler_gamma
    return max(0.0, psi(n) + psi(k) - (psi((dx <= r[:, None]).sum(1)) + psi((dy <= r[:, None]).sum(1))).mean())


def test_mutual_information_reads_all_rows(spark):
    rng = np.random.default_rng(6)
    n = 5000
    y = rng.normal(size=n)
    columns = {"weak": 0.3 * y + rng.normal(size=n), "steps": np.round(y + rng.normal(size=n)), "rare": np.where(rng.random(n) < 0.1, y, rng.normal(size=n))}
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(y, *columns.values(), strict=True))]
    df = spark.createDataFrame(rows, "i bigint, y double, " + ", ".join(f"{c} double" for c in columns)).repartition(4)
    found = {r.feature: r.score for r in select.univariate(df, list(columns), "y", "i", 3, score_func="mutual_info").collect()}
    for name, x in columns.items():
        # Rows of equal x are told apart by noise, which moves the estimate of steps by some 5e-4 from draw to draw.
        assert found[name] == pytest.approx(plain_information(x, y), abs=1e-3 if name == "steps" else 1e-6)


def test_attention_close_to_float():
    rng = np.random.default_rng(4)
    x = rng.integers(-60, 60, (5, 4, 16))
    w = [rng.integers(-20, 20, s) for s in ((48, 16), (48,), (16, 16), (16,))]
    y = attention.attend(x, *w, heads=4)
    f = [a / 128 for a in w]
    q, k, v = ((x / 128) @ f[0].T + f[1]).reshape(5, 4, 3, 4, 4).transpose(2, 0, 3, 1, 4)
    e = np.exp(q @ k.transpose(0, 1, 3, 2) / 2)
    c = (e / e.sum(-1, keepdims=True) @ v).transpose(0, 2, 1, 3).reshape(5, 4, 16)
    assert np.abs(y / 128 - np.clip(c @ f[2].T + f[3], -1, 127 / 128)).max() < 6 / 128


def test_stream_windows(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, i bigint, v double")
    for n in range(4):
        df.where(f"i div 25 = {n}").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_window_mean(stream, "key", "i", ["v"], 8).writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.bin): r.v for r in spark.table("means").collect()}
    for k in "ab":
        own = [v for key, _, v in rows if key == k]
        assert [got[k, b] for b in range(len(own) // 8)] == [float(np.mean(own[8 * b : 8 * b + 8])) for b in range(len(own) // 8)]
    assert len(got) == sum(len([1 for r in rows if r[0] == k]) // 8 for k in "ab")


def test_latest_and_failed_trials(spark):
    runs = spark.createDataFrame([("m", "t1", "d1", 0.1), ("m", "t2", "d2", None), ("n", "t1", "d3", 0.3)], "k string, timestamp string, run_dir string, r2 double")
    assert {r.run_dir for r in experiments.latest(runs, ["k"]).collect()} == {"d2", "d3"}
    last = experiments.ranked(runs, ["timestamp"], [experiments.sortable("r2").desc()])
    assert {r.run_dir: r.rank for r in last.collect()} == {"d3": 1, "d1": 2, "d2": 1}


def test_bounded_jobs():
    import threading

    running, most, lock = [0], [0], threading.Lock()

    def work(n):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return 10 // n
        finally:
            with lock:
                running[0] -= 1

    found = jobs.run_bounded([5, 0, 2, 1, 10], work, 2)
    assert [r for _, r, _ in found] == [2, None, 5, 10, 1] and found[1][2].startswith("ZeroDivisionError") and most[0] <= 2
    with pytest.raises(ValueError):
        jobs.run_bounded([1], work, 0)


def test_strict_reports(spark):
    good = "## Metrics (in original y units)\n" + "".join(f"| {s} | 1 | 2 | 3 | 4 | 0.5 |\n" for s in ("train", "val", "test"))
    experiments.check_strictly(spark.createDataFrame([(good,)], "report string"))
    with pytest.raises(ValueError, match="not a number"):
        experiments.check_strictly(spark.createDataFrame([(good,), (good.replace("| 3", "| 1e"),)], "report string"))


def test_perfect_feature_comes_first(spark):
    rows = spark.createDataFrame([(float(i), 3.0 * i, float(i % 7), 1.0) for i in range(50)], "y double, same double, other double, flat double")
    found = stats.column_scores(rows, ["flat", "other", "same"], "f")
    assert [r.feature for r in stats.top_k(found, 3).collect()] == ["same", "other", "flat"]


def test_running_best_in_parts(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, float(v) if v > 0.1 else None) for i, v in enumerate(rng.random(500))] + [("b", 1, None), ("b", 2, 0.5)]
    found = {(r.study, r.trial): r.best for r in experiments.running_best(spark.createDataFrame(rows, "study string, trial int, score double"), "study", "trial", "score").collect()}
    best = {}
    for s, t, v in rows:
        best[s] = max((x for x in (best.get(s), v) if x is not None), default=None)
        assert found[s, t] == best[s]


def test_failed_trials_of_any_kind_go_on(spark, monkeypatch):
    rows = spark.createDataFrame([("train" if i % 3 else "val", i, float(i), 2.0 * i) for i in range(90)], "split string, split_row_idx bigint, a double, y double")
    kind, calls = models.REGISTRY["ElasticNetCV"], []
    fit = kind.fit

    def sometimes(self, *a, **k):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("a worker was lost")
        return fit(self, *a, **k)

    monkeypatch.setattr(kind, "fit", sometimes)
    _, _, trials = tune.study("ElasticNetCV", rows.where("split = 'train'"), rows.where("split = 'val'"), ["a"], n_trials=2)
    assert [r.status.split(":")[0] for r in trials.orderBy("trial").collect()] == ["failed", "complete"]
