import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.operators import frame, solvers, stats


def table(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(b, i, float(v), float(w)) for b, n in sizes.items() for i, (v, w) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, "benchmark string, row_idx bigint, v double, w double")


@pytest.mark.parametrize("external", [False, True])
def test_split_is_slicing(spark, external):
    sizes = {"b": 37, "a": 101, "c": 2, "d": 64}
    df = table(spark, sizes)
    got = {(r.benchmark, r.row_idx): (r.split, r.split_row_idx) for r in frame.split(df, (0.75, 0.15, 0.1), 7, external_test=external).collect()}
    rng, place, want = np.random.default_rng(7), {"train": 0, "val": 0, "test": 0}, {}
    for b in sorted(sizes):
        n = sizes[b]
        block = int(round(n * 0.25))
        start = int(rng.integers(0, n - block + 1)) if block else 0
        mid = start + (block if external else int(round(block * 0.15 / 0.25)))
        for part, rows in (("train", [*range(start), *range(start + block, n)]), ("val", range(start, mid)), ("test", range(mid, start + block))):
            for i in rows:
                want[b, i] = (part, place[part])
                place[part] += 1
    assert got == want
    with pytest.raises(ValueError):
        frame.split_plan({"x": 3}, (0.1, 0.5, 0.4), 1)


def test_row_index(spark):
    rows = [("a" if i % 3 else None, (i * 7919) % 1000) for i in range(1000)]
    got = frame.with_row_index(spark.createDataFrame(rows, "g string, k bigint"), "g", ["k"]).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert part.sort_values("k")["row_idx"].tolist() == list(range(len(part)))


def test_window_mean(spark):
    df = table(spark, {"a": 23}).withColumn("split", F.lit("train")).withColumnRenamed("row_idx", "split_row_idx")
    x = df.toPandas().sort_values("split_row_idx")["v"].to_numpy()
    got = frame.window_mean(df, ["v"], 5).orderBy("bin").toPandas()
    assert np.allclose(got["v"], x[:20].reshape(4, 5).mean(1))
    with pytest.raises(Exception, match="wider than"):  # the split would be lost
        frame.window_mean(df, ["v"], 50).count()
    with pytest.raises(ValueError):
        frame.window_mean(df, ["v"], 0)


def test_scaling_and_checks(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "train"), (None, float("nan"), "val")], "a double, b double, split string")
    scaler = {r.feature: (r.mean, r.std) for r in frame.fit_scaler(df.where("split = 'train'"), ["a", "b"]).collect()}
    assert scaler == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    assert frame.drop_constant(df, ["a", "b"])[1] == ["a"]
    with pytest.raises(ValueError):
        frame.check_finite(df, ["a", "b"])
    frame.check_finite(df.where("split = 'train'"), ["a", "b"])
    with pytest.raises(ValueError):
        frame.drop_constant(df, ["b"])
    with pytest.raises(ValueError):
        frame.check_same_columns({"x": ["a", "b"], "y": ["b", "a"]})
    with pytest.raises(ValueError):
        frame.align_rows(table(spark, {"a": 3}), table(spark, {"a": 4}))


def test_metrics_of_constant_target(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 1.0)], "split string, y double, prediction double")
    assert {r.split: r.r2 for r in stats.metrics(df).collect()} == {"a": 1.0, "b": 0.0}


@pytest.mark.parametrize("p", [3, 70])
def test_fold_grams(spark, p):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(90, p + 1))
    names = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame(pd.DataFrame(z, columns=[*names, "y"]).assign(i=range(90))).repartition(4)
    grams = stats.fold_grams(df, names, "y", stats.fold_of(F.col("i"), 90, 4))
    for k, rows in enumerate(np.array_split(z, 4)):
        assert grams[k].n == len(rows) and np.allclose(grams[k].products, rows.T @ rows) and np.allclose(grams[k].sums, rows.sum(0))
    w = rng.normal(size=p)
    assert np.isclose(grams[0].loss(w, 0.3), ((z[:23, -1] - z[:23, :-1] @ w - 0.3) ** 2).sum())


def plain_gram(x, y):
    z = np.column_stack((x, y))
    return stats.Gram(len(x), z.sum(0), z.T @ z)


def test_penalised_fits_meet_their_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 30))
    x = (x - x.mean(0)) / x.std(0)
    y = x[:, 3] * 2 - x[:, 8] + rng.normal(size=400) * 0.1
    G, b, yy = plain_gram(x, y).centred
    w = solvers.elastic_net(G, b, 0.1, 0.7, False, 5000, 1e-10)
    g = b - G @ w - 0.1 * 0.3 * w
    assert np.allclose(g[w != 0], 0.07 * np.sign(w[w != 0]), atol=1e-6) and (np.abs(g[w == 0]) <= 0.07 + 1e-6).all()
    assert (solvers.elastic_net(G, b, 0.01, 1.0, True) >= 0).all()
    m = solvers.mcp(G, b, 0.2)
    r = y - y.mean() - x @ m
    z = m + x.T @ r / 400
    want = np.where(np.abs(z) <= 0.2, 0, np.where(np.abs(z) <= 1, np.sign(z) * (np.abs(z) - 0.2) / 0.8, z))
    assert np.allclose(m, want, atol=1e-4)
    assert {j for j, _ in solvers.deep(G, b, yy, 2)} == {3, 8}
    assert set(solvers.eliminate(plain_gram(x, y), 2)) == {3, 8}
    folds = {k: plain_gram(x[r], y[r]) for k, r in enumerate(np.array_split(np.arange(400), 3))}
    assert set(solvers.forward(folds, 2)) == {3, 8}
    assert np.count_nonzero(np.abs(solvers.elastic_net_cv(folds, [1.0], 20, False)[0]) > 0.5) == 2
    start = [0, 1]
    assert set(solvers.swap(G, b, yy, start)) == {3, 8}
    S = [3, 8, 1]
    direct = np.linalg.solve(x[:, S].T @ x[:, S] + np.eye(3), x[:, S].T @ (y - y.mean()))
    assert np.allclose(solvers.ridge(plain_gram(x, y), S), direct)


def test_strings(spark):
    row = spark.range(1).select(
        S.stem(F.lit("cache_func.parquet"), "_func").alias("stem"), S.shortened(F.lit("abcdefghijklmnop"), 14).alias("short"), S.stem_part(F.lit("a_input_b_output_deep_mlp"), 2).alias("kind"),
        S.stem_part(F.lit("nothing"), 1).alias("none"), S.rule_features(F.lit("a <= 0.5 & b > -1.2e3 and a > 1 & z < 1"), F.lit("rule"), ["a", "b"]).alias("f"), S.significant(F.lit(0.0123456), 3).alias("g"))
    r = row.first()
    assert (r.stem, r.short, r.kind, r.none, r.f, round(r.g, 6)) == ("cache", "abcdefgh...nop", "output", None, ["a", "b"], 0.0123)


def test_folds_of_every_benchmark(spark):
    sizes = {"b": 37, "a": 101, "c": 2, "d": 64}
    df = table(spark, sizes)
    counts = df.groupBy("benchmark").agg(F.count("*").alias("n"))
    rows = df.join(counts, "benchmark").select("benchmark", "row_idx", stats.fold_of(F.col("row_idx"), F.col("n"), 3).alias("fold")).collect()
    want = {(b, int(i)): k for b, n in sizes.items() for k, part in enumerate(np.array_split(np.arange(n), 3)) for i in part}
    assert {(r.benchmark, r.row_idx): r.fold for r in rows} == want
