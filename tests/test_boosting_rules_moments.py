import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import boosting, frame, models, moments, rules, stats


def table(spark, x, y, start=0, names=None):
    names = names or [f"c{j}" for j in range(x.shape[1])]
    rows = [(start + i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "split_row_idx bigint, " + ", ".join(f"`{c}` double" for c in names) + ", y double")


def plain_tree(bins, g, depth, rate, leaves=None):
    """Level by level with a loop over every node, feature and bin: (each row's value, the splits)."""
    nodes, value, splits, room = [np.arange(len(g))], np.zeros(len(g)), [], (leaves or 10**9) - 1
    value[:] = -rate * g.sum() / (len(g) + 1)
    for _ in range(depth):
        tried = []
        for rows in nodes:
            best = (1e-12, None)
            for f in range(len(bins)):
                for k in range(255):
                    left = rows[bins[f, rows] <= k]
                    if 1 <= len(left) < len(rows):
                        gl, G, hl, H = g[left].sum(), g[rows].sum(), len(left), len(rows)
                        gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, k))
            if best[1]:
                tried.append((best, rows))
        nodes = []
        for (gain, (f, k)), rows in sorted(tried, key=lambda t: -t[0][0])[: max(0, room)]:
            room -= 1
            splits.append((gain, f, k))
            for part in (rows[bins[f, rows] <= k], rows[bins[f, rows] > k]):
                value[part] = -rate * g[part].sum() / (len(part) + 1)
                nodes.append(part)
    return value, splits


@pytest.mark.parametrize("leaves", [None, [3, 5, 4]])
def test_boosting_is_a_plain_loop(spark, leaves):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(260, 3)), 1)
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2]
    train, val = table(spark, x[:200], y[:200]).repartition(3), table(spark, x[200:], y[200:], 200)
    made = boosting.boost(train, val, ["c0", "c1", "c2"], 3, 3, 0.5, leaves=leaves, patience=None)
    edges = boosting.edges_of(train, ["c0", "c1", "c2"])
    bins = np.stack([np.searchsorted(e, x[:200, j], "left") for j, e in enumerate(edges)])
    f = np.full(200, y[:200].mean())
    for t, tree in enumerate(made.trees):
        value, splits = plain_tree(bins, f - y[:200], 3, 0.5, leaves and leaves[t])
        assert np.allclose(sorted(g for g, _, _ in splits), sorted(tree.gain[tree.feature >= 0]))
        f += value
        assert made.history[t][1] == pytest.approx(((f - y[:200]) ** 2).mean())
    assert np.allclose(made.predict(x[:200]), f)


def test_boosting_patience_keeps_the_best(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = x[:, 0] + rng.normal(size=300)
    train, val = table(spark, x[:150], y[:150]), table(spark, x[150:], y[150:], 150)
    made = boosting.boost(train, val, ["c0", "c1", "c2", "c3"], 60, 3, 0.5, patience=6)
    losses = [v for _, _, v in made.history]
    assert len(made.history) == made.best + 6 < 60 and made.best == len(made.trees) == int(np.argmin(losses)) + 1
    assert ((made.predict(x[150:]) - y[150:]) ** 2).mean() == pytest.approx(min(losses))
    # A rise shorter than the patience ends nothing, and a whole fit gives the same trees.
    whole = boosting.boost(train, val, ["c0", "c1", "c2", "c3"], made.best, 3, 0.5, patience=None)
    assert np.allclose(whole.predict(x), made.predict(x))


def test_boosting_samples_don_t_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 20))
    y = x[:, 0] * x[:, 1]
    train, none = table(spark, x, y), table(spark, x, y).where("false")
    names, kw = [f"c{j}" for j in range(20)], dict(subsample=0.6, colsample=0.5, parallel=2, leaves=[4, 5, 3, 6])
    one, two = (boosting.boost(d, none, names, 4, 3, 0.3, **kw) for d in (train, train.repartition(7)))
    assert np.allclose(one.predict(x), two.predict(x)) and len(one.trees) == 4
    assert [(t.feature >= 0).sum() + 1 for t in one.trees] == [4, 5, 3, 6] or all((t.feature >= 0).sum() < k for t, k in zip(one.trees, (4, 5, 3, 6), strict=True))
    share = boosting.chosen_rows(np.arange(100_000), 5, 0.3)
    assert abs(share.mean() - 0.3) < 0.01 and 0.07 < (share & boosting.chosen_rows(np.arange(100_000), 6, 0.3)).mean() < 0.11


def test_boosting_of_exchanged_sums(spark, monkeypatch):
    """Many blocks, groups of features and rewritten blocks give what one block gives."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 9))
    y = x[:, 0] * x[:, 1] + x[:, 8]
    train, val, names = table(spark, x[:600], y[:600]).repartition(5), table(spark, x[600:], y[600:], 600), [f"c{j}" for j in range(9)]
    one = boosting.boost(train, val, names, 6, 3, 0.3)
    for name, v in (("BLOCK_BYTES", 900), ("GROUP", 2), ("PENDING", 2)):
        monkeypatch.setattr(boosting, name, v)
    two = boosting.boost(train, val, names, 6, 3, 0.3)
    assert np.allclose(one.predict(x), two.predict(x)) and np.allclose(one.history, two.history)


def test_rule_grams_are_those_of_dense_indicators(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(331, 3))
    df = table(spark, x, x[:, 0] + rng.normal(size=331)).repartition(3)
    names = ["c0", "c1", "c2"]
    some = [f"c{j} {op} {v!r}" for j in range(3) for op in ("<=", ">") for v in (-0.5, 0.1, 0.8)]
    some += [f"{a} & {b}" for a, b in zip(some, some[5:], strict=False)]
    fold = stats.fold_of(F.col("split_row_idx"), 331, 3)
    found = rules.rule_grams(df, names, [2.0, 0.5, 1.0], some, fold)
    wide = rules.indicators(df, some, "r").withColumns({"c0": F.col("c0") * 2.0, "c1": F.col("c1") * 0.5})
    want = stats.fold_grams(wide, [*names, *[f"r{i}" for i in range(len(some))]], "y", fold)
    assert found.keys() == want.keys()
    for k, g in want.items():
        assert g.n == found[k].n and np.allclose(g.products, found[k].products) and np.allclose(g.sums, found[k].sums)


def test_tree_rules_and_many_terms(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4))
    df = table(spark, x, 2 * (x[:, 0] > 0.2) * (x[:, 1] <= 0.5) + x[:, 2])
    model = models.RuleFit(1, intercept=True).fit(df.where("split_row_idx < 400"), df.where("split_row_idx >= 400"), ["c0", "c1", "c2", "c3"], {"max_rules": 60, "tree_size": 3, "memory_par": 0.1})
    assert 20 < len(model.rules) <= 60
    got = [r.prediction for r in model.predict(df).orderBy("split_row_idx").collect()]
    holds = lambda t: (lambda c, op, v: x[:, int(c[1:])] <= float(v) if op == "<=" else x[:, int(c[1:])] > float(v))(*t.split())
    want = x @ model.linear + model.a + sum(w * np.all([holds(t) for t in r.split(" & ")], axis=0) for r, w in zip(model.rules, model.w, strict=True))
    assert np.allclose(got, want) and np.corrcoef(got[400:], np.array([r.y for r in df.orderBy("split_row_idx").collect()])[400:])[0, 1] > 0.97
    # 4,000 rules predict, as do 4,000 columns.
    model.rules, model.w = [f"c{i % 4} <= {i / 1000!r}" for i in range(4000)], np.ones(4000)
    assert model.predict(df.limit(5)).select("prediction").count() == 5
    got = {r.split_row_idx: r.prediction for r in model.predict(df.limit(5)).collect()}
    assert all(np.isclose(v, x[i] @ model.linear + model.a + sum(x[i, k % 4] <= k / 1000 for k in range(4000))) for i, v in got.items())
    wide = spark.range(3).select(*[(F.col("id") + i).cast("double").alias(f"c{i}") for i in range(4000)])
    linear = models.ElasticNet()
    linear.columns, linear.w, linear.a = wide.columns, np.ones(4000), 1.0
    assert sorted(r.prediction for r in linear.predict(wide).select("prediction").collect()) == [1 + 4000 * i + 3999 * 2000 for i in range(3)]


def test_moments(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 6)) * [1, 1e6, 1e-6, 1, 1, 0] + [0, 1e9, 0, 5, 0, 3]
    y = x[:, 0] - x[:, 3] + rng.normal(size=500)
    rows = [[float(v) for v in r] + [float(t)] for r, t in zip(x, y, strict=True)]
    for i in range(0, 500, 7):
        rows[i][3] = None
    for i in range(0, 500, 11):
        rows[i][6] = None
    rows[5][4], rows[6][4], rows[9][4] = float("nan"), float("inf"), None
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{j} double" for j in range(6)) + ", y double").repartition(5)
    found = {r.feature: r for r in moments.moments(df, [f"c{j}" for j in range(6)], "y").collect()}
    for j in (0, 1, 2, 3, 5):
        own = np.array([r[j] for r in rows if r[j] is not None])
        both = np.array([(r[j], r[6]) for r in rows if r[j] is not None and r[6] is not None])
        r = found[f"c{j}"]
        assert (r.n, r.n_both, r.n_null, r.min, r.max) == (len(own), len(both), 500 - len(own), own.min(), own.max())
        assert np.isclose(r["mean"], own.mean(), rtol=1e-12) and np.isclose(r.m2, ((own - own.mean()) ** 2).sum(), rtol=1e-9)
        assert np.isclose(r.co, ((both - both.mean(0)).prod(1)).sum(), rtol=1e-8, atol=1e-7)
    r = found["c4"]
    assert (r.n_nan, r.n_inf, r.n_null) == (1, 1, 1) and np.isnan(r["mean"])
    assert [r.n for r in moments.moments(df.where("false"), ["c0", "c1"]).collect()] == [0, 0] and moments.moments(df, []).count() == 0
    flat = {r.feature: r.is_constant for r in frame.constant_columns(df.withColumn("none", F.lit(None).cast("double")), ["c0", "c5", "none"]).collect()}
    assert flat == {"c0": False, "c5": True, "none": None}


def test_scores_of_many_columns(spark):
    rng = np.random.default_rng(8)
    p, n = 5000, 60
    x = rng.normal(size=(n, p))
    df = spark.createDataFrame([(r.tolist(), float(r[17])) for r in x], "v array<double>, y double")
    wide = df.selectExpr(*[f"v[{j}] as c{j}" for j in range(p)], "y")
    found = stats.top_k(stats.column_scores(wide, [f"c{j}" for j in range(p)], "pearson"), 2).collect()
    others = np.abs(np.corrcoef(x.T)[17])
    others[17] = 0
    assert found[0].feature == "c17" and found[1].feature == f"c{others.argmax()}" and np.isclose(found[1].score, others.max())


def test_window_wider_than_a_split(spark):
    rows = spark.createDataFrame([("train", i, float(i)) for i in range(20)] + [("val", i, 1.0) for i in range(3)], "split string, split_row_idx bigint, v double")
    assert frame.window_mean(rows.where("split = 'train'"), ["v"], 8).count() == 2 and frame.window_mean(rows.where("false"), ["v"], 8).count() == 0
    with pytest.raises(Exception, match="wider than"):
        frame.window_mean(rows, ["v"], 8).collect()


def test_gram_of_tiles(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 13))
    df, names = table(spark, x, x[:, 0] + 1).repartition(3), [f"c{j}" for j in range(13)]
    fold = stats.fold_of(F.col("split_row_idx"), 700, 3)
    want = stats.fold_grams(df, names, "y", fold)
    monkeypatch.setattr(stats, "TILE", 4)
    for found in (stats.fold_grams(df, names, "y", fold), stats.tiled_grams(df, names, "y", fold, 5)):
        assert found.keys() == want.keys()
        for k, g in want.items():
            assert g.n == found[k].n and np.allclose(g.sums, found[k].sums) and np.allclose(g.products, found[k].products)
    assert stats.tiled_grams(df.where("false"), names) == {}


def test_gram_of_ten_thousand_columns(spark):
    """Ten thousand columns: each task holds a tile of 8 MB and a block of 512 rows."""
    p, n = 10_000, 64
    df = spark.range(n).select(F.lit(0).alias("fold"), F.expr(f"transform(sequence(0, {p - 1}), j -> (cast((id * 7919 + j * 104729) % 1009 as double) - 504) / 100)").alias("v"))
    z = df.select("fold", F.concat("v", F.array(F.col("v")[0] * 2, F.lit(1.0))).alias("z"))
    x = (np.arange(n)[:, None] * 7919 + np.arange(p) * 104729) % 1009 / 100 - 5.04
    want, seen = np.column_stack((x, 2 * x[:, 0], np.ones(n))), 0
    for r in stats.vector_tiles(z, p + 2, shares=1).where("i = j or i = 0").toLocalIterator():
        a, b = r["i"] * stats.TILE, r["j"] * stats.TILE
        t = np.frombuffer(r["tile"]).reshape(min(stats.TILE, p + 2 - a), -1)
        assert np.allclose(t, want[:, a : a + len(t)].T @ want[:, b : b + t.shape[1]], atol=1e-8)
        seen += 1
    assert seen == 19
