import math
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import frame, models, trees, tune


def plain_interaction(x, leaves, i, j, p):
    """By the definition: every set of the other features, every leaf."""

    def value(known):
        total = 0.0
        for v, path in leaves:
            for f, lo, hi, share in path:
                v *= float(lo < x[f] <= hi) if f in known else share
            total += v
        return total

    rest, total = [f for f in range(p) if f not in (i, j)], 0.0
    for n in range(len(rest) + 1):
        for s in combinations(rest, n):
            w = math.factorial(n) * math.factorial(p - n - 2) / (2 * math.factorial(p - 1))
            total += w * (value({*s, i, j}) - value({*s, i}) - value({*s, j}) + value({*s}))
    return total


def test_tree_interactions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = 3 * x[:, 0] * (x[:, 1] > 0) + x[:, 2]
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "split_row_idx bigint, a double, b double, c double, d double, y double")
    train, val = rows.where("split_row_idx < 240"), rows.where("split_row_idx >= 240")
    model = models.BoostedTrees(1).fit(train, val, names, {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3})
    found = trees.leaves(model.model)
    # The leaves are the model: with all features known they give its predictions.
    sure = [model.model.base + sum(v for v, path in found if all(lo < r[f] <= hi for f, lo, hi, _ in path)) for r in x[:20]]
    want = [r.prediction for r in model.predict(rows.where("split_row_idx < 20")).orderBy("split_row_idx").collect()]
    assert np.allclose(sure, want)
    paths = trees.Paths(found)
    values = lambda rows: dict(zip(paths.pairs, paths.values(rows), strict=True))
    fast = values(x[:10])
    for i, j in combinations(range(4), 2):
        slow = [plain_interaction(r, found, i, j, 4) for r in x[:10]]
        assert np.allclose(fast.get((i, j), np.zeros(10)), slow)
    table = {(r.feature_i, r.feature_j): r.weight for r in model.interaction(rows).collect()}
    whole = values(x[:240])
    assert np.isclose(table["a", "b"], np.abs(whole[0, 1]).mean()) and table["a", "b"] == table["b", "a"] == max(table.values())
    assert not any(a == b for a, b in table)
    # No rows, or no paths of two features: no interactions.
    assert trees.interactions(rows.where("false").select(*names), names, found).count() == 0
    assert trees.interactions(rows.select(*names), names, []).count() == 0


def test_interactions_of_many_deep_trees():
    """1,500 trees of depth 8 on a row sample's part in seconds, some leaves against the definition."""
    rng = np.random.default_rng(1)
    found = []
    for _ in range(1500 * 128):
        path = [(int(f), *sorted(rng.normal(size=2).tolist()), float(rng.uniform(0.2, 0.8))) for f in rng.choice(20, int(rng.integers(2, 9)), replace=False)]
        found.append((float(rng.normal()), path))
    x = rng.normal(size=(16, 20))
    few = found[:40]
    paths = trees.Paths(few)
    values = dict(zip(paths.pairs, paths.values(x[:2]), strict=True))
    for i, j in paths.pairs[:12]:
        own = [leaf for leaf in few if {i, j} <= {f for f, *_ in leaf[1]}]
        assert np.allclose(values[i, j], [sum(plain_of_path(r, leaf, i, j) for leaf in own) for r in x[:2]])
    began = time.perf_counter()
    assert trees.Paths(found).values(x).shape == (190, 16)
    assert time.perf_counter() - began < 90


def plain_of_path(x, leaf, i, j):
    """A leaf's interaction by the definition over the features on its path (others don't count)."""
    features = [f for f, *_ in leaf[1]]
    renamed = [(leaf[0], [(k, *t[1:]) for k, t in enumerate(leaf[1])])]
    return plain_interaction(x[features], renamed, features.index(i), features.index(j), len(features))


def test_sampled_rows(spark):
    rows = spark.range(2000)
    one, two = ({r.id for r in frame.sampled(d, 500, 7, ["id"]).collect()} for d in (rows, rows.repartition(5)))
    assert one == two and len(one) == 500 and one != {r.id for r in frame.sampled(rows, 500, 8, ["id"]).collect()}
    assert frame.sampled(rows.limit(3), 500, 7, ["id"]).count() == 3


def searched(seed, n, guided):
    space = {"x": ("float", -5.0, 5.0), "rate": ("log", 1e-4, 1.0), "k": ("int", 1, 9), "kind": ("choice", ["a", "b", "c"])}
    rng, done = np.random.default_rng(seed), []
    for _ in range(n):
        hp = tune.proposed(space, done if guided else [], rng)
        assert -5 <= hp["x"] <= 5 and 0.99e-4 <= hp["rate"] <= 1.01 and 1 <= hp["k"] <= 9 and isinstance(hp["k"], int)
        score = -((hp["x"] - 2) ** 2) - (math.log10(hp["rate"]) + 2) ** 2 - abs(hp["k"] - 4) / 3 - (hp["kind"] != "b")
        done.append((hp, score if hp["x"] > -4 else float("-inf")))
    return max(s for _, s in done), done


def test_search_learns_from_trials():
    assert searched(5, 30, True)[1] == searched(5, 30, True)[1]
    guided, random = (np.mean([searched(s, 60, g)[0] for s in range(12)]) for g in (True, False))
    assert guided > random


def test_pinned_parameters_stay(spark):
    rows = spark.createDataFrame([("train" if i % 3 else "val", i, float(i), 2.0 * i) for i in range(60)], "split string, split_row_idx bigint, a double, y double")
    _, hp, trials = tune.study("ElasticNetCV", rows.where("split = 'train'"), rows.where("split = 'val'"), ["a"], {"n_alphas": 7}, n_trials=2)
    assert hp["n_alphas"] == 7 and {r.params["n_alphas"] for r in trials.collect()} == {"7"}


def test_parameter_importances(spark):
    made = [("s", {"x": str(i), "kind": "ab"[i % 2], "flat": "1"}, float(i % 2)) for i in range(16)] + [("s", {"x": "1", "kind": "a", "flat": "1"}, float("-inf")), ("one", {"x": "1"}, 1.0), ("same", {"x": "1"}, 1.0), ("same", {"x": "2"}, 1.0)]
    found = {(r.study, r.param): r.importance for r in tune.importances(spark.createDataFrame(made, "study string, params map<string,string>, score double")).collect()}
    assert found == {("s", "kind"): 1.0, ("s", "x"): 0.0, ("s", "flat"): 0.0}


@pytest.mark.parametrize("name", ["MLP", "FTTransformer"])
def test_networks_don_t_depend_on_the_rows_places(spark, name):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([("train" if i % 4 else "val", i, *map(float, v), float(v[0])) for i, v in enumerate(rng.normal(size=(80, 2)))], "split string, split_row_idx bigint, a double, b double, y double")
    hp = {"epochs": 3}
    one, two = (models.REGISTRY[name](3).fit(d.where("split = 'train'"), d.where("split = 'val'"), ["a", "b"], hp) for d in (rows, rows.repartition(7)))
    assert one.history == two.history
    with pytest.raises(ValueError, match="training rows"):
        models.REGISTRY[name](3).fit(rows.where(F.lit(False)), rows.where(F.lit(False)), ["a", "b"], hp)
