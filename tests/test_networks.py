"""Networks trained by tasks side by side."""

import numpy as np

from millrace.operators import networks
from millrace.operators.models import REGISTRY, Layers
from millrace.operators.transformer import FeatureTransformer  # noqa: F401  registers itself


def _rows(spark, n, first=0):
    rng = np.random.default_rng(first)
    x = rng.normal(size=(n, 2))
    return spark.createDataFrame([(i, float(a), float(b), float(a - 2 * b)) for i, (a, b) in enumerate(x)], "split_row_idx bigint, a double, b double, y double")


def test_shards_hold_every_row_once(spark):
    rows = _rows(spark, 500)
    z = rows.selectExpr("CASE WHEN split_row_idx % 10 = 9 THEN 1 ELSE 0 END AS part", "split_row_idx", "array(a, b, y) AS z")
    made = networks.packed(z, 7, 2).collect()
    held = np.concatenate([np.frombuffer(r["data"]).reshape(-1, 3) for r in made])
    assert len(made) == 7 and sum(r["n"] for r in made) == 450
    whole = np.array([(r["a"], r["b"], r["y"]) for r in rows.collect()])
    assert np.array_equal(held[np.lexsort(held.T)], whole[np.lexsort(whole.T)])


def test_networks_beyond_one_shard_learn_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(networks, "SHARD", 400)
    train, val = _rows(spark, 1200), _rows(spark, 300, 1)
    for name, epochs in (("MLP", 60), ("FTTransformer", 25)):
        model = REGISTRY[name]().fit(train, val, ["a", "b"], {"epochs": epochs, "lr": 1e-2})
        assert [h[0] for h in model.history] == list(range(1, epochs + 1))
        error = model.predict(val).selectExpr("avg(pow(prediction - y, 2)) AS e", "var_pop(y) AS v").first()
        assert error["e"] < 0.1 * error["v"]
        assert np.isclose(error["e"], min(h[2] for h in model.history), rtol=1e-3)  # the best weights, and their error over all validation rows


def test_shards_without_validation_rows(spark, monkeypatch):
    monkeypatch.setattr(networks, "SHARD", 50)
    train = _rows(spark, 120)
    net, history = networks.trained(train, train.limit(0), ["a", "b"], lambda: Layers(2, 4, 3, 0.0, 1e-2, 0.0, 1), 1, epochs=3)
    assert len(history) == 3 and np.isnan(history[-1][2]) and np.isfinite(net.flat()).all()
