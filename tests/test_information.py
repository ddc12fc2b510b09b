import numpy as np
import pytest

from millrace.operators import information


def brute(points, k):
    """d and both counts of each row, from the whole matrix of distances."""
    x, y = points["X"].to_numpy(), points["Y"].to_numpy()
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.partition(np.maximum(dx, dy), k, axis=1)[:, k]
    r = np.maximum(d - 1, 0)[:, None]
    return d, (dx <= r).sum(1), (dy <= r).sum(1)


def odd_columns(n):
    """A normal column, whole numbers, one value for most rows with a rare other, a copy of y, far outliers, one that is y's rounding."""
    rng = np.random.default_rng(8)
    y = np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))
    columns = {"near": 0.5 * y + rng.normal(size=n), "steps": np.round(3 * rng.normal(size=n)), "hot": np.where(np.arange(n) < 2, 7.0, np.where(rng.random(n) < 0.6, 1.0, rng.normal(size=n))),
               "copy": y.copy(), "far": rng.standard_cauchy(n), "coarse": np.sign(y), "flat": np.full(n, 2.0)}
    return y, columns


@pytest.mark.parametrize("tile", [100_000, 90])
def test_tiles_give_exact_distances_and_counts(spark, tile):
    """Cut into tiles or not, distances and counts are those of the whole matrix."""
    y, columns = odd_columns(1500)
    names = [c for c in columns if c != "flat"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(y, *columns.values(), strict=True))], "i bigint, y double, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    told = {j: {"std": v.std(), "low": v.min(), "high": v.max(), "size": np.abs(v).mean()} for j, v in ((-1, y), *enumerate(columns[c] for c in names))}
    told = {j: {a: float(b) for a, b in r.items()} for j, r in told.items()}
    points = information._points(df, names, "y", "i", told, range(len(names)), 42)
    spans = information._distances(points, 3, tile)
    found = {(r.ordinal, r.i): r.d for r in spans.collect()}
    counts = {}
    for r in information._counts(spans).collect():
        counts.setdefault((r.ordinal, r.i), []).append(r.n)
    everything = points.toPandas().sort_values("i")
    for j in range(len(names)):
        d, nx, ny = brute(everything[everything["ordinal"] == j], 3)
        assert [found[j, i] for i in range(len(y))] == d.tolist()
        assert [sorted(counts[j, i]) for i in range(len(y))] == [sorted(p) for p in zip(nx.tolist(), ny.tolist(), strict=True)]


def test_scores_agree_with_arrays_in_memory(spark):
    y, columns = odd_columns(3000)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(y, *columns.values(), strict=True))], "i bigint, y double, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    whole, cut = ({r.feature: r.score for r in information.scores(df, list(columns), "y", "i", tile=t).collect()} for t in (information.TILE, 200))
    assert whole == pytest.approx(cut, abs=1e-9) and whole["flat"] == 0.0
    for c in ("near", "far"):
        assert whole[c] == pytest.approx(information.neighbours_information(columns[c], y), abs=2e-2)  # y's ties fall by noise


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 1.0)], "i int, a double, y double")
    assert [r.score for r in information.scores(df, ["a"], "y", "i").collect()] == [0.0]
    assert [r.score for r in information.scores(df.where("false"), ["a"], "y", "i").collect()] == [0.0]
    with pytest.raises(ValueError, match="finite"):
        information.scores(df.selectExpr("i", "IF(i = 1, NULL, a) AS a", "y"), ["a"], "y", "i")


def test_digamma():
    n = np.arange(1, 3000)
    exact = np.cumsum(np.r_[0.0, 1 / n[:-1]]) - np.euler_gamma
    assert max(abs(information.digamma(float(i)) - e) for i, e in zip(n, exact, strict=True)) < 1e-10
