"""Regressors behind one interface. Predictions are in the scaled target's units."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import vector
from . import boosting, frame, rules, solvers, trees
from .networks import Network, trained
from .stats import Gram, fold_grams, fold_of

REGISTRY: dict[str, type[Regressor]] = {}
#: Training rows that interactions of boosted trees are averaged over; the feature is such a sample.
INTERACTION_ROWS = 500


def register(name: str) -> Callable[[type], type]:
    def add(kind: type) -> type:
        REGISTRY[name] = kind
        kind.name = name
        return kind

    return add


class Regressor:
    """fit(train, val, columns), predict(df) adds a prediction; importance and interaction are tables, or None."""

    name = ""

    def __init__(self, seed: int = 42, intercept: bool = False, non_negative: bool = False) -> None:
        self.seed, self.intercept, self.non_negative = seed, intercept, non_negative
        self.history: list[tuple[int, float, float]] = []

    @staticmethod
    def space() -> dict[str, tuple]:
        """Hyper-parameters: ("choice", values), ("int", low, high), ("float", low, high) or ("log", low, high)."""
        return {}

    def fit(self, train: DataFrame, val: DataFrame, columns: Sequence[str], hp: dict) -> Regressor:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def importances(self) -> dict[str, float]:
        raise NotImplementedError

    def importance(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame([(k, float(v)) for k, v in self.importances().items()], "feature string, importance double")

    def interaction(self, df: DataFrame) -> DataFrame | None:
        return None

    def convergence(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.history, "iteration int, train_loss double, val_loss double")


def by_rows(df: DataFrame, columns: Sequence[str], of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Add the prediction of each row's vector, in Arrow batches; the plan doesn't grow with the columns' or terms' number."""

    @F.arrow_udf("double")
    def predicted(v: pa.Array) -> pa.Array:
        return pa.array(of(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)), pa.float64())

    return df.withColumn("prediction", predicted(vector(columns)))


@register("ElasticNetCV")
class ElasticNet(Regressor):
    @staticmethod
    def space() -> dict[str, tuple]:
        return {"n_alphas": ("choice", [10, 20, 50]), "l1_ratio": ("choice", [0.1, 0.3, 0.5, 0.7, 0.9])}

    def fit(self, train, val, columns, hp):
        ratios = hp.get("l1_ratio", 0.5)
        folds = fold_grams(train, columns, "y", fold_of(F.col("split_row_idx"), train.count(), hp.get("cv", 5)))
        self.columns = list(columns)
        self.w, self.a, self.alpha, self.l1 = solvers.elastic_net_cv(folds, ratios if isinstance(ratios, (list, tuple)) else [ratios], hp.get("n_alphas", 20), self.non_negative, self.intercept)
        return self

    def predict(self, df):
        w, a = self.w, self.a
        return by_rows(df, self.columns, lambda x: x @ w + a)

    def importances(self):
        return dict(zip(self.columns, np.abs(self.w).tolist(), strict=True))


@register("GBDT")
class BoostedTrees(Regressor):
    @staticmethod
    def space() -> dict[str, tuple]:
        return {"n_estimators": ("int", 100, 1500), "max_depth": ("int", 3, 8), "learning_rate": ("log", 1e-3, 0.3), "subsample": ("float", 0.6, 1.0), "colsample_bytree": ("float", 0.6, 1.0)}

    def fit(self, train, val, columns, hp):
        """Trees are added until the validation rows' error hasn't fallen for 30 of them; those up to the best one count."""
        self.columns = list(columns)
        self.model = boosting.boost(train, val, columns, hp.get("n_estimators", 1500), hp.get("max_depth", 4), hp.get("learning_rate", 0.1), hp.get("subsample", 1.0), hp.get("colsample_bytree", 1.0), self.seed, hp.get("early_stopping_rounds", 30))
        self.history = self.model.history
        self.sample = frame.sampled(train, INTERACTION_ROWS, self.seed, ["split_row_idx"]).select(*columns)
        return self

    def predict(self, df):
        return by_rows(df, self.columns, self.model.predict)

    def importances(self):
        return dict(zip(self.columns, self.model.gains().tolist(), strict=True))

    def interaction(self, df):
        """Mean absolute Shapley interaction over a seeded sample of the training rows."""
        return trees.interactions(self.sample, self.columns, trees.leaves(self.model))


def tree_rules(grown: Sequence[boosting.Tree], columns: Sequence[str]) -> list[str]:
    """Every branch of trees as a conjunction of thresholds, equal ones once."""
    found: list[str] = []
    for t in grown:
        path = {0: []}
        for node in range(len(t.feature)):  # parents come before their children
            if t.feature[node] >= 0:
                name, cut = columns[t.feature[node]], float(t.threshold[node])
                for child, op in ((t.left[node], "<="), (t.right[node], ">")):
                    path[int(child)] = [*path[node], f"{name} {op} {cut!r}"]
                    found.append(" & ".join(path[int(child)]))
    return list(dict.fromkeys(found))


@register("RuleFit")
class RuleFit(Regressor):
    @staticmethod
    def space() -> dict[str, tuple]:
        return {"tree_size": ("int", 2, 5), "max_rules": ("choice", [500, 1000, 2000, 4000]), "memory_par": ("log", 1e-3, 1e-1)}

    def fit(self, train, val, columns, hp):
        """Small trees on row samples, each tree's number of leaves drawn about ``tree_size``; all their branches, and the columns themselves, as terms of a lasso.

        A column's term has the weight of a rule of typical support: it is scaled by 0.4 over its deviation.
        """
        size, limit = hp.get("tree_size", 4), hp.get("max_rules", 2000)
        n = train.count()
        rng = np.random.default_rng(self.seed)
        grown = -(-limit // size)
        leaves = (2 + np.floor(rng.exponential(max(size - 2, 0), grown))).astype(int).tolist()
        share = min(0.5, (100 + 6 * np.sqrt(n)) / n)
        deepest = max(1, int(np.ceil(np.log2(max(leaves)))) + 1)
        made = boosting.boost(train, val, columns, grown, deepest, hp.get("memory_par", 0.01), share, 1.0, self.seed, None, leaves, parallel=8)
        found = tree_rules(made.trees, columns)[:limit]
        self.columns, self.history = list(columns), made.history
        std = {r["feature"]: r["std"] for r in frame.fit_scaler(train, columns).collect()}
        scales = [0.4 / std[c] for c in columns]
        folds = rules.rule_grams(train, columns, scales, found, fold_of(F.col("split_row_idx"), n, 3))
        # Rules that hold everywhere or nowhere say nothing.
        p, total = len(columns), sum(folds.values(), Gram(0.0, 0.0, 0.0))
        support = total.sums[p:-1] / total.n
        kept = np.flatnonzero((support > 0) & (support < 1))
        at = np.concatenate((np.arange(p), p + kept))
        w, self.a, *_ = solvers.elastic_net_cv({k: g.only(at) for k, g in folds.items()}, [1.0], 100, self.non_negative, self.intercept)
        self.rules, self.support = [found[i] for i in kept], support[kept].tolist()
        self.linear, self.w = w[:p] * scales, w[p:]
        return self

    def predict(self, df):
        live = np.flatnonzero(self.w)
        maps, linear, w, a = rules.Bitmaps([self.rules[i] for i in live], self.columns), self.linear, self.w[live], self.a

        def of(x: np.ndarray) -> np.ndarray:
            held = np.unpackbits(maps.of(x).view(np.uint8), axis=1, count=len(x), bitorder="little") if len(w) and len(x) else np.zeros((len(w), len(x)))
            return x @ linear + w @ held + a

        return by_rows(df, self.columns, of)

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(c, "linear", float(v), 1.0) for c, v in zip(self.columns, self.linear, strict=True)]
        rows += [(r, "rule", float(v), float(s)) for r, v, s in zip(self.rules, self.w, self.support, strict=True)]
        return df.sparkSession.createDataFrame(rows, "rule string, type string, coef double, support double")

    def importance(self, df):
        return rules.importance(self.table(df), self.columns)

    def interaction(self, df):
        return rules.cooccurrence(self.table(df), self.columns)


class Layers(Network):
    """Two hidden layers of ReLU with dropout, AdamW, a cosine schedule, early stopping and the best weights kept."""

    def __init__(self, p: int, h1: int, h2: int, dropout: float, lr: float, wd: float, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        sizes = [p, h1, h2, 1]
        self.w = [x for a, b in zip(sizes, sizes[1:], strict=False) for x in (self.rng.uniform(-1, 1, (a, b)) / np.sqrt(a), self.rng.uniform(-1, 1, b) / np.sqrt(a))]
        self.dropout, self.lr, self.wd = dropout, lr, wd

    def forward(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, list]:
        kept, h = [x], x
        for i in (0, 2):
            h = np.maximum(0, h @ self.w[i] + self.w[i + 1])
            mask = ((self.rng.random(h.shape) >= self.dropout) / (1 - self.dropout)).astype(h.dtype) if train and self.dropout else 1.0
            kept.append((h, mask))
            h = h * mask
        return (h @ self.w[4] + self.w[5])[:, 0], kept

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        out, (x0, (h1, m1), (h2, m2)) = self.forward(x, True)
        g = (2 * (out - y) / len(y))[:, None]
        d2 = (g @ self.w[4].T) * m2 * (h2 > 0)
        d1 = (d2 @ self.w[2].T) * m1 * (h1 > 0)
        return [x0.T @ d1, d1.sum(0), (h1 * m1).T @ d2, d2.sum(0), (h2 * m2).T @ g, g.sum(0)], float(((out - y) ** 2).mean())

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0]


@register("MLP")
class Perceptron(Regressor):
    @staticmethod
    def space() -> dict[str, tuple]:
        return {"hidden1": ("choice", [64, 128, 256, 512]), "hidden2": ("choice", [32, 64, 128, 256]), "dropout": ("float", 0.0, 0.3), "lr": ("log", 1e-4, 1e-2), "weight_decay": ("log", 1e-6, 1e-3)}

    def fit(self, train, val, columns, hp):
        self.columns = list(columns)
        seed, p = self.seed, len(columns)

        def make() -> Layers:
            return Layers(p, hp.get("hidden1", 64), hp.get("hidden2", 32), hp.get("dropout", 0.1), hp.get("lr", 3e-3), hp.get("weight_decay", 1e-5), seed)

        self.net, self.history = trained(train, val, columns, make, seed, hp.get("epochs", 300))
        return self

    def predict(self, df):
        net = self.net
        return by_rows(df, self.columns, lambda x: net.forward(x)[0])

    def importances(self):
        return dict(zip(self.columns, np.abs(self.net.w[0]).sum(1).tolist(), strict=True))
