"""A transformer over numerical features, in NumPy: a tape of operations, the network, its training and attention maps.

A feature is a token x_j W_j + b_j, behind a class token. Blocks add attention and a feed-forward layer to their input,
each behind a layer norm (but for the first block's attention); the class token goes through a norm, ReLU and a line.
Training is that of ``networks``; prediction runs in batches on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import vector
from .models import Regressor, register
from .networks import Network, train_whole, trained

ATTENTION_ROWS = 1024


class Var:
    """A value on the tape and how its gradient is passed on."""

    def __init__(self, value: np.ndarray, parents: Sequence[tuple[Var, Callable[[np.ndarray], np.ndarray]]] = ()) -> None:
        self.value, self.parents, self.grad = value, parents, None

    def __add__(self, o: Var) -> Var:
        return Var(self.value + o.value, [(self, lambda g: _fold(g, self.value.shape)), (o, lambda g: _fold(g, o.value.shape))])

    def __mul__(self, o: Var | np.ndarray | float) -> Var:
        if not isinstance(o, Var):
            return Var(self.value * o, [(self, lambda g: g * o)])
        return Var(self.value * o.value, [(self, lambda g: _fold(g * o.value, self.value.shape)), (o, lambda g: _fold(g * self.value, o.value.shape))])

    def __matmul__(self, o: Var) -> Var:
        t = lambda v: np.swapaxes(v, -1, -2)
        if o.value.ndim == 2:  # one product of all rows, not one for each row of the batch
            flat = lambda v: v.reshape(-1, v.shape[-1])
            value = (flat(self.value) @ o.value).reshape(*self.value.shape[:-1], -1)
            return Var(value, [(self, lambda g: (flat(g) @ o.value.T).reshape(self.value.shape)), (o, lambda g: flat(self.value).T @ flat(g))])
        return Var(self.value @ o.value, [(self, lambda g: _fold(g @ t(o.value), self.value.shape)), (o, lambda g: _fold(t(self.value) @ g, o.value.shape))])

    def relu(self) -> Var:
        return Var(np.maximum(0, self.value), [(self, lambda g: g * (self.value > 0))])

    def softmax(self) -> Var:
        e = np.exp(self.value - self.value.max(-1, keepdims=True))
        p = e / _last(e)
        return Var(p, [(self, lambda g: p * (g - _last(g * p)))])

    def normed(self) -> Var:
        n = self.value.shape[-1]
        centred = self.value - _last(self.value) / n
        s = np.sqrt(_last(centred**2) / n + 1e-5)
        z = centred / s
        return Var(z, [(self, lambda g: (g - _last(g) / n - z * (_last(g * z) / n)) / s)])

    def reshape(self, *shape: int) -> Var:
        return Var(self.value.reshape(shape), [(self, lambda g: g.reshape(self.value.shape))])

    def transpose(self, *axes: int) -> Var:
        return Var(self.value.transpose(axes), [(self, lambda g: g.transpose(np.argsort(axes)))])

    def __getitem__(self, at: object) -> Var:
        def back(g: np.ndarray) -> np.ndarray:
            whole = np.zeros_like(self.value)
            whole[at] = g
            return whole

        return Var(self.value[at], [(self, back)])

    def backward(self, grad: np.ndarray) -> None:
        order: list[Var] = []
        seen: set[int] = set()
        stack = [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack += [(v, True), *((p, False) for p, _ in v.parents)]
        self.grad = grad
        for v in reversed(order):
            for p, back in v.parents:
                g = back(v.grad)
                p.grad = g if p.grad is None else p.grad + g


def _last(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(*a.shape[:-1], 1)


def _fold(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum a gradient over the axes along which its value was repeated."""
    if g.shape == shape:
        return g
    if len(shape) < g.ndim and shape == g.shape[g.ndim - len(shape) :]:  # repeated as a whole
        return (np.ones(g.size // int(np.prod(shape)), g.dtype) @ g.reshape(-1, int(np.prod(shape)))).reshape(shape)
    g = g.sum(tuple(range(g.ndim - len(shape))))
    return g.sum(tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] > 1), keepdims=True).reshape(shape)


def stacked(first: Var, rest: Var) -> Var:
    """Put a token before the others."""
    n = len(rest.value)
    value = np.concatenate((np.repeat(first.value[None, None], n, 0), rest.value), 1)
    return Var(value, [(first, lambda g: g[:, 0].sum(0)), (rest, lambda g: g[:, 1:])])


class Transformer(Network):
    own_error = True
    lr, wd, noise = 3e-3, 1e-5, 0.0

    def __init__(self, features: int, width: int, blocks: int, heads: int, hidden: int, dropout: float, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        while width % heads:
            heads -= 1
        self.heads, self.blocks, self.width, self.dropout = heads, blocks, width, dropout
        u = lambda *shape: self.rng.uniform(-1, 1, shape) * np.sqrt(3 / shape[0])
        small = lambda *shape: self.rng.uniform(-1, 1, shape) / np.sqrt(width)
        self.w = {"token": small(features, width), "bias": small(features, width), "cls": small(width), "gain": np.ones(width), "shift": np.zeros(width), "out": u(width, 1), "out_b": np.zeros(1)}
        for k in range(blocks):
            self.w |= {f"in{k}": u(width, 3 * width), f"in_b{k}": np.zeros(3 * width), f"proj{k}": u(width, width), f"proj_b{k}": np.zeros(width), f"a{k}": u(width, hidden), f"a_b{k}": np.zeros(hidden), f"b{k}": u(hidden, width), f"b_b{k}": np.zeros(width)}
            self.w |= {f"g1{k}": np.ones(width), f"s1{k}": np.zeros(width), f"g2{k}": np.ones(width), f"s2{k}": np.zeros(width)}

    def forward(self, x: np.ndarray, train: bool = False) -> tuple[Var, dict[str, Var], list[np.ndarray]]:
        """Predictions, the weights on the tape, and each block's attention (rows, heads, tokens, tokens)."""
        p, maps = {k: Var(v) for k, v in self.w.items()}, []
        n, part = len(x), self.width // self.heads
        drop = lambda v: v * ((self.rng.random(v.value.shape) >= self.dropout) / (1 - self.dropout)).astype(v.value.dtype) if train and self.dropout else v
        t = stacked(p["cls"], Var(x[:, :, None]) * p["token"] + p["bias"])
        s = t.value.shape[1]
        for k in range(self.blocks):
            h = t if k == 0 else t.normed() * p[f"g1{k}"] + p[f"s1{k}"]
            qkv = (h @ p[f"in{k}"] + p[f"in_b{k}"]).reshape(n, s, 3, self.heads, part).transpose(2, 0, 3, 1, 4)
            weights = (qkv[0] @ qkv[1].transpose(0, 1, 3, 2) * float(1 / np.sqrt(part))).softmax()
            maps.append(weights.value)
            t = t + drop((weights @ qkv[2]).transpose(0, 2, 1, 3).reshape(n, s, self.width) @ p[f"proj{k}"] + p[f"proj_b{k}"])
            h = t.normed() * p[f"g2{k}"] + p[f"s2{k}"]
            t = t + drop((h @ p[f"a{k}"] + p[f"a_b{k}"]).relu() @ p[f"b{k}"] + p[f"b_b{k}"])
        head = (t[:, 0].normed() * p["gain"] + p["shift"]).relu()
        return (head @ p["out"] + p["out_b"])[:, 0], p, maps

    def predict(self, x: np.ndarray, size: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + size])[0].value for i in range(0, len(x), size)]) if len(x) else np.zeros(0)

    def attention(self, x: np.ndarray) -> np.ndarray:
        """Mean attention between features over rows, blocks and heads."""
        return np.mean([m[:, :, 1:, 1:].mean((0, 1)) for m in self.forward(x)[2]], axis=0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients, of norm one at most together, from rows with noise."""
        out, p, _ = self.forward(x + (self.noise * self.rng.standard_normal(x.shape)).astype(x.dtype) if self.noise else x, True)
        error = out.value - y
        out.backward(2 * error / len(y))
        size = float(np.sqrt(sum((q.grad**2).sum() for q in p.values() if q.grad is not None)))
        return {k: (q.grad if q.grad is not None else np.zeros_like(q.value)) * min(1.0, 1.0 / (size + 1e-6)) for k, q in p.items()}, float((error**2).mean())

    def train(self, x, y, xv, yv, lr: float, wd: float, noise: float = 0.0, epochs: int = 300, batch: int = 256, patience: int = 40) -> list[tuple[int, float, float]]:
        """AdamW with a cosine schedule, input noise, early stopping, the best weights kept."""
        self.lr, self.wd, self.noise = lr, wd, noise
        return train_whole(self, x, y, xv, yv, epochs, batch, patience)


@register("FTTransformer")
class FeatureTransformer(Regressor):
    @staticmethod
    def space() -> dict[str, tuple]:
        return {"d_token": ("choice", [16, 32, 64]), "n_blocks": ("int", 2, 4), "n_heads": ("choice", [2, 4, 8]), "d_ffn": ("choice", [32, 64, 128, 256]), "dropout": ("float", 0.0, 0.3), "lr": ("log", 1e-4, 1e-2), "weight_decay": ("log", 1e-6, 1e-3), "noise": ("float", 0.0, 0.05)}

    def fit(self, train, val, columns, hp):
        self.columns = list(columns)
        seed, p = self.seed, len(columns)

        def make() -> Transformer:
            net = Transformer(p, hp.get("d_token", 16), hp.get("n_blocks", 2), hp.get("n_heads", 4), hp.get("d_ffn", 32), hp.get("dropout", 0.0), seed)
            net.lr, net.wd, net.noise = hp.get("lr", 3e-3), hp.get("weight_decay", 1e-5), hp.get("noise", 0.0)
            return net

        self.net, self.history = net, _ = trained(train, val, columns, make, seed, hp.get("epochs", 300))

        def attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False) for b in batches])
            yield pa.RecordBatch.from_arrays([pa.array([net.attention(z.reshape(-1, p)).tobytes()], pa.binary())], ["maps"])

        first = train.orderBy("split_row_idx").limit(ATTENTION_ROWS).select(vector(columns).alias("z"))
        self.maps = np.frombuffer(first.coalesce(1).mapInArrow(attention, "maps binary").first()[0]).reshape(p, p)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        net = self.net

        @F.pandas_udf("double")
        def of(*parts: pd.Series) -> pd.Series:
            return pd.Series(net.predict(np.column_stack([p.to_numpy(np.float64) for p in parts])))

        return df.withColumn("prediction", of(*[F.col(c) for c in self.columns]))

    def importances(self) -> dict[str, float]:
        return dict(zip(self.columns, np.linalg.norm(self.net.w["token"], axis=1).tolist(), strict=True))

    def interaction(self, df: DataFrame) -> DataFrame:
        """Mean attention between features over the first training rows; none of a feature with itself."""
        rows = [(a, b, float(self.maps[i, j])) for i, a in enumerate(self.columns) for j, b in enumerate(self.columns) if i != j]
        return df.sparkSession.createDataFrame(rows, "feature_i string, feature_j string, weight double")
