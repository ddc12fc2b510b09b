"""Training of networks: AdamW with a cosine schedule and early stopping, in one task for few rows, else by tasks side by side.

Beyond ``SHARD`` training rows, rows are dealt by their index into shards of about that many, whose number depends on the rows only. In each
epoch, every shard takes the steps of an epoch over its own rows from the same weights and moments, and these are averaged, weighted by
rows; tasks add up what their shards made, so the driver gets the weights and moments once a task. The validation rows lie with the
shards: their error comes with the next epoch's pass. Every row is used in every epoch; shards work in single precision.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cluster import checkpointed
from ..functions.scalar import vector

#: Training rows of a shard, about, and numbers that a shard may have.
SHARD = 16_384
SHARD_VALUES = 50_000_000
LEAST_GAIN = 1e-7


class Network:
    """Weights ``w`` by key (a list or a dict), ``rng``, learning rate ``lr`` and weight decay ``wd``."""

    #: Whether the training rows' error counts where there are no validation rows; else all epochs run, and the last weights stay.
    own_error = False
    rng: np.random.Generator
    lr: float
    wd: float

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict | list, float]:
        """Gradients by key, and the rows' mean squared error."""
        raise NotImplementedError

    def predict(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def keys(self) -> list:
        return list(self.w) if isinstance(self.w, dict) else list(range(len(self.w)))

    def start(self) -> None:
        self.m, self.v = ({k: np.zeros_like(self.w[k]) for k in self.keys()} for _ in range(2))
        self.t = 0

    def epoch(self, x: np.ndarray, y: np.ndarray, rate: float, batch: int = 256) -> list[float]:
        """One pass over the rows in random order; the batches' errors."""
        order, losses = self.rng.permutation(len(x)), []
        for at in range(0, len(x), batch):
            grads, loss = self.gradients(x[order[at : at + batch]], y[order[at : at + batch]])
            losses.append(loss)
            self.t += 1
            first, second = 1 - 0.9**self.t, 1 - 0.999**self.t
            for k in self.keys():
                g = grads[k]
                self.m[k] = 0.9 * self.m[k] + 0.1 * g
                self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
                self.w[k] = self.w[k] * (1 - rate * self.wd) - rate * (self.m[k] / first) / (np.sqrt(self.v[k] / second) + 1e-8)
        return losses

    def copied(self) -> list | dict:
        return {k: self.w[k].copy() for k in self.keys()} if isinstance(self.w, dict) else [w.copy() for w in self.w]

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(s[k]) for s in (self.w, self.m, self.v) for k in self.keys()]).astype(np.float64)

    def set(self, flat: np.ndarray, kind: type = np.float64) -> None:
        """Weights and moments from one vector."""
        at = 0
        for s in (self.w, self.m, self.v):
            for k in self.keys():
                n = s[k].size
                s[k] = flat[at : at + n].reshape(s[k].shape).astype(kind)
                at += n


class Stopping:
    """Keeps the weights of the least error; ``met`` says when patience has run out."""

    def __init__(self, patience: int) -> None:
        self.patience, self.least, self.since, self.kept = patience, np.inf, 0, None

    def met(self, loss: float, weights: Callable[[], list | dict]) -> bool:
        self.since += 1
        if loss < self.least - LEAST_GAIN:
            self.least, self.since, self.kept = loss, 0, weights()
            return False
        return self.since >= self.patience


def cosine(lr: float, epoch: int, epochs: int) -> float:
    return float(lr * (1 + np.cos(np.pi * epoch / epochs)) / 2)


def train_whole(net: Network, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, epochs: int = 300, batch: int = 256, patience: int = 40) -> list[tuple[int, float, float]]:
    """Train on rows in memory; (epoch, training error, validation error)."""
    if not len(xv) and net.own_error:
        xv, yv = x, y
    stopping, history = Stopping(patience), []
    net.start()
    for epoch in range(epochs):
        losses = net.epoch(x, y, cosine(net.lr, epoch, epochs), batch)
        loss = float(((net.predict(xv) - yv) ** 2).mean()) if len(xv) else float("nan")
        history.append((epoch + 1, float(np.mean(losses)), loss))
        if len(xv) and stopping.met(loss, net.copied):
            break
    net.w = stopping.kept or net.w
    return history


_PACKED = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def keep_memory() -> None:
    """Freed memory stays with the worker (glibc): a step's arrays come and go, and getting their pages anew takes half of its time."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    mallopt(-1, 256 << 20)  # what may lie free at the heap's end
    mallopt(-3, 32 << 20)  # arrays below this come from the heap


def packed(rows: DataFrame, shards: int, p: int) -> DataFrame:
    """A row for each shard: its number of training rows, and all of its rows, training rows first, in order."""

    def work(t: pa.Table) -> pa.Table:
        part, at = t["part"].to_numpy(), t["split_row_idx"].to_numpy()
        z = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["z"].chunks]).reshape(-1, p + 1)
        z = z[np.lexsort((at, part))]
        return pa.Table.from_pydict({"shard": t["shard"][:1], "n": [int((part == 0).sum())], "data": [z.tobytes()]}, schema=_PACKED)

    dealt = rows.withColumn("shard", F.pmod(F.col("split_row_idx"), F.lit(shards)).cast("bigint"))
    return dealt.groupBy("shard").applyInArrow(work, "shard bigint, n bigint, data binary")


def train_dealt(rows: DataFrame, shards: int, p: int, net: Network, seed: int, epochs: int, patience: int) -> list[tuple[int, float, float]]:
    """Train by shards, with the weights averaged after each epoch."""
    sc = rows.sparkSession.sparkContext
    blocks = checkpointed(packed(rows, shards, p)).repartitionByRange(min(shards, max(1, sc.defaultParallelism)), "shard").persist()
    stopping, history, losses = Stopping(patience), [], None
    net.start()

    def passed(epoch: int, rate: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(mean weights and moments, (training error, batches, validation error, its rows)); the validation rows' are of the weights before. Without a rate, no steps."""
        sent = pickle.dumps(net)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_memory()
            total, seen = 0.0, np.zeros(5)
            for b in batches:
                for shard, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    z = np.frombuffer(data.as_buffer()).reshape(-1, p + 1).astype(np.float32)
                    own: Network = pickle.loads(sent)
                    own.set(own.flat(), np.float32)
                    own.rng = np.random.default_rng((seed, epoch, shard))
                    check = z[n:] if len(z) > n or not own.own_error else z
                    if len(check) and (epoch or rate is None):
                        seen[2:4] += ((own.predict(check[:, :-1]) - check[:, -1]).astype(np.float64) ** 2).sum(), len(check)
                    if rate is not None and n:
                        made = own.epoch(z[:n, :-1], z[:n, -1], rate)
                        total = total + own.flat() * n
                        seen += sum(made), len(made), 0, 0, n
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, np.float64).tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], ["flat", "seen"])

        total, seen = 0.0, np.zeros(5)
        for r in blocks.mapInArrow(task, "flat binary, seen binary").collect():  # a row for each task
            one = np.frombuffer(r["seen"])
            seen = seen + one
            if one[4]:
                total = total + np.frombuffer(r["flat"])
        return (total / seen[4] if seen[4] else total), seen

    try:
        for epoch in range(epochs + 1):
            last = epoch == epochs
            flat, seen = passed(epoch, None if last else cosine(net.lr, epoch, epochs))
            if epoch:
                loss = float(seen[2] / seen[3]) if seen[3] else float("nan")
                history.append((epoch, losses, loss))
                if seen[3] and stopping.met(loss, net.copied):
                    break
            if not last:
                losses = float(seen[0] / seen[1])
                steps = max(1, round(seen[1] / shards))
                net.set(flat)
                net.t += steps
    finally:
        blocks.unpersist()
    net.w = stopping.kept or net.w
    return history


def trained(train: DataFrame, val: DataFrame, columns: Sequence[str], make: Callable[[], Network], seed: int, epochs: int = 300, patience: int = 40) -> tuple[Network, list[tuple[int, float, float]]]:
    """A network trained on all rows, and its errors by epoch; only weights and errors come to the driver."""
    rows = train.select(F.lit(0).alias("part"), "split_row_idx", *columns, "y").unionByName(val.select(F.lit(1).alias("part"), "split_row_idx", *columns, "y"))
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # two rows
    if not sizes.get(0):
        raise ValueError("a network needs training rows")
    p = len(columns)
    rows = rows.select("part", "split_row_idx", vector([*columns, "y"]).alias("z"))
    shards = max(-(-sizes[0] // SHARD), -(-sum(sizes.values()) * (p + 1) // SHARD_VALUES))
    if shards > 1:
        net = make()
        return net, train_dealt(rows, shards, p, net, seed, epochs, patience)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            keep_memory()
            t = pa.Table.from_batches(parts)
            part, at = t["part"].to_numpy(), t["split_row_idx"].to_numpy()
            z = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in parts]).reshape(len(part), -1)
            z, cut = z[np.lexsort((at, part))], int((part == 0).sum())
            net = make()
            history = train_whole(net, z[:cut, :-1], z[:cut, -1], z[cut:, :-1], z[cut:, -1], epochs, patience=patience)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net, history))], pa.binary())], ["made"])

    return pickle.loads(rows.repartition(1).mapInArrow(task, "made binary").collect()[0][0])
