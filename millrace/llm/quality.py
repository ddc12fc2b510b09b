"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A token (a word, a run of marks, or a sign for its form: all capitals, a number, the word before again) falls into one
of ``BUCKETS`` by its hash. Each bucket has a sparse ternary index vector; its word vector is the sum of the index
vectors that stand within ``REACH`` tokens of it in the training texts, and its own. A document is the mean of its
tokens' normed word vectors, and the mean of its distinct tokens' vectors. A network of one hidden layer gives a logit,
and a temperature that fits a part of the training rows held back from it makes that a probability.

Training reads the first ``rows`` labelled rows by a hash of id, label and text, whole texts of any length; tokens become
buckets where the rows are read, and one task fits the model. Every text is scored whole. Vectors and weights are of fixed
size. Nulls: a null text is empty and is scored as such; rows whose label or id is null are not learned from. A document
with two labels, or an id that several documents have, gives a training row for each pair of them, all within ``rows``;
rows that are equal in all of it tie, and either is used. With fewer than two classes of labels, all scores are the share
of label 1 (0.5 without labels). Empty tables give no rows; extra columns are kept, one named as the score is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, fitted, kept, out, steps

BUCKETS = 1 << 15
WIDTH = 64
NONZERO = 8
REACH = 2
HIDDEN = 48
EPOCHS = 60
ROWS = 6000
#: Tokens of which a worker keeps the buckets.
CACHE = 100_000
THRESHOLD = 0.3
SEED = 7

_TOKEN = re.compile(r"\w+|[^\w\s]+|\n").findall


def _bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace")) % BUCKETS


def _form(token: str) -> tuple[int, ...]:
    """A token's buckets: of itself in lower case, and of its form."""
    own = [_bucket(token.lower())]
    if len(token) > 1 and token.isupper():
        own.append(_bucket("\0capitals"))
    elif token.isdigit():
        own.append(_bucket("\0number"))
    elif not token[0].isalnum():
        own.append(_bucket(f"\0marks{min(len(token), 4)}"))
    if len(token) > 24:
        own.append(_bucket("\0long"))
    return tuple(own)


_AGAIN = "\0again"


def bucketed(text: str | None) -> np.ndarray:
    """The buckets of a text's tokens, in order."""
    found = _TOKEN(text) if text else []
    forms = kept(("quality",), lambda: Recent(_form, CACHE, 64))
    of, again, made, last = forms.__getitem__, _bucket(_AGAIN), [], None
    for token in found:
        made += of(token)
        if token == last:
            made.append(again)
        last = token
    return np.array(made, np.int32)


def index_vectors(seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    at = rng.integers(0, WIDTH, (BUCKETS, NONZERO))
    signs = rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO))
    v = np.zeros((BUCKETS, WIDTH), np.float32)
    np.add.at(v, (np.arange(BUCKETS)[:, None], at), signs)
    return v


def word_vectors(texts: list[np.ndarray], reach: int = REACH) -> np.ndarray:
    """Normed word vector of each bucket, learned from token sequences; buckets never met have their index vector only."""
    index = index_vectors()
    v = index.copy()
    for t in texts:
        for d in range(1, reach + 1):
            if len(t) > d:
                np.add.at(v, t[d:], index[t[:-d]] / d)
                np.add.at(v, t[:-d], index[t[d:]] / d)
    return (v / np.maximum(1e-6, np.linalg.norm(v, axis=1, keepdims=True))).astype(np.float32)


def pooled(texts: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Mean over tokens, mean over distinct tokens, and the share of distinct tokens."""
    made = np.zeros((len(texts), 2 * WIDTH + 2), np.float32)
    for i, t in enumerate(texts):
        if len(t):
            distinct, n = np.unique(t, return_counts=True)
            v = vectors[distinct]
            made[i, :WIDTH] = (n / len(t)).astype(np.float32) @ v
            made[i, WIDTH : 2 * WIDTH] = v.mean(0)
            made[i, -2] = len(distinct) / len(t)
            made[i, -1] = np.log1p(len(t)) / 10
    return made


class Network:
    """Standardised inputs, one hidden layer of ReLU, a logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> None:
        self.constant = None if len(np.unique(y)) > 1 else (float(y.mean()) if len(y) else 0.5)
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.std
        order = rng.permutation(len(x))
        held = order[: max(1, len(x) // 6)]
        rest = order[len(held) :] if len(x) > 12 else order
        p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(epochs):
            mixed = rng.permutation(rest)
            for at in range(0, len(mixed), 128):
                xb, yb = x[mixed[at : at + 128]], y[mixed[at : at + 128]]
                pre = xb @ p[0] + p[1]
                h = np.maximum(0, pre)
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - yb) / len(yb)
                gh = np.outer(g, p[2]) * (pre > 0)
                grads = [xb.T @ gh + 1e-3 * p[0], gh.sum(0), h.T @ g + 1e-3 * p[2], np.array([g.sum()])]
                t += 1
                for k, d in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] = p[k] - 2e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        z = self.logits(x[held])
        loss = lambda k: np.logaddexp(0, np.where(y[held] > 0, -z, z) / k).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits((x - self.mean) / self.std) / self.temperature, -30, 30)))


class Model:
    """Fitted on documents (the buckets of their tokens) and labels."""

    def __init__(self, texts: list[np.ndarray], labels: list[int]) -> None:
        self.vectors = word_vectors(texts)
        self.network = Network(pooled(texts, self.vectors).astype(np.float64), np.array(labels, np.float64))
        self.vectors = self.vectors.astype(np.float16)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.vectors.dtype != np.float32:
            self.vectors = self.vectors.astype(np.float32)
        return self.network.probabilities(pooled([bucketed(t) for t in texts], self.vectors).astype(np.float64))


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, label_col: str, rows: int = ROWS) -> DataFrame:
    """(h, label, buckets): a labelled row's hash, label and token buckets (binary, int32). held_out is a column of the label's id."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    texts = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("_of") == F.col("_id"))  # bounded by rows
    found = found.select(F.xxhash64("_id", "_label", "text").alias("h"), F.col("_label").alias("label"), "text").dropDuplicates(["h", "label"])
    schema = pa.schema([("h", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            yield out(schema, {"h": b.column(0), "label": b.column(1), "buckets": [bucketed(t).tobytes() for t in b.column(2).to_pylist()]})

    return found.mapInArrow(work, "h bigint, label int, buckets binary")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS) -> Model:
    """A model of at most ``rows`` labelled rows that held_out doesn't mark."""

    def model(t: pa.Table) -> Model:
        return Model([np.frombuffer(x, np.int32) for x in t.column("buckets").to_pylist()], t.column("label").to_pylist())

    return fitted(training_rows(docs, labels, held_out, id_col, text_col, label_col, rows), ["h", "label"], rows, model) or Model([], [])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with one more column, the probability of label 1; a column that has its name already is replaced."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text_col):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(b.column(at).to_pylist()), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
