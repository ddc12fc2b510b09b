"""Integer multi-head self-attention over rows of int8 tokens, in Arrow batches of NumPy int64."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import EXP_BITS, EXP_C0, EXP_C1, EXP_C2, FRAC, LOG2E


def wrapped(values: np.ndarray) -> np.ndarray:
    return (values + 128) % 256 - 128


def narrow(acc: np.ndarray, shift: int) -> np.ndarray:
    return np.clip((acc + (1 << (shift - 1) if shift > 0 else 0)) >> shift, -128, 127)


def exp_of(d: np.ndarray, frac: int) -> np.ndarray:
    m = -np.minimum(d, 0) * LOG2E
    z = m >> (frac + 16)
    f = (m - (z << (frac + 16))) >> (frac + 16 - EXP_BITS)
    p = ((EXP_C2 * f * f) >> (2 * EXP_BITS)) + ((EXP_C1 * f) >> EXP_BITS) + EXP_C0
    return np.where(z > EXP_BITS, 0, p >> np.minimum(z, 62))


def attend(x: np.ndarray, in_w: np.ndarray, in_b: np.ndarray, out_w: np.ndarray, out_b: np.ndarray, heads: int, softmax_frac: int = 8, recip_frac: int = 24, scale_frac: int = 14) -> np.ndarray:
    """x: (rows, tokens, width) of int64."""
    rows, tokens, width = x.shape
    part = width // heads
    scale = int(round(2**scale_frac / np.sqrt(part)))
    qkv = narrow(x @ in_w.T + (in_b << FRAC), FRAC).reshape(rows, tokens, 3, heads, part)
    q, k, v = (qkv[:, :, i].transpose(0, 2, 1, 3) for i in range(3))
    shift = 2 * FRAC + scale_frac - softmax_frac
    scores = (q @ k.transpose(0, 1, 3, 2) * scale + (1 << (shift - 1))) >> shift
    e = exp_of(scores - scores.max(-1, keepdims=True), softmax_frac)
    total = np.maximum(1, e.sum(-1, keepdims=True))
    inverse = ((1 << recip_frac) + (total >> 1)) // total
    context = narrow((e @ v) * inverse, recip_frac).transpose(0, 2, 1, 3).reshape(rows, tokens, width)
    return narrow(context @ out_w.T + (out_b << FRAC), FRAC)


def over_rows(df: DataFrame, id_col: str, x_col: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, y): a kernel over a batch's vectors at once (rows, width) of int64; y is an array of bigint."""
    schema = pa.schema([(id_col, pa.int64()), ("y", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = kernel(np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.int64()))], schema=schema)

    return df.select(F.col(id_col).cast("bigint"), x_col).mapInArrow(work, f"{id_col} bigint, y array<bigint>")


def feed_forward(x: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Two layers with a ReLU between; the products are exact in int64."""
    hidden = np.maximum(0, narrow(x @ w1.T + (b1 << FRAC), FRAC))
    return narrow(hidden @ w2.T + (b2 << FRAC), FRAC)


def fixture(n: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Deterministic weights and biases numbered from start."""
    i = np.arange(start, start + n)
    return wrapped(7 * i - 13), wrapped(5 - 3 * i)


def attention(df: DataFrame, id_col: str, x_col: str, tokens: int, width: int, heads: int) -> DataFrame:
    """(id, y) with coefficients by the deterministic fixture rule."""
    in_w, out_w = fixture(3 * width * width)[0].reshape(3 * width, width), fixture(width * width)[0].reshape(width, width)
    in_b, out_b = fixture(3 * width)[1], fixture(width)[1]
    return over_rows(df, id_col, x_col, lambda x: attend(x[:, : tokens * width].reshape(-1, tokens, width), in_w, in_b, out_w, out_b, heads).reshape(len(x), -1))
