"""Chroma audio fingerprints and their alignment.

A recording (mono samples) becomes frames of twelve pitch classes; rectangles of an integral image over them are
compared by sixteen filters, each giving two bits (Gray code), so every position has a packed 32-bit integer.
Recordings with the same integers are one class. The stated queries are dealt into blocks of about ``BLOCK`` positions, and each block
meets every class where that is read: the histogram over offsets counts, for each offset, all bits that agree where query and
recording overlap (a correlation of bits as signs, 32 channels at once, by short transforms), and the bit error is that count's
rest. So no offset is missed and no key is shared by many; the cost is queries times recordings, as stated, and nothing but
matches is sent.

Defined results: a null or empty recording has no integers; all such are one class, which matches nothing. Recordings too short
for a position likewise. Repeated rows are members of one class. A query and a class match at the offset of least bit error among those
where ``OVERLAP`` of the shorter one's positions meet, the nearest to 0 on ties, then the lesser. Recordings of any length are taken
whole; a query longer than a block is a block of its own. Rows without an id whose recording others have are members of that class;
a class of such rows alone matches nothing. Empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, out, spread

RATE = 4000
FRAME = 512
HOP = 128
WIDTH = 16
ERRORS = 0.35
#: Share of the shorter recording's positions that have to meet.
OVERLAP = 0.5
#: Positions in a block of queries, and numbers in a step's histograms.
BLOCK = 1 << 19
PAIR_NUMBERS = 1 << 23
LEVEL = 0.25


def pitch_map(rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """(bins, 12): each spectrum bin's pitch class, from 55 Hz to half the rate."""
    hertz = np.fft.rfftfreq(frame, 1 / rate)
    made = np.zeros((len(hertz), 12), np.float32)
    heard = np.flatnonzero((hertz >= 55) & (hertz < rate / 2))
    made[heard, np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12] = 1
    return made


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12), each frame of length one (or zero where it is silent)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    energy = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).astype(np.float32) @ pitch_map(rate)
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.divide(energy, norm, out=np.zeros_like(energy), where=norm > 1e-6)


def filters() -> list[tuple[str, int, int, int]]:
    """(kind, first pitch class, classes, frames): what the sixteen filters compare, by rule."""
    kinds = ("time", "pitch", "centre", "corners")
    return [(kinds[i % 4], (i * 5) % 9, 2 + i % 3, (4, 8, 16, 12)[i // 4]) for i in range(16)]


def integers(frames: np.ndarray) -> np.ndarray:
    """Packed 32-bit integers of the positions that have WIDTH frames ahead."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = np.cumsum(np.cumsum(frames, axis=0), axis=1)
    at = np.arange(n)
    box = lambda t, t2, p, p2: image[at + t2, p2] - image[at + t, p2] - image[at + t2, p] + image[at + t, p]
    packed = np.zeros(n, np.uint32)
    for kind, p, h, w in filters():
        p2 = min(12, p + 2 * (h // 2))
        mid, half = (p + p2) // 2, w // 2
        every = box(0, w, p, p2)
        if kind == "time":
            part = box(0, half, p, p2)
        elif kind == "pitch":
            part = box(0, w, p, mid)
        elif kind == "centre":
            part = box(w // 4, w - w // 4, p, p2)
        else:
            part = box(0, half, p, mid) + box(half, w, mid, p2)
        ratio = np.log1p(part) - np.log1p(every - part)
        level = (ratio > -LEVEL).astype(np.uint32) + (ratio > 0) + (ratio > LEVEL)
        packed = (packed << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return packed


def fingerprints(media: DataFrame, id_col: str, media_col: str, decode: Callable[[object], np.ndarray | None], rate: int = RATE) -> DataFrame:
    """(rec_id, prints): prints is an array of the packed integers (as signed ints). ``decode`` gives a value's samples."""
    schema = pa.schema([("rec_id", pa.int64()), ("prints", pa.list_(pa.int32()))])

    def prints(value: object) -> np.ndarray:
        samples = decode(value) if value is not None else None
        return integers(chroma(samples, rate)).view(np.int32) if samples is not None else np.zeros(0, np.int32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                yield out(schema, {"rec_id": b.column(0), "prints": [prints(v) for v in b.column(1).to_pylist()]})

    return media.select(F.col(id_col).cast("bigint"), media_col).mapInArrow(work, "rec_id bigint, prints array<int>")


class Part:
    """Some recordings' integers, and their spectra for the length of transform last asked for."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]) -> None:
        self.ids, self.prints, self.made = np.array(ids, np.int64), prints, (0, None, None)
        self.sizes = np.array([len(p) for p in prints])

    def spectra(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Real and imaginary parts, (frequencies, recordings, 2 * 32) and (frequencies, 2 * 32, recordings)."""
        if self.made[0] != n:
            s = np.fft.rfft(signs(self.prints, n), axis=2)
            both = np.concatenate((s.real, s.imag), 1)
            self.made = (n, np.ascontiguousarray(both.transpose(2, 0, 1)), np.ascontiguousarray(both.transpose(2, 1, 0)))
        return self.made[1:]


def parts(ids: list[int], prints: list[np.ndarray]) -> list[Part]:
    """Recordings in parts of not too different lengths, of so many that a step's histograms are bounded."""
    order, made, start = sorted(range(len(ids)), key=lambda i: len(prints[i])), [], 0
    for end in range(1, len(order) + 1):
        least = len(prints[order[start]])
        if end == len(order) or end - start >= np.clip(np.sqrt(PAIR_NUMBERS / (2 * least + 64)), 1, 256) or len(prints[order[end]]) > 1.25 * least + 16:
            made.append(Part([ids[i] for i in order[start:end]], [prints[i] for i in order[start:end]]))
            start = end
    return made


def signs(prints: list[np.ndarray], n: int) -> np.ndarray:
    """(recordings, 32, n): each position's bits as 1 and -1, zero beyond the end."""
    made = np.zeros((len(prints), n, 32), np.float32)
    for m, p in zip(made, prints, strict=True):
        m[: len(p)] = np.unpackbits(np.ascontiguousarray(p).view(np.uint8).reshape(-1, 4), axis=1).astype(np.float32) * 2 - 1
    return made.transpose(0, 2, 1)


def good_length(n: int) -> int:
    """The least length from n on that has no prime factor beyond 7."""
    while True:
        rest = n
        for f in (2, 3, 5, 7):
            while rest % f == 0:
                rest //= f
        if rest == 1:
            return n
        n += 1


def met(a: Part, b: Part, overlap: float, errors: float) -> tuple[np.ndarray, ...]:
    """(i, j, offset, votes, bit error) of the pairs of a[i] and b[j] whose least bit error is at most ``errors``.

    Transforms wrap only at offsets that are out of reach. Which pairs may pass is seen in single numbers with room for their
    rounding; those are then decided by whole ones.
    """
    la, lb = a.sizes[:, None], b.sizes[None, :]
    need = np.maximum(1, np.ceil(overlap * np.minimum(la, lb))).astype(np.int64)
    low, high = int((need - la).min()), int((lb - need).max())  # offsets that any pair needs
    n = good_length(int(max(la.max() + max(0, high), lb.max() - min(0, low), high - low + 1)))
    # The product of spectra as real numbers, and the way back as a matrix, for the wanted offsets only.
    f = np.arange(n // 2 + 1)
    left, right = a.spectra(n)[0], b.spectra(n)[1]
    product = np.empty((2 * len(f), len(la), lb.shape[1]), np.float32)
    np.matmul(left, right, out=product[: len(f)])
    np.matmul(left, np.concatenate((right[:, 32:], -right[:, :32]), 1), out=product[len(f) :])
    product = product.reshape(2 * len(f), -1)
    weight = np.where((f == 0) | (2 * f == n), 1, 2) / n
    back = lambda o: np.stack((weight * np.cos(2 * np.pi * o * f / n), -weight * np.sin(2 * np.pi * o * f / n)))
    at_best = lambda r: r.max(0).reshape(need.shape)  # noqa: E731  one less twice the bit error
    if (la == la[0, 0]).all() and (lb == lb[0, 0]).all():
        meet = lambda o: np.minimum(la[0, 0], lb[0, 0] - o) - np.maximum(0, -o)
        scaled = lambda o: back(o[:, None]) / (32 * np.maximum(1, meet(o)))[None, :, None]
        if low == -high:  # an offset and its opposite from the same two sums
            cos, sin = scaled(np.arange(high + 1)).astype(np.float32)
            r = np.abs(sin @ product[len(f) :])
            r += cos @ product[: len(f)]
        else:
            r = np.concatenate(scaled(np.arange(low, high + 1)), 1).astype(np.float32) @ product
        alike = at_best(r)
    else:
        o = np.arange(low, high + 1)[:, None, None]
        both = np.minimum(la, lb - o) - np.maximum(0, -o)
        r = (np.concatenate(back(np.arange(low, high + 1)[:, None]), 1).astype(np.float32) @ product).reshape(both.shape)
        alike = np.where(both >= need, r / np.maximum(1, 32 * both), -np.inf).max(0)
    i, j = np.nonzero(alike >= 1 - 2 * errors - 1e-3)
    offsets = np.array(sorted(range(low, high + 1), key=lambda o: (abs(o), o)))[:, None]
    r = np.concatenate(back(offsets), 1) @ product[:, i * lb.shape[1] + j]  # agreeing bits less differing ones, whole numbers but for rounding
    both = np.minimum(la[i, 0], lb[0, j] - offsets) - np.maximum(0, -offsets)
    votes = np.rint((r + 32 * both) / 2).astype(np.int64)
    error = np.where(both >= need[i, j], 1 - votes / np.maximum(1, 32 * both), np.inf)
    best = error.argmin(0) if len(i) else np.zeros(0, np.int64)
    at = np.arange(len(i))
    passed = np.flatnonzero(error[best, at] <= errors)
    best, at = best[passed], at[passed]
    return i[at], j[at], offsets[best, 0], votes[best, at], error[best, at]


def align(prints: DataFrame, is_query: Column, errors: float = ERRORS, overlap: float = OVERLAP) -> DataFrame:
    """(kind, a_id, b_id, offset, votes, bit_error).

    kind ``member``: b_id's recording has the same integers as a_id's, its class's least id (itself included).
    kind ``match``: class a_id, which has a query, agrees with class b_id when b is ``offset`` positions later; votes are the bits that agree there.
    """
    spark = prints.sparkSession
    rows = checkpointed(prints.select("rec_id", "prints", F.sha2(F.array_join(F.col("prints").cast("array<string>"), ","), 256).alias("key"), F.coalesce(is_query, F.lit(False)).alias("query")))
    classes = checkpointed(rows.groupBy("key").agg(F.min("rec_id").alias("id"), F.first("prints").alias("prints"), F.max("query").alias("query")))
    members = rows.select("key", "rec_id").join(spread(classes.select(F.col("key").alias("_key"), "id"), "_key"), F.col("key") == F.col("_key"))
    found = members.select(F.lit("member").alias("kind"), F.col("id").alias("a_id"), F.col("rec_id").alias("b_id"), F.lit(0).alias("offset"), F.lit(0).cast("bigint").alias("votes"), F.lit(0.0).alias("bit_error"))

    heard = classes.where("id is not null and size(prints) > 0").select("id", "prints", "query")
    total = heard.where("query").agg(F.sum(F.size("prints"))).first()[0] or 0
    blocks = -(-total // BLOCK)
    asked = heard.where("query").select("id", "prints", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))).alias("block"))
    asked = checkpointed(asked) if blocks > 1 else asked
    # All recordings, dealt evenly: a task's time is its recordings' number times the queries'.
    others = heard.select("id", "prints").repartition(4 * spark.sparkContext.defaultParallelism)
    for k in range(blocks):
        own = asked.where(F.col("block") == k).collect()  # about BLOCK integers
        if own:
            queries = parts([r["id"] for r in own], [np.array(r["prints"], np.int32) for r in own])
            found = found.unionByName(others.mapInArrow(meeting(spark.sparkContext.broadcast(queries), errors, overlap), "kind string, a_id bigint, b_id bigint, offset int, votes bigint, bit_error double"))
    return found


def meeting(shared: Broadcast, errors: float, overlap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over (id, prints): matches with a block of queries."""
    schema = pa.schema([("kind", pa.string()), ("a_id", pa.int64()), ("b_id", pa.int64()), ("offset", pa.int32()), ("votes", pa.int64()), ("bit_error", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            theirs = parts(b.column(0).to_pylist(), [v.values.to_numpy() for v in b.column(1)])
            for own in theirs:
                for asked in shared.value:
                    i, j, *rest = met(asked, own, overlap, errors)
                    a_id, b_id = asked.ids[i], own.ids[j]
                    if (others := a_id != b_id).any():
                        yield out(schema, {"kind": ["match"] * int(others.sum()), "a_id": a_id[others], "b_id": b_id[others], **{name: v[others] for name, v in zip(("offset", "votes", "bit_error"), rest, strict=True)}})

    return work


def melody(vector: list[float] | None, rate: int = RATE, note: int = 256) -> np.ndarray | None:
    """A vector as a recording: each number is a note, the higher the number the higher the pitch, over four octaves."""
    if not vector:
        return None
    numbers = np.nan_to_num(np.array([x if x is not None else 0.0 for x in vector], np.float64), posinf=1, neginf=-1)
    pitch = np.clip(np.round(24 + 60 * numbers), 0, 47)
    return np.sin(2 * np.pi * np.cumsum(np.repeat(110 * 2 ** (pitch / 12), note)) / rate).astype(np.float32)
