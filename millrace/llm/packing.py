"""Cost-balanced packing of documents into training sequences.

A document is its token ids and an end id. Blocks of about ``BLOCK`` tokens are packed each on its own, so memory is
bounded and no document moves between machines. A block of T tokens gets T // length full sequences, and sequences of
powers of two for the rest, so that nothing is padded. Documents (cut at the sequence length first) go in descending
order of length, each to the sequence of lowest cost that still has room for it; a document's cost is estimated as
``LINEAR * n + QUADRATIC * n * n`` for attention within it. What fits nowhere is cut to fill the sequence with most
room, and its rest is placed in the same way.

Nulls: a null text is empty, and is then its end id alone. Rows with equal ids are packed each on its own; sequence ids
are unique in a result. Documents of equal length tie and go in the order of the block; of sequences of equal cost the first is
taken. Empty tables give no rows; other columns than id and text aren't read, so names can't clash.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, kept, steps
from .tokens import byte_letters, library

LENGTH = 2048
END = 1
#: Tokens of a block, about; a document that is longer is its own block.
BLOCK = 1 << 20
LINEAR = 1.0
QUADRATIC = 1.0 / LENGTH
CACHE = 200_000
CACHED_BYTES = 64


# The vocabulary's pre-token pattern, for lower-case texts in ASCII and Latin-1 letters (in normal form already).
_PIECES = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+""").findall
_LATIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÿ]*").fullmatch


class Ids:
    """Token ids (little-endian unsigned 32-bit) of texts; of pre-tokens where the text is Latin, else of words, which no pre-token spans."""

    def __init__(self, path: str) -> None:
        self.encode, self.model = library(path).encode, library(path).model.tokenize
        self.letter = {b: c for c, b in byte_letters().items()}
        self.special = sorted({t.content for t in library(path).get_added_tokens_decoder().values()})
        self.pieces = Recent(lambda p: _bytes([t.id for t in self.model(p.encode().decode("latin-1").translate(self.letter))]), CACHE, CACHED_BYTES)
        self.words = Recent(self.word, CACHE, CACHED_BYTES)

    def word(self, word: bytes) -> bytes:
        return _bytes(self.encode(word.decode("utf-8"), add_special_tokens=False).ids)

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _LATIN(text) and not any(s in text for s in self.special):
            return b"".join(map(self.pieces.__getitem__, _PIECES(text.lower())))
        return b"".join(map(self.words.__getitem__, text.encode("utf-8", "replace").split()))


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def worker_ids(path: str) -> Ids:
    """A worker keeps its cache from task to task."""
    return kept(("ids", path), lambda: Ids(path))


def pack(lengths: list[int], size: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill T // size sequences and some of powers of two."""
    total = sum(lengths)
    room = [size] * (total // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if (total % size) >> b & 1]
    full = list(room)
    cost = [0.0] * len(room)
    used = [0] * len(room)
    # Sequences by the room they have left; in each, a heap by cost. An entry that has moved on is dropped when met.
    by_room: dict[int, list[tuple[float, int]]] = {}
    sizes: list[int] = []

    def put(s: int) -> None:
        if room[s]:
            if room[s] not in by_room:
                by_room[room[s]] = []
                insort(sizes, room[s])
            heapq.heappush(by_room[room[s]], (cost[s], s))

    def top(r: int) -> tuple[float, int] | None:
        heap = by_room[r]
        return heap[0] if heap else None

    for s in range(len(room)):
        put(s)
    work = []
    for d, n in enumerate(lengths):
        work += [(-min(size, n - at), d, at) for at in range(0, n, size)]
    heapq.heapify(work)
    pieces = []
    while work:
        n, d, at = heapq.heappop(work)
        n = -n
        k = bisect_left(sizes, n)
        take = n
        if k == len(sizes):  # it fits nowhere: fill the sequence with most room
            k, take = len(sizes) - 1, sizes[-1]
            r = sizes[k]
        else:
            r = min(sizes[k:], key=lambda x: by_room[x][0])
        _, s = heapq.heappop(by_room[r])
        if not by_room[r]:
            del by_room[r]
            sizes.remove(r)
        pieces.append((d, at, take, s, full[s] - room[s]))
        room[s] -= take
        used[s] += take
        cost[s] += linear * take + quadratic * take * take
        put(s)
        if take < n:
            heapq.heappush(work, (take - n, d, at + take))
    return pieces


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LENGTH, end: int = END, block: int = BLOCK) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, and ids (binary, little-endian unsigned 32-bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
    tail = np.array([end], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, number = worker_ids(path), TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, number
            pieces = pack([len(x) // 4 for _, x in held], size)
            for at in range(0, len(pieces), 4096):
                part = pieces[at : at + 4096]
                yield pa.RecordBatch.from_arrays([
                    pa.array([held[d][0] for d, *_ in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                    pa.array([len(held[p[0]][1]) // 4 for p in part], pa.int64()), pa.array([number + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                    pa.array([held[d][1][4 * a : 4 * (a + n)] for d, a, n, *_ in part], pa.binary())], schema=schema)
            number += 1 + max(p[3] for p in pieces)
            held, tokens = [], 0

        for b in steps(batches):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = ids.of(text) + tail
                held.append((key, made))
                tokens += len(made) // 4
                if tokens >= block:
                    yield from flush()
        if held:
            yield from flush()

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(work, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
