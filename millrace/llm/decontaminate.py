"""Benchmark decontamination by winnowing.

An item's windows are its runs of ``WINDOW`` words (an item of fewer words: the whole of it). Training and test texts
keep the minimum k-gram hash of each sliding window of k-grams; with k-grams of ``K`` words and ``WINDOW - K + 1``
k-grams a window, any shared run of ``WINDOW`` words shares a kept fingerprint. Kept fingerprints are joined, and each
hit is extended to the windows around it, which are compared word by word, so hash collisions cannot make a hit. Items of
fewer words have fingerprints of their own length, one for each run of that many words. Equal windows are numbered once, so a
window costs a place the same whether one item or ten thousand have it; their items are listed once for a document.

The test side is cut into blocks of at most ``BLOCK_CHARS`` characters, whose size is checked; one block is broadcast at a
time. With more than one, documents are read anew for each and hits are added up by row; texts are never shuffled for it.

Nulls: a null text has no words and cannot be hit; an item without words has no windows. An item_id that comes twice
counts once; items without an id count as one, and have no name. Empty tables give no rows, or rows without hits. Ids may
be null; repeated rows are kept; texts of any length are read whole; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, spread, steps

WINDOW = 10
K = 5
#: Characters of benchmark text in a broadcast block at most (one text may be longer).
BLOCK_CHARS = 8 << 20

#: A-Z to lower case; what is not a letter, a digit or beyond ASCII separates words.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD).split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _BASE + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    return _mixed(h)


def grams_of_rows(rows: np.ndarray) -> np.ndarray:
    """``grams`` of each row's whole run."""
    h = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        h = h * _BASE + rows[:, i].astype(np.uint64) + np.uint64(1)
    return _mixed(h)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost minimum of each run of w hashes."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for i in range(1, w):
        new = hashes[i : i + n]
        less = new <= best
        best = np.where(less, new, best)
        at = np.where(less, np.arange(i, i + n), at)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


class Block:
    """A part of the benchmark, ready to be matched."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW, k: int = K) -> None:
        self.window, self.k = window, k
        self.word: dict[bytes, int] = {}
        self.items, runs = [], []
        for item, text in items:
            ids = [self.word.setdefault(x, len(self.word) + 1) for x in words_of(text)]
            if ids:
                self.items.append(None if item is None else str(item))
                runs.append(np.array(ids, np.int32))
        #: For each length of window: sorted kept fingerprints; sorted window hashes, their words, and their items (those of window i from first[i] on).
        self.prints: dict[int, np.ndarray] = {}
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.array([min(window, len(r)) for r in runs], np.int64)
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n).tolist()
            size = k if n == window else n
            kept = [grams(runs[i], size) for i in own]
            self.prints[n] = np.unique(np.concatenate([h[winnow(h, n - size + 1)] for h in kept]))
            words = np.concatenate([np.lib.stride_tricks.sliding_window_view(runs[i], n) for i in own])
            item = np.repeat(own, [len(runs[i]) - n + 1 for i in own])
            words, of = np.unique(words, axis=0, return_inverse=True)
            pairs = np.unique(np.stack((of.ravel(), item)), axis=1)
            hashes = grams_of_rows(words)
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two windows of the benchmark have the same hash")
            order = np.argsort(hashes)
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            by = np.argsort(place[pairs[0]], kind="stable")
            first = np.concatenate(([0], np.cumsum(np.bincount(place[pairs[0]], minlength=len(order)))))
            self.windows[n] = (hashes[order], words[order], first, pairs[1][by])

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first word, window) of the windows that occur in ids, which are numbers of this block's words, or 0."""
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, prints in self.prints.items():
            size = self.k if n == self.window else n
            h = grams(ids, size)
            kept = winnow(h, n - size + 1)
            kept = kept[unknown[kept + size] == unknown[kept]]  # a gram with a word the block doesn't have is in no window
            at = np.searchsorted(prints, h[kept])
            kept = kept[(at < len(prints)) & (prints[np.minimum(at, len(prints) - 1)] == h[kept])]
            starts = np.unique((kept[:, None] - np.arange(n - size + 1)).ravel())  # of the windows that hold the gram
            starts = starts[(starts >= 0) & (starts + n <= len(ids))]
            starts = starts[unknown[starts + n] == unknown[starts]]
            if not len(starts):
                continue
            hashes, words, _, _ = self.windows[n]
            own = ids[starts[:, None] + np.arange(n)]
            mine = grams_of_rows(own)
            at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
            same = (hashes[at] == mine) & (words[at] == own).all(axis=1)
            yield n, starts[same], at[same]

    def names(self, n: int, windows: np.ndarray) -> set[str | None]:
        """The items that have any of these windows."""
        _, _, first, item = self.windows[n]
        return {self.items[i] for w in windows.tolist() for i in item[first[w] : first[w + 1]].tolist()}


def unpacked(part: Broadcast) -> Block:
    """A broadcast block; the worker doesn't keep its bytes beside it."""
    block = pickle.loads(part.value)
    part.__dict__.pop("_value", None)
    return block


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The benchmark in lists of at most ``chars`` characters (or of one text), dealt by hash; never more than one list in the driver."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    n = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // chars))
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        most = dealt.groupBy("block").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows")).where(F.col("chars") > chars).where("rows > 1")
        if n == 1 or most.isEmpty():
            break
        n *= 2
    for i in range(n):
        yield [(r[0], r[1]) for r in dealt.where(F.col("block") == i).select("item", "text").collect()]


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint ranges that spans make."""
    a: list[int] = []
    b: list[int] = []
    for x, y in sorted(spans):
        if b and x <= b[-1]:
            b[-1] = max(b[-1], y)
        else:
            a.append(x)
            b.append(y)
    return a, b


def sorted_names(names: set[str | None]) -> list[str | None]:
    """Names in order; a nameless item comes last."""
    return [*sorted(x for x in names if x is not None), *([None] if None in names else [])]


FIELDS = {"n_words": "bigint", "n_hit": "bigint", "starts": "array<bigint>", "ends": "array<bigint>", "items": "array<string>"}


def matched(rows: DataFrame, items: list[tuple], window: int, k: int, hits_only: bool = False) -> DataFrame:
    """``rows`` with _text in place of FIELDS, matched with one block, which is broadcast; with ``hits_only``, only rows that are hit."""
    part = rows.sparkSession.sparkContext.broadcast(pickle.dumps(Block(items, window, k)))
    rest = [f for f in rows.schema.fields if f.name != "_text"]
    names = [*(f.name for f in rest), *FIELDS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = unpacked(part)
        number = block.word.get
        for batch in steps(batches, "_text"):
            texts = [words_of(t) for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()]
            first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))  # a zero between texts
            ids = np.zeros(first[-1], np.int32)
            for t, at in zip(texts, first.tolist(), strict=False):
                ids[at : at + len(t)] = [number(x, 0) for x in t]
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            items: list[set[str | None]] = [set() for _ in texts]
            for n, at, found in block.hits(ids):
                doc = np.searchsorted(first, at, "right") - 1
                for d, x in zip(doc.tolist(), (at - first[doc]).tolist(), strict=True):
                    spans[d].append((x, x + n))
                for d in np.unique(doc).tolist():
                    items[d] |= block.names(n, np.unique(found[doc == d]))
            ranges = [merged(x) for x in spans]
            made = [pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(b) - sum(a) for a, b in ranges], pa.int64()), pa.array([a for a, _ in ranges], pa.list_(pa.int64())), pa.array([b for _, b in ranges], pa.list_(pa.int64())), pa.array([sorted_names(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in rest), *made], names)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{c} {kind}" for c, kind in FIELDS.items())])
    found = rows.mapInArrow(work, ddl)
    return found.where("n_hit > 0") if hits_only else found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, keep: tuple[str, ...] = (), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every row's doc_id, n_words, hit ranges and items: (doc_id, n_words, n_hit, starts, ends, items), then the columns in ``keep``.

    ``starts`` and ``ends`` are word positions of disjoint hit ranges, end exclusive; ``items`` are item ids as strings, sorted
    (an item without an id is a null, at the end).
    """
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    order = ["doc_id", *FIELDS, *[F.col(f"_keep_{c}").alias(c) for c in keep]]
    blocks = blocks_of(benchmark, item_col, item_text_col, block_chars)
    items, more = next(blocks), next(blocks, None)
    if more is None:
        return matched(picked, items, window, k).select(*order)
    rows = checkpointed(picked.withColumn("_row", F.monotonically_increasing_id()))
    found = None
    for part in chain((items, more), blocks):
        new = checkpointed(matched(rows.select("_row", "_text"), part, window, k, hits_only=True))
        found = new if found is None else found.unionByName(new)
    found = found.groupBy(F.col("_row").alias("_of")).agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"), F.flatten(F.collect_list("items")).alias("names"))  # a row's, from each block
    rest = [f for f in rows.schema.fields if f.name not in ("_text", "_row")]

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "_text"):
            column = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            ranges = [merged([(x["starts"], x["ends"]) for x in s or ()]) for s in column["spans"].to_pylist()]
            made = [pa.array([len(words_of(t)) for t in column["_text"].to_pylist()], pa.int64()), pa.array([sum(y) - sum(x) for x, y in ranges], pa.int64()), pa.array([x for x, _ in ranges], pa.list_(pa.int64())), pa.array([y for _, y in ranges], pa.list_(pa.int64())), pa.array([sorted_names(set(x or ())) for x in column["names"].to_pylist()], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(column[f.name] for f in rest), *made], [*(f.name for f in rest), *FIELDS])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{c} {kind}" for c, kind in FIELDS.items())])
    return rows.join(spread(found, "_of"), F.col("_row") == F.col("_of"), "left").mapInArrow(united, ddl).select(*order)


def digest(hits: DataFrame) -> DataFrame:
    """The columns of a contamination report."""
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def sha256_of(items: list[object]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def oracle() -> str:
    """The report as DuckDB SQL, by joining whole windows."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM documents),
    b AS (SELECT item_id, {words} AS w FROM benchmark), i AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
    ia AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM i), iw AS (SELECT DISTINCT item_id, n, array_to_string(w[a:a + n - 1], ' ') AS win FROM ia),
    da AS (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
    hits AS (SELECT id, item_id, a, da.n FROM da JOIN iw ON da.n = iw.n AND array_to_string(w[a:a + da.n - 1], ' ') = win),
    places AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(a, a + n)) AS p FROM hits) GROUP BY id),
    items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (id) LEFT JOIN items USING (id)"""
