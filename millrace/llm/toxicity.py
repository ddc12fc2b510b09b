"""Toxicity classifier: a convolutional network over hashed word embeddings, trained in numpy, with a threshold for each language.

A word (``\\w+``, lower case) is the sum of the embeddings of its buckets: the word itself, its beginnings and its endings, so
that inflected forms of one stem share most of their vector. Filters of the ``WIDTHS`` slide over the words; each gives its
greatest response over the whole text, and a linear layer makes a logit of those. The first number of a bucket's embedding
starts as the log odds of its texts' labels, the others at random; all are trained, with buckets left out at random.

The same words tell the language: sums of log frequencies of each language's words (``LANGUAGES`` of them at most, learned from
the training rows' language column; a score reads the text only). A fifth of the training rows is held back from the network:
on it, one temperature and a threshold for each language are chosen, drawn towards the common one where a language has few
rows. A score is the probability after both, so 0.5 is every language's threshold.

Training reads every labelled row that may be learned from, whole texts of any length. Up to ``SHARD`` rows are fitted in one task, in
``EPOCHS`` epochs. Beyond, rows are dealt by their id into shards of about that many and kept as blocks of word numbers; counts of
buckets and of languages' words are added up over all of them. In each of ``ROUNDS`` rounds every shard takes the steps of an epoch
over its own rows from the same weights, and what they changed is averaged: a bucket's embedding over the steps that met it,
other weights over the rows. Temperature and thresholds are of all held-back rows, by sums of losses. Only sums of fixed size come to the driver.
The held-back rows are weighted back to the labels' shares. Every text is scored whole, in blocks of
``BLOCK`` words that overlap. Vectors and weights are of fixed size.

Defined results: a null text is empty and is scored as such, as are texts without words; rows whose label or id is null are not
learned from, a null language is one of its own. An id with two labels, or that several documents have, gives a training row
for each pair (all in one shard); rows equal in all of it tie, and one is used. With fewer than two classes, all scores are the share of label 1
(0.5 without labels). Empty tables give no rows; extra columns are kept, one named as the score is replaced.
"""

from __future__ import annotations

import copy
import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, checkpointed, fitted, kept, steps

BUCKETS = 1 << 16
DIM = 12
#: Filter widths in words, and the number of filters of each.
WIDTHS = ((1, 8), (2, 4), (3, 4))
PIECES = 6
DOUBT = 1.5
#: Training rows of a shard, about, and epochs over one shard alone or over several.
SHARD = 8192
EPOCHS = 10
ROUNDS = 5
BATCH = 32
LEFT_OUT = 0.2
RATE = 0.02
LANGUAGES = 32
THRESHOLD = 0.5
SEED = 11
#: Words whose rows a worker keeps, and words in a block of a text.
CACHE = 60_000
BLOCK = 1 << 16
#: Words and texts after which a block of training rows ends, and buckets whose numbers are added up together.
BLOCK_WORDS, BLOCK_TEXTS = 1 << 18, 1024
PART = 1024
#: Temperatures to choose from, and bits of the filter of labelled ids for each of them.
TEMPERATURES = np.geomspace(0.25, 4, 17)
ID_BITS = 8

_WORDS = re.compile(r"\w+").findall
_FILTERS = sum(n for _, n in WIDTHS)
_COLUMNS = sum(k * n for k, n in WIDTHS)


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def buckets_of(word: str) -> list[int]:
    """PIECES buckets: of the word, its first 3 to 5 and last 3 and 4 UTF-8 bytes; 0 stands for none (a word too short for one)."""
    b = word.encode("utf-8", "replace")
    n, m = len(b), BUCKETS - 1
    if n > 4:
        return [1 + crc32(b, 1) % m, 1 + crc32(b[:3], 2) % m, 1 + crc32(b[:4], 3) % m, 1 + crc32(b[:5], 4) % m, 1 + crc32(b[-3:], 5) % m, 1 + crc32(b[-4:], 6) % m]
    parts = ((b, 1), (b[:3] if n >= 3 else b"", 2), (b[:4] if n >= 4 else b"", 3), (b"", 4), (b[-3:] if n > 3 else b"", 5), (b"", 6))
    return [1 + crc32(p, kind) % m if p else 0 for p, kind in parts]


def numbered(words: list[str], number: defaultdict[str, int]) -> np.ndarray:
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def log_odds(docs: Sequence[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each bucket, the log odds of label 1 among texts that have it against all: nearest to 0 within ``DOUBT`` deviations of its counts."""
    counts = np.zeros((2, BUCKETS))
    for d, label in zip(docs, y, strict=True):
        counts[int(label), d] += 1
    return odds_of(counts, np.bincount(y.astype(int), minlength=2))


def odds_of(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log_odds of counts of texts by label and bucket, and of texts by label."""
    n = n[:, None]
    low, high = np.maximum(0, counts - DOUBT * np.sqrt(counts)) + 0.5, counts + DOUBT * np.sqrt(counts) + 0.5
    least, most = (np.log(one / (n[1] + 1)) - np.log(zero / (n[0] + 1)) for one, zero in ((low[1], high[0]), (high[1], low[0])))
    odds = np.where(least > 0, least, np.where(most < 0, most, 0.0)) * (counts.sum(0) > 0)
    odds[0] = 0
    return odds


class Conv:
    """The network: embeddings E, filters (one matrix, a column for each place of each filter), filters' bias, output weights and bias."""

    def __init__(self, odds: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.E[:, 0] = odds / 4
        self.E[0] = 0
        self.f = rng.normal(0, 0.3, (DIM, _COLUMNS)).astype(np.float32)
        self.f[0] = np.abs(self.f[0])
        self.b = np.full(_FILTERS, -0.2, np.float32)
        self.w = np.abs(rng.normal(0, 0.3, _FILTERS)).astype(np.float32)
        self.a = np.float32(-1.0)

    def responses(self, buckets: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(word vectors, each word's response to each filter's places) for words given by their buckets."""
        e = self.E[buckets]
        x = e.sum(1) if mask is None else np.einsum("npd,np->nd", e, mask)
        return x, x @ self.f

    def greatest(self, r: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's greatest response over a text whose words have the rows r, and the word that it begins at; beyond the end lie zeros."""
        n, best, at, c, o = len(r), np.empty(_FILTERS, np.float32), np.zeros(_FILTERS, np.int64), 0, 0
        for k, m in WIDTHS:
            s = r[:, c : c + m]
            if k > 1:
                s = s.copy()
                for j in range(1, min(k, n)):
                    s[: n - j] += r[j:, c + j * m : c + (j + 1) * m]
            if where:
                at[o : o + m] = s.argmax(0)
                best[o : o + m] = s[at[o : o + m], np.arange(m)]
            else:
                best[o : o + m] = s.max(0)
            c, o = c + k * m, o + m
        return best, at if where else None

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(0, pooled + self.b) @ self.w + self.a

    def start(self) -> None:
        """Adagrad's sums, and the steps that met each bucket."""
        self.sums = {k: np.full_like(getattr(self, k), 0.01, dtype=np.float32) for k in ("f", "b", "w", "a")} | {"E": np.full(BUCKETS, 0.01, np.float32)}
        self.met = np.zeros(BUCKETS, np.float32)

    def train(self, docs: list[np.ndarray], table: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.start()
        for _ in range(epochs):
            self.epoch(docs, table, y, weight, rng)
        del self.sums, self.met

    def epoch(self, docs: list[np.ndarray], table: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """docs: arrays of word numbers; table: buckets of each word. Adagrad; gradients only flow through the greatest responses."""
        sums = self.sums

        def step(name: str, g: np.ndarray) -> None:
            sums[name] = sums[name] + g * g
            setattr(self, name, getattr(self, name) - RATE * g / np.sqrt(sums[name]))

        mixed = rng.permutation([i for i in range(len(docs)) if len(docs[i])])
        for lo in range(0, len(mixed), BATCH):
            batch = mixed[lo : lo + BATCH]
            distinct, inverse = np.unique(np.concatenate([docs[i] for i in batch]), return_inverse=True)
            sizes = np.array([len(docs[i]) for i in batch])
            first = np.cumsum(sizes) - sizes
            bk = table[distinct]
            mask = ((rng.random(bk.shape) >= LEFT_OUT) / (1 - LEFT_OUT)).astype(np.float32)
            x, r = self.responses(bk, mask)
            tops = [self.greatest(r[inverse[a : a + n]], True) for a, n in zip(first, sizes, strict=True)]
            h = np.stack([p for p, _ in tops]) + self.b
            at = np.stack([a for _, a in tops])
            live = np.maximum(0, h)
            g = weight[batch] * (1 / (1 + np.exp(-np.clip(live @ self.w + self.a, -30, 30))) - y[batch]).astype(np.float32) / len(batch)
            d = g[:, None] * self.w * (h > 0)
            gf, gx = 1e-4 * self.f, np.zeros_like(x)
            c = o = 0
            for k, m in WIDTHS:
                for q in range(k):
                    place = at[:, o : o + m] + q
                    dq = np.where(place < sizes[:, None], d[:, o : o + m], 0)
                    words = inverse[np.minimum(place, sizes[:, None] - 1) + first[:, None]]
                    gf[:, c : c + m] += np.einsum("nm,nmd->dm", dq, x[words])
                    np.add.at(gx, words, dq[..., None] * self.f[:, c : c + m].T)
                    c += m
                o += m
            met = np.flatnonzero(gx.any(1))
            ids, back = np.unique(bk[met].ravel(), return_inverse=True)
            ge = np.zeros((len(ids), DIM), np.float32)
            np.add.at(ge, back, (gx[met][:, None, :] * mask[met][..., None]).reshape(-1, DIM))
            self.met[ids] += 1
            sums["E"][ids] += (ge * ge).mean(1)
            self.E[ids] -= RATE * ge / np.sqrt(sums["E"][ids])[:, None]
            self.E[0] = 0
            step("f", gf)
            step("b", d.sum(0))
            step("w", live.T @ g + 1e-4 * self.w)
            step("a", g.sum())


def heard(names: list[str], docs: list[np.ndarray], table: np.ndarray, langs: list[str | None]) -> np.ndarray:
    """How often each language of these has each bucket's words; other languages aren't counted."""
    counts = np.zeros((len(names), BUCKETS))
    for d, lang in zip(docs, langs, strict=True):
        if (lang or "") in names:
            np.add.at(counts[names.index(lang or "")], table[d, 0], 1)
    return counts


class Tongues:
    """Languages by the words of their texts: log frequencies of hashed words, one column a language."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        logs = np.log(counts + 0.1) - np.log(counts.sum(1, keepdims=True) + 0.1 * BUCKETS)
        self.logs = (logs - logs.mean(0)).T.astype(np.float32) if self.names else np.zeros((BUCKETS, 0), np.float32)

    def of(self, sums: np.ndarray) -> int:
        return int(sums.argmax()) if len(sums) and sums.any() else -1


def cuts_of(low: float, high: float) -> np.ndarray:
    """Thresholds to choose from."""
    return np.unique(np.concatenate((np.linspace(low, high, 81), [0.0])))


def losses(z: np.ndarray, y: np.ndarray, tongue: np.ndarray, cuts: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Log losses of logits summed by (label, language), a row for each temperature, a column for each threshold."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for label in np.unique(y).astype(int).tolist():
        for lang in np.unique(tongue[y == label]).tolist():
            own, total = z[(y == label) & (tongue == lang)], np.zeros((len(TEMPERATURES), len(cuts)))
            for lo in range(0, len(own), 512):
                far = (cuts - own[lo : lo + 512, None]) * (1 if label else -1)
                total += [np.logaddexp(0, far / k).sum(0) for k in TEMPERATURES]
            found[label, lang] = total
    return found


class Model:
    """Fitted on texts, labels and languages; ``shares`` are the labels' numbers in all rows that may be learned from, with a text or not."""

    def __init__(self, texts: list[str | None], labels: list[int], langs: list[str | None], shares: Sequence[int] = (0, 0), epochs: int = EPOCHS, seed: int = SEED) -> None:
        y = np.array(labels, np.float64)
        self.constant = None if len(np.unique(y)) > 1 else (float(y.mean()) if len(y) else 0.5)
        if self.constant is not None:
            return
        number = defaultdict(count().__next__)
        docs = [numbered(words_of(t), number) for t in texts]
        table = np.array([buckets_of(w) for w in number] or [[0] * PIECES], np.int64)
        shares = [s or n for s, n in zip(shares, np.bincount(y.astype(int), minlength=2), strict=True)]
        rng = np.random.default_rng(seed)
        held = np.zeros(len(y), bool)
        for label in (0, 1):  # a fifth of each, but one row of each is learned from
            rows = rng.permutation(np.flatnonzero(y == label))
            held[rows[: min(len(rows) // 5, len(rows) - 1)]] = True
        rest = np.flatnonzero(~held)
        names, n = np.unique([langs[i] or "" for i in rest], return_counts=True)
        names = names[np.argsort(-n, kind="stable")][:LANGUAGES].tolist()
        self.tongues = Tongues(names, heard(names, [docs[i] for i in rest], table, [langs[i] for i in rest]))
        self.net = Conv(log_odds([np.unique(table[np.unique(docs[i])]) for i in rest], y[rest]), seed)
        n = np.bincount(y[rest].astype(int), minlength=2)
        self.net.train([docs[i] for i in rest], table, y[rest], (len(rest) / 2 / n)[y[rest].astype(int)].astype(np.float32), epochs, seed)
        self.calibrate([texts[i] for i in np.flatnonzero(held)], y[held], shares)
        self.pack()

    def calibrate(self, texts: list[str | None], y: np.ndarray, shares: Sequence[int]) -> None:
        """One temperature, and a threshold for each language: least log loss on held-back rows, weighted to the labels' shares."""
        self.temperature, self.common, self.thresholds = 1.0, 0.0, {}
        if len(y):
            z, tongue = self.raw(texts, Rows(self))
            cuts = cuts_of(z.min(), z.max())
            self.settle(losses(z, y, tongue, cuts), np.bincount(y.astype(int), minlength=2), shares, cuts)

    def settle(self, tables: dict[tuple[int, int], np.ndarray], n: np.ndarray, shares: Sequence[int], cuts: np.ndarray) -> None:
        """The least of the losses, given by label and language for each temperature and threshold, n held-back rows of each label."""
        w = np.array([shares[v] / max(1, n[v]) for v in (0, 1)])
        w *= n.sum() / (w @ n)
        loss = sum(w[label] * t for (label, _), t in tables.items())
        k, t = np.unravel_index(loss.argmin(), loss.shape)
        self.temperature, self.common = TEMPERATURES[k], cuts[t]
        for lang in sorted({lang for _, lang in tables}):
            own = sum(w[label] * t[k] for (label, of), t in tables.items() if of == lang)
            self.thresholds[lang] = float(cuts[(own + 0.5 * ((cuts - self.common) / self.temperature) ** 2).argmin()])

    def pack(self) -> None:
        self.net.E = self.net.E.astype(np.float16)
        self.tongues.logs = self.tongues.logs.astype(np.float16)
        self.key = crc32(self.net.E.tobytes() + self.net.f.tobytes())

    def unpack(self) -> None:
        if self.net.E.dtype != np.float32:
            self.net.E = self.net.E.astype(np.float32)
            self.tongues.logs = self.tongues.logs.astype(np.float32)

    def row(self, words: list[str]) -> np.ndarray:
        """What these words answer to every filter's places, and what they say of languages."""
        return self.answers(np.array([buckets_of(w) for w in words], np.int64))

    def answers(self, b: np.ndarray) -> np.ndarray:
        return np.hstack((self.net.responses(b)[1], self.tongues.logs[b[:, 0]]))

    def raw(self, texts: list[str | None], seen: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Logits and languages (their number, -1 for none) of whole texts."""
        logits, tongue = np.empty(len(texts)), np.full(len(texts), -1)
        for i, text in enumerate(texts):
            logits[i], tongue[i] = self.told(words_of(text), seen.of)
        return logits, tongue

    def told(self, words: Sequence, rows: Callable[[Sequence], np.ndarray]) -> tuple[float, int]:
        """A whole text's logit and language, from what rows() has for its words."""
        wide = max(k for k, _ in WIDTHS) - 1
        best, said = np.full(_FILTERS, -np.inf, np.float32), np.zeros(len(self.tongues.names), np.float64)
        for at in range(0, len(words), BLOCK):
            r = rows(words[at : at + BLOCK + wide])
            best = np.maximum(best, self.net.greatest(r[:, :_COLUMNS])[0])
            said += r[:BLOCK, _COLUMNS:].sum(0, dtype=np.float64)
        return self.net.logit(best if len(words) else np.full(_FILTERS, -1e3, np.float32)), self.tongues.of(said)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        self.unpack()
        z, tongue = self.raw(texts, kept(("toxicity", self.key), lambda: Rows(self)))
        t = np.array([self.thresholds.get(int(v), self.common) for v in tongue])
        return 1 / (1 + np.exp(-np.clip((z - t) / self.temperature, -30, 30)))


class Rows:
    """Rows of words met, in one matrix; when it is full, it starts anew."""

    def __init__(self, model: Model) -> None:
        self.model, self.number = model, {}
        self.matrix = np.empty((2 * CACHE, _COLUMNS + len(model.tongues.names)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        number = self.number
        at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        new = list({words[i] for i in missing})
        if len(number) + len(new) > len(self.matrix):
            number.clear()
            missing, new = np.arange(len(words)), list(set(words))
        if new:
            lo = len(number)
            self.matrix[lo : lo + len(new)] = self.model.row(new)
            number.update(zip(new, range(lo, lo + len(new)), strict=True))
            at[missing] = [number[words[i]] for i in missing]
        return self.matrix[at]


def likely(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of docs whose ``_of`` is one of the n ids ``_id``, and some eighth of the others: a bit map of hashed ids (a byte an id) spares a join their texts."""
    bits = -(-ID_BITS * n // 32768) * 32768
    place = lambda key: F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(bits))
    maps = ids.select(place("_id").alias("_place")).groupBy(F.expr("_place div 32768").alias("_map")).agg(F.bitmap_construct_agg(F.expr("_place % 32768")).alias("_bits"))
    found = docs.withColumn("_place", place("_of")).withColumn("_map", F.expr("_place div 32768")).join(F.broadcast(maps), "_map")
    return found.where("conv(hex(substring(_bits, cast(_place % 32768 div 8 as int) + 1, 1)), 16, 10) div shiftleft(1, cast(_place % 8 as int)) % 2 = 1").select(*docs.columns)


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, label_col: str, lang_col: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """(_of, text, lang) of the documents and (_id, _label) of the labels that may be learned from, and the numbers of labels 0 and 1 among the latter."""
    mine = F.col(id_col).isNotNull() & ~held_out
    usable = labels.where(F.col(label_col).isNotNull() & mine).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1)").distinct()
    shares = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}  # two rows
    texts = docs.where(mine).select(F.col(id_col).alias("_of"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return texts, usable, [shares.get(0, 0), shares.get(1, 0)]


def paired(texts: DataFrame, usable: DataFrame) -> DataFrame:
    """(h, label, lang, text) for each document and each of its labels."""
    found = texts.join(usable.hint("shuffle_hash"), F.col("_of") == F.col("_id"))
    return found.select(F.xxhash64("_id", "_label", "text").alias("h"), F.col("_label").alias("label"), "lang", "text")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Model:
    """A model of all labelled rows that held_out (a column of the id) doesn't mark."""
    texts, usable, shares = training_rows(docs, labels, held_out, id_col, text_col, label_col, lang_col)
    n = texts.select("_of").join(usable, F.col("_of") == F.col("_id")).count()
    if n > SHARD:
        return fit_dealt(texts, usable, n, shares)

    def model(t: pa.Table) -> Model:
        return Model(t.column("text").to_pylist(), t.column("label").to_pylist(), t.column("lang").to_pylist(), shares)

    return fitted(paired(texts, usable).dropDuplicates(["h", "label"]), ["h", "label"], max(1, n), model) or Model([], [], [])


_BLOCK = pa.schema([("shard", pa.int32()), ("held", pa.bool_()), ("n0", pa.int64()), ("n1", pa.int64()), ("langs", pa.list_(pa.string())), ("lang_rows", pa.list_(pa.int64())), ("labels", pa.binary()), ("tongues", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("buckets", pa.binary())])
_BLOCK_SQL = "shard int, held boolean, n0 bigint, n1 bigint, langs array<string>, lang_rows array<bigint>, labels binary, tongues binary, sizes binary, words binary, buckets binary"


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows, sorted by h and label, as blocks of word numbers; equal rows are one. A fifth, by h, makes blocks that are held back."""
    shard, seen, last = TaskContext.get().partitionId(), Recent(buckets_of, CACHE, 64), None
    empty = lambda: (defaultdict(count().__next__), [], [], [])
    open_ = {held: empty() for held in (False, True)}
    size = {False: 0, True: 0}

    def closed(held: bool) -> pa.RecordBatch:
        number, docs, labels, langs = open_[held]
        open_[held], size[held] = empty(), 0
        names, of, n = np.unique([v or "" for v in langs], return_inverse=True, return_counts=True)
        row = [shard, held, labels.count(0), labels.count(1), names.tolist(), n.tolist(), np.array(labels, "u1").tobytes(), of.astype("i4").tobytes(),
               np.array([len(d) for d in docs], "i8").tobytes(), np.concatenate(docs).astype("u4").tobytes(), np.array([seen[w] for w in number] or [[0] * PIECES], "u2").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    for b in steps(batches):
        for h, label, lang, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (h, label) == last:
                continue
            last, held = (h, label), h % 5 == 0
            number, docs, labels, langs = open_[held]
            docs.append(numbered(words_of(text), number))
            labels.append(label)
            langs.append(lang)
            size[held] += len(docs[-1])
            if len(docs) >= BLOCK_TEXTS or size[held] >= BLOCK_WORDS:
                yield closed(held)
    for held in (False, True):
        if open_[held][1]:
            yield closed(held)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, list[str]]]:
    """(shard, texts' word numbers, words' buckets, labels, languages) of each block."""
    for b in batches:
        for i in range(b.num_rows):
            x = {name: b.column(at)[i].as_py() for at, name in enumerate(b.schema.names)}
            ends = np.cumsum(np.frombuffer(x["sizes"], "i8"))
            docs = np.split(np.frombuffer(x["words"], "u4").astype(np.int64), ends[:-1])
            yield x["shard"], docs, np.frombuffer(x["buckets"], "u2").astype(np.int64).reshape(-1, PIECES), np.frombuffer(x["labels"], "u1").astype(np.float64), [x["langs"][t] for t in np.frombuffer(x["tongues"], "i4")]


def added(made: DataFrame, kind: str = "f8") -> dict[int, np.ndarray]:
    """Sums of arrays by ``part``, made on the executors; those of parts below 0 are of single precision, the others of this kind."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(data.as_py(), "f4" if part < 0 else kind)
                total[part] = total[part] + x if part in total else x.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("f8" if kind == "f8" else "f4").tobytes() for x in total.values()], pa.binary())], ["part", "data"])

    rows = made.repartition("part").mapInArrow(work, "part int, data binary").collect()
    return {r["part"]: np.frombuffer(r["data"], "f8" if kind == "f8" else "f4").astype(np.float64) for r in rows}


def sent(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["part", "data"])


def counts_of(blocks: DataFrame, names: list[str]) -> np.ndarray:
    """For each bucket, the texts of label 0 and of label 1 that have it, and how often each language has its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for _, docs, table, y, langs in unpacked(batches):
            counts = np.zeros((2 + len(names), BUCKETS)) if counts is None else counts
            for d, label in zip(docs, y, strict=True):
                counts[int(label), np.unique(table[np.unique(d)])] += 1
            counts[2:] += heard(names, docs, table, langs)
        if counts is not None:
            yield sent({i: counts[:, i * PART : (i + 1) * PART].astype("f4") for i in range(BUCKETS // PART)})

    parts = added(blocks.mapInArrow(work, "part int, data binary"), "f4")
    return np.hstack([parts[i].reshape(-1, PART) for i in range(BUCKETS // PART)])


def round_of(blocks: DataFrame, net: Conv, weight: np.ndarray, i: int) -> None:
    """One epoch of all shards from the net's weights and sums, averaged into it."""
    shared = blocks.sparkSession.sparkContext.broadcast(net)
    dense = lambda own: np.concatenate([np.ravel(v) for k in ("f", "b", "w", "a") for v in (getattr(own, k), own.sums[k])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, 0
        for shard, docs, table, y, _ in unpacked(batches):
            if own is None:
                own, rng = copy.deepcopy(shared.value), np.random.default_rng((SEED, i, shard))
            own.epoch(docs, table, y, weight[y.astype(int)], rng)
            rows += len(docs)
        if own is not None:
            met = np.minimum(own.met, 2048)[:, None]  # half precision is exact up to there
            change = np.hstack((met, met * (own.E - shared.value.E), met * (own.sums["E"] - shared.value.sums["E"])[:, None])).astype("f2")
            yield sent({-1: (rows * np.append(1, dense(own))).astype("f4")} | {p: change[p * PART : (p + 1) * PART] for p in range(BUCKETS // PART)})

    parts = added(blocks.mapInArrow(work, "part int, data binary"), "f2")
    shared.destroy()
    change = np.vstack([parts[p].reshape(PART, -1) for p in range(BUCKETS // PART)])
    change[:, 1:] /= np.maximum(1, change[:, :1])
    net.E += change[:, 1:-1].astype(np.float32)
    net.sums["E"] += change[:, -1].astype(np.float32)
    net.E[0] = 0
    mean, at = parts[-1][1:] / parts[-1][0], 0
    for k in ("f", "b", "w", "a"):
        shape, size = np.shape(getattr(net, k)), np.size(getattr(net, k))
        setattr(net, k, mean[at : at + size].reshape(shape).astype(np.float32)[()])
        net.sums[k] = mean[at + size : at + 2 * size].reshape(shape).astype(np.float32)[()]
        at += 2 * size


def fit_dealt(texts: DataFrame, usable: DataFrame, n: int, shares: Sequence[int]) -> Model:
    """A model of n training rows, dealt by id into shards."""
    shards = -(-n // SHARD)
    rows = paired(likely(texts, usable, sum(shares)).repartition(shards, "_of"), usable.repartition(shards, "_id"))
    blocks = checkpointed(rows.sortWithinPartitions("h", "label", "lang").mapInArrow(blocks_of, _BLOCK_SQL))
    tally = {r["held"]: np.array([r["n0"], r["n1"]]) for r in blocks.groupBy("held").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()}
    learned, held = (tally.get(k, np.zeros(2, int)) for k in (False, True))
    both = learned + held
    if not both.all():
        return Model([], [int(both[1] > 0)], [])
    # A label that has held-back rows only is learned from those, too.
    own = blocks.where("not held") if learned.all() else blocks
    learned = learned if learned.all() else both
    spoken = own.select(F.explode(F.arrays_zip("langs", "lang_rows")).alias("x")).groupBy("x.langs").agg(F.sum("x.lang_rows").alias("n"))
    names = [r["langs"] for r in spoken.orderBy(F.desc("n"), "langs").limit(LANGUAGES).collect()]
    counts = counts_of(own, names)
    model = Model([], [], [])
    model.constant, model.tongues, model.net = None, Tongues(names, counts[2:]), Conv(odds_of(counts[:2], learned))
    model.net.start()
    for i in range(ROUNDS):
        round_of(own, model.net, (learned.sum() / 2 / learned).astype(np.float32), i)
    del model.net.sums, model.net.met
    model.temperature, model.common, model.thresholds = 1.0, 0.0, {}
    model.pack()
    if held.sum():
        calibrate_dealt(blocks.where("held"), model, held, shares)
    return model


def calibrate_dealt(blocks: DataFrame, model: Model, n: np.ndarray, shares: Sequence[int]) -> None:
    """Temperature and thresholds of all held-back rows, n of each label."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.unpack()
        for _, docs, table, y, _ in unpacked(batches):
            r = own.answers(table)
            z, tongue = zip(*(own.told(d, lambda d: r[d]) for d in docs), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(y.astype("i4")), pa.array(tongue, pa.int32()), pa.array(z, pa.float64())], ["label", "tongue", "z"])

    logits = checkpointed(blocks.mapInArrow(said, "label int, tongue int, z double"))
    low, high = logits.agg(F.min("z"), F.max("z")).first()
    cuts, several = cuts_of(low, high), LANGUAGES + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, tongue, z = (b.column(i).to_numpy() for i in range(3))
            if len(z):
                yield sent({label * several + lang + 1: t for (label, lang), t in losses(z, y, tongue, cuts).items()})

    parts = added(logits.mapInArrow(work, "part int, data binary"))
    model.settle({(p // several, p % several - 1): x.reshape(len(TEMPERATURES), -1) for p, x in parts.items()}, n, shares, cuts)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with one more column, the probability of label 1; a column that has its name already is replaced."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text_col):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(b.column(at).to_pylist()), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
