"""Language identification by a bit-sliced Bloom filter of n-grams.

A slot of the filter is a bit mask with one bit for each language. Looking up an n-gram takes the AND of its slots'
masks, which gives all languages that hold it at once. A text's n-grams are looked up together; each language's
popcount is corrected for the rate of false positives that its filled slots imply, and the highest corrected share wins
(ties: the language with more training rows, then by name).

Texts are lower-cased and runs of other characters than letters become one space, so n-grams see word ends.
Training reads about ``per_language`` rows of each language, or fewer so that ``rows`` rows (one for each language, if there
are more languages) are the bound in all; they are whole texts of any length, the first by a hash of id and text. N-grams
are made where the rows are read, and one task fits the filter. Every text is predicted whole. An n-gram belongs to a
language where it occurs in ``at_least`` of its training rows and in at least ``share`` of the rate that it has in its
strongest language, which keeps out foreign words. The filter has ``slots`` slots, fewer where there are many languages,
so that it stays within ``FILTER_BYTES``.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Rows without a language or id aren't trained on, nor
are texts without a letter. Without any training row all texts are ``und``. Repeated rows are kept; where equal rows tie for
a place in training, either is used. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fitted, out, spread, steps

SIZES = (2, 3, 4)
SLOTS = 1 << 21
FILTER_BYTES = 128 << 20
HASHES = 2
ROWS = 8000
PER_LANGUAGE = 1500
AT_LEAST = 3
SHARE = 0.1
UND = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Lower-case letters, other runs as one space, with a space at both ends; empty without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    c = np.concatenate(([32], np.where(is_letter, c, 32), [32])).astype(np.uint32)
    return c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]


def ngrams(c: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams."""
    m = len(c) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + c[i : i + m]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def distinct_ngrams(text: str, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """The distinct n-grams of a text."""
    c = codes(text)
    return np.unique(np.concatenate([ngrams(c, n) for n in sizes])) if len(c) else np.zeros(0, np.uint64)


class Model:
    """The filter and what corrects its counts. Learned from rows of (language, distinct n-grams of a text)."""

    def __init__(self, rows: list[tuple[str, np.ndarray]], sizes: tuple[int, ...] = SIZES, slots: int = SLOTS, at_least: int = AT_LEAST, share: float = SHARE) -> None:
        by: dict[str, list[np.ndarray]] = {}
        for lang, grams in rows:
            by.setdefault(lang, []).append(grams)
        #: By training rows, then by name: the order in which ties are decided.
        self.languages = sorted(by, key=lambda x: (-len(by[x]), x))
        planes = max(1, -(-len(self.languages) // 64))
        kind = np.uint8 if len(self.languages) <= 8 else np.uint64
        while planes * slots * np.dtype(kind).itemsize > FILTER_BYTES and slots > 1 << 12:
            slots //= 2
        self.sizes, self.mask = sizes, np.uint64(slots - 1)
        self.filter = np.zeros((planes, slots), kind)
        seen = {i: np.unique(np.concatenate(by[lang]), return_counts=True) for i, lang in enumerate(self.languages)}
        rates = [(h, n / len(by[self.languages[i]])) for i, (h, n) in seen.items()]
        every = np.unique(np.concatenate([h for h, _ in rates])) if rates else np.zeros(0, np.uint64)
        best = np.zeros(len(every))
        for h, r in rates:
            at = np.searchsorted(every, h)
            best[at] = np.maximum(best[at], r)
        for i, (h, n) in seen.items():
            rate = n / len(by[self.languages[i]])
            own = h[(n >= min(at_least, len(by[self.languages[i]]))) & (rate >= share * best[np.searchsorted(every, h)])]
            for slot in self.places(own):
                self.filter[i // 64, slot] |= kind(1) << kind(i % 64)
        bits = [(self.filter[i // 64] >> kind(i % 64)) & kind(1) for i in range(len(self.languages))]
        self.false = np.array([b.mean() ** HASHES for b in bits])

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(32 * k)) & self.mask).astype(np.int64) for k in range(HASHES)]

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages): corrected share of each text's n-grams that the language holds; NaN without a letter."""
        made = np.full((len(texts), len(self.languages)), np.nan)
        parts = [codes(t) if t else np.zeros(0, np.uint32) for t in texts]
        for i, c in enumerate(parts):
            if not len(c) or not self.languages:
                continue
            h = np.concatenate([ngrams(c, n) for n in self.sizes])
            masks = [self.filter[:, p] for p in self.places(h)]
            both = np.bitwise_and.reduce(masks)
            if self.filter.dtype == np.uint8:
                count = np.bincount(both[0], minlength=256)
                hits = np.array([count[(np.arange(256) >> k) & 1 == 1].sum() for k in range(len(self.languages))])
            else:
                hits = np.array([((both[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum() for k in range(len(self.languages))])
            made[i] = np.maximum(0, (hits / len(h) - self.false) / np.maximum(1e-9, 1 - self.false))
        return made

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages, and scores: the winner's part of all shares."""
        shares = self.shares(texts)
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        void = np.isnan(shares[:, 0])
        shares = np.nan_to_num(shares)
        best = shares.argmax(1)
        total = shares.sum(1)
        score = np.where(total > 0, shares.max(1) / np.where(total > 0, total, 1), 0.0)
        return [UND if v else self.languages[b] for v, b in zip(void, best, strict=True)], np.where(void, 0.0, score)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = ROWS, per_language: int = PER_LANGUAGE) -> tuple[DataFrame, int]:
    """(h, lang, grams) and a bound: the bound's first rows by h are those to learn from, evenly by language."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    counts = checkpointed(usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first")))
    languages = counts.count()
    bound, each = max(rows, languages), min(per_language, max(1, rows // max(1, languages)))
    # A row is drawn with the chance that gives its language so many rows; the least hash is always drawn.
    drawn = (F.col("h") == F.col("first")) | (F.pmod("h", F.lit(1 << 40)) < F.lit(float(1 << 40)) * each / F.col("n"))
    few = counts.select(F.col("lang").alias("_lang"), "n", "first")
    few = F.broadcast(few) if languages <= rows else spread(few, "_lang")
    chosen = usable.join(few, F.col("lang") == F.col("_lang")).where(drawn).select("h", "lang", "text", (F.col("h") != F.col("first")).alias("later")).dropDuplicates(["h", "lang"])
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("later", pa.bool_()), ("grams", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            yield out(schema, {"h": b.column(0), "lang": b.column(1), "later": b.column(3), "grams": [distinct_ngrams(t).tobytes() for t in b.column(2).to_pylist()]})

    return chosen.mapInArrow(work, "h bigint, lang string, later boolean, grams binary"), bound


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Every row's doc_id, held_out, lang_pred and score. Rows that ``held_out`` marks, or of null id, aren't learned from."""
    learned = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.coalesce(held_out, F.lit(True)).alias("_out"))
    chosen, bound = training_rows(learned.where(~F.col("_out")), "_id", "_text", "_lang", rows, per_language)
    fit = lambda t: Model([(lang, np.frombuffer(g, np.uint64)) for lang, g in zip(t.column("lang").to_pylist(), t.column("grams").to_pylist(), strict=True) if g])
    model = fitted(chosen, ["later", "h", "lang"], bound, fit) or Model([])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            langs, scores = shared.value.predict(b.column(1).to_pylist())
            yield out(schema, {"doc_id": b.column(0), "held_out": b.column(2), "lang_pred": langs, "score": scores})

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    return picked.mapInArrow(work, "doc_id bigint, held_out boolean, lang_pred string, score double")
