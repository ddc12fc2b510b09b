"""Token counts by a two-tier lookup on the map side.

A text is cut where white space follows other characters; no token of the byte-level vocabulary spans such a cut, so
the tokens of a text are those of its units (white space, then a word). Tier one is a broadcast table of frequent
pre-tokens and their token counts, bounded by the size of the vocabulary it is made from: every entry of the
vocabulary that is a whole pre-token. Tier two is each worker's own cache, bounded in entries, of the units and
pre-tokens met there; what it lacks is encoded by the library. No pre-token is shuffled.

Nulls: a null text counts as empty. Empty texts have no tokens; texts of any length are counted whole, and a unit with
a special string in it goes to the library as a whole. Repeated rows are kept. Empty tables give no rows; other columns than
id and text aren't read, so names can't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, kept, out, steps

LIMIT = 512
#: Entries of a worker's cache, about half of those it may hold.
CACHE = 300_000
#: Longer units are not cached.
CACHED_CHARS = 64

_ASCII_SPACE = " \t\n\r\x0b\x0c"
#: A unit: white space of any kind, then everything up to the next ASCII white space.
_UNIT = regex.compile(rf"[{_ASCII_SPACE}]*[^{_ASCII_SPACE}]+|[{_ASCII_SPACE}]+$")
#: Where white space stands one by one, units are what single spaces and line ends separate.
_TWO_SPACES = re.compile(r"\s\s")
#: Words whose letters all libraries' tables agree on, and words of these letters, digits and ASCII marks.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
_LATIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ɏ]+").fullmatch


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes as."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def frequent(path: str, pattern: str) -> tuple[str, bytes]:
    """Tier one: the vocabulary's entries that are one pre-token, and how many tokens each is; compact, to be broadcast."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters, one = byte_letters(), regex.compile(pattern)
    words = []
    for entry in vocabulary:
        try:
            word = bytes(letters[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if "\0" not in word and one.fullmatch(word) and not (word.isspace() and len(word) > 1):
            words.append(word)
    found = library(path).encode_batch(words, add_special_tokens=False)
    kept = [(w, len(e.ids)) for w, e in zip(words, found, strict=True) if len(e.ids) < 256]
    return "\0".join(w for w, _ in kept), bytes(n for _, n in kept)


class Counter:
    """Token counts of texts. What the caches lack is made of pre-tokens, by tier one and the library's model."""

    def __init__(self, path: str, table: tuple[str, bytes], pattern: str, special: list[str], room: int = CACHE) -> None:
        self.tier = dict(zip(table[0].split("\0"), table[1], strict=True)) if table[0] else {}
        self.encode, self.model = library(path).encode, library(path).model.tokenize
        self.pieces, self.special = regex.compile(pattern).findall, special
        self.letter = {b: c for c, b in byte_letters().items()}
        #: Of words that follow a space, and of other units.
        self.words = Recent(lambda word: self.unit(" " + word), room, CACHED_CHARS)
        self.others = Recent(self.unit, room // 4, CACHED_CHARS)

    def piece(self, piece: str) -> int:
        """Tokens of one pre-token."""
        return self.tier.get(piece) or len(self.model(piece.encode().decode("latin-1").translate(self.letter)))

    def unit(self, unit: str) -> int:
        """Tokens of a unit with its white space."""
        if not unit:
            return 0
        word = unit[1:] if unit[0] == " " else unit
        if _LETTERS(word):
            return self.piece(unit)
        if _LATIN(word) and not any(s in word for s in self.special):
            return sum(map(self.piece, self.pieces(unit)))
        return len(self.encode(unit, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if _TWO_SPACES.search(text):
            return sum(map(self.others.__getitem__, _UNIT.findall(text)))
        n, of = -1, self.words.__getitem__
        for line in text.split("\n"):  # a single line end is a token
            first, *rest = line.split(" ")
            n += 1 + self.others[first] + sum(map(of, rest))
        return n


def worker_counter(path: str, broadcast, pattern: str, special: list[str]) -> Counter:
    """A worker keeps its cache from task to task."""
    return kept(("tokens", path, pattern, *special), lambda: Counter(path, broadcast.value, pattern, special))


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Every row's doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``path``: a byte-level BPE vocabulary of the tokenizers library, at the same place on all machines; ``pattern``: its pre-token pattern.
    """
    special = sorted({t.content for t in library(path).get_added_tokens_decoder().values()})
    table = docs.sparkSession.sparkContext.broadcast(frequent(path, pattern))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            counter = worker_counter(path, table, pattern, special)
            n = [counter.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield out(schema, {"doc_id": b.column(0), "n_bytes": b.column(2), "n_tokens": n, "over_limit": [x > limit for x in n]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return picked.mapInArrow(work, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
