"""Fill-in-middle documents over an index of distinct texts.

A text is cut into units (a run of ASCII letters, or any other code point). The index holds each distinct text once, found by its
SHA-256 and length, without its copies being sent around: they are dropped where they are read, as far as one task has
them. Documents are joined back to the index by that key, and a text's unit ends are listed once for all of its documents as an
Elias-Fano list: low bits packed, high bits as gaps in a bit string, so a unit takes about two bits and its low ones. Each
document reads the two ends that its seed selects. Every document is verified at last: the text rebuilt from its own output must
have the digest that the scan has found for that document, or the job fails.

A key with more than one row in ``SHARE`` of all, or with more than ``CHUNK`` rows, is dealt over several chunks on both sides, each with
its own copy of the text. There are never more than ``SHARE`` plus one in ``CHUNK`` rows of such keys (50 bytes each), which
are broadcast.

Defined results: a null text is empty; a null id is seeded as an empty one. Empty texts have no units and are plain. Texts are
cut whole, at any length. Rows that share an id get the same seed; equal rows give equal results. Empty tables give no rows;
other columns than id and text are not kept, so names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, STEP_ROWS, checkpointed, out, steps

MARKS = ("<P>", "<S>", "<M>")
#: Shares, in percent: documents that stay plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SHARE = 512
CHUNK = 1 << 18
#: Ends between two marks of where to look in the bit string.
SKIP = 256


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def unit_ends(text: str) -> np.ndarray:
    """Where each unit ends, in code points, ascending."""
    c = code_points(text) | 32
    letter = (c >= 97) & (c <= 122)
    return np.append(np.flatnonzero(~(letter[:-1] & letter[1:])) + 1, len(c)) if len(c) else np.zeros(0, np.int64)


class EliasFano:
    """An ascending list of integers: ``low`` bits of each packed, the rest in unary in ``high``; ``skip`` has the place of every SKIP-th one bit."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, skip: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.skip = n, low_bits, low, high, skip

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        bits = max(0, int(np.log2(max(1, values[-1] / n)))) if n else 0
        values = values.astype(np.int64)
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes() if bits else b""
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little").tobytes(), ones[::SKIP].astype(np.int64))

    def __getitem__(self, i: int) -> int:
        """The i-th value, from 0: read from the bit string after the last mark before it."""
        at = int(self.skip[i // SKIP])
        left = i % SKIP
        first, place = at >> 3, at - (at & 7)
        while True:
            part = np.flatnonzero(np.unpackbits(np.frombuffer(self.high[first : first + 64], np.uint8), bitorder="little")) + place
            part = part[part >= at]
            if left < len(part):
                one = int(part[left])
                break
            left, first, place = left - len(part), first + 64, place + 512
        bit, low = i * self.low_bits, 0
        for k in range(self.low_bits):
            low |= ((self.low[(bit + k) >> 3] >> ((bit + k) & 7)) & 1) << k
        return ((one - i) << self.low_bits) | low

    def dump(self) -> bytes:
        return b"".join((np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.int64).tobytes(), self.low, self.high, self.skip.tobytes()))

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, bits, a, b = (int(v) for v in np.frombuffer(data, np.int64, 4))
        return cls(n, bits, data[32 : 32 + a], data[32 + a : 32 + a + b], np.frombuffer(data[32 + a + b :], np.int64))


def seeds(doc_id: int | None) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))  # type: ignore[return-value]


def form_of(text: str, h3: int, h4: int) -> str:
    if not text or h3 % 100 >= 100 - PLAIN or any(m in text for m in MARKS):
        return "plain"
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm"


def joined(form: str, prefix: str, middle: str, suffix: str) -> str:
    p, s, m = MARKS
    return f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made of. A mark can't arise across a cut, as none ends in what another begins with."""
    p, s, m = MARKS
    if form == "plain":
        return output
    head, middle = output.split(m, 1)
    first, second = head[len(p) :].split(p if form == "spm" else s, 1)
    return second + middle + first if form == "spm" else first + middle + second


_COLUMNS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, documents) to each document's form, cuts, output and digests; a text's list of ends is made once for all of them."""
    made, size = [], 0

    def flushed() -> pa.RecordBatch:
        return out(_OUT, dict(zip(_OUT.names, zip(*made, strict=True), strict=True)))

    for b in steps(batches):
        for key, text, members in zip(*b.columns, strict=True):
            key, text = key.as_py(), text.as_py()
            ends, h = EliasFano.of(unit_ends(text)), _sha(text)
            for i in members.values.field(0).to_pylist():
                h1, h2, h3, h4 = seeds(i)
                form, cut, output, h_output = form_of(text, h3, h4), (None, None), text, h
                if form != "plain":
                    one, two = sorted((h1 % (ends.n + 1), h2 % (ends.n + 1)))
                    a, z = (ends[k - 1] if k else 0 for k in (one, two))
                    cut, output = (a, z - a), joined(form, text[:a], text[a:z], text[z:])
                    h_output = _sha(output)
                back = _sha(restored(output, form))
                if bytes.fromhex(back) != key[:32]:
                    raise ValueError(f"the text of document {i} can't be rebuilt")
                made.append((i, ends.n, form, *cut, output, h_output, back))
                size += len(output)
                if len(made) >= STEP_ROWS or size >= STEP_BYTES:
                    yield flushed()
                    made, size = [], 0
    if made:
        yield flushed()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256), one row a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.unhex(F.sha2(text.cast("binary"), 256)), F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")))
    key = F.coalesce(key, F.lit(b""))  # never null, and the planner may know
    named = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"))
    # How many documents have each key: keys with very many are few, by their number.
    counts = checkpointed(named.groupBy("key").agg(F.count("*").alias("rows")))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    most = max(1, min(total // SHARE, CHUNK))
    hot = F.broadcast(counts.where(F.col("rows") > most).select("key", F.ceil(F.col("rows") / most).cast("int").alias("chunks")))
    dealt = lambda rows, by: rows.join(hot, "key", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64(by), F.col("chunks")).cast("int"), F.lit(0)))

    whole = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), key.alias("key"))
    index = dealt(whole, "doc_id").groupBy("key", "chunk").agg(F.min("text").alias("text"))
    members = dealt(named, "doc_id").groupBy("key", "chunk").agg(F.collect_list(F.struct("doc_id")).alias("documents"))  # a chunk's ids, about ``most``
    met = index.join(members, ["key", "chunk"]).select("key", "text", "documents")  # both lie by key and chunk
    return met.mapInArrow(transformed, _COLUMNS)


def digests(docs: DataFrame) -> DataFrame:
    return fill_in_middle(docs).drop("output")


def oracle() -> str:
    h = lambda k: f"('0x' || substr(s, {8 * k + 1}, 8))::BIGINT"
    p, s, m = MARKS
    marked = " OR ".join(f"contains(text, '{x}')" for x in MARKS)
    part = lambda a, z: f"array_to_string(units[{a}:{z}], '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
  u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
  c AS (SELECT *, len(units) AS n, least({h(0)} % (len(units) + 1), {h(1)} % (len(units) + 1)) AS one, greatest({h(0)} % (len(units) + 1), {h(1)} % (len(units) + 1)) AS two,
    CASE WHEN text = '' OR {marked} OR {h(2)} % 100 >= {100 - PLAIN} THEN 'plain' WHEN {h(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
  x AS (SELECT *, {part("1", "one")} AS prefix, {part("one + 1", "two")} AS middle, {part("two + 1", "n")} AS suffix FROM c),
  o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output FROM x),
  b AS (SELECT *, strpos(output, '{m}') AS at_m, CASE WHEN form = 'spm' THEN strpos(output, '{p}') ELSE strpos(output, '{s}') END AS at_2 FROM o)
  SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars, sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, at_2 - 4) || substr(output, at_m + 3) || substr(output, at_2 + 3, at_m - at_2 - 3)
      ELSE substr(output, at_2 + 3, at_m - at_2 - 3) || substr(output, at_m + 3) || substr(output, 4, at_2 - 4) END) AS restored_sha256 FROM b"""
