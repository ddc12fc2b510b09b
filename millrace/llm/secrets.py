"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Base candidates are found by pattern, leftmost and non-overlapping for each kind. Besides them, ``opaque`` candidates are
long runs of letters and digits of mixed case outside base spans. Each candidate's value is hashed, and the corpus says
how many distinct repositories and owners hold that hash:

* ``widespread``: many owners or repositories hold it, as with an example that is copied around;
* ``live``: few owners do, and the value looks random (several distinct characters, no placeholder word).

Base spans always stay. An opaque span is added only where it is live. Nulls: a null text is empty; a null repository
or owner counts as one of its own kind; repeated rows count once for their repository and keep their own row. Texts of any
length are scanned whole. Spans that begin at one place stand in the order of the kinds; hashes that just as many hold as a
bound says are widespread. Empty tables give no rows; of the input's other columns only those named in ``keep`` are kept, under names that
can't clash with the scan's own.
Counting is by partial sums over (hash, owner, repository), so a hash that a third of all rows hold is no hot spot.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let, spread

# The patterns of the base kinds, in the order in which kinds with the same start are listed.
KINDS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "opaque": r"[A-Za-z0-9_-]{20,}",
}
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test[_-]?(key|token|secret)|1234567"
#: All characters that a value can have.
ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
WIDE_OWNERS = 3
WIDE_REPOSITORIES = 10
#: Lengths are summed in runs of this many, so that a text with very many matches takes n * RUN steps, not n * n.
RUN = 128

SPAN = "array<struct<start:int,end:int,rank:int,kind:string,value:string>>"


def _starts(lengths: Column) -> Column:
    """Exclusive running sums of an array of integers."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda r: total(F.slice(lengths, r * RUN + 1, RUN)))
    heads = let(runs, lambda s: F.transform(s, lambda _, r: total(F.slice(s, F.lit(1), r))))
    return let(heads, lambda h: F.transform(lengths, lambda _, i: F.element_at(h, F.floor(i / RUN).cast("int") + 1) + total(F.slice(lengths, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN))))


def spans_of(text: Column, kind: str) -> Column:
    """The matches of a kind in a text, as structs of start, end (code points, end exclusive), rank, kind and value."""
    pattern = F.lit(KINDS[kind])
    rank = list(KINDS).index(kind)
    none = F.array().cast(SPAN)

    def located(found: Column) -> Column:
        gaps = F.split(text, KINDS[kind], -1)
        # Gap and match lengths in turn; their running sum has the starts of the matches at odd places.
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return let(steps, lambda s: let(_starts(s), lambda at: F.transform(found, lambda m, i: F.struct(
            (F.element_at(at, i + 1) + F.element_at(s, i + 1) - F.length(m)).alias("start"),
            (F.element_at(at, i + 1) + F.element_at(s, i + 1)).alias("end"),
            F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            (F.regexp_extract(m, KINDS[kind], 1) if kind == "assign" else m).alias("value")))))

    every = F.regexp_extract_all(text, pattern, F.lit(0))
    made = let(every, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none))
    if kind == "access":
        made = F.when(F.contains(text, F.lit("AKIA")), made).otherwise(none)
    if kind == "assign":
        made = F.filter(made, lambda s: F.length(s["value"]) >= 6)
    if kind == "opaque":
        mixed = lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]")
        made = F.filter(made, mixed)
    return made


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Each row with base (array of spans) and opaque (those that don't touch a base span), besides the columns in keep."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[c.alias(n) for n, c in (keep or {}).items()], text.alias("_text"))
    rows = rows.select(*(keep or {}), *[spans_of(F.col("_text"), k).alias(f"_{k}") for k in KINDS])
    apart = F.when(F.size("_opaque") == 0, F.col("_opaque")).otherwise(F.filter("_opaque", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"]))))
    return rows.withColumn("base", F.concat("_assign", "_access", "_hex")).withColumn("opaque", apart).drop("_opaque")


def ownership(found: DataFrame, wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """(hash, owners, repositories, widespread) for each distinct candidate of found: (hash, owner, repository)."""
    held = found.select("hash", "owner", "repository").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")).withColumn("widespread", (F.col("owners") >= wide_owners) | (F.col("repositories") >= wide_repositories))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", keep: tuple[str, ...] = (), wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """Each row's doc_id, n_assign, n_access, n_hex, base, spans (arrays of spans; spans has the added ones too), n_live, n_widespread.

    Columns in ``keep`` follow, for instance the text. The spans hold start, end, kind and value, and in ``spans`` whether it is live.
    """
    columns = {"doc_id": F.col(id_col), "_owner": F.col(owner_col).cast("string"), "_repository": F.col(repository_col).cast("string")}
    columns |= {f"_keep_{c}": F.col(c) for c in keep}
    rows = candidates(docs, text_col, columns).withColumn("_row", F.monotonically_increasing_id())
    rows = checkpointed(rows.select("_row", *columns, *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in list(KINDS)[:3]], "base", "opaque"))
    found = rows.where((F.size("base") > 0) | (F.size("opaque") > 0)).select("_row", F.col("_owner").alias("owner"), F.col("_repository").alias("repository"), F.explode(F.concat("base", "opaque")).alias("span"))
    found = found.withColumn("hash", F.sha2(F.col("span.value").cast("binary"), 256))
    verdicts = spread(ownership(found, wide_owners, wide_repositories).withColumnRenamed("hash", "_hash"), "_hash")
    value = F.col("span.value")
    # What the whole value leaves of its alphabet says how many distinct characters it has.
    distinct = len(ALPHABET) - F.length(F.call_function("translate", F.lit(ALPHABET), value, F.lit("")))
    random = (distinct >= 8) & ~value.rlike(PLACEHOLDER)
    judged = found.join(verdicts, F.col("hash") == F.col("_hash")).withColumn("live", ~F.col("widespread") & random)
    judged = judged.where((F.col("span.kind") != "opaque") | F.col("live"))
    per_row = judged.groupBy("_row").agg(
        F.collect_list(F.struct("span.start", "span.end", "span.rank", "span.kind", "span.value", "live")).alias("spans"),
        F.count_if("live").alias("n_live"), F.count_if("widespread").alias("n_widespread"),
    ).withColumnRenamed("_row", "_of")
    whole = rows.join(spread(per_row, "_of"), F.col("_row") == F.col("_of"), "left")
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,value:string,live:boolean>>")
    return whole.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.coalesce("spans", none).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("n_widespread", F.lit(0)).cast("bigint").alias("n_widespread"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def redacted(text: Column, spans: Column, live_mark: str = "[SECRET]", example_mark: str = "[EXAMPLE]") -> Column:
    """The text with its spans replaced; spans that overlap become one mark (live, if the first of them is)."""
    start = F.struct(F.array().cast("array<struct<a:int,b:int,live:boolean>>").alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(False).alias("live"))

    def step(s: Column, x: Column) -> Column:
        row = F.struct(s["a"].alias("a"), s["b"].alias("b"), s["live"].alias("live"))
        return F.when(x["start"] < s["b"], F.struct(s["done"].alias("done"), s["a"].alias("a"), F.greatest(s["b"], x["end"]).alias("b"), (s["live"] | x["live"]).alias("live"))).otherwise(
            F.struct(F.when(s["a"] >= 0, F.concat(s["done"], F.array(row))).otherwise(s["done"]).alias("done"), x["start"].alias("a"), x["end"].alias("b"), x["live"].alias("live")))

    merged = F.aggregate(F.array_sort(spans), start, step, lambda s: F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"), s["live"].alias("live")))))
    pieces = let(merged, lambda m: F.concat(
        F.transform(m, lambda x, i: F.concat(
            let(F.when(i == 0, F.lit(0)).otherwise(F.element_at(m, F.greatest(i, F.lit(1)))["b"]), lambda last: F.substring(text, last + 1, x["a"] - last)),
            F.when(x["live"], F.lit(live_mark)).otherwise(F.lit(example_mark)))),
        F.array(let(F.element_at(m, -1)["b"], lambda last: F.substring(text, last + 1, F.lit(2147483647) - last - 1)))))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))


def oracle() -> str:
    """The scan of ``documents`` as DuckDB SQL; only the kinds' patterns and the placeholder words are shared with the operator.

    Letters of either case are written out, because that engine folds other letters onto ASCII ones too.
    """
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    patterns = KINDS | {"assign": f"(?:{'|'.join(map(either, ('password', 'passwd', 'secret', 'token', 'api_?key')))})" + KINDS["assign"].split(")", 1)[1]}
    q = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(f"SELECT r, {i} AS rank, {q(k)} AS kind, string_split_regex(t, {q(v)}) AS gaps, regexp_extract_all(t, {q(v)}) AS found FROM d" for i, (k, v) in enumerate(patterns.items()))
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, CAST(source AS VARCHAR) AS owner, CAST(doc_id AS VARCHAR) AS repository, coalesce(text, '') AS t FROM documents),
  f AS ({found}),
  u AS (SELECT r, rank, kind, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS hit, generate_subscripts(found, 1) AS i FROM f WHERE len(found) > 0),
  s AS (SELECT r, rank, kind, hit, CASE WHEN rank = 0 THEN regexp_extract(hit, {q(patterns["assign"])}, 1) ELSE hit END AS value, sum(length(gap) + length(hit)) OVER (PARTITION BY r, rank ORDER BY i) AS stop FROM u),
  k AS MATERIALIZED (SELECT r, rank, kind, value, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s
    WHERE (rank <> 0 OR length(value) >= 6) AND (rank <> 3 OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')))),
  c AS MATERIALIZED (SELECT * FROM k WHERE rank < 3 UNION ALL SELECT * FROM k o WHERE rank = 3 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.r = o.r AND b.rank < 3 AND b.start < o.stop AND o.start < b.stop)),
  h AS (SELECT DISTINCT value, owner, repository FROM c JOIN d USING (r)),
  w AS (SELECT value, count(DISTINCT coalesce('=' || owner, '')) >= {WIDE_OWNERS} OR count(*) >= {WIDE_REPOSITORIES} AS wide FROM h GROUP BY value),
  j AS (SELECT c.*, wide, NOT wide AND len(list_distinct(string_split(c.value, ''))) >= 8 AND NOT regexp_matches(c.value, {q(PLACEHOLDER)}) AS live FROM c JOIN w ON c.value = w.value),
  g AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (wide) AS n_widespread FROM j WHERE rank < 3 OR live GROUP BY r)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0) AS n_live, coalesce(n_widespread, 0) AS n_widespread FROM d LEFT JOIN g ON d.r = g.r"""
