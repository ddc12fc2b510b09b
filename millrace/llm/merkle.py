"""Merkle manifest: a digest for a whole table, one for each group of its rows, and a proof for every row.

A leaf is the SHA-256 of a row's fields, each as ``-`` where it is null and else as its UTF-8 byte count, a colon and its value.
In each group, leaves stand in order; while several nodes remain, every ``FAN`` consecutive ones become the digest of their
digests' hex texts. What remains is the group's subroot; subroots in order of their groups' names become the root likewise.

Build: each level is persisted as runs of at most ``FAN`` children (written to the shared folder), so no task holds a group,
however large. Proofs go down from the root: a level's runs meet their own nodes in the level above, and each child puts
its siblings in front of the steps that the run has inherited. The lowest level is only unfolded, not joined.

Defined results: null ids, groups and fields are values of their own (null group and id first in order). Rows with the same id
stand in order of their leaves; equal rows have equal leaves, each with its own place and proof. An empty text differs from
a null one. Texts are hashed whole, at any length. A group of one row has that leaf as its subroot, and a table of one
group its subroot as root; a proof without siblings is the empty text. Empty tables give no rows. Other columns than the
ones named are neither hashed nor kept, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, checkpointed, spread

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Groups (one small row each) that are broadcast to number their rows; beyond it they are joined by shuffles.
FEW_GROUPS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, _UPPER, _LOWER)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, in this order."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """The rows with ``i``, their place from 0 in this order: by ranges, and offsets from the ranges' row counts (one row for each partition)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = checkpointed(rows.withColumn("_part", F.shiftright("_at", 33)))
    parts = rows.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", (before - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(parts), "_part").select(*df.columns, (F.col("_at") + F.col("_shift")).alias("i"))


def depth(n: int) -> int:
    """Levels of runs above n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def build(nodes: DataFrame, levels: int, *payload: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Bottom-up: the persisted runs of each level, and for each level (the topmost included) the groups that end there, with their root.

    nodes: g (group), n (nodes of the group in this level), idx, h, and the payload of leaves, which the lowest runs keep.
    """
    runs, roots = [], []
    for k in range(levels + 1):
        roots.append(nodes.where("n = 1").select("g", "h"))
        if k == levels:
            break
        kid = F.struct("idx", "h", *(payload if k == 0 else ()))
        made = nodes.where("n > 1").groupBy("g", "n", F.expr(f"idx div {FAN}").alias("run")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))  # FAN rows at most
        runs.append(checkpointed(made.withColumn("all", F.array_join(F.col("kids.h"), ""))))
        nodes = runs[-1].select("g", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("run").alias("idx"), digest(F.col("all")).alias("h"))
    return runs, roots


def push(runs: list[DataFrame], tops: DataFrame, *payload: str) -> DataFrame | None:
    """Top-down: (g, subroot, steps) and kid's idx, h and payload, for all leaves that lie in runs; None without runs.

    tops: g, level (that the group's root lies on), subroot, steps (of the root itself). A step is (left, right): the joined
    digests of the siblings on either side.
    """
    above = None
    for k in reversed(range(len(runs))):
        ends = tops.where(F.col("level") == k + 1).select("g", F.lit(0).cast("bigint").alias("run"), "subroot", "steps")
        above = ends if above is None else above.select("g", F.col("kid.idx").alias("run"), "subroot", "steps").unionByName(ends)
        met = spread(runs[k], "g", "run").join(spread(above, "g", "run"), ["g", "run"]).select("g", "all", "subroot", "steps", F.posexplode("kids").alias("at", "kid"))
        step = F.struct(F.expr("substring(all, 1, 64 * at)").alias("left"), F.expr("substring(all, 64 * at + 65)").alias("right"))
        above = met.select("g", "kid", "subroot", F.concat(F.array(step), "steps").alias("steps"))
    return above


_NO_STEPS = "cast(array() as array<struct<left: string, right: string>>)"


def manifest(leaves: DataFrame, group: str, order: str, *payload: str) -> DataFrame:
    """(group, order, leaf, payload, subroot, root, steps) for rows that have a ``leaf``; payload columns go along unread."""
    cols = dict.fromkeys((group, order, "leaf", *payload))
    rows = numbered(checkpointed(leaves.select(*[F.col(c).alias(f"p_{c}") for c in cols])), f"p_{group}", f"p_{order}", "p_leaf")
    groups = rows.groupBy(F.col(f"p_{group}").alias("_group")).agg(F.min("i").alias("first"), F.count("*").alias("n"))
    groups = checkpointed(numbered(groups, "_group").withColumnRenamed("i", "g"))
    some = groups.agg(F.count("*").alias("groups"), F.max("n").alias("most")).first()
    levels, upper = depth(some["most"] or 0), depth(some["groups"])

    named = F.broadcast(groups) if some["groups"] <= FEW_GROUPS else groups
    nodes = rows.join(named, F.col(f"p_{group}").eqNullSafe(F.col("_group"))).select("g", "n", (F.col("i") - F.col("first")).alias("idx"), F.col("p_leaf").alias("h"), *[f"p_{c}" for c in cols])
    held = [f"p_{c}" for c in cols]
    runs, roots = build(nodes, levels, *held)

    # The upper tree: one leaf for each group.
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)
    subroots = checkpointed(subroots)
    top_runs, top_roots = build(subroots.select(F.lit(0).cast("bigint").alias("g"), F.lit(some["groups"]).cast("bigint").alias("n"), F.col("g").alias("idx"), "h"), upper)
    root = top_roots[upper].first()  # one row, or none of an empty table
    root = F.lit(root["h"] if root else None).cast("string")
    top = push(top_runs, subroots.sparkSession.range(1).select(F.col("id").alias("g"), F.lit(upper).alias("level"), F.lit("").alias("subroot"), F.expr(_NO_STEPS).alias("steps")))
    top = subroots.select(F.col("g").alias("_g"), "h", F.expr(_NO_STEPS).alias("steps")) if top is None else top.select(F.col("kid.idx").alias("_g"), F.col("kid.h").alias("h"), "steps")
    level = F.lit(0)
    for k in range(levels):
        level = F.when(F.col("n") > FAN**k, k + 1).otherwise(level)
    tops = checkpointed(top.join(groups, F.col("_g") == F.col("g")).select("g", level.alias("level"), F.col("h").alias("subroot"), "steps"))

    lone = nodes.where("n = 1").join(tops.where("level = 0"), "g").select(*held, "subroot", "steps")
    below = push(runs, tops, *held)
    found = lone if below is None else below.select(*[F.col(f"kid.{c}").alias(c) for c in held], "subroot", "steps").unionByName(lone)
    return found.select(*[F.col(f"p_{c}").alias(c) for c in cols], "subroot", root.alias("root"), "steps")


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings from the leaf's run up to the root, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, start, lambda at, s: digest(F.concat(s["left"], at, s["right"])))


def audited(docs: DataFrame) -> DataFrame:
    """Each document's leaf and proof, and whether its proof still gives the root after texts were tampered with (one id in three, by crc32)."""
    hit = bucket(F.col("doc_id"), 3) == 0
    texts = {True: lowered(F.col("text")), False: F.col("text")}
    of = lambda changed: leaf(*[texts[changed] if c == "text" else F.col(c) for c in FIELDS])
    leaves = docs.select("lang", "doc_id", of(False).alias("leaf"), F.when(hit, of(True)).alias("tampered"))
    found = manifest(leaves, "lang", "doc_id", "tampered")
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("steps")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# ---------------------------------------------------------------- the same in DuckDB SQL, for groups of at most FAN ** levels rows

_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"


def _tree(name: str, g: str, source: str, levels: int) -> str:
    """CTEs name0..nameL: nodes (g, idx, n, h) of each level; a group's single node goes up as it is."""
    made = [f"{name}0 AS (SELECT {g} AS g, idx, n, h FROM {source})"]
    for k in range(levels):
        made.append(f"{name}{k + 1} AS (SELECT g, idx // {FAN} AS idx, (max(n) + {FAN - 1}) // {FAN} AS n, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}{k} GROUP BY g, idx // {FAN})")
    return ", ".join(made)


def _climb(name: str, start: str, levels: int, prefix: str) -> str:
    """CTEs prefix0..prefixL: rows with the place idx, the proof so far and the folded digest at each level."""
    made = [f"{prefix}0 AS ({start})"]
    for k in range(levels):
        made.append(f"""{prefix}{k + 1} AS (SELECT b.* EXCLUDE (idx, proof, fold), b.idx // {FAN} AS idx, b.proof || coalesce(s.lft, '') || coalesce(s.rgt, '') AS proof,
  CASE WHEN s.g IS NULL THEN b.fold ELSE sha256(s.lft || b.fold || s.rgt) END AS fold
  FROM {prefix}{k} b LEFT JOIN (SELECT g, idx, coalesce(string_agg(h, '' ORDER BY idx) OVER (PARTITION BY g, idx // {FAN} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(h, '' ORDER BY idx) OVER (PARTITION BY g, idx // {FAN} ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}{k} WHERE n > 1) s ON b.g = s.g AND b.idx = s.idx)""")
    return ", ".join(made)


def oracle(levels: int = 6, upper: int = 3) -> str:
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    of = lambda text: "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""WITH t0 AS (SELECT doc_id, lang, {of("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN {of(low)} END AS tampered FROM documents),
  names AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM t0 GROUP BY lang),
  t AS (SELECT t0.*, names.g, names.n, row_number() OVER (PARTITION BY names.g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h FROM t0 JOIN names ON t0.lang IS NOT DISTINCT FROM names.lang),
  {_tree("a", "g", "t", levels)},
  u AS (SELECT g AS idx, h, count(*) OVER () AS n FROM a{levels}), {_tree("b", "0", "u", upper)},
  {_climb("a", "SELECT doc_id, leaf, g, idx, '' AS proof, coalesce(tampered, leaf) AS fold FROM t", levels, "p")},
  {_climb("b", f"SELECT doc_id, leaf, g AS lang_g, 0 AS g, g AS idx, proof, fold FROM p{levels}", upper, "q")}
  SELECT q.doc_id, q.leaf, s.h AS subroot, r.h AS root, sha256(q.proof) AS proof_sha256, q.fold AS folded_root, q.fold = r.h AS verified
  FROM q{upper} q JOIN a{levels} s ON s.g = q.lang_g CROSS JOIN b{upper} r"""
