"""Conjunctions of thresholds as columns, and what a rule ensemble says of features."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rule_features, vector
from .stats import PARTS, Gram, added_grams

_TERM = re.compile(r"^(.*?)\s*(<=|>=|==|!=|<|>)\s*(-?\d+\.?\d*(?:[eE][+-]?\d+)?)$")


_HOLDS = {"<=": np.less_equal, ">=": np.greater_equal, "<": np.less, ">": np.greater, "==": np.equal, "!=": np.not_equal}


class Bitmaps:
    """Rules as conditions on columns by their place; what holds for a block of rows is a bit map a rule, 64 rows a word."""

    def __init__(self, rules: Sequence[str], columns: Sequence[str]) -> None:
        at, number = {c: i for i, c in enumerate(columns)}, {}
        self.rules: list[list[int]] = []
        for r in rules:
            terms = [_TERM.match(t.strip()).groups() for t in re.split(r"\s+&\s+|\s+and\s+", r)]
            self.rules.append([number.setdefault((at[c], op, float(v)), len(number)) for c, op, v in terms])
        self.conditions = list(number)

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rules, words) for rows x; a missing value fulfils nothing but !=."""
        words = -(-len(x) // 64)
        held = np.zeros((len(self.conditions), words * 8), np.uint8)
        columns = np.ascontiguousarray(x.T)
        for i, (c, op, v) in enumerate(self.conditions):
            bits = np.packbits(_HOLDS[op](columns[c], v), bitorder="little")
            held[i, : len(bits)] = bits
        held = held.view(np.uint64)
        made = np.empty((len(self.rules), words), np.uint64)
        for i, conditions in enumerate(self.rules):
            made[i] = np.bitwise_and.reduce(held[conditions], axis=0)
        return made

    @staticmethod
    def together(bits: np.ndarray) -> np.ndarray:
        """(rules, rules): in how many rows both hold."""
        made = np.empty((len(bits), len(bits)), np.int64)
        for i in range(len(bits)):
            made[i, i:] = np.bitwise_count(bits[i:] & bits[i]).sum(1, dtype=np.int64)
            made[i:, i] = made[i, i:]
        return made

    @staticmethod
    def totals(bits: np.ndarray, z: np.ndarray, step: int = 256) -> np.ndarray:
        """(rules, numbers): each number's sum over the rows where the rule holds."""
        made = np.empty((len(bits), z.shape[1]))
        for i in range(0, len(bits), step):
            made[i : i + step] = np.unpackbits(bits[i : i + step].view(np.uint8), axis=1, count=len(z), bitorder="little").astype(np.float64) @ z
        return made


def rule_grams(df: DataFrame, columns: Sequence[str], scales: Sequence[float], rules: Sequence[str], fold: Column, y: str = "y") -> dict[int, Gram]:
    """The Gram of each fold of scaled columns and rules' indicators, in one pass without a column a rule.

    Rules meet by AND and a count of bits, rules and numbers by masked sums. A task holds R x R counts and R x (p + 2) sums for each
    fold that it meets (R rules, p columns); the matrix that comes to the driver has (p + R + 2) squared numbers a fold.
    """
    p, R, factors = len(columns), len(rules), np.array([*scales, 1.0, 1.0])
    maps = Bitmaps(rules, columns)
    schema = pa.schema([("fold", pa.int32()), ("row", pa.int32()), ("v", pa.list_(pa.float64()))])
    packed = df.select(fold.cast("int").alias("fold"), vector([*columns, y]).alias("z"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            which = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1)
            for k in np.unique(which):
                own = x[which == k]
                bits = maps.of(own)
                z = np.hstack((own, np.ones((len(own), 1)))) * factors
                made = [maps.together(bits), maps.totals(bits, z), z.T @ z]
                held[int(k)] = [s + m for s, m in zip(held[int(k)], made, strict=True)] if int(k) in held else made
        for k, (rr, rz, zz) in held.items():
            # Rows of the whole matrix in the order columns, rules, y, ones.
            whole = lambda left, middle: np.hstack((left[:, :p], middle, left[:, p:]))
            for at, part in ((range(p), whole(zz[:p], rz[:, :p].T)), (range(p, p + R), whole(rz, rr)), (range(p + R, p + R + 2), whole(zz[p:], rz[:, p:].T))):
                for i in range(0, len(part), 64):
                    rows = part[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.array(at[i : i + 64], pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], schema=schema)

    return added_grams(packed.mapInArrow(work, PARTS), p + R)


def compiled(rule: str) -> Column:
    """A rule's truth as a boolean column."""
    made = F.lit(True)
    for term in re.split(r"\s+&\s+|\s+and\s+", rule):
        name, op, value = _TERM.match(term.strip()).groups()
        c, v = F.col(f"`{name}`"), float(value)
        made = made & {"<=": c <= v, ">=": c >= v, "<": c < v, ">": c > v, "==": c == v, "!=": c != v}[op]
    return made


def indicators(df: DataFrame, rules: Sequence[str], prefix: str = "rule_") -> DataFrame:
    return df.withColumns({f"{prefix}{i}": compiled(r).cast("double") for i, r in enumerate(rules)})


def rule_support(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """(rule_id, n_true, support), in one pass."""
    row = df.agg(*[F.count_if(compiled(r)).alias(f"n{i}") for i, r in enumerate(rules)], F.count("*").alias("n"))
    stack = ", ".join(f"{i}, n{i}, n{i} / n" for i in range(len(rules)))
    return row.selectExpr(f"stack({len(rules)}, {stack}) as (rule_id, n_true, support)")


def rule_table(spark: SparkSession, df: DataFrame, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """(rule, type, coef, support) of rules and linear terms (support 1)."""
    texts = [r for r, kind, _ in rules if kind == "rule"]
    support = dict(zip(texts, [r["support"] for r in sorted(rule_support(df, texts).collect(), key=lambda r: r["rule_id"])], strict=True)) if texts else {}
    return spark.createDataFrame([(r, kind, float(c), float(support.get(r, 1.0))) for r, kind, c in rules], "rule string, type string, coef double, support double")


def importance(rules: DataFrame, known: list[str]) -> DataFrame:
    """Each rule's |coef| * support, shared evenly by its features."""
    parts = rules.withColumn("features", rule_features(F.col("rule"), F.col("type"), known)).where(F.size("features") > 0)
    weight = F.abs("coef") * F.col("support") / F.size("features")
    return parts.select(F.explode("features").alias("feature"), weight.alias("w")).groupBy("feature").agg(F.sum("w").alias("importance"))


def cooccurrence(rules: DataFrame, known: list[str]) -> DataFrame:
    """(feature_i, feature_j, weight): |coef| * support of the rules that hold both."""
    parts = rules.where("type = 'rule'").withColumn("features", rule_features(F.col("rule"), F.col("type"), known)).where(F.size("features") > 1)
    weight = (F.abs("coef") * F.col("support")).alias("w")
    first = parts.select("features", weight, F.explode("features").alias("feature_i"))
    both = first.select("feature_i", "w", F.explode("features").alias("feature_j")).where("feature_i <> feature_j")
    return both.groupBy("feature_i", "feature_j").agg(F.sum("w").alias("weight"))
