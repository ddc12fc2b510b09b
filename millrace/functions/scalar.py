"""Column functions of the tabular pipeline: scaling, guards, string forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12

# Names that run stems are made of, in the order in which they are tried.
KINDS = ("input", "output", "internal")
SELECTORS = ("from_model", "sequential", "univariate", "variance", "pearson", "deep", "mcp", "rfe", "none")
MODELS = ("ft_transformer", "elasticnet", "rulefit", "gbdt", "mlp")
SPLITS = ("train", "val", "test")


def guarded(std: Column) -> Column:
    """A standard deviation that can be divided by: 0 counts as 1."""
    return F.when(std == 0, F.lit(1.0)).otherwise(std)


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / guarded(std)


def unscaled(z: Column, mean: Column, std: Column) -> Column:
    return z * guarded(std) + mean


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0).cast("bigint"))


def mcp_threshold(z: Column, lam: float, gamma: float, positive: bool = False) -> Column:
    """The minimax concave penalty's update of one coordinate of unit variance."""
    size = F.abs(z)
    shrunk = F.when(size <= lam, F.lit(0.0)).when(size <= gamma * lam, F.signum(z) * (size - lam) / (1 - 1 / gamma)).otherwise(z)
    return F.when(z < 0, F.lit(0.0)).otherwise(shrunk) if positive else shrunk


def stem(name: Column, suffix: str) -> Column:
    """A file name without its ending and the given suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), f"{suffix}$", "")


# Fixed values of the next two: how many letters stay on each side, and which letters a job may have.
def shortened(name: Column, longest: int) -> Column:
    return F.when(F.length(name) <= longest, name).otherwise(F.concat(F.substring(name, 1, 8), F.lit("..."), F.substring(name, -(longest - 11), longest - 11)))


def job_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), 1, 120)


def job_id(said: Column) -> Column:
    """The number in a batch system's answer, or null."""
    found = F.regexp_extract(said, r"Submitted batch job (\d+)", 1)
    return F.when(found != "", found)


# Fixed value: the form of a log's completion line.
DONE = r"(?m)INFO +pipeline +:: +done: +(\S.*report\.md) *$"


def last_report(log: Column) -> Column:
    """The report that a log's last completion line names, or null."""
    return F.try_element_at(F.regexp_extract_all(log, F.lit(DONE), F.lit(1)), F.lit(-1))


# The forms of a run's stem and folder.
#: module, kind, selector and model of a run's stem; the first kind name after the start that leaves a known setup counts.
STEM = rf"^(.+?)_({'|'.join(KINDS)})_({'|'.join(SELECTORS)})_({'|'.join(MODELS)})$"
RUN_DIR = r"^(.+)_(\d{8}_\d{6})$"


def stem_part(name: Column, part: int) -> Column:
    """1: module, 2: kind, 3: selector, 4: model; null where the stem isn't of that form."""
    found = F.regexp_extract(name, STEM, part)
    return F.when(found != "", found)


def rule_features(rule: Column, kind: Column, known: list[str]) -> Column:
    """Known features in a rule, in order and each once; a linear term is its own feature.

    A rule is conditions joined by " & " (or " and "); a condition is a feature, an operator and a number, with blanks between.
    """
    names = F.array(*map(F.lit, known))
    words = F.split(F.replace(rule, F.lit(" and "), F.lit(" & ")), " & ")
    first = lambda condition: F.array_join(F.slice(F.split(F.trim(condition), " "), 1, F.greatest(F.size(F.split(F.trim(condition), " ")) - 2, F.lit(1))), " ")
    terms = F.when(kind == "linear", F.array(rule)).otherwise(F.transform(words, first))
    return F.array_distinct(F.filter(terms, lambda x: F.array_contains(names, x)))


def significant(x: Column, digits: int) -> Column:
    """A number rounded to significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * scale) / scale)


def vector(columns: Sequence[str], *more: str) -> Column:
    """Columns as one array of doubles, and SQL expressions after them. One expression, so that thousands of columns take one call."""
    return F.expr("array(" + ", ".join([*[f"cast(`{c.replace('`', '``')}` as double)" for c in columns], *more]) + ")")
