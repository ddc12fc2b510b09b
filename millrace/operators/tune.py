"""Hyper-parameter search: seeded trials, each chosen by what the ones before it scored (R2 on the validation rows)."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import transformer  # noqa: F401  it registers its model
from .models import REGISTRY, Regressor
from .stats import metrics


STARTS = 10  # random trials before the search looks at scores
CANDIDATES = 24


def drawn(rng: np.random.Generator, kind: str, args: tuple) -> object:
    """A value at random."""
    if kind == "choice":
        return args[0][int(rng.integers(len(args[0])))]
    if kind == "int":
        return int(rng.integers(args[0], args[1] + 1))
    return float(math.exp(rng.uniform(math.log(args[0]), math.log(args[1])))) if kind == "log" else float(rng.uniform(args[0], args[1]))


class Density:
    """What values some trials had, and that any other may do: counts plus one, or normal curves and one as wide as the range."""

    def __init__(self, kind: str, args: tuple, seen: list) -> None:
        self.kind, self.args = kind, args
        if kind == "choice":
            self.share = np.array([1.0 + sum(v == c for v in seen) for c in args[0]])
            self.share /= self.share.sum()
            return
        self.low, self.high = (math.log(args[0]), math.log(args[1])) if kind == "log" else (float(args[0]), float(args[1]))
        self.at = np.sort([(self.low + self.high) / 2, *[math.log(v) if kind == "log" else float(v) for v in seen]])
        span = max(self.high - self.low, 1e-12)
        edges = np.concatenate(([self.low], self.at, [self.high]))
        self.width = np.clip(np.maximum(np.diff(edges)[1:], np.diff(edges)[:-1]), span / min(100, 1 + len(self.at)), span)
        self.width[np.argmin(np.abs(self.at - (self.low + self.high) / 2))] = span

    def draw(self, rng: np.random.Generator) -> object:
        if self.kind == "choice":
            return self.args[0][int(rng.choice(len(self.share), p=self.share))]
        i = int(rng.integers(len(self.at)))
        v = float(np.clip(rng.normal(self.at[i], self.width[i]), self.low, self.high))
        return int(round(v)) if self.kind == "int" else math.exp(v) if self.kind == "log" else v

    def log(self, v: object) -> float:
        if self.kind == "choice":
            return float(np.log(self.share[self.args[0].index(v)]))
        x = math.log(v) if self.kind == "log" else float(v)
        return float(np.log(np.mean(np.exp(-0.5 * ((x - self.at) / self.width) ** 2) / self.width) + 1e-300))


def proposed(space: dict[str, tuple], done: list[tuple[dict, float]], rng: np.random.Generator) -> dict:
    """The next parameter set: at random at first, then, for each parameter, of some values drawn as the best trials have them, the one
    that is likeliest among those against all others. Failed trials count among the others."""
    if len(done) < STARTS:
        return {name: drawn(rng, kind, tuple(args)) for name, (kind, *args) in space.items()}
    ranked = [hp for hp, _ in sorted(done, key=lambda t: -t[1])]
    cut, made = min(25, math.ceil(0.1 * len(ranked))), {}
    for name, (kind, *args) in space.items():
        good, rest = (Density(kind, tuple(args), [hp[name] for hp in part]) for part in (ranked[:cut], ranked[cut:]))
        made[name] = max((good.draw(rng) for _ in range(CANDIDATES)), key=lambda v: good.log(v) - rest.log(v))
    return made


def importances(trials: DataFrame, study: str = "study", parts: int = 4) -> DataFrame:
    """(study, param, importance): the share of the scores' variance that lies between ranges of a parameter's values, in shares that add up to one.

    trials: study, params map<string,string>, score. Numbers are cut into equal ranges; other values stand for themselves. Trials
    without a finite score are left out, as are studies whose trials say nothing (fewer than two, equal scores).
    """
    rows = trials.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).select(study, "score", F.explode("params").alias("param", "value"))
    rows = rows.withColumn("x", F.expr("try_cast(value AS double)"))
    wide = rows.groupBy(study, "param").agg(F.min("x").alias("low"), F.max("x").alias("high"), (F.count("x") == F.count("*")).alias("number"), F.avg("score").alias("mean"), F.var_pop("score").alias("var"), F.count("*").alias("n"))
    of = F.least(F.lit(parts - 1), F.floor((F.col("x") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * parts))
    each = rows.join(wide, [study, "param"]).withColumn("part", F.when(F.col("number"), F.coalesce(of, F.lit(0)).cast("string")).otherwise(F.col("value")))
    sums = each.groupBy(study, "param", "mean", "var", "n", "part").agg(F.count("*").alias("k"), F.avg("score").alias("m"))
    shares = sums.groupBy(study, "param", "var", "n").agg(F.sum(F.col("k") * (F.col("m") - F.col("mean")) ** 2).alias("between")).where((F.col("n") > 1) & (F.col("var") > 0))
    shares = shares.select(study, "param", (F.col("between") / F.col("n") / F.col("var")).alias("share"))
    total = shares.groupBy(study).agg(F.sum("share").alias("total")).where("total > 0")
    return shares.join(total, study).select(study, "param", (F.col("share") / F.col("total")).alias("importance"))


def study(algorithm: str, train: DataFrame, val: DataFrame, columns: Sequence[str], fixed: dict | None = None, n_trials: int = 5, seed: int = 42, timeout: float = 300, at_once: int = 1, **flags) -> tuple[Regressor, dict, DataFrame]:
    """The best trial's model, its parameters, and the trials: (trial, params, score, status). Failed trials score -inf.

    Trials run ``at_once`` side by side, each round proposed as a whole: those before it in its round count as done, with the middle
    score so far, so that proposals depend on seed and scores only. At the timeout, running trials are cancelled as soon
    as any has ended well; without one, the search goes on until the first does. The best trial's model is the final one: a
    refit with the same parameters, rows and seed would give the same.
    """
    if not val.limit(1).count():
        raise ValueError("a search needs validation rows")
    kind, rows, best, sc = REGISTRY[algorithm], [], None, train.sparkSession.sparkContext
    space, done, rng = {k: v for k, v in kind.space().items() if k not in (fixed or {})}, [], np.random.default_rng(seed)
    end = time.monotonic() + timeout

    def attempt(hp: dict, tag: str) -> tuple[Regressor | None, float, str]:
        sc.addJobTag(tag)
        try:
            model = kind(seed=seed, **flags).fit(train, val, columns, hp)
            return model, float(metrics(model.predict(val).withColumn("split", F.lit("val"))).first()["r2"]), "complete"
        except Exception as e:  # a trial may fail in any way; the search goes on
            return None, float("-inf"), f"failed: {e}"[:200]
        finally:
            sc.removeJobTag(tag)

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        while len(rows) < n_trials and (best is None or time.monotonic() < end):
            scores, round_ = sorted(s for _, s in done if math.isfinite(s)), []
            middle = scores[len(scores) // 2] if scores else 0.0
            for _ in range(min(max(1, at_once), n_trials - len(rows))):
                free = proposed(space, [*done, *[(f, middle) for f, _, _ in round_]], rng)
                round_.append((free, free | (fixed or {}), f"trial-{uuid.uuid4().hex}"))
            running = {pool.submit(inheritable_thread_target(train.sparkSession)(attempt), hp, tag): tag for _, hp, tag in round_}  # trials stay in the caller's pool
            well = best is not None
            while left := [f for f in running if not f.done()]:
                well = well or any(f.done() and f.result()[0] is not None for f in running)
                if well and time.monotonic() >= end:
                    for f in left:  # again and again, as a trial may be between two jobs
                        sc.cancelJobsWithTag(running[f])
                wait(left, timeout=1 if well and time.monotonic() >= end else max(0.05, min(1.0, end - time.monotonic())), return_when=FIRST_COMPLETED)
            for (free, hp, _), f in zip(round_, running, strict=True):
                model, score, status = f.result()
                done.append((free, score if math.isfinite(score) else float("-inf")))
                rows.append((len(rows), {k: str(v) for k, v in hp.items()}, score, status))
                if model is not None and not math.isnan(score) and (best is None or score > best[0]):
                    best = (score, model, hp)
    if best is None:
        raise ValueError(f"all trials failed: {rows[-1][3]}")
    trials = train.sparkSession.createDataFrame(rows, "trial int, params map<string,string>, score double, status string")
    return best[1], best[2], trials
