"""Jobs of a grid of configurations: inventory, routing, worker batches, preview, manifest, and a bounded pool that runs them."""

from __future__ import annotations

import concurrent.futures
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .experiments import round_robin

# The two pools that nodes belong to.
POOLS = ("gpu", "cpu")


def checked_count(value: object) -> int:
    """A positive whole number, from an argument's text."""
    n = int(str(value))
    if n < 1:
        raise ValueError(f"{value} must be 1 or more")
    return n


def checked_nodes(value: str, count: int | None = None) -> list[str]:
    """The pools of nodes from a comma-separated argument; with ``count``, there must be as many."""
    nodes = [x.strip() for x in value.split(",")]
    if "" in nodes:
        raise ValueError("a node's pool must not be empty")
    if unknown := sorted(set(nodes) - set(POOLS)):
        raise ValueError(f"unknown pools {unknown}; there are {sorted(POOLS)}")
    if count is not None and len(nodes) != count:
        raise ValueError(f"{len(nodes)} pools for {count} nodes")
    return nodes


def routing(nodes: Sequence[str]) -> str:
    """Which algorithms go to GPU nodes: all (there are no others), none (there are none) or selected ones."""
    return {("gpu",): "all", ("cpu",): "none"}.get(tuple(sorted(set(nodes))), "selected")


def pool_of(algorithm: Column, nodes: Sequence[str], gpu_algorithms: Iterable[str]) -> Column:
    mode = routing(nodes)
    if mode != "selected":
        return F.lit("gpu" if mode == "all" else "cpu")
    return F.when(algorithm.isin(*gpu_algorithms), "gpu").otherwise("cpu")


def batches(jobs: DataFrame, nodes: Sequence[str], gpu_algorithms: Iterable[str], order: Sequence[str], algorithm: str = "algorithm") -> DataFrame:
    """Jobs with their pool and, dealt in order, their worker within it."""
    workers = {p: list(nodes).count(p) for p in POOLS if p in nodes}
    return round_robin(jobs.withColumn("pool", pool_of(F.col(algorithm), nodes, gpu_algorithms)), "pool", order, workers)


def preview(dealt: DataFrame, name: str, first: int = 5) -> DataFrame:
    """(pool, worker, n, jobs): each worker's number of jobs, and its first few in order, without running any.

    A part of a worker's jobs gives its own first few, so no task holds all of a worker's jobs.
    """
    few = lambda c: F.slice(F.array_sort(c), 1, first)
    parts = dealt.groupBy("pool", "worker", F.pmod(F.xxhash64(name), F.lit(64)).alias("part"), F.col(name).alias("job")).agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("pool", "worker", "part").orderBy("job"))
    parts = parts.withColumn("at", at).groupBy("pool", "worker", "part").agg(F.sum("n").alias("n"), F.flatten(F.collect_list(F.when(F.col("at") <= first, F.array_repeat("job", F.least(F.col("n"), F.lit(first)).cast("int"))))).alias("jobs"))
    whole = parts.groupBy("pool", "worker").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("jobs")).alias("jobs"))  # 64 parts of a few
    return whole.select("pool", "worker", "n", F.array_join(few(F.col("jobs")), ",").alias("jobs"))


def manifest(dealt: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """(pool, worker, job, n, jobs_crc): what was submitted; answers: pool, worker and job (the batch system's number)."""
    sums = dealt.groupBy("pool", "worker").agg(F.count("*").alias("n"), F.sum(F.crc32(F.col(name).cast("binary"))).alias("jobs_crc"))
    return sums.join(answers, ["pool", "worker"], "left").select("pool", "worker", "job", "n", "jobs_crc")


def run_bounded(jobs: Sequence[object], work: Callable[[object], object], at_once: int) -> list[tuple[object, object, str]]:
    """(job, result, error) of each job in order, at most ``at_once`` at a time; a failed job doesn't stop the others."""
    with concurrent.futures.ThreadPoolExecutor(max_workers=checked_count(at_once)) as pool:
        waiting = [(job, pool.submit(work, job)) for job in jobs]
        return [(job, None if (e := f.exception()) else f.result(), f"{type(e).__name__}: {e}" if e else "") for job, f in waiting]
