"""A grid of configurations from a folder to a manifest: finished ones are skipped, the others run side by side."""

from __future__ import annotations

import os
import threading
import time
import uuid

from pyspark.sql import SparkSession

from ..operators import experiments, jobs
from ..sources import config, sinks, tables
from . import run


def pending(spark: SparkSession, folder: str, output_root: str) -> tuple[list[str], list[str]]:
    """The folder's configurations that have no finished run, and the stems of those that have one."""
    found = {os.path.splitext(os.path.basename(p))[0]: p for p in config.discover(folder)}
    done = experiments.finished(tables.logs(spark, output_root), tables.report_paths(spark, output_root))
    wanted = spark.createDataFrame([(s,) for s in found], "stem string")
    left = {r["stem"] for r in experiments.unfinished(wanted, done, "stem").collect()}  # one row a configuration
    return [found[s] for s in sorted(left)], sorted(set(found) - left)


def run_grid(spark: SparkSession, folder: str, output_root: str, base: str = ".", at_once: int = 2, n_trials: int = 5, trials_at_once: int = 1, limit: float | None = None) -> dict:
    """Run what isn't finished, ``at_once`` at a time, each in a pool of the fair scheduler by its algorithm; a run that takes longer than ``limit`` seconds is cancelled.

    The manifest (also at output_root/manifest.json, written at once as a whole) says of each configuration whether it was skipped, completed or failed, where
    its run is, and how long it took. A failed or cancelled run doesn't stop the others and is run again next time.
    """
    todo, skipped = pending(spark, folder, output_root)
    os.makedirs(output_root, exist_ok=True)
    sc = spark.sparkContext

    def work(path: str) -> dict:
        tag, began, over = f"run-{uuid.uuid4().hex}", time.monotonic(), threading.Event()
        sc.setLocalProperty("spark.scheduler.pool", os.path.splitext(os.path.basename(path))[0])
        sc.addJobTag(tag)

        def watch() -> None:
            if not over.wait(limit):
                while not over.wait(0.5):  # a run may be between two jobs
                    sc.cancelJobsWithTag(tag)

        if limit is not None:
            threading.Thread(target=watch, daemon=True).start()
        try:
            c, result = run.run(spark, path, output_root, base, n_trials, trials_at_once)
            best = {r["split"]: r["r2"] for r in result.metrics.select("split", "r2").collect()}
            return {"status": "completed", "run_dir": c.run_dir, "r2": best, "seconds": round(time.monotonic() - began, 3)}
        finally:
            over.set()
            sc.removeJobTag(tag)
            sc.setLocalProperty("spark.scheduler.pool", None)

    made = {s: {"status": "skipped"} for s in skipped}
    for path, result, error in jobs.run_bounded(todo, work, at_once):
        made[os.path.splitext(os.path.basename(path))[0]] = result or {"status": "failed", "error": error[:300]}
    manifest = {"folder": os.path.abspath(folder), "runs": dict(sorted(made.items()))}
    sinks.write_atomically(os.path.join(output_root, "manifest.json"), manifest)
    return manifest
