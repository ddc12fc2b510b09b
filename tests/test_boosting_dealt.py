"""Boosting's blocks are dealt to as many tasks as their bytes ask for, wherever the rows lay."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import boosting


def test_blocks_of_one_partition_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    rows = spark.createDataFrame([(i, float(a), float(b), float(a * b)) for i, (a, b) in enumerate(x)], "split_row_idx bigint, a double, b double, y double").coalesce(1)
    grow = lambda: boosting.boost(rows, rows.limit(0), ["a", "b"], 2, 2, 0.3, patience=None)
    lone, used = grow(), []
    whole = boosting.level_sums

    def watched(blocks, *args):
        used.append(blocks.select(F.spark_partition_id().alias("p")).distinct().count())
        return whole(blocks, *args)

    monkeypatch.setattr(boosting, "BLOCK_BYTES", 512)
    monkeypatch.setattr(boosting, "TASK_BYTES", 1024)
    monkeypatch.setattr(boosting, "level_sums", watched)
    dealt = grow()
    assert min(used) >= 3
    assert np.allclose(lone.predict(x), dealt.predict(x))
