"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to one Python step at most; texts are cut into such steps by size too.
STEP_ROWS = 512
STEP_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made, but in local mode (tests) only: elsewhere executors could not see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def restarted(df: DataFrame) -> DataFrame:
    """A checkpoint for iterations: the planner keeps nothing of what it knew or guessed of the rows.

    A plain checkpoint hands on estimated sizes. Each join multiplies its inputs' sizes, so over a few rounds the estimates
    get millions of digits, and planning takes minutes and the driver's memory.
    """
    spark, done = df.sparkSession, checkpointed(df)
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows for a join by ``keys`` (integers or strings), so that both sides get their own exchange and a skewed key can be split there.

    Rows that an aggregate has dealt by these keys would be taken as they lie. The keys are written in another form here, so that
    the planner doesn't know how the rows lie; that costs nothing, where a repartition would shuffle once more.
    """
    kind = dict(df.dtypes)
    same = {k: F.concat(F.col(k), F.lit("")) if kind[k] == "string" else F.col(k).bitwiseXOR(F.lit(0)).cast(kind[k]) for k in keys}
    return df.withColumns(same)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Frames made within drop their shuffle files as soon as they have run. For those that are checkpointed and not run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n: the fold that the held-out rows are chosen by."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches into steps of bounded rows and bytes, so that long texts don't pile up in a worker."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = 0
        while start < batch.num_rows:
            rows = min(STEP_ROWS, batch.num_rows - start)
            while rows > 1 and column.slice(start, rows).nbytes > STEP_BYTES:
                rows //= 2
            yield batch.slice(start, rows)
            start += rows


def out(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


class Recent(dict):
    """A cache of at most about twice ``room`` entries: when full, all become old; old ones met again are new again."""

    def __init__(self, make: Callable, room: int, longest: int) -> None:
        super().__init__()
        self.make, self.room, self.longest, self.old = make, room, longest, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What ``make`` gives, kept by this worker from task to task until another key is asked for.

    One thing only is kept, so that a worker that serves one operator after another holds the caches of the last.
    """
    if key not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def fitted(rows: DataFrame, order: list[Column], limit: int, fit: Callable[[pa.Table], object]) -> object:
    """``fit`` of the first ``limit`` rows in this order, run in one task; only the model comes to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(parts)))], pa.binary())], ["model"])

    made = rows.orderBy(*order).limit(limit).coalesce(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(made[0][0]) if made else None
