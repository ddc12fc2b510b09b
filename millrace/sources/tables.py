"""Feature and label tables, one file or folder a benchmark: <stem>_func and <stem>_pwr, as Parquet or as pickled pandas frames (.pkl).

All files of a kind are one scan, whatever their number: a row's place is its place in its file, after the rows of the folder's files
before it (a small table of counts, one row a file). Column names come from the files' footers, or with the rows of pickles.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frame import align_rows, check_same_columns


def stem_of(path: str, suffix: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    name = name.rsplit(".", 1)[0] if "." in name else name
    return name.removesuffix(suffix)


def by_stem(paths: Sequence[str], suffix: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for p in paths:
        if (s := stem_of(p, suffix)) in found:
            raise ValueError(f"two files of stem {s}: {found[s]}, {p}")
        found[s] = p
    return found


# ---------------------------------------------------------------- pickles

# The names that pickled frames of numbers and their indexes are made of.
ADMITTED = {
    ("builtins", "slice"), ("builtins", "bytearray"), ("_codecs", "encode"),
    ("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy.core.numeric", "_frombuffer"),
    ("numpy._core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"),
    ("pandas", "DataFrame"), ("pandas", "Series"), ("pandas", "Index"), ("pandas", "RangeIndex"), ("pandas.core.frame", "DataFrame"), ("pandas.core.series", "Series"),
    ("pandas.core.indexes.base", "Index"), ("pandas.core.indexes.base", "_new_Index"), ("pandas.core.indexes.range", "RangeIndex"), ("pandas.core.indexes.numeric", "Int64Index"),
    ("pandas.core.internals.managers", "BlockManager"), ("pandas.core.internals.managers", "SingleBlockManager"), ("pandas._libs.internals", "_unpickle_block"), ("pandas._libs.internals", "BlockManager"),
    ("pandas.core.arrays.string_", "StringArray"), ("pandas.core.arrays.string_", "StringDtype"), ("pandas._libs.arrays", "__pyx_unpickle_NDArrayBacked"),
}


class Unpickler(pickle.Unpickler):
    """Loads frames of numbers only: any other name in a file is refused before it is looked up, so a file can't run code."""

    def find_class(self, module: str, name: str) -> object:
        if (module, name) not in ADMITTED:
            raise pickle.UnpicklingError(f"a table's file may not hold {module}.{name}")
        return super().find_class(module, name)


def unpickled(data: bytes) -> pd.DataFrame:
    found = Unpickler(io.BytesIO(data)).load()
    found = found.to_frame() if isinstance(found, pd.Series) else found
    if not isinstance(found, pd.DataFrame):
        raise pickle.UnpicklingError(f"a table's file holds {type(found).__name__}, not a frame")
    return found


def _pickles(spark: SparkSession, of: dict[str, str], columns: Sequence[str] | None, suffix: str) -> DataFrame:
    """One row a file becomes its rows: read by Spark from whatever store, unpickled where they are read; a file is as a whole in its task."""
    files = spark.read.format("binaryFile").load(list(of.values())).select("path", "content")
    if columns is None:

        def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array([[str(c) for c in unpickled(data.as_py()).columns]])], ["names"])

        first = spark.read.format("binaryFile").load(next(iter(of.values()))).select("content")
        columns = [c for c in first.mapInArrow(header, "names array<string>").first()["names"] if c != "row_idx"]
        whole = list(columns)
    else:
        whole = None
    names = list(columns)
    schema = T.StructType([T.StructField("benchmark", T.StringType()), T.StructField("row_idx", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                at, frame = path.as_py(), unpickled(data.as_py())
                frame.columns = [str(c) for c in frame.columns]
                own = [c for c in frame.columns if c != "row_idx"]
                if whole is not None:
                    check_same_columns({"the first file": whole, at: own})
                for c in names:
                    if c not in own:
                        raise ValueError(f"{at} has no column {c}; it has {own}")
                place = frame["row_idx"].to_numpy(np.int64) if "row_idx" in frame.columns else np.arange(len(frame))
                for i in range(0, len(frame), 8192):
                    part = slice(i, i + 8192)
                    cells = [pa.array(frame[c].to_numpy(np.float64)[part]) for c in names]
                    yield pa.RecordBatch.from_arrays([pa.array([stem_of(at, suffix)] * len(place[part])), pa.array(place[part]), *cells], ["benchmark", "row_idx", *names])

    return files.mapInArrow(work, schema)


# ---------------------------------------------------------------- Parquet


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a path, in order, as the scan names them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = [f.getPath() for f in where.getFileSystem(conf).listStatus(where)]
    return sorted(p.toUri().toString() for p in found if not p.getName().startswith(("_", ".")))


def _plain(uri: Column) -> Column:
    """A file's name with one slash after the scheme: local files are named with one or with three."""
    return F.regexp_replace(uri, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _names(spark: SparkSession, file: str) -> list[str]:
    """A file's column names from its footer, without a job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), conf))
    try:
        return [f.getName() for f in reader.getFileMetaData().getSchema().getFields()]
    finally:
        reader.close()


def _parquet(spark: SparkSession, of: dict[str, str], columns: Sequence[str] | None) -> DataFrame:
    with ThreadPoolExecutor(16) as pool:
        listed = dict(zip(of, pool.map(lambda p: _files(spark, p), of.values()), strict=True))
        names = dict(zip(of, pool.map(lambda fs: _names(spark, fs[0]) if fs else [], listed.values()), strict=True))
    if columns is None:
        check_same_columns(names)
        columns = [c for c in next(iter(names.values())) if c != "row_idx"]
    for stem, own in names.items():
        for c in columns:
            if c not in own:
                raise ValueError(f"{of[stem]} has no column {c}; it has {own}")
    indexed = {stem: "row_idx" in own for stem, own in names.items()}
    values = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    parts = []
    for has in (True, False):
        stems = [s for s in of if indexed[s] is has]
        if not stems:
            continue
        schema = T.StructType([f for f in spark.read.parquet(of[stems[0]]).schema if f.name in (*columns, "row_idx")])
        rows = spark.read.schema(schema).parquet(*[of[s] for s in stems])
        table = spark.createDataFrame([(f, s, i) for s in stems for i, f in enumerate(listed[s])], "_file string, benchmark string, _nth int").withColumn("_file", _plain(F.col("_file")))  # one row a file
        if has:
            index = F.col("row_idx").cast("bigint").alias("row_idx")
        else:
            counts = rows.groupBy(_plain(F.col("_metadata.file_path")).alias("_file")).agg((F.max("_metadata.row_index") + 1).alias("_n"))
            before = F.coalesce(F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy("benchmark").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            table = table.join(counts, "_file", "left").withColumn("_before", before)
            index = (F.col("_row") + F.col("_before")).alias("row_idx")
        place = [] if has else [F.col("_metadata.row_index").alias("_row")]
        rows = rows.select(_plain(F.col("_metadata.file_path")).alias("_at"), *place, *([F.col("row_idx")] if has else []), *values)
        parts.append(rows.join(F.broadcast(table), F.col("_at") == F.col("_file")).select("benchmark", index, *[f"`{c}`" for c in columns]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _scan(spark: SparkSession, of: dict[str, str], columns: Sequence[str] | None, suffix: str) -> DataFrame:
    """(benchmark, row_idx, columns as doubles) of all files; without a row_idx column a file's own order is the row order. No columns: all, the same in each."""
    pickles = {s: p for s, p in of.items() if p.endswith((".pkl", ".pickle"))}
    others = {s: p for s, p in of.items() if s not in pickles}
    made = [scan for scan in ([_pickles(spark, pickles, columns, suffix)] if pickles else []) + ([_parquet(spark, others, columns)] if others else [])]
    check_same_columns({str(i): d.columns for i, d in enumerate(made)})
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def load_pairs(spark: SparkSession, x_paths: Sequence[str], y_paths: Sequence[str], y_label: str) -> tuple[DataFrame, list[str], list[str]]:
    """(benchmark, row_idx, features, y), the feature names, and label files without features, which are left out."""
    xs, ys = by_stem(x_paths, "_func"), by_stem(y_paths, "_pwr")
    if lacking := sorted(set(xs) - set(ys)):
        raise ValueError(f"no label file for {lacking}; there is {sorted(ys)}")
    x = _scan(spark, dict(sorted(xs.items())), None, "_func")
    y = _scan(spark, {s: ys[s] for s in sorted(xs)}, [y_label], "_pwr").withColumnRenamed(y_label, "y")
    return align_rows(x, y), [c for c in x.columns if c not in ("benchmark", "row_idx")], sorted(set(ys) - set(xs))


def load_train_test(spark: SparkSession, train: Sequence[str], test: Sequence[str], y_paths: Sequence[str], y_label: str) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Training and external test rows; a stem in both, or other columns in one, is an error."""
    if both := sorted(set(by_stem(train, "_func")) & set(by_stem(test, "_func"))):
        raise ValueError(f"in training and test: {both}")
    rows, columns, _ = load_pairs(spark, train, y_paths, y_label)
    if not test:
        return rows, None, columns
    held, others, _ = load_pairs(spark, test, y_paths, y_label)
    check_same_columns({"train": columns, "test": others})
    return rows, held, columns


def reports(spark: SparkSession, output_root: str) -> DataFrame:
    """(run_dir, report): each run's report as one text."""
    files = spark.read.text(f"{output_root}/*/report.md", wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_dir"), F.col("value").alias("report"))


def logs(spark: SparkSession, output_root: str) -> DataFrame:
    """(stem, run_dir, log): each run's log as one text; none where there is no run yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{output_root}/*/fit.log")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], "stem string, run_dir string, log string")
    files = spark.read.text(f"{output_root}/*/fit.log", wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("at"), F.col("value").alias("log"))
    folder = F.regexp_replace("at", "/fit\\.log$", "")
    return files.select(F.regexp_replace(F.element_at(F.split(folder, "/"), -1), "_[0-9]{8}_[0-9]{6}$", "").alias("stem"), folder.alias("run_dir"), "log")


def report_paths(spark: SparkSession, output_root: str) -> DataFrame:
    """(path) of the reports that exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{output_root}/*/report.md")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return spark.createDataFrame([(f.getPath().toUri().getPath() if f.getPath().toUri().getScheme() == "file" else f.getPath().toString(),) for f in found], "path string")
