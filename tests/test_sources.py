import os
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import frame
from millrace.sources import tables


def write_pairs(folder, names, write, rows=37):
    rng, kept = np.random.default_rng(0), {}
    for b in names:
        x = pd.DataFrame(rng.normal(size=(rows, 3)), columns=["f0", "a b", "f.2"])
        y = pd.DataFrame({"p/Pc(top)": rng.normal(size=rows), "other": 1.0})
        write(x, f"{folder}/{b}_func")
        write(y, f"{folder}/{b}_pwr")
        kept[b] = (x, y)
    return kept


def same(found, kept):
    rows = {(r.benchmark, r.row_idx): r for r in found.collect()}
    assert len(rows) == sum(len(x) for x, _ in kept.values())
    for b, (x, y) in kept.items():
        for i in range(len(x)):
            r = rows[b, i]
            assert [r["f0"], r["a b"], r["f.2"], r.y] == [*x.iloc[i], y["p/Pc(top)"].iloc[i]]


def test_pickled_pairs(spark, tmp_path):
    kept = write_pairs(tmp_path, ["alpha", "be ta"], lambda d, at: d.to_pickle(at + ".pkl"))
    paths = lambda suffix: [f"{tmp_path}/{b}_{suffix}.pkl" for b in kept]
    found, columns, unused = tables.load_pairs(spark, paths("func"), paths("pwr"), "p/Pc(top)")
    assert columns == ["f0", "a b", "f.2"] and not unused
    same(found, kept)
    with pytest.raises(Exception, match="has no column"):
        tables.load_pairs(spark, paths("func"), paths("pwr"), "none")[0].collect()
    kept["alpha"][0].rename(columns={"f0": "g0"}).to_pickle(f"{tmp_path}/be ta_func.pkl")
    with pytest.raises(Exception, match="differ"):
        tables.load_pairs(spark, paths("func"), paths("pwr"), "p/Pc(top)")[0].collect()


class Hostile:
    def __init__(self, at):
        self.at = at

    def __reduce__(self):
        return os.system, (f"touch {self.at}",)


def test_hostile_pickles_are_refused(spark, tmp_path):
    for n, bad in enumerate((Hostile(f"{tmp_path}/ran"), pd.DataFrame({"a": [Hostile(f"{tmp_path}/ran")]}), [1, 2])):
        with open(f"{tmp_path}/{n}_func.pkl", "wb") as f:
            pickle.dump(bad, f)
        with pytest.raises(pickle.UnpicklingError):
            tables.unpickled(open(f"{tmp_path}/{n}_func.pkl", "rb").read())
        pd.DataFrame({"y": [1.0]}).to_pickle(f"{tmp_path}/{n}_pwr.pkl")
        with pytest.raises(Exception, match="may not hold|not a frame"):
            tables.load_pairs(spark, [f"{tmp_path}/{n}_func.pkl"], [f"{tmp_path}/{n}_pwr.pkl"], "y")[0].collect()
    assert not os.path.exists(f"{tmp_path}/ran")


def jobs(spark, name, what):
    spark.sparkContext.setJobGroup(name, name)
    made = what()
    return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_row_order_is_that_of_the_files(spark, tmp_path):
    """One file, a folder of several files in order, names with odd letters; jobs don't grow with the files."""
    kept = write_pairs(tmp_path, [f"b {i}%2F" if i == 3 else f"b{i}" for i in range(30)], lambda d, at: d.to_parquet(at + ".parquet", row_group_size=10))
    x, y = pd.DataFrame(np.arange(300.0).reshape(100, 3), columns=["f0", "a b", "f.2"]), pd.DataFrame({"p/Pc(top)": np.arange(100.0)})
    os.makedirs(f"{tmp_path}/many_func.parquet")
    for i in range(4):
        x.iloc[25 * i : 25 * i + 25].to_parquet(f"{tmp_path}/many_func.parquet/part-{i}.parquet")
    y.to_parquet(f"{tmp_path}/many_pwr.parquet")
    kept["many"] = (x, y)
    paths = lambda suffix, names: [f"{tmp_path}/{b}_{suffix}.parquet" for b in names]
    load = lambda names: lambda: tables.load_pairs(spark, paths("func", names), paths("pwr", kept), "p/Pc(top)")
    (found, columns, unused), n = jobs(spark, "all files", load(list(kept)))
    (_, _, others), few = jobs(spark, "two files", load(list(kept)[:2]))
    assert n == few and columns == ["f0", "a b", "f.2"] and not unused and len(others) == 29
    same(found, kept)


def test_rows_without_a_benchmark(spark):
    rows = spark.createDataFrame([("a" if i % 2 else None, i // 2, float(i)) for i in range(40)], "benchmark string, row_idx bigint, x double")
    made = frame.align_rows(rows, rows.select("benchmark", "row_idx", (F.col("x") * 2).alias("y")))
    assert made.count() == 40 and all(r.y == 2 * r.x for r in made.collect())
    parts = frame.split(made, (0.5, 0.25, 0.25), 1)
    assert parts.count() == 40 and {r.split for r in parts.where("benchmark is null").collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError, match="row counts differ"):
        frame.align_rows(rows, rows.where("benchmark is null"))
