"""Row-ordered views of the tables: benchmarks, a row index, features and a planted target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import split, with_row_index

RATIOS = (0.7, 0.2, 0.1)
SEED = 42
WINDOW = 16
E_FEATURES = ["hour", "user_id", "k", "value"]
L_FEATURES = ["quantity", "discount", "tax", "linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type; y = 2 value + 0.5 k and a small known rest."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    rest = ((F.col("event_id") * 7919) % 101 - 50) / 100.0
    rows = ev.select(F.col("event_type").alias("benchmark"), "event_id", F.hour("ts").cast("double").alias("hour"), F.col("user_id").cast("double").alias("user_id"), k.alias("k"), "value", (2 * F.col("value") + 0.5 * k + rest).alias("y"))
    return rows


def e_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_index(e_rows(spark, sf_dir), "benchmark", ["event_id"])


def e_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(e_view(spark, sf_dir), RATIOS, SEED)


def l_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by flag and status; y = 30 quantity - 4000 discount and a known rest."""
    rest = (F.col("l_orderkey") * 7919) % 101 - 50
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("benchmark"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_linenumber").cast("double").alias("linenumber"), (30 * F.col("l_quantity") - 4000 * F.col("l_discount") + rest).alias("y"))


def v_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64 columns e1..e64, with a target of three of them."""
    e = table(spark, sf_dir, "embeddings")
    x = [F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(64)]
    rest = ((F.col("vec_id") * 7919) % 101 - 50) / 1000.0
    y = 3 * F.col("embedding")[0].cast("double") - 2 * F.col("embedding")[7].cast("double") + 1.5 * F.col("embedding")[20].cast("double") + rest
    return e.select("vec_id", *x, y.alias("y"))


V_FEATURES = [f"e{i + 1}" for i in range(64)]

# ---------------------------------------------------------------- the same in DuckDB SQL

E_SQL = """ev AS (SELECT event_type AS benchmark, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_idx,
  CAST(hour(ts) AS DOUBLE) AS hour, CAST(user_id AS DOUBLE) AS user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value,
  2 * value + 0.5 * CAST(json_extract_string(props, '$.k') AS DOUBLE) + ((event_id * 7919) % 101 - 50) / 100.0 AS y FROM events)"""

#: The generator's draws for the benchmarks' row counts at the three scales (seed 42, ratios 0.7, 0.2, 0.1).
STARTS_SQL = """starts(benchmark, n, start) AS (VALUES
  ('click', 210, 13), ('error', 201, 109), ('purchase', 202, 92), ('signup', 199, 61), ('view', 188, 57),
  ('click', 2006, 125), ('error', 2014, 1092), ('purchase', 1981, 908), ('signup', 2017, 620), ('view', 1982, 601),
  ('click', 19863, 1241), ('error', 19810, 10733), ('purchase', 20084, 9203), ('signup', 20302, 6237), ('view', 19941, 6044))"""

SPLIT_SQL = f"""{E_SQL}, {STARTS_SQL},
  sizes AS (SELECT benchmark, count(*) AS n FROM ev GROUP BY benchmark),
  plan AS (SELECT s.benchmark, s.n, t.start, t.start + CAST(round_even(s.n * 0.3, 0) AS BIGINT) AS stop,
                  t.start + CAST(round_even(CAST(round_even(s.n * 0.3, 0) AS BIGINT) * 0.2 / 0.3, 0) AS BIGINT) AS mid FROM sizes s JOIN starts t ON s.benchmark = t.benchmark AND s.n = t.n),
  off AS (SELECT *, coalesce(sum(n - (stop - start)) OVER w, 0) AS o_train, coalesce(sum(mid - start) OVER w, 0) AS o_val, coalesce(sum(stop - mid) OVER w, 0) AS o_test FROM plan
          WINDOW w AS (ORDER BY benchmark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  sp AS (SELECT ev.*, CASE WHEN row_idx < start OR row_idx >= stop THEN 'train' WHEN row_idx < mid THEN 'val' ELSE 'test' END AS split,
                CAST(CASE WHEN row_idx < start THEN o_train + row_idx WHEN row_idx >= stop THEN o_train + row_idx - (stop - start) WHEN row_idx < mid THEN o_val + row_idx - start ELSE o_test + row_idx - mid END AS BIGINT) AS split_row_idx
         FROM ev JOIN off USING (benchmark))"""

WINDOW_SQL = f"""{SPLIT_SQL}, wm AS (SELECT split, split_row_idx // {WINDOW} AS bin, avg(hour) AS hour, avg(user_id) AS user_id, avg(k) AS k, avg(value) AS value, avg(y) AS y
  FROM sp GROUP BY 1, 2 HAVING count(*) = {WINDOW})"""

L_SQL = """li AS (SELECT l_returnflag || l_linestatus AS benchmark, l_quantity AS quantity, l_discount AS discount, l_tax AS tax, CAST(l_linenumber AS DOUBLE) AS linenumber,
  30 * l_quantity - 4000 * l_discount + (l_orderkey * 7919) % 101 - 50 AS y FROM lineitem)"""

V_SQL = "vv AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i + 1}" for i in range(64)) + ", 3 * CAST(embedding[1] AS DOUBLE) - 2 * CAST(embedding[8] AS DOUBLE) + 1.5 * CAST(embedding[21] AS DOUBLE) + ((vec_id * 7919) % 101 - 50) / 1000.0 AS y FROM embeddings)"
