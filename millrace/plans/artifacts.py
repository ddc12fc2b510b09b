"""Queries of configurations, run artefacts, reports and jobs: what a run reads and leaves, compared with SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.cluster import new_folder
from ..operators import experiments as X
from ..operators import frame, jobs, select, stats
from ..sources import config as C
from ..sources import sinks
from . import views as V
from .registry import ORACLES, query

# ---------------------------------------------------------------- configurations

def _mapped(rows: DataFrame, of: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return rows.mapInPandas(lambda batches: (of(b) for b in batches), schema)


_FAULTS = f"""CASE WHEN o_orderkey % 19 = 0 THEN 'config.regression'
  WHEN o_orderkey % 5 = 0 THEN 'general.trainset_x_path' WHEN o_custkey % 7 = 0 THEN 'general.y_label' WHEN o_orderkey % 23 = 0 THEN 'general.seed'
  WHEN o_totalprice < 15000 OR o_custkey % 11 = 0 THEN 'preprocessing.train_val_test_ratio' WHEN o_orderkey % 9 = 0 THEN 'preprocessing.avg_wsize'
  WHEN o_custkey % 10 = 8 OR (o_custkey % 10 = 9 AND o_orderstatus = 'P') THEN 'feature_selection.algorithm' WHEN o_custkey % 10 <> 9 AND o_orderkey % 13 = 0 THEN 'feature_selection.top_k'
  WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'P' THEN 'feature_selection.hyperparams'
  WHEN o_custkey % 6 = 5 THEN 'regression.algorithm' WHEN o_orderkey % 29 = 0 THEN 'regression.intercept_on' WHEN year(o_orderdate) <= 1995 THEN 'regression.hpo_timeout' END"""


@query(f"SELECT o_orderkey AS k, {_FAULTS} AS place FROM orders")
def config_errors(spark, sf_dir):
    """Each order's values are written as a configuration's text; the result names the place of its first error. Where the status is P, nulls are left out."""
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    unless = lambda bad, value: F.when(~bad, value)
    named = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    struct = lambda **of: F.struct(*[v.alias(n) for n, v in of.items()])
    share = F.when(price < 15000, 0.0).otherwise(F.round(F.least(price / 1e6 + 0.1, F.lit(0.7)), 2))
    general = struct(trainset_x_path=F.array_repeat("o_orderpriority", (key % 5).cast("int")), testset_x_path=F.array().cast("array<string>"), y_path=F.array(F.lit("a_pwr")), y_label=unless(cust % 7 == 0, F.col("o_orderstatus")), seed=unless(key % 23 == 0, cust))
    preprocessing = struct(drop_zero_var=key % 2 == 0, train_val_test_ratio=F.array(share, F.lit(0.2), F.when(cust % 11 == 0, 0.7).otherwise(0.8) - share), avg_wsize=key % 9)
    chosen = F.when(cust % 10 < 9, named([*C.SELECTORS, "best"], F.least(cust % 10, F.lit(8))))
    feature_selection = struct(algorithm=chosen, top_k=key % 13, hyperparams=unless(key % 4 == 0, F.from_json(F.lit("{}"), "map<string,string>")))
    regression = struct(algorithm=named([*C.ALGORITHMS, "OLS"], cust % 6), intercept_on=unless(key % 29 == 0, price > 100000), non_negative_coef_only=F.lit(False), hpo_timeout=F.year("o_orderdate") - 1995)
    config = struct(general=general, preprocessing=preprocessing, feature_selection=feature_selection, regression=unless(key % 19 == 0, regression))
    text = F.when(F.col("o_orderstatus") == "P", F.to_json(config)).otherwise(F.to_json(config, {"ignoreNullFields": "false"}))
    return C.audited(V.table(spark, sf_dir, "orders").select(key.alias("k"), text.alias("config"))).select("k", "place")


@query("""SELECT event_id AS k, event_type || '_' || user_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS run_dir,
  CASE event_id % 3 WHEN 0 THEN '/abs/' || event_type WHEN 1 THEN 's3://b/' || event_type ELSE 'base/' || event_type || '/x' END AS path, user_id % 3 <> 2 AS listed FROM events""")
def config_paths(spark, sf_dir):
    """Events as configurations' files: run folders' names, paths in relation to a base, and which names are configurations."""
    def named(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, kind, user, ts in zip(b["event_id"], b["event_type"], b["user_id"], b["ts"], strict=True):
            given = (f"/abs/{kind}", f"s3://b/{kind}", f"{kind}/x")[k % 3]
            rows.append((k, C.run_name(f"in/{kind}_{user}.yaml", ts), C.resolved(given, "base"), C.is_config(kind + (".yaml", ".yml", ".yaml.bak")[user % 3])))
        return pd.DataFrame(rows, columns=["k", "run_dir", "path", "listed"])

    return _mapped(V.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts"), named, "k bigint, run_dir string, path string, listed boolean")


@query("""WITH c AS (SELECT o_orderkey AS k, string_split(o_orderkey::VARCHAR, '') AS a, CASE WHEN o_custkey % 3 = 0 THEN string_split(o_custkey::VARCHAR, '') ELSE list_reverse(string_split(o_orderkey::VARCHAR, '')) END AS b FROM orders)
  SELECT k, CASE WHEN a = b THEN 'same' WHEN list_sort(list_distinct(a)) = list_sort(list_distinct(b)) THEN 'another order' ELSE 'differ' END AS outcome FROM c""")
def schema_check(spark, sf_dir):
    """Column lists of two tables (the digits of an order's number, and those in reverse or of its customer's): equal, in another order, or with others."""
    def outcome(one: str, two: str) -> str:
        try:
            frame.check_same_columns({"one": list(one), "two": list(two)})
        except ValueError as e:
            return "another order" if "missing [], extra []" in str(e) else "differ"
        return "same"

    def outcomes(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": b["k"], "outcome": [outcome(*p) for p in zip(b["one"], b["two"], strict=True)]})

    one, two = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), one.alias("one"), F.when(F.col("o_custkey") % 3 == 0, two).otherwise(F.reverse(one)).alias("two"))
    return _mapped(rows, outcomes, "k bigint, outcome string")


# ---------------------------------------------------------------- what a run leaves


def _tables_back(spark, path: str, columns: list[str]):
    """(split, side, n_rows, total, types) of the six saved tables, read again."""
    found = None
    for split in S.SPLITS:
        for side in ("x", "y"):
            t = spark.read.parquet(f"{path}/{side}_{split}")
            kinds = ",".join(kind for c, kind in t.dtypes if c != "split_row_idx")
            own = t.agg(F.count("*").alias("n_rows"), F.round(F.coalesce(F.sum(columns[0] if side == "x" else "y"), F.lit(0.0)), 3).alias("total")).select(F.lit(split).alias("split"), F.lit(side).alias("side"), "n_rows", "total", F.lit(kinds).alias("types"))
            found = own if found is None else found.unionByName(own)
    return found


_SIX = "SELECT s.split, side, count(sp.benchmark) AS n_rows, round(coalesce(sum(CASE side WHEN 'x' THEN sp.value ELSE sp.y END), 0), 3) AS total, CASE side WHEN 'x' THEN 'double,double' ELSE 'double' END AS types FROM (SELECT unnest(['train', 'val', 'test']) AS split) s, (SELECT unnest(['x', 'y']) AS side) LEFT JOIN {} sp ON sp.split = s.split GROUP BY ALL"


@query(f"WITH {V.SPLIT_SQL} " + _SIX.format("sp"))
def split_tables(spark, sf_dir):
    """The six split tables, written and read again."""
    path = new_folder(spark, "splits")
    sinks.save_split_tables(V.e_split(spark, sf_dir), ["value", "k"], path)
    return _tables_back(spark, path, ["value", "k"])


@query(f"WITH {V.E_SQL}, one AS (SELECT *, 'train' AS split FROM ev) " + _SIX.format("one"))
def split_tables_empty(spark, sf_dir):
    """All rows train: the other splits' tables are empty, with their types."""
    path = new_folder(spark, "splits")
    sinks.save_split_tables(frame.split(V.e_view(spark, sf_dir), (1.0, 0.0, 0.0), V.SEED), ["value", "k"], path)
    return _tables_back(spark, path, ["value", "k"])


@query(ORACLES["zscore_fit"])
def saved_scaler(spark, sf_dir):
    path = new_folder(spark, "scaler")
    sinks.save_scaler(frame.fit_scaler(V.l_rows(spark, sf_dir), V.L_FEATURES), path)
    return spark.read.parquet(path).select("feature", F.round("mean", 5).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT 's' || l_suppkey AS feature, round(avg(l_quantity), 6) AS importance FROM lineitem GROUP BY 1")
def saved_importance(spark, sf_dir):
    """Importance as CSV, best first, read again."""
    path = new_folder(spark, "importance")
    sinks.save_importance(V.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("feature")).agg(F.avg("l_quantity").alias("importance")), path)
    return spark.read.csv(path, header=True, schema="feature string, importance double").select("feature", F.round("importance", 6).alias("importance"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT event_type AS feature_i, " + ", ".join(f"round(coalesce(sum(value) FILTER (['{_TYPES[0]}', '{_TYPES[1]}', '{_TYPES[2]}', '{_TYPES[3]}', '{_TYPES[4]}'][event_id * 7 % 5 + 1] = '{t}'), 0), 3) AS \"{t}\"" for t in _TYPES) + " FROM events GROUP BY 1")
def saved_interaction(spark, sf_dir):
    """Pairs as a square table in CSV, read again."""
    path, names = new_folder(spark, "interaction"), F.array(*map(F.lit, _TYPES))
    pairs = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("feature_i"), F.element_at(names, (F.col("event_id") * 7 % 5 + 1).cast("int")).alias("feature_j"), F.col("value").alias("weight"))
    sinks.save_table(sinks.interaction_matrix(pairs, list(_TYPES)), path)
    return spark.read.csv(path, header=True, schema="feature_i string, " + ", ".join(f"{t} double" for t in _TYPES)).select("feature_i", *[F.round(t, 3).alias(t) for t in _TYPES])


@query("""SELECT event_id AS trial, '{"kind":"' || event_type || '","depth":"' || event_id % 7 || '"}' AS params, value AS score FROM events""")
def saved_trials(spark, sf_dir):
    """Trials with their parameters as JSON in CSV, read again."""
    path = new_folder(spark, "trials")
    params = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("depth"), (F.col("event_id") % 7).cast("string"))
    sinks.save_table(V.table(spark, sf_dir, "events").select(F.col("event_id").alias("trial"), params.alias("params"), F.col("value").alias("score")), path)
    return spark.read.csv(path, header=True, schema="trial bigint, params string, score double", quote='"', escape="\\")


@query("SELECT l_returnflag || ' <= ' || l_linenumber AS rule, 'rule' AS type, round(avg(l_discount), 6) AS coef, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linenumber")
def saved_rules(spark, sf_dir):
    """All rules as CSV, read again."""
    path = new_folder(spark, "rules")
    rule = F.concat_ws(" <= ", "l_returnflag", F.col("l_linenumber").cast("string")).alias("rule")
    sinks.save_table(V.table(spark, sf_dir, "lineitem").groupBy(rule).agg(F.lit("rule").alias("type"), F.avg("l_discount").alias("coef"), F.count("*").alias("n")), path)
    return spark.read.csv(path, header=True, schema="rule string, type string, coef double, n bigint").select("rule", "type", F.round("coef", 6).alias("coef"), "n")


_EXACT = re.sub(r", \d\) AS (smape|mape|rmse|mae|r2)", r", 12) AS \1", ORACLES["ols_metrics"])


@query(f"WITH m AS ({_EXACT}) SELECT split, round(smape, 3) AS smape, round(mape, 3) AS mape, round(rmse, 5) AS rmse, round(mae, 5) AS mae, round(r2, 4) AS r2, 'configs/a.yaml' AS config, 'GBDT' AS algorithm, 'mcp' AS selection FROM m")
def report_roundtrip(spark, sf_dir):
    """A report written from metrics and parsed again: six cells a split, configuration, algorithm and selection."""
    rows = frame.window_mean(V.e_split(spark, sf_dir), [*V.E_FEATURES, "y"], V.WINDOW)
    b, a = rows.where("split = 'train'").agg(F.regr_slope("y", "value"), F.regr_intercept("y", "value")).first()
    found = stats.metrics(rows.withColumn("prediction", F.lit(a) + F.lit(b) * F.col("value")))
    text = sinks.report("configs/a.yaml", "GBDT", "mcp", [], found, {"depth": 3}, [])
    parsed = X.parsed_reports(spark.createDataFrame([(text,)], "report string"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), *[F.col(f"{s}_{n}").alias(n) for n in X.METRICS]) for s in S.SPLITS]))
    return parsed.select(sides.alias("x"), "config", "algorithm", "selection").select("x.*", "config", "algorithm", "selection")


# ---------------------------------------------------------------- reports and logs of many runs

_KINDS = 6


def _reports(spark, sf_dir):
    """A report for each order: whole, without a split, with a short row, with a word for a number, without its heading, or none."""
    k = F.col("o_orderkey")
    text = lambda n: (k % n).cast("string")
    row = lambda split, *cells: F.concat(F.lit(f"| {split} | "), *[x for c in cells for x in (c, F.lit(" | "))])
    kind = k % _KINDS
    lines = [F.when(kind == 4, "## Other").otherwise("## Metrics (in original y units)"), row("train", text(11), F.lit("1.5"), text(7), F.lit("2"), F.concat(F.lit("0."), text(89))),
             F.when(kind == 2, row("val", text(5), text(3))).when(kind != 1, row("val", F.when(kind == 3, "none").otherwise(text(5)), text(3), text(97), F.lit("1e-1"), F.lit("-.5"))),
             row("test", F.lit("9"), text(13), F.lit(".25"), F.lit("+1"), text(2)), F.lit("## Files"), F.lit("- Feature selection: **mcp**")]
    config = F.when(k % 4 != 0, F.concat(F.lit("- Config: `configs/"), F.lit("c"), (k % 10).cast("string"), F.lit(".yaml`")))
    run = F.concat(F.lit("d"), (k % 10).cast("string"), F.when(k % 9 == 0, "").otherwise("_20240101_000000"))
    rows = V.table(spark, sf_dir, "orders").select(k.alias("k"), run.alias("run_dir"), F.when(kind != 5, F.concat_ws("\n", config, *[F.rtrim(x) for x in lines])).alias("report"))
    return X.parsed_reports(X.parsed_dirs(rows))


_CASE = "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'a split is missing' WHEN 2 THEN 'not six cells' WHEN 3 THEN 'not a number' ELSE 'no metrics heading' END"
_SKIP = "CASE WHEN o_orderkey % 9 = 0 THEN 'no timestamp' WHEN o_orderkey % 6 = 5 THEN 'no report' WHEN o_orderkey % 6 > 0 THEN 'unparseable' END"


@query(f"SELECT o_orderkey AS k, {_CASE} AS problem FROM orders")
def parse_strict(spark, sf_dir):
    return _reports(spark, sf_dir).select("k", X.strict_problem(F.col("report")).alias("problem"))


@query(f"""SELECT o_orderkey AS k, {_SKIP} AS skip_reason, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderkey % 11 AS DOUBLE) END AS train_smape, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderkey % 13 AS DOUBLE) END AS test_mape,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(0.1 AS DOUBLE) END AS val_mae, CASE WHEN o_orderkey % 6 < 4 THEN CAST(o_orderkey % 2 AS DOUBLE) END AS test_r2, CASE WHEN o_orderkey % 6 <> 5 THEN 'mcp' END AS selection,
  CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 5 THEN 'c' || o_orderkey % 10 WHEN o_orderkey % 9 <> 0 THEN 'd' || o_orderkey % 10 END AS stem FROM orders""")
def parse_all_cells(spark, sf_dir):
    """All cells, the selection line, skip reasons, and the stem by the configuration's name or else the folder's."""
    rows = _reports(spark, sf_dir).withColumn("stem", X.stem_of_run(F.col("config"), F.col("run_dir")))
    return rows.select("k", "skip_reason", "train_smape", "test_mape", "val_mae", "test_r2", "selection", "stem")


@query(f"WITH r AS (SELECT {_SKIP} AS s, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 10 END AS c FROM orders) SELECT count(*) AS scanned, count(DISTINCT CASE WHEN s IS NULL THEN c END) AS configs, count(*) FILTER (s IS NULL) AS parsed, count(*) FILTER (s IS NOT NULL) AS skipped FROM r")
def scan_counts(spark, sf_dir):
    return X.scan_counts(_reports(spark, sf_dir))


@query("""WITH l AS (SELECT 's' || event_id % 50 AS stem, 'out/s' || event_id % 50 || '_' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS run_dir, event_id AS k FROM events),
  t AS (SELECT stem, run_dir, CASE WHEN k % 5 = 1 THEN '/abs/' || k || '/report.md' ELSE run_dir || '/report.md' END AS report,
    CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 = 1 THEN CASE WHEN k % 3 = 0 THEN 1 WHEN k % 2 = 0 THEN 2 ELSE 0 END WHEN k % 5 = 2 THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END ELSE 0 END AS found FROM l)
  SELECT stem, run_dir, CASE found WHEN 1 THEN report ELSE run_dir || '/report.md' END AS report FROM t WHERE found > 0 QUALIFY row_number() OVER (PARTITION BY stem ORDER BY run_dir DESC) = 1""")
def finished_runs(spark, sf_dir):
    """Runs whose log has a completion line (of the right logger) that names a report which exists, or has moved to the run's folder."""
    k = F.col("event_id")
    stem = F.concat(F.lit("s"), (k % 50).cast("string"))
    run = F.concat(F.lit("out/"), stem, F.lit("_"), F.lpad(k.cast("string"), 9, "0"))
    head = F.lit("09:00 INFO pipeline :: done: old/report.md\n09:30 INFO pipeline :: ")
    log = F.when(k % 5 == 0, "09:00 INFO pipeline :: started").when(k % 5 == 1, F.concat(head, F.lit("done: /abs/"), k.cast("string"), F.lit("/report.md \n"))).when(k % 5 == 2, F.concat(head, F.lit("done: report.md\n10:00 INFO pipeline :: end"))).otherwise("09:00 INFO other :: done: report.md")
    ev = V.table(spark, sf_dir, "events")
    there = ev.where(k % 2 == 0).select(F.concat_ws("/", run, F.lit("report.md")).alias("path")).union(ev.where(k % 3 == 0).select(F.concat(F.lit("/abs/"), k.cast("string"), F.lit("/report.md"))))
    return X.finished(ev.select(stem.alias("stem"), run.alias("run_dir"), log.alias("log")), there).select("stem", "run_dir", "report")


# ---------------------------------------------------------------- jobs

_ALGORITHMS = ["GBDT", "MLP", "RuleFit", "FTTransformer", "ElasticNetCV"]
_MODES = [("gpu,gpu", "all"), ("cpu, cpu", "none"), ("gpu,cpu,cpu", "selected")]
_JOBS_SQL = "j AS (SELECT p_partkey AS k, 'c' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS config, ['GBDT', 'MLP', 'RuleFit', 'FTTransformer', 'ElasticNetCV'][p_partkey % 5 + 1] AS algorithm FROM part)"


def _jobs(spark, sf_dir):
    k = F.col("p_partkey")
    return V.table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("c"), F.lpad(k.cast("string"), 9, "0")).alias("config"), F.element_at(F.array(*map(F.lit, _ALGORITHMS)), (k % 5 + 1).cast("int")).alias("algorithm"))


_GPU = "algorithm IN ('MLP', 'FTTransformer')"


@query(f"WITH {_JOBS_SQL}, d AS (SELECT k, 'all' AS mode, 'gpu' AS pool, 2 AS n FROM j UNION ALL SELECT k, 'none', 'cpu', 2 FROM j UNION ALL SELECT k, 'selected', CASE WHEN {_GPU} THEN 'gpu' ELSE 'cpu' END, CASE WHEN {_GPU} THEN 1 ELSE 2 END FROM j) SELECT k, mode, pool, ((row_number() OVER (PARTITION BY mode, pool ORDER BY k) - 1) % n)::INTEGER AS worker FROM d")
def job_routing(spark, sf_dir):
    """Pools and workers of all jobs, for nodes of GPUs only, of none, and of both."""
    found = None
    for nodes, mode in _MODES:
        own = jobs.batches(_jobs(spark, sf_dir), jobs.checked_nodes(nodes), {"MLP", "FTTransformer"}, ["config"]).select("k", F.lit(jobs.routing(jobs.checked_nodes(nodes)) if mode else "").alias("mode"), "pool", "worker")
        found = own if found is None else found.unionByName(own)
    return found


def _refused(check, *args) -> bool:
    try:
        check(*args)
    except ValueError:
        return True
    return False


@query("""SELECT o_orderkey AS k, o_orderstatus = 'P' OR o_custkey % 4 = 2 OR (o_custkey % 3 <> 0 AND o_orderkey % 5 = 0) AS nodes_refused, o_orderkey % 7 < 3 AS count_refused FROM orders""")
def job_arguments(spark, sf_dir):
    """Orders as command lines: pools of two nodes, for some with a wanted number, and a count; what the checks refuse."""
    def refused(b: pd.DataFrame) -> pd.DataFrame:
        nodes = [_refused(jobs.checked_nodes, a, None if pd.isna(n) else int(n)) for a, n in zip(b["nodes"], b["wanted"], strict=True)]
        return pd.DataFrame({"k": b["k"], "nodes_refused": nodes, "count_refused": [_refused(jobs.checked_count, c) for c in b["count"]]})

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    first = F.when(F.col("o_orderstatus") == "F", "gpu").when(F.col("o_orderstatus") == "O", "cpu").otherwise("tpu")
    second = F.element_at(F.array(*map(F.lit, ("gpu", " cpu", "", "cpu"))), (cust % 4 + 1).cast("int"))
    rows = V.table(spark, sf_dir, "orders").select(key.alias("k"), F.concat_ws(",", first, second).alias("nodes"), F.when(cust % 3 != 0, F.when(key % 5 == 0, 3).otherwise(2)).alias("wanted"), (key % 7 - 2).cast("string").alias("count"))
    return _mapped(rows, refused, "k bigint, nodes_refused boolean, count_refused boolean")


_DEALT = f"WITH {_JOBS_SQL}, d AS (SELECT config, CASE WHEN {_GPU} THEN 'gpu' ELSE 'cpu' END AS pool, ((row_number() OVER (PARTITION BY {_GPU} ORDER BY config) - 1) % CASE WHEN {_GPU} THEN 1 ELSE 2 END)::INTEGER AS worker FROM j)"


@query(f"{_DEALT}, f AS (SELECT *, row_number() OVER (PARTITION BY pool, worker ORDER BY config) AS place FROM d) SELECT pool, worker, count(*) AS n, string_agg(config, ',' ORDER BY config) FILTER (place <= 5) AS jobs FROM f GROUP BY pool, worker")
def job_preview(spark, sf_dir):
    dealt = jobs.batches(_jobs(spark, sf_dir), jobs.checked_nodes("gpu,cpu,cpu"), {"MLP", "FTTransformer"}, ["config"])
    return jobs.preview(dealt, "config")


@query(f"{_DEALT} SELECT pool, worker, CASE WHEN pool = 'gpu' THEN '70' WHEN worker = 0 THEN '80' END AS job, count(*) AS n FROM d GROUP BY pool, worker")
def job_manifest(spark, sf_dir):
    """What was submitted, with the numbers that the batch system answered, where it did."""
    dealt = jobs.batches(_jobs(spark, sf_dir), jobs.checked_nodes("gpu,cpu,cpu"), {"MLP", "FTTransformer"}, ["config"])
    said = spark.createDataFrame([("gpu", 0, "Submitted batch job 70"), ("cpu", 0, "Submitted batch job 80 on x"), ("cpu", 1, "error: no such queue")], "pool string, worker int, said string")
    return jobs.manifest(dealt, said.select("pool", "worker", S.job_id(F.col("said")).alias("job")), "config").drop("jobs_crc")


# ---------------------------------------------------------------- selectors by name


@query(f"WITH {V.L_SQL}, s AS (SELECT " + ", ".join(f"abs(corr({c}, y)) AS p_{c}, var_pop({c}) AS v_{c}" for c in V.L_FEATURES) + " FROM li), long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS o, p_{c} AS p, v_{c} AS v FROM s" for i, c in enumerate(V.L_FEATURES)) + """),
  ranked AS (SELECT 'pearson' AS method, feature, row_number() OVER (ORDER BY p DESC, o) AS rank FROM long UNION ALL SELECT 'variance', feature, row_number() OVER (ORDER BY v DESC, o) FROM long WHERE v > 0
  UNION ALL SELECT 'univariate', feature, row_number() OVER (ORDER BY p DESC, o) FROM long UNION ALL SELECT 'none', feature, o + 1 FROM long) SELECT method, feature, rank::INTEGER AS rank FROM ranked WHERE method = 'none' OR rank <= 3""")
def select_dispatch(spark, sf_dir):
    """Selectors called by name, each with its own settings; no name keeps all columns in their order."""
    rows = V.l_rows(spark, sf_dir).withColumn("split_row_idx", F.monotonically_increasing_id())
    found = None
    for name in ("pearson", "variance", "univariate", None):
        own = select.select(rows, V.L_FEATURES, name, 3, hyperparams={"univariate": {"score_func": "f_regression"}, "variance": {"threshold": 0.0}})
        own = own.select(F.lit(name or "none").alias("method"), "feature", F.col("rank").cast("int").alias("rank"))
        found = own if found is None else found.unionByName(own)
    return found
