"""Queries of experiment runs; the runs are derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import experiments as X
from . import views as V
from .registry import query

_MODULES = ("cp0", "idu", "ifu", "iu", "lsu", "rtu", "vidu", "vpu")
_quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

RUNS_SQL = f"""named AS (SELECT o_orderkey AS k, {_quoted(_MODULES)}[o_orderkey % 8 + 1] AS module, {_quoted(S.KINDS)}[(o_orderkey // 8) % 3 + 1] AS kind,
  {_quoted(S.SELECTORS)}[(o_orderkey * o_orderkey) % 8 + 1] AS fs_method, {_quoted(S.MODELS)}[((o_orderkey * o_orderkey) // 8) % 5 + 1] AS model,
  strftime(o_orderdate, '%Y%m%d_') || lpad(CAST((o_orderkey * 31) % 240000 AS VARCHAR), 6, '0') AS timestamp,
  ((o_orderkey * 7919) % 1000) / 1000.0 AS test_r2, ((o_orderkey * 104729) % 1000) / 1000.0 AS val_r2, ((o_orderkey * 31) % 997) / 100.0 AS test_rmse FROM orders),
  runs AS (SELECT *, fs_method || '_' || model AS setup, module || '_' || kind || '_' || fs_method || '_' || model AS stem, module || '_' || kind || '_' || fs_method || '_' || model || '_' || timestamp AS run_dir FROM named)"""

_LATEST_SQL = RUNS_SQL + ", latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY module, kind, setup ORDER BY timestamp DESC, run_dir DESC, k DESC) = 1)"
_COLUMNS = "k, module, kind, setup, timestamp, test_r2, val_r2, test_rmse"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    rows = V.table(spark, sf_dir, "orders").select(
        k.alias("k"), ((k * 7919) % 1000 / 1000.0).alias("test_r2"), ((k * 104729) % 1000 / 1000.0).alias("val_r2"), ((k * 31) % 997 / 100.0).alias("test_rmse"),
        F.concat_ws("_", pick(_MODULES, k % 8), pick(S.KINDS, F.floor(k / 8) % 3), pick(S.SELECTORS, (k * k) % 8), pick(S.MODELS, F.floor(k * k / 8) % 5),
                    F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(((k * 31) % 240000).cast("string"), 6, "0")).alias("run_dir"))
    return X.parsed_dirs(rows)


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.latest(_runs(spark, sf_dir), ["module", "kind", "setup"], ["timestamp", "run_dir", "k"])


@query(f"WITH {RUNS_SQL} SELECT k, stem, timestamp, module, kind, fs_method, model FROM runs")
def parse_stem(spark, sf_dir):
    return _runs(spark, sf_dir).select("k", "stem", "timestamp", "module", "kind", "fs_method", "model")


@query(f"WITH {_LATEST_SQL} SELECT {_COLUMNS} FROM latest")
def runs_latest(spark, sf_dir):
    return _latest(spark, sf_dir).select(*_COLUMNS.split(", "))


@query(f"WITH {_LATEST_SQL} SELECT k, row_number() OVER (ORDER BY test_r2, k)::INTEGER AS by_r2, row_number() OVER (ORDER BY test_rmse, k)::INTEGER AS by_rmse FROM latest")
def runs_rank_r2(spark, sf_dir):
    runs = _latest(spark, sf_dir).withColumn("_all", F.lit(1))  # one row for each of at most some thousand setups
    runs = X.ranked(runs, ["_all"], [X.sortable("test_r2"), F.col("k")], "by_r2")
    return X.ranked(runs, ["_all"], [X.sortable("test_rmse"), F.col("k")], "by_rmse").select("k", "by_r2", "by_rmse")


@query(f"WITH {_LATEST_SQL} SELECT module, kind, setup, row_number() OVER (PARTITION BY module, kind ORDER BY test_r2 DESC, val_r2 DESC, setup DESC)::INTEGER AS rank FROM latest")
def runs_rank_experiment(spark, sf_dir):
    order = [X.sortable("test_r2").desc(), X.sortable("val_r2").desc(), F.desc("setup")]
    return X.ranked(_latest(spark, sf_dir), ["module", "kind"], order).select("module", "kind", "setup", "rank")


@query(f"WITH {_LATEST_SQL} SELECT {_COLUMNS} FROM latest WHERE test_r2 > 0.8")
def runs_high_r2(spark, sf_dir):
    return _latest(spark, sf_dir).where("test_r2 > 0.8").select(*_COLUMNS.split(", "))


@query(f"WITH {_LATEST_SQL} SELECT {_COLUMNS} FROM latest WHERE module IN ('cp0', 'lsu') AND kind = 'input'")
def runs_filter(spark, sf_dir):
    return X.only(_latest(spark, sf_dir), module=["cp0", "lsu"], kind=["input"], selector=None).select(*_COLUMNS.split(", "))


_GRID = f"grid AS (SELECT s || '_' || m AS setup FROM (SELECT unnest({_quoted(S.SELECTORS[:-1])}) AS s), (SELECT unnest({_quoted(S.MODELS)}) AS m))"


@query(f"WITH {RUNS_SQL}, {_GRID}, e AS (SELECT DISTINCT module || '_' || kind AS experiment FROM runs) SELECT experiment, setup FROM e, grid EXCEPT SELECT module || '_' || kind, setup FROM runs")
def runs_missing(spark, sf_dir):
    return X.missing_setups(_runs(spark, sf_dir))


@query(f"WITH {RUNS_SQL} SELECT k, CASE WHEN model IN ('mlp', 'ft_transformer') THEN 'gpu' ELSE 'cpu' END AS pool, ((row_number() OVER (PARTITION BY model IN ('mlp', 'ft_transformer') ORDER BY run_dir, k) - 1) % CASE WHEN model IN ('mlp', 'ft_transformer') THEN 3 ELSE 4 END)::INTEGER AS worker FROM runs")
def round_robin(spark, sf_dir):
    jobs = _runs(spark, sf_dir).select("k", "run_dir", F.when(F.col("model").isin("mlp", "ft_transformer"), "gpu").otherwise("cpu").alias("pool"))
    return X.round_robin(jobs, "pool", ["run_dir", "k"], {"gpu": 3, "cpu": 4}).select("k", "pool", "worker")


@query(f"WITH {RUNS_SQL} SELECT DISTINCT stem FROM runs WHERE stem NOT IN (SELECT stem FROM runs WHERE test_r2 > 0.9985)")
def skip_finished(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return X.unfinished(runs.select("stem").distinct(), runs.where("test_r2 > 0.9985"), "stem")


_REPORT = """reports AS (SELECT o_orderkey AS k, '# Run' || chr(10) || '- Config: `configs/' || o_orderpriority || '.yaml`' || chr(10) || '- Algorithm: **RuleFit**' || chr(10) || '## Metrics (in original y units)' || chr(10)
  || '| train | 1.5 | 2.5 | ' || (o_orderkey % 97) || '.25 | 0.5 | 0.' || (o_orderkey % 89) || ' |' || chr(10) || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '| val | 1.5 | 2.5 | ' || (o_orderkey % 83) || '.5 | 0.5 | -0.' || (o_orderkey % 79) || ' |' || chr(10) END
  || '| test | 1.5 | 2.5e1 | ' || (o_orderkey % 73) || ' | 0.5 | .' || (o_orderkey % 71) || ' |' || chr(10) || '## Files' || chr(10) || '| test | 9 | 9 | 9 | 9 | 9 |' AS report FROM orders)"""


@query("WITH " + _REPORT + """ SELECT k, 'configs/' || regexp_extract(report, 'configs/([^`]+)`', 1) AS config, 'RuleFit' AS algorithm,
  CAST(regexp_extract(report, 'train \\| 1.5 \\| 2.5 \\| ([0-9.]+)', 1) AS DOUBLE) AS train_rmse, TRY_CAST(nullif(regexp_extract(report, 'val \\|[^\\n]*\\| (-0[0-9.]+) \\|', 1), '') AS DOUBLE) AS val_r2,
  CAST(regexp_extract(report, 'test \\| 1.5 \\| 2.5e1 \\| ([0-9.]+)', 1) AS DOUBLE) AS test_rmse, CAST(regexp_extract(report, 'test \\| 1.5[^\\n]*\\| ([.][0-9]+) \\|', 1) AS DOUBLE) AS test_r2,
  CASE WHEN k % 7 = 0 THEN 'unparseable' END AS skip_reason FROM reports""")
def parse_metrics_row(spark, sf_dir):
    k, text = F.col("o_orderkey"), lambda n: (F.col("o_orderkey") % n).cast("string")
    lines = [F.lit("# Run"), F.concat(F.lit("- Config: `configs/"), "o_orderpriority", F.lit(".yaml`")), F.lit("- Algorithm: **RuleFit**"), F.lit("## Metrics (in original y units)"),
             F.concat(F.lit("| train | 1.5 | 2.5 | "), text(97), F.lit(".25 | 0.5 | 0."), text(89), F.lit(" |")),
             F.when(k % 7 != 0, F.concat(F.lit("| val | 1.5 | 2.5 | "), text(83), F.lit(".5 | 0.5 | -0."), text(79), F.lit(" |"))),
             F.concat(F.lit("| test | 1.5 | 2.5e1 | "), text(73), F.lit(" | 0.5 | ."), text(71), F.lit(" |")), F.lit("## Files"), F.lit("| test | 9 | 9 | 9 | 9 | 9 |")]
    reports = V.table(spark, sf_dir, "orders").select(k.alias("k"), F.concat_ws("\n", *lines).alias("report"))
    return X.parsed_reports(reports).select("k", "config", "algorithm", "train_rmse", "val_r2", "test_rmse", "test_r2", "skip_reason")


@query("SELECT event_id, max(CASE WHEN value < 200 THEN value END) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM events")
def hpo_running_best(spark, sf_dir):
    """Event types as studies, events as trials; a value of 200 or more stands for a failed trial."""
    trials = V.table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") < 200, F.col("value")).alias("score"))
    return X.running_best(trials, "event_type", "event_id", "score").select("event_id", "best")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'runs/' || event_type || '/report.md' END AS report, CAST(event_id AS VARCHAR) AS job FROM events")
def last_report(spark, sf_dir):
    """A log for each event: its last completion line names the report; a batch answer holds the job's number."""
    name = F.concat(F.lit("runs/"), "event_type", F.lit("/report.md"))
    log = F.concat(F.lit("start\n"), F.when(F.col("event_id") % 3 == 0, F.lit("stopped")).otherwise(F.concat(F.lit("12:00 INFO pipeline :: done: runs/old/report.md\n12:30 INFO other :: done: x/report.md\n13:00 INFO pipeline :: done: "), name, F.lit("\n"))))
    said = F.concat(F.lit("Submitted batch job "), F.col("event_id").cast("string"))
    return V.table(spark, sf_dir, "events").select("event_id", S.last_report(log).alias("report"), S.job_id(said).alias("job"))
