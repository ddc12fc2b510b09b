"""Experiment runs: parsing of names and reports, latest runs, rankings, audits, assignment of work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.cluster import checkpointed
from .frame import with_row_index


def parsed_dirs(df: DataFrame, col: str = "run_dir") -> DataFrame:
    """Add stem, timestamp, module, kind, fs_method, model and setup of a run's folder; null where it doesn't parse."""
    found = lambda part: F.regexp_extract(col, S.RUN_DIR, part)
    df = df.withColumn("stem", F.when(found(1) != "", found(1))).withColumn("timestamp", F.when(found(2) != "", found(2)))
    parts = {n: S.stem_part(F.col("stem"), i + 1) for i, n in enumerate(("module", "kind", "fs_method", "model"))}
    return df.withColumns(parts).withColumn("setup", F.concat_ws("_", "fs_method", "model"))


def metrics_section(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)(## Metrics.*?)(?:\n## |\z)", 1)


METRICS = ("smape", "mape", "rmse", "mae", "r2")


def number(cell: Column) -> Column:
    """A cell's number, or null where it is not written with digits alone (a sign, a point and an exponent apart)."""
    plain = F.trim(cell)
    return F.when(plain.rlike("^[0-9.eE+-]*[0-9]$"), plain.try_cast("double"))


def metric_rows(text: Column) -> Column:
    """A report's metrics rows in order, as structs of split and five numbers; rows of another form don't count."""
    cells = F.transform(F.filter(F.split(metrics_section(text), r"\r?\n"), lambda line: F.startswith(line, F.lit("|"))), lambda line: F.split(F.rtrim(line), r"\|"))
    whole = F.filter(cells, lambda c: (F.size(c) == len(METRICS) + 3) & F.trim(c[1]).isin(*S.SPLITS) & (F.get(c, len(METRICS) + 2) == ""))
    rows = F.transform(whole, lambda c: F.struct(F.trim(c[1]).alias("split"), *[number(c[i + 2]).alias(n) for i, n in enumerate(METRICS)]))
    return F.filter(rows, lambda r: F.least(*[r[n].isNotNull().cast("int") for n in METRICS]) == 1)


def parsed_reports(df: DataFrame, text: str = "report") -> DataFrame:
    """Add the five metrics of each split, config, algorithm, selection, and skip_reason where a report lacks one of the splits.

    Of several rows for one split the last counts. A row without a report, or (where there is such a column) without a
    timestamp, is skipped for that.
    """
    row = lambda rows, s: F.try_element_at(F.filter(rows, lambda x: x["split"] == s), F.lit(-1)).alias(s)
    line = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    timed = F.col("timestamp").isNotNull() if "timestamp" in df.columns else F.lit(True)
    df = df.withColumn("_rows", F.transform(F.array(metric_rows(F.col(text))), lambda rows: F.struct(*[row(rows, s) for s in S.SPLITS]))[0])
    values = {f"{s}_{n}": F.col(f"_rows.{s}.{n}") for s in S.SPLITS for n in METRICS}
    df = df.withColumns(values | {"config": line(r"(?m)^- Config:\s+`([^`]+)`\s*$"), "algorithm": line(r"(?m)^- Algorithm:\s+\*\*([^*]+)\*\*\s*$"), "selection": line(r"(?m)^- Feature selection:\s+\*\*([^*]+)\*\*\s*$")})
    lacks = F.greatest(*[F.col(f"{s}_r2").isNull().cast("int") for s in S.SPLITS]) == 1
    return df.withColumn("skip_reason", F.when(~timed, "no timestamp").when(F.col(text).isNull(), "no report").when(lacks, "unparseable")).drop("_rows")


def strict_problem(text: Column, heading: str = "## Metrics (in original y units)") -> Column:
    """What a strict reading of a report objects to, or null: the exact heading, one row of six cells for each split, numbers in all."""
    lines = F.split(text, r"\r?\n")
    at = F.array_position(lines, heading).cast("int")
    after = F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))
    end = F.array_position(F.transform(after, lambda x: F.startswith(x, F.lit("## "))), True).cast("int")
    own = F.filter(F.when(end > 0, F.slice(after, F.lit(1), end - 1)).otherwise(after), lambda x: F.trim(F.get(F.split(x, r"\|"), 1)).isin(*S.SPLITS))
    cells = F.transform(own, lambda x: F.split(F.rtrim(x), r"\|"))
    short = F.exists(cells, lambda c: F.size(c) != len(METRICS) + 3)
    bad = F.exists(cells, lambda c: F.exists(F.slice(c, 3, len(METRICS)), lambda x: number(x).isNull()))
    lacking = F.size(F.array_except(F.array(*map(F.lit, S.SPLITS)), F.transform(cells, lambda c: F.trim(c[1])))) > 0
    return F.when(text.isNull() | (at == 0), "no metrics heading").when(short, "not six cells").when(bad, "not a number").when(lacking, "a split is missing")


def check_strictly(df: DataFrame, text: str = "report") -> None:
    """Raise where any report has a problem."""
    bad = df.select(strict_problem(F.col(text)).alias("problem")).where("problem is not null").groupBy("problem").count().collect()
    if bad:
        raise ValueError(f"reports that can't be read: {sorted(tuple(r) for r in bad)}")


def scan_counts(runs: DataFrame) -> DataFrame:
    """(scanned, configs, parsed, skipped) of parsed reports; configs are distinct ones among those parsed."""
    read = F.col("skip_reason").isNull()
    return runs.agg(F.count("*").alias("scanned"), F.count_distinct(F.when(read, F.col("config"))).alias("configs"), F.count_if(read).alias("parsed"), F.count_if(~read).alias("skipped"))


def stem_of_run(config: Column, run_dir: Column) -> Column:
    """The stem that a report's configuration names; the folder's without its time, where it names none."""
    own = F.regexp_replace(F.regexp_replace(config, r"^.*/", ""), r"\.[^.]*$", "")
    return F.coalesce(F.when(own != "", own), F.nullif(F.regexp_extract(run_dir, S.RUN_DIR, 1), F.lit("")))


def finished(logs: DataFrame, reports: DataFrame) -> DataFrame:
    """(stem, run_dir, report): each stem's newest run whose log names a report that exists.

    logs: stem, run_dir and log; reports: path of those that exist. A name that isn't absolute is taken in the run's folder; a report
    that moved counts where the run's folder has its own report.md.
    """
    named = logs.select("stem", "run_dir", S.last_report(F.col("log")).alias("said")).where("said is not null")
    full = F.when(F.startswith("said", F.lit("/")), F.col("said")).otherwise(F.concat_ws("/", "run_dir", "said"))
    local = F.when(F.regexp_extract("said", r"([^/]*)$", 1) == "report.md", F.concat_ws("/", "run_dir", F.lit("report.md")))
    tried = named.select("stem", "run_dir", F.posexplode(F.array(full, local)).alias("turn", "report")).where("report is not null")
    there = tried.join(reports.select(F.col("path").alias("report")).distinct(), "report", "left_semi")
    return there.groupBy("stem").agg(F.max_by(F.struct("run_dir", "report"), F.struct("run_dir", -F.col("turn"))).alias("x")).select("stem", "x.*")


def latest(runs: DataFrame, keys: Sequence[str], by: Sequence[str] = ("timestamp", "run_dir")) -> DataFrame:
    """Of each key's runs the one with the greatest ``by``."""
    found = runs.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in runs.columns if c not in keys]), F.struct(*by)).alias("x"))
    return found.select(*keys, "x.*").select(*runs.columns)


def sortable(metric: str) -> Column:
    """A metric to sort by: what isn't finite comes below all."""
    c = F.col(metric)
    return F.when(S.is_finite(c), c).otherwise(F.lit(float("-inf")))


def ranked(runs: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return runs.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def missing_setups(runs: DataFrame) -> DataFrame:
    """(experiment, setup): setups that an experiment with any run lacks. The grid has 40 setups."""
    spark = runs.sparkSession
    grid = spark.createDataFrame([(f"{s}_{m}",) for s in S.SELECTORS if s != "none" for m in S.MODELS], "setup string")
    experiments = runs.select(F.concat_ws("_", "module", "kind").alias("experiment")).distinct()
    seen = runs.select(F.concat_ws("_", "module", "kind").alias("experiment"), "setup").distinct()
    return experiments.crossJoin(F.broadcast(grid)).join(seen, ["experiment", "setup"], "left_anti")


def round_robin(jobs: DataFrame, pool: str, order: Sequence[str], workers: dict[str, int]) -> DataFrame:
    """Deal each pool's jobs in order to its workers, numbered from 0."""
    n = F.create_map(*[F.lit(x) for kv in workers.items() for x in kv])
    return with_row_index(jobs, pool, order, "_i").withColumn("worker", F.pmod(F.col("_i"), F.element_at(n, F.col(pool))).cast("int")).drop("_i")


def unfinished(jobs: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    return jobs.join(finished.select(key).distinct(), key, "left_anti")


def running_best(trials: DataFrame, study: str, trial: str, score: str) -> DataFrame:
    """Best score so far of each study; a failed trial (null) leaves it as it is. A study's trials need not fit one task.

    Trials lie in parts by range; a part's first trials also see the best of the parts before it, of which there are few numbers.
    """
    n = int(trials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lain = trials.repartitionByRange(n, study, trial).withColumn("_part", F.spark_partition_id())
    lain = checkpointed(lain)
    tops = lain.groupBy(study, "_part").agg(F.max(score).alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(Window.partitionBy(study).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    own = F.max(score).over(Window.partitionBy(study, "_part").orderBy(trial).rowsBetween(Window.unboundedPreceding, 0))
    return lain.withColumn("best", own).join(before, [study, "_part"]).withColumn("best", F.greatest("best", "_before")).drop("_part", "_before")


def only(runs: DataFrame, **wanted: Sequence[str] | None) -> DataFrame:
    """Runs whose columns have one of the wanted values, column by column; None lets all pass, an empty list none."""
    for column, values in wanted.items():
        if values is not None:
            runs = runs.where(F.col(column).isin(*values) if values else F.lit(False))
    return runs
