"""Queries of row-ordered tables: pairing, split, windows, scaling, scores, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import frame, stats
from . import views as V
from .registry import query

_FILES = """x AS (SELECT DISTINCT regexp_replace(c_mktsegment || '_' || (c_custkey % 40) || '_func', '_func$', '') AS stem FROM customer),
  y AS (SELECT DISTINCT regexp_replace(c_mktsegment || '_' || (c_custkey % 50 + 5) || '_pwr', '_pwr$', '') AS stem FROM customer)"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = V.table(spark, sf_dir, "customer")
    name = lambda n, suffix: S.stem(F.concat_ws("_", "c_mktsegment", n.cast("string"), F.lit(suffix)), f"_{suffix}").alias("stem")
    return c.select(name(F.col("c_custkey") % 40, "func")).distinct(), c.select(name(F.col("c_custkey") % 50 + 5, "pwr")).distinct()


@query(f"WITH {_FILES} SELECT stem FROM x JOIN y USING (stem)")
def pair_files(spark, sf_dir):
    return frame.pair_stems(*_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT stem FROM x WHERE stem NOT IN (SELECT stem FROM y)")
def pair_missing_y(spark, sf_dir):
    return frame.stems_without(*_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT stem FROM y WHERE stem NOT IN (SELECT stem FROM x)")
def pair_unused_y(spark, sf_dir):
    return frame.stems_without(*reversed(_files(spark, sf_dir)))


@query(f"WITH {_FILES} SELECT stem FROM x INTERSECT SELECT stem FROM y")
def split_overlap(spark, sf_dir):
    return frame.stems_in_both(*_files(spark, sf_dir))


@query("SELECT c_mktsegment AS stem, count(*)::BIGINT AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def repeated_stems(spark, sf_dir):
    return frame.repeated_stems(V.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stem")))


@query(f"WITH {V.E_SQL} SELECT benchmark, row_idx::BIGINT AS row_idx, round(value, 6) AS value, round(y, 6) AS y FROM ev")
def row_align(spark, sf_dir):
    rows = V.e_view(spark, sf_dir)
    return frame.align_rows(rows.select("benchmark", "row_idx", F.round("value", 6).alias("value")), rows.select("benchmark", "row_idx", F.round("y", 6).alias("y")))


@query(f"WITH {V.SPLIT_SQL} SELECT event_id, benchmark, row_idx::BIGINT AS row_idx, split, split_row_idx FROM sp")
def split_assign(spark, sf_dir):
    return V.e_split(spark, sf_dir).select("event_id", "benchmark", "row_idx", "split", "split_row_idx")


@query(f"WITH {V.SPLIT_SQL} SELECT split, count(*)::BIGINT AS n_rows FROM sp GROUP BY split")
def split_counts(spark, sf_dir):
    return frame.split_counts(V.e_split(spark, sf_dir))


_AUDIT = "SELECT '{0}' AS feature, count_if(isnan({0}))::BIGINT AS n_nan, count_if(isinf({0}))::BIGINT AS n_inf, count_if({0} IS NULL)::BIGINT AS n_null FROM li"


@query(f"WITH {V.L_SQL} " + " UNION ALL ".join(_AUDIT.format(c) for c in V.L_FEATURES))
def finite_audit(spark, sf_dir):
    return frame.finite_audit(V.l_rows(spark, sf_dir), V.L_FEATURES)


@query("SELECT 'l_quantity' AS feature, max(l_quantity) = min(l_quantity) AS is_constant FROM lineitem UNION ALL SELECT 'one', true UNION ALL SELECT 'l_tax', max(l_tax) = min(l_tax) FROM lineitem")
def zero_variance_cols(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", F.lit(1.0).alias("one"))
    return frame.constant_columns(rows, ["l_quantity", "one", "l_tax"])


_MEANS = ", ".join(f"round({c}, 6) AS {c}" for c in [*V.E_FEATURES, "y"])


def _windows(spark, sf_dir) -> DataFrame:
    return frame.window_mean(V.e_split(spark, sf_dir), [*V.E_FEATURES, "y"], V.WINDOW)


@query(f"WITH {V.WINDOW_SQL} SELECT split, bin::BIGINT AS bin, {_MEANS} FROM wm")
def window_mean(spark, sf_dir):
    return _windows(spark, sf_dir).select("split", "bin", *[F.round(c, 6).alias(c) for c in [*V.E_FEATURES, "y"]])


@query(f"WITH {V.L_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 5) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS std FROM li" for c in V.L_FEATURES))
def zscore_fit(spark, sf_dir):
    return frame.fit_scaler(V.l_rows(spark, sf_dir), V.L_FEATURES).select("feature", F.round("mean", 5).alias("mean"), F.round("std", 6).alias("std"))


_Z = ", ".join(f"round(({c} - m.m_{c}) / m.s_{c}, 6) AS {c}" for c in V.E_FEATURES)
_FIT = "m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in [*V.E_FEATURES, "y"]) + " FROM wm WHERE split = 'train')"


@query(f"WITH {V.WINDOW_SQL}, {_FIT} SELECT split, bin::BIGINT AS bin, {_Z} FROM wm, m")
def zscore_apply(spark, sf_dir):
    rows = _windows(spark, sf_dir)
    scaler = frame.fit_scaler(rows.where("split = 'train'"), V.E_FEATURES)
    return frame.scale(rows, scaler, V.E_FEATURES).select("split", "bin", *[F.round(c, 6).alias(c) for c in V.E_FEATURES])


@query(f"WITH {V.WINDOW_SQL} SELECT split, bin::BIGINT AS bin, round(y, 6) AS y FROM wm")
def inverse_zscore(spark, sf_dir):
    rows = _windows(spark, sf_dir).select("split", "bin", "y")
    scaler = frame.fit_scaler(rows.where("split = 'train'"), ["y"])
    return frame.scale(frame.scale(rows, scaler, ["y"]), scaler, ["y"], inverse=True).withColumn("y", F.round("y", 6))


_RANKED = "SELECT CAST(row_number() OVER (ORDER BY score DESC, ordinal) AS INTEGER) AS rank, feature, round(score, {1}) AS score FROM s QUALIFY row_number() OVER (ORDER BY score DESC, ordinal) <= {0}"


def _scores_sql(of: str, source: str, columns: list[str]) -> str:
    return "s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS ordinal, {of.format(c)} AS score FROM {source}" for i, c in enumerate(columns)) + ")"


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("score", F.round("score", digits))


@query(f"WITH {V.V_SQL}, {_scores_sql('abs(corr({0}, y))', 'vv', V.V_FEATURES)} {_RANKED.format(20, 6)}")
def fs_pearson(spark, sf_dir):
    return _rounded(stats.top_k(stats.column_scores(V.v_view(spark, sf_dir), V.V_FEATURES, "pearson"), 20), 6)


@query(f"WITH {V.V_SQL}, {_scores_sql('var_pop({0})', 'vv', V.V_FEATURES)} {_RANKED.format(20, 6)}")
def fs_variance(spark, sf_dir):
    return _rounded(stats.top_k(stats.column_scores(V.v_view(spark, sf_dir), V.V_FEATURES, "variance").where("score > 0"), 20), 6)


@query(f"WITH {V.V_SQL}, {_scores_sql('corr({0}, y) ** 2 / (1 - corr({0}, y) ** 2) * (count(*) - 2)', 'vv', V.V_FEATURES)} {_RANKED.format(20, 4)}")
def fs_f_regression(spark, sf_dir):
    return _rounded(stats.top_k(stats.column_scores(V.v_view(spark, sf_dir), V.V_FEATURES, "f"), 20), 4)


_G = " UNION ALL ".join(f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, round(avg({a} * {b}), 5) AS g FROM li" for a in V.L_FEATURES for b in V.L_FEATURES)


@query(f"WITH {V.L_SQL} {_G}")
def gram_matrix(spark, sf_dir):
    g = stats.fold_grams(V.l_rows(spark, sf_dir), V.L_FEATURES)[0].raw()[0]
    rows = [(a, b, float(g[i, j])) for i, a in enumerate(V.L_FEATURES) for j, b in enumerate(V.L_FEATURES)]
    return spark.createDataFrame(rows, "feature_i string, feature_j string, g double").withColumn("g", F.round("g", 5))


_METRICS = "round(avg(2 * abs(y - p) / (abs(y) + abs(p) + 1e-12)) * 100, 4) AS smape, round(avg(abs(y - p) / (abs(y) + 1e-12)) * 100, 4) AS mape, round(sqrt(avg((y - p) ** 2)), 5) AS rmse, round(avg(abs(y - p)), 5) AS mae, round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 6) AS r2"


def _metrics(df: DataFrame) -> DataFrame:
    found = stats.metrics(df)
    return found.select("split", *[F.round(c, d).alias(c) for c, d in (("smape", 4), ("mape", 4), ("rmse", 5), ("mae", 5), ("r2", 6))])


@query(f"WITH {V.WINDOW_SQL}, f AS (SELECT regr_slope(y, value) AS b, regr_intercept(y, value) AS a FROM wm WHERE split = 'train'), p AS (SELECT split, y, a + b * value AS p FROM wm, f) SELECT split, {_METRICS} FROM p GROUP BY split")
def ols_metrics(spark, sf_dir):
    """Windows of the split, z-scores by the training rows, a line from value to y, errors in the target's own units."""
    rows = _windows(spark, sf_dir)
    scaler = frame.fit_scaler(rows.where("split = 'train'"), ["value", "y"])
    z = frame.scale(rows.withColumn("truth", F.col("y")), scaler, ["value", "y"])
    line = z.where("split = 'train'").agg(F.regr_slope("y", "value").alias("b"), F.regr_intercept("y", "value").alias("a"))
    z = z.crossJoin(F.broadcast(line)).withColumn("p", F.col("a") + F.col("b") * F.col("value"))  # one row
    y = scaler.where("feature = 'y'").select(F.col("mean").alias("_m"), F.col("std").alias("_s"))
    return _metrics(z.crossJoin(F.broadcast(y)).select("split", F.col("truth").alias("y"), (F.col("p") * F.col("_s") + F.col("_m")).alias("prediction")))


_RULES = [("quantity <= 25.0 & discount > 0.05", "rule", 1.5), ("tax > 0.04", "rule", -0.75), ("quantity > 10.0 and tax <= 0.06 & linenumber < 4", "rule", 0.4), ("discount", "linear", -2.0)]
_CONDITIONS = ["quantity <= 25.0 AND discount > 0.05", "tax > 0.04", "quantity > 10.0 AND tax <= 0.06 AND linenumber < 4"]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_table(spark, V.l_rows(spark, sf_dir), _RULES)


@query(f"WITH {V.L_SQL} " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS rule_id, count_if({c})::BIGINT AS n_true, round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS support FROM li" for i, c in enumerate(_CONDITIONS)))
def rule_indicator(spark, sf_dir):
    return rules.rule_support(V.l_rows(spark, sf_dir), [r for r, kind, _ in _RULES if kind == "rule"]).withColumn("support", F.round("support", 6))


_RULE_SQL = f"WITH {V.L_SQL}, r(features, kind, coef, support) AS (" + " UNION ALL ".join(
    f"SELECT {f}, '{kind}', {coef}, {s}" for f, (_, kind, coef), s in zip(
        ("['quantity','discount']", "['tax']", "['quantity','tax','linenumber']", "['discount']"), _RULES,
        [*[f"(SELECT avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) FROM li)" for c in _CONDITIONS], "1.0"], strict=True)) + ")"


@query(_RULE_SQL + " SELECT feature, round(sum(abs(coef) * support / len(features)), 6) AS importance FROM (SELECT *, unnest(features) AS feature FROM r) GROUP BY feature")
def rule_importance(spark, sf_dir):
    return rules.importance(_rules(spark, sf_dir), V.L_FEATURES).withColumn("importance", F.round("importance", 6))


@query(_RULE_SQL + ", a AS (SELECT row_number() OVER () AS id, * FROM r WHERE kind = 'rule'), e AS (SELECT id, coef, support, unnest(features) AS f FROM a) SELECT x.f AS feature_i, y.f AS feature_j, round(sum(abs(x.coef) * x.support), 6) AS weight FROM e x JOIN e y ON x.id = y.id AND x.f <> y.f GROUP BY 1, 2")
def rule_cooccurrence(spark, sf_dir):
    return rules.cooccurrence(_rules(spark, sf_dir), V.L_FEATURES).withColumn("weight", F.round("weight", 6))


@query("SELECT p_brand AS feature, round(sum(p_retailprice), 4) AS score FROM part GROUP BY 1 ORDER BY score DESC, feature LIMIT 10")
def top_features(spark, sf_dir):
    rows = V.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.sum("p_retailprice"), 4).alias("score"))
    return rows.orderBy(F.desc("score"), "feature").limit(10)


@query(f"WITH {V.L_SQL} SELECT benchmark, round(sum(CASE WHEN abs(z) <= 0.3 THEN 0.0 WHEN abs(z) <= 1.5 THEN sign(z) * (abs(z) - 0.3) / 0.8 ELSE z END), 4) AS total FROM (SELECT benchmark, (quantity - 25) / 15 AS z FROM li) GROUP BY 1")
def mcp_threshold(spark, sf_dir):
    z = (F.col("quantity") - 25) / 15
    return V.l_rows(spark, sf_dir).groupBy("benchmark").agg(F.round(F.sum(S.mcp_threshold(z, 0.3, 5.0)), 4).alias("total"))


@query(f"WITH {V.E_SQL}, t AS (SELECT benchmark, count(*) AS n FROM ev GROUP BY 1) SELECT event_id, CAST(CASE WHEN row_idx < (n % 3) * (n // 3 + 1) THEN row_idx // (n // 3 + 1) ELSE (row_idx - n % 3) // (n // 3) END AS INTEGER) AS fold FROM ev JOIN t USING (benchmark)")
def kfold_assign(spark, sf_dir):
    """Contiguous folds of every benchmark's rows, each by its own count."""
    rows = V.e_view(spark, sf_dir)
    counts = rows.groupBy("benchmark").agg(F.count("*").alias("n"))  # one row a benchmark
    return rows.join(F.broadcast(counts), "benchmark").select("event_id", stats.fold_of(F.col("row_idx"), F.col("n"), 3).alias("fold"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 14 THEN p_name ELSE substr(p_name, 1, 8) || '...' || right(p_name, 3) END AS short, regexp_replace(p_type || '/' || p_name, '[^A-Za-z0-9_.-]+', '_', 'g')[1:120] AS job FROM part")
def labels_short(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", S.shortened(F.col("p_name"), 14).alias("short"), S.job_name(F.concat("p_type", F.lit("/"), "p_name")).alias("job"))


@query("SELECT o_orderkey, round(CASE WHEN o_totalprice = 0 THEN 0 ELSE round(o_totalprice * 10 ** (2 - floor(log10(abs(o_totalprice))))) / 10 ** (2 - floor(log10(abs(o_totalprice)))) END, 6) AS price FROM orders")
def significant_digits(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.significant(F.col("o_totalprice"), 3), 6).alias("price"))


from ..operators import rules  # noqa: E402
