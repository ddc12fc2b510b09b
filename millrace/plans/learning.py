"""Queries of selectors and models, over the embeddings' and events' views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frame, select, stats, tune
from . import fit
from . import views as V
from .registry import query


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' view, z-scored, in order."""
    rows = V.v_view(spark, sf_dir)
    rows = frame.scale(rows, frame.fit_scaler(rows, V.V_FEATURES), V.V_FEATURES)
    return frame.with_row_index(rows.withColumn("one", F.lit(0)), "one", ["vec_id"], "split_row_idx")


def _selected(method: str, rounded: bool, **hp):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = select.select(_vectors(spark, sf_dir), V.V_FEATURES, method, 5, hyperparams={method: hp})
        return found.withColumn("score", F.round("score", 6)) if rounded else found

    return run


_COLUMNS = ", ".join(V.V_FEATURES)
#: Information by all pairs of rows, without the noise that tells equal values apart.
_INFORMATION = f"""WITH {V.V_SQL}, u AS (SELECT vec_id, y, feature, v FROM (UNPIVOT vv ON {_COLUMNS} INTO NAME feature VALUE v)),
  z AS (SELECT vec_id, feature, v / stddev_pop(v) OVER (PARTITION BY feature) AS x, y / stddev_pop(y) OVER (PARTITION BY feature) AS y FROM u),
  d AS (SELECT a.feature, a.vec_id, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] AS d FROM z a JOIN z b ON a.feature = b.feature AND a.vec_id <> b.vec_id GROUP BY ALL),
  c AS (SELECT a.feature, a.vec_id, count(*) FILTER (abs(a.x - b.x) < d) AS nx, count(*) FILTER (abs(a.y - b.y) < d) AS ny
        FROM z a JOIN d ON a.feature = d.feature AND a.vec_id = d.vec_id JOIN z b ON a.feature = b.feature GROUP BY ALL),
  n AS (SELECT count(*) AS n FROM vv), h AS (SELECT i AS m, sum(CASE WHEN i > 1 THEN 1 / (i - 1) ELSE 0 END) OVER (ORDER BY i) - 0.5772156649015329 AS psi FROM (SELECT unnest(range(1, n + 1)) AS i FROM n)),
  s AS (SELECT feature, greatest(0, any_value(hn.psi) + any_value(hk.psi) - avg(hx.psi + hy.psi)) AS score
        FROM c JOIN h hx ON nx = hx.m JOIN h hy ON ny = hy.m, n JOIN h hn ON n = hn.m, h hk WHERE hk.m = 3 GROUP BY feature)
  SELECT row_number() OVER (ORDER BY score DESC, CAST(feature[2:] AS INTEGER))::INTEGER AS rank, feature, round(score, 6) AS score FROM s QUALIFY rank <= 5"""

#: Ridge by sweeping: a column swept once is in the model, swept again it is out; the target's column then has the coefficients.
_ELIMINATION = f"""WITH RECURSIVE {V.V_SQL}, u AS (SELECT vec_id, feature, v FROM (UNPIVOT vv ON {_COLUMNS}, y INTO NAME feature VALUE v)),
  z AS (SELECT vec_id, CASE WHEN feature = 'y' THEN 0 ELSE CAST(feature[2:] AS INTEGER) END AS c,
               (v - avg(v) OVER w) / CASE WHEN feature = 'y' THEN 1 ELSE stddev_pop(v) OVER w END AS v FROM u WINDOW w AS (PARTITION BY feature)),
  g AS MATERIALIZED (SELECT a.c AS i, b.c AS j, sum(a.v * b.v) + CASE WHEN a.c = b.c AND a.c > 0 THEN 1 ELSE 0 END AS v FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY a.c, b.c),
  r AS (SELECT 0 AS step, range(1, 65)::INTEGER[] AS todo, range(1, 65)::INTEGER[] AS kept, i, j, v FROM g
        UNION ALL
        SELECT step, todo, kept, i, j, v FROM (
          WITH now AS (SELECT any_value(step) AS step, any_value(todo) AS todo, any_value(kept) AS kept FROM r),
          worst AS (SELECT list(i ORDER BY v * v, i) AS c FROM r, now WHERE j = 0 AND list_contains(now.kept, i)),
          next AS (SELECT step + 1 AS step, kept, CASE WHEN len(todo) > 0 THEN todo ELSE c[1 : least(6, len(kept) - 5)] END AS todo FROM now, worst WHERE len(todo) > 0 OR len(kept) > 5),
          k AS (SELECT step, todo[1] AS k, todo[2:] AS todo, CASE WHEN step > 64 THEN list_filter(kept, lambda c: c <> todo[1]) ELSE kept END AS kept FROM next)
          SELECT k.step, k.todo, k.kept, r.i, r.j, CASE WHEN r.i = k AND r.j = k THEN 1 / d.v WHEN r.i = k THEN r.v / d.v WHEN r.j = k THEN -r.v / d.v ELSE r.v - col.v * row.v / d.v END AS v
          FROM r, k, r d, r col, r row WHERE d.i = k AND d.j = k AND col.i = r.i AND col.j = k AND row.i = k AND row.j = r.j))
  SELECT row_number() OVER (ORDER BY abs(v) DESC)::INTEGER AS rank, 'e' || i AS feature, round(abs(v), 6) AS score FROM r WHERE step = (SELECT max(step) FROM r) AND j = 0 AND list_contains(kept, i)"""

#: Forward search: matrices of the rows outside each of three folds, and of all rows (3), are swept by each chosen column; p has the fold's own rows.
_FORWARD = f"""WITH RECURSIVE {V.V_SQL}, n AS (SELECT count(*) AS n FROM vv), o AS (SELECT vv.*, row_number() OVER (ORDER BY vec_id) - 1 AS place, n FROM vv, n),
  q AS (SELECT *, CASE WHEN place < (n % 3) * (n // 3 + 1) THEN place // (n // 3 + 1) ELSE (place - n % 3) // (n // 3) END AS fold FROM o),
  u AS (SELECT fold, vec_id, feature, v FROM (UNPIVOT q ON {_COLUMNS}, y INTO NAME feature VALUE v)),
  z AS (SELECT fold, vec_id, CASE WHEN feature = 'y' THEN 0 ELSE CAST(feature[2:] AS INTEGER) END AS c, CASE WHEN feature = 'y' THEN v ELSE (v - avg(v) OVER w) / stddev_pop(v) OVER w END AS v FROM u WINDOW w AS (PARTITION BY feature)),
  t AS (SELECT f, z.* FROM z, (SELECT unnest(range(4)) AS f)), m AS (SELECT f, c, avg(v) AS m FROM t WHERE fold <> f GROUP BY f, c),
  e AS MATERIALIZED (SELECT t.f, fold, vec_id, t.c, v - m AS v FROM t JOIN m ON t.f = m.f AND t.c = m.c),
  g AS MATERIALIZED (SELECT a.f, a.c AS i, b.c AS j, sum(a.v * b.v) FILTER (a.fold <> a.f) + CASE WHEN a.c = b.c AND a.c > 0 THEN 1 ELSE 0 END AS v, coalesce(sum(a.v * b.v) FILTER (a.fold = a.f), 0) AS p
                     FROM e a JOIN e b ON a.f = b.f AND a.vec_id = b.vec_id GROUP BY a.f, a.c, b.c),
  y AS MATERIALIZED (SELECT fold AS f, var_pop(v) * count(*) AS total FROM z WHERE c = 0 GROUP BY fold),
  r AS (SELECT 0 AS step, []::INTEGER[] AS chosen, f, i, j, v FROM g
        UNION ALL
        SELECT step, chosen, f, i, j, v FROM (
          WITH now AS (SELECT any_value(step) AS step, any_value(chosen) AS chosen FROM r HAVING count(*) > 0),
          c AS (SELECT a.f, a.i AS k, a.v / d.v AS t FROM r a JOIN r d ON d.f = a.f AND d.i = a.i AND d.j = a.i, now WHERE a.j = 0 AND a.i > 0 AND a.f < 3 AND NOT list_contains(now.chosen, a.i)),
          w AS (SELECT f, k, k AS c, t AS w FROM c UNION ALL SELECT f, k, 0, -1 FROM c
                UNION ALL SELECT c.f, k, s.i, s.v - x.v * t FROM c JOIN r s ON s.f = c.f AND s.j = 0 JOIN r x ON x.f = c.f AND x.i = s.i AND x.j = k, now WHERE list_contains(now.chosen, s.i)),
          lost AS (SELECT a.f, a.k, sum(a.w * b.w * g.p) AS lost FROM w a JOIN w b ON a.f = b.f AND a.k = b.k JOIN g ON g.f = a.f AND g.i = a.c AND g.j = b.c GROUP BY a.f, a.k),
          best AS (SELECT k FROM lost JOIN y ON lost.f = y.f GROUP BY k ORDER BY sum(1 - lost / total) DESC, k LIMIT 1),
          k AS (SELECT now.step + 1 AS step, list_append(now.chosen, best.k) AS chosen, best.k AS k FROM now, best WHERE now.step < 5)
          SELECT k.step, k.chosen, r.f, r.i, r.j, CASE WHEN r.i = k AND r.j = k THEN 1 / d.v WHEN r.i = k THEN r.v / d.v WHEN r.j = k THEN -r.v / d.v ELSE r.v - col.v * row.v / d.v END AS v
          FROM r, k, r d, r col, r row WHERE d.f = r.f AND d.i = k AND d.j = k AND col.f = r.f AND col.i = r.i AND col.j = k AND row.f = r.f AND row.i = k AND row.j = r.j))
  SELECT row_number() OVER (ORDER BY abs(v) DESC)::INTEGER AS rank, 'e' || i AS feature, round(abs(v), 6) AS score FROM r WHERE step = 5 AND f = 3 AND j = 0 AND list_contains(chosen, i)"""

for _name, _method, _hp, _sql in (("fs_rfe", "rfe", {}, _ELIMINATION), ("fs_lasso", "from_model", {}, None), ("fs_forest", "from_model", {"estimator": "rf"}, None), ("fs_sequential", "sequential", {}, _FORWARD), ("fs_mcp", "mcp", {}, None), ("fs_deep", "deep", {}, None), ("fs_mutual_info", "univariate", {"score_func": "mutual_info"}, _INFORMATION)):
    _run = _selected(_method, rounded=_sql is not None, **_hp)
    _run.__name__ = _name
    query(*([_sql] if _sql else []))(_run)


def _modelled(algorithm: str, **hp):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = frame.window_mean(V.e_split(spark, sf_dir), [*V.E_FEATURES, "y"], V.WINDOW)
        result = fit.fit_windows(rows, V.E_FEATURES, fit.Settings(algorithm=algorithm, hyperparams=hp, n_trials=1, non_negative=False, intercept=True))
        return result.metrics

    return run


for _name, _algorithm, _hp in (("model_elastic_net", "ElasticNetCV", {}), ("model_gbdt", "GBDT", {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.3}), ("model_rulefit", "RuleFit", {"max_rules": 500, "tree_size": 4, "memory_par": 0.05}), ("model_mlp", "MLP", {}), ("model_transformer", "FTTransformer", {"lr": 3e-3, "d_token": 16, "n_blocks": 2, "dropout": 0.0, "d_ffn": 32})):
    _run = _modelled(_algorithm, **_hp)
    _run.__name__ = _name
    query()(_run)


@query()
def hpo_trials(spark, sf_dir):
    rows = frame.window_mean(V.e_split(spark, sf_dir), [*V.E_FEATURES, "y"], V.WINDOW)
    scaled, _ = fit.scaled(rows, V.E_FEATURES)
    parts = {s: scaled.where(F.col("split") == s).withColumnRenamed("bin", "split_row_idx") for s in ("train", "val")}
    return tune.study("ElasticNetCV", parts["train"], parts["val"], V.E_FEATURES, n_trials=4, intercept=True)[2]


@query()
def gbdt_interaction(spark, sf_dir):
    """Shapley interactions of boosted trees."""
    rows = frame.window_mean(V.e_split(spark, sf_dir), [*V.E_FEATURES, "y"], V.WINDOW)
    settings = fit.Settings(algorithm="GBDT", hyperparams={"n_estimators": 100, "max_depth": 3, "learning_rate": 0.3}, n_trials=1, non_negative=False, intercept=True)
    return fit.fit_windows(rows, V.E_FEATURES, settings).interaction


@query("SELECT event_id, value FROM events ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id LIMIT 500")
def row_sample(spark, sf_dir):
    """Five hundred rows by seed: the sample is the feature."""
    return frame.sampled(V.table(spark, sf_dir, "events"), 500, 42, ["event_id"]).select("event_id", "value")


@query("""WITH t AS (SELECT o_orderpriority AS study, o_orderkey, CAST(o_totalprice AS DOUBLE) / 1000 + (CASE WHEN o_orderstatus = 'F' THEN 50 ELSE 0 END) AS score, CAST(o_totalprice AS VARCHAR) AS price, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status FROM orders WHERE o_orderkey % 11 <> 0),
  r AS (SELECT study, score, param, value, try_cast(value AS DOUBLE) AS x FROM (UNPIVOT t ON price, cust, status INTO NAME param VALUE value)),
  w AS (SELECT study, param, min(x) AS low, max(x) AS high, count(x) = count(*) AS number, avg(score) AS mean, var_pop(score) AS var, count(*) AS n FROM r GROUP BY ALL),
  p AS (SELECT r.study, r.param, mean, var, n, score, CASE WHEN number THEN CAST(coalesce(least(3, CAST(floor((x - low) / nullif(high - low, 0) * 4) AS BIGINT)), 0) AS VARCHAR) ELSE value END AS part FROM r JOIN w ON r.study = w.study AND r.param = w.param),
  g AS (SELECT study, param, mean, var, n, count(*) AS k, avg(score) AS m FROM p GROUP BY study, param, mean, var, n, part),
  s AS (SELECT study, param, sum(k * (m - mean) ** 2) / n / var AS share FROM g WHERE n > 1 AND var > 0 GROUP BY study, param, var, n)
  SELECT study, param, round(share / sum(share) OVER (PARTITION BY study), 6) AS importance FROM s""")
def hpo_param_importance(spark, sf_dir):
    """Order priorities as studies, orders as trials; one in eleven failed."""
    o = V.table(spark, sf_dir, "orders")
    score = F.col("o_totalprice") / 1000 + F.when(F.col("o_orderstatus") == "F", 50).otherwise(0)
    params = F.create_map(*[c for name, col in (("price", "o_totalprice"), ("cust", "o_custkey"), ("status", "o_orderstatus")) for c in (F.lit(name), F.col(col).cast("string"))])
    trials = o.select(F.col("o_orderpriority").alias("study"), params.alias("params"), F.when(F.col("o_orderkey") % 11 != 0, score).otherwise(float("-inf")).alias("score"))
    return tune.importances(trials).withColumn("importance", F.round("importance", 6))


_GRAM = [*V.V_FEATURES, "y"]
_FOLDS = f"""WITH {V.V_SQL}, n AS (SELECT count(*) AS n FROM vv), o AS (SELECT vv.*, row_number() OVER (ORDER BY vec_id) - 1 AS i, n.n FROM vv, n),
  f AS (SELECT *, CAST(CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1) ELSE (i - n % 3) // (n // 3) END AS INTEGER) AS fold FROM o),
  u AS (SELECT fold, vec_id, feature, v FROM (UNPIVOT f ON {", ".join(_GRAM)} INTO NAME feature VALUE v)),
  s AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS d FROM u WHERE feature <> 'y' GROUP BY feature),
  z AS (SELECT fold, vec_id, u.feature, CASE WHEN u.feature = 'y' THEN v ELSE (v - m) / d END AS v FROM u LEFT JOIN s ON u.feature = s.feature)
  SELECT a.fold, count(*)::BIGINT AS n, a.feature AS feature_i, b.feature AS feature_j, round(sum(a.v * b.v), 4) + 0.0 AS product
  FROM z a JOIN z b ON a.fold = b.fold AND a.vec_id = b.vec_id GROUP BY ALL"""


@query(_FOLDS)
def fold_gram(spark, sf_dir):
    """Row counts, X'X, X'y and y'y of each of three folds, over all features."""
    rows = _vectors(spark, sf_dir)
    grams = stats.fold_grams(rows, V.V_FEATURES, "y", stats.fold_of(F.col("split_row_idx"), rows.count(), 3))
    made = [(k, int(g.n), a, b, round(float(g.products[i, j]), 4) + 0.0) for k, g in grams.items() for i, a in enumerate(_GRAM) for j, b in enumerate(_GRAM)]
    return spark.createDataFrame(made, "fold int, n bigint, feature_i string, feature_j string, product double")
