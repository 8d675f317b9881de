"""Queries over predictions, runs and paired comparisons.

Predictions are derived from the event stream: every event row carries a truth, a
predicted class and probabilities computed from its identifiers.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from renewscope.config import EVENTS_STUDY, MODEL_CLASSES, MOVEMENT_CLASSES, RUN_SEEDS, TAU_GRID
from renewscope.functions.scalar import argmax_index, code_of, mean_se_text, movement_class, name_of, user_uniform
from renewscope.operators import metrics as M
from renewscope.operators import paired as P
from renewscope.operators.explore import mean_se
from renewscope.plans.catalog import table_query
from renewscope.plans.sqltext import md5_mod_sql
from renewscope.sources.adapters import table


def predictions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    q = F.array(*[((i * k + u) % 10 + 1).cast("double") for k in (3, 5, 7)])
    total = F.aggregate(q, F.lit(0.0), lambda a, x: a + x)
    return e.select(
        "event_id", "user_id", "event_type", "value",
        (i % 4).cast("int").alias("y"),
        F.when(i % 3 == 0, i % 4).otherwise((i * 7 + u) % 4).cast("int").alias("p"),
        (42 + i % 5).cast("int").alias("seed"), (i % 2).alias("arm"),
        (((i * 13 + u) % 100) / 100).alias("p_renew"),
        F.transform(q, lambda x: x / total).alias("q"),
    ).withColumn("movement", argmax_index(F.col("q"))).withColumn(
        "probs", M.compose_probabilities(F.col("p_renew"), F.col("q")))


_CTES = {
    "pred": """
SELECT *, CASE WHEN q1 >= q2 AND q1 >= q3 THEN 0 WHEN q2 >= q3 THEN 1 ELSE 2 END AS movement,
  1 - p_renew AS c0, p_renew * q1 AS c1, p_renew * q2 AS c2, p_renew * q3 AS c3
FROM (SELECT event_id, user_id, event_type, value, CAST(event_id % 4 AS INT) AS y,
  CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE (event_id * 7 + user_id) % 4 END AS INT) AS p,
  CAST(42 + event_id % 5 AS INT) AS seed, event_id % 2 AS arm,
  CAST((event_id * 13 + user_id) % 100 AS DOUBLE) / 100 AS p_renew,
  ((event_id * 3 + user_id) % 10 + 1) / CAST(s AS DOUBLE) AS q1,
  ((event_id * 5 + user_id) % 10 + 1) / CAST(s AS DOUBLE) AS q2,
  ((event_id * 7 + user_id) % 10 + 1) / CAST(s AS DOUBLE) AS q3
  FROM (SELECT *, (event_id * 3 + user_id) % 10 + (event_id * 5 + user_id) % 10 + (event_id * 7 + user_id) % 10 + 3 AS s
        FROM events))""",
    "per_seed": """
SELECT seed, cls, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM (
  SELECT seed, y AS cls, 1 AS support, 0 AS predicted, CAST(y = p AS INT) AS hits FROM pred
  UNION ALL SELECT seed, p, 0, 1, 0 FROM pred) GROUP BY 1, 2""",
    "per_class": """
SELECT seed, cls, hits / nullif(predicted, 0) AS precision, hits / nullif(support, 0) AS recall,
  2 * hits / (support + predicted) AS f1, support, hits FROM per_seed""",
    "runs": """
SELECT seed, sum(hits) / sum(support) AS accuracy, avg(recall) AS balanced_acc, avg(f1) AS macro_f1,
  sum(f1 * support) / sum(support) AS weighted_f1, sum(support) AS n FROM per_class GROUP BY 1""",
    "cm": """
SELECT s.seed, a.y, b.p, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY s.seed, a.y) AS share
FROM (SELECT DISTINCT seed FROM pred) s, (SELECT unnest(range(4)) AS y) a, (SELECT unnest(range(4)) AS p) b
LEFT JOIN (SELECT seed, y, p, count(*) AS n FROM pred GROUP BY 1, 2, 3) c
  ON c.seed = s.seed AND c.y = a.y AND c.p = b.p""",
    "imp": """
SELECT *, gain / sum(gain) OVER (PARTITION BY run) AS gain_share,
  rank() OVER (PARTITION BY run ORDER BY gain DESC) AS rank
FROM (SELECT CAST(event_id % 5 AS INT) AS run, 'f' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS feature,
  sum(round(value * 100)) / 100 AS gain FROM events GROUP BY 1, 2)""",
    "robust": """
SELECT feature, avg(gain_share) AS mean_share, stddev_samp(gain_share) AS sd_share,
  stddev_samp(gain_share) / sqrt(count(*)) AS se_share, median(gain_share) AS median_share, avg(rank) AS mean_rank,
  count(*) FILTER (WHERE rank <= 5) AS top5_count, count(*) FILTER (WHERE rank <= 10) AS top10_count, count(*) AS n_runs
FROM imp GROUP BY 1""",
    "model_runs": """
SELECT seed, event_type AS model, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS macro_f1 FROM pred GROUP BY 1, 2""",
    "pairs": """
SELECT c.contrast, a.seed AS pair_id, a.macro_f1 AS a, b.macro_f1 AS b FROM (VALUES
  ('view-click', 'view', 'click'), ('view-error', 'view', 'error'), ('signup-purchase', 'signup', 'purchase'))
  c(contrast, ma, mb) JOIN model_runs a ON a.model = c.ma JOIN model_runs b ON b.model = c.mb AND b.seed = a.seed""",
    "diffs": """
SELECT contrast, count(*) AS n, avg(a - b) AS mean_diff, median(a - b) AS median_diff, stddev_samp(a - b) AS sd_diff,
  stddev_samp(a - b) / sqrt(count(*)) AS se_diff, count(*) FILTER (WHERE a > b) AS wins_a,
  count(*) FILTER (WHERE a = b) AS ties, count(*) FILTER (WHERE a < b) AS wins_b,
  avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t_stat FROM pairs GROUP BY 1""",
    # Degrees of freedom 4: p = 1 - sin(theta) * (1 + cos(theta)^2 / 2).
    "tests": """
SELECT *, 1 - sin(atan(abs(t_stat) / 2)) * (1 + cos(atan(abs(t_stat) / 2)) ** 2 / 2) AS p_t FROM diffs""",
    "numbered": """
SELECT contrast, a - b AS d, row_number() OVER (PARTITION BY contrast ORDER BY pair_id) - 1 AS i FROM pairs""",
    "perm": """
SELECT f.contrast, avg(CAST(f.stat >= o.obs - 1e-15 AS INT)) AS p_perm, count(*) AS n_perm
FROM (SELECT contrast, mask, abs(avg(CASE WHEN (mask >> i) & 1 = 1 THEN -d ELSE d END)) AS stat
      FROM numbered, (SELECT CAST(unnest(range(32)) AS BIGINT) AS mask) GROUP BY 1, 2) f
JOIN (SELECT contrast, abs(avg(d)) AS obs FROM numbered GROUP BY 1) o USING (contrast) GROUP BY 1""",
    "ranked": """
SELECT contrast, d, row_number() OVER (PARTITION BY contrast ORDER BY abs(d)) - 1 AS i,
  rank() OVER (PARTITION BY contrast ORDER BY abs(d)) + (count(*) OVER (PARTITION BY contrast, abs(d)) - 1) / 2.0 AS r,
  count(*) OVER (PARTITION BY contrast) AS n
FROM numbered WHERE d <> 0""",
    "wilcox": """
SELECT contrast, w_stat, least(1, 2 * avg(CAST(t <= w_stat AS INT))) AS p_wilcoxon FROM (
  SELECT contrast, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN 0 ELSE r END) AS t
  FROM ranked, (SELECT CAST(unnest(range(32)) AS BIGINT) AS mask) WHERE mask < (1 << n) GROUP BY 1, 2)
JOIN (SELECT contrast, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w_stat
      FROM ranked GROUP BY 1) USING (contrast) GROUP BY 1, 2""",
}


def _query(name, columns, sql=None):
    return table_query(name, columns, sql, _CTES)


_SCORES = "accuracy:f balanced_acc:f macro_f1:f weighted_f1:f n:i"


@_query("score_block_by_run", f"seed:i {_SCORES}", "SELECT * FROM runs")
def score_block_by_run(spark, sf_dir):
    return M.score_block(predictions(spark, sf_dir), ["seed"])


@_query("per_class_scores", "seed:i cls:i class_name precision:f recall:f f1:f support:i",
        "SELECT *, [" + ", ".join(f"'{c}'" for c in MODEL_CLASSES) + "][cls + 1] AS class_name FROM per_class")
def per_class_scores(spark, sf_dir):
    return M.per_class_report(predictions(spark, sf_dir), MODEL_CLASSES, ["seed"]).withColumnRenamed("class", "class_name")


_REPORT_AVG = "avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, sum(support) AS support"
_REPORT_WAVG = ", ".join(f"sum({m} * support) / sum(support) AS {m}" for m in ("precision", "recall", "f1"))


@_query("classification_report", "seed:i class_name precision:f recall:f f1:f support:i",
        "SELECT seed, [" + ", ".join(f"'{c}'" for c in MODEL_CLASSES) + "][cls + 1] AS class_name, precision, recall, f1, support "
        f"FROM per_class UNION ALL SELECT seed, 'macro avg', {_REPORT_AVG} FROM per_class GROUP BY 1 "
        f"UNION ALL SELECT seed, 'weighted avg', {_REPORT_WAVG}, sum(support) FROM per_class GROUP BY 1 "
        "UNION ALL SELECT seed, 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), "
        "sum(support) FROM per_class GROUP BY 1")
def classification_report(spark, sf_dir):
    return M.classification_report(predictions(spark, sf_dir), MODEL_CLASSES, ["seed"]).withColumnRenamed(
        "class", "class_name")


@_query("confusion_matrix", "seed:i y:i p:i n:i share:f", "SELECT * FROM cm")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(predictions(spark, sf_dir), 4, ["seed"])


@_query("confusion_mean_se", "y:i p:i n_runs:i share_mean:f share_std:f share_se:f", """
SELECT y, p, count(*) AS n_runs, avg(share) AS share_mean, stddev_samp(share) AS share_std,
  stddev_samp(share) / sqrt(count(*)) AS share_se FROM cm GROUP BY 1, 2""")
def confusion_mean_se(spark, sf_dir):
    return M.confusion_mean_se(predictions(spark, sf_dir), 4)


@_query("confusion_pooled", "y:i p:i n:i share:f",
        "SELECT y, p, sum(n) AS n, sum(n) / sum(sum(n)) OVER (PARTITION BY y) AS share FROM cm GROUP BY 1, 2")
def confusion_pooled(spark, sf_dir):
    return M.confusion_matrix(predictions(spark, sf_dir), 4)


@_query("ranking_scores", "seed:i roc_auc:f average_precision:f", """
SELECT seed, auc.roc_auc, ap.average_precision FROM (
  SELECT seed, (sum(r) FILTER (WHERE pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(1 - pos)) AS roc_auc
  FROM (SELECT seed, pos, rank() OVER (PARTITION BY seed ORDER BY p_renew)
      + (count(*) OVER (PARTITION BY seed, p_renew) - 1) / 2.0 AS r
    FROM (SELECT seed, p_renew, CAST(y > 0 AS INT) AS pos FROM pred)) GROUP BY 1) auc
JOIN (SELECT seed, sum(pos * tp / n_above) / sum(pos) AS average_precision FROM (
    SELECT seed, pos, sum(pos) OVER w AS tp, count(*) OVER w AS n_above
    FROM (SELECT seed, p_renew, CAST(y > 0 AS INT) AS pos FROM pred)
    WINDOW w AS (PARTITION BY seed ORDER BY p_renew DESC RANGE UNBOUNDED PRECEDING)) GROUP BY 1) ap USING (seed)""")
def ranking_scores(spark, sf_dir):
    pred = predictions(spark, sf_dir).withColumn("pos", (F.col("y") > 0).cast("int"))
    return M.ranking_scores(pred, "p_renew", "pos", ["seed"])


@_query("rmse_by_run", "seed:i rmse:f", "SELECT seed, sqrt(avg((value - p_renew) ** 2)) AS rmse FROM pred GROUP BY 1")
def rmse_by_run(spark, sf_dir):
    return M.rmse(predictions(spark, sf_dir), "value", "p_renew", ["seed"])


@_query("composed_probabilities", "event_id:i c0:f c1:f c2:f c3:f best:i", """
SELECT event_id, c0, c1, c2, c3, CASE WHEN c0 >= c1 AND c0 >= c2 AND c0 >= c3 THEN 0 WHEN c1 >= c2 AND c1 >= c3 THEN 1
  WHEN c2 >= c3 THEN 2 ELSE 3 END AS best FROM pred""")
def composed_probabilities(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    return pred.select("event_id", *[F.col("probs")[i].alias(f"c{i}") for i in range(4)],
                       argmax_index(F.col("probs")).alias("best"))


_TAUS = ", ".join(f"CAST({t!r} AS DOUBLE)" for t in TAU_GRID)
_TAU_SCORES = f"""
SELECT tau, avg(f1) AS macro_f1, sum(hits) / sum(support) AS accuracy FROM (
  SELECT tau, cls, 2 * sum(hits) / (sum(support) + sum(predicted)) AS f1, sum(hits) AS hits, sum(support) AS support FROM (
    SELECT tau, y AS cls, 1 AS support, 0 AS predicted, CAST(y = d AS INT) AS hits FROM tau_pred
    UNION ALL SELECT tau, d, 0, 1, 0 FROM tau_pred) GROUP BY 1, 2) GROUP BY 1"""
_CTES["tau_pred"] = (f"SELECT tau, y, CASE WHEN p_renew < tau THEN 0 ELSE movement + 1 END AS d FROM pred, "
                     f"(SELECT unnest([{_TAUS}]) AS tau)")
_CTES["tau_scored"] = _TAU_SCORES


@_query("renewal_threshold_scores", "tau:f macro_f1:f accuracy:f", "SELECT * FROM tau_scored")
def renewal_threshold_scores(spark, sf_dir):
    return M.tau_scores(predictions(spark, sf_dir))


@_query("best_renewal_threshold", "tau:f macro_f1:f",
        "SELECT tau, macro_f1 FROM tau_scored ORDER BY round(macro_f1, 12) DESC, tau LIMIT 1")
def best_renewal_threshold(spark, sf_dir):
    return M.best_tau(predictions(spark, sf_dir))


def weight_vectors(n: int) -> list[list[float]]:
    """Repeatable weights in [0.5, 1.9], the first vector being all ones."""
    def draw(i, j):
        digest = hashlib.md5(f"w:{i}:{j}".encode()).hexdigest()
        return round(0.5 + 1.4 * (int(digest, 16) % 1000) / 1000, 4)

    return [[1.0] * 4] + [[draw(i, j) for j in range(4)] for i in range(1, n)]


#: As many vectors as the published search draws.
_WEIGHTS = weight_vectors(6000)
_CTES["weighted"] = f"""
SELECT weight_id, y, CASE WHEN a >= b AND a >= c AND a >= d THEN 0 WHEN b >= c AND b >= d THEN 1 WHEN c >= d THEN 2 ELSE 3 END AS p
FROM (SELECT weight_id, y, c0 * w[1] AS a, c1 * w[2] AS b, c2 * w[3] AS c, c3 * w[4] AS d FROM pred,
  (SELECT unnest(range({len(_WEIGHTS)})) AS weight_id, unnest({[[float(x) for x in w] for w in _WEIGHTS]}::DOUBLE[][]) AS w))"""
_CTES["weight_scored"] = """
SELECT weight_id, avg(f1) AS macro_f1 FROM (
  SELECT weight_id, cls, 2 * sum(hits) / (sum(support) + sum(predicted)) AS f1 FROM (
    SELECT weight_id, y AS cls, 1 AS support, 0 AS predicted, CAST(y = p AS INT) AS hits FROM weighted
    UNION ALL SELECT weight_id, p, 0, 1, 0 FROM weighted) GROUP BY 1, 2) GROUP BY 1"""


@_query("decision_weight_scores", "weight_id:i macro_f1:f", "SELECT * FROM weight_scored")
def decision_weight_scores(spark, sf_dir):
    return M.weight_scores(predictions(spark, sf_dir), _WEIGHTS)


@_query("best_decision_weights", "weight_id:i macro_f1:f",
        "SELECT weight_id, macro_f1 FROM weight_scored ORDER BY round(macro_f1, 12) DESC, weight_id LIMIT 1")
def best_decision_weights(spark, sf_dir):
    return M.best_weights(predictions(spark, sf_dir), _WEIGHTS)


@_query("ensemble_mean_vectors", "user_id:i c0:f c1:f c2:f c3:f best:i", """
SELECT *, CASE WHEN c0 >= c1 AND c0 >= c2 AND c0 >= c3 THEN 0 WHEN c1 >= c2 AND c1 >= c3 THEN 1
  WHEN c2 >= c3 THEN 2 ELSE 3 END AS best
FROM (SELECT user_id, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2, avg(c3) AS c3 FROM pred GROUP BY 1)""")
def ensemble_mean_vectors(spark, sf_dir):
    mean = M.ensemble_mean(predictions(spark, sf_dir), ["user_id"])
    return mean.select("user_id", *[F.col("probs")[i].alias(f"c{i}") for i in range(4)],
                       argmax_index(F.col("probs")).alias("best"))


def _arm_sql(ratio):
    return f"""
SELECT event_id, ratio, CASE WHEN ratio < 0.5 THEN 'CONTRACTION' WHEN ratio > 1.5 THEN 'EXPANSION' ELSE 'STABLE' END AS movement_class,
  CASE WHEN p_renew < 0.3 THEN 0 WHEN ratio < 0.5 THEN 1 WHEN ratio > 1.5 THEN 3 ELSE 2 END AS four_class
FROM (SELECT *, {ratio} AS ratio FROM pred)"""


def _arm(spark, sf_dir, arm):
    pred = predictions(spark, sf_dir)
    ratio = M.ratio_from_prediction(F.log1p("value") if arm == "volume" else F.col("p_renew"),
                                    F.col("user_id") + 0.37, arm)
    kept = pred.withColumn("ratio", ratio)
    return kept.select(
        "event_id", "ratio", movement_class(F.col("ratio"), 0.5, 1.5).alias("movement_class"),
        M.threshold_class(F.col("p_renew"), M.ratio_to_movement(F.col("ratio"), EVENTS_STUDY), F.lit(0.3)).alias("four_class"))


@_query("volume_arm_classes", "event_id:i movement_class four_class:i",
        _arm_sql("(exp(ln(1 + value)) - 1) / greatest(user_id + 0.37, 1e-9)"))
def volume_arm_classes(spark, sf_dir):
    return _arm(spark, sf_dir, "volume")


@_query("ratio_arm_classes", "event_id:i ratio:f movement_class four_class:i", _arm_sql("exp(p_renew) - 1"))
def ratio_arm_classes(spark, sf_dir):
    return _arm(spark, sf_dir, "ratio")


_BASE_U = md5_mod_sql("'base:' || CAST(event_id AS VARCHAR)", 1_000_000) + " / CAST(1000000 AS DOUBLE)"
_CTES["base_train"] = "SELECT y, count(*) AS n FROM pred WHERE seed > 42 GROUP BY 1"
_CTES["base_pred"] = f"""
SELECT s.strategy, t.y, (SELECT y FROM base_train ORDER BY n DESC, y LIMIT 1) AS p
FROM pred t, (SELECT unnest(['most_frequent', 'prior']) AS strategy) s WHERE t.seed = 42
UNION ALL SELECT 'stratified', t.y, (SELECT min(b.y) FROM (SELECT y, sum(n) OVER (ORDER BY y) / (SELECT sum(n) FROM base_train) AS upto
  FROM base_train) b WHERE b.upto > t.u) AS p FROM (SELECT *, {_BASE_U} AS u FROM pred WHERE seed = 42) t"""
_CTES["base_conf"] = """
SELECT strategy, cls, sum(support) AS support, sum(hits) AS hits, 2 * sum(hits) / (sum(support) + sum(predicted)) AS f1,
  sum(hits) / nullif(sum(support), 0) AS recall FROM (
  SELECT strategy, y AS cls, 1 AS support, 0 AS predicted, CAST(y = p AS INT) AS hits FROM base_pred
  UNION ALL SELECT strategy, p, 0, 1, 0 FROM base_pred) GROUP BY 1, 2"""


@_query("naive_baselines", f"strategy {_SCORES}", """
SELECT strategy, sum(hits) / sum(support) AS accuracy, avg(recall) AS balanced_acc, avg(f1) AS macro_f1,
  sum(f1 * support) / sum(support) AS weighted_f1, sum(support) AS n FROM base_conf GROUP BY 1""")
def naive_baselines(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    train = pred.where(F.col("seed") > 42)
    uniform = user_uniform(F.col("event_id").cast("string"), "base")
    return M.score_block(M.baseline_predictions(train, pred.where("seed = 42"), uniform), ["strategy"])


@_query("constant_regression_baseline", "movement_class n:i", """
SELECT CASE WHEN r < 0.5 THEN 'CONTRACTION' WHEN r > 1.5 THEN 'EXPANSION' ELSE 'STABLE' END AS movement_class, count(*) AS n
FROM (SELECT (exp((SELECT avg(ln(1 + value)) FROM pred WHERE seed > 42)) - 1) / greatest(user_id + 0.37, 1e-9) AS r
  FROM pred WHERE seed = 42) GROUP BY 1""")
def constant_regression_baseline(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    constant = pred.where("seed > 42").agg(F.avg(F.log1p("value"))).scalar()
    ratio = M.ratio_from_prediction(constant, F.col("user_id") + 0.37, "volume")
    return pred.where("seed = 42").groupBy(movement_class(ratio, 0.5, 1.5).alias("movement_class")).agg(
        F.count(F.lit(1)).alias("n"))


@_query("class_codes", "label code:i move_code:f back",
        "SELECT label, CAST(i AS INT) AS code, CASE WHEN i > 0 THEN i - 1 END AS move_code, label AS back FROM "
        "(SELECT unnest(['CHURN', 'CONTRACTION', 'STABLE', 'EXPANSION']) AS label, unnest(range(4)) AS i) "
        "WHERE i IN (SELECT y FROM pred)")
def class_codes(spark, sf_dir):
    seen = predictions(spark, sf_dir).select("y").distinct()
    names = seen.select(name_of(F.col("y"), MODEL_CLASSES).alias("label"))
    code = code_of(F.col("label"), MODEL_CLASSES)
    return names.select("label", code.alias("code"), code_of(F.col("label"), MOVEMENT_CLASSES).alias("move_code"),
                        name_of(code, MODEL_CLASSES).alias("back"))


def _runs(spark, sf_dir):
    pred = predictions(spark, sf_dir).withColumnRenamed("event_type", "model")
    hit = F.when(F.col("y") == F.col("p"), F.lit(1.0)).otherwise(F.lit(0.0))
    return pred.groupBy("seed", "model").agg(F.avg(hit).alias("macro_f1"))


@_query("run_summary", "model n_runs:i macro_f1_mean:f macro_f1_std:f macro_f1_se:f shown", """
SELECT *, printf('%.4f ± %.4f', macro_f1_mean, macro_f1_se) AS shown FROM (
  SELECT model, count(*) AS n_runs, avg(macro_f1) AS macro_f1_mean, stddev_samp(macro_f1) AS macro_f1_std,
    stddev_samp(macro_f1) / sqrt(count(*)) AS macro_f1_se FROM model_runs GROUP BY 1)""")
def run_summary(spark, sf_dir):
    s = mean_se(_runs(spark, sf_dir), ["model"], ["macro_f1"])
    return s.withColumn("shown", mean_se_text(F.col("macro_f1_mean"), F.col("macro_f1_se")))


@_query("champion_model", "model macro_f1_mean:f",
        "SELECT model, avg(macro_f1) AS macro_f1_mean FROM model_runs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def champion_model(spark, sf_dir):
    return M.champion(_runs(spark, sf_dir))


_MODELS = ("click", "error", "purchase", "signup", "view")


@_query("runs_by_seed", "seed:i " + " ".join(f"{m}:f" for m in _MODELS),
        "SELECT seed, " + ", ".join(f"max(macro_f1) FILTER (WHERE model = '{m}') AS {m}" for m in _MODELS)
        + " FROM model_runs GROUP BY 1")
def runs_by_seed(spark, sf_dir):
    return M.runs_wide(_runs(spark, sf_dir), _MODELS)


_BOARD = ("macro_f1", "balanced_acc", "accuracy", "weighted_f1")


@_query("leaderboard", "model " + " ".join(f"{m}:f" for m in _BOARD),
        "SELECT 'mean' AS model, " + ", ".join(f"avg({m}) AS {m}" for m in _BOARD) + " FROM runs UNION ALL "
        "SELECT 'run ' || seed, " + ", ".join(_BOARD) + " FROM runs")
def leaderboard(spark, sf_dir):
    runs = M.score_block(predictions(spark, sf_dir), ["seed"])
    single = runs.withColumn("model", F.concat(F.lit("run "), F.col("seed")))
    summary = mean_se(runs.withColumn("model", F.lit("mean")), ["model"], list(_BOARD))
    return M.leaderboard(summary, single)


@_query("importance_shares", "run:i feature gain_share:f rank:i", "SELECT * FROM imp")
def importance_shares(spark, sf_dir):
    return _importance(spark, sf_dir)


def _importance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    gain = e.groupBy(
        (F.col("event_id") % 5).cast("int").alias("run"),
        F.concat(F.lit("f"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("feature"),
    ).agg((F.sum(F.round(F.col("value") * 100)) / 100).alias("gain"))
    return M.importance_shares(gain)


@_query("importance_robustness", "feature mean_share:f sd_share:f se_share:f median_share:f mean_rank:f top5_count:i "
        "top10_count:i n_runs:i", "SELECT * FROM robust")
def importance_robustness(spark, sf_dir):
    return M.importance_robustness(_importance(spark, sf_dir))


@_query("importance_top10_overlap", "overlap:i", """
SELECT count(*) AS overlap FROM (SELECT feature FROM imp WHERE run = 0 ORDER BY gain_share DESC, feature LIMIT 10)
WHERE feature IN (SELECT feature FROM robust ORDER BY mean_share DESC, feature LIMIT 10)""")
def importance_top10_overlap(spark, sf_dir):
    return M.importance_overlap(_importance(spark, sf_dir), 0)


@_query("importance_in_every_run", "feature", "SELECT feature FROM robust WHERE top10_count = n_runs")
def importance_in_every_run(spark, sf_dir):
    return M.in_every_run(M.importance_robustness(_importance(spark, sf_dir)))


@_query("importance_shares_sum", "run:i total:f ok:i",
        "SELECT run, sum(gain_share) AS total, CAST(abs(sum(gain_share) - 1) <= 1e-6 AS INT) AS ok FROM imp GROUP BY 1")
def importance_shares_sum(spark, sf_dir):
    return M.sum_to_one(_importance(spark, sf_dir))


@_query("rounded_report", "model shown:f",
        "SELECT model, round_even(avg(macro_f1), 4) AS shown FROM model_runs GROUP BY 1")
def rounded_report(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("model").agg(F.bround(F.avg("macro_f1"), 4).alias("shown"))


_CONTRASTS = [("view-click", "view", "click"), ("view-error", "view", "error"), ("signup-purchase", "signup", "purchase")]


def _pairs(spark, sf_dir):
    return P.pair_runs(_runs(spark, sf_dir), _CONTRASTS)


@_query("paired_differences", "contrast n:i mean_diff:f median_diff:f sd_diff:f se_diff:f wins_a:i ties:i wins_b:i",
        "SELECT * FROM diffs")
def paired_differences(spark, sf_dir):
    return P.differences(_pairs(spark, sf_dir))


@_query("paired_t_tests", "contrast t_stat:f df:i p_t:f", "SELECT *, 4 AS df FROM tests")
def paired_t_tests(spark, sf_dir):
    return P.paired_t(_pairs(spark, sf_dir))


@_query("extreme_paired_differences", "contrast pair_id:i z:f", """
SELECT * FROM (SELECT contrast, pair_id, (a - b - avg(a - b) OVER w) / stddev_samp(a - b) OVER w AS z FROM pairs
  WINDOW w AS (PARTITION BY contrast)) WHERE abs(z) > 1.0""")
def extreme_paired_differences(spark, sf_dir):
    return P.extreme_differences(_pairs(spark, sf_dir), limit=1.0)


@_query("sign_flip_tests", "contrast p_perm:f n_perm:i", "SELECT * FROM perm")
def sign_flip_tests(spark, sf_dir):
    return P.sign_flip_p(_pairs(spark, sf_dir))


@_query("wilcoxon_tests", "contrast w_stat:f p_wilcoxon:f", "SELECT * FROM wilcox")
def wilcoxon_tests(spark, sf_dir):
    return P.wilcoxon_p(_pairs(spark, sf_dir))


@_query("holm_adjusted_tests", "contrast p_t_holm:f", """
SELECT contrast, least(1, max(scaled) OVER (ORDER BY p_t, contrast ROWS UNBOUNDED PRECEDING)) AS p_t_holm FROM (
  SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_t, contrast) + 1) * p_t AS scaled FROM tests)""")
def holm_adjusted_tests(spark, sf_dir):
    return P.holm(P.paired_t(_pairs(spark, sf_dir)), "p_t", "p_t_holm")


# Fixed value: 97.5 % point of Student's t with 4 degrees of freedom.
_T4 = 2.7764451051977987


@_query("paired_t_intervals", "contrast ci_lo:f ci_hi:f",
        f"SELECT contrast, mean_diff - {_T4} * se_diff AS ci_lo, mean_diff + {_T4} * se_diff AS ci_hi FROM diffs")
def paired_t_intervals(spark, sf_dir):
    return P.t_interval(P.paired_t(_pairs(spark, sf_dir)))


@_query("bootstrap_intervals", "contrast boot_lo:f boot_hi:f", """
SELECT contrast, quantile_cont(m, 0.025) AS boot_lo, quantile_cont(m, 0.975) AS boot_hi FROM (
  SELECT contrast, draw, avg(v.d) AS m FROM (
    SELECT contrast, draw, CAST('0x' || substr(md5('42:' || contrast || ':' || draw || ':' || (p.i + 1)), 1, 13) AS BIGINT) % n AS pick
    FROM numbered p JOIN (SELECT contrast, count(*) AS n FROM numbered GROUP BY 1) USING (contrast), (SELECT unnest(range(1, 10001)) AS draw)) k
  JOIN numbered v USING (contrast) WHERE v.i = k.pick GROUP BY 1, 2) GROUP BY 1""")
def bootstrap_intervals(spark, sf_dir):
    return P.bootstrap_interval(_pairs(spark, sf_dir))


@_query("paired_test_table", "contrast mean_diff:f ci_text wins_text t_stat:f p_t:f p_perm:f p_wilcoxon:f", f"""
SELECT contrast, mean_diff, printf('[%.4f, %.4f]', mean_diff - {_T4} * se_diff, mean_diff + {_T4} * se_diff) AS ci_text,
  wins_a || '/' || n AS wins_text, t_stat, p_t, p_perm, p_wilcoxon
FROM tests JOIN perm USING (contrast) JOIN wilcox USING (contrast)""")
def paired_test_table(spark, sf_dir):
    return P.paired_tests(_pairs(spark, sf_dir))


@_query("published_summary_check", "model n:i mean:f sd:f se:f min:f max:f reproduced:i", """
SELECT model, count(*) AS n, avg(macro_f1) AS mean, stddev_samp(macro_f1) AS sd,
  stddev_samp(macro_f1) / sqrt(count(*)) AS se, min(macro_f1) AS min, max(macro_f1) AS max,
  CAST(abs(avg(macro_f1) - avg(macro_f1) FILTER (model <> 'error' OR seed <> 42)) <= 1e-4 AND
    abs(stddev_samp(macro_f1) / sqrt(count(*)) - stddev_samp(macro_f1) FILTER (model <> 'error' OR seed <> 42)
      / sqrt(count(*) FILTER (model <> 'error' OR seed <> 42))) <= 1e-4 AS INT) AS reproduced
FROM model_runs GROUP BY 1""")
def published_summary_check(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    # The published table lacks a run of one model, whose row then can't be reproduced.
    published = runs.where((F.col("model") != "error") | (F.col("seed") != 42))
    return P.summary_check(runs, mean_se(published, ["model"], ["macro_f1"]))


@_query("run_table_problems", "model problem", """
SELECT model, 'unexpected seed' AS problem FROM (SELECT DISTINCT model FROM model_runs WHERE seed = 46)
UNION ALL SELECT 'absent', 'missing seed'""")
def run_table_problems(spark, sf_dir):
    return P.run_table_problems(_runs(spark, sf_dir), [*_MODELS, "absent"], RUN_SEEDS[:-1])


@_query("first_run_per_seed", "model seed:i event_id:i",
        "SELECT event_type AS model, seed, min(event_id) AS event_id FROM pred GROUP BY 1, 2")
def first_run_per_seed(spark, sf_dir):
    runs = predictions(spark, sf_dir).withColumnRenamed("event_type", "model")
    return P.first_per_seed(runs, "event_id")
