"""Registered queries for metrics, calibration, scoring analytics, explanations, preprocessing,
folds and bootstrap weights (SQL-checkable), plus the iterative model operators (rows-only)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.colref import c
from ..functions.exprs import apply_platt_expr
from ..operators import calibrate, explain, metrics, postscore, prep, stability
from ..operators.search import stratified_folds
from ..sources import readers
from . import fixtures as fx
from . import sql_fixtures as sq
from . import sql_metrics as sm
from .queries_core import labelled_cohort
from .registry import register, round_doubles

K4 = ["outcome", "featureset", "model", "fold"]
K3 = ["outcome", "featureset", "model"]
S4 = ", ".join(K4)
S3 = ", ".join(K3)
MET7 = metrics.METRIC_COLUMNS


def _preds(spark, sf_dir, alt=False):
    return fx.f_preds(spark, sf_dir, with_alt_model=alt)


# ------------------------------------------------------------------ H1-H8 metrics

def roc_auc_q(spark: SparkSession, sf_dir: str):
    return round_doubles(metrics.rank_metrics(_preds(spark, sf_dir), K4).select(*K4, "roc_auc"))


register("roc_auc", "H1", sq.with_(sq.F_PREDS, sm.rank_cte("rk", "F_preds", S4)) +
         f"SELECT {S4}, round(roc_auc, 6) AS roc_auc FROM rk")(roc_auc_q)


def pr_auc_q(spark: SparkSession, sf_dir: str):
    return round_doubles(metrics.rank_metrics(_preds(spark, sf_dir), K4).select(*K4, "pr_auc"))


register("pr_auc", "H2", sq.with_(sq.F_PREDS, sm.rank_cte("rk", "F_preds", S4)) +
         f"SELECT {S4}, round(pr_auc, 6) AS pr_auc FROM rk")(pr_auc_q)


def brier_q(spark: SparkSession, sf_dir: str):
    return round_doubles(metrics.point_metrics(_preds(spark, sf_dir), K4).select(*K4, "brier"))


register("brier", "H3", sq.with_(sq.F_PREDS, sm.point_cte("pt", "F_preds", S4)) +
         f"SELECT {S4}, round(brier, 6) AS brier FROM pt")(brier_q)


def accuracy_f1_q(spark: SparkSession, sf_dir: str):
    return round_doubles(metrics.point_metrics(_preds(spark, sf_dir), K4).select(*K4, "accuracy", "f1"))


register("accuracy_f1", "H4", sq.with_(sq.F_PREDS, sm.point_cte("pt", "F_preds", S4)) +
         f"SELECT {S4}, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM pt")(accuracy_f1_q)


def calibration_slope_q(spark: SparkSession, sf_dir: str):
    t = metrics.point_metrics(_preds(spark, sf_dir), K4)
    return round_doubles(t.select(*K4, "calibration_intercept", "calibration_slope"))


register("calibration_slope_intercept", "H5", sq.with_(sq.F_PREDS, sm.point_cte("pt", "F_preds", S4)) +
         f"SELECT {S4}, round(calibration_intercept, 6) AS calibration_intercept, "
         f"round(calibration_slope, 6) AS calibration_slope FROM pt")(calibration_slope_q)


def fold_metrics_table(spark: SparkSession, sf_dir: str, alt: bool = False):
    return metrics.fold_metrics_both(_preds(spark, sf_dir, alt), K4)


def fold_metrics_q(spark: SparkSession, sf_dir: str):
    return round_doubles(fold_metrics_table(spark, sf_dir))


register("fold_metrics", "H1-H5", sq.with_(sq.F_PREDS, sm.metrics_cte("mr", "F_preds", S4),
                                             sm.metrics_cte("mc", "F_preds", S4, p="prob_calibrated")) +
         f"SELECT {S4}, " + ", ".join(f"round(mr.{m}, 6) AS {m}" for m in MET7) + ", " +
         ", ".join(f"round(mc.{m}, 6) AS {m}_calibrated" for m in MET7) +
         f" FROM mr LEFT JOIN mc USING ({S4})")(fold_metrics_q)


def classification_summary_q(spark: SparkSession, sf_dir: str):
    return round_doubles(metrics.classification_summary(_preds(spark, sf_dir, True), K3))


_CLIP = "least(greatest(prob, 1e-6), 1 - 1e-6)"
register("classification_summary", "H6", sq.with_(
    sq.F_PREDS_ALT, f"cl AS (SELECT {S3}, y_true, {_CLIP} AS prob FROM F_preds WHERE y_true IS NOT NULL AND prob IS NOT NULL)",
    sm.rank_cte("rk", "cl", S3)) + f"""
SELECT {S3}, count(*) AS n, round(sum(y_true), 6) AS pos, round(avg(y_true), 6) AS pos_rate,
  round(max(rk.roc_auc), 6) AS roc_auc, round(max(rk.pr_auc), 6) AS pr_auc,
  round(avg((cl.prob - y_true) * (cl.prob - y_true)), 6) AS brier
FROM cl JOIN rk USING ({S3}) GROUP BY {S3}""")(classification_summary_q)


def mean_fold_metrics_q(spark: SparkSession, sf_dir: str):
    return round_doubles(metrics.mean_fold_metrics(fold_metrics_table(spark, sf_dir, True), K3))


_MEAN_SQL = sq.with_(sq.F_PREDS_ALT, sm.metrics_cte("mr", "F_preds", S4)) + f"""
, mean_t AS (SELECT {S3}, """ + ", ".join(f"avg({m}) AS mean_{m}" for m in MET7) + f""", count(roc_auc) AS n_folds
  FROM mr GROUP BY {S3})
"""
register("mean_fold_metrics", "H7", _MEAN_SQL + f"SELECT {S3}, " +
         ", ".join(f"round(mean_{m}, 6) AS mean_{m}" for m in MET7) + ", n_folds FROM mean_t")(mean_fold_metrics_q)


def best_model_q(spark: SparkSession, sf_dir: str):
    mean = metrics.mean_fold_metrics(fold_metrics_table(spark, sf_dir, True), K3)
    best = metrics.best_model_per_outcome(mean)
    return round_doubles(best.select(*K3, "mean_roc_auc", "mean_pr_auc", "n_folds"))


register("best_model_per_outcome", "H8", _MEAN_SQL + f"""
SELECT {S3}, round(mean_roc_auc, 6) AS mean_roc_auc, round(mean_pr_auc, 6) AS mean_pr_auc, n_folds FROM mean_t
WHERE mean_roc_auc IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY mean_roc_auc DESC, featureset, model) = 1""")(best_model_q)


# ------------------------------------------------------------------ I2, I5-I7 calibration tables

PLATT_A, PLATT_B = 0.026469, 1.053401  # published Platt intercept/slope of the reference's final model


def apply_platt_q(spark: SparkSession, sf_dir: str):
    p = fx.f_preds(spark, sf_dir)
    return round_doubles(p.select(*K3, "row_index", apply_platt_expr(c("prob"), PLATT_A, PLATT_B)
                                  .alias("prob_calibrated")))


_Q = "least(greatest(prob, 1e-6), 1 - 1e-6)"
register("apply_platt", "I2", sq.with_(sq.F_PREDS) + f"""
SELECT {S3}, row_index, round(1 / (1 + exp(-({PLATT_A} + {PLATT_B} * ln({_Q} / (1 - {_Q}))))), 6) AS prob_calibrated
FROM F_preds""")(apply_platt_q)


_BIN_COLS = ["bin_lo", "bin_hi", "pos", "pos_rate", "prob_mean", "prob_median"]


def binned_q(spark: SparkSession, sf_dir: str):
    return round_doubles(calibrate.binned_calibration(fx.f_preds(spark, sf_dir), K3).withColumn(
        "bin", c("bin").cast("long")))


register("binned_calibration", "I5", sq.with_(sq.F_PREDS, sm.binned_cte("bc", "F_preds", S3)) +
         f"SELECT {S3}, bin, n, {sm.round_cols(_BIN_COLS)} FROM bc")(binned_q)


def ece_q(spark: SparkSession, sf_dir: str):
    b = calibrate.binned_calibration(fx.f_preds(spark, sf_dir), K3)
    return round_doubles(calibrate.ece(b, K3))


register("ece", "I6", sq.with_(sq.F_PREDS, sm.binned_cte("bc", "F_preds", S3)) +
         f"SELECT {S3}, round(sum(n * abs(pos_rate - prob_mean)) / sum(n), 6) AS ece FROM bc GROUP BY {S3}")(ece_q)


def calibration_report_q(spark: SparkSession, sf_dir: str):
    return round_doubles(calibrate.calibration_report(fx.f_preds(spark, sf_dir), K3))


register("calibration_report", "I7", sq.with_(
    sq.F_PREDS, sm.binned_cte("br", "F_preds", S3), sm.binned_cte("bcal", "F_preds", S3, p="prob_calibrated")) + f"""
, er AS (SELECT {S3}, sum(n * abs(pos_rate - prob_mean)) / sum(n) AS ece FROM br GROUP BY {S3}),
ec AS (SELECT {S3}, sum(n * abs(pos_rate - prob_mean)) / sum(n) AS ece FROM bcal GROUP BY {S3}),
bs AS (SELECT {S3}, count(*) AS n,
  avg((prob - y_true) * (prob - y_true)) FILTER (WHERE prob IS NOT NULL AND y_true IS NOT NULL) AS brier_raw,
  avg((prob_calibrated - y_true) * (prob_calibrated - y_true))
    FILTER (WHERE prob_calibrated IS NOT NULL AND y_true IS NOT NULL) AS brier_calibrated
  FROM F_preds GROUP BY {S3})
SELECT {S3}, n, 10 AS ece_bins, round(er.ece, 6) AS ece_raw, round(brier_raw, 6) AS brier_raw,
  round(ec.ece, 6) AS ece_calibrated, round(brier_calibrated, 6) AS brier_calibrated
FROM bs LEFT JOIN er USING ({S3}) LEFT JOIN ec USING ({S3})""")(calibration_report_q)


# ------------------------------------------------------------------ L2-L6, M1-M10 post-prediction

def scores_long(spark: SparkSession, sf_dir: str):
    p = fx.f_preds(spark, sf_dir, with_alt_model=True)
    return p.select(c("row_index"), F.lit("cv").alias("tag"), *K3, "prob", "prob_calibrated",
                    F.when(c("model") == "elasticnet", 0).otherwise(1).alias("seq"))


def scores_wide_q(spark: SparkSession, sf_dir: str):
    return round_doubles(postscore.scores_wide(scores_long(spark, sf_dir), "row_index", "seq"))


def _scores_wide_sql() -> str:
    cols = []
    for o, _, _ in fx.PRED_OUTCOMES:
        for pc in ("prob", "prob_calibrated"):
            cols.append(f"round(arg_min({pc}, seq) FILTER (WHERE outcome = '{o}' AND {pc} IS NOT NULL), 6) "
                        f"AS \"cv__{o}__{pc}\"")
    return sq.with_(sq.F_PREDS_ALT) + "SELECT row_index, " + ", ".join(cols) + \
        " FROM (SELECT *, CASE WHEN model = 'elasticnet' THEN 0 ELSE 1 END AS seq FROM F_preds) GROUP BY row_index"


register("scores_wide", "L2", _scores_wide_sql())(scores_wide_q)


def wide_preds(spark: SparkSession, sf_dir: str):
    return postscore.predictions_wide(fx.f_preds(spark, sf_dir), outcomes=[o for o, _, _ in fx.PRED_OUTCOMES])


def predictions_wide_q(spark: SparkSession, sf_dir: str):
    return round_doubles(wide_preds(spark, sf_dir))


def _wide_sql_body() -> str:
    cols = []
    for o, _, _ in fx.PRED_OUTCOMES:
        cols += [f"arg_min(fold, fold) FILTER (WHERE outcome = '{o}') AS {o}_fold",
                 f"arg_min(y_true, fold) FILTER (WHERE outcome = '{o}') AS {o}_y_true",
                 f"avg(prob) FILTER (WHERE outcome = '{o}') AS {o}_prob",
                 f"avg(prob_calibrated) FILTER (WHERE outcome = '{o}') AS {o}_prob_calibrated"]
    return "wide AS (SELECT row_index, " + ", ".join(cols) + ", 'raw' AS prob_variant FROM F_preds GROUP BY row_index)"


_WIDE = sq.with_(sq.F_PREDS, _wide_sql_body())
_WIDE_ROUND = ", ".join(
    f"{o}_fold, {o}_y_true, round({o}_prob, 6) AS {o}_prob, round({o}_prob_calibrated, 6) AS {o}_prob_calibrated"
    for o, _, _ in fx.PRED_OUTCOMES)
register("predictions_wide", "M4", _WIDE + f"SELECT row_index, {_WIDE_ROUND}, prob_variant FROM wide")(
    predictions_wide_q)


def score_tiers_q(spark: SparkSession, sf_dir: str):
    """Scored models -> wide scores -> a tier column per tag and variant."""
    wide = postscore.scores_wide(scores_long(spark, sf_dir), "row_index", "seq", models=[("cv", o) for o, _, _ in fx.PRED_OUTCOMES])
    return round_doubles(postscore.assign_tiers(wide).select("row_index", "cv__tier__raw", "cv__tier__calibrated"))


def _score_tier_sql() -> str:
    def tier(suffix: str) -> str:
        h, g, d = (f'cv__{o}__{suffix}' for o, _, _ in fx.PRED_OUTCOMES)
        return (f"CASE WHEN {h} >= 0.8 AND {g} >= 0.7 THEN 'T3' WHEN {h} >= 0.8 OR {g} >= 0.7 OR {d} >= 0.7 THEN 'T2' "
                f"WHEN {h} >= 0.6 OR {g} >= 0.6 OR {d} >= 0.6 THEN 'T1' ELSE 'T0' END")
    best = ", ".join(f"arg_min({pc}, seq) FILTER (WHERE outcome = '{o}') AS cv__{o}__{pc}" for o, _, _ in fx.PRED_OUTCOMES for pc in ("prob", "prob_calibrated"))
    return sq.with_(sq.F_PREDS_ALT) + f""", w AS (SELECT row_index, {best}
  FROM (SELECT *, CASE WHEN model = 'elasticnet' THEN 0 ELSE 1 END AS seq FROM F_preds) GROUP BY row_index)
SELECT row_index, {tier("prob")} AS cv__tier__raw, {tier("prob_calibrated")} AS cv__tier__calibrated FROM w"""


register("score_tiers", "L2-L3", _score_tier_sql())(score_tiers_q)


def ladder(spark: SparkSession, sf_dir: str):
    return postscore.joint_risk_ladder(wide_preds(spark, sf_dir))


_TIER_SQL = """CASE WHEN hypertension_prob >= 0.8 AND hyperglycemia_prob >= 0.7 THEN 'T3'
  WHEN hypertension_prob >= 0.8 OR hyperglycemia_prob >= 0.7 OR dyslipidemia_prob >= 0.7 THEN 'T2'
  WHEN hypertension_prob >= 0.6 OR hyperglycemia_prob >= 0.6 OR dyslipidemia_prob >= 0.6 THEN 'T1' ELSE 'T0' END"""
_LADDER = _WIDE + f", ladder AS (SELECT row_index, {_TIER_SQL} AS tier, hypertension_prob, hyperglycemia_prob, " \
                  "dyslipidemia_prob, hypertension_y_true, hyperglycemia_y_true, dyslipidemia_y_true, " \
                  "'raw' AS prob_variant FROM wide)\n"


def ladder_q(spark: SparkSession, sf_dir: str):
    return round_doubles(ladder(spark, sf_dir))


register("joint_risk_ladder", "L3-L4", _LADDER + """
SELECT row_index, tier, round(hypertension_prob, 6) AS hypertension_prob, round(hyperglycemia_prob, 6) AS
  hyperglycemia_prob, round(dyslipidemia_prob, 6) AS dyslipidemia_prob, hypertension_y_true, hyperglycemia_y_true,
  dyslipidemia_y_true, prob_variant FROM ladder""")(ladder_q)


def tier_summary_q(spark: SparkSession, sf_dir: str):
    return round_doubles(postscore.tier_summary(ladder(spark, sf_dir)))


register("tier_summary", "L5", _LADDER + "SELECT tier, count(*) AS n, " + ", ".join(
    f"sum(({o}_y_true = 1)::INT)::BIGINT AS {o}_pos, round(avg(COALESCE(({o}_y_true = 1)::INT, 0)), 6) AS {o}_pos_rate, "
    f"round(avg({o}_prob), 6) AS {o}_prob_mean" for o, _, _ in fx.PRED_OUTCOMES) +
    ", 'raw' AS prob_variant FROM ladder GROUP BY tier")(tier_summary_q)


def tier_members_q(spark: SparkSession, sf_dir: str):
    return postscore.tier_members(ladder(spark, sf_dir))


register("tier_members", "L6", _LADDER + "SELECT row_index FROM ladder WHERE tier = 'T3'")(tier_members_q)

PICKS = ["hypertension:Q_PLUS_ANTHRO:elasticnet", "hyperglycemia:Q_PLUS_ANTHRO:xgboost",
         "dyslipidemia:Q_PLUS_ANTHRO:elasticnet"]


def selected_long(spark: SparkSession, sf_dir: str):
    picks = readers.load_picks(spark, PICKS)
    return postscore.selected_predictions_long(fx.f_preds(spark, sf_dir, with_alt_model=True), picks)


_SEL = sq.with_(sq.F_PREDS_ALT) + """, sel AS (SELECT *, prob AS prob_used,
  CASE WHEN y_true = 1 THEN 1 - prob ELSE prob END AS error FROM F_preds
  WHERE (outcome, featureset, model) IN (('hypertension', 'Q_PLUS_ANTHRO', 'elasticnet'),
    ('hyperglycemia', 'Q_PLUS_ANTHRO', 'xgboost'), ('dyslipidemia', 'Q_PLUS_ANTHRO', 'elasticnet')))
"""


def selected_long_q(spark: SparkSession, sf_dir: str):
    return round_doubles(selected_long(spark, sf_dir))


register("selected_predictions_long", "M1,A8", _SEL + """
SELECT fold, row_index, y_true, round(prob, 6) AS prob, round(prob_calibrated, 6) AS prob_calibrated, outcome,
  featureset, model, round(prob_used, 6) AS prob_used, round(error, 6) AS error FROM sel""")(selected_long_q)


def misclassification_q(spark: SparkSession, sf_dir: str):
    return round_doubles(postscore.misclassification_summary(selected_long(spark, sf_dir)))


register("misclassification_summary", "M2", _SEL + """
SELECT outcome, count(*) AS n, sum((y_true = 1)::INT)::BIGINT AS pos, round(avg(COALESCE((y_true = 1)::INT, 0)), 6)
  AS pos_rate, sum((y_true = 0 AND prob_used >= 0.9)::INT)::BIGINT AS n_fp,
  sum((y_true = 1 AND prob_used <= 0.1)::INT)::BIGINT AS n_fn, sum((error >= 0.9)::INT)::BIGINT AS n_high_error,
  'raw' AS prob_variant FROM sel GROUP BY outcome""")(misclassification_q)


def high_error_q(spark: SparkSession, sf_dir: str):
    return round_doubles(postscore.high_error_rows(selected_long(spark, sf_dir)))


register("high_error_rows", "M3", _SEL + """
SELECT fold, row_index, y_true, round(prob, 6) AS prob, round(prob_calibrated, 6) AS prob_calibrated, outcome,
  featureset, model, round(prob_used, 6) AS prob_used, round(error, 6) AS error,
  CASE WHEN y_true = 1 THEN 'FN_like' ELSE 'FP_like' END AS bad_type FROM sel WHERE error >= 0.9""")(high_error_q)

CTX_COLS = ["sbp", "waist", "sex"]


def high_conf_q(spark: SparkSession, sf_dir: str):
    ctx = fx.f_cohort(spark, sf_dir)
    return round_doubles(postscore.high_confidence_rows(wide_preds(spark, sf_dir), ctx, context_cols=CTX_COLS))


register("high_confidence_rows", "M5", sq.with_(sq.F_COHORT, sq.F_PREDS, _wide_sql_body()) + ", hc AS (" + " UNION ALL ".join(
    f"SELECT '{o}' AS outcome, CASE WHEN {o}_y_true = 1 AND {o}_prob <= 0.1 THEN 'HC_FN' "
    f"WHEN {o}_y_true = 0 AND {o}_prob >= 0.9 THEN 'HC_FP' END AS tag, row_index, {o}_y_true AS y_true, "
    f"{o}_prob AS prob FROM wide" for o, _, _ in fx.PRED_OUTCOMES) + """)
SELECT hc.outcome, hc.tag, hc.row_index, hc.y_true, round(hc.prob, 6) AS prob, round(c.sbp, 6) AS sbp,
  round(c.waist, 6) AS waist, c.sex
FROM hc LEFT JOIN F_cohort c ON hc.row_index = c.row_id WHERE hc.tag IS NOT NULL""")(high_conf_q)

NUM_PROFILE = ["sbp", "glucose", "waist", "spend"]
CAT_PROFILE = ["sex", "smoke", "urban", "butter"]
_GROUPS = " UNION ALL ".join(
    f"SELECT row_index AS _id, '{o}' AS outcome, CASE WHEN {o}_y_true = 1 AND {o}_prob <= 0.1 THEN 'HC_FN' "
    f"WHEN {o}_y_true = 1 THEN 'OTHER_POS' WHEN {o}_y_true = 0 THEN 'NEG' END AS \"group\" FROM wide"
    for o, _, _ in fx.PRED_OUTCOMES)


def numeric_profile_q(spark: SparkSession, sf_dir: str):
    ctx = fx.f_cohort(spark, sf_dir)
    return round_doubles(postscore.error_group_numeric_profile(wide_preds(spark, sf_dir), ctx, NUM_PROFILE))


register("error_group_numeric_profile", "M6", sq.with_(sq.F_COHORT, sq.F_PREDS, _wide_sql_body()) +
         f", g AS (SELECT * FROM ({_GROUPS}) WHERE \"group\" IS NOT NULL), long AS (" + " UNION ALL ".join(
             f"SELECT row_id AS _id, '{n}' AS \"column\", {n}::DOUBLE AS v FROM F_cohort" for n in NUM_PROFILE) + """)
SELECT outcome, "group", "column", count(v) AS n, sum((v IS NULL)::INT)::BIGINT AS missing, round(avg(v), 6) AS mean,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10,
  round(quantile_cont(v, 0.9), 6) AS p90
FROM g JOIN long USING (_id) GROUP BY outcome, "group", "column\"""")(numeric_profile_q)


def categorical_profile_q(spark: SparkSession, sf_dir: str):
    ctx = fx.f_cohort(spark, sf_dir)
    return round_doubles(postscore.error_group_categorical_profile(wide_preds(spark, sf_dir), ctx, CAT_PROFILE))


register("error_group_categorical_profile", "M7", sq.with_(sq.F_COHORT, sq.F_PREDS, _wide_sql_body()) +
         f", g AS (SELECT * FROM ({_GROUPS}) WHERE \"group\" IS NOT NULL), long AS (" + " UNION ALL ".join(
             (f"SELECT row_id AS _id, '{n}' AS \"column\", {n} AS value FROM F_cohort" if n != "butter" else
              f"SELECT row_id AS _id, '{n}' AS \"column\", CAST({n} AS VARCHAR) AS value FROM F_cohort")
             for n in CAT_PROFILE) + """),
sizes AS (SELECT outcome, "group", count(*) AS size FROM g JOIN F_cohort ON g._id = F_cohort.row_id GROUP BY 1, 2)
SELECT outcome, "group", "column", value, count(*) AS n, round(count(*) / max(size), 6) AS pct
FROM g JOIN long USING (_id) JOIN sizes USING (outcome, "group") GROUP BY outcome, "group", "column", value
""")(categorical_profile_q)


def greedy_prune_q(spark: SparkSession, sf_dir: str):
    p = fx.f_preds(spark, sf_dir, ["hypertension"])
    out = postscore.greedy_prune_curve(p, target_auc=0.9, limit=400)
    return round_doubles(out.withColumn("k", c("k").cast("long")))


register("greedy_prune_curve", "M8", sq.with_(sq.F_PREDS) + """,
v AS (SELECT row_index AS id, y_true AS y, prob AS score, CASE WHEN y_true = 1 THEN 1 - prob ELSE prob END AS error
      FROM F_preds WHERE outcome = 'hypertension'),
cand AS (SELECT *, row_number() OVER (ORDER BY error DESC, id) AS k FROM v QUALIFY k <= 400),
s AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM v GROUP BY score),
cum AS (SELECT *, COALESCE(sum(neg) OVER w, 0) AS neg_below, COALESCE(sum(pos) OVER w, 0) AS pos_below
        FROM s WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N, sum(pos * (neg_below + 0.5 * neg)) AS U FROM cum),
cw AS (SELECT cand.*, P, N, U, CASE WHEN y = 1 THEN neg_below + 0.5 * neg ELSE P - pos_below - 0.5 * pos END AS w
       FROM cand JOIN cum USING (score) CROSS JOIN tot),
corr AS (SELECT a.k, COALESCE(sum(CASE WHEN a.y <> b.y AND a.score = b.score THEN 0.5
                   WHEN a.y = 1 AND b.y = 0 AND b.score < a.score THEN 1
                   WHEN a.y = 0 AND b.y = 1 AND b.score > a.score THEN 1 ELSE 0 END), 0) AS corr
         FROM cand a LEFT JOIN cand b ON b.k < a.k GROUP BY a.k),
curve AS (SELECT cw.*, sum(w) OVER o AS sw, sum(corr) OVER o AS sc, sum(y) OVER o AS dp, sum(1 - y) OVER o AS dn
          FROM cw JOIN corr USING (k) WINDOW o AS (ORDER BY k)),
auc AS (SELECT *, CASE WHEN P - dp > 0 AND N - dn > 0 THEN (U - sw + sc) / ((P - dp) * (N - dn)) END AS auc_after
        FROM curve),
ks AS (SELECT COALESCE(min(k) FILTER (WHERE auc_after >= 0.9), 400) AS kstar FROM auc)
SELECT k, id AS row_index, y AS y_true, round(score, 6) AS prob, round(error, 6) AS error,
  round(auc_after, 6) AS auc_after
FROM auc CROSS JOIN ks WHERE k <= kstar AND U / (P * N) < 0.9""")(greedy_prune_q)


def tail_prune(spark: SparkSession, sf_dir: str):
    p = fx.f_preds(spark, sf_dir, ["dyslipidemia"])
    t3 = postscore.tier_members(ladder(spark, sf_dir))
    return postscore.per_class_tail_prune(p, t3, drop_per_iter=20)


def tail_prune_q(spark: SparkSession, sf_dir: str):
    return round_doubles(tail_prune(spark, sf_dir).withColumn("rank", c("rank").cast("long")))


_TAIL = _LADDER + """, t3 AS (SELECT row_index FROM ladder WHERE tier = 'T3'),
d AS (SELECT row_index, y_true, prob, CASE WHEN y_true = 1 THEN 1 - prob ELSE prob END AS error FROM F_preds
      WHERE outcome = 'dyslipidemia' AND row_index NOT IN (SELECT row_index FROM t3) AND y_true IN (0, 1)),
thr AS (SELECT y_true, quantile_cont(error, 0.95) AS t FROM d GROUP BY y_true),
tail AS (SELECT d.*, row_number() OVER (PARTITION BY d.y_true ORDER BY error DESC, row_index) AS rank
         FROM d JOIN thr USING (y_true) WHERE error > t QUALIFY rank <= 10)
"""
register("per_class_tail_prune", "M9", _TAIL + """
SELECT row_index, y_true, round(prob, 6) AS prob, round(error, 6) AS error, rank FROM tail""")(tail_prune_q)


def drop_rows_q(spark: SparkSession, sf_dir: str):
    cohort = fx.f_cohort(spark, sf_dir).select("row_id", "sbp", "sex")
    return round_doubles(postscore.drop_rows(cohort, tail_prune(spark, sf_dir)))


register("drop_rows", "M10", sq.with_(sq.F_COHORT) + _TAIL.replace("WITH ", ", ", 1) + """
SELECT row_id, round(sbp, 6) AS sbp, sex FROM F_cohort WHERE row_id NOT IN (SELECT row_index FROM tail)""")(drop_rows_q)


# ------------------------------------------------------------------ N1-N3 explanation tables

COEF_COLS = ["smoke", "sex", "urban", "segment"]
LABEL_MAP = {"smoke": "Smoking", "sex": "Sex", "urban": "Residence"}


def _coefs(spark: SparkSession, sf_dir: str):
    return explain.univariate_log_odds(labelled_cohort(spark, sf_dir), "y_risk_cluster", COEF_COLS)


_COEF_SQL = sq.with_(sq.F_OUTCOMES) + ", lab AS (SELECT * FROM F_outcomes WHERE y_risk_cluster IS NOT NULL), " \
    "tot AS (SELECT sum(y_risk_cluster) AS P, sum(1 - y_risk_cluster) AS N FROM lab), cells AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS col, {n} AS level, sum(y_risk_cluster) AS a, sum(1 - y_risk_cluster) AS b FROM lab "
        f"WHERE {n} IS NOT NULL GROUP BY {n}" for n in COEF_COLS) + """),
coefs AS (SELECT col || '=' || level AS feature, col AS source_feature,
  ln((a + 0.5) * (N - b + 0.5) / ((b + 0.5) * (P - a + 0.5))) AS coef FROM cells CROSS JOIN tot)
"""


def coefficient_table_q(spark: SparkSession, sf_dir: str):
    return round_doubles(explain.coefficient_table(_coefs(spark, sf_dir)))


register("coefficient_table", "N1", _COEF_SQL + """
SELECT feature, round(coef, 6) AS coef, round(abs(coef), 6) AS abs_coef, round(exp(coef), 6) AS odds_ratio,
  CASE WHEN coef >= 0 THEN 'risk↑' ELSE 'risk↓' END AS direction, source_feature, feature AS feature_label,
  source_feature AS source_label FROM coefs""")(coefficient_table_q)


def grouped_importance_q(spark: SparkSession, sf_dir: str):
    return round_doubles(explain.grouped_importance(explain.coefficient_table(_coefs(spark, sf_dir))))


register("grouped_importance", "N2", _COEF_SQL + """
SELECT source_feature, source_feature AS source_label, round(sum(abs(coef)), 6) AS sum_abs_coef FROM coefs
GROUP BY source_feature""")(grouped_importance_q)


def label_map_q(spark: SparkSession, sf_dir: str):
    t = explain.coefficient_table(_coefs(spark, sf_dir), LABEL_MAP)
    return t.select("feature", "source_feature", "feature_label", "source_label")


register("apply_label_map", "N3", _COEF_SQL + """,
m AS (SELECT * FROM (VALUES ('smoke', 'Smoking'), ('sex', 'Sex'), ('urban', 'Residence')) t(src, lab))
SELECT feature, source_feature, COALESCE(m.lab, source_feature) || '=' || substr(feature, strpos(feature, '=') + 1)
  AS feature_label, COALESCE(m.lab, source_feature) AS source_label
FROM coefs LEFT JOIN m ON coefs.source_feature = m.src""")(label_map_q)


# ------------------------------------------------------------------ E1-E8 preprocessing

NUM_FEATS = ["sbp", "dbp", "glucose", "tg", "waist"]
CAT_FEATS = ["smoke", "sex", "segment", "ethnicity"]


def median_imputer_q(spark: SparkSession, sf_dir: str):
    df = fx.f_cohort(spark, sf_dir)
    m = prep.MedianImputer(inputCols=NUM_FEATS).fit(df)
    return round_doubles(m.transform(df).select("row_id", *NUM_FEATS))


register("median_imputer", "E1", sq.with_(sq.F_COHORT) + "SELECT row_id, " + ", ".join(
    f"round(COALESCE({n}, (SELECT quantile_cont({n}, 0.5) FROM F_cohort)), 6) AS {n}" for n in NUM_FEATS) +
    " FROM F_cohort")(median_imputer_q)

_MODE_SQL = {n: f"(SELECT {n} FROM F_cohort WHERE {n} IS NOT NULL GROUP BY {n} ORDER BY count(*) DESC, {n} LIMIT 1)"
             for n in CAT_FEATS}


def mode_imputer_q(spark: SparkSession, sf_dir: str):
    df = fx.f_cohort(spark, sf_dir)
    return prep.ModeImputer(inputCols=CAT_FEATS).fit(df).transform(df).select("row_id", *CAT_FEATS)


register("mode_imputer", "E2", sq.with_(sq.F_COHORT) + "SELECT row_id, " + ", ".join(
    f"COALESCE({n}, {_MODE_SQL[n]}) AS {n}" for n in CAT_FEATS) + " FROM F_cohort")(mode_imputer_q)

_IMPUTED_CAT = sq.with_(sq.F_COHORT) + ", imp AS (SELECT row_id, " + ", ".join(
    f"COALESCE({n}, {_MODE_SQL[n]}) AS {n}" for n in CAT_FEATS) + " FROM F_cohort), rare AS (SELECT row_id, " + \
    ", ".join(f"CASE WHEN {n} IN (SELECT {n} FROM imp GROUP BY {n} HAVING count(*) / (SELECT count(*) FROM imp) "
              f">= 0.01) THEN {n} ELSE 'Other' END AS {n}" for n in CAT_FEATS) + " FROM imp)\n"


def _rare(spark: SparkSession, sf_dir: str):
    df = fx.f_cohort(spark, sf_dir)
    df = prep.ModeImputer(inputCols=CAT_FEATS).fit(df).transform(df)
    return prep.RareCategoryGrouper(inputCols=CAT_FEATS, minFreq=0.01).fit(df).transform(df)


def rare_grouper_q(spark: SparkSession, sf_dir: str):
    return _rare(spark, sf_dir).select("row_id", *CAT_FEATS)


register("rare_category_grouper", "E3", _IMPUTED_CAT + "SELECT row_id, " + ", ".join(CAT_FEATS) + " FROM rare")(
    rare_grouper_q)


def one_hot_q(spark: SparkSession, sf_dir: str):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    df = _rare(spark, sf_dir)
    idx = StringIndexer(inputCols=["smoke", "sex"], outputCols=["i_smoke", "i_sex"], stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(df).transform(df)
    ohe = OneHotEncoder(inputCols=["i_smoke", "i_sex"], outputCols=["v_smoke", "v_sex"], dropLast=True,
                        handleInvalid="error").fit(idx).transform(idx)
    active = [(F.array_position(vector_to_array(c(f"v_{n}")), 1.0) - 1).cast("long") for n in ("smoke", "sex")]
    return ohe.select("row_id", "smoke", active[0].alias("smoke_slot"), "sex", active[1].alias("sex_slot"))


register("one_hot", "E4", _IMPUTED_CAT + """
SELECT row_id, smoke, dense_rank() OVER (ORDER BY smoke) - 1 AS smoke_slot, sex,
  dense_rank() OVER (ORDER BY sex) - 1 AS sex_slot FROM rare""")(one_hot_q)

SCALE_FEATS = ["sbp", "waist", "tc"]


def standardize_q(spark: SparkSession, sf_dir: str):
    df = fx.f_cohort(spark, sf_dir)
    df = prep.MedianImputer(inputCols=SCALE_FEATS).fit(df).transform(df)
    return round_doubles(prep.PopulationScaler(inputCols=SCALE_FEATS).fit(df).transform(df).select("row_id", *SCALE_FEATS))


register("standardize", "E5", sq.with_(sq.F_COHORT) + ", imp AS (SELECT row_id, " + ", ".join(
    f"COALESCE({n}, (SELECT quantile_cont({n}, 0.5) FROM F_cohort)) AS {n}" for n in SCALE_FEATS) +
    " FROM F_cohort) SELECT row_id, " + ", ".join(
    f"round(CASE WHEN stddev_pop({n}) OVER () = 0 THEN 0.0 ELSE ({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () END, 6)"
    f" AS {n}" for n in SCALE_FEATS) + " FROM imp")(standardize_q)

N_KNOTS = 4


def spline_q(spark: SparkSession, sf_dir: str):
    df = fx.f_cohort(spark, sf_dir)
    df = prep.MedianImputer(inputCols=["glucose"]).fit(df).transform(df)
    m = prep.SplineBasis(inputCols=["glucose"], nKnots=N_KNOTS).fit(df)
    return round_doubles(m.transform(df).select("row_id", *m.outputCols()))


def _spline_sql() -> str:
    def b(u):
        return (f"CASE WHEN {u} >= 0 AND {u} < 1 THEN pow({u}, 3) / 6 "
                f"WHEN {u} >= 1 AND {u} < 2 THEN (-3 * pow({u}, 3) + 12 * pow({u}, 2) - 12 * {u} + 4) / 6 "
                f"WHEN {u} >= 2 AND {u} < 3 THEN (3 * pow({u}, 3) - 24 * pow({u}, 2) + 60 * {u} - 44) / 6 "
                f"WHEN {u} >= 3 AND {u} <= 4 THEN pow(4 - {u}, 3) / 6 ELSE 0 END")
    cols = []
    for j in range(N_KNOTS + 1):
        u = f"((x - (lo + ({j} - 3) * h)) / h)"
        cols.append(f"round({b(u)}, 6) AS glucose_sp{j}")
    return sq.with_(sq.F_COHORT) + """, imp AS (SELECT row_id,
  COALESCE(glucose, (SELECT quantile_cont(glucose, 0.5) FROM F_cohort)) AS g FROM F_cohort),
rng AS (SELECT min(g) AS lo, max(g) AS hi FROM imp),
xs AS (SELECT row_id, least(greatest(g, lo), hi) AS x, lo, (hi - lo) / """ + str(N_KNOTS - 1) + \
        """ AS h FROM imp CROSS JOIN rng)
SELECT row_id, """ + ", ".join(cols) + " FROM xs"


register("spline_basis", "E6", _spline_sql())(spline_q)


def class_weight_q(spark: SparkSession, sf_dir: str):
    return round_doubles(prep.class_weight_table(labelled_cohort(spark, sf_dir), "y_risk_cluster"))


register("balanced_class_weight", "E8", sq.with_(sq.F_OUTCOMES) + """
SELECT y_risk_cluster, count(*) AS n_c, round((SELECT count(*) FROM F_outcomes WHERE y_risk_cluster IS NOT NULL)
  / (2 * count(*)), 6) AS weight FROM F_outcomes WHERE y_risk_cluster IS NOT NULL GROUP BY y_risk_cluster""")(
    class_weight_q)


# ------------------------------------------------------------------ G1 folds, J1/J3 bootstrap

def folds_q(spark: SparkSession, sf_dir: str):
    df = labelled_cohort(spark, sf_dir).filter(c("y_risk_cluster").isNotNull()).select("row_id", "y_risk_cluster")
    return stratified_folds(df, "y_risk_cluster", k=5, seed=42, id_col="row_id")


register("stratified_folds", "G1", sq.with_(sq.F_OUTCOMES) + """
SELECT row_id, y_risk_cluster, ((row_number() OVER (PARTITION BY y_risk_cluster ORDER BY md5('42|' || row_id), row_id)
  - 1) % 5 + 1)::INTEGER AS fold FROM F_outcomes WHERE y_risk_cluster IS NOT NULL""")(folds_q)

N_DRAWS = 200
SMD_FEATS = ["sbp", "glucose", "tg", "waist", "spend"]


def _poisson_sql(u: str) -> str:
    return " + ".join(f"({u} >= {t!r})::INT" for t in stability.poisson_thresholds(0.7))


def bootstrap_weights_q(spark: SparkSession, sf_dir: str):
    df = fx.f_cohort(spark, sf_dir)
    return stability.bootstrap_weights(df, n_draws=N_DRAWS, frac=0.7, seed=42).withColumn("w", c("w").cast("long"))


_U = "(('0x' || substr(md5('42|' || draw || '|' || row_id), 1, 8))::BIGINT / 4294967296.0)"
_BOOT = sq.with_(sq.F_COHORT) + f""", bw AS (SELECT draw, row_id, ({_poisson_sql(_U)})::BIGINT AS w
  FROM F_cohort CROSS JOIN range(0, {N_DRAWS}) t(draw))
"""
register("bootstrap_weights", "J1", _BOOT + "SELECT draw::INTEGER AS draw, row_id, w FROM bw WHERE w > 0")(
    bootstrap_weights_q)


def stability_summary_q(spark: SparkSession, sf_dir: str):
    """Per Poisson draw, a weighted standardized mean difference per feature stands in for the per-draw
    fit (selected if |smd| > 0.1, sign of smd); the summary is the J3 aggregation over the draws table."""
    df = labelled_cohort(spark, sf_dir).filter(c("y_risk_cluster").isNotNull())
    sums = stability.draw_sums(df, "y_risk_cluster", SMD_FEATS, N_DRAWS, 0.7, 42, "row_id")
    of = lambda n, y: F.sum(F.when(c("y") == y, c(n)))
    s = sums.groupBy("draw", "feature").agg(
        (of("wx", 1) / of("w", 1)).alias("m1"), (of("wx", 0) / of("w", 0)).alias("m0"),
        (F.sum("wx") / F.sum("w")).alias("m"), (F.sum("wxx") / F.sum("w")).alias("m2"))
    smd = (c("m1") - c("m0")) / F.sqrt(c("m2") - c("m") * c("m"))
    draws = s.select("draw", "feature", (F.abs(smd) > 0.1).cast("double").alias("selected"),
                     F.signum(smd).alias("sign"))
    return stability.stability_summary(draws)


register("stability_summary", "J3", sq.with_(sq.F_OUTCOMES) + f""", lab AS (SELECT * FROM F_outcomes
  WHERE y_risk_cluster IS NOT NULL),
bw AS (SELECT draw, row_id, ({_poisson_sql(_U)}) AS w FROM lab CROSS JOIN range(0, {N_DRAWS}) t(draw)),
long AS (""" + " UNION ALL ".join(
    f"SELECT bw.draw, bw.w, lab.y_risk_cluster AS y, '{n}' AS feature, lab.{n} AS x FROM bw JOIN lab USING (row_id) "
    f"WHERE bw.w > 0 AND lab.{n} IS NOT NULL" for n in SMD_FEATS) + """),
s AS (SELECT draw, feature, sum(CASE WHEN y = 1 THEN w * x END) / sum(CASE WHEN y = 1 THEN w END) AS m1,
  sum(CASE WHEN y = 0 THEN w * x END) / sum(CASE WHEN y = 0 THEN w END) AS m0, sum(w * x) / sum(w) AS m,
  sum(w * x * x) / sum(w) AS m2 FROM long GROUP BY draw, feature),
d AS (SELECT draw, feature, (abs((m1 - m0) / sqrt(m2 - m * m)) > 0.1)::INT::DOUBLE AS selected,
  sign((m1 - m0) / sqrt(m2 - m * m)) AS sign FROM s),
ms AS (SELECT feature, avg(selected) AS inc, avg(sign) AS msign FROM d GROUP BY feature)
SELECT feature, round(max(inc), 6) AS inclusion_freq, round(avg((sign(d.sign) = sign(msign))::INT), 6)
  AS sign_consistency FROM d JOIN ms USING (feature) GROUP BY feature""")(stability_summary_q)

from . import queries_fit  # noqa: E402,F401  (iterative operators, rows-only check)
