"""Registered queries for the iterative (model-fitting) operators.

Iterative fits have no SQL twin (the driver records a rows-only check); their
invariants are covered by tests.  They run on all labelled rows of the cohort
stand-in with small candidate lists; the full grids are parameters.  Where a fit
has a closed form on suitable columns (log odds of groups, group means), a query
with a SQL twin checks it.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colref import c
from ..operators import calibrate, explain, models, prep, scoring, search, stability
from ..session import scratch_path
from ..functions.rules import build_outcomes
from . import fixtures as fx
from . import sql_fixtures as sq
from .registry import register, round_doubles

Y = "y_risk_cluster"
NUM = ["tc", "ldl", "spend", "butter"]
CAT = ["smoke", "urban", "segment", "ethnicity"]
SEED = 42


def _cohort(spark: SparkSession, sf_dir: str):
    """The cohort with outcomes, checkpointed once to the shared checkpoint folder: the model queries
    filter on outcomes and run many jobs, so the rules are evaluated once and the lineage is cut."""
    return build_outcomes(fx.f_cohort(spark, sf_dir), fx.OUTCOMES_SPEC, checkpoint=True)


def _labelled(spark: SparkSession, sf_dir: str):
    """The labelled modelling table (read from the written cohort: nothing to release)."""
    df = _cohort(spark, sf_dir).filter(c(Y).isNotNull())
    return df.select(c("row_id").alias("_id"), c(Y).cast("double").alias("label"), *[c(n) for n in NUM + CAT])


def _split(spark: SparkSession, sf_dir: str):
    """Outer fold 1 of a stratified 5-fold split: train on folds 2-5, test on fold 1."""
    folded = search.stratified_folds(_labelled(spark, sf_dir), "label", 5, SEED, "_id", "_f")
    return folded.filter(c("_f") != 1).drop("_f"), folded.filter(c("_f") == 1).drop("_f")


def _fit_predict(kind: str, params: dict):
    def q(spark: SparkSession, sf_dir: str):
        train, test = _split(spark, sf_dir)
        pm = search.fit_pipeline(train, kind, params, CAT, NUM, SEED)
        out = models.predict_proba(pm, test)
        return round_doubles(out.select(c("_id").alias("row_index"), c("label").alias("y_true"), "prob"))
    return q


register("elasticnet", "F1,F5")(_fit_predict("elasticnet", {"C": 1.0, "l1_ratio": 0.5}))
register("boosted_trees", "F2,F5")(_fit_predict("boosted_trees", {"n_estimators": 20, "max_depth": 3,
                                                                  "learning_rate": 0.1, "subsample": 0.85,
                                                                  "colsample_bytree": 0.85}))
register("glassbox_additive", "F3,F5")(_fit_predict("glassbox_additive", {"max_bins": 16, "C": 1.0}))
register("gam_spline", "F4,F5")(_fit_predict("gam_spline", {"n_knots": 5}))


def preprocessor_q(spark: SparkSession, sf_dir: str):
    """E7: fitted preprocessor's slot table with the mean encoded value of each slot over all rows."""
    df = _labelled(spark, sf_dir)
    pm = prep.fit_preprocessor(df, CAT, NUM)  # the make_preprocessor pipeline, fitted in two scans
    slots = spark.createDataFrame(prep.slot_table(pm, CAT, NUM), "slot int, feature string, source string, level string")
    means = pm.transform(df).select(F.posexplode(vector_to_array("features")).alias("slot", "v")) \
        .groupBy("slot").agg(F.avg("v").alias("mean_value"))
    return round_doubles(slots.join(means, "slot", "left"))


def _preprocessor_sql() -> str:
    """Slots in order: numbers (standardized, so their mean is 0), then the kept levels of each text column."""
    parts = [f"SELECT {i} AS slot, '{n}' AS feature, '{n}' AS source, NULL AS level, 0.0::DOUBLE AS mean_value" for i, n in enumerate(NUM)]
    ctes = []
    for n in CAT:
        ctes.append(f"""m_{n} AS (SELECT COALESCE({n}, (SELECT {n} FROM lab WHERE {n} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {n} LIMIT 1)) AS v FROM lab),
f_{n} AS (SELECT v, count(*) AS k FROM m_{n} GROUP BY v),
g_{n} AS (SELECT CASE WHEN k >= 0.01 * (SELECT count(*) FROM lab) THEN v ELSE 'Other' END AS level, sum(k) AS k FROM f_{n} GROUP BY 1),
s_{n} AS (SELECT level, k / (SELECT count(*) FROM lab) AS mean_value, row_number() OVER (ORDER BY level) - 1 AS pos FROM g_{n})""")
    before = str(len(NUM))
    for n in CAT:
        parts.append(f"SELECT ({before} + pos)::INTEGER, '{n}=' || level, '{n}', level, round(mean_value, 6) FROM s_{n}")
        before += f" + (SELECT count(*) FROM s_{n})"
    return (sq.with_(sq.F_OUTCOMES) + f", lab AS (SELECT * FROM F_outcomes WHERE {Y} IS NOT NULL),\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(parts))


register("make_preprocessor", "E7", _preprocessor_sql())(preprocessor_q)


# ------------------------------------------------------------------ fits with a closed form (F1, I1, I3, I4)

def _by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("_id", "label", F.coalesce(c("urban"), F.lit("none")).alias("urban"))


def group_log_odds_q(spark: SparkSession, sf_dir: str):
    """F1 on one text column with a negligible penalty: each level's balanced probability is its share of
    weighted positives.  N1's input comes with it: probability and coefficients are of one fitted model."""
    df = _by_level(spark, sf_dir)
    pm = search.fit_pipeline(df, "elasticnet", {"C": 1e8, "l1_ratio": 0.0, "tol": 1e-9}, ["urban"], [], SEED, min_freq=0.0)
    scored = models.predict_proba(pm, df)
    return scored.groupBy("urban").agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.round(F.avg("prob"), 3).alias("prob"))


register("group_log_odds", "F1,F5", sq.with_(sq.F_OUTCOMES) + f""", lab AS (SELECT COALESCE(urban, 'none') AS urban, {Y} AS y FROM F_outcomes WHERE {Y} IS NOT NULL),
t AS (SELECT sum(y) AS p, sum(1 - y) AS q FROM lab)
SELECT urban, count(*) AS n, sum(y) AS pos, round((sum(y) / p) / (sum(y) / p + sum(1 - y) / q), 3) AS prob
FROM lab, t GROUP BY urban, p, q""")(group_log_odds_q)


def fitted_coefficients_q(spark: SparkSession, sf_dir: str):
    """Coefficient table of a fitted model: differences of two levels' coefficients are log odds ratios."""
    df = _by_level(spark, sf_dir)
    pm = search.fit_pipeline(df, "elasticnet", {"C": 1e8, "l1_ratio": 0.0, "tol": 1e-9}, ["urban"], [], SEED, min_freq=0.0)
    table = explain.coefficient_table(explain.fitted_coefficients(pm, ["urban"], []), {"urban": "Area"})
    base = table.agg(F.min_by("coef", "feature").alias("base"))
    return table.join(base, F.lit(True)).select("feature", "source_label", "feature_label", (F.round(c("coef") - c("base"), 2) + 0.0).alias("log_odds_ratio"))


register("fitted_coefficients", "N1", sq.with_(sq.F_OUTCOMES) + f""", lab AS (SELECT COALESCE(urban, 'none') AS urban, {Y} AS y FROM F_outcomes WHERE {Y} IS NOT NULL),
g AS (SELECT urban, ln(sum(y) / sum(1 - y)) AS lo FROM lab GROUP BY urban)
SELECT 'urban=' || urban AS feature, 'Area' AS source_label, 'Area=' || urban AS feature_label,
  round(lo - (SELECT lo FROM g ORDER BY urban LIMIT 1), 2) + 0.0 AS log_odds_ratio FROM g""")(fitted_coefficients_q)


def _two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.f_preds(spark, sf_dir, ["hypertension"])
    return p.select("row_index", "y_true", F.when(c("prob") < 0.5, 0.3).otherwise(0.6).alias("prob"))


def platt_two_scores_q(spark: SparkSession, sf_dir: str):
    """I1 on predictions of two scores: the fitted line goes through both groups' log odds."""
    df = _two_scores(spark, sf_dir)
    return calibrate.fit_platt(df, "y_true", "prob").transform(df).groupBy("prob").agg(F.round(F.avg("prob_calibrated"), 4).alias("prob_calibrated"))


register("platt_two_scores", "I1,I2", sq.with_(sq.F_PREDS) + """
SELECT CASE WHEN prob < 0.5 THEN 0.3 ELSE 0.6 END::DOUBLE AS prob, round(avg(y_true), 4) AS prob_calibrated
FROM F_preds WHERE outcome = 'hypertension' GROUP BY 1""")(platt_two_scores_q)


def isotonic_levels_q(spark: SparkSession, sf_dir: str):
    """I3/I4 on four scores whose outcome rates rise already: the fit gives the group means."""
    p = fx.f_preds(spark, sf_dir, ["hypertension"]).select("y_true", ((F.floor(c("prob") * 4) + 1) / 5).alias("prob"))
    out = calibrate.fit_isotonic(p).transform(p, "prob", "prob_isotonic")
    return round_doubles(out.groupBy("prob").agg(F.count("*").alias("n"), F.max("prob_isotonic").alias("prob_isotonic"), F.min("prob_isotonic").alias("least")))


register("isotonic_levels", "I3,I4", sq.with_(sq.F_PREDS) + """
SELECT round((floor(prob * 4) + 1) / 5, 6) AS prob, count(*) AS n, round(avg(y_true), 6) AS prob_isotonic, round(avg(y_true), 6) AS least
FROM F_preds WHERE outcome = 'hypertension' GROUP BY 1""")(isotonic_levels_q)


def isotonic_knots_q(spark: SparkSession, sf_dir: str):
    """I3 as a table, on scores whose outcome rates fall twice: the blocks that pooling leaves.

    Scores are the thirds of the twelve parts of the probability, swapped inside each third, so that the rates of
    every three scores fall and are pooled to one block.
    """
    p = fx.f_preds(spark, sf_dir, ["hypertension"])
    part = F.floor(c("prob") * 12)
    score = (F.floor(part / 3) * 3 + (2 - part % 3)) / 12
    knots = calibrate.isotonic_knots(p.select("y_true", score.alias("prob")))
    return round_doubles(knots.select("lo", "hi", "value", c("weight").cast("bigint").alias("n")))


register("isotonic_knots", "I3", sq.with_(sq.F_PREDS) + """, pts AS (SELECT floor(prob * 12) AS part, y_true FROM F_preds WHERE outcome = 'hypertension')
SELECT round(floor(part / 3) * 3 / 12, 6) AS lo, round((floor(part / 3) * 3 + 2) / 12, 6) AS hi, round(avg(y_true), 6) AS value, count(*) AS n
FROM pts GROUP BY floor(part / 3)""")(isotonic_knots_q)


def additive_base_rate_q(spark: SparkSession, sf_dir: str):
    """F3 is unweighted: over the rows it was fitted on, its mean probability is the outcome's rate."""
    df = _labelled(spark, sf_dir)
    pm = search.fit_pipeline(df, "glassbox_additive", {"max_bins": 16, "C": 1.0, "interactions": 2}, CAT, NUM, SEED)
    return models.predict_proba(pm, df).agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.round(F.avg("prob"), 3).alias("mean_prob"))


register("additive_base_rate", "F3,F5", sq.with_(sq.F_OUTCOMES) + f"""
SELECT count(*) AS n, sum({Y}) AS pos, round(avg({Y}), 3) AS mean_prob FROM F_outcomes WHERE {Y} IS NOT NULL""")(additive_base_rate_q)

EN_SPACE = {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]}  # fixed values: the task's candidates


def grid_search_q(spark: SparkSession, sf_dir: str):
    best, scores = search.search(_labelled(spark, sf_dir), "elasticnet", EN_SPACE, CAT, NUM, inner=3, n_iter=50, seed=SEED)
    return spark.createDataFrame([(str(p), float(s), str(p) == str(best)) for p, s in scores],
                                 "params string, mean_auc double, best boolean")


register("grid_search", "G2")(grid_search_q)


GBT_SPACE = {"n_estimators": [200, 400, 800], "max_depth": [3, 4, 5, 6], "learning_rate": [0.02, 0.05, 0.1],
             "subsample": [0.7, 0.85, 1.0], "colsample_bytree": [0.7, 0.85, 1.0]}  # fixed values: the task's candidates


def random_search_q(spark: SparkSession, sf_dir: str):
    """G3 over the boosted trees' candidates: 50 of 324 drawn without replacement."""
    best, scores = search.search(_labelled(spark, sf_dir), "boosted_trees", GBT_SPACE, CAT, NUM, inner=3, n_iter=50, seed=SEED)
    return spark.createDataFrame([(str(p), float(s), str(p) == str(best)) for p, s in scores],
                                 "params string, mean_auc double, best boolean")


register("random_search", "G3")(random_search_q)


def random_search_elasticnet_q(spark: SparkSession, sf_dir: str):
    """G3 over the elastic net's candidates: 20 of 30 drawn without replacement, all fits together."""
    best, scores = search.search(_labelled(spark, sf_dir), "elasticnet", EN_SPACE, CAT, NUM, inner=3, n_iter=20, seed=SEED)
    return spark.createDataFrame([(str(p), float(s), str(p) == str(best)) for p, s in scores],
                                 "params string, mean_auc double, best boolean")


register("random_search_elasticnet", "G3")(random_search_elasticnet_q)


def oof_q(spark: SparkSession, sf_dir: str):
    return round_doubles(search.oof_predict(_labelled(spark, sf_dir), "elasticnet", {"C": 1.0, "l1_ratio": 0.5}, CAT, NUM, inner=3,
                                            seed=SEED))


register("oof_predict", "G4")(oof_q)


def nested_cv_q(spark: SparkSession, sf_dir: str):
    """Fold metrics with the parameters that each fold's search chose, 5 outer and 3 inner folds over all candidates."""
    res = search.nested_cv(_cohort(spark, sf_dir), Y, CAT, NUM, "elasticnet", EN_SPACE, outer=5, inner=3, n_iter=50, seed=SEED)
    chosen = spark.createDataFrame([(k + 1, str(p)) for k, p in enumerate(res.best_params)], "fold int, best_params string")
    return round_doubles(res.fold_metrics.join(chosen, "fold"))


register("nested_cv", "G5,I1")(nested_cv_q)


def run_experiment_q(spark: SparkSession, sf_dir: str):
    """Both outcomes and two families, 5 outer and 3 inner folds; all candidates of the elastic net, two of the additive model."""
    df = _cohort(spark, sf_dir)
    m, _ = search.run_experiment(df, ["risk_cluster", "central_obesity"], {"LABS": ["tc", "ldl", "smoke"]},
                                 {"elasticnet": EN_SPACE, "glassbox_additive": {"max_bins": [8, 16]}},
                                 outer=5, inner=3, seed=SEED)
    return round_doubles(m)


register("run_experiment", "G6")(run_experiment_q)


def fit_and_score_q(spark: SparkSession, sf_dir: str):
    """G7 fit_picks then L1 score_models on the whole cohort (artifacts in the shared scratch folder)."""
    df = _cohort(spark, sf_dir)
    root = scratch_path(spark, "models")
    scoring.fit_picks(df, [{"outcome": "risk_cluster", "featureset": "LABS", "model": "elasticnet"},
                           {"outcome": "central_obesity", "featureset": "LABS", "model": "glassbox_additive", "recalibration": "isotonic"},
                           {"outcome": "central_obesity", "featureset": "LABS", "model": "gam_spline", "recalibration": "none"}],
                      {"LABS": ["tc", "ldl", "spend", "smoke", "urban"]}, {"elasticnet": EN_SPACE}, root, inner=3, seed=SEED)
    return round_doubles(scoring.score_models(fx.f_cohort(spark, sf_dir), root))


register("fit_picks_score_models", "G7,L1")(fit_and_score_q)


def platt_q(spark: SparkSession, sf_dir: str):
    p = fx.f_preds(spark, sf_dir, ["hypertension"])
    cal = calibrate.fit_platt(p, "y_true", "prob")
    return round_doubles(cal.to_df(spark))


register("fit_platt", "I1")(platt_q)


def isotonic_q(spark: SparkSession, sf_dir: str):
    p = fx.f_preds(spark, sf_dir, ["hypertension"])
    iso = calibrate.fit_isotonic(p.filter(c("fold") != 1), "y_true", "prob")
    out = iso.transform(p.filter(c("fold") == 1), "prob", "prob_isotonic")
    return round_doubles(out.select("row_index", "y_true", "prob", "prob_isotonic"))


register("isotonic_calibration", "I3,I4")(isotonic_q)


def stability_selection_q(spark: SparkSession, sf_dir: str):
    df = _cohort(spark, sf_dir)
    draws = stability.stability_draws(df, Y, NUM + CAT, CAT, NUM, n_draws=200, frac=0.7, seed=SEED)
    return stability.stability_summary(draws)


register("stability_selection", "J2,J4")(stability_selection_q)


def tree_contributions_q(spark: SparkSession, sf_dir: str):
    df = _labelled(spark, sf_dir)
    pm = search.fit_pipeline(df, "boosted_trees", {"n_estimators": 300, "max_depth": 4}, CAT, NUM, SEED)
    pre, gbt = pm.stages[0], pm.stages[1]
    slots = prep.slot_table(pre, CAT, NUM)
    vec = pre.transform(df)
    return round_doubles(explain.mean_abs_tree_contribution(gbt, vec, [(s[1], s[2]) for s in slots], scratch_path(spark, "gbt")))


register("tree_contributions", "N4")(tree_contributions_q)


def additive_global_q(spark: SparkSession, sf_dir: str):
    """Shape table (one row per bin) with each feature's importance."""
    df = _labelled(spark, sf_dir)
    bins, imp = explain.explain_additive(df, CAT, NUM, max_bins=16)
    return round_doubles(bins.join(imp.drop("feature_type"), "feature"))


register("additive_global", "N5")(additive_global_q)
