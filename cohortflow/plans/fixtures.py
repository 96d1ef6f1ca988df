"""Deterministic stand-in views over the driver tables.

All values come from integer arithmetic on the order key ``k`` (unique), so
Spark and DuckDB compute identical numbers.  Each builder has a SQL twin in
``plans.sql_fixtures`` used by the oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The three outcomes of the joint-risk ladder with the (a, b) multipliers of F_preds.
PRED_OUTCOMES = [("hypertension", 7919, 104729), ("hyperglycemia", 7907, 104723), ("dyslipidemia", 7901, 104717)]
# A second, weaker model per outcome for model-choice operators (multiplier of its score).
ALT_MODEL_MULT = {"hypertension": 3571, "hyperglycemia": 3559, "dyslipidemia": 3547}

# Outcome spec of the flagship, with the thresholds of the reference's outcome spec and the
# stand-in column names / sex labels of F_orders.
SBP_DBP = {"kind": "sbp_dbp", "sbp_column": "sbp", "dbp_column": "dbp", "sbp_threshold": 140, "dbp_threshold": 90}
GLUCOSE = {"kind": "threshold", "column": "glucose", "operator": ">=", "threshold": 5.6}
LIPID = {"kind": "lipid", "tg_column": "tg", "tc_column": "tc", "ldl_column": "ldl", "hdl_column": "hdl",
         "tg_threshold": 1.7, "tc_threshold": 6.2, "ldl_threshold": 4.1, "hdl_male_threshold": 1.04,
         "hdl_female_threshold": 1.3, "sex_column": "sex", "sex_male_value": "M", "sex_female_value": "F"}
WAIST = {"kind": "waist_by_sex", "waist_column": "waist", "sex_column": "sex", "sex_male_value": "M",
         "sex_female_value": "F", "male_threshold": 90, "female_threshold": 85}
OUTCOMES_SPEC = {
    "risk_cluster": {"rule": {"kind": "count_positive", "min_count": 2, "rules": [SBP_DBP, GLUCOSE, LIPID, WAIST]}},
    "central_obesity": {"rule": WAIST},
}
BUTTER_BINNING = {"butter": {"type": "numeric", "bins": [0.0, 1.0, 999999], "labels": ["0-1", ">1"]}}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(col: Column, m: int) -> Column:
    return col % F.lit(m)


def f_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort stand-in, before sentinel cleaning (one row per order)."""
    o = read(spark, sf_dir, "orders")
    cust = read(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_mktsegment"))
    k = F.col("o_orderkey")
    null_d = F.lit(None).cast("double")
    sex = (F.when(_mod(k, 20) == 0, F.lit(None).cast("string")).when(_mod(k, 20) == 1, F.lit("X"))
           .when(_mod(k, 7) < 3, F.lit("M")).otherwise(F.lit("F")))
    smoke = (F.when(_mod(k, 211) == 0, F.lit("rare")).when(_mod(k, 11) == 0, F.lit("NA"))
             .when(_mod(k * 71, 5) < 2, F.lit("smoker")).otherwise(F.lit("never")))
    # customer is joined on its key; AQE broadcasts it only when its runtime size is small
    return o.join(cust, o["o_custkey"] == cust["c_custkey"], "left").select(
        k.alias("row_id"),
        F.when(_mod(k, 17) == 0, F.lit(999.0)).otherwise((100 + _mod(k * 37, 83)).cast("double")).alias("sbp"),
        F.when(_mod(k, 19) == 0, F.lit(-1.0)).otherwise((60 + _mod(k * 53, 47)).cast("double")).alias("dbp"),
        F.when(_mod(k, 23) == 0, null_d).otherwise((40 + _mod(k * 29, 41)) / 10).alias("glucose"),
        F.when(_mod(k, 29) == 0, null_d).when(_mod(k, 101) == 0, F.lit(0.0))
        .otherwise((5 + _mod(k * 31, 37)) / 10).alias("tg"),
        ((30 + _mod(k * 41, 43)) / 10).alias("tc"),
        ((10 + _mod(k * 43, 39)) / 10).alias("ldl"),
        F.when(_mod(k, 107) == 0, F.lit(0.0)).otherwise((6 + _mod(k * 47, 15)) / 10).alias("hdl"),
        sex.alias("sex"),
        F.when(_mod(k, 13) == 0, null_d).otherwise((65 + _mod(k * 59, 46)).cast("double")).alias("waist"),
        F.col("o_orderstatus").alias("urban"),
        F.col("o_orderpriority").alias("ethnicity"),
        smoke.alias("smoke"),
        (_mod(k * 73, 4) / 2).alias("butter"),
        F.col("o_totalprice").alias("spend"),
        F.col("c_mktsegment").alias("segment"),
    )


def f_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_orders after sentinel cleaning of every column but the id."""
    from ..sources.readers import null_sentinels

    raw = f_orders(spark, sf_dir)
    return null_sentinels(raw, columns=[n for n in raw.columns if n != "row_id"])


def _pred_rows(k: Column, a: int, b: int) -> tuple[Column, Column]:
    prob = _mod(k * a, 10007) / 10007
    y = ((_mod(k * b, 1009) / 1009) < prob).cast("double")
    return prob, y


def f_preds(spark: SparkSession, sf_dir: str, outcomes: Sequence[str] | None = None,
            with_alt_model: bool = False) -> DataFrame:
    """Long OOF predictions: fold, row_index, y_true, prob, prob_calibrated, outcome, featureset, model.

    The three outcomes are one projection each over ``orders`` unioned, so the
    table grows with ``orders``.
    """
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    parts = []
    for name, a, b in PRED_OUTCOMES:
        if outcomes is not None and name not in outcomes:
            continue
        prob, y = _pred_rows(k, a, b)
        models = [("elasticnet", prob)]
        if with_alt_model:
            models.append(("xgboost", _mod(k * ALT_MODEL_MULT[name], 10007) / 10007))
        for model, p in models:
            parts.append(o.select(
                (_mod(k, 5) + 1).cast("int").alias("fold"), k.alias("row_index"), y.alias("y_true"),
                p.alias("prob"), (p * p).alias("prob_calibrated"), F.lit(name).alias("outcome"),
                F.lit("Q_PLUS_ANTHRO").alias("featureset"), F.lit(model).alias("model")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def f_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels.quality as the primary and labels.toxic as the secondary definition of one outcome."""
    lab = read(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id"), F.col("quality").cast("double").alias("label__primary"),
                      F.col("toxic").cast("double").alias("label__secondary"))


def f_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def f_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
