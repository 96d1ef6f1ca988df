"""Metric properties against brute force on small random tables."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from cohortflow.operators import calibrate, metrics
from cohortflow.operators.quantiles import bucket_edges, bucket_of, exact_quantiles


def _auc_brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    diff = pos[:, None] - neg[None, :]
    return float(((diff > 0) + 0.5 * (diff == 0)).mean())


def _ap_brute(y, p):
    order = np.argsort(-p, kind="stable")
    ys, ps = y[order], p[order]
    thresholds = np.unique(ps)[::-1]
    P = ys.sum()
    ap, prev_r = 0.0, 0.0
    for t in thresholds:
        sel = ps >= t
        tp = ys[sel].sum()
        r, prec = tp / P, tp / sel.sum()
        ap += (r - prev_r) * prec
        prev_r = r
    return ap


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(3):
        n = 200
        p = np.round(rng.random(n), 2)  # many ties
        y = (rng.random(n) < p).astype(float)
        rows += [(g, float(a), float(b)) for a, b in zip(y, p)]
    return rows, spark.createDataFrame(rows, "g int, y_true double, prob double")


def test_auc_ap_match_brute_force(spark, table):
    rows, df = table
    got = {r["g"]: r for r in metrics.rank_metrics(df, ["g"]).collect()}
    for g in range(3):
        y = np.array([r[1] for r in rows if r[0] == g])
        p = np.array([r[2] for r in rows if r[0] == g])
        assert got[g]["roc_auc"] == pytest.approx(_auc_brute(y, p), abs=1e-12)
        assert got[g]["pr_auc"] == pytest.approx(_ap_brute(y, p), abs=1e-12)


def test_auc_invariant_under_monotone_transform(spark, table):
    _, df = table
    a = {r["g"]: r["roc_auc"] for r in metrics.rank_metrics(df, ["g"]).collect()}
    b = {r["g"]: r["roc_auc"] for r in metrics.rank_metrics(df.selectExpr("g", "y_true", "prob * prob * 0.5 AS prob"),
                                                            ["g"]).collect()}
    assert a == pytest.approx(b)


def test_single_class_gives_null(spark):
    df = spark.createDataFrame([(0, 1.0, 0.2), (0, 1.0, 0.4)], "g int, y_true double, prob double")
    r = metrics.rank_metrics(df, ["g"]).first()
    assert r["roc_auc"] is None


def test_point_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 0.9), (0, 0.0, 0.6), (0, 1.0, 0.4), (0, 0.0, 0.1)],
                               "g int, y_true double, prob double")
    r = metrics.point_metrics(df, ["g"]).first()
    assert r["accuracy"] == pytest.approx(0.5)
    assert r["f1"] == pytest.approx(1 / (1 + 0.5 * 2))
    assert r["brier"] == pytest.approx((0.01 + 0.36 + 0.36 + 0.01) / 4)


def test_binned_calibration_counts_and_ece(spark, table):
    _, df = table
    b = calibrate.binned_calibration(df, ["g"], bins=10)
    tot = {r["g"]: r["s"] for r in b.groupBy("g").agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect()}
    assert tot == {0: 200, 1: 200, 2: 200}
    for r in calibrate.ece(b, ["g"]).collect():
        assert 0.0 <= r["ece"] <= 1.0


def test_binned_calibration_matches_pandas_qcut(spark, table):
    pd = pytest.importorskip("pandas")
    rows, df = table
    b = calibrate.binned_calibration(df.filter("g = 0"), [], bins=10).orderBy("bin").collect()
    p = pd.Series([r[2] for r in rows if r[0] == 0])
    expected = pd.qcut(p, q=10, duplicates="drop").value_counts(sort=False).tolist()
    assert [r["n"] for r in b] == [x for x in expected if x > 0]


def test_platt_on_calibrated_scores_is_identity(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.02, 0.98, 4000)
    y = (rng.random(4000) < p).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y_true double, prob double")
    cal = calibrate.fit_platt(df)
    assert cal.intercept == pytest.approx(0.0, abs=0.15)
    assert cal.slope == pytest.approx(1.0, abs=0.15)


def test_isotonic_is_monotone(spark, table):
    _, df = table
    iso = calibrate.fit_isotonic(df)
    out = iso.transform(df).orderBy("prob").select("prob_calibrated").collect()
    vals = [r[0] for r in out]
    assert all(a <= b + 1e-12 for a, b in zip(vals, vals[1:]))


def test_rank_metrics_when_scores_crowd(spark):
    """Scores of a rare outcome lie in one part in a million near 0: buckets follow the scores."""
    rng = np.random.default_rng(5)
    s = rng.random(4000) * 1e-7
    y = (rng.random(4000) < 0.3 + 0.4 * s / 1e-7).astype(float)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(y, s, strict=True)], "g string, y_true double, prob double")
    counts = metrics.score_counts(df, ["g"])
    edges = bucket_edges(counts, ["g"], "score")
    per = counts.join(edges, "g").select(bucket_of(F.col("score"), F.col("_edges")).alias("b")).groupBy("b").count()
    assert per.agg(F.max("count")).first()[0] <= 40
    got = metrics.rank_metrics(df, ["g"]).first()["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    want = (np.searchsorted(np.sort(neg), pos)).sum() / (len(pos) * len(neg))
    assert got == pytest.approx(want, abs=1e-12)


def test_constant_scores_do_not_break_the_report(spark):
    rows = [("flat", float(i % 2), 0.3) for i in range(20)] + [("ok", float(i % 3 == 0), i / 40) for i in range(40)]
    df = spark.createDataFrame(rows, "model string, y_true double, prob double")
    out = calibrate.binned_calibration(df, ["model"]).toPandas()
    flat = out[out.model == "flat"]
    assert len(flat) == 1 and flat.n.iloc[0] == 20 and flat.bin_lo.iloc[0] == flat.bin_hi.iloc[0] == pytest.approx(0.3)
    assert out[out.model == "ok"].n.sum() == 40


def test_exact_quantiles_match_sorting(spark):
    rng = np.random.default_rng(0)
    parts = []
    for k, n in enumerate([1, 2, 3, 10, 64, 1000]):
        for kind, v in enumerate([rng.normal(size=n), rng.integers(0, 5, n).astype(float), np.exp(rng.normal(size=n) * 5)]):
            parts += [(f"{k}-{kind}", float(x)) for x in v]
    qs = [0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.99, 1]
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(spark.createDataFrame(parts, "g string, v double"), ["g"], "v", qs).collect()}
    for g, values in got.items():
        assert np.allclose(values, np.quantile([x for k, x in parts if k == g], qs), rtol=1e-12)


def test_constant_scores_have_no_slope(spark):
    """Whatever the constant: its sums' rounding errors are no slope."""
    from pyspark.sql import functions as F

    from cohortflow.operators import metrics

    df = spark.range(21000).select((F.col("id") % 300).cast("int").alias("fold"), (F.col("id") % 7 < 3).cast("double").alias("y_true"))
    out = metrics.fold_metrics(df.withColumn("prob", 0.5 + F.col("fold") / 977), ["fold"])
    assert out.filter("calibration_slope is not null or calibration_intercept is not null").count() == 0 and out.count() == 300
