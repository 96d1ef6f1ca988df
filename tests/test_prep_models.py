"""Preprocessing invariants, folds balance and model-fit invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import explain, metrics, models, prep, search, stability


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(1)
    n = 600
    x1 = rng.normal(0, 1, n)
    x2 = rng.normal(5, 2, n)
    cat = rng.choice(["a", "b", "c", "rare"], n, p=[0.5, 0.3, 0.195, 0.005])
    y = (rng.random(n) < 1 / (1 + np.exp(-(x1 + (cat == "a") - 0.5)))).astype(float)
    rows = [(i, float(y[i]), float(x1[i]) if i % 17 else None, float(x2[i]), str(cat[i]) if i % 23 else None)
            for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y double, x1 double, x2 double, cat string")


def test_median_mode_rare(spark, cohort):
    m = prep.MedianImputer(inputCols=["x1"]).fit(cohort)
    med = cohort.select(F.percentile("x1", 0.5)).first()[0]
    assert m.transform(cohort).filter(F.col("x1").isNull()).count() == 0
    assert m.transform(cohort).filter("row_id % 17 = 0").select("x1").distinct().first()[0] == pytest.approx(med)
    mi = prep.ModeImputer(inputCols=["cat"]).fit(cohort).transform(cohort)
    assert mi.filter("row_id % 23 = 0").select("cat").distinct().first()[0] == "a"
    rg = prep.RareCategoryGrouper(inputCols=["cat"], minFreq=0.01).fit(mi).transform(mi)
    assert sorted(r[0] for r in rg.select("cat").distinct().collect()) == ["Other", "a", "b", "c"]


def test_population_scaler_and_spline(spark, cohort):
    df = prep.MedianImputer(inputCols=["x1", "x2"]).fit(cohort).transform(cohort)
    sc = prep.PopulationScaler(inputCols=["x2"]).fit(df).transform(df)
    r = sc.agg(F.avg("x2").alias("m"), F.stddev_pop("x2").alias("s")).first()
    assert r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1, abs=1e-9)
    const = spark.createDataFrame([(1.0,), (1.0,)], "z double")
    assert [x[0] for x in prep.PopulationScaler(inputCols=["z"]).fit(const).transform(const).collect()] == [0.0, 0.0]
    sp = prep.SplineBasis(inputCols=["x2"], nKnots=5).fit(df)
    out = sp.transform(df).select(*sp.outputCols()).toPandas().to_numpy()
    assert out.shape[1] == 6
    # the full basis is a partition of unity; dropping the last spline leaves sums in [0, 1]
    assert (out.sum(1) <= 1 + 1e-9).all() and (out >= -1e-12).all()


def test_preprocessor_slots(spark, cohort):
    pm = prep.make_preprocessor(["cat"], ["x1", "x2"]).fit(cohort)
    slots = prep.slot_table(pm, ["cat"], ["x1", "x2"])
    vec = pm.transform(cohort).select("features").first()[0]
    assert len(vec) == len(slots)
    assert [s[1] for s in slots] == ["x1", "x2", "cat=Other", "cat=a", "cat=b", "cat=c"]


def test_stratified_folds_balanced(spark, cohort):
    f = search.stratified_folds(cohort, "y", k=5, seed=42, prefix_hex=1)
    counts = f.groupBy("y", "fold").count().collect()
    for cls in (0.0, 1.0):
        c = [r["count"] for r in counts if r["y"] == cls]
        assert len(c) == 5 and max(c) - min(c) <= 1
    again = search.stratified_folds(cohort, "y", k=5, seed=42, prefix_hex=2)
    assert f.join(again.withColumnRenamed("fold", "f2"), "row_id").filter("fold != f2").count() == 0


def test_candidates():
    space = {"a": [1, 2, 3], "b": [0.1, 0.2]}
    assert len(search.candidates_for(space, 50)) == 6
    sample = search.candidates_for(space, 4, seed=1)
    assert len(sample) == 4 and len({str(s) for s in sample}) == 4


def test_tree_contributions_sum_to_margin(spark, cohort):
    from pyspark.ml.functions import vector_to_array

    from cohortflow.session import scratch_path

    base = cohort.select(F.col("row_id").alias("_id"), F.col("y").alias("label"), "x1", "x2", "cat")
    pm = search.fit_pipeline(base, "boosted_trees", {"n_estimators": 5, "max_depth": 3}, ["cat"], ["x1", "x2"])
    pre, gbt = pm.stages
    slots = prep.slot_table(pre, ["cat"], ["x1", "x2"])
    vec = pre.transform(base)
    contrib = explain.tree_contributions(gbt, vec, [s[1] for s in slots], scratch_path(spark, "t"), id_col="_id")
    total = contrib.groupBy("_id").agg(F.sum("contribution").alias("s"))
    margin = gbt.transform(vec).select(F.col("_id"), vector_to_array("rawPrediction")[1].alias("m"))
    diff = total.join(margin, "_id").select(F.max(F.abs(F.col("s") - F.col("m")))).first()[0]
    assert diff < 1e-9


def test_bootstrap_weights_mean(spark, cohort):
    w = stability.bootstrap_weights(cohort, n_draws=10, frac=0.7)
    mean = w.agg(F.sum("w")).first()[0] / (10 * 600)
    assert mean == pytest.approx(0.7, abs=0.05)


def test_stability_summary_semantics(spark):
    draws = spark.createDataFrame([(0, "a", 1.0, 1.0), (1, "a", 1.0, 1.0), (2, "a", 0.0, 0.0), (3, "a", 1.0, -1.0)],
                                  "draw int, feature string, selected double, sign double")
    r = stability.stability_summary(draws).first()
    assert r["inclusion_freq"] == 0.75 and r["sign_consistency"] == 0.5


def test_drop_first(spark, cohort):
    for fitted in (prep.make_preprocessor(["cat"], ["x2"], drop_first=True).fit(cohort), prep.fit_preprocessor(cohort, ["cat"], ["x2"], drop_first=True)):
        slots = prep.slot_table(fitted, ["cat"], ["x2"], drop_first=True)
        assert [s[1] for s in slots] == ["x2", "cat=a", "cat=b", "cat=c"]
        assert len(fitted.transform(cohort).select("features").first()[0]) == 4


def test_fused_fit_with_repeat_weights(spark, cohort):
    """A row of weight 3 counts as three rows in medians, moments and levels."""
    w = cohort.withColumn("w", (F.col("row_id") % 4).cast("int"))
    copies = w.filter("w > 0").withColumn("k", F.explode(F.expr("sequence(1, w)")))
    a = prep.fit_preprocessor(w.filter("w > 0"), ["cat"], ["x1", "x2"], weight_col="w")
    b = prep.fit_preprocessor(copies, ["cat"], ["x1", "x2"])
    x, y = (p.transform(cohort).select("features").toPandas()["features"].map(lambda v: v.toArray()) for p in (a, b))
    assert np.allclose(np.vstack(x), np.vstack(y), atol=1e-9)


def _base(cohort):
    return cohort.select(F.col("row_id").alias("_id"), F.col("y").alias("label"), "x1", "x2", "cat")


def test_unweighted_families_keep_the_base_rate(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.random() < 0.08), float(rng.normal()), str(rng.choice(["a", "b"]))) for i in range(1500)]
    df = spark.createDataFrame(rows, "_id long, label double, x double, cat string")
    rate = df.agg(F.avg("label")).first()[0]
    for kind, params in (("glassbox_additive", {"max_bins": 8}), ("boosted_trees", {"n_estimators": 10})):
        pm = search.fit_pipeline(df, kind, params, ["cat"], ["x"])
        mean = pm.transform(df).select(models.prob_of_one(F.col("probability")).alias("p")).agg(F.avg("p")).first()[0]
        assert mean == pytest.approx(rate, abs=0.03)
    pm = search.fit_pipeline(df, "elasticnet", {"C": 1.0}, ["cat"], ["x"])
    mean = pm.transform(df).select(models.prob_of_one(F.col("probability")).alias("p")).agg(F.avg("p")).first()[0]
    assert mean == pytest.approx(0.5, abs=0.05)  # balanced classes


def test_interactions_change_the_fit(spark):
    """The label is the sign of a product: only a pair term can tell it."""
    rng = np.random.default_rng(4)
    a, b, noise = rng.normal(size=1200), rng.normal(size=1200), rng.normal(size=1200)
    df = spark.createDataFrame([(i, float(a[i] * b[i] > 0), float(a[i]), float(b[i]), float(noise[i])) for i in range(1200)],
                               "_id long, label double, a double, b double, noise double")
    auc = {}
    for k in (0, 1):
        pm = search.fit_pipeline(df, "glassbox_additive", {"max_bins": 8, "interactions": k}, [], ["a", "b", "noise"])
        p = pm.transform(df).select(F.lit(0).alias("g"), F.col("label").alias("y_true"), models.prob_of_one(F.col("probability")).alias("prob"))
        auc[k] = metrics.rank_metrics(p, ["g"]).first()["roc_auc"]
    assert auc[0] < 0.7 and auc[1] > 0.9


def test_additive_levels_are_bounded(spark):
    df = spark.createDataFrame([(i, float(i % 2), f"id{i}") for i in range(600)], "_id long, label double, who string")
    pre = models.fit_additive(df, ["who"], [], min_freq=0.01)
    assert len(pre.transform(df).select("features").first()[0]) <= 3


def test_explanation_keeps_missing_as_a_level(spark, cohort):
    bins, imp = explain.explain_additive(_base(cohort), ["cat"], ["x1", "x2"], max_bins=8)
    assert {r["feature"] for r in imp.collect()} == {"cat", "x1", "x2"}
    n = {r["feature"]: r["n"] for r in bins.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    assert set(n.values()) == {600}


def test_logistic_fit_is_optimal(spark, cohort):
    """at the fitted coefficients the penalized loss has a zero subgradient."""
    base = search.with_balanced_weight(_base(cohort))
    pre = prep.fit_preprocessor(base, ["cat"], ["x1", "x2"])
    vec = pre.transform(base)
    m = models.elasticnet(C=0.5, l1_ratio=0.5, weight_sum=600.0, tol=1e-9).fit(vec)
    pdf = vec.select("features", "label", "weight").toPandas()
    X, y, w = np.vstack([v.toArray() for v in pdf.features]), pdf.label.to_numpy(), pdf.weight.to_numpy()
    beta = m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(X @ beta + m.intercept)))
    grad = X.T @ (w * (p - y)) / w.sum()
    reg = 1.0 / (0.5 * 600.0)
    for g, b in zip(grad, beta, strict=True):
        if abs(b) > 1e-8:
            assert g + reg * (0.5 * np.sign(b) + 0.5 * b) == pytest.approx(0, abs=2e-4)
        else:
            assert abs(g) <= reg * 0.5 + 2e-4
    assert abs(np.sum(w * (p - y)) / w.sum()) < 2e-4


def test_recalibration_persists_and_reloads(spark, cohort):
    from cohortflow.operators import scoring
    from cohortflow.session import scratch_path

    df = cohort.withColumnRenamed("y", "y_out")
    root = scratch_path(spark, "models")
    picks = [{"outcome": "out", "featureset": "F", "model": "elasticnet", "recalibration": r} for r in ("none", "intercept_slope", "isotonic")]
    for k, p in enumerate(picks):
        scoring.fit_picks(df, [p], {"F": ["x1", "x2", "cat"]}, {}, root, tag=f"t{k}", inner=2)
    assert [m[0] for m in scoring.list_models(spark, root)] == ["t0", "t1", "t2"]
    out = scoring.score_models(df, root).toPandas()
    assert out[out.tag == "t0"].prob_calibrated.isna().all()
    assert not out[out.tag != "t0"].prob_calibrated.isna().any()
    iso = out[out.tag == "t2"].sort_values("prob").prob_calibrated.to_numpy()
    assert (np.diff(iso) >= -1e-12).all()
    again = search.fit_pipeline(df.select(F.col("row_id").alias("_id"), F.col("y_out").alias("label"), "x1", "x2", "cat"), "elasticnet", {}, ["cat"], ["x1", "x2"])
    mem = again.transform(df.withColumnRenamed("row_id", "_id")).select("_id", models.prob_of_one(F.col("probability")).alias("p")).toPandas().set_index("_id").p
    saved = out[out.tag == "t1"].set_index("row_index").prob
    assert np.allclose(saved.sort_index(), mem.sort_index(), atol=1e-6)
    with pytest.raises(ValueError):
        scoring.fit_picks(df, [{**picks[0], "recalibration": "magic"}], {"F": ["x1"]}, {}, root)


def test_poisson_thresholds_cover_large_fractions():
    t = stability.poisson_thresholds(30.0)
    assert len(t) > 60 and 1 - t[-1] < 2 ** -31


def test_all_saved_models_in_one_scan(spark, cohort):
    """Four models of three families: one scan in the plan, scores equal to each model's own transform."""
    from pyspark.ml import PipelineModel

    from cohortflow.operators import scoring
    from cohortflow.operators.calibrate import load_calibrator
    from cohortflow.session import scratch_path

    path = scratch_path(spark, "cohort")
    cohort.withColumnRenamed("y", "y_out").write.parquet(path)
    df = spark.read.parquet(path)
    root = scratch_path(spark, "models")
    sets = {"A": ["x1", "x2", "cat"], "B": ["x2", "cat"]}
    picks = [{"outcome": "out", "featureset": f, "model": m, "recalibration": r} for f, m, r in (
        ("A", "elasticnet", "intercept_slope"), ("B", "elasticnet", "none"), ("A", "gam_spline", "none"), ("B", "glassbox_additive", "isotonic"))]
    scoring.fit_picks(df, picks, sets, {"glassbox_additive": {"max_bins": [8]}}, root, inner=2)
    out = scoring.score_models(df, root)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    out = out.persist()
    assert out.count() == 4 * 600 and out.groupBy("row_index").count().filter("count <> 4").count() == 0
    for tag, outcome, fs, kind in scoring.list_models(spark, root):
        base = f"{root}/{tag}/{outcome}/{fs}/{kind}"
        single = PipelineModel.load(f"{base}/pipeline").transform(df.withColumnRenamed("row_id", "_id")).select("_id", models.prob_of_one(F.col("probability")).alias("p"))
        single = load_calibrator(spark, f"{base}/calibrator").transform(single, "p", "q")
        both = out.filter((F.col("featureset") == fs) & (F.col("model") == kind)).join(single, F.col("row_index") == F.col("_id"))
        far = both.agg(F.max(F.abs(F.col("p") - F.col("prob"))).alias("p"), F.max(F.abs(F.col("q") - F.col("prob_calibrated"))).alias("q")).first()
        assert far["p"] < 1e-12 and (far["q"] is None if (fs, kind) in (("A", "gam_spline"), ("B", "elasticnet")) else far["q"] < 1e-12)
    out.unpersist()
    with pytest.raises(ValueError):
        scoring.score_models(df, scratch_path(spark, "nothing"))


def test_tree_attribution_is_the_walk_of_each_row():
    """Thresholds, categories that the split lists or does not know, and paths of unequal length, row by row."""
    import numpy as np

    rng = np.random.default_rng(4)
    X = np.column_stack([rng.normal(size=200), rng.integers(-1, 4, 200).astype(float)])
    left, right, feat = (np.array(v) for v in ([1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0, -1, 1, -1, -1]))
    pred, thr, is_cat = np.array([0.1, -0.5, 0.4, 0.9, 0.2]), np.array([0.3, np.nan, np.nan, np.nan, np.nan]), np.array([False, False, True, False, False])
    goes_left = np.zeros((5, 3), dtype=bool)
    goes_left[2, [0, 2]] = True
    stump = (0.5, np.array([-1]), np.array([-1]), np.array([-1]), np.array([2.0]), np.array([np.nan]), np.array([False]), np.zeros((1, 1), dtype=bool))
    contrib, bias = explain._attribute(X, [(2.0, left, right, feat, pred, thr, is_cat, goes_left), stump])
    for x, own, b in zip(X, contrib, bias, strict=True):
        want = np.zeros(2)
        want[0] = 2.0 * ((pred[1] if x[0] <= 0.3 else pred[2]) - pred[0])
        if x[0] > 0.3:
            want[1] = 2.0 * ((pred[3] if x[1] in (0, 2) else pred[4]) - pred[2])
        assert own == pytest.approx(want) and b == pytest.approx(2.0 * 0.1 + 0.5 * 2.0)


def test_tree_contributions_query_fits_all_trees(spark, sf_dir, monkeypatch):
    """300 trees of depth 4, the model family's own, on all labelled rows."""
    from cohortflow.plans import queries_fit

    seen = {}

    def fake(df, kind, params, *args):
        seen.update(params, rows=df.count(), kind=kind)
        raise InterruptedError

    monkeypatch.setattr(queries_fit.search, "fit_pipeline", fake)
    with pytest.raises(InterruptedError):
        queries_fit.tree_contributions_q(spark, sf_dir)
    whole = {"n_estimators": 300, "max_depth": 4, "rows": queries_fit._labelled(spark, sf_dir).count(), "kind": "boosted_trees"}
    assert seen == whole
