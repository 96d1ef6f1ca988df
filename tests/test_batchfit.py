"""Fits solved together against single fits, plain medians and ranks, and optimality of every solution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import batchfit, calibrate, metrics, models, prep, search, stability
from cohortflow.operators.batchfit import Batch


@pytest.fixture(scope="module")
def rows(spark):
    """Missing numbers and texts, a rare level, a level named like the rest, a constant column."""
    rng = np.random.default_rng(2)
    n = 700
    x1, x2 = rng.normal(3, 2, n), np.exp(rng.normal(0, 2, n))
    cat = rng.choice(["a", "b", "c", "Other", "r1", "r2", "r3"], n, p=[0.4, 0.3, 0.2, 0.08, 0.01, 0.005, 0.005])
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.7 * (x1 - 3) + (cat == "a") - 0.4)))).astype(float)
    data = [(i, float(y[i]), float(x1[i]) if i % 13 else None, float(x2[i]) if i % 9 else float("nan"), 5.0, str(cat[i]) if i % 11 else None, "one") for i in range(n)]
    df = spark.createDataFrame(data, "_id long, label double, x1 double, x2 double, flat double, cat string, one string")
    return df.withColumn("_f", (F.col("_id") % 3 + 1).cast("int")).persist()


NUM, CAT = ["x1", "x2", "flat"], ["cat", "one"]


def fold_batch(rows, **kw):
    times = F.array(*[(F.col("_f") != f).cast("tinyint") for f in (1, 2, 3)])
    return Batch.prepare(rows, CAT, NUM, times, 3, **kw)


GRID = [(C, r) for C in (0.05, 1.0, 50.0) for r in (0.0, 0.5, 1.0)]


@pytest.fixture(scope="module")
def solved(rows):
    batch = fold_batch(rows)
    return batch, batch.fit([(t, C, r) for t in range(3) for C, r in GRID])


def single(rows, fold):
    train = search.with_balanced_weight(rows.filter(F.col("_f") != fold))
    pre = prep.fit_preprocessor(train, CAT, NUM)
    vec = pre.transform(train).select("features", "label", "weight").toPandas()
    return pre, np.vstack([v.toArray() for v in vec.features]), vec.label.to_numpy(), vec.weight.to_numpy()


def objective(X, y, w, coef, intercept, C, r):
    m = X @ coef + intercept
    return (w * (np.logaddexp(0, m) - y * m)).sum() + (r * np.abs(coef).sum() + (1 - r) / 2 * (coef ** 2).sum()) / C


def test_every_solution_is_optimal_on_the_single_fit_features(rows, solved):
    batch, fits = solved
    names = {n: k for k, n, _, _ in batch.prepared.slots}
    for t in range(3):
        pre, X, y, w = single(rows, t + 1)
        slots = [s[1] for s in prep.slot_table(pre, CAT, NUM)]
        for (C, r), fit in zip(GRID, fits[t * len(GRID):], strict=False):
            coef = np.array([fit.coef[names[n]] for n in slots])
            rest = np.delete(fit.coef, [names[n] for n in slots])
            assert not rest.any()  # slots that this set lacks
            p = 1 / (1 + np.exp(-(X @ coef + fit.intercept)))
            grad = X.T @ (w * (p - y))
            assert abs((w * (p - y)).sum()) < 1e-5
            for g, b in zip(grad, coef, strict=True):
                if abs(b) > 1e-9:
                    assert g + (r * np.sign(b) + (1 - r) * b) / C == pytest.approx(0, abs=1e-5)
                else:
                    assert abs(g) <= r / C + 1e-5


def test_coefficients_equal_single_fits(rows, solved):
    """Where a ridge part makes the solution unique, at 1e-4."""
    batch, fits = solved
    names = {n: k for k, n, _, _ in batch.prepared.slots}
    train = search.with_balanced_weight(rows.filter(F.col("_f") != 1))
    pre = prep.fit_preprocessor(train, CAT, NUM)
    vec = pre.transform(train).persist()
    n = vec.count()
    for (C, r), fit in list(zip(GRID, fits, strict=False))[:5]:
        if r == 1.0:
            continue
        m = models.elasticnet(C, r, float(n), tol=1e-12).fit(vec)
        got = np.array([fit.coef[names[s[1]]] for s in prep.slot_table(pre, CAT, NUM)])
        assert np.allclose(got, m.coefficients.toArray(), atol=1e-4) and fit.intercept == pytest.approx(m.intercept, abs=1e-4)
        mine = batch.score(rows.filter(F.col("_f") == 1), [fit], ["_id"], F.array(F.lit(0)), 1)
        theirs = m.transform(pre.transform(rows.filter(F.col("_f") == 1))).select("_id", models.prob_of_one(F.col("probability")).alias("p"))
        assert mine.join(theirs, "_id").select(F.max(F.abs(F.col("prob") - F.col("p")))).first()[0] < 1e-4
    vec.unpersist()


@pytest.mark.parametrize("split, exact", [(256, 4096), (32, 1)])
def test_medians_of_all_sets(spark, monkeypatch, split, exact):
    """Sorted, reversed, skewed, tied and signed values; cuts that miss, and ranges that take many passes."""
    monkeypatch.setattr(batchfit, "SPLIT", split)
    monkeypatch.setattr(batchfit, "EXACT", exact)
    rng = np.random.default_rng(8)
    n = 400
    columns = {"up": np.arange(n) * 1.0, "down": -np.arange(n) ** 3.0, "skew": np.exp(rng.normal(0, 30, n)), "tied": rng.integers(0, 3, n) * 1.0, "zero": rng.choice([0.0, -0.0, 1e-300], n),
               "gaps": np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n))}
    times = rng.integers(0, 4, (n, 5)).astype(np.uint8)
    times[:, 4] = 0
    data = [(float(i % 2), times[i].tolist(), *(float(v[i]) for v in columns.values())) for i in range(n)]
    df = spark.createDataFrame(data, "label double, times array<tinyint>, " + ", ".join(f"{c} double" for c in columns)).repartition(3)
    got = Batch.prepare(df, [], list(columns), F.col("times"), 5).prepared.medians
    for j, v in enumerate(columns.values()):
        for t in range(4):
            here = ~np.isnan(v)
            assert got[t, j] == np.median(np.repeat(v[here], times[here, t])), (j, t)
    assert np.isnan(got[4]).all()


def test_cuts_that_miss_cost_passes_only(rows, spark):
    batch = fold_batch(rows)
    bad = {0: batchfit._keys(np.array([1e9])), 1: batchfit._keys(np.array([-5.0, -4.0]))}
    counts = np.array([[(~np.isnan(np.array([r[c] if r[c] is not None else np.nan for r in rows.filter(F.col("_f") != f).collect()]))).sum() for f in (1, 2, 3)] for c in NUM])
    got = batchfit.weighted_medians(batch.packed, batch.layout, 3, counts.astype(float), bad)
    assert np.array_equal(got[:, :2], batch.prepared.medians[:, :2])


@pytest.mark.parametrize("bucket", [1 << 20, 40, 1])
def test_aucs_equal_rank_metrics(rows, solved, bucket):
    """With one bucket a fit and with very many; a fit without coefficients ties all scores."""
    batch, fits = solved
    flat = batchfit.LinearFit(0, np.zeros(len(batch.prepared.slots)), 0.3, np.eye(batch.layout.width)[2 * len(NUM)] * 0.3, 1)
    use = [fits[0], fits[4], flat, None]
    scored = batch.score(rows, use, ["label"], F.array(F.lit(0), F.lit(1)), 2)
    want = {(r["_group"], r["_fit"]): r["roc_auc"] for r in metrics.rank_metrics(scored, ["_group", "_fit"], "label", "prob").collect()}
    got = batch.aucs(rows, use, F.array(F.lit(0), F.lit(1)), 2, bucket=bucket)
    assert got[3] is None and got[2] == 0.5
    assert [got[k] for k in range(3)] == pytest.approx([want[k // 2, k % 2] for k in range(3)], abs=1e-12)
    assert batch.aucs(rows.filter("label = 1"), use, F.array(F.lit(0)), 2) == {0: None, 1: None, 2: None, 3: None}


def test_draws_equal_sql(spark):
    df = spark.range(300).withColumn("row_id", F.col("id") * 7)
    got = batchfit.hashed_draws([str(7 * k) for k in range(300)], 6, 42, 0.7)
    for d in range(6):
        want = [r["w"] for r in df.orderBy("row_id").select(stability.draw_weight(d, 0.7, 42, "row_id").alias("w")).collect()]
        assert got[:, d].tolist() == want


def test_draws_fit_their_copies(spark, rows):
    """A draw's fit equals a single fit on the drawn rows with copies."""
    df = rows.withColumnRenamed("_id", "row_id")
    batch = Batch.prepare(df, CAT, NUM, None, 3, draws=(42, 0.7), id_col="row_id")
    fits = batch.fit([(d, 1.0, 0.5) for d in range(3)])
    copies = df.withColumn("w", stability.draw_weight(1, 0.7, 42, "row_id")).filter("w > 0").withColumn("k", F.explode(F.expr("sequence(1, w)")))
    train = search.with_balanced_weight(copies.select("label", *NUM, *CAT))
    pre = prep.fit_preprocessor(train, CAT, NUM)
    vec = pre.transform(train).select("features", "label", "weight").toPandas()
    X, y, w = np.vstack([v.toArray() for v in vec.features]), vec.label.to_numpy(), vec.weight.to_numpy()
    names = {n: k for k, n, _, _ in batch.prepared.slots}
    coef = np.array([fits[1].coef[names[s[1]]] for s in prep.slot_table(pre, CAT, NUM)])
    grad = X.T @ (w * (1 / (1 + np.exp(-(X @ coef + fits[1].intercept))) - y))
    for g, b in zip(grad, coef, strict=True):
        assert abs(g + 0.5 * np.sign(b) + 0.5 * b) < 1e-5 if abs(b) > 1e-9 else abs(g) <= 0.5 + 1e-5


def test_sets_of_one_class_and_empty_tables(spark, rows):
    times = F.array(F.lit(1).cast("tinyint"), (F.col("label") == 1).cast("tinyint"), F.lit(0).cast("tinyint"))
    batch = Batch.prepare(rows, CAT, NUM, times, 3)
    fits = batch.fit([(0, 1.0, 0.5), (1, 1.0, 0.5), (2, 1.0, 0.5)])
    assert fits[0] is not None and fits[1] is None and fits[2] is None and batch.fit([]) == []
    empty = Batch.prepare(rows.limit(0), CAT, NUM, times, 3)
    assert empty.fit([(0, 1.0, 0.5)]) == [None]


def test_scratch_is_removed(spark, rows):
    import os

    batch = fold_batch(rows)
    assert os.path.isdir(batch.path)
    batch.discard()
    assert not os.path.exists(batch.path)


# ------------------------------------------------------------------ folds, searches and nested searches

def test_inner_folds_follow_from_one_ranking(rows):
    """Ranks without a fold give the folds that the training rows alone would get."""
    ranked = search.class_ranks(rows.drop("_f"), "label", 42, "_id").withColumn("_fout", ((F.col("_rank") - 1) % 5 + 1).cast("int")).persist()
    for f in (1, 3, 5):
        train = ranked.filter(F.col("_fout") != f)
        want = search.stratified_folds(train.select("_id", "label"), "label", 3, 42, "_id", "want")
        got = train.select("_id", ((search.rank_without_fold(F.col("_rank"), f, 5) - 1) % 3 + 1).cast("int").alias("got"))
        assert got.join(want, "_id").filter("got != want").count() == 0 and got.count() == want.count()
    ranked.unpersist()


def test_search_and_oof_equal_single_fits(rows):
    base = rows.drop("_f")
    best, means = search.search(base, "elasticnet", {"C": [0.05, 1.0], "l1_ratio": [0.2]}, CAT, NUM, inner=3)
    oof = search.oof_predict(base, "elasticnet", {"C": 1.0, "l1_ratio": 0.2}, CAT, NUM, inner=3).persist()
    folded = search.stratified_folds(base, "label", 3, 42, "_id", "_fin").persist()
    aucs = []
    for f in (1, 2, 3):
        pm = search.fit_pipeline(folded.filter(F.col("_fin") != f), "elasticnet", {"C": 1.0, "l1_ratio": 0.2, "tol": 1e-12}, CAT, NUM)
        p = pm.transform(folded.filter(F.col("_fin") == f)).select("_id", "label", models.prob_of_one(F.col("probability")).alias("p"), F.lit(1).alias("g"))
        assert p.join(oof, "_id").select(F.max(F.abs(F.col("p") - F.col("prob")))).first()[0] < 1e-4
        aucs.append(metrics.rank_metrics(p, ["g"], "label", "p").first()["roc_auc"])
    assert oof.count() == 700 and dict((p["C"], m) for p, m in means)[1.0] == pytest.approx(np.mean(aucs), abs=2e-3)
    assert best == max(means, key=lambda m: m[1])[0]


def test_nested_cv_equals_its_parts(rows):
    df = rows.withColumnRenamed("_id", "row_id").withColumnRenamed("label", "y")
    space = {"C": [0.02, 1.0], "l1_ratio": [0.5]}
    res = search.nested_cv(df, "y", CAT, NUM, "elasticnet", space, outer=3, inner=2)
    preds = res.predictions.persist()
    assert preds.count() == 700 and len(res.best_params) == 3 and res.fold_metrics.count() == 3
    base = rows.drop("_f")
    folded = search.stratified_folds(base, "label", 3, 42, "_id", "_fout").persist()
    train, test = folded.filter("_fout != 2").drop("_fout"), folded.filter("_fout = 2")
    best, _ = search.search(train, "elasticnet", space, CAT, NUM, inner=2)
    assert res.best_params[1] == best
    pm = search.fit_pipeline(train, "elasticnet", {**best, "tol": 1e-12}, CAT, NUM)
    p = pm.transform(test).select(F.col("_id").alias("row_index"), models.prob_of_one(F.col("probability")).alias("p"))
    cal = calibrate.fit_platt(search.oof_predict(train, "elasticnet", best, CAT, NUM, inner=2), "label", "prob")
    own = preds.filter("fold = 2").join(p, "row_index").withColumn("q", cal.column(F.col("prob")))
    assert own.count() == test.count()
    far = own.agg(F.max(F.abs(F.col("p") - F.col("prob"))), F.max(F.abs(F.col("q") - F.col("prob_calibrated")))).first()
    assert far[0] < 1e-4 and far[1] < 1e-4
    none = search.nested_cv(df, "y", CAT, NUM, "elasticnet", {}, outer=2, inner=2, recalibration=None).predictions
    assert none.filter("prob_calibrated is not null").count() == 0


def test_platt_lines_together(spark):
    rng = np.random.default_rng(5)
    data = [(k, float(rng.random() < p), float(p)) for k in (1, 2, 3) for p in rng.beta(0.5, k, 400)]
    df = spark.createDataFrame([*data, (1, None, 0.5), (2, 1.0, None)], "fold int, y double, p double").persist()
    lines = calibrate.fit_platts(df, "fold", [1, 2, 3], "y", "p")
    for k, line in lines.items():
        one = calibrate.fit_platt(df.filter(F.col("fold") == k), "y", "p")
        assert (line.intercept, line.slope) == pytest.approx((one.intercept, one.slope), abs=1e-5)
    with pytest.raises(ValueError):
        calibrate.fit_platts(df, "fold", [9], "y", "p")


@pytest.mark.parametrize("kind, params", [("glassbox_additive", {"max_bins": 8, "C": 0.5}), ("gam_spline", {"n_knots": 5})])
def test_binned_and_splined_fits_equal_single_fits(rows, kind, params):
    base = rows.drop("_f")
    oof = search.oof_predict(base, kind, params, CAT, NUM[:2], inner=3).persist()
    folded = search.stratified_folds(base, "label", 3, 42, "_id", "_fin").persist()
    pm = search.fit_pipeline(folded.filter("_fin != 2"), kind, {**params, "tol": 1e-12}, CAT, NUM[:2])
    p = pm.transform(folded.filter("_fin = 2")).select("_id", models.prob_of_one(F.col("probability")).alias("p"))
    assert oof.count() == 700
    assert p.join(oof, "_id").select(F.max(F.abs(F.col("p") - F.col("prob")))).first()[0] < 2e-3  # the single fit's solver stops at 1e-4
    nested = search.nested_cv(rows.withColumnRenamed("_id", "row_id").withColumnRenamed("label", "y"), "y", CAT, NUM[:2], kind, {k: [v] for k, v in params.items()}, outer=2, inner=2)
    assert nested.predictions.count() == 700 and nested.predictions.filter("prob_calibrated is null").count() == 0


def test_stability_of_many_draws(spark, rows):
    df = rows.withColumnRenamed("_id", "row_id").withColumnRenamed("label", "y")
    draws = stability.stability_draws(df, "y", NUM + CAT, CAT, NUM, n_draws=40, frac=0.7)
    out = {r["feature"]: r for r in stability.stability_summary(draws).collect()}
    assert set(out) == set(NUM + CAT) and draws.count() == 40 * 5
    assert out["x1"]["inclusion_freq"] == 1.0 and out["x1"]["sign_consistency"] == 1.0 and out["flat"]["inclusion_freq"] == 0.0


def test_scores_travel_short(rows, solved):
    """A score is 8 bytes between tasks, and equal scores travel once with their rows."""
    import pyarrow as pa

    batch, fits = solved
    n, levels = 4000, batch.layout.levels
    record = {f"_n{k}": pa.array(np.arange(n) * 0.001 if k == 0 else np.full(n, 5.0)) for k in range(3)}
    record |= {f"_c{k}": pa.array([levels[k][0]] * n) for k in range(2)}
    record |= {"_groups": pa.array([[0]] * n, pa.list_(pa.int32())), "_label": pa.array(np.arange(n) % 2.0)}
    sent = lambda b: sum(len(r["keys"]) + len(r["counts"] or b"") for out in batchfit._send_scores(batch.layout, batchfit.Margins(fits[4:5]), 1, {0: batchfit._keys(np.array([0.0]))})(iter([b])) for r in out.to_pylist())
    assert sent(pa.RecordBatch.from_pydict(record)) <= 8 * n
    record["_n0"] = pa.array(np.full(n, 3.0))
    assert sent(pa.RecordBatch.from_pydict(record)) <= 24


def test_rows_of_like_sets_are_one_run(rows):
    batch = fold_batch(rows)
    for r in batch.packed.toArrow().to_pylist():
        b = batchfit._Rows(batch.layout, 3, r)
        runs = [part for part, _ in batchfit._runs(b, np.arange(3))]
        assert len(runs) == 6 if batchfit.RUN * 6 <= r["n"] else len(runs) == 1
    batch.discard()


def test_draw_hashes_are_md5(monkeypatch):
    import hashlib

    from cohortflow.operators import draws

    monkeypatch.setattr(draws, "CHUNK", 7)
    heads = [f"42|{d}".encode() for d in (0, 9, 10, 123)]
    tails = [b"", b"|x", "|é".encode(), b"|" + b"y" * 51, b"|" + b"z" * 80, *(f"|{k}".encode() for k in range(30))]
    want = [[int.from_bytes(hashlib.md5(h + x).digest()[:4], "big") for x in tails] for h in heads]
    assert draws.first_digits(heads, tails).tolist() == want
    assert draws.counts(heads, tails, [0.5, 1.0]).tolist() == [[int(u >= 2 ** 31) for u in own] for own in want]


def test_bootstrap_weights_equal_their_columns(spark):
    """As the column form has them, for a missing id too; no plan makes a row a draw before its hash."""
    df = spark.createDataFrame([(None,), (7,), (999,), (123456789,), (7,)], "row_id long")
    got = stability.bootstrap_weights(df, 40, 0.7, 42)
    draws = df.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("draw"))
    want = stability.with_poisson_weight(draws, 42, 0.7, "row_id").filter(stability.drawn(0.7)).drop("_u")
    key = lambda d: sorted((str(r["row_id"]), r["draw"], r["w"]) for r in d.collect())
    assert key(got) == key(want) and got.columns == want.columns
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_draw_sums(spark, rows):
    df = rows.select(F.col("_id").alias("row_id"), "label", "x1")
    got = {(r["draw"], r["y"]): (r["w"], r["wx"], r["wxx"]) for r in stability.draw_sums(df, "label", ["x1"], 3, 0.7, 42).collect()}
    long = stability.bootstrap_weights(df, 3, 0.7, 42).join(df, "row_id").filter("x1 is not null").groupBy("draw", "label").agg(
        F.sum("w").alias("w"), F.sum(F.expr("w * x1")).alias("wx"), F.sum(F.expr("w * x1 * x1")).alias("wxx")).collect()
    assert len(got) == len(long)
    for r in long:
        assert got[r["draw"], r["label"]] == pytest.approx((r["w"], r["wx"], r["wxx"]))


def test_balanced_weight_needs_no_join(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (1.0,), (None,)], "label double")
    out = search.with_balanced_weight(df)
    assert "Join" not in out._jdf.queryExecution().toString()
    assert sorted((r["label"], r["weight"]) for r in out.collect()) == [(0.0, 5 / 9)] * 3 + [(1.0, 5 / 3)]


def test_auroc_of_packed_rows_is_that_of_the_table(rows, solved):
    """Whole and small buckets; rows of a set that another leaves out."""
    batch, fits = solved
    fold = F.array((F.col("_f") - 1).cast("int"))
    whole = batch.aucs(rows, fits, fold, len(GRID))
    assert batch.held_aucs(fits, [(-1, t) for t in range(3)], len(GRID)) == pytest.approx(whole, abs=1e-12)
    assert batch.held_aucs(fits, [(-1, t) for t in range(3)], len(GRID), bucket=20) == pytest.approx(whole, abs=1e-12)
    # rows in the first set and not in the second are those of the second fold
    second = batch.held_aucs(fits[: len(GRID)], [(0, 1)], len(GRID))
    assert second == pytest.approx(batch.aucs(rows.filter("_f = 2"), fits[: len(GRID)], F.array(F.lit(0)), len(GRID)), abs=1e-12)


def test_candidates_of_a_set_share_curvatures(rows, solved, monkeypatch):
    """One curvature a set and pass while the steps shrink, and the coefficients of fits that each take their own."""
    batch, fits = solved
    near = [(t, C, 0.5) for t in range(3) for C in (10.0, 20.0, 50.0, 100.0)]
    asked = []

    def counted(layout, sets, raw, which, balance, bent):
        asked.append((len(raw), len(bent)))
        return curves(layout, sets, raw, which, balance, bent)

    curves = batchfit._curves
    monkeypatch.setattr(batchfit, "_curves", counted)
    shared = batch.fit(near)
    assert max(bent for _, bent in asked) == 3 and max(n for n, _ in asked) == 9
    solve = batchfit._solve
    monkeypatch.setattr(batchfit, "_solve", lambda *a: solve(*a[:4]))
    for x, y in zip(shared, batch.fit(near), strict=True):
        assert x.coef == pytest.approx(y.coef, abs=1e-8) and x.intercept == pytest.approx(y.intercept, abs=1e-8)


def test_frequent_values_are_found_by_the_first_count(spark, monkeypatch):
    """Ten values of 1,000 rows each: no range is halved down to a value, no value is listed."""
    df = spark.range(10000).select((F.col("id") % 2).cast("double").alias("label"), ((F.col("id") % 10) / 7).alias("x"))
    passes = []
    summed = batchfit._summed
    monkeypatch.setattr(batchfit, "EXACT", 8)
    batch = Batch.prepare(df, [], ["x"], F.array(F.lit(1).cast("tinyint")), 1)
    monkeypatch.setattr(batchfit, "_summed", lambda parts: passes.append(1) or summed(parts))
    monkeypatch.setattr(batchfit, "_list_values", None)
    wanted = {(0, 0): [0, 999, 1000, 5500, 9999]}
    found = batchfit.order_statistics(batch.packed, batch.layout, 1, wanted, batch.cuts)
    assert [found[0, 0, r] for r in wanted[0, 0]] == [0 / 7, 0 / 7, 1 / 7, 5 / 7, 9 / 7] and len(passes) == 1
    assert batch.prepared.medians[0, 0] == (4 / 7 + 5 / 7) / 2


def test_families_of_an_experiment_share_their_rows(rows, monkeypatch):
    """Rows are ranked and packed once an outcome and feature set; every family's metrics are those of its own nested search."""
    df = rows.withColumnRenamed("_id", "row_id").withColumn("y_a", F.col("label")).withColumn("y_b", 1 - F.col("label")).drop("label")
    made = []
    prepare = search.NestedRows.prepare
    monkeypatch.setattr(search.NestedRows, "prepare", lambda self, *a: made.append(1) or prepare(self, *a))
    families = {"elasticnet": {"C": [0.1, 1.0]}, "glassbox_additive": {"max_bins": [4]}}
    got, _ = search.run_experiment(df, ["a", "b"], {"F": ["x1", "cat"]}, families, outer=2, inner=2)
    assert len(made) == 2
    alone = search.nested_cv(df, "y_b", ["cat"], ["x1"], "glassbox_additive", families["glassbox_additive"], outer=2, inner=2).fold_metrics
    keep = lambda t: sorted((r["fold"], r["roc_auc"], r["brier"], r["brier_calibrated"]) for r in t.collect())
    for x, y in zip(keep(got.filter("outcome = 'b' and model = 'glassbox_additive'")), keep(alone), strict=True):
        assert x == pytest.approx(y, abs=1e-9)
