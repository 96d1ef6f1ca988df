"""Boosted trees of a search, grown by tasks of one fit each, against Spark's own and plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import search, treefit
from cohortflow.operators.batchfit import Design
from cohortflow.plans import queries_fit


@pytest.fixture(scope="module")
def few(spark):
    """Features of few values, so that Spark's bins and exact quantiles are the same cuts; missing numbers and texts."""
    rng = np.random.default_rng(5)
    n = 500
    x1, x2 = rng.integers(0, 7, n).astype(float), rng.choice([0.0, 1.5, 4.0, 9.0, 11.0], n)
    cat = rng.choice(["a", "b", "c"], n, p=[0.5, 0.3, 0.2])
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 * (x1 - 3) + 0.3 * (x2 > 3) * (cat == "a") - 0.2)))).astype(float)
    data = [(i, float(y[i]), float(x1[i]) if i % 13 else None, float(x2[i]), str(cat[i]) if i % 17 else None) for i in range(n)]
    return spark.createDataFrame(data, "_id long, label double, x1 double, x2 double, cat string").persist()


def test_search_equals_sparks_trees(few, monkeypatch):
    """All rows and columns for every tree: the same splits, whichever way the trees are grown."""
    space = {"n_estimators": [1, 4], "max_depth": [1, 3], "learning_rate": [0.3]}
    best, scores = search.search(few, "boosted_trees", space, ["cat"], ["x1", "x2"], inner=2)
    monkeypatch.setattr(treefit, "CODE_BYTES", 0)  # too many codes to send
    assert treefit.fits(few.withColumn("_fin", F.lit(1)), [{}], ["cat"], ["x1", "x2"], 2, 1, 0.01) is None
    spark_best, spark_scores = search.search(few, "boosted_trees", space, ["cat"], ["x1", "x2"], inner=2)
    assert [p for p, _ in scores] == [p for p, _ in spark_scores]
    assert [s for _, s in scores] == pytest.approx([s for _, s in spark_scores], abs=1e-9)
    assert best == spark_best


def test_number_of_trees_is_a_prefix_and_dealing_does_not_matter(few):
    folded = few.withColumn("_fin", (F.col("_id") % 2 + 1).cast("int"))
    deal = lambda df, cands: treefit.fits(df, cands, ["cat"], ["x1", "x2"], 2, 7, 0.01)
    drawn = {"max_depth": 3, "subsample": 0.7, "colsample_bytree": 0.7}
    both = deal(folded, [{"n_estimators": 3, **drawn}, {"n_estimators": 6, **drawn}])
    assert len(both) == 4 and both[0] != both[1]
    alone = deal(folded.repartition(5), [{"n_estimators": 3, **drawn}])
    assert [alone[0], alone[1]] == [both[0], both[2]]


def test_one_class_gives_no_score(spark, few):
    folded = few.withColumn("_fin", F.when(F.col("label") == 1, 1).otherwise(2))
    assert treefit.fits(folded, [{"n_estimators": 2}], ["cat"], ["x1", "x2"], 2, 7, 0.01) == {0: None, 1: None}


def test_tree_is_the_greedy_one():
    """Splits and leaf values of plain search over all rules, and each row's leaf, for rows of part of the draws."""
    rng = np.random.default_rng(3)
    n = 400
    design = Design(0, np.zeros(2), [np.array([1.0, 2.0, 3.0]), np.array([5.0])], None, [np.array([0, 1, 2, -1])], 0)
    cod = treefit.coding(design)
    plain = np.column_stack([rng.integers(0, s, n) for s in cod.sizes])
    codes = []
    for group in cod.groups:
        at = np.zeros(n, dtype=np.int64)
        for f in group:
            at = at * cod.sizes[f] + plain[:, f]
        codes.append(at)
    slope, inside = rng.normal(size=n) + plain[:, 0] - (plain[:, 2] == 1), (rng.random(n) < 0.7).astype(float)
    got = treefit.grow(cod, codes, slope * inside, inside, 3, 1.0, rng).leaves(codes)
    rules = [(plain[:, f], rule) for f in range(3) for rule in cod.rules[f]]

    def grown(rows, depth):
        own = rows & (inside > 0)
        out = np.where(rows, slope[own].mean(), 0.0)
        parts = [(rows & rule[code], rows & ~rule[code]) for code, rule in rules] if depth else []
        parts = [(a, b) for a, b in parts if (a & own).any() and (b & own).any()]
        if not parts:
            return out
        gain = [sum(slope[x & own].sum() ** 2 / (x & own).sum() for x in p) for p in parts]
        if max(gain) - slope[own].sum() ** 2 / own.sum() <= 1e-10:
            return out
        a, b = parts[int(np.argmax(gain))]
        return np.where(a, grown(a, depth - 1), np.where(b, grown(b, depth - 1), 0.0))

    assert got == pytest.approx(grown(np.ones(n, dtype=bool), 3))


def test_random_search_runs_the_whole_space(spark, sf_dir, monkeypatch):
    """50 draws of the 324 candidates of 200 to 800 trees, on all labelled rows."""
    seen = {}

    def fake(train, kind, space, cat, num, inner, n_iter, seed):
        seen.update(rows=train.count(), kind=kind, cands=search.candidates_for(space, n_iter, seed), inner=inner, size=search.space_size(space))
        return {}, [({}, 0.5)]

    monkeypatch.setattr(queries_fit.search, "search", fake)
    queries_fit.random_search_q(spark, sf_dir)
    assert seen["kind"] == "boosted_trees" and seen["inner"] == 3 and seen["size"] == 324 and len(seen["cands"]) == 50
    assert {p["n_estimators"] for p in seen["cands"]} == {200, 400, 800} and {p["max_depth"] for p in seen["cands"]} == {3, 4, 5, 6}
    assert seen["rows"] == queries_fit._labelled(spark, sf_dir).count()
