"""Post-scoring operators: tiers truth table, pruning curve against brute force, tail pruning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions.exprs import tier_expr
from cohortflow.operators import postscore


def _auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    d = pos[:, None] - neg[None, :]
    return float(((d > 0) + 0.5 * (d == 0)).mean())


def test_tier_truth_table(spark):
    rows = [(0, 0.8, 0.7, 0.0), (1, 0.8, 0.1, 0.0), (2, 0.1, 0.1, 0.7), (3, 0.6, 0.1, 0.1), (4, 0.1, 0.1, 0.1),
            (5, None, 0.7, None), (6, None, None, None), (7, 0.8, None, 0.0)]
    df = spark.createDataFrame(rows, "i int, h double, g double, l double")
    got = [r[0] for r in df.select(tier_expr(F.col("h"), F.col("g"), F.col("l"))).collect()]
    assert got == ["T3", "T2", "T2", "T1", "T0", "T2", "T0", "T2"]


def _brute_greedy(ids, y, p, target, limit):
    err = np.where(y == 1, 1 - p, p)
    order = sorted(range(len(ids)), key=lambda i: (-err[i], ids[i]))
    keep = np.ones(len(ids), bool)
    auc = _auc(y, p)
    dropped = []
    for i in order:
        if (auc is not None and auc >= target) or len(dropped) >= limit:
            break
        keep[i] = False
        dropped.append((ids[i], _auc(y[keep], p[keep])))
        auc = dropped[-1][1]
    return dropped


@pytest.mark.parametrize("target,limit", [(0.8, 60), (0.99, 40)])
def test_greedy_prune_curve_matches_brute_force(spark, target, limit):
    rng = np.random.default_rng(11)
    n = 300
    p = np.round(rng.random(n), 2)
    y = (rng.random(n) < (0.3 + 0.4 * p)).astype(float)
    ids = np.arange(1000, 1000 + n)
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in zip(ids, y, p)],
                               "row_index long, y_true double, prob double")
    got = postscore.greedy_prune_curve(df, target_auc=target, limit=limit).orderBy("k").collect()
    exp = _brute_greedy(list(ids), y, p, target, limit)
    assert [r["row_index"] for r in got] == [e[0] for e in exp]
    for r, e in zip(got, exp):
        assert r["auc_after"] == pytest.approx(e[1], abs=1e-12)


def test_per_class_tail_prune(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(i % 2), float(np.round(rng.random(), 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "row_index long, y_true double, prob double")
    out = postscore.per_class_tail_prune(df, drop_per_iter=6).collect()
    assert len(out) == 6
    for cls in (0.0, 1.0):
        errs = sorted([(1 - p if y == 1 else p) for _, y, p in rows if y == cls])
        thr = np.quantile(errs, 0.95)
        picked = [r for r in out if r["y_true"] == cls]
        assert len(picked) == 3 and all(r["error"] > thr for r in picked)
