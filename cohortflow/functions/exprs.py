"""Small Column-expression builders shared across operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def truth(pred: Column) -> Column:
    """Three-valued predicate -> two-valued: NULL compares as False."""
    return F.coalesce(pred, F.lit(False))


def num(col: Column) -> Column:
    """Numeric view of a column: try_cast to double and NaN -> NULL."""
    x = col.try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def clip_prob(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def logit(p: Column, eps: float = EPS) -> Column:
    q = clip_prob(p, eps)
    return F.ln(q / (F.lit(1.0) - q))


def apply_platt_expr(p: Column, intercept, slope, eps: float = EPS) -> Column:
    """1 / (1 + exp(-(a + b * logit(clip p))))."""
    a = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    b = slope if isinstance(slope, Column) else F.lit(float(slope))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(a + b * logit(p, eps))))


def error_expr(y: Column, p: Column) -> Column:
    """Per-row error: 1 - p for positives, p otherwise."""
    return F.when(y == F.lit(1.0), F.lit(1.0) - p).otherwise(p)


def tier_expr(h: Column, g: Column, l: Column, htn_hi: float = 0.8, hyper_hi: float = 0.7,
              lip_hi: float = 0.7, any_mid: float = 0.6) -> Column:
    """Joint-risk tier; comparisons against NULL count as False."""
    t3 = truth(h >= htn_hi) & truth(g >= hyper_hi)
    t2 = truth(h >= htn_hi) | truth(g >= hyper_hi) | truth(l >= lip_hi)
    t1 = truth(h >= any_mid) | truth(g >= any_mid) | truth(l >= any_mid)
    return (F.when(t3, F.lit("T3")).when(t2, F.lit("T2")).when(t1, F.lit("T1")).otherwise(F.lit("T0")))
