"""Discrimination and calibration metrics over prediction tables.

Every metric runs as one grouped job over arbitrary key columns (e.g.
``outcome, featureset, model, fold``), never as a Python loop over groups.

Rank metrics (AUROC, average precision) need, for each distinct score, the
number of negatives/positives with a lower score.  A global ``orderBy``
window would put a whole key group into one task, so cumulative counts are
computed in two levels: rows are pre-aggregated to distinct scores, each group's
scores are cut at their own quantiles, bucket totals (small: keys x buckets) get a
running sum as offsets, and the exact running sum inside each bucket is a
window partitioned by (keys, bucket).  Exact, and parallel however the scores crowd.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colref import c
from ..functions.exprs import clip_prob, logit
from ..session import scratch_path
from .quantiles import bucket_edges, bucket_of

METRIC_COLUMNS = ["roc_auc", "pr_auc", "brier", "accuracy", "f1", "calibration_intercept", "calibration_slope"]


def score_counts(df: DataFrame, keys: Sequence[str], y: str = "y_true", score: str = "prob") -> DataFrame:
    """(keys, score, pos, neg) with rows of NULL label or score dropped."""
    yy = c(y).cast("double")
    return (df.filter(yy.isNotNull() & c(score).isNotNull())
            .groupBy(*[c(k) for k in keys], c(score).cast("double").alias("score"))
            .agg(F.sum((yy == 1.0).cast("long")).alias("pos"), F.sum((yy != 1.0).cast("long")).alias("neg")))


def cumulative_below(counts: DataFrame, keys: Sequence[str], cols: Sequence[str], score: str = "score") -> DataFrame:
    """Add ``{col}_below`` = sum of ``col`` over rows of the same keys with a strictly lower score, and
    ``{col}_total`` = sum over the whole key group.

    ``counts`` must hold one row per (keys, score).  Bucket boundaries are quantiles of each group's
    distinct scores, so a crowd of scores near 0 spreads over as many buckets as any other.
    Offsets and totals come from the bucket table (keys x buckets rows).
    """
    keys = list(keys)
    if not keys:
        return cumulative_below(counts.withColumn("_all", F.lit(0)), ["_all"], cols, score).drop("_all")
    edges = bucket_edges(counts, keys, score)
    with_b = counts.join(edges, keys).withColumn("_bucket", bucket_of(c(score), c("_edges"))).drop("_edges")
    kcols = [c(k) for k in keys]
    totals = with_b.groupBy(*kcols, "_bucket").agg(*[F.sum(col).alias(f"_t_{col}") for col in cols])
    w_b = Window.partitionBy(*kcols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    w_k = Window.partitionBy(*kcols)
    offsets = totals.select(*kcols, "_bucket",
                            *[F.coalesce(F.sum(f"_t_{col}").over(w_b), F.lit(0)).alias(f"_o_{col}") for col in cols],
                            *[F.sum(f"_t_{col}").over(w_k).alias(f"_T_{col}") for col in cols])
    w_in = Window.partitionBy(*kcols, "_bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    inside = with_b.select("*", *[F.coalesce(F.sum(col).over(w_in), F.lit(0)).alias(f"_i_{col}") for col in cols])
    joined = inside.join(offsets, [*keys, "_bucket"], "inner")
    return joined.select(*[c(n) for n in counts.columns],
                         *[(c(f"_o_{col}") + c(f"_i_{col}")).alias(f"{col}_below") for col in cols],
                         *[c(f"_T_{col}").alias(f"{col}_total") for col in cols])


def rank_metrics(df: DataFrame, keys: Sequence[str], y: str = "y_true", score: str = "prob") -> DataFrame:
    """(keys, roc_auc, pr_auc): tie-aware AUROC (mid-rank) and step-wise average precision.

    NULL when a key group has only one class.
    """
    return rank_from_counts(score_counts(df, keys, y, score), keys)


def rank_from_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rank_metrics`` from (keys, score, pos, neg)."""
    cum = cumulative_below(counts, keys, ["pos", "neg"])
    kcols = [c(k) for k in keys]
    j = cum.withColumnsRenamed({"pos_total": "P", "neg_total": "N"})
    ap_term = F.when(c("pos") > 0, c("pos") * (c("P") - c("pos_below")) /
                     ((c("P") + c("N")) - (c("pos_below") + c("neg_below"))))
    out = j.groupBy(*kcols).agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum(c("pos") * (c("neg_below") + c("neg") * 0.5)).alias("U"),
        F.sum(ap_term).alias("AP"))
    return out.select(*kcols,
                      F.when((c("P") > 0) & (c("N") > 0), c("U") / (c("P") * c("N"))).alias("roc_auc"),
                      F.when(c("P") > 0, c("AP") / c("P")).alias("pr_auc"))


def point_metrics(df: DataFrame, keys: Sequence[str], y: str = "y_true", score: str = "prob",
                  threshold: float = 0.5) -> DataFrame:
    """(keys, n, pos, brier, accuracy, f1, calibration_intercept, calibration_slope)."""
    yy, p = c(y).cast("double"), c(score).cast("double")
    valid = df.filter(yy.isNotNull() & p.isNotNull())
    pred = (p >= threshold).cast("double")
    lg = logit(p)
    out = valid.groupBy(*[c(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((yy == 1.0).cast("long")).alias("pos"),
        F.avg((p - yy) * (p - yy)).alias("brier"),
        F.avg((pred == yy).cast("double")).alias("accuracy"),
        F.sum(((pred == 1.0) & (yy == 1.0)).cast("long")).alias("_tp"),
        F.sum(((pred == 1.0) & (yy != 1.0)).cast("long")).alias("_fp"),
        F.sum(((pred != 1.0) & (yy == 1.0)).cast("long")).alias("_fn"),
        F.regr_intercept(yy, lg).alias("calibration_intercept"),
        F.regr_slope(yy, lg).alias("calibration_slope"),
    )
    denom = c("_tp") + (c("_fp") + c("_fn")) * 0.5
    return out.select(*[c(k) for k in keys], "n", "pos", "brier", "accuracy",
                      F.when(denom > 0, c("_tp") / denom).otherwise(F.lit(0.0)).alias("f1"),
                      "calibration_intercept", "calibration_slope")


def _from_counts(counts: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """The point metrics from (keys, score, pos, neg): sums over distinct scores."""
    p, lg = c("score"), logit(c("score"))
    m = c("pos") + c("neg")
    hit = (p >= threshold)
    s = counts.groupBy(*[c(k) for k in keys]).agg(
        F.sum(m).alias("n"), F.sum("pos").alias("sy"), F.sum(c("pos") * (p - 1) * (p - 1) + c("neg") * p * p).alias("se"),
        F.sum(F.when(hit, c("pos")).otherwise(c("neg"))).alias("ok"),
        F.sum(F.when(hit, c("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, c("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(c("pos"))).alias("fn"),
        F.sum(m * lg).alias("sx"), F.sum(m * lg * lg).alias("sxx"), F.sum(c("pos") * lg).alias("sxy"),
        (F.min(lg) < F.max(lg)).alias("spread"))
    n = c("n").cast("double")
    # one constant score has no slope; its sums would leave rounding errors to divide
    slope = F.when(c("spread"), F.try_divide(n * c("sxy") - c("sx") * c("sy"), n * c("sxx") - c("sx") * c("sx")))
    half = c("tp") + (c("fp") + c("fn")) * 0.5
    return s.select(*[c(k) for k in keys], (c("se") / n).alias("brier"), (c("ok") / n).alias("accuracy"),
                    F.when(half > 0, c("tp") / half).otherwise(F.lit(0.0)).alias("f1"),
                    ((c("sy") - slope * c("sx")) / n).alias("calibration_intercept"), slope.alias("calibration_slope"))


def fold_metrics(preds: DataFrame, keys: Sequence[str] = ("outcome", "featureset", "model", "fold"),
                 y: str = "y_true", score: str = "prob", suffix: str = "") -> DataFrame:
    """The seven fold metrics per key group.

    Predictions are read once: counts per (keys, distinct score) are written to the shared folder, and
    the rank and point parts are both taken from there.
    """
    keys = list(keys)
    path = scratch_path(preds.sparkSession, "score-counts")
    score_counts(preds, keys, y, score).write.parquet(path)
    counts = preds.sparkSession.read.parquet(path)
    out = _from_counts(counts, keys).join(rank_from_counts(counts, keys), keys, "left")
    return out.select(*[c(k) for k in keys], *[c(m).alias(m + suffix) for m in METRIC_COLUMNS])


def fold_metrics_both(preds: DataFrame, keys: Sequence[str] = ("outcome", "featureset", "model", "fold"), y: str = "y_true") -> DataFrame:
    """Fold metrics of ``prob`` and, suffixed ``_calibrated``, of ``prob_calibrated``: both variants in one pass."""
    keys = list(keys)
    both = F.array(*[F.struct(F.lit(v).alias("variant"), c(n).cast("double").alias("_score")) for v, n in (("raw", "prob"), ("calibrated", "prob_calibrated"))])
    long = fold_metrics(preds.select(*[c(k) for k in keys], c(y), F.inline(both)), [*keys, "variant"], y, "_score")
    wide = [F.max(F.when(c("variant") == v, c(m))).alias(m + s) for v, s in (("raw", ""), ("calibrated", "_calibrated")) for m in METRIC_COLUMNS]
    return long.groupBy(*[c(k) for k in keys]).agg(*wide)


def classification_summary(preds: DataFrame, keys: Sequence[str] = ("outcome", "featureset", "model"),
                           y: str = "y_true", score: str = "prob") -> DataFrame:
    """Pooled OOF summary per model: n, pos, pos_rate, roc_auc, pr_auc, brier on clipped probabilities."""
    keys = list(keys)
    clipped = preds.filter(c(y).isNotNull() & c(score).isNotNull()).select(
        *[c(k) for k in keys], c(y).cast("double").alias("_y"), clip_prob(c(score).cast("double")).alias("_p"))
    # the predictions are read once: both parts come from the written counts of distinct scores
    path = scratch_path(preds.sparkSession, "score-counts")
    score_counts(clipped, keys, "_y", "_p").write.parquet(path)
    counts = preds.sparkSession.read.parquet(path)
    p, n = c("score"), F.sum(c("pos") + c("neg"))
    base = counts.groupBy(*[c(k) for k in keys]).agg(
        n.alias("n"), F.sum("pos").cast("double").alias("pos"), (F.sum("pos") / n).alias("pos_rate"),
        (F.sum(c("pos") * (p - 1) * (p - 1) + c("neg") * p * p) / n).alias("brier"))
    return base.join(rank_from_counts(counts, keys), keys, "left").select(*[c(k) for k in keys], "n", "pos", "pos_rate", "roc_auc", "pr_auc", "brier")


def mean_fold_metrics(fold_table: DataFrame, keys: Sequence[str] = ("outcome", "featureset", "model"),
                      metrics: Sequence[str] = tuple(METRIC_COLUMNS)) -> DataFrame:
    """Mean of each metric over folds ignoring NULLs; n_folds = folds with an AUROC."""
    present = [m for m in metrics if m in fold_table.columns]
    return fold_table.groupBy(*[c(k) for k in keys]).agg(
        *[F.avg(c(m)).alias(f"mean_{m}") for m in present],
        F.count(c("roc_auc")).alias("n_folds"))


def best_model_per_outcome(mean_table: DataFrame, seq: str | None = None,
                           restrict_featuresets: Sequence[str] | None = None,
                           picks: DataFrame | None = None, metric: str = "mean_roc_auc") -> DataFrame:
    """Highest mean AUROC per outcome; ties go to the earliest candidate (``seq``, else featureset/model).

    Explicit ``picks`` (outcome, featureset, model) override the choice.
    """
    if picks is not None:
        return mean_table.join(picks.select("outcome", "featureset", "model"),
                               ["outcome", "featureset", "model"], "left_semi")
    t = mean_table.filter(c(metric).isNotNull())
    if restrict_featuresets is not None:
        t = t.filter(c("featureset").isin(list(restrict_featuresets)))
    order = [F.desc(metric)] + ([c(seq)] if seq else [c("featureset"), c("model")])
    w = Window.partitionBy("outcome").orderBy(*order)
    return t.withColumn("_rn", F.row_number().over(w)).filter(c("_rn") == 1).drop("_rn")
