"""Post-prediction analytics: wide scores, joint-risk tiers, misclassification
reports, high-error profiles and review/pruning candidate lists.

Pruning operators *return* ranked candidate lists and the AUROC curve they
would give; they never delete data.  An AUROC computed after dropping the
rows a model gets wrong is not an unbiased estimate of model quality.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colref import c
from ..functions.exprs import error_expr, tier_expr
from .metrics import cumulative_below, score_counts
from .quantiles import exact_quantiles

JOINT_OUTCOMES = ("hypertension", "hyperglycemia", "dyslipidemia")


VARIANT_COLUMNS = {"raw": "prob", "calibrated": "prob_calibrated"}


def score_column(outcome: str, variant: str, tag: str | None = None) -> str:
    """Where a wide table keeps an outcome's score: ``{outcome}_prob...`` of predictions, ``{tag}__{outcome}__prob...`` of scores."""
    name = VARIANT_COLUMNS["calibrated" if variant == "calibrated" else "raw"]
    return f"{outcome}_{name}" if tag is None else f"{tag}__{outcome}__{name}"


# ---------------------------------------------------------------- scores / tiers

def scores_wide(scores: DataFrame, id_col: str = "row_index", seq: str | None = None,
                pcols: Sequence[str] = ("prob", "prob_calibrated"),
                models: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """One row per id with columns ``{tag}__{outcome}__{pcol}``.

    When several models share a key, the first non-null value in ``seq``
    order wins (``min_by`` on an explicit sequence; ``first`` would be
    nondeterministic).  Keys whose values are all NULL are skipped.  The pivot
    value list is computed up front (a tiny distinct over model keys) so the
    pivot itself is a single shuffle on the id.  ``models``, the (tag, outcome)
    pairs that are there (``list_models`` knows them), saves that pass; columns then exist
    for all of them.
    """
    order = c(seq) if seq else F.lit(0)
    long = scores.select(c(id_col).alias(id_col), order.alias("_seq"), F.explode(F.array(*[
        F.struct(F.concat_ws("__", c("tag"), c("outcome"), F.lit(p)).alias("_key"), c(p).cast("double").alias("_v"))
        for p in pcols])).alias("kv")).select(id_col, "_seq", "kv._key", "kv._v")
    if models is not None:
        keys = sorted(f"{tag}__{outcome}__{p}" for tag, outcome in set(models) for p in pcols)
    else:
        present = long.filter(c("_v").isNotNull()).select("_key").distinct()
        keys = sorted(r["_key"] for r in present.collect())  # bounded by the number of saved models
    valued = long.filter(c("_v").isNotNull())
    return valued.groupBy(id_col).pivot("_key", keys).agg(F.min_by("_v", "_seq"))


def assign_tier(df: DataFrame, prob_variant: str = "raw", outcomes: Sequence[str] = JOINT_OUTCOMES,
                htn_hi: float = 0.8, hyper_hi: float = 0.7, lip_hi: float = 0.7, any_mid: float = 0.6,
                out_col: str = "tier", tag: str | None = None) -> DataFrame:
    """Joint-risk tier from three scores; ``tag`` reads the columns of ``scores_wide``."""
    h, g, l = (c(score_column(o, prob_variant, tag)).cast("double") for o in outcomes)
    return df.withColumn(out_col, tier_expr(h, g, l, htn_hi, hyper_hi, lip_hi, any_mid))


def assign_tiers(wide: DataFrame, outcomes: Sequence[str] = JOINT_OUTCOMES, **thresholds) -> DataFrame:
    """``scores_wide`` output with a column ``{tag}__tier__{variant}`` for every tag and variant whose three scores are there."""
    present = set(wide.columns)
    tags = sorted({n.split("__", 1)[0] for n in wide.columns if n.count("__") >= 2})
    out = wide
    for tag in tags:
        for variant in VARIANT_COLUMNS:
            if all(score_column(o, variant, tag) in present for o in outcomes):
                out = assign_tier(out, variant, outcomes, out_col=f"{tag}__tier__{variant}", tag=tag, **thresholds)
    return out


def joint_risk_ladder(wide: DataFrame, prob_variant: str = "raw", outcomes: Sequence[str] = JOINT_OUTCOMES,
                      id_col: str = "row_index", **thresholds) -> DataFrame:
    """id, tier, three probabilities, three labels, variant; required columns asserted."""
    wanted = {id_col, *(score_column(o, prob_variant) for o in outcomes), *(f"{o}_y_true" for o in outcomes)}
    if absent := wanted.difference(wide.columns):
        raise ValueError(f"a risk ladder of {', '.join(outcomes)} also needs: {', '.join(sorted(absent))}")
    t = assign_tier(wide, prob_variant, outcomes, **thresholds)
    return t.select(c(id_col), "tier", *[c(score_column(o, prob_variant)) for o in outcomes],
                    *[c(f"{o}_y_true") for o in outcomes], F.lit(prob_variant).alias("prob_variant"))


def tier_summary(ladder: DataFrame, prob_variant: str = "raw", outcomes: Sequence[str] = JOINT_OUTCOMES) -> DataFrame:
    """Per tier: n and per outcome pos, pos_rate (NULL labels in the denominator), mean prob; tier desc."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for o in outcomes:
        y = c(f"{o}_y_true").cast("double")
        aggs += [F.sum((y == 1.0).cast("long")).alias(f"{o}_pos"),
                 F.avg(F.coalesce((y == 1.0).cast("double"), F.lit(0.0))).alias(f"{o}_pos_rate"),
                 F.avg(c(score_column(o, prob_variant)).cast("double")).alias(f"{o}_prob_mean")]
    return ladder.groupBy("tier").agg(*aggs).withColumn("prob_variant", F.lit(prob_variant)).orderBy(F.desc("tier"))


def tier_members(ladder: DataFrame, tier: str = "T3", id_col: str = "row_index") -> DataFrame:
    return ladder.filter(c("tier") == tier).select(c(id_col))


# ---------------------------------------------------------------- misclassification

def selected_predictions_long(preds: DataFrame, picks: DataFrame, prob_variant: str = "raw") -> DataFrame:
    """Predictions of the picked (outcome, featureset, model) with ``prob_used`` and ``error``."""
    if prob_variant == "calibrated" and "prob_calibrated" not in preds.columns:
        raise ValueError("prob_calibrated not found in predictions")
    sel = preds.join(picks.select("outcome", "featureset", "model"), ["outcome", "featureset", "model"], "left_semi")
    used = c("prob_calibrated") if prob_variant == "calibrated" else c("prob")
    return sel.withColumn("prob_used", used.cast("double")) \
        .withColumn("error", error_expr(c("y_true").cast("double"), c("prob_used")))


def misclassification_summary(long: DataFrame, prob_variant: str = "raw", fp_prob: float = 0.9,
                              fn_prob: float = 0.1, error_thr: float = 0.9) -> DataFrame:
    """Per outcome: n, pos, pos_rate, confident FP / FN counts and high-error count."""
    y, p = c("y_true").cast("double"), c("prob_used")
    return long.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y == 1.0).cast("long")).alias("pos"),
        F.avg(F.coalesce((y == 1.0).cast("double"), F.lit(0.0))).alias("pos_rate"),
        F.sum(((y == 0.0) & (p >= fp_prob)).cast("long")).alias("n_fp"),
        F.sum(((y == 1.0) & (p <= fn_prob)).cast("long")).alias("n_fn"),
        F.sum((c("error") >= error_thr).cast("long")).alias("n_high_error"),
    ).withColumn("prob_variant", F.lit(prob_variant))


def high_error_rows(long: DataFrame, error_thr: float = 0.9, id_col: str = "row_index") -> DataFrame:
    """Rows with error >= threshold, typed FN_like / FP_like, ordered by outcome, error desc, id."""
    bad = long.filter(c("error") >= error_thr)
    return bad.withColumn("bad_type", F.when(c("y_true") == 1.0, F.lit("FN_like")).otherwise(F.lit("FP_like"))) \
        .orderBy("outcome", F.desc("error"), id_col)


def predictions_wide(long: DataFrame, prob_variant: str = "raw", id_col: str = "row_index",
                     outcomes: Sequence[str] | None = None) -> DataFrame:
    """One row per id, per outcome ``{o}_fold, {o}_y_true, {o}_prob, {o}_prob_calibrated``.

    Equivalent to chained full outer joins across outcomes, done as one pivot
    (one shuffle on the id).  Duplicate (id, outcome) rows: the lowest fold's
    fold/label, mean probabilities.  Only for two or more outcomes; naming them saves a pass.
    """
    if outcomes is None:
        outcomes = [r["outcome"] for r in long.select("outcome").distinct().collect()]  # outcome names only
    outcomes = sorted(outcomes)
    if len(outcomes) < 2:
        raise ValueError("predictions_wide needs at least two outcomes")
    has_cal = "prob_calibrated" in long.columns
    aggs = [F.min_by("fold", F.struct("fold", "y_true")).alias("fold"),
            F.min_by("y_true", F.struct("fold", "y_true")).alias("y_true"),
            F.avg("prob").alias("prob")]
    if has_cal:
        aggs.append(F.avg("prob_calibrated").alias("prob_calibrated"))
    wide = long.groupBy(id_col).pivot("outcome", outcomes).agg(*aggs)
    names = ["fold", "y_true", "prob"] + (["prob_calibrated"] if has_cal else [])
    cols = [c(id_col)]
    for o in outcomes:
        cols += [c(f"{o}_{n}").alias(f"{o}_{n}") for n in names]
    return wide.select(*cols, F.lit(prob_variant).alias("prob_variant"))


# ---------------------------------------------------------------- high-confidence error profiles

def _group(outcome: str, prob_variant: str, fn_prob: float) -> Column:
    y = c(f"{outcome}_y_true").cast("double")
    p = c(score_column(outcome, prob_variant)).cast("double")
    return F.when((y == 1.0) & (p <= fn_prob), "HC_FN").when(y == 1.0, "OTHER_POS").when(y == 0.0, "NEG")


def high_confidence_rows(wide: DataFrame, context: DataFrame, outcomes: Sequence[str] = JOINT_OUTCOMES,
                         prob_variant: str = "raw", fp_prob: float = 0.9, fn_prob: float = 0.1,
                         id_col: str = "row_index", context_id: str = "row_id",
                         context_cols: Sequence[str] | None = None) -> DataFrame:
    """Per outcome HC_FN (y=1, p<=fn_prob) and HC_FP (y=0, p>=fp_prob) rows with context columns."""
    parts = []
    for o in outcomes:
        y = c(f"{o}_y_true").cast("double")
        p = c(score_column(o, prob_variant)).cast("double")
        tag = F.when((y == 1.0) & (p <= fn_prob), F.lit("HC_FN")).when((y == 0.0) & (p >= fp_prob), F.lit("HC_FP"))
        parts.append(wide.select(F.lit(o).alias("outcome"), tag.alias("tag"), c(id_col).alias(id_col),
                                 y.alias("y_true"), p.alias("prob")).filter(c("tag").isNotNull()))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    keep = list(context_cols) if context_cols is not None else [n for n in context.columns if n != context_id]
    ctx = context.select(c(context_id).alias("_cid"), *[c(n) for n in keep])
    return rows.join(ctx, rows[id_col] == ctx["_cid"], "left").drop("_cid")


def error_group_numeric_profile(wide: DataFrame, context: DataFrame, columns: Sequence[str],
                                outcomes: Sequence[str] = JOINT_OUTCOMES, prob_variant: str = "raw",
                                fn_prob: float = 0.1, id_col: str = "row_index",
                                context_id: str = "row_id", approx: bool = False) -> DataFrame:
    """Per outcome, group (HC_FN / OTHER_POS / NEG) and numeric column: n, missing, mean, median, p10, p90.

    Text values are coerced with ``try_cast``.  Rows meet their context once, by id; groups, columns
    and values are unfolded after that join.
    """
    cells = [F.struct(F.lit(n).alias("column"), F.nanvl(c(n).try_cast("double"), F.lit(None).cast("double")).alias("v")) for n in columns]
    j = _members(wide, context, columns, outcomes, prob_variant, fn_prob, id_col, context_id).select("outcome", "group", F.inline(F.array(*cells)))
    keys = ["outcome", "group", "column"]
    qs = [("median", 0.5), ("p10", 0.1), ("p90", 0.9)]
    stats = j.groupBy(*keys).agg(
        F.count("v").alias("n"), F.count_if(c("v").isNull()).alias("missing"), F.avg("v").alias("mean"),
        *([F.percentile_approx("v", [q for _, q in qs], 100000).alias("quantiles")] if approx else []))
    if not approx:
        stats = stats.join(exact_quantiles(j, keys, "v", [q for _, q in qs]), keys, "left")
    return stats.select(*keys, "n", "missing", "mean", *[F.get("quantiles", F.lit(i)).cast("double").alias(name) for i, (name, _) in enumerate(qs)])


def _members(wide, context, columns, outcomes, prob_variant, fn_prob, id_col, context_id) -> DataFrame:
    """(outcome, group, context columns): one row per row and outcome that has a group, after one join on the id."""
    ctx = context.select(c(context_id).alias("_cid"), *[c(n) for n in dict.fromkeys(columns)])
    both = wide.join(ctx, c(id_col) == c("_cid"), "inner")
    tags = F.array(*[F.struct(F.lit(o).alias("outcome"), _group(o, prob_variant, fn_prob).alias("group")) for o in outcomes])
    return both.select(*[c(n) for n in dict.fromkeys(columns)], F.inline(tags)).filter(c("group").isNotNull())


def error_group_categorical_profile(wide: DataFrame, context: DataFrame, columns: Sequence[str],
                                    outcomes: Sequence[str] = JOINT_OUTCOMES, prob_variant: str = "raw",
                                    fn_prob: float = 0.1, id_col: str = "row_index",
                                    context_id: str = "row_id") -> DataFrame:
    """Per outcome, group, column and level (NULL kept): n and pct of the group's rows."""
    cells = [F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value")) for n in columns]
    j = _members(wide, context, columns, outcomes, prob_variant, fn_prob, id_col, context_id).select("outcome", "group", F.inline(F.array(*cells)))
    counts = j.groupBy("outcome", "group", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    # every row of a group has one value per column, so a column's counts add up to the group's size
    size = F.sum("n").over(Window.partitionBy("outcome", "group", "column"))
    return counts.select("outcome", "group", "column", "value", "n", (c("n") / size).alias("pct"))


# ---------------------------------------------------------------- review / pruning candidates

def _candidate_corrections(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within the ranked candidates: pair credit of each candidate with earlier, opposite-class candidates.

    Runs on the bounded candidate set (at most ``limit`` rows).  O(m log m)
    with a Fenwick tree over score ranks, no pair enumeration.
    """
    pdf = pdf.sort_values("k").reset_index(drop=True)
    m = len(pdf)
    scores = np.sort(pdf["score"].unique())
    ranks = np.searchsorted(scores, pdf["score"].to_numpy()) + 1
    size = len(scores)
    tree = {0.0: np.zeros(size + 1), 1.0: np.zeros(size + 1)}

    def add(t, i):
        while i <= size:
            t[i] += 1
            i += i & (-i)

    def prefix(t, i):
        s = 0.0
        while i > 0:
            s += t[i]
            i -= i & (-i)
        return s

    corr = np.zeros(m)
    ys = pdf["y"].to_numpy()
    for i in range(m):
        r, yv = int(ranks[i]), float(ys[i])
        if yv == 1.0:  # earlier negatives with lower score count 1, equal 0.5
            t = tree[0.0]
            lower, upto = prefix(t, r - 1), prefix(t, r)
            corr[i] = lower + 0.5 * (upto - lower)
        else:  # earlier positives with higher score count 1, equal 0.5
            t = tree[1.0]
            total, upto, lower = prefix(t, size), prefix(t, r), prefix(t, r - 1)
            corr[i] = (total - upto) + 0.5 * (upto - lower)
        add(tree[yv], r)
    return pdf.assign(corr=corr)


def greedy_prune_curve(preds: DataFrame, target_auc: float = 0.8, limit: int = 400, id_col: str = "row_index",
                       y: str = "y_true", score: str = "prob") -> DataFrame:
    """Rows ranked by error (desc, id asc) and the AUROC left after dropping the first k.

    Returns the first k* rows, where k* is the first k with AUROC >= target
    (or ``limit``), with columns k, id, y_true, prob, error, auc_after.  Empty
    when the full AUROC already meets the target.

    AUROC(k) has a closed form because the order is fixed: the full
    U-statistic minus each dropped row's pair credit against all rows (an
    equi-join of the <= limit candidates on score against per-score cumulative
    counts), plus the credit of pairs dropped at both ends (computed on the
    bounded candidate set).  No loop over the data and no pair enumeration.
    """
    valid = preds.filter(c(y).isNotNull() & c(score).isNotNull()).select(
        c(id_col).alias("_id"), c(y).cast("double").alias("y"), c(score).cast("double").alias("score"),
        F.lit(0).alias("_g"))
    rank = [F.desc("error"), c("_id")]
    # bounded top-k: per-partition partial sort, then a merge of at most `limit` rows per partition
    cand = valid.withColumn("error", error_expr(c("y"), c("score"))).orderBy(*rank).limit(limit) \
        .withColumn("k", F.row_number().over(Window.orderBy(*rank)))
    counts = score_counts(valid, ["_g"], "y", "score")
    cum = cumulative_below(counts, ["_g"], ["pos", "neg"])
    tot = cum.groupBy("_g").agg(F.sum(c("pos") * (c("neg_below") + c("neg") * 0.5)).alias("U"))
    u = tot.first()  # one number
    cw = cand.join(cum.select("score", "pos", "neg", "pos_below", "neg_below", c("pos_total").alias("P"),
                              c("neg_total").alias("N")), "score", "inner") \
        .withColumn("U", F.lit(float(u["U"]) if u and u["U"] is not None else 0.0))
    # credit of a positive: negatives below (+ half the tied); of a negative: positives above (+ half the tied)
    cw = cw.withColumn("w", F.when(c("y") == 1.0, c("neg_below") + c("neg") * 0.5)
                       .otherwise(c("P") - c("pos_below") - c("pos") * 0.5))
    corr = cw.select("_g", "k", "_id", "y", "score", "error", "w", "P", "N", "U").groupBy("_g").applyInPandas(
        _candidate_corrections,
        f"_g int, k int, _id {dict(valid.dtypes)['_id']}, y double, score double, error double, w double, P long, N long, U double, "
        "corr double")
    w_run = Window.partitionBy("_g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    curve = corr.select(
        "k", "_id", "y", "score", "error", "P", "N", "U",
        F.sum("w").over(w_run).alias("_w"), F.sum("corr").over(w_run).alias("_c"),
        F.sum((c("y") == 1.0).cast("long")).over(w_run).alias("_dp"),
        F.sum((c("y") != 1.0).cast("long")).over(w_run).alias("_dn"))
    pk, nk = c("P") - c("_dp"), c("N") - c("_dn")
    curve = curve.withColumn("auc_after", F.when((pk > 0) & (nk > 0), (c("U") - c("_w") + c("_c")) / (pk * nk)))
    auc0 = F.when((c("P") > 0) & (c("N") > 0), c("U") / (c("P") * c("N")))
    w_all = Window.partitionBy("P")
    k_star = F.min(F.when(c("auc_after") >= target_auc, c("k"))).over(w_all)
    out = curve.withColumn("_kstar", F.coalesce(k_star, F.lit(limit))).filter(
        (auc0 < target_auc) & (c("k") <= c("_kstar")))
    return out.select("k", c("_id").alias(id_col), c("y").alias(y), c("score").alias(score), "error", "auc_after")


def per_class_tail_prune(preds: DataFrame, already_dropped: DataFrame | None = None, drop_per_iter: int = 20,
                         q: float = 0.95, id_col: str = "row_index", y: str = "y_true",
                         score: str = "prob") -> DataFrame:
    """Per class, rows with error above the class's q-quantile (strict), top max(1, drop_per_iter//2) by error."""
    df = preds.select(c(id_col).alias(id_col), c(y).cast("double").alias(y), c(score).cast("double").alias(score))
    if already_dropped is not None:
        df = df.join(already_dropped.select(c(id_col)), id_col, "left_anti")
    df = df.filter(c(y).isin(0.0, 1.0)).withColumn("error", error_expr(c(y), c(score)))
    thr = exact_quantiles(df, [y], "error", [q]).select(c(y), F.get("quantiles", F.lit(0)).alias("_thr"))
    k = max(1, drop_per_iter // 2)
    w = Window.partitionBy(y).orderBy(F.desc("error"), c(id_col))
    return df.join(thr, y, "inner").filter(c("error") > c("_thr")) \
        .withColumn("rank", F.row_number().over(w)).filter(c("rank") <= k).drop("_thr")


def drop_rows(df: DataFrame, dropped: DataFrame, id_col: str = "row_id", dropped_id: str = "row_index") -> DataFrame:
    """Remove the listed ids (unknown ids ignored)."""
    ids = dropped.select(c(dropped_id).alias(id_col)).distinct()
    return df.join(ids, id_col, "left_anti")
