"""Stratified folds, hyper-parameter search and nested cross-validation.

Folds are a column, never separate datasets.  Searches of the linear families
(elastic net, splines, additive bins without pair terms) solve all fits (outer
folds x inner folds x candidates) together, see ``batchfit``: each iteration is one
pass over the rows for all of them.

The boosted trees of a search are grown by tasks of one fit each, see ``treefit``, as long as the
rows' codes can be sent to every task.

For the others the driver loops over folds and candidates (each is one
Spark ML fit); all data work stays in Spark jobs.  Candidate fits of one fold are
submitted from a small thread pool so Spark can run them concurrently, and the
preprocessor, which has no searched parameter (except the additive model's bin
count), is fitted once per (outer, inner) fold and shared by every candidate.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from functools import reduce
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colref import c
from ..session import remove_scratch, scratch_path
from . import treefit
from .batchfit import Batch
from .calibrate import calibrates, fit_calibrator, fit_calibrators
from .metrics import METRIC_COLUMNS, fold_metrics_both, rank_metrics
from .models import MAX_BINS, build_model, fit_features, is_balanced, prob_of_one

# ---------------------------------------------------------------- G1 stratified folds


def class_ranks(df: DataFrame, label: str, seed: int = 42, id_col: str = "row_id", out: str = "_rank", prefix_hex: int = 4) -> DataFrame:
    """Number rows of each class from 1 in the order of md5(seed|id) (ties by id), equal in Spark and DuckDB.

    The rank is computed in two levels so no single task sees a whole class: counts per (class, hash
    prefix) get a running offset (a table of classes x 16^prefix rows), and row_number runs inside
    each (class, prefix) partition.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), c(id_col).cast("string")))
    with_h = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, prefix_hex))
    counts = with_h.groupBy(c(label).alias("_cls"), "_b").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy("_cls").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_cls", "_b", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(c(label), "_b").orderBy("_h", c(id_col))
    ranked = with_h.withColumn("_rn", F.row_number().over(w_in))
    j = ranked.join(offsets, (ranked[label].eqNullSafe(offsets["_cls"])) & (ranked["_b"] == offsets["_b"]), "inner")
    return j.withColumn(out, c("_off") + c("_rn")).drop("_h", "_b", "_rn", "_cls", "_off").drop(offsets["_b"])


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int = 42, id_col: str = "row_id",
                     fold_col: str = "fold", prefix_hex: int = 4) -> DataFrame:
    """Assign fold 1..k so that per-class counts differ by at most one across folds: (rank within class - 1) % k + 1."""
    ranked = class_ranks(df, label, seed, id_col, "_rank", prefix_hex)
    return ranked.withColumn(fold_col, ((c("_rank") - 1) % k + 1).cast("int")).drop("_rank")


def rank_without_fold(rank: Column, fold: int, k: int) -> Column:
    """The rank that a row of another fold has among the rows outside ``fold``: those of it up to this rank are left out."""
    return rank - F.floor((rank - F.lit(fold) + k) / k).cast("long")


# ---------------------------------------------------------------- candidates (G2 / G3)

def space_size(space: Mapping[str, Sequence]) -> int:
    return math.prod(len(v) if isinstance(v, (list, tuple)) else 1 for v in space.values())


def grid_candidates(space: Mapping[str, Sequence]) -> list[dict]:
    keys = list(space.keys())
    vals = [v if isinstance(v, (list, tuple)) else [v] for v in space.values()]
    return [dict(zip(keys, combo)) for combo in itertools.product(*vals)]


def random_candidates(space: Mapping[str, Sequence], n_iter: int, seed: int = 42) -> list[dict]:
    grid = grid_candidates(space)
    rng = np.random.default_rng(seed)
    idx = rng.choice(len(grid), size=min(n_iter, len(grid)), replace=False)
    return [grid[i] for i in sorted(idx)]


def candidates_for(space: Mapping[str, Sequence], n_iter: int, seed: int = 42) -> list[dict]:
    """Full grid when n_iter covers the space, else a seeded sample without replacement."""
    if not space:
        return [{}]
    size = space_size(space)
    return grid_candidates(space) if n_iter >= size else random_candidates(space, n_iter, seed)


# ---------------------------------------------------------------- modelling table helpers

def with_balanced_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """w_c = n / (2 n_c) on exactly the rows given.

    The class counts (two rows for a binary outcome) are counted here and go into the plan as numbers: a join
    on the label would gather all rows of a class in one task.
    """
    counts = {r["_cls"]: r["_nc"] for r in df.groupBy(c(label).alias("_cls")).agg(F.count(F.lit(1)).alias("_nc")).collect()}
    weight = F.lit(None).cast("double")
    for cls, n in counts.items():
        if cls is not None:
            weight = F.when(c(label) == F.lit(cls), F.lit(sum(counts.values()) / (len(counts) * n))).otherwise(weight)
    return df.filter(c(label).isNotNull()).withColumn(out, weight)


FIT_PARTITION_BYTES = 64 << 20


def fit_partitions(df: DataFrame, n_rows: int) -> DataFrame:
    """Even partitions of a table of vectors for iterative fits, of about 64 MB each and as many as that takes.

    Every solver iteration is one job over all of them, so a small table is one task and a large one
    is spread without a cap.  The width of the vectors is known from their metadata.
    """
    width = df.schema["features"].metadata.get("ml_attr", {}).get("num_attrs", 1)
    return df.repartition(max(1, -(-int(n_rows) * width * 8 // FIT_PARTITION_BYTES)))


def _pre_key(kind: str, params: Mapping) -> str:
    return json.dumps({k: params.get(k) for k in ("max_bins", "n_knots", "interactions")}
                      if kind in ("glassbox_additive", "gam_spline") else {})


def _fit_vectors(kind: str, params: Mapping, train: DataFrame, valid: DataFrame, cat_cols, num_cols, min_freq):
    pre = fit_features(kind, cat_cols, num_cols, train, params, min_freq)
    tv = pre.transform(train).select("_id", "label", "weight", "features")
    tv = fit_partitions(tv, train.count()).persist(StorageLevel.MEMORY_AND_DISK)
    vv = pre.transform(valid).select("_id", "label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    return pre, tv, vv


def search(train: DataFrame, kind: str, space: Mapping[str, Sequence], cat_cols, num_cols, inner: int = 3,
           n_iter: int = 50, seed: int = 42, min_freq: float = 0.01, parallelism: int = 4):
    """Mean inner-fold AUROC of every candidate; returns (best params, [(params, mean auc)]).

    ``train`` has columns _id, label, weight (balanced on the full train set is
    recomputed per inner fold) and the raw feature columns.
    """
    cands = candidates_for(space, n_iter, seed)
    folded = stratified_folds(train, "label", inner, seed, "_id", "_fin").persist(StorageLevel.MEMORY_AND_DISK)
    if in_batches(kind, cands):
        batch, fits = _fold_fits(folded, kind, cands, cat_cols, num_cols, inner, min_freq)
        means = [(p, m) for p, m in zip(cands, _mean_auc(batch.held_aucs(fits, [(-1, f) for f in range(inner)], len(cands)), inner, len(cands))[0])]
        batch.discard()
        folded.unpersist()
        return _best(means), means
    if kind == "boosted_trees" and (aucs := treefit.fits(folded, cands, cat_cols, num_cols, inner, seed, min_freq)) is not None:
        means = list(zip(cands, _mean_auc(aucs, inner, len(cands))[0], strict=True))
        folded.unpersist()
        return _best(means), means
    scores = {i: [] for i in range(len(cands))}
    by_pre: dict[str, list[int]] = {}
    for i, p in enumerate(cands):
        by_pre.setdefault(_pre_key(kind, p), []).append(i)
    for f in range(1, inner + 1):
        tr = with_balanced_weight(folded.filter(c("_fin") != f).drop("weight"))
        va = folded.filter(c("_fin") == f)
        for _, idxs in by_pre.items():
            _, tv, vv = _fit_vectors(kind, cands[idxs[0]], tr, va, cat_cols, num_cols, min_freq)
            weight = "weight" if is_balanced(kind) else None
            n_w = float(tv.count())  # balanced weights sum to the number of rows

            def run(i, tv=tv, n_w=n_w, weight=weight):
                return i, build_model(kind, cands[i], n_w, seed, weight_col=weight).fit(tv)

            with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
                fitted = list(ex.map(run, idxs))
            # all candidates of this fold are scored in one grouped AUROC job (one row per candidate back)
            preds = None
            for i, m in fitted:
                p = m.transform(vv).select(F.lit(i).alias("_cand"), "label",
                                           prob_of_one(c("probability")).alias("prob"))
                preds = p if preds is None else preds.unionByName(p)
            for r in rank_metrics(preds, ["_cand"], "label", "prob").collect():
                scores[r["_cand"]].append(r["roc_auc"])
            tv.unpersist()
            vv.unpersist()
    means = [(cands[i], float(np.mean([s for s in scores[i] if s is not None])) if any(
        s is not None for s in scores[i]) else float("nan")) for i in range(len(cands))]
    folded.unpersist()
    return _best(means), means


def _best(means: Sequence[tuple[dict, float]]) -> dict:
    """The candidate with the highest mean AUROC, the earliest of equals."""
    return max(means, key=lambda m: np.nan_to_num(m[1], nan=-1.0))[0]


def in_batches(kind: str, cands: Sequence[Mapping]) -> bool:
    """Whether a family's fits are solved together: all linear ones, the additive model without pair terms."""
    return kind in ("elasticnet", "gam_spline") or (kind == "glassbox_additive" and not any(int(p.get("interactions", 0)) for p in cands))


def batch_fits(batch: Batch, kind: str, wanted: Sequence[tuple[int, Mapping]]) -> list:
    """The fits of (set, candidate) of one family."""
    if kind == "elasticnet":
        return batch.fit([(t, *_penalty(p)) for t, p in wanted])
    basis = (lambda p: int(p.get("n_knots", 10))) if kind == "gam_spline" else (lambda p: int(p.get("max_bins", MAX_BINS)))
    make = batch.splined if kind == "gam_spline" else batch.binned
    designs = {k: make(k) for k in {basis(p) for _, p in wanted}}
    # the spline model's penalty is fixed, as in ``models.build_model``
    return batch.fit_designs([(designs[basis(p)][t], 1.0 if kind == "gam_spline" else float(p.get("C", 1.0))) for t, p in wanted], is_balanced(kind))


def _fold_fits(folded: DataFrame, kind: str, cands: Sequence[Mapping], cat_cols, num_cols, inner: int, min_freq: float) -> tuple[Batch, list]:
    """The fits of every candidate on the rows outside each fold ``_fin``, fold by fold."""
    times = F.array(*[(c("_fin") != f).cast("tinyint") for f in range(1, inner + 1)])
    batch = Batch.prepare(folded, cat_cols, num_cols, times, inner, min_freq)
    return batch, batch_fits(batch, kind, [(f, p) for f in range(inner) for p in cands])


def _penalty(params: Mapping) -> tuple[float, float]:
    return float(params.get("C", 1.0)), float(params.get("l1_ratio", 0.5))


def _mean_auc(aucs: Mapping[int, float | None], inner: int, n_cands: int) -> list[list[float]]:
    """Mean AUROC over the inner folds by outer fold and candidate; fits run by outer fold, inner fold, candidate."""
    out = []
    for lo in range(0, len(aucs), inner * n_cands):
        own = [[aucs[lo + i * n_cands + k] for i in range(inner)] for k in range(n_cands)]
        out.append([float(np.mean([a for a in x if a is not None])) if any(a is not None for a in x) else float("nan") for x in own])
    return out


def choose(train: DataFrame, kind: str, space: Mapping[str, Sequence], *args) -> dict:
    """The best candidate of a space; a space of one needs no search."""
    if space_size(space or {}) == 1:
        return grid_candidates(space)[0] if space else {}
    return search(train, kind, space, *args)[0]


def fit_pipeline(train: DataFrame, kind: str, params: Mapping, cat_cols, num_cols, seed: int = 42,
                 min_freq: float = 0.01) -> PipelineModel:
    """Preprocessor + model refitted on all given rows (balanced weights on those rows).

    The weighted training table is persisted for the several fit jobs; this
    also keeps query planning cheap when the input carries a long rule lineage.
    """
    tr = with_balanced_weight(train.drop("weight") if "weight" in train.columns else train) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    pre = fit_features(kind, cat_cols, num_cols, tr, params, min_freq)
    n_rows = tr.count()
    vec = fit_partitions(pre.transform(tr).select("label", "weight", "features"), n_rows).persist(StorageLevel.MEMORY_AND_DISK)
    # balanced weights sum to the number of rows
    model = build_model(kind, params, float(n_rows), seed, weight_col="weight" if is_balanced(kind) else None).fit(vec)
    vec.unpersist()
    tr.unpersist()
    return PipelineModel(stages=[pre, model])


def oof_predict(train: DataFrame, kind: str, params: Mapping, cat_cols, num_cols, inner: int = 3, seed: int = 42,
                min_freq: float = 0.01) -> DataFrame:
    """Inner-fold out-of-fold probabilities (_id, label, prob) of a fixed estimator, written to the shared folder."""
    folded = stratified_folds(train, "label", inner, seed, "_id", "_fin").persist(StorageLevel.MEMORY_AND_DISK)
    if in_batches(kind, [params]):
        batch, fits = _fold_fits(folded, kind, [params], cat_cols, num_cols, inner, min_freq)
        path = scratch_path(train.sparkSession, "oof")
        batch.score(folded, fits, ["_id", "label"], F.array((c("_fin") - 1).cast("int")), 1).select("_id", "label", "prob").write.parquet(path)
        batch.discard()
        folded.unpersist()
        return train.sparkSession.read.parquet(path)

    def held_out(f: int) -> DataFrame:
        pm = fit_pipeline(folded.filter(c("_fin") != f), kind, params, cat_cols, num_cols, seed, min_freq)
        return (pm.transform(folded.filter(c("_fin") == f))
                .select("_id", "label", prob_of_one(c("probability")).alias("prob")))

    with ThreadPoolExecutor(max_workers=max(1, inner)) as pool:  # the folds' fits are independent
        parts = list(pool.map(held_out, range(1, inner + 1)))
    path = scratch_path(train.sparkSession, "oof")
    reduce(DataFrame.unionByName, parts).write.parquet(path)
    folded.unpersist()
    return train.sparkSession.read.parquet(path)


@dataclass
class NestedResult:
    predictions: DataFrame
    fold_metrics: DataFrame
    best_params: list = field(default_factory=list)


def nested_cv(df: DataFrame, y: str, cat_cols: Sequence[str], num_cols: Sequence[str], kind: str,
              space: Mapping[str, Sequence], outer: int = 5, inner: int = 3, n_iter: int = 50, seed: int = 42,
              recalibration: str | None = "intercept_slope", id_col: str = "row_id", min_freq: float = 0.01,
              parallelism: int = 4, checkpoint: bool = True, shared: NestedRows | None = None) -> NestedResult:
    """Outer folds: search on train, score test, calibrate on train OOF, apply to test.

    ``shared`` keeps the ranked and packed rows for calls with the same table, outcome, columns and folds.

    Predictions (fold, row_index, y_true, prob, prob_calibrated) are written to
    the shared checkpoint folder, which cuts the lineage of the per-fold models
    and lets later metric jobs survive executor loss.
    """
    calibrates(recalibration)  # an unknown name fails before any fit
    base = df.filter(c(y).isNotNull()).select(
        c(id_col).alias("_id"), c(y).cast("double").alias("label"), *[c(n) for n in list(cat_cols) + list(num_cols)])
    if in_batches(kind, candidates_for(space, n_iter, seed)):
        out, best = _nested_batches(base, kind, candidates_for(space, n_iter, seed), cat_cols, num_cols, outer, inner, seed, recalibration, min_freq, shared)
        return NestedResult(out, fold_metrics_both(out, ["fold"]), best)
    folded = stratified_folds(base, "label", outer, seed, "_id", "_fout").persist(StorageLevel.MEMORY_AND_DISK)

    def one_fold(f: int) -> tuple[DataFrame, dict]:
        train = folded.filter(c("_fout") != f).drop("_fout")
        test = folded.filter(c("_fout") == f).drop("_fout")
        params = choose(train, kind, space, cat_cols, num_cols, inner, n_iter, seed, min_freq, parallelism)
        pm = fit_pipeline(train, kind, params, cat_cols, num_cols, seed, min_freq)
        scored = pm.transform(test).select("_id", "label", prob_of_one(c("probability")).alias("prob"))
        oof = oof_predict(train, kind, params, cat_cols, num_cols, inner, seed, min_freq) if calibrates(recalibration) else None
        scored = fit_calibrator(recalibration, oof, "label", "prob").transform(scored, "prob", "prob_calibrated")
        return scored.select(F.lit(f).alias("fold"), c("_id").alias("row_index"), c("label").alias("y_true"), "prob", "prob_calibrated"), params

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:  # outer folds are independent
        done = list(pool.map(one_fold, range(1, outer + 1)))
    preds, best = [d for d, _ in done], [p for _, p in done]
    out = reduce(DataFrame.unionByName, preds)
    if checkpoint:
        path = scratch_path(df.sparkSession, "nested-predictions")
        out.write.parquet(path)
        out = df.sparkSession.read.parquet(path)
        folded.unpersist()
    fm = fold_metrics_both(out, ["fold"])
    return NestedResult(out, fm, best)


@dataclass
class NestedRows:
    """The rows of nested folds, ranked and packed once for all families."""

    rows: DataFrame | None = None
    batch: Batch | None = None
    path: str = ""

    def prepare(self, base: DataFrame, cat_cols, num_cols, outer: int, inner: int, seed: int, min_freq: float) -> None:
        """The inner folds of every outer fold follow from a row's rank in its class, so one ranking gives all sets: the
        rows outside each outer fold, and those without each of its inner folds."""
        spark = base.sparkSession
        self.path = scratch_path(spark, "nested-rows")
        class_ranks(base, "label", seed, "_id").write.parquet(self.path)
        rows = spark.read.parquet(self.path).withColumn("_fout", ((c("_rank") - 1) % outer + 1).cast("int"))
        own = range(1, outer + 1)
        self.rows = rows.withColumns({f"_in{f}": F.when(c("_fout") != f, ((rank_without_fold(c("_rank"), f, outer) - 1) % inner + 1).cast("int")) for f in own})
        outside = [(c("_fout") != f).cast("tinyint") for f in own]
        without = [F.coalesce((c(f"_in{f}") != i).cast("tinyint"), F.lit(0).cast("tinyint")) for f in own for i in range(1, inner + 1)]
        self.batch = Batch.prepare(self.rows, cat_cols, num_cols, F.array(*outside, *without), outer * (1 + inner), min_freq)

    def discard(self) -> None:
        if self.batch is not None:
            self.batch.discard()
            remove_scratch(self.rows.sparkSession, self.path)


def _nested_batches(base: DataFrame, kind: str, cands: Sequence[dict], cat_cols, num_cols, outer: int, inner: int, seed: int, recalibration: str | None,
                       min_freq: float, shared: NestedRows | None = None) -> tuple[DataFrame, list[dict]]:
    """Nested cross-validation in two rounds of fits: all inner fits of all outer folds, then the outer ones.

    The inner fits of a chosen candidate give its out-of-fold predictions.
    """
    spark = base.sparkSession
    nested = shared or NestedRows()
    if nested.batch is None:
        nested.prepare(base, cat_cols, num_cols, outer, inner, seed, min_freq)
    rows, batch, own = nested.rows, nested.batch, range(1, outer + 1)
    held = F.array_compact(F.array(*[(c(f"_in{f}") - 1 + (f - 1) * inner).cast("int") for f in own]))  # the inner sets that a row is held out of
    n = len(cands)
    fits, best = None, [0] * outer
    if n > 1 or calibrates(recalibration):
        fits = batch_fits(batch, kind, [(outer + g, p) for g in range(outer * inner) for p in cands])
    if n > 1:
        means = _mean_auc(batch.held_aucs(fits, [(g // inner, outer + g) for g in range(outer * inner)], n), inner, n)
        best = [max(range(n), key=lambda k, own=own: np.nan_to_num(own[k], nan=-1.0)) for own in means]
    chosen = batch_fits(batch, kind, [(f, cands[best[f]]) for f in range(outer)])
    groups = F.array((c("_fout") - 1).cast("int"))
    if fits is not None:
        chosen += [fits[g * n + best[g // inner]] for g in range(outer * inner)]
        groups = F.concat(groups, F.transform(held, lambda g: g + outer))
    scored_path = scratch_path(spark, "nested-scores")
    batch.score(rows, chosen, ["_id", "label", "_fout"], groups, 1).write.parquet(scored_path)
    scored = spark.read.parquet(scored_path)
    oof = scored.filter(c("_group") >= outer).select((F.floor((c("_group") - outer) / inner) + 1).cast("int").alias("fold"), "label", "prob")
    cals = fit_calibrators(recalibration, oof, "fold", list(own), "label", "prob")
    test = scored.filter(c("_group") < outer)
    parts = [cals[f].transform(test.filter(c("_fout") == f), "prob", "prob_calibrated") for f in own]
    out = reduce(DataFrame.unionByName, parts).select(c("_fout").alias("fold"), c("_id").alias("row_index"), c("label").alias("y_true"), "prob", "prob_calibrated")
    out_path = scratch_path(spark, "nested-predictions")
    out.write.parquet(out_path)
    if shared is None:
        nested.discard()
    remove_scratch(spark, scored_path)
    return spark.read.parquet(out_path), [cands[k] for k in best]


def run_experiment(df: DataFrame, outcomes: Sequence[str], feature_sets: Mapping[str, Sequence[str]],
                   models: Mapping[str, Mapping[str, Sequence]], leakage_block: Mapping[str, Sequence[str]] | None = None,
                   outer: int = 5, inner: int = 3, n_iter: int = 50, seed: int = 42, id_col: str = "row_id",
                   recalibration: str | None = "intercept_slope", y_prefix: str = "y_") -> tuple[DataFrame, DataFrame]:
    """outcomes x feature sets x models -> (fold metrics long table, predictions long table) with keys."""
    from ..sources.schema import drop_leakage, outcome_base, split_columns

    leakage_block = leakage_block or {}
    metric_parts, pred_parts = [], []
    for outcome in outcomes:
        for fs_name, cols in feature_sets.items():
            use = drop_leakage(cols, leakage_block.get(outcome_base(outcome), []))
            cat, num = split_columns(df, use)
            shared = NestedRows()
            for kind, space in models.items():
                res = nested_cv(df, y_prefix + outcome, cat, num, kind, space, outer, inner, n_iter, seed,
                                recalibration, id_col, shared=shared)
                keys = [F.lit(outcome).alias("outcome"), F.lit(fs_name).alias("featureset"), F.lit(kind).alias("model")]
                metric_parts.append(res.fold_metrics.select(*keys, "*"))
                pred_parts.append(res.predictions.select("*", *keys))
            shared.discard()
    m = metric_parts[0]
    for p in metric_parts[1:]:
        m = m.unionByName(p, allowMissingColumns=True)
    pr = pred_parts[0]
    for p in pred_parts[1:]:
        pr = pr.unionByName(p)
    return m, pr


__all__ = ["stratified_folds", "grid_candidates", "random_candidates", "candidates_for", "search", "oof_predict",
           "nested_cv", "run_experiment", "fit_pipeline", "with_balanced_weight", "METRIC_COLUMNS"]
