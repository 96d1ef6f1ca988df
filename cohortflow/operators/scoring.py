"""Final model fitting (per pick) and scoring of new tables with every saved model.

Artifacts live under ``models_root/tag/outcome/featureset/model/``:
``pipeline`` (Spark ML ``PipelineModel``), ``calibrator`` and ``meta``
(single-row Parquet tables).  Scoring is lazy: one scan, per model a ``transform`` plus a
calibration expression, then one row a model; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colref import c
from ..sources.schema import drop_leakage, ensure_columns, outcome_base, split_columns
from .calibrate import calibrates, fit_calibrator, load_calibrator, save_calibrator
from .models import prob_of_one
from .search import choose, fit_pipeline, oof_predict


def _model_dir(root: str, tag: str, outcome: str, featureset: str, model: str) -> str:
    return f"{root.rstrip('/')}/{tag}/{outcome}/{featureset}/{model}"


def fit_picks(df: DataFrame, picks: Sequence[Mapping], feature_sets: Mapping[str, Sequence[str]],
              spaces: Mapping[str, Mapping], models_root: str, tag: str = "final", inner: int = 3, n_iter: int = 50,
              seed: int = 42, id_col: str = "row_id", y_prefix: str = "y_",
              leakage_block: Mapping[str, Sequence[str]] | None = None, recalibration: str | None = "intercept_slope") -> DataFrame:
    """Per pick: inner-CV search on all labelled rows, refit, calibrator fitted on out-of-fold predictions, persist artifacts.

    ``recalibration``: intercept_slope, isotonic or none; a pick's own ``recalibration`` entry comes first.

    Returns the metadata table (one row per pick).
    """
    spark = df.sparkSession
    leakage_block = leakage_block or {}
    metas = []
    for pick in picks:
        outcome, fs, kind = pick["outcome"], pick["featureset"], pick["model"]
        wanted = pick.get("recalibration", recalibration)
        calibrates(wanted)  # an unknown name fails before any fit
        cols = drop_leakage(feature_sets[fs], leakage_block.get(outcome_base(outcome), []))
        blocked = [x for x in feature_sets[fs] if x not in cols]
        cat, num = split_columns(df, cols)
        base = df.filter(c(y_prefix + outcome).isNotNull()).select(
            c(id_col).alias("_id"), c(y_prefix + outcome).cast("double").alias("label"), *[c(n) for n in cols]) \
            .persist(StorageLevel.MEMORY_AND_DISK)
        space = spaces.get(kind, {})
        params = choose(base, kind, space, cat, num, inner, n_iter, seed)
        pm = fit_pipeline(base, kind, params, cat, num, seed)
        oof = oof_predict(base, kind, params, cat, num, inner, seed) if calibrates(wanted) else None
        cal = fit_calibrator(wanted, oof, "label", "prob")
        out = _model_dir(models_root, tag, outcome, fs, kind)
        pm.write().overwrite().save(f"{out}/pipeline")
        save_calibrator(cal, spark, f"{out}/calibrator")
        stats = base.agg(F.count(F.lit(1)).alias("n_train"), F.sum("label").alias("pos")).first()
        meta = spark.createDataFrame(
            [(tag, outcome, fs, kind, int(stats["n_train"]), float(stats["pos"] or 0.0),
              float((stats["pos"] or 0.0) / stats["n_train"]) if stats["n_train"] else None, cols, blocked,
              str(params), cal.method)],
            "tag string, outcome string, featureset string, model string, n_train long, pos double, "
            "pos_rate double, columns_used array<string>, leakage_blocked array<string>, best_params string, recalibration string")
        meta.write.mode("overwrite").parquet(f"{out}/meta")
        metas.append(meta)
        base.unpersist()
    res = metas[0]
    for m in metas[1:]:
        res = res.unionByName(m)
    return res


def list_models(spark: SparkSession, models_root: str) -> list[tuple[str, str, str, str]]:
    """(tag, outcome, featureset, model) of every saved model, listed in the root's own file system (bounded by model count)."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{models_root.rstrip('/')}/*/*/*/*/pipeline")
    found = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
    return sorted(tuple(str(x.getPath().toString()).split("/")[-5:-1]) for x in found or ())


def score_models(df: DataFrame, models_root: str, id_col: str = "row_id",
                 types: Mapping[str, str] | None = None) -> DataFrame:
    """Long scores (row_index, tag, outcome, featureset, model, prob, prob_calibrated) for every saved model.

    One scan of ``df`` serves all models: the raw columns travel beside the scores made so far, each model works on
    its own copies of those it needs, and the scores become rows at the end.
    """
    spark = df.sparkSession
    found = list_models(spark, models_root)
    if not found:
        raise ValueError(f"no saved models under {models_root}")
    saved = []
    for key in found:
        path = _model_dir(models_root, *key)
        saved.append((key, PipelineModel.load(f"{path}/pipeline"), list(spark.read.parquet(f"{path}/meta").first()["columns_used"]), load_calibrator(spark, f"{path}/calibrator")))
    needed = list(dict.fromkeys(n for _, _, columns, _ in saved for n in columns))
    wide = ensure_columns(df, [id_col, *needed], types)
    raw = {n: f"_raw{k}" for k, n in enumerate(needed)}
    carried = [c(id_col).alias("_id"), *[c(n).alias(r) for n, r in raw.items()]]
    wide = wide.select(*carried)
    done: list[str] = []
    for k, (_, pipeline, columns, cal) in enumerate(saved):
        kept = ["_id", *raw.values(), *done]
        own = wide.select(*kept, *[c(raw[n]).alias(n) for n in columns])
        scored = cal.transform(pipeline.transform(own).withColumn("prob", prob_of_one(c("probability"))), "prob", "prob_calibrated")
        done.append(f"_score{k}")
        wide = scored.select(*kept, F.struct("prob", c("prob_calibrated").cast("double").alias("prob_calibrated")).alias(done[-1]))
    names = ("tag", "outcome", "featureset", "model")
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, key, strict=True)], c(s)["prob"].alias("prob"), c(s)["prob_calibrated"].alias("prob_calibrated"))
            for (key, *_), s in zip(saved, done, strict=True)]
    return wide.select(c("_id").alias("row_index"), F.inline(F.array(*rows)))


__all__ = ["fit_picks", "score_models", "list_models", "split_columns"]
