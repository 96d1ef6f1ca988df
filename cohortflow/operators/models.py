"""Risk-model families as Spark ML estimators over an assembled ``features`` vector.

* ``elasticnet``  - balanced logistic regression with an L1/L2 mix.  sklearn's
  C-form objective  C * sum(w_i loss_i) + penalty  equals Spark's
  mean-loss form with ``regParam = 1 / (C * sum(w))`` (balanced weights sum to n).
* ``boosted_trees`` - ``GBTClassifier``, unweighted.  Differences to an xgboost booster:
  first-order fitting, no leaf L2, columns sampled per node not per tree.
* ``glassbox_additive`` - a binned generalised additive model: numeric columns are
  cut into quantile bins (plus a NULL bin), categorical levels are kept, all are
  one-hot encoded and fitted, unweighted, with L2 logistic regression; ``interactions``
  adds that many pairwise terms, for the pairs of coarse bins whose outcome rates
  depart most from what the two features give alone.  Same model class as a cyclic
  boosting EBM (a sum of per-feature and per-pair step functions) fitted by penalised
  likelihood instead of boosting.
* ``gam_spline`` - cubic B-spline basis + L2 balanced logistic regression.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Interaction, OneHotEncoder, QuantileDiscretizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colref import c
from .prep import MedianImputer, ModeImputer, ModeImputerModel, RareCategoryGrouper, fit_preprocessor, make_preprocessor

MODEL_KINDS = ("elasticnet", "boosted_trees", "glassbox_additive", "gam_spline")


def elasticnet(C: float = 1.0, l1_ratio: float = 0.5, weight_sum: float = 1.0, weight_col: str | None = "weight",
               max_iter: int = 2000, features_col: str = "features", label_col: str = "label",
               tol: float = 1e-4) -> LogisticRegression:
    """Each solver iteration is one distributed aggregation job; tol=1e-4 is sklearn's default tolerance."""
    kw = {"weightCol": weight_col} if weight_col else {}
    return LogisticRegression(featuresCol=features_col, labelCol=label_col, regParam=1.0 / (float(C) * weight_sum),
                              elasticNetParam=float(l1_ratio), standardization=False, maxIter=int(max_iter),
                              tol=float(tol), **kw)


def boosted_trees(n_estimators: int = 300, max_depth: int = 4, learning_rate: float = 0.1, subsample: float = 1.0,
                  colsample_bytree: float = 1.0, seed: int = 42, features_col: str = "features",
                  label_col: str = "label", weight_col: str | None = None) -> GBTClassifier:
    strategy = "all" if float(colsample_bytree) >= 1.0 else str(float(colsample_bytree))
    kw = {"weightCol": weight_col} if weight_col else {}
    return GBTClassifier(featuresCol=features_col, labelCol=label_col, maxIter=int(n_estimators),
                         maxDepth=int(max_depth), stepSize=float(learning_rate), subsamplingRate=float(subsample),
                         featureSubsetStrategy=strategy, seed=int(seed), **kw)


def gam_spline_model(weight_sum: float, weight_col: str | None = "weight", features_col: str = "features",
                     label_col: str = "label") -> LogisticRegression:
    return elasticnet(C=1.0, l1_ratio=0.0, weight_sum=weight_sum, weight_col=weight_col,
                      features_col=features_col, label_col=label_col)


def build_model(kind: str, params: Mapping, weight_sum: float, seed: int = 42, features_col: str = "features",
                label_col: str = "label", weight_col: str | None = "weight"):
    """Estimator over the features vector for one model family and one parameter combination."""
    if kind == "elasticnet":
        return elasticnet(params.get("C", 1.0), params.get("l1_ratio", 0.5), weight_sum, weight_col,
                          params.get("max_iter", 2000), features_col, label_col, params.get("tol", 1e-4))
    if kind == "boosted_trees":
        return boosted_trees(params.get("n_estimators", 300), params.get("max_depth", 4),
                             params.get("learning_rate", 0.1), params.get("subsample", 1.0),
                             params.get("colsample_bytree", 1.0), seed, features_col, label_col, weight_col)
    if kind == "gam_spline":
        return gam_spline_model(weight_sum, weight_col, features_col, label_col)
    if kind == "glassbox_additive":
        return elasticnet(params.get("C", 1.0), 0.0, weight_sum, weight_col, params.get("max_iter", 2000), features_col, label_col)
    raise ValueError(f"unknown model kind: {kind}")


def is_balanced(kind: str) -> bool:
    """Families fitted with class weights; the others keep the outcome's base rate in their probabilities."""
    return kind in ("elasticnet", "gam_spline")


def preprocessor_for(kind: str, cat_cols: Sequence[str], num_cols: Sequence[str], params: Mapping | None = None,
                     min_freq: float = 0.01, scale_numeric: bool = True) -> Pipeline:
    """Feature pipeline of a model family (the additive model bins instead of scaling)."""
    params = params or {}
    if kind == "gam_spline":
        return make_preprocessor(cat_cols, num_cols, min_freq, use_splines=True, n_knots=int(params.get("n_knots", 10)))
    if kind == "glassbox_additive":
        return additive_preprocessor(cat_cols, num_cols, int(params.get("max_bins", MAX_BINS)), min_freq)
    return make_preprocessor(cat_cols, num_cols, min_freq, scale_numeric=scale_numeric)


def fit_features(kind: str, cat_cols: Sequence[str], num_cols: Sequence[str], df: DataFrame,
                 params: Mapping | None = None, min_freq: float = 0.01, scale_numeric: bool = True, approx: bool = False):
    """Fitted feature pipeline of a model family; ``approx`` takes medians from a sketch."""
    params = params or {}
    if kind == "glassbox_additive":
        return fit_additive(df, cat_cols, num_cols, int(params.get("max_bins", MAX_BINS)), min_freq, int(params.get("interactions", 0)))
    if kind == "gam_spline":
        return fit_preprocessor(df, cat_cols, num_cols, min_freq, use_splines=True,
                                n_knots=int(params.get("n_knots", 10)), approx=approx)
    return fit_preprocessor(df, cat_cols, num_cols, min_freq, scale_numeric=scale_numeric, approx=approx)


MAX_BINS = 128
PAIR_BINS = 8  # coarse bins in which pairs are compared and fitted


def additive_preprocessor(cat_cols: Sequence[str], num_cols: Sequence[str], max_bins: int = MAX_BINS,
                          min_freq: float = 0.01, output_col: str = "features", missing: str = "impute") -> Pipeline:
    """Per-feature step-function basis: quantile bins and categorical levels, all one-hot encoded, none dropped.

    ``missing="impute"`` (training) fills numbers with the median and text with the mode.
    ``missing="keep"`` (explanation) keeps a bin for missing numbers and a level ``Missing``.
    Either way levels rarer than ``min_freq`` are one level, so the indexer learns at
    most 1 / min_freq levels of a column.
    """
    cat_cols, num_cols = list(cat_cols), list(num_cols)
    stages = []
    bins = [f"__bin_{i}" for i in range(len(num_cols))]
    if num_cols:
        if missing == "impute":
            stages.append(MedianImputer(inputCols=num_cols))
        stages.append(QuantileDiscretizer(inputCols=num_cols, outputCols=bins, numBuckets=int(max_bins),
                                          handleInvalid="keep", relativeError=1e-4))
    idx = [f"__lvl_{i}" for i in range(len(cat_cols))]
    if cat_cols:
        stages.append(ModeImputer(inputCols=cat_cols) if missing == "impute" else ModeImputerModel(
            inputCols=cat_cols, state=json.dumps(dict.fromkeys(cat_cols, "Missing"))))
        stages += [RareCategoryGrouper(inputCols=cat_cols, minFreq=min_freq),
                   StringIndexer(inputCols=cat_cols, outputCols=idx, stringOrderType="alphabetAsc",
                                 handleInvalid="keep")]
    if num_cols and missing == "keep":
        stages.append(MissingBin(inputCols=bins, nBins=int(max_bins)))
    ohe_in = bins + idx
    ohe_out = [f"__oh_{i}" for i in range(len(ohe_in))]
    if ohe_in:
        stages.append(OneHotEncoder(inputCols=ohe_in, outputCols=ohe_out, dropLast=False, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=ohe_out, outputCol=output_col))
    return Pipeline(stages=stages)


class MissingBin(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Missing numbers get the bin after the last one (a number's bin is null where the number is)."""

    nBins = Param(Params._dummy(), "nBins", "number of bins", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, nBins=MAX_BINS):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.coalesce(c(n), F.lit(float(self.getOrDefault(self.nBins)))) for n in self.getInputCols()})


def pair_stages(num_cols: Sequence[str], n_blocks: int) -> tuple[list, list[str]]:
    """Coarse codes of every feature for pair terms: quantile bins of numbers, the level index of text.

    Returns (stages, one code column per feature); one-hot blocks ``__pc_i`` come with them.
    """
    coarse = [f"__pair_{i}" for i in range(len(num_cols))]
    codes = coarse + [f"__lvl_{i}" for i in range(n_blocks - len(num_cols))]
    stages = []
    if num_cols:
        stages.append(QuantileDiscretizer(inputCols=list(num_cols), outputCols=coarse, numBuckets=PAIR_BINS, handleInvalid="keep", relativeError=1e-3))
    stages.append(OneHotEncoder(inputCols=codes, outputCols=[f"__pc_{i}" for i in range(n_blocks)], dropLast=False, handleInvalid="keep"))
    return stages, codes


def rank_pairs(df: DataFrame, codes: Sequence[str], label_col: str = "label") -> list[tuple[int, int]]:
    """Feature pairs by how far their cells' outcome rates depart from an additive table, most first.

    One job counts (pair, code, code) cells; the departure of a cell from the sum of its
    row and column effects is squared and weighted by its rows.
    """
    pairs = list(itertools.combinations(range(len(codes)), 2))
    if not pairs:
        return []
    cells = [F.struct(F.lit(k).alias("pair"), c(codes[i]).cast("int").alias("a"), c(codes[j]).cast("int").alias("b")) for k, (i, j) in enumerate(pairs)]
    counts = df.select(c(label_col).cast("double").alias("y"), F.inline(F.array(*cells))).groupBy("pair", "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    mean = lambda w: F.sum(c("n") * c("rate")).over(w) / F.sum("n").over(w)
    table = counts.withColumns({"row": mean(Window.partitionBy("pair", "a")), "col": mean(Window.partitionBy("pair", "b")), "all": mean(Window.partitionBy("pair"))})
    off = c("rate") - c("row") - c("col") + c("all")
    scored = table.groupBy("pair").agg((F.sum(c("n") * off * off) / F.sum("n")).alias("gain")).collect()
    gain = {r["pair"]: r["gain"] for r in scored}
    return [pairs[k] for k in sorted(gain, key=lambda k: (-gain[k], k))]


def fit_additive(df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str], max_bins: int = MAX_BINS, min_freq: float = 0.01,
                 interactions: int = 0, label_col: str = "label", output_col: str = "features", missing: str = "impute") -> PipelineModel:
    """Fitted additive basis, with ``interactions`` pair terms appended to the main effects."""
    main = additive_preprocessor(cat_cols, num_cols, max_bins, min_freq, output_col if not interactions else "__main", missing).fit(df)
    blocks = len(list(cat_cols)) + len(list(num_cols))
    if not interactions or blocks < 2:
        if interactions:
            return PipelineModel(stages=[*main.stages, VectorAssembler(inputCols=["__main"], outputCol=output_col)])
        return main
    stages, codes = pair_stages(num_cols, blocks)
    coded = main.transform(df)
    fitted = []
    for s in stages:
        s = s.fit(coded)
        coded = s.transform(coded)
        fitted.append(s)
    chosen = rank_pairs(coded, codes, label_col)[:interactions]
    terms = [Interaction(inputCols=[f"__pc_{i}", f"__pc_{j}"], outputCol=f"__ix_{i}_{j}") for i, j in chosen]
    last = VectorAssembler(inputCols=["__main", *[x.getOutputCol() for x in terms]], outputCol=output_col)
    return PipelineModel(stages=[*main.stages, *fitted, *terms, last])


def predict_proba(model, df: DataFrame, out_col: str = "prob") -> DataFrame:
    """Probability of class 1 from a fitted classifier/pipeline."""
    scored = model.transform(df)
    return scored.withColumn(out_col, prob_of_one(c("probability")))


def prob_of_one(prob_vec: Column) -> Column:
    return vector_to_array(prob_vec)[1]


def weight_sum(df: DataFrame, weight_col: str = "weight") -> float:
    return float(df.agg(F.sum(weight_col)).first()[0] or 0.0)
