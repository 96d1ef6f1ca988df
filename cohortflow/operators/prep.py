"""Preprocessing as Spark ML stages (fit on training rows only, then transform).

Custom column-wise estimators keep their learned state in a JSON string
Param, so fitted pipelines persist with ``DefaultParamsWritable`` and reload
with ``PipelineModel.load``.  Each ``fit`` is one aggregation job over all of
its input columns; ``transform`` is a single projection of literal-folded
expressions (no UDF).

``make_preprocessor`` assembles numeric (median impute -> population
standardize, or cubic B-spline basis) and categorical (mode impute -> rare
level grouping -> one-hot) branches into a feature vector, numeric first.
``slot_table`` maps every vector slot to its source column and level.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler, VectorSizeHint, VectorSlicer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colref import c
from .quantiles import column_modes, column_quantiles


class _HasState(Params):
    state = Param(Params._dummy(), "state", "learned state as JSON", typeConverter=TypeConverters.toString)

    def _state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


def _num(col: Column) -> Column:
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


# ---------------------------------------------------------------- E1 median imputer

class MedianImputerModel(Model, HasInputCols, _HasState, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        med = self._state()
        return df.withColumns({n: F.coalesce(_num(c(n)), F.lit(med[n]).cast("double")) for n in self.getInputCols()})


class MedianImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Exact median per column (linear interpolation) learned on the fitting rows.

    ``approx=True`` switches to ``percentile_approx`` for bounded memory on huge inputs.
    """
    approx = Param(Params._dummy(), "approx", "use percentile_approx", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCols=None, approx=False):
        super().__init__()
        self._setDefault(approx=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        cols = self.getInputCols()
        found = column_quantiles(df, {n: _num(c(n)) for n in cols}, [0.5], self.getOrDefault(self.approx))
        med = {n: (None if q is None else float(q[0])) for n, q in found.items()}
        return MedianImputerModel(inputCols=cols, state=json.dumps(med))


# ---------------------------------------------------------------- E2 mode imputer

class ModeImputerModel(Model, HasInputCols, _HasState, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        mode = self._state()
        return df.withColumns({n: F.coalesce(c(n).cast("string"), F.lit(mode[n]).cast("string"))
                               for n in self.getInputCols()})


class ModeImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Most frequent non-null value per column; ties go to the smallest value."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        cols = self.getInputCols()
        return ModeImputerModel(inputCols=cols, state=json.dumps(column_modes(df, cols)))


# ---------------------------------------------------------------- E3 rare category grouper

class RareCategoryGrouperModel(Model, HasInputCols, _HasState, DefaultParamsReadable, DefaultParamsWritable):
    otherLabel = Param(Params._dummy(), "otherLabel", "label for rare/unseen levels",
                       typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, state=None, otherLabel="Other"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = self._state()
        other = F.lit(self.getOrDefault(self.otherLabel))
        out = {}
        for n in self.getInputCols():
            levels = [v for v in keep[n]["levels"]]
            col = c(n).cast("string")
            kept = col.isin(levels) if levels else F.lit(False)
            null_branch = F.lit(None).cast("string") if keep[n]["keep_null"] else other
            out[n] = F.when(col.isNull(), null_branch).when(kept, col).otherwise(other)
        return df.withColumns(out)


class RareCategoryGrouper(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Keep levels whose training frequency (NULL counted as a level) is >= minFreq; others -> otherLabel.

    Fit is one unpivot + ``groupBy(column, value).count()`` over all columns;
    the kept-level lists are bounded (at most 1/minFreq levels per column).
    """
    minFreq = Param(Params._dummy(), "minFreq", "minimum level frequency", typeConverter=TypeConverters.toFloat)
    otherLabel = Param(Params._dummy(), "otherLabel", "label for rare/unseen levels",
                       typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, minFreq=0.01, otherLabel="Other"):
        super().__init__()
        self._setDefault(minFreq=0.01, otherLabel="Other")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> RareCategoryGrouperModel:
        cols = self.getInputCols()
        min_freq = self.getOrDefault(self.minFreq)
        long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value"))
                                            for n in cols])).alias("kv")).select("kv.*")
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        total = long.groupBy("column").agg(F.count(F.lit(1)).alias("total"))
        kept = counts.join(total, "column").filter(c("n") / c("total") >= min_freq).collect()  # <= 1/minFreq per column
        state = {n: {"levels": [], "keep_null": False} for n in cols}
        for r in kept:
            if r["value"] is None:
                state[r["column"]]["keep_null"] = True
            else:
                state[r["column"]]["levels"].append(r["value"])
        for n in cols:
            state[n]["levels"].sort()
        return RareCategoryGrouperModel(inputCols=cols, state=json.dumps(state),
                                        otherLabel=self.getOrDefault(self.otherLabel))


# ---------------------------------------------------------------- E5 population standardizer

class PopulationScalerModel(Model, HasInputCols, _HasState, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        out = {}
        for n in self.getInputCols():
            mean, std = st[n]
            x = _num(c(n))
            out[n] = F.lit(0.0) * x if not std else (x - F.lit(mean)) / F.lit(std)
        return df.withColumns(out)


class PopulationScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population std; a constant column maps to 0 (Spark's StandardScaler uses the sample std)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        aggs = []
        for i, n in enumerate(cols):
            aggs += [F.avg(_num(c(n))).alias(f"a{i}"), F.stddev_pop(_num(c(n))).alias(f"s{i}")]
        row = df.agg(*aggs).first() if cols else None
        st = {n: (row[f"a{i}"], row[f"s{i}"]) for i, n in enumerate(cols)}
        return PopulationScalerModel(inputCols=cols, state=json.dumps(st))


# ---------------------------------------------------------------- E6 cubic B-spline basis

def _cardinal_cubic(u: Column) -> Column:
    """Uniform cubic B-spline with support [0, 4]."""
    return (F.when((u >= 0) & (u < 1), u * u * u / 6.0)
            .when((u >= 1) & (u < 2), (-3 * u * u * u + 12 * u * u - 12 * u + 4) / 6.0)
            .when((u >= 2) & (u < 3), (3 * u * u * u - 24 * u * u + 60 * u - 44) / 6.0)
            .when((u >= 3) & (u <= 4), (4 - u) * (4 - u) * (4 - u) / 6.0)
            .otherwise(F.lit(0.0)))


def spline_columns(x: Column, lo: float, hi: float, n_knots: int, name: str) -> list[Column]:
    """Cubic B-spline basis on uniform knots lo..hi (extended by 3 knots each side), last spline dropped,
    inputs clipped to [lo, hi] (constant extrapolation).  n_knots + 1 columns."""
    h = (hi - lo) / (n_knots - 1) if hi > lo else 1.0
    xc = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    n_splines = n_knots + 2
    cols = []
    for j in range(n_splines - 1):
        t_j = lo + (j - 3) * h
        cols.append(_cardinal_cubic((xc - F.lit(t_j)) / F.lit(h)).alias(f"{name}_sp{j}"))
    return cols


class SplineBasisModel(Model, HasInputCols, _HasState, DefaultParamsReadable, DefaultParamsWritable):
    nKnots = Param(Params._dummy(), "nKnots", "number of knots", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, state=None, nKnots=10):
        super().__init__()
        self._set(**self._input_kwargs)

    def outputCols(self) -> list[str]:
        k = self.getOrDefault(self.nKnots)
        return [f"{n}_sp{j}" for n in self.getInputCols() for j in range(k + 1)]

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        k = self.getOrDefault(self.nKnots)
        extra = []
        for n in self.getInputCols():
            lo, hi = st[n]
            extra += spline_columns(_num(c(n)), lo, hi, k, n)
        return df.select("*", *extra)


class SplineBasis(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Uniform-knot cubic B-spline basis between each column's training min and max."""
    nKnots = Param(Params._dummy(), "nKnots", "number of knots", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, nKnots=10):
        super().__init__()
        self._setDefault(nKnots=10)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SplineBasisModel:
        cols = self.getInputCols()
        aggs = []
        for i, n in enumerate(cols):
            aggs += [F.min(_num(c(n))).alias(f"lo{i}"), F.max(_num(c(n))).alias(f"hi{i}")]
        row = df.agg(*aggs).first()
        st = {n: (row[f"lo{i}"], row[f"hi{i}"]) for i, n in enumerate(cols)}
        return SplineBasisModel(inputCols=cols, state=json.dumps(st), nKnots=self.getOrDefault(self.nKnots))


# ---------------------------------------------------------------- E7 preprocessor

def make_preprocessor(cat_cols: Sequence[str], num_cols: Sequence[str], min_freq: float = 0.01,
                      other_label: str = "Other", scale_numeric: bool = True, use_splines: bool = False,
                      n_knots: int = 10, drop_first: bool = False, output_col: str = "features") -> Pipeline:
    """Numeric (median impute -> scale | spline) + categorical (mode -> rare -> one-hot), numeric slots first.

    ``drop_first`` leaves out each column's first level (alphabetical), which becomes the baseline.
    One-hot uses ``StringIndexer(alphabetAsc, handleInvalid=keep)`` + ``OneHotEncoder(dropLast=True)``:
    the kept "unknown" slot is exactly the dropped one, so unseen/NULL levels map to all zeros.
    """
    cat_cols, num_cols = list(cat_cols), list(num_cols)
    stages = []
    num_out = list(num_cols)
    if num_cols:
        stages.append(MedianImputer(inputCols=num_cols))
        if use_splines:
            stages.append(SplineBasis(inputCols=num_cols, nKnots=n_knots))
            num_out = [f"{n}_sp{j}" for n in num_cols for j in range(n_knots + 1)]
        elif scale_numeric:
            stages.append(PopulationScaler(inputCols=num_cols))
    ohe_out = []
    if cat_cols:
        idx = [f"__idx_{i}" for i in range(len(cat_cols))]
        ohe_out = [f"__ohe_{i}" for i in range(len(cat_cols))]
        stages += [ModeImputer(inputCols=cat_cols),
                   RareCategoryGrouper(inputCols=cat_cols, minFreq=min_freq, otherLabel=other_label),
                   StringIndexer(inputCols=cat_cols, outputCols=idx, stringOrderType="alphabetAsc",
                                 handleInvalid="keep"),
                   OneHotEncoder(inputCols=idx, outputCols=ohe_out, dropLast=True, handleInvalid="error")]
        if drop_first:
            stages.append(FirstSlotDropper(inputCols=ohe_out))
    stages.append(VectorAssembler(inputCols=num_out + ohe_out, outputCol=output_col, handleInvalid="keep"))
    return Pipeline(stages=stages)


class FirstSlotDropper(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the first slot of each one-hot block: the first level in alphabetical order becomes the baseline."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        for n in self.getInputCols():
            size = df.schema[n].metadata["ml_attr"]["num_attrs"]
            if size > 1:
                cut = VectorSlicer(inputCol=n, outputCol=f"{n}_rest", indices=list(range(1, size)))
                df = cut.transform(df).drop(n).withColumnRenamed(f"{n}_rest", n)
            else:  # a column with one level keeps a constant zero, as vectors need a slot
                df = VectorSizeHint(inputCol=n, size=1).transform(df.withColumn(n, array_to_vector(F.array(F.lit(0.0)))))
        return df


def slot_table(model: PipelineModel, cat_cols: Sequence[str], num_cols: Sequence[str],
               drop_first: bool = False) -> list[tuple[int, str, str, str | None]]:
    """(slot, feature name, source column, level) for every vector slot of a fitted preprocessor.

    Feature names are ``col`` for numeric slots (``col_spJ`` for splines) and
    ``col=level`` for one-hot slots.  Built from fitted metadata, not from data.
    """
    slots: list[tuple[int, str, str, str | None]] = []
    spline = next((s for s in model.stages if isinstance(s, SplineBasisModel)), None)
    i = 0
    for n in num_cols:
        if spline is not None:
            for j in range(spline.getOrDefault(spline.nKnots) + 1):
                slots.append((i, f"{n}_sp{j}", n, None))
                i += 1
        else:
            slots.append((i, n, n, None))
            i += 1
    by_col: dict[str, list[str]] = {}
    for s in model.stages:
        if isinstance(s, StringIndexerModel):
            if s.isSet(s.inputCols):
                by_col.update({n: list(lv) for n, lv in zip(s.getInputCols(), s.labelsArray)})
            else:
                by_col[s.getInputCol()] = list(s.labels)
    for n in cat_cols:
        levels = by_col.get(n, [])  # alphabetical; the extra "unknown" slot is the dropped one
        if drop_first and len(levels) <= 1:
            slots.append((i, f"{n}=", n, None))  # the constant slot of a column whose only level is the baseline
            i += 1
        for lv in levels[1:] if drop_first else levels:
            slots.append((i, f"{n}={lv}", n, lv))
            i += 1
    return slots


# ---------------------------------------------------------------- E8 class weights

def balanced_class_weight(df: DataFrame, y: str, out_col: str = "weight") -> DataFrame:
    """Add w_c = n / (n_classes * n_c).  The class table has one row per class (two here)."""
    counts = df.filter(c(y).isNotNull()).groupBy(c(y).alias("_cls")).agg(F.count(F.lit(1)).alias("_nc"))
    w = counts.select("_cls", (F.sum("_nc").over(_all()) / (F.count("_nc").over(_all()) * c("_nc"))).alias(out_col))
    # two rows for a binary outcome; Spark broadcasts it by its size
    return df.join(w, df[y] == w["_cls"], "left").drop("_cls")


def class_weight_table(df: DataFrame, y: str) -> DataFrame:
    counts = df.filter(c(y).isNotNull()).groupBy(c(y).alias(y)).agg(F.count(F.lit(1)).alias("n_c"))
    return counts.select(c(y), "n_c", (F.sum("n_c").over(_all()) / (F.count("n_c").over(_all()) * c("n_c")))
                         .alias("weight"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


# ---------------------------------------------------------------- fused fit (two scans)

def fit_preprocessor(df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str], min_freq: float = 0.01,
                     other_label: str = "Other", scale_numeric: bool = True, use_splines: bool = False,
                     n_knots: int = 10, output_col: str = "features", approx: bool = False, drop_first: bool = False,
                     weight_col: str | None = None) -> PipelineModel:
    """Fit the ``make_preprocessor`` pipeline with a few aggregation jobs instead of one per stage.

    ``weight_col`` holds whole numbers: a row of weight 3 counts as three rows (bootstrap draws).

    * numeric jobs: exact median, count, mean, population variance, min, max per column; the
      post-imputation mean/std follow from combining the observed moments with the imputed
      median mass (parallel-variance formula), so no second pass over imputed data;
    * categorical job: level counts per column (unpivot + group), of which only the levels the
      model keeps are collected (frequency >= min_freq after imputation, or the mode): at most
      1/min_freq + 2 rows per column.

    Returns the same fitted stages as ``make_preprocessor(...).fit(df)``.
    """
    cat_cols, num_cols = list(cat_cols), list(num_cols)
    stages = []
    num_out = list(num_cols)
    if num_cols:
        w = F.lit(1.0) if weight_col is None else c(weight_col).cast("double")
        copies = df if weight_col is None else df.withColumn("_copy", F.explode(F.sequence(F.lit(1), c(weight_col).cast("int"))))
        medians = column_quantiles(copies, {n: _num(c(n)) for n in num_cols}, [0.5], approx)
        middle = {n: (q[0] if q else 0.0) for n, q in medians.items()}
        aggs = [F.sum(w).alias("_n")]
        for i, n in enumerate(num_cols):
            x = _num(c(n))
            d = x - F.lit(float(middle[n]))  # moments around the median lose no digits
            aggs += [F.sum(F.when(x.isNotNull(), w)).alias(f"cnt{i}"), F.sum(w * d).alias(f"s{i}"),
                     F.sum(w * d * d).alias(f"ss{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        row = df.agg(*aggs).first()
        total = row["_n"]
        med, scale, rng = {}, {}, {}
        for i, n in enumerate(num_cols):
            m, cnt = (medians[n][0] if medians[n] else None), row[f"cnt{i}"]
            shift = row[f"s{i}"] / cnt if cnt else 0.0
            mu, var = middle[n] + shift, max((row[f"ss{i}"] or 0.0) / cnt - shift * shift, 0.0) if cnt else 0.0
            med[n] = float(m) if m is not None else None
            if m is None or not total:
                scale[n] = (None, None)
                rng[n] = (None, None)
                continue
            k = total - cnt
            mean2 = (cnt * mu + k * m) / total
            var2 = (cnt * (var + (mu - mean2) ** 2) + k * (m - mean2) ** 2) / total
            scale[n] = (mean2, float(np.sqrt(max(var2, 0.0))))
            rng[n] = (min(row[f"lo{i}"], m), max(row[f"hi{i}"], m))
        stages.append(MedianImputerModel(inputCols=num_cols, state=json.dumps(med)))
        if use_splines:
            stages.append(SplineBasisModel(inputCols=num_cols, state=json.dumps(rng), nKnots=n_knots))
            num_out = [f"{n}_sp{j}" for n in num_cols for j in range(n_knots + 1)]
        elif scale_numeric:
            stages.append(PopulationScalerModel(inputCols=num_cols, state=json.dumps(scale)))
    ohe_out = []
    if cat_cols:
        times = F.lit(1).cast("long") if weight_col is None else c(weight_col).cast("long")
        long = df.select(times.alias("times"), F.inline(F.array(*[F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value"))
                                                                  for n in cat_cols])))
        counts = long.groupBy("column", "value").agg(F.sum("times").alias("cnt"))
        # one small row a column: no task ranks a column's levels
        known = F.when(c("value").isNotNull(), F.struct((-c("cnt")).alias("less"), c("value").alias("value")))
        columns = counts.groupBy("column").agg(F.sum("cnt").alias("total"), F.count("value").alias("n_levels"), F.min(known).alias("most"))
        columns = columns.select("column", "total", "n_levels", F.col("most.value").alias("mode"))
        # bounded collect: the modal level, the NULL row and levels that can pass the frequency test
        rows = counts.join(columns, "column").filter(c("value").isNull() | (c("value") == c("mode")) | (c("cnt") >= c("total") * min_freq)) \
            .select("column", "value", "cnt", "total", "n_levels", "mode").collect()
        by_col: dict[str, list] = {n: [] for n in cat_cols}
        for r in rows:
            by_col[r["column"]].append(r)
        modes, keep, labels = {}, {}, []
        for n in cat_cols:
            rs = by_col[n]
            total = rs[0]["total"] if rs else 0
            n_null = sum(r["cnt"] for r in rs if r["value"] is None)
            mode = rs[0]["mode"] if rs else None
            modes[n] = mode
            levels = []
            for r in rs:
                if r["value"] is None:
                    continue
                cnt = r["cnt"] + (n_null if r["value"] == mode else 0)
                if total and cnt / total >= min_freq:
                    levels.append(r["value"])
            keep_null = mode is None and total > 0 and n_null / total >= min_freq
            keep[n] = {"levels": sorted(levels), "keep_null": keep_null}
            n_levels = rs[0]["n_levels"] if rs else 0
            seen = set(levels)
            if n_levels > len(levels) or (mode is None and n_null and not keep_null):
                seen.add(other_label)
            labels.append(sorted(seen))
        idx = [f"__idx_{i}" for i in range(len(cat_cols))]
        ohe_out = [f"__ohe_{i}" for i in range(len(cat_cols))]
        # one indexer per column: label lists differ in length (a multi-column model pads them with NULLs)
        indexers = [StringIndexerModel.from_labels(lv, inputCol=n, outputCol=o, handleInvalid="keep")
                    for n, lv, o in zip(cat_cols, labels, idx)]
        stages += [ModeImputerModel(inputCols=cat_cols, state=json.dumps(modes)),
                   RareCategoryGrouperModel(inputCols=cat_cols, state=json.dumps(keep), otherLabel=other_label),
                   *indexers, _onehot_model(df.sparkSession, indexers, cat_cols, labels, idx, ohe_out)]
        if drop_first:
            stages.append(FirstSlotDropper(inputCols=ohe_out))
    stages.append(VectorAssembler(inputCols=num_out + ohe_out, outputCol=output_col, handleInvalid="keep"))
    return PipelineModel(stages=stages)


def _onehot_model(spark, indexers, cat_cols, labels, idx, outputs):
    """Fitted OneHotEncoderModel for fitted indexers: the category sizes come from the indexers'
    output metadata, so fitting on a one-row frame is exactly the fit on the training data."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, T.StringType()) for n in cat_cols])
    tiny = spark.createDataFrame([tuple(lv[0] if lv else None for lv in labels)], schema)
    for ix in indexers:
        tiny = ix.transform(tiny)
    return OneHotEncoder(inputCols=list(idx), outputCols=list(outputs), dropLast=True,
                         handleInvalid="error").fit(tiny)
