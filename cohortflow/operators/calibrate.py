"""Probability recalibration and calibration tables.

* Tables (``binned_calibration``, ``ece``, ``calibration_report``) are grouped
  jobs over prediction tables keyed by any columns.
* Fits (``fit_platt``, ``fit_isotonic``) use Spark ML on the full table and
  return small driver-side calibrator objects whose ``transform`` is a Column
  expression (Platt) or a Spark ML model (isotonic).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colref import c
from ..functions.exprs import apply_platt_expr, logit
from ..session import remove_scratch, scratch_path
from .quantiles import exact_quantiles

PLATT_C = 1e6


@dataclass
class PlattCalibrator:
    intercept: float
    slope: float
    method: str = "intercept_slope"

    def column(self, p):
        return apply_platt_expr(p, self.intercept, self.slope)

    def transform(self, df: DataFrame, prob_col: str = "prob", out_col: str = "prob_calibrated") -> DataFrame:
        return df.withColumn(out_col, self.column(c(prob_col)))

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.method, float(self.intercept), float(self.slope))],
                                     "method string, intercept double, slope double")


def fit_platt(df: DataFrame, y: str = "y_true", prob: str = "prob", C: float = PLATT_C,
              weight: str | None = None) -> PlattCalibrator:
    """Logistic regression of y on logit(clip p) with L2 penalty 1/(2C) (sklearn's C-form).

    Spark's objective is mean loss + regParam/2 |w|^2, so regParam = 1 / (C * sum of weights).
    """
    data = df.filter(c(y).isNotNull() & c(prob).isNotNull()).select(
        c(y).cast("double").alias("label"), logit(c(prob).cast("double")).alias("z"),
        *([c(weight).cast("double").alias("w")] if weight else []))
    n = data.agg(F.sum("w") if weight else F.count(F.lit(1))).first()[0] or 0
    if not n:
        raise ValueError("no rows to fit a calibrator")
    vec = VectorAssembler(inputCols=["z"], outputCol="features").transform(data)
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (C * float(n)),
                            elasticNetParam=0.0, standardization=False, fitIntercept=True, maxIter=200, tol=1e-10,
                            **({"weightCol": "w"} if weight else {}))
    m = lr.fit(vec)
    return PlattCalibrator(float(m.intercept), float(m.coefficients[0]))


@dataclass
class IsotonicCalibrator:
    model: IsotonicRegressionModel
    method: str = "isotonic"

    def transform(self, df: DataFrame, prob_col: str = "prob", out_col: str = "prob_calibrated") -> DataFrame:
        m = self.model.copy()
        m.setFeaturesCol(prob_col).setPredictionCol(out_col)
        return m.transform(df)


RUN = 1 << 18  # points that one task pools


def _pool(batches):
    """Pools adjacent violators of sorted points or blocks; of equal means too, so that means rise strictly."""
    lo: list[float] = []
    hi: list[float] = []
    total: list[float] = []
    weight: list[float] = []
    for batch in batches:
        for a, b, s, w in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            while total and total[-1] * w >= s * weight[-1]:
                a, s, w = lo.pop(), s + total.pop(), w + weight.pop()
                hi.pop()
            lo.append(a)
            hi.append(b)
            total.append(s)
            weight.append(w)
    if lo:
        columns = [pa.array(x, pa.float64()) for x in (lo, hi, total, weight)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([TaskContext.get().partitionId()] * len(lo), pa.int32())], names=["lo", "hi", "total", "weight", "part"])


def isotonic_knots(df: DataFrame, y: str = "y_true", prob: str = "prob", run: int = RUN) -> DataFrame:
    """(lo, hi, value, weight) of the blocks of the isotonic fit of ``y`` on ``prob``: value is constant from score lo to hi.

    Violators may be pooled in any order.  Each round pools inside ranges of scores, one task a range of about
    ``run`` points, and the next has half as many, wider ranges of the blocks that are left.  It ends when no
    range's last block lies above the next one's first, mostly after a round or two; the table stays in Spark.
    """
    spark = df.sparkSession
    points = df.filter(c(y).isNotNull() & c(prob).isNotNull()).groupBy(c(prob).cast("double").alias("lo")).agg(
        F.sum(c(y).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    path = scratch_path(spark, "isotonic-points")
    points.select("lo", c("lo").alias("hi"), "total", "weight").write.parquet(path)
    blocks = spark.read.parquet(path)
    ranges = max(1, -(-blocks.count() // run))
    while True:
        at = scratch_path(spark, "isotonic-blocks")
        ranged = blocks.select("lo", "hi", "total", "weight").repartitionByRange(ranges, "lo").sortWithinPartitions("lo")
        ranged.mapInArrow(_pool, "lo double, hi double, total double, weight double, part int").write.parquet(at)
        remove_scratch(spark, path)
        path, blocks = at, spark.read.parquet(at)
        mean = c("total") / c("weight")
        ends = blocks.groupBy("part").agg(F.min(mean).alias("first"), F.max(mean).alias("last")).orderBy("part").collect()  # one row a range
        if all(a["last"] < b["first"] for a, b in zip(ends, ends[1:])):
            return blocks.select("lo", "hi", (c("total") / c("weight")).alias("value"), "weight")
        ranges = max(1, ranges // 2)


def fit_isotonic(df: DataFrame, y: str = "y_true", prob: str = "prob") -> IsotonicCalibrator:
    """Monotone (increasing) step fit; ties pooled; linear between blocks, constant outside the fitted range.

    The blocks are pooled in Spark (``isotonic_knots``); the model object that they become holds two
    points a block, not one a distinct score.
    """
    blocks = isotonic_knots(df, y, prob)
    half = F.when(c("lo") < c("hi"), c("weight") / 2).otherwise(c("weight"))
    ends = F.array_distinct(F.array("lo", "hi"))
    data = blocks.select(F.explode(ends).alias("p"), c("value").alias("label"), half.alias("w"))
    model = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="w", isotonic=True).fit(data)
    return IsotonicCalibrator(model)


@dataclass
class NoCalibrator:
    """Leaves the calibrated probability null."""

    method: str = "none"

    def transform(self, df: DataFrame, prob_col: str = "prob", out_col: str = "prob_calibrated") -> DataFrame:
        return df.withColumn(out_col, F.lit(None).cast("double"))


def calibrates(name: str | None) -> bool:
    """Whether a recalibration of this name changes anything; unknown names raise."""
    known = {None: False, "none": False, "intercept_slope": True, "isotonic": True}
    if name not in known:
        raise ValueError(f"unknown recalibration {name!r}: none, intercept_slope and isotonic are there")
    return known[name]


def fit_calibrator(name: str | None, df: DataFrame | None, y: str = "y_true", prob: str = "prob"):
    """The calibrator of that name, fitted on out-of-fold predictions."""
    if not calibrates(name):
        return NoCalibrator()
    return fit_platt(df, y, prob) if name == "intercept_slope" else fit_isotonic(df, y, prob)


def fit_calibrators(name: str | None, df: DataFrame, key: str, values: Sequence, y: str = "y_true", prob: str = "prob") -> dict:
    """The calibrator of each value of ``key``; Platt lines are fitted together."""
    if not calibrates(name):
        return {v: NoCalibrator() for v in values}
    return fit_platts(df, key, values, y, prob) if name == "intercept_slope" else {v: fit_isotonic(df.filter(c(key) == F.lit(v)), y, prob) for v in values}


def fit_platts(df: DataFrame, key: str, values: Sequence, y: str = "y_true", prob: str = "prob", C: float = PLATT_C, tol: float = 1e-9, max_steps: int = 50) -> dict:
    """``fit_platt`` for every value of ``key`` at once: each Newton step of all lines is one grouped job."""
    rows = df.filter(c(y).isNotNull() & c(prob).isNotNull()).select(c(key).alias("k"), c(y).cast("double").alias("y"), logit(c(prob).cast("double")).alias("z"))
    line, before, step = ({v: (0.0, 0.0) for v in values} for _ in range(3))
    value, done = dict.fromkeys(values, float("inf")), set()
    for _ in range(max_steps):
        todo = [v for v in values if v not in done]
        if not todo:
            break
        pick = lambda at: F.coalesce(*[F.when(c("k") == F.lit(v), F.lit(line[v][at])) for v in todo])
        m = pick(0) + pick(1) * c("z")
        p = 1.0 / (1.0 + F.exp(-m))
        h = p * (1.0 - p)
        # log(1 + exp(m)) without overflow
        loss = F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - c("y") * m
        sums = rows.filter(c("k").isin(todo)).groupBy("k").agg(*[F.sum(x).alias(n) for n, x in {
            "f": loss, "g0": p - c("y"), "g1": (p - c("y")) * c("z"), "h00": h, "h01": h * c("z"), "h11": h * c("z") * c("z")}.items()]).collect()
        found = {r["k"]: r for r in sums}
        for v in todo:
            if v not in found:
                raise ValueError("no rows to fit a calibrator")
            r, (a, b) = found[v], line[v]
            now = r["f"] + b * b / (2 * C)
            if now > value[v] + 1e-10 * abs(now):  # a step too long is halved
                step[v] = tuple(s / 2 for s in step[v])
            else:
                value[v], before[v] = now, line[v]
                g1, h11 = r["g1"] + b / C, r["h11"] + 1 / C
                det = r["h00"] * h11 - r["h01"] ** 2
                step[v] = (0.0, 0.0) if det <= 0 else (-(h11 * r["g0"] - r["h01"] * g1) / det, -(r["h00"] * g1 - r["h01"] * r["g0"]) / det)
            line[v] = tuple(x + s for x, s in zip(before[v], step[v], strict=True))
            if max(map(abs, step[v])) <= tol:
                done.add(v)
    return {v: PlattCalibrator(*line[v]) for v in values}


def save_calibrator(cal, spark, path: str) -> None:
    """``path``/table has the method and the Platt line; an isotonic model lies beside it."""
    platt = isinstance(cal, PlattCalibrator)
    row = (cal.method, float(cal.intercept) if platt else None, float(cal.slope) if platt else None)
    spark.createDataFrame([row], "method string, intercept double, slope double").write.mode("overwrite").parquet(f"{path}/table")
    if isinstance(cal, IsotonicCalibrator):
        cal.model.write().overwrite().save(f"{path}/isotonic")


def load_calibrator(spark, path: str):
    row = spark.read.parquet(f"{path}/table").first()
    if row["method"] == "isotonic":
        return IsotonicCalibrator(IsotonicRegressionModel.load(f"{path}/isotonic"))
    return PlattCalibrator(row["intercept"], row["slope"]) if row["method"] == "intercept_slope" else NoCalibrator()


def _quantile_edges(valid: DataFrame, keys: Sequence[str], bins: int, approx: bool, accuracy: int) -> DataFrame:
    qs = [i / bins for i in range(bins + 1)]
    if approx:
        table = valid.groupBy(*[c(k) for k in keys]).agg(F.percentile_approx("_p", qs, accuracy).alias("quantiles"))
    else:
        table = exact_quantiles(valid, keys, "_p", qs)
    return table.select(*[c(k) for k in keys], F.array_distinct("quantiles").alias("_edges"))


def binned_calibration(preds: DataFrame, keys: Sequence[str] = (), y: str = "y_true", prob: str = "prob",
                       bins: int = 10, approx: bool = False, accuracy: int = 100000, medians: bool = True) -> DataFrame:
    """Quantile-bin calibration table per key group; ``medians=False`` leaves ``prob_median`` out.

    Edges are the linear-interpolated quantiles at i/bins with duplicates
    dropped; bins are right-closed and the first includes the minimum.
    Output: keys, bin, bin_lo, bin_hi, n, pos, pos_rate, prob_mean, prob_median.
    ``approx`` uses ``percentile_approx`` for the edges (bounded memory on huge groups).
    """
    keys = list(keys)
    gkeys = keys or ["_g"]
    valid = preds.filter(c(y).isNotNull() & c(prob).isNotNull()).select(
        *([c(k) for k in keys] or [F.lit(0).alias("_g")]),
        c(y).cast("double").alias("_y"), c(prob).cast("double").alias("_p"))
    # a narrow written table: the passes for edges, bins and medians read it, not the source again
    path = scratch_path(preds.sparkSession, "calibration-rows")
    valid.write.parquet(path)
    valid = preds.sparkSession.read.parquet(path)
    edges = _quantile_edges(valid, gkeys, bins, approx, accuracy)
    # one edge array per key group (keys x (bins+1) doubles); AQE plans the join from its runtime size
    joined = valid.join(edges, gkeys, "inner")
    # a group whose scores are all equal has one edge and one bin, from that score to itself
    binned = joined.withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("_edges", lambda e: e < c("_p"))))) \
        .withColumn("bin_lo", F.get("_edges", c("bin") - 1)) \
        .withColumn("bin_hi", F.coalesce(F.get("_edges", c("bin")), c("bin_lo")))
    cell = [*gkeys, "bin", "bin_lo", "bin_hi"]
    out = binned.groupBy(*[c(k) for k in cell]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"), F.avg("_y").alias("pos_rate"), F.avg("_p").alias("prob_mean"),
        *([F.percentile_approx("_p", 0.5, accuracy).cast("double").alias("prob_median")] if approx else []))
    if medians and not approx:
        middle = exact_quantiles(binned, [*gkeys, "bin"], "_p", [0.5])
        out = out.join(middle.select(*[c(k) for k in gkeys], "bin", F.get("quantiles", F.lit(0)).alias("prob_median")), [*gkeys, "bin"])
    return out if keys else out.drop("_g")


def ece(binned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error per key group from a binned table: sum n_k/N |pos_rate - prob_mean|."""
    keys = list(keys)
    return binned.groupBy(*[c(k) for k in keys]).agg(
        (F.sum(c("n") * F.abs(c("pos_rate") - c("prob_mean"))) / F.sum("n")).alias("ece"))


def calibration_report(preds: DataFrame, keys: Sequence[str] = ("outcome", "featureset", "model"),
                       y: str = "y_true", bins: int = 10, approx: bool = False) -> DataFrame:
    """Per model: n, ece_bins, ece/brier raw and, when any calibrated value exists, calibrated."""
    keys = list(keys)
    long = preds.select(*[c(k) for k in keys], c(y).alias("_y"), F.explode(F.array(
        F.struct(F.lit("raw").alias("variant"), c("prob").cast("double").alias("_p")),
        F.struct(F.lit("calibrated").alias("variant"), c("prob_calibrated").cast("double").alias("_p")),
    )).alias("v")).select(*[c(k) for k in keys], "_y", "v.variant", "v._p")
    vkeys = keys + ["variant"]
    binned = binned_calibration(long, vkeys, "_y", "_p", bins=bins, approx=approx, medians=False)
    e = ece(binned, vkeys)
    brier = long.filter(c("_y").isNotNull() & c("_p").isNotNull()).groupBy(*[c(k) for k in vkeys]).agg(
        F.avg((c("_p") - c("_y")) * (c("_p") - c("_y"))).alias("brier"))
    n = preds.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    per = e.join(brier, vkeys, "full_outer")
    wide = per.groupBy(*[c(k) for k in keys]).pivot("variant", ["raw", "calibrated"]).agg(
        F.first("ece").alias("ece"), F.first("brier").alias("brier"))
    return n.join(wide, keys, "left").select(
        *[c(k) for k in keys], "n", F.lit(bins).alias("ece_bins"),
        c("raw_ece").alias("ece_raw"), c("raw_brier").alias("brier_raw"),
        c("calibrated_ece").alias("ece_calibrated"), c("calibrated_brier").alias("brier_calibrated"))
