"""Bootstrap stability selection.

Bootstrap draws are Poisson(frac) row weights derived from a hash of
(seed, draw, id): no row copies, reproducible, and equal in any engine that
has md5.  The expected draw size is frac * n (the reference samples exactly
n * frac rows with replacement; Poisson weights are the standard streaming
equivalent of that multinomial draw).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.colref import c
from .batchfit import Batch, hashed_draws

RESOLUTION = 2.0 ** -32  # of the uniform hash that draws are made from


def poisson_thresholds(lam: float) -> list[float]:
    """Cumulative Poisson(lam) probabilities P(X <= k), k = 0, 1, ... (inverse-CDF sampling).

    They go on until the rest of the distribution lies below the hash's resolution, whatever ``lam``.
    """
    term = acc = math.exp(-lam)
    out, k = [acc], 0
    while 1.0 - acc > RESOLUTION and (k <= lam or term > 1e-18):
        k += 1
        term *= lam / k
        acc += term
        out.append(acc)
    return out


def uniform_hash(seed: int, draw: Column, id_col: Column) -> Column:
    """U[0,1) from the first 8 hex digits of md5('seed|draw|id')."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), id_col.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(2 ** 32)


def poisson_weight(u: Column, lam: float) -> Column:
    w = F.lit(0)
    for t in poisson_thresholds(lam):
        w = w + (u >= F.lit(t)).cast("int")
    return w


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks on all cores: each becomes many hashes, so the bytes of a table say little about its work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


DRAWN = 8192  # rows whose draws are made at a time


def bootstrap_weights(df: DataFrame, n_draws: int = 200, frac: float = 0.7, seed: int = 42,
                      id_col: str = "row_id") -> DataFrame:
    """(id, draw, w) for every draw and row with w > 0 (no row copies beyond the weight).

    The hashes of a batch of ids are made together (``draws.counts``); ``uniform_hash`` is their column form.
    """
    ids = df.select(c(id_col).alias(id_col))
    schema = T.StructType([*ids.schema.fields, T.StructField("draw", T.IntegerType()), T.StructField("w", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, DRAWN):
                part = batch.slice(lo, DRAWN)
                times = hashed_draws(part.column(1).to_pylist(), n_draws, seed, frac)
                for d in range(n_draws):
                    row = np.flatnonzero(times[:, d])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(np.full(len(row), d, dtype=np.int32)), pa.array(times[row, d].astype(np.int32))],
                                                     names=[id_col, "draw", "w"])

    return _spread(ids.select(c(id_col), c(id_col).cast("string").alias("_key"))).mapInArrow(run, schema)


def draw_sums(df: DataFrame, y: str, features: Sequence[str], n_draws: int = 200, frac: float = 0.7, seed: int = 42,
              id_col: str = "row_id") -> DataFrame:
    """(draw, feature, y, w, wx, wxx): sums of the weights, weighted values and squares of the drawn rows with a
    value, by draw, feature and ``y``.  Tasks add up their rows as products of matrices."""
    features = list(features)
    src = df.select(c(y).cast("double").alias("_y"), c(id_col).cast("string").alias("_key"), *[c(n).cast("double").alias(f"_x{k}") for k, n in enumerate(features)])

    def run(batches):
        total: dict[float | None, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, DRAWN):
                part = batch.slice(lo, DRAWN)
                times = hashed_draws(part.column(1).to_pylist(), n_draws, seed, frac).astype(np.float64)
                label = np.array(part.column(0).to_pylist(), dtype=object)
                x = [part.column(2 + k) for k in range(len(features))]
                here = np.column_stack([col.is_valid().to_numpy(zero_copy_only=False) for col in x]).astype(np.float64)
                value = np.column_stack([col.fill_null(0.0).to_numpy(zero_copy_only=False) for col in x])
                for v in set(label):
                    own = label == v
                    w = times[own].T
                    sums = np.stack([w @ here[own], w @ value[own], w @ (value[own] ** 2)])
                    total[v] = total[v] + sums if v in total else sums
        for v, sums in total.items():
            d, f = np.nonzero(sums[0])
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array([features[k] for k in f], pa.string()), pa.array([v] * len(d), pa.float64()),
                                              *(pa.array(s[d, f]) for s in sums)], names=["draw", "feature", "y", "w", "wx", "wxx"])

    parts = _spread(src).mapInArrow(run, "draw int, feature string, y double, w double, wx double, wxx double")
    return parts.groupBy("draw", "feature", "y").agg(*[F.sum(n).alias(n) for n in ("w", "wx", "wxx")])


def drawn(frac: float) -> Column:
    """w > 0, stated on the hash column: u >= P(X = 0).  (A filter on ``w`` itself would be pushed
    below the projection with the hash inlined once per inverse-CDF threshold.)"""
    return c("_u") >= F.lit(poisson_thresholds(frac)[0])


def with_poisson_weight(df: DataFrame, seed: int, frac: float, id_col: str, draw_col: str = "draw",
                        out: str = "w") -> DataFrame:
    """Add the Poisson(frac) weight of (draw, id).  The hash is a column of its own so the inverse-CDF
    comparisons reuse it (a non-cheap expression referenced many times is not inlined back)."""
    return df.withColumn("_u", uniform_hash(seed, c(draw_col), c(id_col))) \
        .withColumn(out, poisson_weight(c("_u"), frac))


def draw_weight(draw: int, frac: float, seed: int, id_col: str) -> Column:
    return poisson_weight(uniform_hash(seed, F.lit(draw), c(id_col)), frac)


def stability_draws(df: DataFrame, y: str, features: Sequence[str], cat_cols: Sequence[str], num_cols: Sequence[str],
                    n_draws: int = 200, frac: float = 0.7, seed: int = 42, id_col: str = "row_id",
                    min_freq: float = 0.01, l1_ratio: float = 0.5, C: float = 1.0) -> DataFrame:
    """Per draw: weighted balanced elastic net; per source feature the slot with the largest |coef|;
    selected if > 1e-6 and its sign.  Returns a (draw, feature, selected, sign) table.

    Medians, levels and class weights are those of the drawn rows with repeats: a row drawn
    three times counts three times.  The fits of all draws run together (``batchfit``): each iteration is one
    pass over the rows.  A draw without both classes has no rows.
    """
    base = df.filter(c(y).isNotNull()).select(c(id_col).alias("_id"), c(y).cast("double").alias("label"), *[c(n) for n in features])
    batch = Batch.prepare(base, cat_cols, num_cols, None, n_draws, min_freq, draws=(seed, frac))
    fits = batch.fit([(b, C, l1_ratio) for b in range(n_draws)])
    batch.discard()
    sources = slots_to_source(batch.prepared.slots, df.sparkSession)
    coefs = df.sparkSession.createDataFrame([(f.set, i, float(v)) for f in fits if f is not None for i, v in enumerate(f.coef)], "draw int, slot_index int, coef double")
    # of each source's slots the one with the largest coefficient, ties to the first
    best = coefs.join(sources, "slot_index").groupBy("draw", c("source_feature").alias("feature")).agg(
        F.max_by("coef", F.struct(F.abs("coef").alias("size"), (-c("slot_index")).alias("at"))).alias("coef"))
    every = df.sparkSession.createDataFrame([(f.set, n) for f in fits if f is not None for n in features], "draw int, feature string")
    top = F.coalesce("coef", F.lit(0.0))
    return every.join(best, ["draw", "feature"], "left").select("draw", "feature", (F.abs(top) > 1e-6).cast("double").alias("selected"), F.signum(top).alias("sign"))


def stability_summary(draws: DataFrame) -> DataFrame:
    """inclusion_freq = mean selected; sign_consistency = share of draws whose sign equals the sign of the
    mean sign; rounded to 6.  ``draws`` holds one row per (draw, feature), 0 where a draw lacks the feature
    (``stability_draws`` guarantees this)."""
    means = draws.groupBy("feature").agg(F.avg("selected").alias("_inc"), F.avg("sign").alias("_ms"))
    agree = draws.join(means, "feature").groupBy("feature").agg(
        F.first("_inc").alias("_inc"),
        F.avg((F.signum("sign") == F.signum("_ms")).cast("double")).alias("_agree"))
    return agree.select("feature", F.round("_inc", 6).alias("inclusion_freq"),
                        F.round("_agree", 6).alias("sign_consistency"))


def slots_to_source(slots: list[tuple[int, str, str, str | None]], spark) -> DataFrame:
    """Slot -> source column table of a fitted preprocessor (the evident intent of name-prefix matching)."""
    return spark.createDataFrame([(i, n, s, lv) for i, n, s, lv in slots],
                                 "slot_index int, slot string, source_feature string, level string")
