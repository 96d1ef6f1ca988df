"""The isotonic fit in ranges against plain pooling, with ranges that must meet, and a million distinct scores."""

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from cohortflow.operators import calibrate


def plain(x, y):
    order = np.argsort(x, kind="stable")
    out = []
    for p in np.unique(x[order]):
        own = y[x == p]
        a, s, w = p, own.sum(), len(own)
        hi = p
        while out and out[-1][2] / out[-1][3] >= s / w:
            a, _, s2, w2 = out.pop()
            s, w = s + s2, w + w2
        out.append((a, hi, s, w))
    return [(a, b, s / w, w) for a, b, s, w in out]


@pytest.mark.parametrize("shape", ["noise", "falling", "sawtooth", "rising", "ties"])
@pytest.mark.parametrize("run", [1 << 18, 60])
def test_blocks_equal_plain_pooling(spark, shape, run):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.permutation(n) / n
    y = {"noise": (rng.random(n) < x).astype(float), "falling": 1 - x, "sawtooth": (x * 7) % 1, "rising": x ** 2, "ties": (rng.random(n) < x).astype(float)}[shape]
    if shape == "ties":
        x = np.round(x, 1)
    df = spark.createDataFrame([*zip(y.tolist(), x.tolist()), (None, 0.5), (1.0, None)], "y_true double, prob double")
    got = sorted(tuple(r) for r in calibrate.isotonic_knots(df, run=run).collect())
    assert np.allclose(got, plain(x, y), atol=1e-12)


def test_calibrator_equals_the_plain_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.random(3000)
    df = spark.createDataFrame([(float(rng.random() < p), float(p)) for p in x], "y_true double, prob double").persist()
    ours = calibrate.fit_isotonic(df).transform(df)
    theirs = IsotonicRegression(featuresCol="prob", labelCol="y_true", predictionCol="want").fit(df).transform(ours)
    assert theirs.select(F.max(F.abs(F.col("want") - F.col("prob_calibrated")))).first()[0] < 1e-9


def test_a_million_distinct_scores(spark):
    df = spark.range(1_000_000).select((F.col("id") / 1e6).alias("prob"), (F.pmod(F.xxhash64("id"), F.lit(1000)) < F.col("id") / 1000).cast("double").alias("y_true"))
    knots = calibrate.isotonic_knots(df).persist()
    mass = knots.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("value")).alias("pos"), F.count("*").alias("blocks")).first()
    pos = df.agg(F.sum("y_true")).first()[0]
    assert mass["n"] == 1_000_000 and mass["pos"] == pytest.approx(pos) and mass["blocks"] < 20_000
    values = [r["value"] for r in knots.orderBy("lo").collect()]
    assert all(a < b for a, b in zip(values, values[1:]))
    assert knots.filter(F.abs(F.col("value") - F.col("lo")) > 0.2).filter("weight > 5000").count() == 0


def test_no_rows(spark):
    empty = spark.createDataFrame([], "y_true double, prob double")
    assert calibrate.isotonic_knots(empty).count() == 0
