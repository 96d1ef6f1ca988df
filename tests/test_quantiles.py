"""Exact quantiles against plain ones: any order, skew, ties, nulls, sketches that miss, brackets too large to list."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import quantiles

QS = [0.0, 0.001, 0.1, 0.25, 0.5, 0.5001, 0.9, 0.999, 1.0]


def groups(n=4000):
    rng = np.random.default_rng(6)
    return {"sorted": np.arange(n) / 7, "reversed": -np.arange(n) ** 2.0, "skewed": np.exp(rng.normal(0, 20, n)), "tied": rng.integers(0, 5, n) * 1.0,
            "one": np.array([3.25]), "two": np.array([1.0, 2.0]), "same": np.full(50, -1.5), "crowd": np.concatenate([np.zeros(n), rng.normal(size=200)])}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(None if k == "same" else k, float(v)) for k, own in groups().items() for v in own] + [("sorted", None)] * 20 + [("empty", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(4).persist()


def check(out):
    got = {r["g"]: r["quantiles"] for r in out.collect()}
    want = {None if k == "same" else k: np.quantile(v, QS) for k, v in groups().items()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert np.allclose(got[k], v, rtol=1e-12, atol=0), k


def test_equal_to_plain_quantiles(table):
    check(quantiles.exact_quantiles(table, ["g"], "v", QS))


@pytest.mark.parametrize("accuracy", [1, 3])
def test_sketches_that_miss(table, monkeypatch, accuracy):
    """A sketch of one or three values brackets nearly nothing rightly."""
    check(quantiles.exact_quantiles(table, ["g"], "v", QS, accuracy=accuracy))


def test_edges_far_from_the_ranks(table, monkeypatch):
    """Edges at the greatest value alone: every rank lies in one cell below them, which later rounds split."""
    real = F.percentile_approx
    calls = []

    def wrong(col, probs, accuracy):
        calls.append(len(probs))
        return F.array_repeat(F.max(col), len(probs)) if len(calls) == 1 else real(col, probs, accuracy)

    monkeypatch.setattr(quantiles.F, "percentile_approx", wrong)
    check(quantiles.exact_quantiles(table, ["g"], "v", QS))
    assert len(calls) > 1


def test_brackets_too_large_to_list(table, monkeypatch):
    """Nothing may be listed: every round only cuts cells into parts, down to single values."""
    monkeypatch.setattr(quantiles, "LISTED", 0)
    check(quantiles.exact_quantiles(table, ["g"], "v", QS))


def test_without_keys_and_equal_to_percentile(spark, table):
    got = quantiles.exact_quantiles(table, [], "v", [0.3, 0.7]).first()["quantiles"]
    want = table.select(F.percentile("v", [0.3, 0.7]).alias("q")).first()["q"]
    assert got == pytest.approx(want, rel=1e-12)
    assert quantiles.exact_quantiles(table.limit(0), ["g"], "v", [0.5]).count() == 0


def test_several_columns(spark, table):
    df = table.select("v", (-F.col("v")).alias("w"), F.lit(None).cast("double").alias("none"))
    got = quantiles.column_quantiles(df, {"v": F.col("v"), "w": F.col("w"), "none": F.col("none")}, [0.25, 0.75])
    assert got["none"] is None and got["v"] == pytest.approx([-got["w"][1], -got["w"][0]])


def test_buckets_by_bisection(spark):
    edges = F.array(*[F.lit(float(x)) for x in (1, 2, 2, 5)])
    got = spark.createDataFrame([(float(x),) for x in (0, 1, 1.5, 2, 3, 5, 6)], "x double").select(quantiles.bucket_of(F.col("x"), edges, 4)).collect()
    assert [r[0] for r in got] == [0, 0, 1, 1, 3, 3, 4]
