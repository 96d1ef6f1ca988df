"""Stateless scoring of a file stream with a saved model equals batch scoring."""

import numpy as np

from cohortflow.operators.scoring import fit_picks, score_models
from cohortflow.session import scratch_path
from cohortflow.streaming import score_stream


def test_score_stream_matches_batch(spark):
    rng = np.random.default_rng(4)
    n = 300
    x = rng.normal(0, 1, n)
    rows = [(i, float(x[i]), ["a", "b"][i % 2], float(rng.random() < 1 / (1 + np.exp(-x[i]))))
            for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, x double, g string, y_out double")
    root = scratch_path(spark, "stream-models")
    fit_picks(df, [{"outcome": "out", "featureset": "FS", "model": "elasticnet"}], {"FS": ["x", "g"]}, {}, root,
              inner=2)
    src = scratch_path(spark, "stream-src")
    df.drop("y_out").write.parquet(src)
    stream = spark.readStream.schema("row_id long, x double, g string").parquet(src)
    q = score_stream(stream, root).writeStream.format("memory").queryName("scored_stream").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["row_index"]: r["prob"] for r in spark.sql("SELECT * FROM scored_stream").collect()}
    exp = {r["row_index"]: r["prob"] for r in score_models(df.drop("y_out"), root).collect()}
    assert len(got) == n and got.keys() == exp.keys()
    assert max(abs(got[k] - exp[k]) for k in got) < 1e-12
