"""Driver contract: entry runs, registry is consistent, a sample of queries equals its SQL twin."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["orders", "customer", "lineitem", "labels", "part", "events"]
SAMPLE = ["orthogonal_tables", "cross_rates", "complete_grids", "rule_count_positive", "roc_auc", "binned_calibration", "greedy_prune_curve",
          "stratified_folds", "tier_summary", "qc_numeric_ranges"]


def test_registry_consistent():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 70 and len(qs) >= 90


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["smoke", "urban", "butter", "n", "rate", "sparse"]


def _norm(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else round(v, 6) + 0.0
    return ("null",) if v is None else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    sdf = entry.queries()[name](spark, sf_dir)
    cols = sorted(sdf.columns)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=str)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    b = sorted((tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in res.fetchall()), key=str)
    assert a == b
