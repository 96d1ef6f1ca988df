import pytest

from cohortflow.session import scratch_path
from cohortflow.sources import (apply_column_mapping, coerce_mostly_numeric, ensure_columns, infer_types,
                                load_column_mapping, load_picks, normalize_col, null_sentinels, read_cohort)


def test_normalize_col():
    assert normalize_col(" 体质指数BMI（kg/m²） ") == "体质指数bmi(kg/m2)"
    assert normalize_col("6、A4 您的性别：") == "6a4您的性别:"
    assert normalize_col("16、A13 收入\n\n") == "16a13收入"


def test_null_sentinels_typed(spark):
    df = spark.createDataFrame([(1, 999.0, "NA", 5), (2, -1.0, "999", -1), (3, float("nan"), "ok", 7)],
                               "id int, x double, s string, k int")
    out = null_sentinels(df, columns=["x", "s", "k"]).orderBy("id").collect()
    assert [r["x"] for r in out] == [None, None, None]
    assert [r["s"] for r in out] == [None, None, "ok"]
    assert [r["k"] for r in out] == [5, None, 7]


def test_read_cohort_csv_roundtrip(spark):
    path = scratch_path(spark, "csv-test")
    df = spark.createDataFrame([("1", "120", "男"), ("2", "999", "NA"), ("3", "", "女")], "id string, sbp string, sex string")
    df.write.option("header", "true").csv(path)
    out = read_cohort(spark, path, "csv")
    assert dict(out.dtypes)["sbp"] == "double"
    rows = out.orderBy("id").collect()
    assert [r["sbp"] for r in rows] == [120.0, None, None]
    assert [r["sex"] for r in rows] == ["男", None, "女"]


def test_column_mapping(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    m = load_column_mapping(spark, [{"from": "a", "to": "x"}, {"from": "zz", "to": "y"}, {"from": "b", "to": "b"}])
    assert apply_column_mapping(df, m).columns == ["x", "b"]
    with pytest.raises(ValueError):
        apply_column_mapping(df, {"a": "b"})


def test_infer_and_coerce(spark):
    rows = [(i, str(i), "L" + str(i % 3), float(i)) for i in range(30)] + [(30, "abc", None, None)]
    df = spark.createDataFrame(rows, "id int, t string, c string, v double")
    kinds = {r["column"]: r["inferred_type"] for r in infer_types(df).collect()}
    assert kinds == {"id": "numeric", "t": "text", "c": "categorical", "v": "numeric"}
    out, cont, cat = coerce_mostly_numeric(df, ["t", "c"])
    assert cont == ["t"] and cat == ["c"]
    assert out.filter("c = 'Missing'").count() == 1
    assert ensure_columns(df, ["id", "zz"]).columns == ["id", "zz"]


def test_load_picks_validation(spark):
    assert load_picks(spark, ["a:b:c"]).count() == 1
    with pytest.raises(ValueError):
        load_picks(spark, ["a:b"])


def test_csv_inference_keeps_identity(spark):
    """19-digit and wider numbers, an id of 999, text ids, codes like 1d and NA tokens survive a round trip."""
    path = scratch_path(spark, "csv-identity")
    rows = [("999", "1234567890123456789", "12345678901234567890123", "P1", "1d", "#N/A", "7"),
            ("-1", "1234567890123456788", "12345678901234567890124", "P2", "2f", "None", "8"),
            ("5", None, "3", "P3", "3", "4", "n/a")]
    names = ["row_id", "long_number", "wide_number", "person", "code", "mixed", "visits"]
    spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).write.option("header", "true").csv(path)
    out = read_cohort(spark, path, "csv")
    assert dict(out.dtypes) == {"row_id": "bigint", "long_number": "bigint", "wide_number": "string", "person": "string",
                                "code": "string", "mixed": "double", "visits": "double"}
    got = {r["person"]: r for r in out.collect()}
    assert {r["row_id"] for r in got.values()} == {999, -1, 5}
    assert got["P1"]["long_number"] == 1234567890123456789 and got["P2"]["long_number"] == 1234567890123456788
    assert got["P3"]["long_number"] is None and got["P1"]["mixed"] is None and got["P3"]["mixed"] == 4.0
    assert [got[p]["code"] for p in ("P1", "P2", "P3")] == ["1d", "2f", "3"]


def test_parquet_ids_are_no_sentinels(spark):
    path = scratch_path(spark, "parquet-ids")
    spark.createDataFrame([(999, 999.0), (1, 2.0)], "row_id long, x double").write.parquet(path)
    assert {(r["row_id"], r["x"]) for r in read_cohort(spark, path).collect()} == {(999, None), (1, 2.0)}


def test_quoted_newlines_are_opt_in(spark):
    path = scratch_path(spark, "csv-lines")
    df = spark.createDataFrame([("1", "a\nb"), ("2", "c")], "row_id string, note string")
    df.write.options(header="true", quoteAll="true").csv(path)
    assert {r["note"] for r in read_cohort(spark, path, "csv", multi_line=True).collect()} == {"a\nb", "c"}


def test_text_ids_of_predictions(spark):
    from cohortflow.sources.readers import load_predictions

    df = spark.createDataFrame([(1, "a7", 1.0, 0.4)], "fold int, row_index string, y_true double, prob double")
    r = load_predictions(spark, df=df, outcome="o", featureset="f", model="m").first()
    assert r["row_index"] == "a7" and r["prob_calibrated"] is None


def test_normalize_col_expr_agrees(spark):
    names = [" 体质指数BMI（kg/m²） ", "6、A4 您的性别：", "16、A13 收入\n\n", "a，b,c·d－e／f"]
    df = spark.createDataFrame([(n,) for n in names], "h string")
    from cohortflow.sources.schema import normalize_col_expr
    assert [r[0] for r in df.select(normalize_col_expr(df.h)).collect()] == [normalize_col(n) for n in names]


def test_inference_casts_no_text(spark):
    """One small aggregate a column decides on its type; edges of BIGINT and of what a double holds."""
    from cohortflow.sources import readers

    big = 2 ** 53
    rows = [("1", str(big), str(big + 1), str(2 ** 63), "1.5", "3d", None, "-9223372036854775808", " 4 "), (None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} string" for k in range(9)))
    got = readers._infer_numeric_strings(df)
    assert [f.dataType.simpleString() for f in got.schema] == ["double", "double", "bigint", "string", "double", "string", "string", "bigint", "double"]
    seen = []
    original = type(df).agg
    try:
        type(df).agg = lambda self, *e: seen.append(len(e)) or original(self, *e)
        readers._infer_numeric_strings(df)
    finally:
        type(df).agg = original
    assert seen == [9]
